"""Model clients against a server that fails, and pair-vocabulary counts against the tokenizer's."""

import json
import sys
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import stylarium
from stylarium.operators import bpe
from stylarium.sources import clients, versions

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(stylarium)


class Stub:
    """Answers in capitals. "flaky" prompts fail at first, "bad" ones always, "down" ones until the server is mended."""

    def __init__(self):
        self.calls, self.times, self.mended, lock, stub = Counter(), [], False, threading.Lock(), self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                self.send_response(200)
                self.end_headers()

            def do_POST(self):
                prompt = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][0]["content"]
                with lock:
                    stub.calls[prompt] += 1
                    stub.times.append(time.monotonic())
                    first = stub.calls[prompt] == 1
                code = 400 if "bad" in prompt else 503 if "flaky" in prompt and first else 429 if "down" in prompt and not stub.mended else 200
                self.send_response(code)
                self.end_headers()
                if code == 200:
                    self.wfile.write(json.dumps({"choices": [{"message": {"content": prompt.upper()}}]}).encode())

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_address[1]}/v1/chat/completions"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


@pytest.fixture
def stub():
    s = Stub()
    yield s
    s.server.shutdown()


def test_no_answer_is_asked_for_twice(spark, tmp_path, stub):
    store, limits = f"file://{tmp_path}/answers", clients.Limits(at_once=3, tries=3, wait=0.01)
    prompts = [f"plain {i}" for i in range(20)] + [f"flaky {i}" for i in range(6)] + ["bad", "down", None] + ["plain 1"] * 30
    df = spark.createDataFrame(list(enumerate(prompts)), "id int, p string").repartition(4)
    make = clients.chat_client(stub.url, "m")
    got = {r["id"]: (r["answer"], r["error"]) for r in clients.answers(df, "p", store, make, "m", limits, tasks=2).collect()}
    assert len(got) == len(prompts)
    for i, p in enumerate(prompts):
        assert got[i] == ((None, None) if p is None else (None, "ValueError: HTTP 400") if p == "bad" else (None, "Transient: HTTP 429") if p == "down" else (p.upper(), None))
    assert all(stub.calls[f"plain {i}"] == 1 for i in range(20)) and all(stub.calls[f"flaky {i}"] == 2 for i in range(6))
    assert stub.calls["bad"] == 1 and stub.calls["down"] == 3
    # Only what has no answer, and what is new, is asked for again.
    stub.mended, before = True, sum(stub.calls.values())
    more = df.union(spark.createDataFrame([(900, "new")], "id int, p string"))
    again = {r["p"]: r["answer"] for r in clients.answers(more, "p", store, make, "m", limits).collect()}
    assert again["down"] == "DOWN" and again["new"] == "NEW" and sum(stub.calls.values()) == before + 3
    # Another model's answers are its own.
    clients.answers(df.where("p = 'plain 1'"), "p", store, make, "other", limits)
    assert stub.calls["plain 1"] == 2 and versions.manifest(spark, store)["version"] == 3
    assert clients.healthy(stub.url) and not clients.healthy("http://127.0.0.1:9/")


def test_a_rate_is_kept(spark, tmp_path, stub):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(12)], "id int, p string")
    clients.answers(df, "p", f"file://{tmp_path}/s", clients.chat_client(stub.url, "m"), "m", clients.Limits(at_once=8, per_second=20), tasks=1)
    assert max(stub.times) - min(stub.times) >= 0.9 * 11 / 20


TEXTS = [None, "", " ", "it's  a\n\n test ", "<|endoftext|>x!!<|endoftext|>", "é😀 ñandú 12345", "x" * 3000, "don't  I'LL 3rd", "Das\tist é", "中文 字。", "a b  c", "ab" * 2000]


def test_pair_counts_equal_the_tokenizers(spark, small):
    tokenizers = pytest.importorskip("tokenizers")
    path = str(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    model = tokenizers.Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    rows = docs.unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(TEXTS)], "id long, text string"))
    texts = {r["id"]: r["text"] for r in rows.collect()}
    counts = bpe.token_counts(rows, "id", "text", path)
    got = {r["id"]: r["tokens"] for r in counts.collect()}
    assert got == {i: len(model.encode(t or "", add_special_tokens=False).ids) for i, t in texts.items()}
    over = {r["id"] for r in bpe.over_budget(rows, "id", "text", path, 768, 2048).collect()}
    assert over == {i for i, n in got.items() if n + 768 > 2048}
    numbers = bpe.budget_numbers(counts).first()
    assert (numbers["n"], numbers["most"]) == (len(got), max(got.values()))
    with pytest.raises(ValueError, match="byte-level"):
        bpe.vocabulary(str(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")))
