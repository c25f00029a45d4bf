"""The loop as a stream, stopped in mid-loop and started again, against the batch plan."""

import json
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import stylarium
from stylarium.plans import loop
from stylarium.streaming import loop_stream

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(stylarium)
SETTINGS = loop.Settings(most=3)


def facts(i: int, r: int) -> tuple[str, int, float]:
    """A round's text, number of violations and score, from id and round alone."""
    return ("" if (i + r) % 5 == 0 else f"answer {i} {r}"), (i * r) % 3, -((i * 7 + r) % 10) / 10


def steps(folder):
    def make():
        def generate(request):
            i, r = int(request["id"]), request["iter"] + 1
            with open(f"{folder}/calls-{i}-{r}", "a") as f:
                f.write("x")
            if i % 7 == 3 and r == 1 + i % 2:
                raise TimeoutError
            if i % 4 == 1:  # flaky: its first call of a round fails
                with open(f"{folder}/calls-{i}-{r}") as f:
                    if len(f.read()) == 1:
                        raise ConnectionError
            return facts(i, r)[0]

        def told(text):
            return (int(x) for x in text.split()[1:])

        def verify(_, text):
            return [{"kind": "entity_missing", "expected": f"e{n}"} for n in range(facts(*told(text))[1])]

        return loop_stream.Steps(generate, verify, lambda _, text: facts(*told(text))[2])

    return make


def batch(spark, ids):
    empty = F.expr("cast(array() as array<struct<id:string,plain:string,styled:string>>)")
    rows = spark.createDataFrame([(str(i), f"input {i}") for i in ids], "id string, input string").withColumn("exemplars", empty)
    i, r = F.col("id").cast("int"), F.col("iter") + 1
    fails = (i % 7 == 3) & (r == 1 + i % 2)

    def generate(df):
        text = F.when((i + r) % 5 == 0, "").otherwise(F.concat(F.lit("answer "), "id", F.lit(" "), r.cast("string")))
        return df.withColumn("text", F.when(~fails, text)).withColumn("error", F.when(fails, "TimeoutError"))

    def verify(df):
        one = lambda n: F.struct(F.lit("entity_missing").alias("kind"), F.concat(F.lit("e"), n.cast("string")).alias("expected"), F.lit(None).cast("string").alias("actual"))
        n = (i * r) % 3
        return df.withColumn("violations", F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.expr("cast(array() as array<struct<kind:string,expected:string,actual:string>>)")))

    out = loop.run(rows, generate, verify, lambda df: df.withColumn("score", -((i * 7 + r) % 10) / 10.0), SETTINGS)
    return {x["id"]: (x["output"], x["selected_round"], x["total_rounds"], x["termination"], x["fallback_kind"], x["error"]) for x in out.collect()}


def wait_for(query, done, seconds=90):
    end = time.time() + seconds
    while time.time() < end and not done():
        assert query.exception() is None
        time.sleep(0.3)
    assert done()


@pytest.mark.parametrize("ids", [range(30)])
def test_a_stopped_loop_goes_on(spark, tmp_path, ids):
    source, sink, checkpoint, calls = (str(tmp_path / x) for x in ("in", "out", "check", "calls"))
    for x in (source, calls):
        (tmp_path / x).mkdir()
    with open(f"{source}/a.json", "w") as f:
        f.writelines(json.dumps({"id": str(i), "input": f"input {i}"}) + "\n" for i in ids)

    def start():
        rows = spark.readStream.schema("id string, input string").json(source)
        out = loop_stream.run_stream(rows, steps(calls), SETTINGS, retries=1, wait=50)
        return out.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", sink).outputMode("append").trigger(processingTime="0 seconds").start()

    made = lambda r: sum(1 for _ in (tmp_path / "calls").glob(f"calls-*-{r}"))
    query = start()
    wait_for(query, lambda: made(2) > 0)
    query.stop()
    with open(f"{source}/b.json", "w") as f:  # a request that comes again is ignored
        f.write(json.dumps({"id": "0", "input": "other"}) + "\n")
    query = start()
    results = lambda: {r["id"]: r for r in spark.read.schema(loop_stream.RESULT).parquet(sink).collect()}
    wait_for(query, lambda: len(results()) == len(ids))
    query.stop()
    got = results()
    assert spark.read.parquet(sink).count() == len(ids)
    want = batch(spark, ids)
    assert {k: (r["output"], r["selected_round"], r["total_rounds"], r["termination"], r["fallback_kind"], r["error"]) for k, r in got.items()} == want
    assert {"first_round_error", "later_round_error", None} <= {r["fallback_kind"] for r in got.values()}
    assert all(r["attempts"] > r["total_rounds"] for k, r in got.items() if int(k) % 4 == 1 and r["total_rounds"])
