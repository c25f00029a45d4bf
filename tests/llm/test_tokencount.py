"""Token counts against the libraries themselves, and what the cache holds and answers."""

import hashlib

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stylarium.llm import tokencount
from stylarium.llm.queries import BYTE_VOCABULARY, PIECE_VOCABULARY, vocabulary

TEXTS = [None, "", " ", "it's  a\n\n test ", "<|endoftext|>x <|endoftext|>", "é😀 ñandú 12345", "x" * 3000, "a b " * 500, "one two three", "\t\r\n\x0b é ", "don't  I'LL 3rd"]
SCHEMA = "doc_id long, text string, digest int, n_tokens string"


def plain(path, text):
    if path.endswith(".model"):
        import sentencepiece

        return len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text or ""))
    return len(Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids)


def table(spark, texts, first=0):
    return spark.createDataFrame([(None if first is None else first + i, t, 1, "own") for i, t in enumerate(texts)], SCHEMA)


def test_counts_are_the_librarys(spark, tmp_path):
    for name in (BYTE_VOCABULARY, PIECE_VOCABULARY, "word_bpe_49k.json"):
        path = vocabulary(name)
        docs = table(spark, TEXTS).union(table(spark, TEXTS)).union(table(spark, ["twin"] * 50, None))
        got = tokencount.count_tokens(docs, path, cache=f"file://{tmp_path}/cache", limit=100).collect()
        want = [(None if t == "twin" else i, len((t or "").encode()), plain(path, t)) for i, t in [*enumerate(TEXTS), *enumerate(TEXTS), *[(None, "twin")] * 50]]
        assert sorted(map(str, [(*w, w[2] > 100) for w in want])) == sorted(str(tuple(r)) for r in got)
        cached = tokencount.stored(spark, f"file://{tmp_path}/cache", tokencount.version(path))
        assert cached.count() == len({t or "" for t in TEXTS}) + 1


def test_long_texts_are_cut_where_words_begin(spark):
    path = vocabulary(BYTE_VOCABULARY)
    text = "".join(["He said it's 3 o'clock, ", "  no\n\n way ", "é à ", "<|endoftext|> or so "][i * i % 4] for i in range(4000))
    model = Tokenizer.from_file(path)
    for most in (1, 7, 1000):
        parts = list(tokencount.pieces(text, most))
        assert "".join(parts) == text and len(parts) > 20
        assert sum(len(model.encode(p, add_special_tokens=False).ids) for p in parts) == plain(path, text)
    long = text * 20  # beyond a megabyte
    assert tokencount.count_tokens(table(spark, [long]), path).first()["n_tokens"] == plain(path, long)


def test_only_misses_are_encoded(spark, tmp_path):
    path, cache = vocabulary(BYTE_VOCABULARY), f"file://{tmp_path}/cache"
    tokencount.count_tokens(table(spark, ["one", "two words"]), path, cache=cache)
    folder = f"{cache}/version={tokencount.version(path)}"
    # A count that the tokenizer would not give shows that the stored one is taken.
    odd = hashlib.sha256(b"known before").digest()
    spark.createDataFrame([(bytearray(odd), 77)], tokencount.STORED).write.mode("append").parquet(folder)
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.count_tokens(table(spark, ["known before", "one", "three"]), path, cache=cache).collect()}
    assert got == {0: 77, 1: plain(path, "one"), 2: plain(path, "three")}
    assert spark.read.parquet(folder).count() == 4  # "one" was not appended again
    # Two writers of one digest count once; another tokenizer has entries of its own.
    spark.createDataFrame([(bytearray(odd), 77)], tokencount.STORED).write.mode("append").parquet(folder)
    assert tokencount.count_tokens(table(spark, ["known before"]), path, cache=cache).count() == 1
    other = vocabulary("word_bpe_49k.json")
    assert tokencount.count_tokens(table(spark, ["known before"]), other, cache=cache).first()["n_tokens"] == plain(other, "known before")


def test_no_rows(spark, tmp_path):
    out = tokencount.count_tokens(table(spark, []).where(F.lit(False)), vocabulary(BYTE_VOCABULARY), cache=f"file://{tmp_path}/cache")
    assert out.count() == 0 and out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
