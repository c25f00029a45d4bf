"""Token counts (operator 11): a cache of counts by digest of content and of tokenizer version.

A text's content is normalised (null is the empty text) and digested in SHA-256;
the tokenizer's version is a digest of its file, its library's name and release
and the options of the count. Counts of that version are joined by digest; only
different texts that have none are encoded, once each, and their counts appended to
the cache, which is then joined with all rows. Equal texts meet after each task
has dropped its own repeats; the few digests that hold a thousandth of all rows or more
(at most a thousand, so they are broadcast) are joined apart from the rest.

Texts are encoded whole. Under a byte-level pattern a long text is cut before a
space between ASCII letters, where a word of the pattern always begins, which bounds what
one call holds; other tokenizers get it in one piece.

Edge cases: null and empty texts have no tokens. Rows that repeat, and rows of null
doc_id, each have a row. An empty table gives an empty result and leaves the cache as
it is. A digest that two writers have appended counts once. Other columns are
ignored. The vocabulary's path is a parameter and must be readable on the executors.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, cut, lean, shared_dir

PIECE = 400_000  # characters encoded at once
HEAVY = 1000  # digests with more than 1 in so many rows are joined by broadcast; there are fewer of them than that
STORED = "digest binary, n_tokens long"
BREAK = re.compile("[A-Za-z](?= [A-Za-z])")


def library(path: str) -> str:
    if path.endswith(".json"):
        return "tokenizers"
    if path.endswith(".model"):
        return "sentencepiece"
    raise ValueError(f"no library for {path}")


def version(path: str) -> str:
    """Digest of all that a count depends on but the text."""
    name = library(path)
    with open(path, "rb") as f:
        vocabulary = hashlib.file_digest(f, "sha256").hexdigest()
    return hashlib.sha256(f"{vocabulary} {name} {importlib.metadata.version(name)} bare".encode()).hexdigest()


def pieces(text: str, most: int) -> Iterator[str]:
    """text in parts of most characters, or longer ones where no break stands."""
    at = 0
    while len(text) - at > most:
        found = BREAK.search(text, at + most)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


def encoder(path: str):
    """texts -> their numbers of tokens, without begin, end and added special tokens."""
    if library(path) == "sentencepiece":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    with open(path, encoding="utf-8") as f:
        setting = json.load(f)
    pattern = setting.get("pre_tokenizer") or {}
    specials = [t["content"] + " " * (t["lstrip"] or t["rstrip"]) for t in setting.get("added_tokens", [])]
    splits = pattern.get("type") == "ByteLevel" and pattern.get("use_regex", True) and not pattern.get("add_prefix_space")
    splits = splits and not setting.get("normalizer") and not any(" " in s for s in specials)

    def count(texts: list[str]) -> list[int]:
        parts, own = [], []
        for i, text in enumerate(texts):
            for part in pieces(text, PIECE) if splits else (text,):
                parts.append(part)
                own.append(i)
        out, lo = [0] * len(texts), 0
        while lo < len(parts):
            hi, size = lo + 1, len(parts[lo])
            while hi < len(parts) and size + len(parts[hi]) <= PIECE:
                size += len(parts[hi])
                hi += 1
            for i, e in zip(own[lo:hi], model.encode_batch_fast(parts[lo:hi], add_special_tokens=False), strict=True):
                out[i] += len(e)
            lo = hi
        return out

    return count


def counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        count = encoder(path)
        for batch in batches:
            numbers = pa.array(count(batch.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), numbers], ["digest", "n_tokens"])

    return lean(run)


def stored(spark: SparkSession, cache: str, of: str) -> DataFrame:
    """digest, n_tokens of one version in the cache, each digest once."""
    try:
        found = spark.read.schema(STORED).parquet(f"{cache}/version={of}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED)
    return found.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row. cache: a folder all executors share; without it, one of this call's own."""
    spark = docs.sparkSession
    bound_batches(spark)
    cache, of = cache or f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}", version(path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"), "text"
    )
    rows = cut(keyed.drop("text"), "text-digests")
    different = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    misses = different.join(stored(spark, cache, of), "digest", "left_anti")
    misses.select("digest", "text").mapInArrow(counter(path), STORED).write.mode("append").parquet(f"{cache}/version={of}")
    counts = stored(spark, cache, of)
    heavy = rows.groupBy("digest").count().where(F.col("count") > rows.count() / HEAVY).select("digest")
    heavy = F.broadcast(heavy.join(counts, "digest"))
    joined = rows.join(heavy, "digest").unionByName(rows.join(heavy.select("digest"), "digest", "left_anti").join(counts, "digest"))
    return joined.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
