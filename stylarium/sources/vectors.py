"""Embedding caches with provenance, vector lookup by text hash, and memo tables for outside calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .versions import load, publish

#: What a cache was made with; a reader must ask for the same.
PROVENANCE = ("model_id", "revision", "dim", "max_length")


def finite(v: Column) -> Column:
    """A vector without null or non-finite components and not all zeros."""
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def write_cache(rows: DataFrame, path: str, model_id: str, revision: str, dim: int, max_length: int) -> None:
    """rows: id, text, embedding. Publishes id, text_sha256, embedding and the provenance as the next version of a cache.

    Bad vectors and repeated ids are errors, and leave the version before as it is.
    """
    good = F.when((F.size("embedding") == dim) & finite(F.col("embedding")), F.col("embedding")).otherwise(F.raise_error(F.lit("a vector of the wrong size, not finite, or zero")))
    out = rows.select(
        "id", F.sha2("text", 256).alias("text_sha256"), good.alias("embedding"),
        F.lit(model_id).alias("model_id"), F.lit(revision).alias("revision"), F.lit(dim).alias("dim"), F.lit(max_length).alias("max_length"), F.current_timestamp().alias("created_at"),
    )
    twice = rows.groupBy("id").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"ids repeat: {[r['id'] for r in twice]}")
    publish(out, path, {"model_id": model_id, "revision": revision, "dim": dim, "max_length": max_length})


def cache_problems(cache: DataFrame, rows: DataFrame, **asked) -> DataFrame:
    """problem, n, example: all that keeps a cache from standing for rows (id, text) under the asked provenance."""
    named = cache.select("id", "text_sha256", *PROVENANCE).withColumn("cached", F.lit(True))
    both = named.join(rows.select("id", F.sha2("text", 256).alias("sha"), F.lit(True).alias("asked")), "id", "full")
    checks = {
        "not in the cache": F.col("cached").isNull(),
        "only in the cache": F.col("asked").isNull(),
        "another text": F.col("cached") & F.col("asked") & ~F.col("sha").eqNullSafe(F.col("text_sha256")),
        **{f"another {k}": F.col("cached") & ~F.col(k).eqNullSafe(F.lit(v)) for k, v in asked.items()},
    }
    found = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]), lambda x: x.isNotNull())
    return both.select("id", F.explode(found).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"), F.min("id").alias("example"))


def read_cache(spark: SparkSession, path: str, rows: DataFrame, **asked) -> DataFrame:
    """id, embedding of a cache that stands for rows; otherwise an error that lists every mismatch."""
    cache = load(spark, path)
    problems = cache_problems(cache, rows, **asked).orderBy("problem").collect()  # a row a kind
    if problems:
        raise ValueError("; ".join(f"{r['problem']}: {r['n']}, as {r['example']}" for r in problems))
    return cache.select("id", "embedding")


def query_vectors(queries: DataFrame, cache: DataFrame, index: DataFrame) -> DataFrame:
    """query_id, q by the hash of the query's text. A missing text, or an encoder other than the index's, is an error."""
    encoder = lambda c: {tuple(r) for r in c.select(*PROVENANCE).distinct().limit(2).collect()}
    if encoder(cache) != encoder(index):
        raise ValueError("queries and index come from different encoders")
    known = cache.groupBy("text_sha256").agg(F.first("embedding").alias("q"))
    hit = queries.select("query_id", F.sha2("text", 256).alias("text_sha256")).join(known, "text_sha256", "left")
    missing = F.raise_error(F.concat(F.lit("no vector for query "), F.col("query_id").cast("string")))
    return hit.select("query_id", F.when(F.col("q").isNotNull(), F.col("q")).otherwise(missing).alias("q"))


def memoized(asked: DataFrame, memo: DataFrame | None, key: str, value: str, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """asked with value joined on by key, and the new rows of the memo. compute: distinct missing keys -> (key, value).

    A key of several values in the memo is an error.
    """
    if memo is None:
        missing, known = asked.select(key).distinct(), None
    else:
        mixed = memo.groupBy(key).agg(F.countDistinct(value).alias("n")).where("n > 1").limit(5).collect()
        if mixed:
            raise ValueError(f"several values of one {key}: {[r[key] for r in mixed]}")
        known = memo.select(key, value).distinct()
        missing = asked.select(key).distinct().join(known, key, "left_anti")
    fresh = compute(missing)
    every = fresh if known is None else known.unionByName(fresh)
    return asked.join(every, key, "left"), fresh


def vote_key(prompt: Column, model: Column) -> Column:
    return F.sha2(F.concat(prompt, model), 256)


def complete(df: DataFrame, column: str, output: str, client: Callable[[], Callable[[list], list]]) -> DataFrame:
    """df with an outside model's answers: client makes, once a task, a function from a list of inputs to a list of outputs.

    The answers come in the order asked; another number of answers is an error.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(output, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for pdf in batches:
            got = list(ask(pdf[column].tolist()))
            if len(got) != len(pdf):
                raise ValueError(f"{len(got)} answers to {len(pdf)} inputs")
            yield pdf.assign(**{output: got})

    return df.mapInPandas(run, schema)
