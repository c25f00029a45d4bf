"""Exact top-k inner product (operator 7): norm-bucketed retrieval.

Vectors become integers, floor(scale * x). They are grouped into buckets of
nearly equal length (each bucket's lengths lie within one per cent) and, inside
a bucket, into blocks of bounded size. Every query first gets a lower bound of
its k-th score from the longest vectors, a set of fixed size. Against a bucket
with greatest length l the bound gives a local cosine threshold
t = bound / (|q| l): above 1 the bucket is skipped; if t is high, the ranges
that the query's largest coordinates leave are tested; else the length alone
prunes. What is left gets its exact integer product.

Edge cases: vectors that are null or hold null or non-finite components take no
part; those of other dimensions are never compared; zero vectors score 0 and do
take part. Rows that repeat an id and vector count once. Ties go to the smaller
id. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, QUERIES, SEEDS, FOCUS, HIGH = 4096, 1024, 4096, 4, 0.6


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    x = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    odd = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
        .where(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
        .where(~odd)
        .select("vec_id", F.transform("x", lambda e: F.floor(e * scale)).alias("v"))
        .dropDuplicates(["vec_id", "v"])
        .withColumn("dim", F.size("v"))
        .withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))))
    )


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where no sum can leave their exact range."""
    if np.abs(q).max(initial=0) * np.abs(p).max(initial=0) * max(q.shape[1], 1) < 2**53:
        return (q.astype(np.float64) @ p.astype(np.float64).T).astype(np.int64)
    return (q.astype(object) @ p.astype(object).T).astype(np.int64)


def apart(df: DataFrame) -> DataFrame:
    """df with columns of its own, to be joined with what it comes from."""
    return df.toDF(*df.columns)


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def bounder(k: int):
    """A lower bound of each query's k-th score from the seeds, its own id aside."""

    def run(key: tuple, queries: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
        if not len(queries):
            return pd.DataFrame({"query_id": [], "bound": []}).astype("int64")
        bound = np.full(len(queries), -(2**62), np.int64)
        if len(seeds):
            s = products(matrix(queries["v"]), matrix(seeds["v"]))
            s[queries["vec_id"].to_numpy()[:, None] == seeds["vec_id"].to_numpy()[None, :]] = -(2**62)
            if s.shape[1] >= k:
                bound = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        return pd.DataFrame({"query_id": queries["vec_id"].to_numpy(), "bound": bound})

    return run


def finder(k: int):
    def run(key: tuple, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        if not len(queries) or not len(block):
            return none
        block = block.sort_values("vec_id")
        ids, p, length = block["vec_id"].to_numpy(np.int64), matrix(block["v"]), block["length"].to_numpy()
        qid, q, ql = queries["vec_id"].to_numpy(np.int64), matrix(queries["v"]), queries["length"].to_numpy()
        bound = queries["bound"].to_numpy(np.int64)
        top = float(length.max())
        reach = ql * top
        local = np.where(reach > 0, bound / np.where(reach > 0, reach, 1), np.where(bound > 0, 2.0, -1.0))
        out = []

        def gather(i: int, cand: np.ndarray | None, s: np.ndarray) -> None:
            """Of query i the k best of candidates (all, if None) with scores s."""
            own = ids if cand is None else ids[cand]
            ok = (s >= bound[i]) & (own != qid[i])
            s, own = s[ok], own[ok]
            if len(s) > k:
                ok = s >= np.partition(s, len(s) - k)[len(s) - k]
                s, own = s[ok], own[ok]
                order = np.lexsort((own, -s))[:k]
                s, own = s[order], own[order]
            if len(s):
                out.append(pd.DataFrame({"query_id": qid[i], "vec_id": own, "score": s}))

        slack = 1e-9
        by_coordinate = (local > HIGH) & (local <= 1 + slack)
        by_length = np.flatnonzero(local <= HIGH)
        unit = p / np.maximum(length, 1e-300)[:, None] if by_coordinate.any() else None
        for i in np.flatnonzero(by_coordinate):
            # The threshold of a vector itself is at least the bucket's, which has the greatest length.
            unit_q, angle = q[i] / ql[i], math.acos(min(local[i], 1.0))
            ok = length * ql[i] >= bound[i] * (1 - slack)
            for f in np.argsort(-np.abs(unit_q))[:FOCUS]:
                own = math.acos(max(-1.0, min(1.0, unit_q[f])))
                ok &= unit[:, f] <= math.cos(max(0.0, own - angle)) + slack
                ok &= unit[:, f] >= math.cos(min(math.pi, own + angle)) - slack
            cand = np.flatnonzero(ok)
            if len(cand):
                gather(i, cand, products(q[i : i + 1], p[cand])[0])
        for lo in range(0, len(by_length), 128):
            some = by_length[lo : lo + 128]
            least = np.where(ql[some] > 0, bound[some] / np.where(ql[some] > 0, ql[some], 1), -1.0).min()
            cand = np.flatnonzero(length >= least * (1 - slack)) if least > 0 else None
            s = products(q[some], p if cand is None else p[cand])
            for i, row in zip(some, s, strict=True):
                gather(i, cand, row)
        return pd.concat(out) if out else none

    return run


def top_products(
    vectors: DataFrame,
    k: int = 10,
    query_every: int = 100,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest integer products of every row whose id is divisible by query_every."""
    rows = integers(vectors, id_col, vector_col, scale)
    seeds = rows.orderBy(F.desc("length"), "vec_id").limit(SEEDS)  # of fixed size
    bucket = F.when(F.col("length") > 0, F.floor(F.log("length") / math.log(1.01))).otherwise(-(10**6)).cast("int")
    rows_b = rows.withColumn("bucket", bucket)
    sizes = rows_b.groupBy("dim", "bucket").agg(F.count("*").alias("count"), F.max("length").alias("top"))
    parts = F.greatest(F.ceil(F.col("count") / BLOCK), F.lit(1))
    blocked = rows_b.join(sizes.drop("top"), ["dim", "bucket"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), parts).cast("int"))
    queries = apart(rows.where(F.pmod("vec_id", F.lit(query_every)) == 0))
    n = max(1, math.ceil(queries.count() / QUERIES))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n)).cast("int"))
    # The stated query set against all rows, in blocks: keys are (block of queries, bucket, part).
    all_blocks = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    bounds = (
        queries.groupBy("dim", "block")
        .cogroup(apart(seeds.withColumn("block", all_blocks)).groupBy("dim", "block"))
        .applyInPandas(bounder(k), "query_id long, bound long")
        .groupBy("query_id")
        .agg(F.min("bound").alias("bound"))
    )
    queries = queries.join(bounds.withColumnRenamed("query_id", "vec_id"), "vec_id")
    # A query asks only buckets whose longest vector can reach its bound, and a bucket goes only to blocks that ask it.
    reached = F.col("length") * F.col("top") >= F.col("bound") * F.when(F.col("bound") > 0, 1 - 1e-9).otherwise(1 + 1e-9)
    wanted = queries.join(apart(sizes), "dim").where(reached).drop("top")
    asked = apart(wanted.withColumn("part", F.explode(F.sequence(F.lit(0), parts.cast("int") - 1))).drop("count"))
    needed = apart(wanted.select("dim", "bucket", "block").distinct())
    keys = ["dim", "block", "bucket", "part"]
    found = (
        asked.groupBy(*keys)
        .cogroup(apart(blocked.join(needed, ["dim", "bucket"])).groupBy(*keys))
        .applyInPandas(finder(k), "query_id long, vec_id long, score long")
        .dropDuplicates()
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
