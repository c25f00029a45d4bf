"""Approximate nearest neighbours (operator 1): one navigable small-world graph per shard, flat neighbour arrays.

Distinct vectors are dealt over shards of bounded size. A shard's vectors get
one more coordinate that gives all the same length, so that nearness and inner
product agree. Every node draws its top level from a geometric law; on each
level it keeps diverse near neighbours, taken from an exact scan of the shard's
level, and reverse edges. The graph is stored as flat arrays in a written
table. Blocks of queries descend the levels, then run a beam search on the
lowest; results of shards are merged, and equal vectors are expanded last.

Edge cases: vectors that are null, zero or hold null or non-finite components
take no part, as query or candidate; vectors of other dimensions are never
compared. Equal vectors, and rows repeated with one id, are one candidate per
id. Ties go to the smaller id. An empty table, or one without valid vectors,
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut, lean

SHARD, BLOCK = 8192, 512
WIDTH, WIDTH0, CANDIDATES, BEAM, AT_ONCE = 16, 32, 64, 160, 4


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        .where(~odd & F.exists("v", lambda x: x != 0))
    )


def diverse(x: np.ndarray, near: np.ndarray, width: int) -> np.ndarray:
    """Of each node's candidates, nearest first, those nearer to the node than to any kept one; -1 fills up."""
    out = np.full((len(near), width), -1, np.int32)
    for lo in range(0, len(near), 512):
        ids = near[lo : lo + 512]
        v = x[np.maximum(ids, 0)]
        own = np.einsum("ncd,nd->nc", v, x[lo : lo + len(ids)])
        own[ids < 0] = -np.inf
        among = np.einsum("ncd,ned->nce", v, v)
        kept = np.zeros(ids.shape, bool)
        count = np.zeros(len(ids), int)
        for c in range(ids.shape[1]):
            clash = (kept & (among[:, c, :] > own[:, c, None])).any(axis=1)
            take = ~clash & (count < width) & (ids[:, c] >= 0)
            kept[:, c] = take
            count += take
        # Fill what is left with the nearest of the others.
        order = np.argsort(~kept, axis=1, kind="stable")[:, :width]
        got = np.take_along_axis(ids, order, axis=1)
        out[lo : lo + len(ids), : got.shape[1]] = got
    return out


def graph(x: np.ndarray, width: int) -> np.ndarray:
    """(n, 2 * width) neighbours: width chosen ones, then reverse edges; -1 for none."""
    n = len(x)
    c = min(CANDIDATES, n - 1)
    if c < 1:
        return np.full((n, 2 * width), -1, np.int32)
    near = np.empty((n, c), np.int32)
    for lo in range(0, n, 1024):
        s = x[lo : lo + 1024] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        top = np.argpartition(-s, c - 1, axis=1)[:, :c]
        near[lo : lo + len(s)] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1), 1)
    chosen = diverse(x, near, width)
    out = np.full((n, 2 * width), -1, np.int32)
    out[:, :width] = chosen
    source, slot = np.nonzero(chosen >= 0)
    target = chosen[source, slot]
    order = np.lexsort((slot, target))
    source, target = source[order], target[order]
    place = np.arange(len(target)) - np.searchsorted(target, target)
    fits = place < width
    out[target[fits], width + place[fits]] = source[fits]
    return out


def build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("vec_id")
    v = np.stack(pdf["v"].to_numpy()).astype(np.float64)
    n = len(v)
    norm = (v * v).sum(axis=1)
    x = np.concatenate([v, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None]], axis=1).astype(np.float32)
    levels = np.floor(-np.log(1 - np.random.default_rng(n).random(n)) / math.log(WIDTH)).astype(int)
    order = np.argsort(-levels, kind="stable")  # nodes of level >= l are a prefix
    x, v, levels = x[order], v[order], levels[order]
    sizes = [int((levels >= lv).sum()) for lv in range(levels.max() + 1)]
    flat = [graph(x[:size], WIDTH0 // 2 if lv == 0 else WIDTH // 2) for lv, size in enumerate(sizes)]
    return pd.DataFrame(
        {
            "shard": [pdf["shard"].iloc[0]],
            "dim": [v.shape[1]],
            "sizes": [sizes],
            "ids": [pdf["vec_id"].to_numpy(np.int64)[order].tobytes()],
            "vectors": [v.tobytes()],
            "neighbours": [b"".join(g.tobytes() for g in flat)],
        }
    )


def descend(q: np.ndarray, x: np.ndarray, levels: list[np.ndarray], beam: int) -> np.ndarray:
    """For each query the nodes of its final beam, best first; -1 fills up."""
    m, n = len(q), len(x)
    at = np.zeros(m, np.int64)
    best = q @ x[0]
    for nb in levels[:0:-1]:
        moving = np.arange(m)
        while len(moving):
            cand = nb[at[moving]]
            s = np.einsum("mcd,md->mc", x[np.maximum(cand, 0)], q[moving])
            s[cand < 0] = -np.inf
            j = s.argmax(axis=1)
            top = s[np.arange(len(j)), j]
            better = top > best[moving]
            moving, j, top, cand = moving[better], j[better], top[better], cand[better]
            at[moving], best[moving] = cand[np.arange(len(j)), j], top
    nb = levels[0]
    beam = min(beam, n)
    ids = np.full((m, beam), -1, np.int64)
    score = np.full((m, beam), -np.inf, np.float32)
    opened = np.ones((m, beam), bool)
    ids[:, 0], score[:, 0], opened[:, 0] = at, best, False
    seen = np.zeros((m, n), bool)
    seen[np.arange(m), at] = True
    alive = np.arange(m)
    while len(alive):
        rank = np.where(opened[alive], np.inf, np.arange(beam)[None, :])
        pick = np.argsort(rank, axis=1)[:, : min(AT_ONCE, beam)]
        ok = np.take_along_axis(rank, pick, 1) < np.inf
        going = ok.any(axis=1)
        alive, pick, ok = alive[going], pick[going], ok[going]
        if not len(alive):
            break
        node = np.take_along_axis(ids[alive], pick, 1)
        row, col = np.nonzero(ok)
        opened[alive[row], pick[row, col]] = True
        cand = np.where(ok[:, :, None], nb[np.maximum(node, 0)], -1).reshape(len(alive), -1)
        cand = np.sort(cand, axis=1)
        fresh = (cand >= 0) & np.concatenate([np.ones((len(cand), 1), bool), cand[:, 1:] != cand[:, :-1]], axis=1)
        fresh &= ~seen[alive[:, None], np.maximum(cand, 0)]
        row, col = np.nonzero(fresh)
        seen[alive[row], cand[row, col]] = True
        s = np.full(cand.shape, -np.inf, np.float32)
        s[row, col] = np.einsum("nd,nd->n", x[cand[row, col]], q[alive[row]])
        s2 = np.concatenate([score[alive], s], axis=1)
        i2 = np.concatenate([ids[alive], np.where(fresh, cand, -1)], axis=1)
        o2 = np.concatenate([opened[alive], ~fresh], axis=1)
        keep = np.argpartition(-s2, beam - 1, axis=1)[:, :beam]
        keep = np.take_along_axis(keep, np.argsort(-np.take_along_axis(s2, keep, 1), axis=1, kind="stable"), 1)
        score[alive] = np.take_along_axis(s2, keep, 1)
        ids[alive] = np.take_along_axis(i2, keep, 1)
        opened[alive] = np.take_along_axis(o2, keep, 1) | (ids[alive] < 0)
    return ids


class Index:
    """A shard's index row, unpacked: ids, vectors, the vectors searched, and the neighbour table of each level."""

    def __init__(self, row) -> None:
        self.ids = np.frombuffer(row.ids, np.int64)
        self.v = np.frombuffer(row.vectors, np.float64).reshape(len(self.ids), row.dim)
        norm = (self.v * self.v).sum(axis=1)
        self.x = np.concatenate([self.v, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None]], axis=1).astype(np.float32)
        self.levels, at = [], 0
        flat = np.frombuffer(row.neighbours, np.int32)
        for lv, size in enumerate(row.sizes):
            w = WIDTH0 if lv == 0 else WIDTH
            self.levels.append(flat[at : at + size * w].reshape(size, w))
            at += size * w

    def search(self, qid: np.ndarray, qv: np.ndarray, k: int) -> pd.DataFrame:
        q = np.concatenate([qv, np.zeros((len(qv), 1))], axis=1).astype(np.float32)
        found = descend(q, self.x, self.levels, max(BEAM, 2 * k))
        row, col = np.nonzero(found >= 0)
        node = found[row, col]
        s = np.einsum("nd,nd->n", self.v[node], qv[row])
        order = np.lexsort((self.ids[node], -s, row))
        row, node, s = row[order], node[order], s[order]
        top = np.arange(len(row)) - np.searchsorted(row, row) < k + 1
        return pd.DataFrame({"query_id": qid[row[top]], "rep": self.ids[node[top]], "score": s[top]})


def searcher(k: int):
    """Rows sorted by part: a shard's index, then the blocks of queries that it answers, one after the other."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, part = None, None
        for pdf in it:
            for r in pdf.itertuples():
                if r.ids is not None:
                    index, part = Index(r), r.part
                elif r.part != part:
                    raise RuntimeError("a block of queries came before its index")
                else:
                    qid = np.frombuffer(r.query_ids, np.int64)
                    yield index.search(qid, np.frombuffer(r.query_vectors, np.float64).reshape(len(qid), r.dim), k)

    return lean(run)


def pack(pdf: pd.DataFrame) -> pd.DataFrame:
    v = np.stack(pdf["v"].to_numpy()).astype(np.float64)
    return pd.DataFrame(
        {
            "dim": [v.shape[1]],
            "block": [pdf["block"].iloc[0]],
            "query_ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()],
            "query_vectors": [v.tobytes()],
        }
    )


def nearest(
    vectors: DataFrame,
    k: int = 20,
    query_every: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    queries: DataFrame | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query, by inner product.

    Queries are the rows of `queries` (columns as vectors), or those whose id
    is divisible by query_every; a query's own id is no candidate.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = valid(vectors, id_col, vector_col)
    first = Window.partitionBy("v").orderBy("vec_id")
    ranked = rows.dropDuplicates(["vec_id", "v"]).withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    members = cut(ranked.withColumn("rep", F.min("vec_id").over(Window.partitionBy("v"))), "members")
    base = members.where("place = 1").select("vec_id", "v", F.size("v").alias("dim"))
    shards = max(1, math.ceil(base.count() / SHARD))
    index = cut(
        base.select("vec_id", "v", F.concat_ws(":", "dim", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).alias("shard"))
        .groupBy("shard")
        .applyInPandas(build, "shard string, dim int, sizes array<int>, ids binary, vectors binary, neighbours binary"),
        "index",
    )
    asked = rows.where(F.pmod("vec_id", F.lit(query_every)) == 0) if queries is None else valid(queries, id_col, vector_col)
    asked = asked.dropDuplicates(["vec_id", "v"]).withColumn("dim", F.size("v"))
    blocks = max(1, math.ceil(asked.count() / BLOCK))
    packed = cut(
        asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
        .groupBy("dim", "block")
        .applyInPandas(pack, "dim int, block int, query_ids binary, query_vectors binary"),
        "queries",
    )
    # An index goes once to each of a few parts, and the far smaller blocks of queries stream past it there.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(blocks, math.ceil(tasks / shards)))
    part = lambda p: F.concat_ws(":", "shard", p.cast("string"))
    none = F.lit(None)
    held = index.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(
        part(F.col("p")).alias("part"), F.lit(-1).alias("block"), "dim", "sizes", "ids", "vectors", "neighbours",
        none.cast("binary").alias("query_ids"), none.cast("binary").alias("query_vectors"),
    )
    asked_of = packed.join(F.broadcast(index.select("shard", "dim")), "dim").select(  # a row a shard: its name and size
        part(F.pmod("block", F.lit(parts))).alias("part"), "block", "dim", none.cast("array<int>").alias("sizes"),
        *[none.cast("binary").alias(c) for c in ("ids", "vectors", "neighbours")], "query_ids", "query_vectors",
    )
    hits = (
        held.unionByName(asked_of)
        .repartition(len_tasks(spark, shards * parts), "part")
        .sortWithinPartitions("part", "block")
        .mapInPandas(searcher(k), "query_id long, rep long, score double")
    )
    per_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    best = hits.withColumn("r", F.row_number().over(per_query)).where(F.col("r") <= k + 1)
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        best.join(members.select("rep", "vec_id"), "rep")
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(final))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def len_tasks(spark, n: int) -> int:
    return max(1, min(n, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
