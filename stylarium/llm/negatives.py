"""Hard-negative mining (operator 12): two-dimensional block products, SUMMA-style.

Vectors become integers, floor(scale * x). Rows lie in blocks of bounded size,
and every block in chunks of dimensions. An anchor block and a row block meet once
a chunk, in a task of their own, and give a tile of partial integer scores; the
partial tiles of a pair of blocks are shuffled together and added in int64. The
sum is reduced in place: first to the best rows of each anchor's label (its
positives), then, in a second product, to the best rows of other labels in the
score window of each anchor and positive. Tiles are never written or joined; a
partial tile travels in the narrowest integers that hold it.

Positives are sought among blocks of the anchor's label only; labels of any size
are cut in blocks by a hash. Anchors without a positive of score 0 or more have no
window and take no part in the second product.

Edge cases: rows with a null id, label or vector, or a null or non-finite
component, take no part; vectors of other dimensions never meet. Rows that repeat
an id, label and vector count once; rows that share an id with an anchor are not its
partners. Ties go to the smaller id. Integers beyond 2^53 in a sum are added
exactly up to 64 bits. Empty tables, anchors without positives, and positives
without negatives give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut, lean
from .mips import apart, products

BLOCK, CHUNK = 1024, 32  # rows of a block, dimensions of a chunk
GRID = (64, 4)  # groups of row blocks and of anchor blocks that meet as one key of the join
LEAST = -(2**62)


def integers(vectors: DataFrame, scale: int, label: Column, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, label, v of the rows that take part."""
    x = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    odd = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("x"))
        .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull())
        .where(~odd)
        .select("vec_id", "label", F.transform("x", lambda e: F.floor(e * scale)).alias("v"))
        .dropDuplicates(["vec_id", "label", "v"])
    )


def narrow(tile: np.ndarray) -> bytes:
    """A tile in the narrowest integers that hold it, behind a byte that names their width."""
    most = int(np.abs(tile).max(initial=0))
    kind = next((k for k in (np.int8, np.int16, np.int32) if most <= np.iinfo(k).max), np.int64)
    return bytes([np.dtype(kind).itemsize]) + np.ascontiguousarray(tile, kind).tobytes()


def wide(data: bytes, shape: tuple[int, int]) -> np.ndarray:
    return np.frombuffer(data, f"i{data[0]}", offset=1).reshape(shape).astype(np.int64)


def blocks(rows: DataFrame, keys: list[str], chunk: int, extra: str = "") -> DataFrame:
    """One row a block and chunk: keys, dim, chunk, ids, labels (chunk 0 only), data (narrow matrix), n, and extra lists of chunk 0."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "label"])
        x, at, out = np.stack(pdf["v"].to_numpy()).astype(np.int64), len(keys), []
        for c in range(max(1, math.ceil(x.shape[1] / chunk))):
            first = c == 0
            out.append((
                *key[: at + 1], c, pdf["vec_id"].to_numpy(np.int64).tobytes() if first else None, pdf["label"].to_numpy(np.int64).tobytes() if first else None,
                narrow(x[:, c * chunk : (c + 1) * chunk]), len(x), *([pdf[extra].tolist()] if extra and first else [None] * bool(extra)),
            ))
        return pd.DataFrame(out, columns=[*keys, "dim", "chunk", "ids", "labels", "data", "n", *([extra] if extra else [])])

    schema = ", ".join(f"{k} long" for k in keys) + ", dim int, chunk int, ids binary, labels binary, data binary, n int"
    schema += f", {extra} array<array<struct<id:long,score:long>>>" if extra else ""
    return rows.withColumn("dim", F.size("v")).groupBy(*keys, "dim").applyInPandas(pack, schema)


def dealt(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with a block number of expected size BLOCK within the groups of by (all rows, if none)."""
    if not by:
        return rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, math.ceil(rows.count() / BLOCK))).cast("long")))
    # One row a group: adaptive execution broadcasts it below its threshold and splits a hot group's join beyond.
    sizes = rows.groupBy(*by).count()
    return apart(rows).join(apart(sizes), by).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("count") / BLOCK))).drop("count")


def partial(it):
    """Pairs of chunks -> their partial tiles, one at a time."""
    for pdf in it:
        for r in range(len(pdf)):
            row = pdf.iloc[r : r + 1]
            tile = products(wide(row["a_data"].iloc[0], (row["a_n"].iloc[0], -1)), wide(row["b_data"].iloc[0], (row["b_n"].iloc[0], -1)))
            yield row.drop(columns=["a_data", "b_data"]).assign(tile=[narrow(tile)])


def best(scores: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest scores of each row among the columns that are ok; ties to the first columns, which hold the least ids."""
    masked = np.where(ok, scores, LEAST)
    if masked.shape[1] > k:
        ok = ok & (masked >= np.partition(masked, masked.shape[1] - k, axis=1)[:, [masked.shape[1] - k]])
    i, j = np.nonzero(ok)
    order = np.lexsort((j, -scores[i, j], i))
    i, j = i[order], j[order]
    nth = np.arange(len(i)) - np.searchsorted(i, i)
    return i[nth < k], j[nth < k]


def totals(pdf: pd.DataFrame) -> tuple[pd.Series, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first chunk's row, and the sum of a pair's partial tiles with the ids and labels of both sides."""
    head = pdf.loc[pdf["chunk"].idxmin()]
    shape = (int(head["a_n"]), int(head["b_n"]))
    total = np.zeros(shape, np.int64)
    for tile in pdf["tile"]:
        total += wide(tile, shape)
    return head, total, *(np.frombuffer(head[c], np.int64) for c in ("a_ids", "a_labels", "b_ids", "b_labels"))


def positives_of(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, total, ids, labels, own, own_labels = totals(pdf)
        i, j = best(total, (labels[:, None] == own_labels[None, :]) & (ids[:, None] != own[None, :]), k)
        return pd.DataFrame({"anchor_id": ids[i], "anchor_label": labels[i], "id": own[j], "score": total[i, j]})

    return run


def negatives_of(k: int, percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head, total, ids, labels, own, own_labels = totals(pdf)
        other = (labels[:, None] != own_labels[None, :]) & (ids[:, None] != own[None, :])
        windows, out = list(head["windows"]), []
        for nth in range(max(map(len, windows), default=0)):
            some = np.array([r for r, w in enumerate(windows) if len(w) > nth])
            goal = np.array([windows[r][nth]["score"] for r in some], np.int64)[:, None]
            s = total[some]
            # percent * goal <= 100 * s, as a bound on s that cannot leave 64 bits
            least = np.array([-(-percent * int(g) // 100) for g in goal[:, 0]], np.int64)[:, None]
            i, j = best(s, other[some] & (s <= goal) & (s >= least), k)
            positive = np.array([windows[r][nth]["id"] for r in some], np.int64)
            out.append(pd.DataFrame({"anchor_id": ids[some[i]], "anchor_label": labels[some[i]], "positive_id": positive[i], "negative_id": own[j],
                                     "positive_score": goal[i, 0], "negative_score": s[i, j]}))
        none = ("anchor_id", "anchor_label", "positive_id", "negative_id", "positive_score", "negative_score")
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in none})

    return run


def tiles(anchors: DataFrame, rows: DataFrame, by: list[str], extra: str = "") -> DataFrame:
    """Partial tiles of each pair of blocks a, b that are alike in by, and chunk.

    The pairs lie on a grid: row blocks in GRID[0] groups, copied for each group of anchor blocks, and anchor blocks
    in GRID[1] groups, copied for each group of row blocks; so no key holds a share of the pairs that grows with a label.
    """

    def side(df: DataFrame, own: str, groups: int, other: int, name: str) -> DataFrame:
        copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other - 1).cast("long")))
        columns = [F.col(c).alias(f"{own}_{c}") for c in ("ids", "labels", "n", "data")] + ([extra] if extra and own == "a" else [])
        return df.select(own, "dim", "chunk", *by, *columns, F.pmod(own, F.lit(groups)).alias(f"{own}_group"), copies.alias(f"{name}_group"))

    keys = ["dim", "chunk", *by, "a_group", "b_group"]
    joined = side(anchors, "a", GRID[1], GRID[0], "b").join(side(rows, "b", GRID[0], GRID[1], "a"), keys).drop("a_group", "b_group", "dim", *by)
    lists = f", {extra} array<array<struct<id:long,score:long>>>" if extra else ""
    schema = "chunk int, a long, a_ids binary, a_labels binary, a_n int, b long, b_ids binary, b_labels binary, b_n int, tile binary" + lists
    names = [f.split()[0] for f in schema.split(", ")]
    return joined.mapInPandas(lean(lambda it: (p[names] for p in partial(it))), schema)


def mine(
    vectors: DataFrame,
    positives: int = 5,
    negatives: int = 5,
    anchor_every: int = 100,
    scale: int = 256,
    percent: int = 80,
    chunk: int = CHUNK,
    label: Column | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose id is divisible by anchor_every. Negatives score at least percent of the positive, and no more than it.
    """
    bound_batches(vectors.sparkSession)
    rows = cut(integers(vectors, scale, F.col("label") if label is None else label, id_col, vector_col), "mined-rows")
    anchor = F.col("vec_id") % anchor_every == 0

    def numbered(df: DataFrame, keys: list[str], name: str, extra: str = "") -> DataFrame:
        return cut(blocks(df, keys, chunk, extra).withColumn(name, F.xxhash64("dim", *keys)), "mined-blocks")

    # Positives: blocks of one label.
    by_label = numbered(dealt(rows, ["label"]), ["label", "block"], "b")
    of_label = numbered(dealt(rows.where(anchor), ["label"]), ["label", "block"], "a")
    near = tiles(of_label, by_label, ["label"]).groupBy("a", "b").applyInPandas(positives_of(positives), "anchor_id long, anchor_label long, id long, score long")
    order = Window.partitionBy("anchor_id", "anchor_label").orderBy(F.desc("score"), "id")
    near = near.withColumn("nth", F.row_number().over(order)).where((F.col("nth") <= positives) & (F.col("score") >= 0))
    windows = near.groupBy("anchor_id", "anchor_label").agg(F.collect_list(F.struct("id", "score")).alias("windows"))  # at most positives each
    # Negatives: blocks of any labels.
    asked = cut(rows.where(anchor).join(windows.toDF("vec_id", "label", "windows"), ["vec_id", "label"]), "mined-anchors")
    some = numbered(dealt(asked, []), ["block"], "a", "windows")
    every = numbered(dealt(rows, []), ["block"], "b")
    schema = "anchor_id long, anchor_label long, positive_id long, negative_id long, positive_score long, negative_score long"
    found = tiles(some, every, [], "windows").groupBy("a", "b").applyInPandas(negatives_of(negatives, percent), schema)
    order = Window.partitionBy("anchor_id", "anchor_label", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
