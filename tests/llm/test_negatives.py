"""Hard negatives against SQL over odd tables, in many small blocks."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stylarium.llm import negatives, queries

SCHEMA = "vec_id long, label int, embedding array<float>, block string, score int"


def vectors(n, dims, labels, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [round(rng.gauss(0.1, 0.3), 1) for _ in range(dims)]  # coarse values: many ties
        rows.append((i, labels(i, rng), x, "own", 1))
    rows += [(n, None, [0.1] * dims, "", 1), (n + 1, 1, None, "", 1), (n + 2, 1, [None] + [0.1] * (dims - 1), "", 1), (n + 3, 1, [float("nan")] * dims, "", 1),
             (n + 4, 1, [float("inf")] * dims, "", 1), (None, 1, [0.5] * dims, "", 1), (n + 5, 2, [0.0] * dims, "", 1), (n + 6, 2, [0.3] * (dims + 2), "", 1)]
    return rows + rows[:3]


def answer(spark, rows):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA), label=label, chunk=3)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, label integer, embedding float[])")
    if rows:
        con.executemany("insert into embeddings values (?, ?, ?)", [r[:3] for r in rows])
    want = con.execute(f"select {', '.join(columns)} from ({queries.OP12_SQL})").fetchall()
    return sorted(tuple(r) for r in got.select(*columns).collect()), sorted(want)


@pytest.mark.parametrize("shape", ["several labels", "one hot label", "a label each"])
def test_mined_negatives_equal_sql(spark, monkeypatch, shape):
    monkeypatch.setattr(negatives, "BLOCK", 40)
    monkeypatch.setattr(negatives, "GRID", (3, 2))
    labels = {"several labels": lambda i, r: i % 4, "one hot label": lambda i, r: 0 if r.random() < 0.9 else 1, "a label each": lambda i, r: i}[shape]
    got, want = answer(spark, vectors(420, 7, labels))
    assert got == want and (got or shape == "a label each")


def test_no_vectors(spark):
    assert answer(spark, []) == ([], [])


def test_tiles_travel_whole():
    for most in (3, 300, 70_000, 2**40):
        tile = np.array([[most, -most, 0], [1, 2, -3]], np.int64)
        assert (negatives.wide(negatives.narrow(tile), (2, 3)) == tile).all()
    assert [negatives.narrow(np.array([[m]]))[0] for m in (3, 300, 70_000, 2**40)] == [1, 2, 4, 8]
