"""Versions that are there whole or not at all: broken writes, many writers, readers that hold an old version."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from stylarium.sources import vectors, versions


def rows(spark, first, n):
    return spark.range(first, first + n).select("id", F.concat(F.lit("t"), "id").alias("text"))


@pytest.mark.parametrize("form", ["parquet", "json"])
def test_a_version_is_whole(spark, tmp_path, form):
    root = f"file://{tmp_path}/table"
    assert versions.manifest(spark, root) is None
    with pytest.raises(FileNotFoundError):
        versions.load(spark, root)
    assert versions.publish(rows(spark, 0, 10), root, {"model": "a"}, form=form) == 1
    old = versions.load(spark, root)
    # A write that fails half way: some tasks have written, no manifest names their files.
    broken = rows(spark, 100, 50).repartition(5).withColumn("text", F.when(F.col("id") == 149, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        versions.publish(broken, root, form=form)
    # A writer that was killed between its data and its manifest.
    rows(spark, 500, 5).write.format(form).save(f"{root}/data/killed")
    (tmp_path / "table/manifests/.draft-killed").write_text('{"version": 2, "par')
    assert versions.load(spark, root).count() == 10 and versions.manifest(spark, root)["facts"] == {"model": "a"}
    assert versions.publish(rows(spark, 10, 3), root, append=True, form=form) == 2
    assert versions.publish(rows(spark, 0, 4), root, {"model": "b"}, form=form) == 3
    assert old.count() == 10  # a reader of an old version goes on with it
    assert [versions.load(spark, root, v).count() for v in (1, 2, 3)] == [10, 13, 4]
    assert versions.manifest(spark, root, 2)["rows"] == 13
    assert versions.sweep(spark, root, keep=2, older=3600) == []
    gone = versions.sweep(spark, root, keep=2, older=0)
    assert "data/killed" in gone and [versions.load(spark, root, v).count() for v in (2, 3)] == [13, 4]
    assert versions.versions(spark, root) == [2, 3]
    with pytest.raises(ValueError, match="schema"):
        versions.publish(spark.range(2), root, append=True, form=form)


def test_many_writers_lose_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/table"
    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(lambda i: versions.publish(rows(spark, i * 10, 10), root, append=True), range(6)))
    assert sorted(numbers) == [1, 2, 3, 4, 5, 6]
    assert sorted(r["id"] for r in versions.load(spark, root).collect()) == list(range(60))
    assert versions.manifest(spark, root)["rows"] == 60
    assert not [f for f in os.listdir(tmp_path / "table/manifests") if "draft" in f and not f.endswith(".crc")]


def test_a_cache_may_be_replaced_while_it_is_read(spark, tmp_path):
    root = f"file://{tmp_path}/cache"
    asked = {"model_id": "m", "revision": "1", "dim": 2, "max_length": 8}
    made = lambda ids, x: spark.createDataFrame([(i, f"t{i}", [x, 1.0]) for i in ids], "id long, text string, embedding array<double>")
    vectors.write_cache(made(range(5), 1.0), root, **asked)
    before = vectors.read_cache(spark, root, made(range(5), 1.0).select("id", "text"), **asked)
    vectors.write_cache(made(range(7), 2.0), root, **asked)
    assert before.agg(F.sum(F.col("embedding")[0])).first()[0] == 5.0
    after = vectors.read_cache(spark, root, made(range(7), 2.0).select("id", "text"), **asked)
    assert after.count() == 7 and after.first()["embedding"][0] == 2.0
    with pytest.raises(ValueError, match="repeat"):
        vectors.write_cache(made([1, 1], 3.0), root, **asked)
    with pytest.raises(Exception, match="finite"):
        vectors.write_cache(made([1], float("nan")), root, **asked)
    assert vectors.read_cache(spark, root, made(range(7), 2.0).select("id", "text"), **asked).count() == 7
