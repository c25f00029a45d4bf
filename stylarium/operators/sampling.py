"""Stratified splits, folds, samples and rotations, by seeded hash order; places in strata of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

MOST_EXAMPLES = 1000


def shuffled(seed: int | str, key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))


def running(df: DataFrame, stratum: str, *order: Column | str, weight: str | None = None, name: str = "before") -> DataFrame:
    """Adds the total weight (rows, without weight) before each row in its stratum's order, however large the stratum.

    A total order is dealt by ranges, summed and offset, so that a stratum's rows are spread over many tasks; only one
    sum a task and stratum is joined on. Null strata are one.
    """
    names = [f"_o{i}" for i in range(len(order))]
    rows = df.withColumns({n: F.col(c) if isinstance(c, str) else c for n, c in zip(names, order, strict=True)})
    rows = rows.withColumn("_w", F.lit(1) if weight is None else F.col(weight))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written once: the borders of the ranges are drawn from samples.
    dealt = written(rows.repartitionByRange(n, stratum, *names).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(F.col(stratum).alias("_s"), F.col("_part").alias("_p")).agg(F.sum("_w").alias("_n"))
    upto = Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_s", "_p", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(stratum, "_part").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("_local", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    out = out.join(offsets, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
    return out.withColumn(name, (F.col("_local") + F.col("_before")).cast("long")).drop("_local", "_part", "_s", "_p", "_before", "_w", *names)


def placed(df: DataFrame, stratum: str, *order: Column | str, place: str = "place") -> DataFrame:
    """Adds each row's place from 1 within its stratum."""
    out = running(df, stratum, *order, name=place)
    return out.withColumn(place, F.col(place) + 1)


def sized(df: DataFrame, stratum: str, name: str = "n") -> DataFrame:
    """Adds the size of a row's stratum, by partial counts."""
    counts = df.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias(name))
    return df.join(counts, F.col(stratum).eqNullSafe(F.col("_s"))).drop("_s")


def folds(df: DataFrame, key: str, stratum: str, k: int = 5, seed: int = 42) -> DataFrame:
    out = placed(df, stratum, shuffled(seed, key), key, place="_place")
    return out.withColumn("fold", ((F.col("_place") - 1) % k).cast("int")).drop("_place")


def stratified_split(df: DataFrame, key: str, stratum: str, share: float = 0.08, seed: int = 42) -> DataFrame:
    """split: eval for max(1, round half to even(n * share)) of each stratum, else train."""
    out = sized(placed(df, stratum, shuffled(seed, key), key, place="_place"), stratum, "_n")
    quota = F.greatest(F.lit(1.0), F.rint(F.col("_n") * F.lit(share)))
    return out.withColumn("split", F.when(F.col("_place") <= quota, "eval").otherwise("train")).drop("_place", "_n")


def even_sample(df: DataFrame, key: str, stratum: str, count: int, seed: int = 42) -> DataFrame:
    """count rows, dealt in turn over the strata in shuffled order; more than there are, or none, is an error."""
    total = df.limit(count).count()
    if count < 1 or total < count:
        raise ValueError(f"{count} rows of {total}")
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(shuffled(seed, key), key))
    # No stratum gives more than count rows, so that its window keeps a bounded head in each task.
    head = df.withColumn("_place", place).where(F.col("_place") <= count)
    return head.orderBy("_place", shuffled(f"{seed}-strata", stratum), stratum).limit(count).drop("_place")


def examples(pool: DataFrame, asked: DataFrame, key: str, stratum: str, attempt: int, seed: int = 42) -> DataFrame:
    """For each asked key 2 + attempt % 2 pool rows of others, in turn over the strata: asked_key, key, place.

    The pool is a small hand-picked set (checked).
    """
    if pool.limit(MOST_EXAMPLES + 1).count() > MOST_EXAMPLES:
        raise ValueError("the example pool is meant to be small")
    pairs = asked.select(F.col(key).alias("asked_key")).join(F.broadcast(pool.select(key, stratum)), F.col("asked_key") != F.col(key))
    mixed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("asked_key").cast("string"), F.lit(str(attempt)), F.col(key).cast("string")).cast("binary"))
    pairs = pairs.withColumn("turn", F.row_number().over(Window.partitionBy("asked_key", stratum).orderBy(mixed, key)))
    place = F.row_number().over(Window.partitionBy("asked_key").orderBy("turn", mixed, key))
    return pairs.withColumn("place", place).where(F.col("place") <= 2 + attempt % 2).select("asked_key", key, "place")


def leave_one_out(pool: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """key, other for every two rows of a small pool with different ids and texts; each row must find exactly size others."""
    if pool.limit(MOST_EXAMPLES + 1).count() > MOST_EXAMPLES:
        raise ValueError("the pool is meant to be small")
    others = F.broadcast(pool.select(F.col(key).alias("other"), F.col(text).alias("_other")))
    pairs = pool.select(key, text).join(others, (F.col(key) != F.col("other")) & (F.col(text) != F.col("_other"))).select(key, "other")
    wrong = pool.select(key).join(pairs.groupBy(key).count(), key, "left").where(F.coalesce("count", F.lit(0)) != size).limit(5).collect()
    if wrong:
        raise ValueError(f"pools of another size than {size}: {[(r[key], r['count']) for r in wrong]}")
    return pairs
