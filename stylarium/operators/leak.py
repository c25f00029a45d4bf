"""Leak detection: character windows of protected texts in other texts, reported by hashes only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import MOST_BITS, filter_of, may_hold
from ..functions.text import CJK, Profile, grams, letters_length, only, short_hash, windows
from ..sources.tables import written


def source_windows(sources: DataFrame, text: str, kind: str, n: int = 12, profile: Profile = CJK) -> DataFrame:
    return sources.select(F.explode(windows(F.col(text), n, profile)).alias("w"), F.lit(kind).alias("kind")).distinct()


def leak_hits(scanned: DataFrame, sources: DataFrame, location: str, text: str, n: int = 12, profile: Profile = CJK, most_bits: int = MOST_BITS) -> DataFrame:
    """location, line, kind, count, hashes: windows of each whole text that are in sources, by the line they start in.

    locations are unique. Windows that a filter of the protected ones rules out go in the scan's own stage; those that
    stay are joined by hash and compared as strings. Only the lines of texts that have some are counted; a window
    finds its line by one ordered pass over a text's line starts and windows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    sources = written(sources, "windows")
    held = filter_of(sources.select(F.xxhash64("w").alias("h")), most_bits)
    own = sources.select(F.xxhash64("w").alias("key"), F.col("w").alias("own"), "kind")
    rows = scanned.select(F.col(location).alias("_loc"), F.posexplode(grams(only(t, profile.letters), n)).alias("at", "w"))
    rows = rows.withColumn("key", F.xxhash64("w")).where(may_hold(held, F.col("key")))
    hits = rows.join(own, "key").where("w = own").select("_loc", "at", "kind", short_hash(F.col("w")).alias("h"))
    hits = written(hits, "leaks")
    lines = (
        scanned.select(F.col(location).alias("_loc"), t.alias("_t"))
        .join(hits.select("_loc").distinct(), "_loc", "left_semi")
        .select("_loc", F.posexplode(F.transform(F.split("_t", "\n"), lambda s: letters_length(s, profile))).alias("line", "size"))
    )
    before = Window.partitionBy("_loc").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0))).where("size > 0")
    null = F.lit(None)
    marks = starts.select("_loc", "at", F.col("line") + 1, null.cast("string"), null.cast("string")).toDF("_loc", "at", "line", "kind", "h")
    both = marks.unionByName(hits.select("_loc", "at", null.cast("int").alias("line"), "kind", "h"))
    # A line's start comes before the windows at its place.
    order = Window.partitionBy("_loc").orderBy("at", F.col("kind").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("line", F.last("line", ignorenulls=True).over(order)).where("kind is not null")
    return placed.groupBy(F.col("_loc").alias(location), "line", "kind").agg(F.count("*").alias("count"), F.sort_array(F.collect_set("h")).alias("hashes"))
