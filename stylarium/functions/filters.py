"""Bloom filters as scalar subqueries: rows that cannot match go in the scan's own stage, before any exchange.

As a literal a filter would stand in full in every text of its plan, which the driver makes anew at each step of
adaptive execution and keeps for each execution.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BITS, BITS_EACH, PROBES = 1 << 23, 16, 4  # of a filter, at most a megabyte; of it for each hash; bits of a hash


@dataclass(frozen=True)
class Filter:
    words: DataFrame  # one row: an array of bits / 64 longs
    bits: int


def places(h: Column, bits: int) -> list[Column]:
    """The PROBES bits of a 64-bit hash."""
    step = F.shiftrightunsigned(h, 32)
    return [(h + step * i).bitwiseAND(F.lit(bits - 1).cast("long")) for i in range(PROBES)]


def filter_of(hashes: DataFrame, most_bits: int = MOST_BITS) -> Filter:
    """The filter of the first column's hashes. Its size is bounded whatever their number.

    Past most_bits / BITS_EACH of them it lets more pass, which the join behind it drops.
    """
    own = hashes.toDF("h").distinct()
    bits = 1 << max(6, min(most_bits, max(1, own.count() * BITS_EACH)).bit_length() - 1)
    at = own.select(F.explode(F.array(*places(F.col("h"), bits))).alias("b"))
    marked = at.select(F.shiftright("b", 6).alias("i"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("x"))
    every = marked.union(hashes.sparkSession.range(bits // 64).select("id", F.lit(0).cast("long")))
    words = every.groupBy("i").agg(F.bit_or("x").alias("x"))  # bits / 64 rows
    words = words.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda w: w["x"]).alias("words"))
    return Filter(words, bits)


def may_hold(held: Filter, h: Column) -> Column:
    """Whether the filter may hold a hash: false only if it does not."""
    known = held.words.scalar()
    out = F.lit(True)
    for at in places(h, held.bits):
        out = out & (F.getbit(F.get(known, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1)
    return out
