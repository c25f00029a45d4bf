"""Surface overlap of two texts, and set metrics of extracted facts."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import CJK, Profile, grams, only


def jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.size(F.array_intersect(a, b)).cast("double") / either).otherwise(F.lit(1.0))


def recall(source: Column, output: Column) -> Column:
    s = F.array_distinct(source)
    return F.when(F.size(s) > 0, F.size(F.array_intersect(s, output)).cast("double") / F.size(s)).otherwise(F.lit(1.0))


def hallucination(source: Column, output: Column) -> Column:
    o = F.array_distinct(output)
    return F.when(F.size(o) > 0, F.size(F.array_except(o, source)).cast("double") / F.size(o)).otherwise(F.lit(0.0))


def exemplar_leak(source: Column, output: Column, exemplars: Column) -> Column:
    o = F.array_distinct(output)
    leaked = F.array_intersect(F.array_except(o, source), exemplars)
    return F.when(F.size(o) > 0, F.size(leaked).cast("double") / F.size(o)).otherwise(F.lit(0.0))


def violations(src: dict[str, Column], out: dict[str, Column], surface_of=lambda key: key) -> Column:
    """Missing entities, missing numerals, extra entities, then titles paired in order: array of (kind, expected, actual).

    surface_of: how the source writes a numeral key.
    """
    none = F.lit(None).cast("string")

    def told(kind: str, keys: Column, expected=lambda x: none, actual=lambda x: none) -> Column:
        return F.transform(
            F.array_sort(keys), lambda x: F.struct(F.lit(kind).alias("kind"), expected(x).alias("expected"), actual(x).alias("actual"))
        )

    lost = {k: F.array_except(src[k], out[k]) for k in src}
    extra = F.array_sort(F.array_except(out["titles"], src["titles"]))
    titles = F.transform(
        F.array_sort(lost["titles"]), lambda m, i: F.struct(F.lit("title").alias("kind"), m.alias("expected"), F.get(extra, i).alias("actual"))
    )
    return F.concat(
        told("entity_missing", lost["entities"], expected=lambda x: x),
        told("numeral_missing", lost["numerals"], expected=surface_of),
        told("entity_hallucination", F.array_except(out["entities"], src["entities"]), actual=lambda x: x),
        titles,
    )


def contained_terms(text: Column, terms: Column) -> Column:
    """The terms of an array that are substrings of text."""
    return F.array_sort(F.filter(terms, lambda t: F.contains(text, t)))


def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    each = [None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)]
    return pd.Series(each, dtype="float64")


def text_similarity(original: Column, plain: Column) -> Column:
    """The ratio of the standard sequence matcher, the plain text as its first sequence: it depends on the order."""
    return F.pandas_udf(_similar, "double")(plain, original)


def exemplar_copy_ratio(output: Column, originals: Column) -> Column:
    """The greatest similarity of an output to any of an array of texts; 0 for none."""

    def run(outputs: pd.Series, groups: pd.Series) -> pd.Series:
        ratio = lambda x, y: difflib.SequenceMatcher(None, y, x).ratio()
        return pd.Series([max((ratio(o or "", t or "") for t in (g if g is not None else [])), default=0.0) for o, g in zip(outputs, groups, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(output, originals)


def gram_table(df: DataFrame, key: str, source: str, output: str, orders: tuple[int, ...], profile: Profile = CJK) -> DataFrame:
    """key, n and counts of the letter grams of a pair: total (the output's occurrences), novel (those the source lacks),
    shared (distinct ones of both), distinct (the source's distinct ones), clipped (occurrences matched one by one).

    Texts are dealt by key once, and grams counted where their pair is: no gram is shuffled. Within a pair they are
    told apart by 64-bit hashes.
    """
    letters = lambda c: only(F.coalesce(F.col(c), F.lit("")), profile.letters)
    dealt = df.select(key, letters(source).alias("s"), letters(output).alias("o")).repartition(key)
    sides = dealt.select(key, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("s").alias("t")), F.struct(F.lit(1).alias("side"), F.col("o").alias("t")))).alias("x"))
    named = lambda n: lambda g: F.struct(F.lit(n).alias("n"), F.xxhash64(g).alias("g"))
    many = F.flatten(F.array(*[F.transform(grams(F.col("x.t"), n), named(n)) for n in orders]))
    each = sides.select(key, F.col("x.side").alias("side"), F.explode(many).alias("y")).groupBy(key, "y.n", "y.g")
    counts = each.agg(F.sum(1 - F.col("side")).alias("s"), F.sum("side").alias("o"))
    return counts.groupBy(key, "n").agg(
        F.sum("o").alias("total"),
        F.sum(F.when(F.col("s") == 0, F.col("o")).otherwise(0)).alias("novel"),
        F.sum(((F.col("s") > 0) & (F.col("o") > 0)).cast("long")).alias("shared"),
        F.sum((F.col("s") > 0).cast("long")).alias("distinct"),
        F.sum(F.least("s", "o")).alias("clipped"),
    )


def gram_measures(df: DataFrame, key: str, source: str, output: str, orders: tuple[int, ...] = (1, 2, 3, 4, 6), profile: Profile = CJK) -> DataFrame:
    """key, pinc<n>, overlap<n> for each order, pinc_mean over 1 to 4, and bleu: character BLEU of a sentence, 0 to 100.

    pinc is null where the output has fewer than n letters, overlap where the source has, the mean if any of its parts is.
    BLEU takes orders 1 to 4 as far as the output reaches, with exponential smoothing; 0 where either text has no letter.
    """
    table = gram_table(df, key, source, output, tuple(sorted({*orders, 1, 2, 3, 4})), profile)
    wide = table.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("n", F.struct("total", "novel", "shared", "distinct", "clipped")))).alias("m"))
    at = lambda n: F.element_at("m", F.lit(n))
    share = lambda a, b: F.when(b > 0, a.cast("double") / b)
    pinc_of = {n: share(at(n)["novel"], at(n)["total"]) for n in {*orders, 1, 2, 3, 4}}
    start = F.struct(F.lit(0.0).alias("log"), F.lit(1.0).alias("smooth"), F.lit(0).alias("order"))

    def add(s: Column, n: Column) -> Column:
        x = F.element_at("m", n)
        halved = s["smooth"] * 2
        zero = F.struct((s["log"] + F.log(100.0 / (halved * x["total"]))).alias("log"), halved.alias("smooth"), n.alias("order"))
        some = F.struct((s["log"] + F.log(100.0 * x["clipped"] / x["total"])).alias("log"), s["smooth"].alias("smooth"), n.alias("order"))
        return F.when(x.isNull() | (x["total"] == 0), s).when(x["clipped"] == 0, zero).otherwise(some)

    score = F.aggregate(F.array(*[F.lit(n) for n in range(1, 5)]), start, add, lambda s: F.exp(s["log"] / F.greatest(s["order"], F.lit(1))))
    source_letters = F.length(only(F.coalesce(F.col(source), F.lit("")), profile.letters))
    output_letters = F.length(only(F.coalesce(F.col(output), F.lit("")), profile.letters))
    rows = df.select(key, source_letters.alias("_s"), output_letters.alias("_o")).join(wide, key, "left")
    brevity = F.when(F.col("_o") >= F.col("_s"), 1.0).otherwise(F.exp(1 - F.col("_s") / F.col("_o")))
    return rows.select(
        key,
        *[pinc_of[n].alias(f"pinc{n}") for n in orders],
        *[share(at(n)["shared"], at(n)["distinct"]).alias(f"overlap{n}") for n in orders],
        ((pinc_of[1] + pinc_of[2] + pinc_of[3] + pinc_of[4]) / 4).alias("pinc_mean"),
        F.when((F.col("_s") > 0) & (F.col("_o") > 0), brevity * score).otherwise(F.lit(0.0)).alias("bleu"),
    )
