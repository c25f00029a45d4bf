"""Acceptance gates: every failed rule becomes a reason; a row is accepted without reasons. Guards that fail a run."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fidelity, numerals
from ..functions.text import CJK, Profile, letters_length, paragraphs, stripped


def reasons(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, in order; null rules do not hold."""
    return F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())


def length_ratio(source: Column, output: Column, profile: Profile = CJK) -> Column:
    """Letters of the output to those of the source, which count as one at least."""
    return letters_length(output, profile).cast("double") / F.greatest(letters_length(source, profile), F.lit(1))


def length_ratio_or_null(source: Column, output: Column, profile: Profile = CJK) -> Column:
    """The other definition: null where the source has no letter."""
    n = letters_length(source, profile)
    return F.when(n > 0, letters_length(output, profile).cast("double") / n)


def copy_limit(dialogue: Column, proper: Column) -> Column:
    """The similarity a text may keep, by its share of dialogue and of proper nouns."""
    return F.when((dialogue >= 0.5) | (proper >= 0.1), 0.70).when((dialogue >= 0.2) | (proper >= 0.07), 0.68).otherwise(0.65)


def acceptance(
    df: DataFrame, key: str, source: str, output: str, similarity: Column | None = None, limit: Column | None = None, profile: Profile = CJK, low: float = 0.9, high: float = 1.3
) -> DataFrame:
    """Length ratio, paragraph count, quantities and similarity of a pair: key, length_ratio, reasons.

    similarity is compared with limit, which comes from copy_limit; both are left out together.
    """
    s, o = F.coalesce(F.col(source), F.lit("")), F.coalesce(F.col(output), F.lit(""))
    rows = df.select(
        key,
        length_ratio(s, o, profile).alias("r"),
        (F.size(paragraphs(s)) != F.size(paragraphs(o))).alias("p"),
        (~numerals.numerals_preserved(numerals.quantities(s), numerals.quantities(o))).alias("q"),
        (F.lit(False) if similarity is None else similarity > limit).alias("c"),
    )
    found = reasons(
        {
            "length_out_of_range": ~F.col("r").between(low, high),
            "paragraph_count_mismatch": F.col("p"),
            "numeral_mismatch": F.col("q"),
            "insufficient_rewrite": F.col("c"),
        }
    )
    return rows.select(key, F.round("r", 6).alias("length_ratio"), F.array_join(found, ",").alias("reasons"))


def content_acceptance(df: DataFrame, key: str, source: str, output: str, hard: Iterable[str], observed: Iterable[str] = (), cut_off: Column | None = None) -> DataFrame:
    """key, reasons, missing_terms, observed_gaps: protected terms and quantities must stay, observed ones are only told."""
    s, o = F.coalesce(F.col(source), F.lit("")), F.coalesce(F.col(output), F.lit(""))
    missing = fidelity.missing_terms(s, o, fidelity.terms(hard))
    found = reasons(
        {
            "provider_output_truncated": F.lit(False) if cut_off is None else cut_off,
            "protected_term_missing": F.size(missing) > 0,
            "numeral_mismatch": ~numerals.numerals_preserved(numerals.quantities(s), numerals.quantities(o)),
        }
    )
    gaps = fidelity.missing_terms(s, o, fidelity.terms(observed))
    return df.select(key, F.array_join(found, ",").alias("reasons"), missing.alias("missing_terms"), gaps.alias("observed_gaps"))


def final_reasons(first: Column, final: Column) -> Column:
    """Reasons of the second pass, from two structs of fidelity.measures; null overlap cannot be assessed.

    The floors, the change and the ranges allow for rounding of 1e-12.
    """
    rules: dict[str, Column] = {}
    for name, floor in (("pinc6", 0.85), ("pinc4", 0.75)):
        before, after = first[name], final[name]
        rules[f"{name}_unassessable"] = before.isNull() | after.isNull()
        rules[f"{name}_below_limit"] = before.isNotNull() & (after < floor - 1e-12)
        rules[f"{name}_repair_decrease"] = before - after > 1e-12
    rules |= {
        "length_out_of_range": ~final["length_ratio"].between(0.6, 1.6),
        "entity_missing": final["entity_recall"] < 1,
        "numeral_missing": final["numeral_recall"] < 1,
        "numeral_added": F.size(final["added_values"]) > 0,
        "numeric_form_not_colloquial": F.size(final["chinese_forms"]) > 0,
        "numeral_parse_error": F.size(final["unparsed"]) > 0,
        "literary_residue": F.size(final["banned_residue"]) > 0,
    }
    return reasons(rules)


TARGETS = (("numeral_recall", ">=", 0.92), ("hallucination_rate", "<=", 0.005), ("profile_gap", "<", 0.204))


def targets(values: dict[str, Column]) -> dict[str, Column]:
    """Whether each target is met."""
    met = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "<": lambda a, b: a < b}
    return {name: met[op](values[name], F.lit(limit)) for name, op, limit in TARGETS}


def human_case_errors(
    rows: DataFrame, entities: Column, domains: int = 6, each: int = 5, low: int = 100, high: int = 300, profile: Profile = CJK
) -> DataFrame:
    """id, error of a set of hand-written cases (id, domain, vernacular): the set's shape, unique ids, and every filled row.

    A blank row is pending, not wrong. entities: the names of a row's text.
    """
    t = F.coalesce(F.col("vernacular"), F.lit(""))
    filled = stripped(t) != ""
    n = letters_length(t, profile)
    own = reasons(
        {
            "length out of range": filled & ~n.between(low, high),
            "fewer than two names": filled & (F.size(entities) < 2),
            "no digit": filled & ~t.rlike("[0-9０-９零〇一二两三四五六七八九十百千万亿]"),
        }
    )
    of_rows = rows.select(F.col("id").cast("string").alias("id"), F.explode(own).alias("error"))
    twice = rows.groupBy(F.col("id").cast("string").alias("id")).count().where("count > 1").select("id", F.lit("id repeats").alias("error"))
    shape = rows.groupBy("domain").count().agg(F.count("*").alias("d"), F.sum("count").alias("n"), F.count_if(F.col("count") != each).alias("uneven"))
    wrong = shape.where(f"d <> {domains} or coalesce(n, 0) <> {domains * each} or uneven > 0")
    return of_rows.unionByName(twice).unionByName(wrong.select(F.lit(None).cast("string").alias("id"), F.lit(f"not {domains} domains of {each}").alias("error")))


def plan_errors(hits: DataFrame, evaluation: DataFrame, k: int = 3, content: str = "content", style: str = "style") -> DataFrame:
    """config, query_id, error of selected exemplars (config, query_id, id, sources): k each, none evaluated, none the query itself,
    and only the routes a configuration stands for."""
    few = hits.groupBy("config", "query_id").agg(F.count("*").alias("n")).where(F.col("n") != k).select("config", "query_id", F.lit(f"not {k} exemplars").alias("error"))
    held = hits.join(evaluation.select(F.col("id")).distinct(), "id", "left_semi").select("config", "query_id", F.lit("an evaluation id").alias("error"))
    own = hits.where("id = query_id").select("config", "query_id", F.lit("the query itself").alias("error"))
    routes = F.map_keys("sources")
    wrong = ((F.col("config") == content) & F.array_contains(routes, "style")) | ((F.col("config") == style) & (F.size(F.array_except(routes, F.array(F.lit("style")))) > 0))
    return few.unionByName(held).unionByName(own).unionByName(hits.where(wrong).select("config", "query_id", F.lit("a route of another configuration").alias("error")))


def over_budget(prompts: DataFrame, key: str, tokens: Column, most_new: int, most: int) -> DataFrame:
    """Prompts whose tokens and the longest answer exceed the window; nothing is ever cut to fit."""
    return prompts.select(key, tokens.alias("tokens")).where(F.col("tokens") + most_new > most)


def require_empty(df: DataFrame, message: str) -> None:
    """Fails, naming some offenders, unless df is empty."""
    some = [tuple(r) for r in df.limit(5).collect()]
    if some:
        raise ValueError(f"{message}: {some}")


def require_unique(df: DataFrame, key: str) -> None:
    require_empty(df.groupBy(key).count().where("count > 1").select(key), f"{key} repeats")


def require_all(left: DataFrame, right: DataFrame, key: str) -> None:
    require_empty(left.select(key).join(right.select(key), key, "left_anti"), f"{key} without a partner")


def require_same_rows(a: DataFrame, b: DataFrame) -> None:
    require_empty(a.exceptAll(b), "rows missing from the second")
    require_empty(b.exceptAll(a), "rows missing from the first")


def row_errors(rows: DataFrame, plan: DataFrame, key: str, digest: str, expected: str) -> DataFrame:
    """key, error of written rows: ids that repeat, that the plan lacks, or whose digest is not the plan's."""
    twice = rows.groupBy(key).count().where("count > 1").select(key, F.lit("repeats").alias("error"))
    both = rows.select(key, F.col(digest).alias("_d")).join(plan.select(key, F.col(expected).alias("_e"), F.lit(True).alias("_in")), key, "left")
    strange = both.where("_in is null").select(key, F.lit("not in the plan").alias("error"))
    other = both.where(F.col("_in") & ~F.col("_d").eqNullSafe(F.col("_e"))).select(key, F.lit("another digest").alias("error"))
    return twice.unionByName(strange).unionByName(other)


def require_same_experiment(replay: DataFrame, first: DataFrame, columns: Iterable[str]) -> None:
    """A replay must match in ids, prompts, seeds and sampling: the named columns, row by row."""
    require_same_rows(replay.select(*columns), first.select(*columns))
