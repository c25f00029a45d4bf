"""Rebuilding pairs with an outside model: attempts that are kept and go on where they stopped, and the two-pass experiment."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fidelity
from ..functions.text import CJK, Profile, strip_fences, stripped
from ..operators import gates
from ..sources import versions
from ..sources.tables import written

ATTEMPT = ("id", "original", "attempt", "output", "model", "error", "reasons")
REPLY = "issues array<struct<category:string,lost_or_changed_fact:string,repair:string>>, repaired_text string"


class ModelMismatch(Exception):
    """Answers of another model than the one asked for: nothing of that round is accepted."""


@dataclass(frozen=True)
class Stores:
    """Folders of versions: every attempt, and the accepted pairs, which follow from the attempts."""

    attempts: str
    pairs: str


def ids_of(spark, store: str, where: str = "true") -> DataFrame | None:
    return versions.load(spark, store).where(where).select("id").distinct() if versions.manifest(spark, store) else None


def without(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    return rows if ids is None else rows.join(ids, "id", "left_anti")


def recover(spark, stores: Stores) -> int:
    """Accepted attempts that never became pairs, as a run stopped in between, become pairs; their number."""
    if not versions.manifest(spark, stores.attempts):
        return 0
    accepted = versions.load(spark, stores.attempts).where("reasons = ''")
    late = without(accepted, ids_of(spark, stores.pairs)).groupBy("id").agg(F.min_by(F.struct("original", "output", "model"), "attempt").alias("x"))
    late = written(late.select("id", "x.*"), "late-pairs")
    n = late.count()
    if n:
        versions.publish(late, stores.pairs, append=True)
    return n


def rebuild(
    chunks: DataFrame, stores: Stores, generate: Callable[[DataFrame], DataFrame], gate: Callable[[DataFrame], DataFrame], model: str, most: int = 3, once: bool = False
) -> dict[str, int]:
    """Asks for a pair of every chunk (id, original) that has none, at most `most` times, and tells the numbers.

    generate adds output, model and error to rows with id, original, attempt and feedback (the reasons of the attempt
    before); gate adds reasons (comma-joined, empty: accepted). A failed call's reason is its error, and is not
    given to the gate. once: chunks that an earlier run asked for in vain are left alone. An attempt is published before the next one is made, so a
    run that stops costs at most one round of calls.
    """
    spark = chunks.sparkSession
    asked = written(chunks.select("id", "original"), "chunks")
    recovered = recover(spark, stores)
    left = without(asked, ids_of(spark, stores.pairs))
    already = asked.count() - left.count()
    if once:
        left = without(left, ids_of(spark, stores.attempts))
    left, made_calls, succeeded = written(left.withColumn("feedback", F.lit("")), "left"), 0, 0
    for attempt in range(1, most + 1):
        if left.isEmpty():
            break
        got = written(generate(left.withColumn("attempt", F.lit(attempt))), "generated")  # outside calls are made once
        fine = gate(got.where("error is null")).select("id", "original", "attempt", "output", "model", "error", "reasons")
        broken = got.where("error is not null").withColumn("reasons", F.col("error")).select(*ATTEMPT)
        strange = got.where((F.col("error").isNull()) & ~F.col("model").eqNullSafe(F.lit(model)))
        others = [r["model"] for r in strange.select("model").distinct().limit(5).collect()]
        if others:
            # The round stays on record, but none of its answers counts.
            versions.publish(fine.withColumn("reasons", F.lit("model_identity_mismatch")).unionByName(broken), stores.attempts, append=True)
            raise ModelMismatch(f"asked {model}, answered {others}")
        versions.publish(fine.unionByName(broken), stores.attempts, append=True)
        rows = written(fine.unionByName(broken), "attempt")
        made_calls += rows.count()
        accepted = rows.where("reasons = ''").select("id", "original", "output", "model")
        n = accepted.count()
        if n:
            versions.publish(accepted, stores.pairs, append=True)
        succeeded += n
        left = written(rows.where("reasons <> ''").select("id", "original", F.col("reasons").alias("feedback")), "left")
    return {"requested": asked.count(), "already_done": already, "recovered": recovered, "succeeded": succeeded, "failed": left.count(), "calls": made_calls}


def history(spark, stores: Stores) -> DataFrame:
    """id, attempts, accepted, reasons: what was tried for each chunk, the reasons in the order of attempts."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("attempt", "reasons"))), lambda x: x["reasons"])  # at most `most` a run
    rows = versions.load(spark, stores.attempts).groupBy("id").agg(F.count("*").alias("attempts"), F.bool_or(F.col("reasons") == "").alias("accepted"), each.alias("r"))
    return rows.select("id", "attempts", "accepted", F.array_join(F.filter("r", lambda x: x != ""), "|").alias("reasons"))


def leave_one_out(chunks: DataFrame, examples: DataFrame, k: int) -> DataFrame:
    """id, examples: the k shortest examples (id, original, vernacular) that are neither the chunk nor its text, shortest first.

    examples are a stated handful; a chunk with fewer than k is an error.
    """
    own = examples.select(F.struct(F.length("original").alias("n"), F.col("id").alias("example"), "original", "vernacular").alias("e")).agg(F.array_sort(F.collect_list("e")).alias("all"))
    fit = F.filter("all", lambda e: (e["example"] != F.col("id")) & (e["original"] != F.col("original")))
    short = F.transform(F.slice(fit, F.lit(1), k), lambda e: F.struct(e["example"].alias("id"), e["original"], e["vernacular"]))
    enough = F.when(F.size(fit) >= k, short).otherwise(F.raise_error(F.concat(F.lit("too few examples for "), F.col("id").cast("string"))))
    return chunks.crossJoin(F.broadcast(own)).select("id", enough.alias("examples"))  # one row


def reply(raw: Column) -> Column:
    """The repair reply of an answer, or null where it is not one: known categories, whole issues and a text."""
    x = F.from_json(strip_fences(stripped(raw)), REPLY)
    whole = x["issues"].isNotNull() & (F.length(x["repaired_text"]) >= 1)
    sound = F.forall(x["issues"], lambda i: i["category"].isin("entity", "numeral") & i["lost_or_changed_fact"].isNotNull() & i["repair"].isNotNull())
    return F.when(whole & F.coalesce(sound, F.lit(False)), x)


def two_pass_run(
    cases: DataFrame,
    generate: Callable[[DataFrame], DataFrame],
    first_prompt: Callable[[Column, Column, Column], Column],
    second_prompt: Callable[[Column, Column, Column, Column], Column],
    approved: tuple[str, ...],
    known: tuple[str, ...] = fidelity.KNOWN_NAMES,
    size: int = 20,
    profile: Profile = CJK,
) -> DataFrame:
    """id, first, second, issues, reasons, delta_pinc4, delta_pinc6, accepted: two calls a case, never a retry.

    cases: id, original, exactly size of them. generate adds raw, error and finish to rows with id, stage and prompt. The first call rewrites without the
    replacement terms that the original has, unless they are entities; the second, asked with the draft, only repairs facts, and
    answers with a reply. A case without a first text has no second call.
    """
    n = cases.count()
    if n != size:
        raise ValueError(f"{n} cases: an experiment has exactly {size}")
    original = F.coalesce("original", F.lit(""))
    entities = F.filter(fidelity.terms(known), lambda w: F.contains(original, w))
    rows = cases.select("id", original.alias("original"), entities.alias("entities"))
    banned = F.filter(fidelity.terms(approved), lambda w: F.contains(F.col("original"), w) & ~F.array_contains("entities", w))
    rows = written(rows.withColumn("banned", banned), "cases")

    def call(df: DataFrame, stage: int, prompt: Column) -> DataFrame:
        got = generate(df.select("id", F.lit(stage).alias("stage"), prompt.alias("prompt")))
        short = F.when(F.col("finish") == "length", F.lit("provider_output_truncated"))
        told = F.filter(F.array(short, F.col("error")), lambda e: e.isNotNull())
        return written(got.select("id", "raw", told.alias("errors")), f"stage-{stage}")

    def measured(texts: DataFrame) -> DataFrame:
        both = texts.join(rows, "id").where("text is not null")
        found = fidelity.measures(both, "id", "original", "text", F.col("entities"), F.col("banned"), profile)
        return found.select("id", F.struct(*[c for c in found.columns if c != "id"]).alias("m"))

    first = call(rows, 1, first_prompt(F.col("original"), F.col("banned"), F.col("entities"))).withColumn("text", strip_fences(stripped(F.col("raw"))))
    drafts = rows.join(first.where("text is not null").select("id", "text"), "id")
    second = call(drafts, 2, second_prompt(F.col("original"), F.col("text"), F.col("banned"), F.col("entities"))).withColumn("reply", reply(F.col("raw")))
    invalid = F.when(F.col("raw").isNotNull() & F.col("reply").isNull(), F.array(F.lit("repair_json_invalid"))).otherwise(F.array().cast("array<string>"))
    second = written(second.select("id", stripped(F.col("reply.repaired_text")).alias("text"), F.col("reply.issues").alias("issues"), F.concat("errors", invalid).alias("errors")), "repaired")
    before, after = measured(first), measured(second)
    both = (
        rows.select("id").join(first.select("id", F.col("text").alias("first"), F.col("errors").alias("e1")), "id", "left")
        .join(second.select("id", F.col("text").alias("second"), "issues", F.col("errors").alias("e2")), "id", "left")
        .join(before.withColumnRenamed("m", "m1"), "id", "left").join(after.withColumnRenamed("m", "m2"), "id", "left")
    )
    none = F.array().cast("array<string>")
    errors = F.concat(F.coalesce("e1", none), F.coalesce("e2", none))
    final = F.when(F.col("m1").isNull() | F.col("m2").isNull(), F.array(F.lit("missing_stage_metrics"))).otherwise(gates.final_reasons(F.col("m1"), F.col("m2")))
    told = F.when(F.col("first").isNull(), F.concat(F.coalesce("e1", none), F.array(F.lit("second_skipped_without_valid_first_call")))).otherwise(F.concat(errors, final))
    out = both.withColumn("reasons", told)
    deltas = [(F.col(f"m2.pinc{n}") - F.col(f"m1.pinc{n}")).alias(f"delta_pinc{n}") for n in (4, 6)]
    return out.select("id", "first", "second", "issues", "reasons", *deltas, (F.size("reasons") == 0).alias("accepted"))
