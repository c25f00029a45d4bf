"""The rewrite loop as an unrolled plan: generate, verify, score and route, one written table a round."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fidelity, style
from ..functions.text import CJK, Profile
from ..operators import agent, stats
from ..sources.tables import written

#: DataFrame functions that the loop is given. generate adds text and error to rows with messages; verify adds violations
#: and score adds score to rows with input and text; retrieve replaces exemplars.
Step = Callable[[DataFrame], DataFrame]
ROUND = f"struct<round:int,output:string,violation_count:int,violations:array<{agent.VIOLATION}>,score:double,echo_stripped_chars:int>"
TRACE = "array<string>"
STATE = ("id", "input", "exemplars", "rounds", "last_violations", "last_output", "iter", "done", "halt_kind", "error", "re_retrieved", "last_score", "trace")


@dataclass(frozen=True)
class Settings:
    """most: generations; least: the score under which exemplars are retrieved again once, never without it."""

    most: int = 3
    least: float | None = None
    form: str = "followup"
    echo_guard: bool = False
    system: str = ""


def start(requests: DataFrame) -> DataFrame:
    """requests: id, input, exemplars (array of (id, plain, styled))."""
    empty = lambda t: F.expr(f"cast(array() as {t})")
    none = F.lit(None)
    return requests.select(
        "id", "input", "exemplars", empty(f"array<{ROUND}>").alias("rounds"), empty(f"array<{agent.VIOLATION}>").alias("last_violations"), none.cast("string").alias("last_output"),
        F.lit(0).alias("iter"), F.lit(False).alias("done"), none.cast("string").alias("halt_kind"), none.cast("string").alias("error"), F.lit(False).alias("re_retrieved"),
        none.cast("double").alias("last_score"), empty(TRACE).alias("trace"),
    )


def event(node: str, **payload: Column) -> Column:
    """A node's visit without any prose: ids, hashes and counts."""
    return F.to_json(F.struct(F.lit(node).alias("node"), *[v.alias(k) for k, v in payload.items()]), {"ignoreNullFields": "false"})


def one_round(state: DataFrame, settings: Settings, generate: Step, verify: Step, score: Step, retrieve: Step | None) -> DataFrame:
    """The unfinished rows after one more generation; finished rows as they are."""
    finished, live = state.where("done"), state.where("not done")
    base = agent.prompt(F.lit(settings.system), F.transform("exemplars", lambda e: F.struct(e["plain"], e["styled"])), F.col("input"))
    messages = agent.next_messages(base, F.col("input"), F.col("last_output"), F.col("last_violations"), settings.form)
    # Outside calls are made once: what they gave is written before it is read twice.
    asked = live.withColumn("messages", messages).withColumn("prompt_sha256", agent.messages_hash(F.col("messages")))
    made = written(generate(asked), "generated")
    failed = F.col("error").isNotNull()
    echo = agent.cut_echo(F.col("text"), F.col("last_violations"))
    whole = F.struct(F.col("text").alias("kept"), F.lit(0).alias("removed"))
    made = made.withColumn("_cut", echo if settings.echo_guard else whole).withColumn("text", F.when(~failed, F.col("_cut.kept"))).withColumn("removed", F.when(~failed, F.col("_cut.removed")).otherwise(0)).drop("_cut")
    blank = ~failed & (F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "") == "")
    judged = score(verify(made.withColumn("_blank", blank)))
    none = F.expr(f"cast(array() as array<{agent.VIOLATION}>)")
    judged = judged.withColumn("violations", F.when(F.col("_blank") | failed, none).otherwise(F.col("violations"))).withColumn("score", F.when(F.col("_blank"), 0.0).otherwise(F.col("score")))
    done = F.col("iter") + 1
    decision = agent.route(failed, F.col("_blank"), F.size("violations"), F.col("score"), done, settings.most, settings.least, F.col("re_retrieved"))
    record = F.struct(
        done.cast("int").alias("round"), F.col("text").alias("output"), F.size("violations").alias("violation_count"), F.col("violations"), F.col("score"), F.col("removed").cast("int").alias("echo_stripped_chars")
    )
    visits = F.array(
        event("generate", round=done, feedback_format=F.lit(settings.form), prompt_sha256=F.col("prompt_sha256"), output_sha256=F.sha2(F.coalesce("text", F.lit("")), 256), output_chars=F.length(F.coalesce("text", F.lit(""))), echo_stripped_chars=F.col("removed"), raised=failed),
        event("verify", violation_count=F.size("violations"), violations=F.col("violations")),
        event("score", score=F.col("score")),
        event("route", decision=F.col("_route")),
    )
    judged = judged.withColumn("_route", decision)
    after = judged.select(
        "id", "input", "exemplars",
        F.when(failed, F.col("rounds")).otherwise(F.array_append("rounds", record)).alias("rounds"),
        F.when(failed, F.col("last_violations")).otherwise(F.col("violations")).alias("last_violations"),
        F.when(failed, F.col("last_output")).otherwise(F.col("text")).alias("last_output"),
        done.cast("int").alias("iter"),
        (F.col("_route") == "accept").alias("done"),
        F.when(failed, F.when(F.col("iter") == 0, "first_round_error").otherwise("later_round_error")).alias("halt_kind"),
        "error",
        (F.col("re_retrieved") | (F.col("_route") == "re_retrieve")).alias("re_retrieved"),
        F.when(failed, F.col("last_score")).otherwise(F.col("score")).alias("last_score"),
        F.concat("trace", visits).alias("trace"),
        F.col("_route"),
    )
    if retrieve is not None and settings.least is not None:
        again = retrieve(after.where("_route = 're_retrieve'").drop("_route")).select(*STATE)
        again = again.withColumn("trace", F.array_append("trace", event("retrieve", exemplar_ids=F.transform("exemplars", lambda e: e["id"]), is_re_retrieve=F.lit(True))))
        after = after.where("_route <> 're_retrieve'").drop("_route").unionByName(again)
    else:
        after = after.drop("_route")
    return finished.unionByName(after.select(*STATE))


def run(requests: DataFrame, generate: Step, verify: Step, score: Step, settings: Settings = Settings(), retrieve: Step | None = None) -> DataFrame:
    """id, output, selected_round, total_rounds, termination, fallback_kind, error, rounds, re_retrieved, trace of each request.

    A round works on the rows that still go on; each round's state is a written table, so that a lost executor costs no
    outside call of an earlier round.
    """
    state = start(retrieve(requests) if retrieve is not None and "exemplars" not in requests.columns else requests)
    for _ in range(settings.most):
        state = written(one_round(state, settings, generate, verify, score, retrieve), "rounds")
    return result(state, settings)


def result(state: DataFrame, settings: Settings) -> DataFrame:
    """Never an empty success: an error in the first round and all-blank versions give the input, labelled as a fallback."""
    keyed = F.transform("rounds", lambda r: F.struct(r["round"], r["output"], r["violation_count"].alias("violations"), r["score"]))
    best = F.when(F.col("halt_kind").eqNullSafe("first_round_error"), F.lit(None).cast("int")).otherwise(agent.best_round(keyed))
    rows = state.withColumn("selected_round", best)
    low = F.lit(False) if settings.least is None else F.coalesce(F.col("last_score") < settings.least, F.lit(False))
    unfinished = (F.col("iter") >= settings.most) & ((F.size("last_violations") > 0) | low)
    none_left = F.col("selected_round").isNull()
    kind = F.when(F.col("halt_kind").eqNullSafe("first_round_error"), "first_round_error").when(none_left, "all_blank").otherwise(F.col("halt_kind"))
    ended = agent.termination(F.lit(False), kind.isNotNull(), unfinished)
    chosen = F.get(F.filter("rounds", lambda r: r["round"] == F.col("selected_round")), F.lit(0))["output"]
    return rows.select(
        "id",
        F.coalesce(chosen, F.col("input")).alias("output"),
        "selected_round",
        F.col("iter").alias("total_rounds"),
        ended.alias("termination"),
        kind.alias("fallback_kind"),
        "error",
        "rounds",
        "re_retrieved",
        "trace",
    )


def fidelity_verifier(dims: fidelity.Dimensions) -> Step:
    def verify(df: DataFrame) -> DataFrame:
        found = fidelity.fact_violations(F.col("_s"), F.col("_o"))
        rows = df.withColumn("_s", fidelity.facts(F.col("input"), dims)).withColumn("_o", fidelity.facts(F.coalesce("text", F.lit("")), dims))
        return rows.withColumn("violations", found).drop("_s", "_o")

    return verify


def predictor_scorer(reference: DataFrame, coef, profile: Profile = CJK) -> Step:
    """The online score: minus the mean absolute error of the output's z against the one predicted from the input's z."""

    def score(df: DataFrame) -> DataFrame:
        texts = df.select("id", F.explode(F.array(F.struct(F.lit("i").alias("side"), F.col("input").alias("t")), F.struct(F.lit("o").alias("side"), F.col("text").alias("t")))).alias("x"))
        z = style.z_scores(style.style_features(texts.select("id", "x.side", F.col("x.t").alias("text")), "text", ("id", "side"), profile), reference)
        both = z.groupBy("id").agg(F.max(F.when(F.col("side") == "i", F.col("z"))).alias("_i"), F.max(F.when(F.col("side") == "o", F.col("z"))).alias("_o"))
        error = style.gap_per_case(F.zip_with("_o", stats.predict(F.col("_i"), coef), lambda a, b: a - b))
        return df.join(both.select("id", (-error).alias("score")), "id")

    return score
