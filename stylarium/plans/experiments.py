"""Experiment arms over sweeps and loops: jobs, memoised prompts, counters, transitions, ablations, audits and integrity checks."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import style
from ..functions.numerals import bind
from ..functions.text import sha
from ..operators import agent, gates, stats
from ..operators.products import QUERIES, ROWS, matrix
from ..sources.tables import written
from ..sources.vectors import memoized

FUSIONS = ("balanced", "content", "equal", "style")


def jobs(spark: SparkSession, configs: Sequence[str] = FUSIONS, most: int = 3) -> DataFrame:
    """config, k, name: no exemplars first, then every configuration with 1 to most."""
    rows = [(None, 0, "retrieval-k0", 0)] + [(c, k, f"retrieval-{c}-k{k}", 1 + i * most + k) for i, c in enumerate(configs) for k in range(1, most + 1)]
    return spark.createDataFrame(rows, "config string, k int, name string, place int")


def arms(spark: SparkSession, prefix: str = "agent", sources: Sequence[str] = ("balanced-k2", "k0"), forms: Sequence[str] = ("followup", "restate")) -> DataFrame:
    """arm, source, form, baseline: every exemplar source with every feedback format."""
    rows = [(f"{prefix}-{s}-{f}", s, f, f"retrieval-{s}") for s in sources for f in forms]
    return spark.createDataFrame(rows, "arm string, source string, form string, baseline string")


def job_prompts(queries: DataFrame, exemplars: DataFrame, jobs_: DataFrame, system: str, key: str = "id") -> DataFrame:
    """name, id, digest, exemplar_ids, messages: the prompt of every query under every job.

    exemplars: config, id, exemplars (array of (id, plain, styled) by rank); a job takes the first k, and must find them.
    """
    rows = queries.select(key, "vernacular").join(F.broadcast(jobs_))  # a stated set of jobs, at most a few dozen
    rows = rows.join(exemplars.withColumnRenamed("exemplars", "_all"), [key, "config"], "left")
    none = F.expr("cast(array() as array<struct<id:string,plain:string,styled:string>>)")
    taken = F.coalesce(F.when(F.col("k") > 0, F.slice("_all", F.lit(1), F.col("k"))), none)
    enough = F.when(F.size(taken) == F.col("k"), taken).otherwise(F.raise_error(F.concat(F.lit("too few exemplars for "), F.col(key).cast("string"), F.lit(" in "), F.col("name"))))
    rows = rows.withColumn("_ex", enough)
    messages = agent.prompt(F.lit(system), F.transform("_ex", lambda e: F.struct(e["plain"], e["styled"])), F.col("vernacular"))
    out = rows.select("name", key, messages.alias("messages"), F.reverse(F.transform("_ex", lambda e: e["id"])).alias("exemplar_ids"))
    return out.withColumn("digest", agent.messages_hash(F.col("messages")))


def count_work(prompts: DataFrame) -> DataFrame:
    """rows and unique_prompts of a dry run."""
    return prompts.agg(F.count("*").alias("rows"), F.countDistinct("digest").alias("unique_prompts"))


def generate_all(prompts: DataFrame, memo: DataFrame | None, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """prompts with output, each distinct prompt computed at most once, and the memo's new rows (digest, output)."""

    def fresh(missing: DataFrame) -> DataFrame:
        first = prompts.groupBy("digest").agg(F.first("messages").alias("messages"))
        return compute(missing.join(first, "digest")).select("digest", "output")

    return memoized(prompts, memo, "digest", "output", fresh)


def remaining(asked: DataFrame, written_rows: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """What a run that starts again still has to do."""
    return asked if written_rows is None else asked.join(written_rows.select(*keys).distinct(), list(keys), "left_anti")


def require_baseline(control: DataFrame, baseline: DataFrame) -> None:
    """The outputs without exemplars must equal the baseline before other groups run."""
    both = control.select("id", "output").join(baseline.select("id", F.col("output").alias("_b")), "id", "full")
    gates.require_empty(both.where(~F.col("output").eqNullSafe(F.col("_b"))).select("id"), "outputs that differ from the baseline")


def sweep(prompts: DataFrame, baseline: DataFrame, compute: Callable[[DataFrame], DataFrame], control: str = "retrieval-k0", memo: DataFrame | None = None) -> DataFrame:
    """name, id, exemplar_ids, digest, output of every job: the control first, which must equal the baseline before others run.

    A prompt that several jobs share is computed once.
    """
    columns = ("name", "id", "exemplar_ids", "digest", "output")
    first, fresh = generate_all(prompts.where(F.col("name") == control), memo, compute)
    first = written(first.select(*columns), "control")
    require_baseline(first, baseline)
    known = first.select("digest", "output").distinct()
    known = known if memo is None else known.unionByName(memo.select("digest", "output")).distinct()
    rest, _ = generate_all(prompts.where(F.col("name") != control), known, compute)
    return first.unionByName(rest.select(*columns))


def report_mismatches(report: DataFrame, rows: DataFrame) -> DataFrame:
    """id, reported, own where the reported hash is not that of the output."""
    own = rows.select("id", sha(F.col("output"), "sha256:").alias("own"))
    both = report.select("id", F.col("output_hash").alias("reported")).join(own, "id", "full")
    return both.where(~F.col("reported").eqNullSafe(F.col("own")))


def first_round_mismatches(loops: DataFrame, baseline: DataFrame) -> DataFrame:
    """Ids whose first round is not the output the loop started from."""
    first = F.get(F.filter("rounds", lambda r: r["round"] == 1), F.lit(0))["output"]
    both = loops.select("id", first.alias("own")).join(baseline.select("id", "output"), "id")
    return both.where(F.col("own").isNotNull() & (F.col("own") != F.col("output"))).select("id")


def round_distribution(loops: DataFrame, most: int = 3) -> DataFrame:
    """what, bucket, n: total rounds, the round kept (or none) and the termination, every bucket present."""
    rows = loops.select(
        F.explode(
            F.array(
                F.struct(F.lit("total_rounds").alias("what"), F.col("total_rounds").cast("string").alias("bucket")),
                F.struct(F.lit("selected_round").alias("what"), F.coalesce(F.col("selected_round").cast("string"), F.lit("none")).alias("bucket")),
                F.struct(F.lit("termination").alias("what"), F.col("termination").alias("bucket")),
            )
        ).alias("x")
    ).select("x.*")
    rounds = [str(i) for i in range(1, most + 1)]
    buckets = [("total_rounds", b) for b in rounds] + [("selected_round", b) for b in [*rounds, "none"]] + [("termination", b) for b in agent.TERMINATIONS]
    every = loops.sparkSession.createDataFrame(buckets, "what string, bucket string")
    counts = rows.groupBy("what", "bucket").agg(F.count("*").alias("n"))
    return every.join(counts, ["what", "bucket"], "full").select("what", "bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _first_and_final(loops: DataFrame) -> DataFrame:
    none = F.expr(f"cast(array() as array<{agent.VIOLATION}>)")
    of = lambda at: F.coalesce(F.get(F.filter("rounds", lambda r: r["round"] == at), F.lit(0))["violations"], none)
    return loops.select("id", F.array_distinct(of(F.lit(1))).alias("first"), F.array_distinct(of(F.col("selected_round"))).alias("final"))


def violation_transitions(loops: DataFrame) -> DataFrame:
    """kind, first, final, fixed, introduced, first_cases, final_cases; a violation is its kind, expected and actual together.

    Without a kept round there are no final violations. Every kind has a row.
    """
    rows = _first_and_final(loops)
    moves = agent.transitions(F.col("first"), F.col("final"))
    rows = rows.select("first", "final", moves["fixed"].alias("fixed"), moves["introduced"].alias("introduced"))
    is_kind = lambda kind: lambda v: v["kind"] == kind
    sums = []
    for kind in agent.KIND_ORDER:
        for name in ("first", "final", "fixed", "introduced"):
            n = F.size(F.filter(name, is_kind(kind)))
            sums.append(F.sum(n).alias(f"{kind}__{name}"))
            if name in ("first", "final"):
                sums.append(F.sum((n > 0).cast("long")).alias(f"{kind}__{name}_cases"))
    wide = rows.agg(*sums)
    cells = ("first", "final", "fixed", "introduced", "first_cases", "final_cases")
    return wide.select(
        F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), *[F.coalesce(F.col(f"{kind}__{c}"), F.lit(0)).alias(c) for c in cells]) for kind in agent.KIND_ORDER])).alias("x")
    ).select("x.*")


def loop_counters(loops: DataFrame) -> DataFrame:
    """first_round_violation_cases, echo_stripped_rounds."""
    first = F.exists("rounds", lambda r: (r["round"] == 1) & (F.size(r["violations"]) > 0))
    cut = F.size(F.filter("rounds", lambda r: r["echo_stripped_chars"] > 0))
    return loops.agg(F.count_if(first).alias("first_round_violation_cases"), F.sum(cut).cast("long").alias("echo_stripped_rounds"))


def feedback_echo(loops: DataFrame) -> DataFrame:
    """final_cases, revision_rounds(_total), second_round(_total): later rounds that hold a lead, or a quoted fragment of an
    earlier round's violations."""
    order = Window.partitionBy("id").orderBy("r.round")
    rounds = loops.select("id", "selected_round", F.explode("rounds").alias("r"))
    marks = F.filter(F.flatten(F.transform("r.violations", lambda v: F.array(v["expected"], v["actual"]))), lambda m: F.coalesce(m, F.lit("")) != "")
    earlier = F.flatten(F.collect_list(marks).over(order.rowsBetween(Window.unboundedPreceding, -1)))  # a loop has few rounds
    place = F.row_number().over(order)
    rows = rounds.select("id", "selected_round", F.col("r.round").alias("round"), F.col("r.output").alias("text"), earlier.alias("seen"), place.alias("place"))
    echoed = F.exists("seen", lambda m: F.contains(F.col("text"), F.concat(F.lit("「"), m, F.lit("」"))))
    for lead in agent.LEADS.values():
        echoed = echoed | F.contains("text", F.lit(lead))
    later = rows.where("place > 1").withColumn("echoed", F.coalesce(echoed, F.lit(False)))
    return later.agg(
        F.count_if(F.col("echoed") & F.col("selected_round").eqNullSafe(F.col("round"))).alias("final_cases"),
        F.count_if("echoed").alias("revision_rounds"),
        F.count("*").alias("revision_rounds_total"),
        F.count_if(F.col("echoed") & (F.col("place") == 2)).alias("second_round"),
        F.count_if(F.col("place") == 2).alias("second_round_total"),
    )


def token_spread(rows: DataFrame, tokens: str, by: Sequence[str] = ()) -> DataFrame:
    """The seven numbers of token counts; none at all is an error."""
    known = rows.where(F.col(tokens).isNotNull())
    if known.isEmpty():
        raise ValueError("no token counts")
    return stats.seven_numbers(known, tokens, list(by))


def ablation(
    pool: DataFrame, cases: DataFrame, dims: int, ks: Sequence[int] = (1, 3), alphas: Sequence[float] = (0.01, 0.1, 1.0, 10.0, 100.0), seed: int = 42
) -> DataFrame:
    """case_id, work, arm, k, gap: the mean gap to a case's own vector of the k pool vectors that each arm picks.

    pool: id, work, fold, x (plain z), y (styled z). cases: case_id, work, fold, x, y, a stated query set. Arms: predicted
    (ridge fitted without the case's fold, its alpha chosen on the other folds), raw (the plain vector itself), mean (the
    pool's mean), oracle (the own vector) and random (the mean gap over the whole fold-free pool). A case is compared with
    pool rows of other folds only; rows and cases without vectors take no part.
    """
    folds = [r["fold"] for r in cases.select("fold").distinct().orderBy("fold").collect()]  # a handful
    guess = F.lit(None).cast("array<double>")
    for f in folds:
        train = pool.where(F.col("fold") != F.lit(f))
        alpha = stats.choose_alpha(train, "x", "y", "fold", (dims, dims), list(alphas))
        coef = stats.fit_ridge(train, "x", "y", (dims, dims), alpha)
        guess = F.when(F.col("fold") == F.lit(f), stats.predict(F.col("x"), coef)).otherwise(guess)
    means = pool.agg(*[F.avg(F.col("y")[i]).alias(f"m{i}") for i in range(dims)]).first()
    centre = F.array(*[F.lit(float(means[f"m{i}"])) for i in range(dims)])
    arms_ = {"predicted": guess, "raw": F.col("x"), "mean": centre, "oracle": F.col("y")}
    asked = cases.where("x is not null and y is not null").select("case_id", "work", F.col("fold").alias("case_fold"), F.col("y").alias("own"), *[q.alias(f"q_{n}") for n, q in arms_.items()])
    met = _met(pool.where("y is not null").select("id", "fold", "y"), asked, list(arms_), max(ks))
    of_k = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    order = Window.partitionBy("case_id", "arm").orderBy("d", "id")
    best = met.where("arm <> 'random'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(ks))
    out = best.select("*", of_k).where("rank <= k").groupBy("case_id", "work", "arm", "k").agg(F.avg("gap").alias("gap"))
    rest = met.where("arm = 'random'").groupBy("case_id", "work", "arm").agg((F.sum("gap") / F.sum("n")).alias("gap"))
    return out.unionByName(rest.select("case_id", "work", "arm", of_k, "gap"))


def _met(pool: DataFrame, asked: DataFrame, arms_: Sequence[str], depth: int) -> DataFrame:
    """case_id, work, arm, id, d, gap, n: of every block of pool rows the depth nearest of each case and arm, and, as arm random, the sum of all n gaps.

    Any number of cases: blocks of cases meet blocks of pool rows, as in products.nearest.
    """
    n_rows, n_cases = (max(1, math.ceil(df.count() / most)) for df, most in ((pool, ROWS), (asked, QUERIES)))
    many = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    rows = pool.select("id", F.col("fold").alias("row_fold"), F.col("y").alias("v"), dealt("id", n_rows).alias("row_block"), many(n_cases).alias("case_block"))
    cases = asked.select("*", dealt("case_id", n_cases).alias("case_block"), many(n_rows).alias("row_block"))
    names = ["case_id", "work", "arm", "id", "d", "gap", "n"]

    def meet(_: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            of = lambda column, at: column.to_numpy(dtype=object)[at]
            y, own = matrix(b["v"]), matrix(a["own"])
            free = a["case_fold"].to_numpy()[:, None] != b["row_fold"].to_numpy()[None, :]
            place = np.unique(b["id"].to_numpy(), return_inverse=True)[1]
            gap = sum(np.abs(y[None, :, c] - own[:, None, c]) for c in range(y.shape[1])) / y.shape[1]
            n = free.sum(axis=1)
            all_ = np.where(free, gap, 0.0).sum(axis=1)
            out.append(pd.DataFrame({"case_id": a["case_id"], "work": a["work"], "arm": "random", "id": None, "d": None, "gap": all_, "n": n})[n > 0])
            for arm in arms_:
                q = matrix(a[f"q_{arm}"])
                d = sum((y[None, :, c] - q[:, None, c]) ** 2 for c in range(y.shape[1]))
                last = np.partition(np.where(free, d, np.inf), min(depth, d.shape[1]) - 1, axis=1)[:, [min(depth, d.shape[1]) - 1]]
                i, j = np.nonzero(free & ~(d > last))
                at = np.lexsort((place[j], d[i, j], i))
                i, j = i[at], j[at]
                first = np.arange(len(i)) - np.searchsorted(i, i) < depth
                i, j = i[first], j[first]
                out.append(pd.DataFrame({"case_id": of(a["case_id"], i), "work": of(a["work"], i), "arm": arm, "id": of(b["id"], j), "d": d[i, j], "gap": gap[i, j], "n": 1}))
        return pd.concat(out)[names] if out else pd.DataFrame(columns=names)

    kinds = {"case_id": asked.schema["case_id"].dataType, "work": asked.schema["work"].dataType, "arm": T.StringType(), "id": pool.schema["id"].dataType, "d": T.DoubleType(), "gap": T.DoubleType(), "n": T.LongType()}
    keys = ["row_block", "case_block"]
    return cases.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(meet, T.StructType([T.StructField(c, kinds[c]) for c in names]))


def ablation_summary(gaps: DataFrame) -> DataFrame:
    """arm, k, work (null overall), n, gap: means of ablation()."""
    sets = [[F.col("arm"), F.col("k"), F.col("work")], [F.col("arm"), F.col("k")]]
    return gaps.groupingSets(sets, F.col("arm"), F.col("k"), F.col("work")).agg(F.grouping("work").cast("int").alias("is_total"), F.count("*").alias("n"), F.avg("gap").alias("gap"))


def oracle_violations(summary: DataFrame) -> DataFrame:
    """Groups whose mean lies under the oracle's: there must be none."""
    best = summary.where("arm = 'oracle'").select("k", "work", "is_total", "gap").toDF("_k", "_w", "_t", "oracle")
    same = (F.col("k") == F.col("_k")) & F.col("work").eqNullSafe(F.col("_w")) & (F.col("is_total") == F.col("_t"))
    return summary.join(best, same).where(F.col("gap") < F.col("oracle") - 1e-12).select("arm", "k", "work")


def advantage(gaps: DataFrame, k: int = 3, draws: int = 10_000) -> DataFrame:
    """other, mean, low, high, clear: predicted minus raw and minus mean; clear where the whole interval is under 0."""
    wide = gaps.where(F.col("k") == k).groupBy("case_id").agg(*[F.max(F.when(F.col("arm") == a, F.col("gap"))).alias(a) for a in ("predicted", "raw", "mean")])
    diffs = wide.select("case_id", F.explode(F.array(*[F.struct(F.lit(a).alias("other"), (F.col("predicted") - F.col(a)).alias("diff")) for a in ("raw", "mean")])).alias("x")).select("case_id", "x.*")
    return stats.bootstrap_exact(diffs, "diff", "other", "case_id", draws).withColumn("clear", F.col("high") < 0)


def scorer_audit(versions: DataFrame, labels: Sequence[str] = ("vernacular", "base", "lora")) -> DataFrame:
    """candidate, label (null overall), spearman, pick_rate of two online scores against the truth.

    versions: id, label, z, original_z, predicted_z. Truth: the gap to the original. Candidate A: the distance of the style
    distance from 1; candidate B: the gap to the predicted vector.
    """
    gap = lambda a, b: style.gap_per_case(F.zip_with(a, b, lambda x, y: x - y))
    scored = versions.select("id", "label", gap("z", "original_z").alias("truth"), F.abs(style.distance(F.col("z")) - 1).alias("A"), gap("z", "predicted_z").alias("B"))
    out = None
    for name in ("A", "B"):
        each = stats.spearman(scored, name, "truth", ["label"]).select(F.lit(name).alias("candidate"), "label", "spearman", F.lit(None).cast("double").alias("pick_rate"))
        rate = stats.pick_rate(scored, "id", "label", "truth", name, list(labels)).select(F.lit(name).alias("candidate"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("spearman"), "pick_rate")
        part = each.unionByName(rate)
        out = part if out is None else out.unionByName(part)
    return out


def run_arms(arms_: DataFrame, run_one: Callable[[Mapping], DataFrame]) -> dict[str, DataFrame]:
    """Each arm's loops; arms are a stated handful."""
    return {r["arm"]: run_one(r.asDict()) for r in arms_.collect()}


def arm_record(loops: DataFrame, tokens: str | None = None) -> dict:
    """Counts of an arm for its manifest: no prose."""
    counters = loop_counters(loops).first().asDict()
    rounds = {(r["what"], r["bucket"]): r["n"] for r in round_distribution(loops).collect()}
    record = {"n": loops.count(), **counters, "rounds": {f"{w}:{b}": n for (w, b), n in sorted(rounds.items())}}
    if tokens:
        record["tokens"] = token_spread(loops, tokens).first().asDict()
    return record


def attempts(chunks: DataFrame, generate: Callable[[DataFrame, int], DataFrame], gate: Callable[[DataFrame], DataFrame], most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Accepted pairs and all attempt records of a rebuild: chunks that a gate refuses are tried again with its reasons.

    generate(rows with id, original, feedback, attempt) adds output and model; gate adds reasons (empty: accepted). Several
    models among the answers are an error.
    """
    left, records = chunks.withColumn("feedback", F.lit("")), None
    for attempt in range(1, most + 1):
        made = written(gate(generate(left.withColumn("attempt", F.lit(attempt)), attempt)), "attempt")
        models = [r["model"] for r in made.select("model").distinct().limit(2).collect()]
        if len(models) > 1:
            raise ValueError(f"answers of several models: {sorted(models)}")
        records = made if records is None else records.unionByName(made)
        refused = made.where("reasons <> ''").withColumn("feedback", F.col("reasons"))
        left = refused.select(*left.columns)
        if left.isEmpty():
            break
    accepted = records.where("reasons = ''")
    return accepted, records


def two_pass(first: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    """key, reasons of the second pass; first and second are tables of fidelity.measures."""
    columns = [c for c in first.columns if c != key]
    a = first.select(key, F.struct(*columns).alias("_a"))
    both = a.join(second.select(key, F.struct(*columns).alias("_b")), key)
    return both.select(key, F.array_join(gates.final_reasons(F.col("_a"), F.col("_b")), ",").alias("reasons"))


def repaired_json(text: Column, ddl: str) -> Column:
    """A record from an answer that may stand in a fence or between other words; null if there is none."""
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return bind(F.from_json(inner, ddl), lambda x: x)
