"""Registered queries of evaluation runs, retrieval plans, the loop and its experiments, and their SQL.

Rounds, violations, exemplars and fold numbers have no table: both engines derive them from ids by MD5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import BM25_CTE, DIFF_SQL, PAIRS_SQL, REFERENCE_SQL, TOKENS_SQL, _Z, paired_differences, pairs, query, rounded, style_cte, table
from .catalog_fidelity import COUNTED_SQL, DIMS, FACTS_CTE, counted_pairs, pick, pick_sql
from .functions import style, surface, text
from .functions.text import LATIN
from .operators import agent, gates, sampling, stats
from .plans import evaluation, experiments, loop, retrieval_plan
from .sources.tables import written

CONFIGS = tuple(sorted(retrieval_plan.CONFIGS))


# Evaluation.


def eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, vernacular, original, output, model: a pair's input, the first answer of its conversation, its answer."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("original"))
    p = counted_pairs(spark, sf_dir).withColumn("conv_id", F.substring_index("pair_id", "-", 1).cast("long"))
    return p.join(first, "conv_id").select(F.col("pair_id").alias("id"), "work", F.col("src").alias("vernacular"), "original", F.col("out").alias("output"))


CASES_SQL = f"""{FACTS_CTE}, og AS (SELECT conv_id, arg_min(text, turn) AS original FROM conversations WHERE role = 'assistant' GROUP BY 1),
  ca AS (SELECT pair_id AS id, work, src AS vernacular, original, out AS output FROM cp JOIN og ON og.conv_id = split_part(pair_id, '-', 1)::BIGINT)"""
SIDES = "SELECT id, 'plain' AS side, vernacular AS t FROM ca UNION ALL SELECT id, 'original', original FROM ca UNION ALL SELECT id, 'out', output FROM ca"
EVAL_CTE = f"""{CASES_SQL}, {style_cte(SIDES, 'id, side')}, r AS (SELECT {REFERENCE_SQL} FROM style WHERE side = 'original'), zs AS (SELECT id, side, [{_Z}] AS z FROM style, r),
  zw AS (SELECT id, any_value(z) FILTER (side = 'out') AS zo, any_value(z) FILTER (side = 'original') AS zr, any_value(z) FILTER (side = 'plain') AS zp FROM zs GROUP BY 1),
  cm AS (SELECT id, sqrt(list_sum(list_transform(zo, lambda x: x * x))) / sqrt(20.0::DOUBLE) AS style_distance, list_transform(list_zip(zo, zr), lambda p: p[1] - p[2]) AS delta, list_transform(list_zip(zp, zr), lambda p: p[1] - p[2]) AS plain_delta FROM zw),
  sr AS (SELECT pair_id AS id, CASE WHEN len(se) > 0 THEN len(list_intersect(se, oe))::DOUBLE / len(se) ELSE 1 END AS entity_recall, CASE WHEN a = b THEN 1.0 ELSE 0.0 END::DOUBLE AS numeral_recall, CASE WHEN len(oe) > 0 THEN len(list_filter(oe, lambda x: NOT list_contains(se, x)))::DOUBLE / len(oe) ELSE 0 END AS hallucination_rate FROM f),
  cr AS (SELECT id, len(list_intersect(s, o))::DOUBLE / (len(s) + len(o) - len(list_intersect(s, o))) AS copy_ratio, output FROM (SELECT id, output, list_distinct({TOKENS_SQL.format('vernacular')}) AS s, list_distinct({TOKENS_SQL.format('output')}) AS o FROM ca)),
  ev AS (SELECT id, style_distance, list_avg(list_transform(delta, lambda x: abs(x))) AS profile_gap_per_case, entity_recall, numeral_recall, hallucination_rate, copy_ratio, 'sha256:' || sha256(output) AS output_hash, delta, plain_delta FROM cm JOIN sr USING (id) JOIN cr USING (id))"""
MEASURED = ("style_distance", "profile_gap_per_case", "entity_recall", "numeral_recall", "hallucination_rate", "copy_ratio")


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-case table; the copy ratio is the overlap of token sets, which SQL can express, and the reference is the originals'."""
    cases = eval_cases(spark, sf_dir)
    generations = cases.select("id", "output", F.lit("m").alias("model"))
    rows = written(evaluation.joined_cases(cases.drop("output"), generations), "cases")
    reference = written(style.fit_reference(style.style_features(rows, "original", ("id",), LATIN)), "reference")
    same = surface.jaccard(F.array_distinct(text.tokens(F.col("vernacular"), LATIN)), F.array_distinct(text.tokens(F.col("output"), LATIN)))
    return evaluation.case_metrics(rows, reference, DIMS, profile=LATIN, similarity=same)


@query(f"WITH {EVAL_CTE} SELECT id, {', '.join(f'round({m}, 6) AS {m}' for m in MEASURED)}, output_hash FROM ev")
def g18_case_metrics(spark, sf_dir):
    """Cases joined with generations and scored."""
    return rounded(evaluated(spark, sf_dir).select("id", *MEASURED, "output_hash"), "id", "output_hash")


@query(f"""WITH {EVAL_CTE}, m AS ({' UNION ALL '.join(f"SELECT '{m}' AS metric, {m}::DOUBLE AS v FROM ev" for m in MEASURED)})
SELECT metric, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(median(v), 6) AS median, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.75), 6) AS q3, round(min(v), 6) AS min, round(max(v), 6) AS max FROM m GROUP BY metric""")
def a01_distributions(spark, sf_dir):
    """The seven numbers of each metric of an evaluation."""
    return rounded(evaluation.distributions(written(evaluated(spark, sf_dir), "ev"), MEASURED), "metric", "n")


@query(f"""WITH {EVAL_CTE}, l AS (SELECT unnest(delta) AS x, unnest(plain_delta) AS p, unnest({list(style.NAMES)}) AS name FROM ev) SELECT name, round(avg(x), 6) AS delta, round(avg(p), 6) AS plain_delta FROM l GROUP BY name""")
def f29_profile_delta(spark, sf_dir):
    """Signed mean differences of each dimension, of the outputs and of the plain inputs."""
    ev = written(evaluated(spark, sf_dir), "ev")
    plain = evaluation.mean_delta(ev, "plain_delta").withColumnRenamed("delta", "plain_delta")
    return rounded(evaluation.mean_delta(ev).join(plain, "name"), "name")


@query(f"WITH {EVAL_CTE} SELECT id, round(-list_avg(list_transform(list_zip(zo, zp), lambda p: abs(p[1] - (0.5 * p[2] + 0.25)))), 6) AS score FROM zw")
def m07_online_score(spark, sf_dir):
    """Minus the mean absolute error against a vector predicted from the input's (here half of it and a quarter)."""
    import numpy as np

    cases = eval_cases(spark, sf_dir)
    reference = written(style.fit_reference(style.style_features(cases, "original", ("id",), LATIN)), "reference")
    coef = np.vstack([np.full(20, 0.25), 0.5 * np.eye(20)])
    rows = cases.select("id", F.col("vernacular").alias("input"), F.col("output").alias("text"))
    return loop.predictor_scorer(reference, coef, LATIN)(rows).select("id", F.round("score", 6).alias("score"))


@query(f"""WITH {EVAL_CTE}, d AS (SELECT id, {', '.join(f'{m} - 0.5::DOUBLE AS {m}' for m in MEASURED)} FROM ev), m AS ({' UNION ALL '.join(f"SELECT '{m}' AS metric, {m}::DOUBLE AS v FROM d" for m in MEASURED)}) SELECT metric, count(*) AS n, round(avg(v), 6) AS mean FROM m GROUP BY 1""")
def a20_comparison(spark, sf_dir):
    """Paired differences of a run against a constant control: counts and means (intervals come from the standard generator)."""
    ev = written(evaluated(spark, sf_dir), "ev")
    control = ev.select("id", *[F.lit(0.5).alias(m) for m in MEASURED])
    got = evaluation.compare(ev, control, {m: None for m in MEASURED}, draws=1000)
    return got.select("metric", "n", F.round("mean", 6).alias("mean"))


@query(f"""WITH {COUNTED_SQL}, t AS (SELECT pair_id, work, src, out, list_distinct({TOKENS_SQL.format('src')}) AS s, list_distinct({TOKENS_SQL.format('out')}) AS o FROM cp), v AS (SELECT work, len(list_intersect(s, o))::DOUBLE / (len(s) + len(o) - len(list_intersect(s, o))) AS x, length(out)::DOUBLE / length(src) AS r, src = out AS same FROM t)
SELECT work, CAST(grouping(work) AS INTEGER) AS is_total, count(*) AS n, round(avg(x), 6) AS similarity, round(avg(r), 6) AS length_ratio, count(*) FILTER (x >= 0.3) AS near_copies, count(*) FILTER (same) AS identical FROM v GROUP BY GROUPING SETS ((work), ())""")
def a18_probe_block(spark, sf_dir):
    """Similarity (of token sets) and length of outputs to inputs, by work and overall."""
    rows = counted_pairs(spark, sf_dir).select(F.col("work").alias("category"), F.col("src").alias("vernacular"), F.col("out").alias("output"))
    same = surface.jaccard(F.array_distinct(text.tokens(F.col("vernacular"), LATIN)), F.array_distinct(text.tokens(F.col("output"), LATIN)))
    return rounded(evaluation.probe_block(rows, same, 0.3).withColumnRenamed("category", "work"), "work", "is_total", "n", "near_copies", "identical")


@query(f"""WITH {PAIRS_SQL}, {DIFF_SQL}, m AS (SELECT work, 'recall' AS metric, recall AS v FROM r0 UNION ALL SELECT work, 'hallucination', hallucination FROM r0)
SELECT metric, work, CAST(grouping(work) AS INTEGER) AS is_total, count(v) AS n, round(avg(v), 6) AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max FROM m GROUP BY GROUPING SETS ((metric, work), (metric))""")
def a04_metric_summaries(spark, sf_dir):
    """Each metric overall and by work."""
    s, o = F.array_distinct(text.tokens(F.coalesce("src", F.lit("")), LATIN)), F.array_distinct(text.tokens(F.coalesce("out", F.lit("")), LATIN))
    p = pairs(spark, sf_dir).select("work", surface.recall(s, o).alias("recall"), surface.hallucination(s, o).alias("hallucination"))
    out = stats.metric_summaries(p, ["recall", "hallucination"], "work").withColumn("is_total", F.col("is_total").cast("int"))
    return rounded(out, "metric", "work", "is_total", "n")


@query(f"WITH {PAIRS_SQL}, {DIFF_SQL} SELECT pair_id, round(hallucination - recall, 6) AS diff FROM r0")
def j03_paired_diff(spark, sf_dir):
    """The difference of two reports' metrics, case by case."""
    s, o = F.array_distinct(text.tokens(F.coalesce("src", F.lit("")), LATIN)), F.array_distinct(text.tokens(F.coalesce("out", F.lit("")), LATIN))
    p = pairs(spark, sf_dir)
    a, b = p.select("pair_id", surface.recall(s, o).alias("m")), p.select("pair_id", surface.hallucination(s, o).alias("m"))
    return rounded(stats.paired(a, b, "pair_id", "m"), "pair_id")


@query(f"""WITH {PAIRS_SQL}, {DIFF_SQL} SELECT work, round(CASE WHEN var_pop(recall) > 0 THEN 1 - sum((recall - (1 - hallucination)) ** 2) / (var_pop(recall) * count(*)) END, 6) AS r2 FROM r0 GROUP BY work""")
def a23_r_squared(spark, sf_dir):
    """R squared of one metric as a guess of another, by work."""
    s, o = F.array_distinct(text.tokens(F.coalesce("src", F.lit("")), LATIN)), F.array_distinct(text.tokens(F.coalesce("out", F.lit("")), LATIN))
    p = pairs(spark, sf_dir).select("work", surface.recall(s, o).alias("truth"), (1 - surface.hallucination(s, o)).alias("guess"))
    return rounded(stats.r_squared(p, "truth", "guess", ["work"]), "work")


@query(f"""WITH v AS (SELECT doc_id, l, {pick_sql(5, 'doc_id', 'l', "'t'")} AS truth, {pick_sql(5, 'doc_id', 'l', "'g'")} AS guess, list_position(['vernacular', 'base', 'lora'], l) AS o FROM documents, (VALUES ('vernacular'), ('base'), ('lora')) x(l)),
  b AS (SELECT doc_id, arg_min(l, truth * 10 + o) AS t, arg_min(l, guess * 10 + o) AS g FROM v GROUP BY 1) SELECT round(avg((t = g)::INT), 6) AS pick_rate FROM b""")
def a26_pick_rate(spark, sf_dir):
    """How often the least guess names the label of least truth; both come from ids, ties go by the labels' order."""
    labels = ["vernacular", "base", "lora"]
    v = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*[F.lit(x) for x in labels])).alias("l"))
    v = v.select("doc_id", "l", pick(5, "doc_id", "l", F.lit("t")).alias("truth"), pick(5, "doc_id", "l", F.lit("g")).alias("guess"))
    return rounded(stats.pick_rate(v, "doc_id", "l", "truth", "guess", labels))


# Retrieval plans.


def made_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """config, query_id, id, rank, sources: three exemplars a query and configuration, all from ids."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array(*[F.struct(F.lit(c).alias("config"), F.lit(i).alias("no")) for i, c in enumerate(CONFIGS)])).alias("c"))
    h = b.select("c.config", "query_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("rank"), F.col("c.no").alias("no"))
    spot = (F.col("query_id") * 7 + F.col("rank") * 13 + F.col("no") * 5) % 97
    mask = (F.col("query_id") + F.col("rank") + F.col("no")) % 7 + 1
    routes = F.filter(F.array(*[F.when(F.shiftright(mask, i).bitwiseAND(1) == 1, F.struct(F.lit(r).alias("r"), F.col("rank").alias("n"))) for i, r in enumerate(retrieval_plan.ROUTES)]), lambda x: x.isNotNull())
    return h.select("config", "query_id", spot.alias("id"), "rank", F.map_from_entries(routes).alias("sources"))


HITS_SQL = f"""h AS (SELECT config, query_id, (query_id * 7 + rank * 13 + no * 5) % 97 AS id, rank, (query_id + rank + no) % 7 + 1 AS mask FROM (SELECT item_id AS query_id FROM benchmark), (VALUES {', '.join(f"('{c}', {i})" for i, c in enumerate(CONFIGS))}) c(config, no), range(1, 4) t(rank)),
  hk AS (SELECT h.*, k FROM h, range(1, 4) t(k) WHERE rank <= k)"""


@query(f"""WITH {HITS_SQL}, x AS (SELECT config, k, query_id, query_id % 4 AS work, mask & 1 AS b, (mask >> 1) & 1 AS d, (mask >> 2) & 1 AS s, (id % 4 = query_id % 4)::INT AS same, abs(id - query_id) / 10.0::DOUBLE AS gap FROM hk),
  g AS (SELECT config, k, work, CAST(grouping(work) AS INTEGER) AS is_total, count(*) AS slots, avg(b) AS has_bm25, avg(d) AS has_dense, avg(s) AS has_style, avg((s = 1 AND b + d = 0)::INT) AS style_only, avg((s = 0)::INT) AS content_only, avg(same) AS same_work FROM x GROUP BY GROUPING SETS ((config, k, work), (config, k))),
  q AS (SELECT config, k, work, query_id, avg(gap) AS gap FROM x GROUP BY ALL), p AS (SELECT config, k, work, CAST(grouping(work) AS INTEGER) AS is_total, avg(gap) AS profile_gap FROM q GROUP BY GROUPING SETS ((config, k, work), (config, k)))
SELECT g.config, CAST(g.k AS INTEGER) AS k, g.work, g.is_total, slots, round(has_bm25, 6) AS has_bm25, round(has_dense, 6) AS has_dense, round(has_style, 6) AS has_style, round(style_only, 6) AS style_only, round(content_only, 6) AS content_only, round(same_work, 6) AS same_work, round(profile_gap, 6) AS profile_gap
FROM g JOIN p ON g.config = p.config AND g.k = p.k AND g.work IS NOT DISTINCT FROM p.work AND g.is_total = p.is_total""")
def a10_route_stats(spark, sf_dir):
    """Rates of the routes over slots, by configuration, k and work, and overall."""
    h = made_hits(spark, sf_dir)
    ids = spark.range(97).select("id", (F.col("id") % 4).alias("work"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 4).alias("work"))
    gaps = h.select("query_id", "id", (F.abs(F.col("id") - F.col("query_id")) / 10.0).alias("gap")).distinct()
    return rounded(retrieval_plan.route_stats(h, ids, asked, gaps), "config", "k", "work", "is_total", "slots")


@query(f"""WITH {HITS_SQL}, s AS (SELECT config, k, query_id, list_distinct(list(id)) AS ids FROM hk GROUP BY ALL)
SELECT a.config AS "left", b.config AS "right", CAST(a.k AS INTEGER) AS k, round(avg(len(list_intersect(a.ids, b.ids))::DOUBLE / (len(a.ids) + len(b.ids) - len(list_intersect(a.ids, b.ids)))), 6) AS jaccard FROM s a JOIN s b ON a.k = b.k AND a.query_id = b.query_id AND a.config < b.config GROUP BY ALL""")
def a11_plan_jaccard(spark, sf_dir):
    """Overlap of each unordered pair of configurations, for each k."""
    return rounded(retrieval_plan.config_jaccard(made_hits(spark, sf_dir)), "left", "right", "k")


@query(f"""WITH {HITS_SQL}, g AS (SELECT config, k, query_id, avg(abs(id - query_id) / 10.0::DOUBLE) AS gap FROM hk GROUP BY ALL)
SELECT config, CAST(k AS INTEGER) AS k, count(*) AS n, round(avg(gap), 6) AS mean, round(stddev_pop(gap), 6) AS std, round(median(gap), 6) AS median, round(quantile_cont(gap, 0.25), 6) AS q1, round(quantile_cont(gap, 0.75), 6) AS q3, round(min(gap), 6) AS min, round(max(gap), 6) AS max FROM g GROUP BY ALL""")
def t03_plan_prefixes(spark, sf_dir):
    """The gaps of plans of one, two and three exemplars, which are prefixes of each other."""
    h = made_hits(spark, sf_dir)
    gaps = h.select("query_id", "id", (F.abs(F.col("id") - F.col("query_id")) / 10.0).alias("gap")).distinct()
    return rounded(retrieval_plan.gap_summary(h, gaps), "config", "k", "n")


@query(f"""WITH {HITS_SQL}, x AS (SELECT * FROM h WHERE NOT (query_id % 11 = 0 AND rank = 3))
SELECT config, query_id, 'not 3 exemplars' AS error FROM x GROUP BY 1, 2 HAVING count(*) <> 3 UNION ALL SELECT config, query_id, 'an evaluation id' FROM x WHERE id % 20 = 3 UNION ALL SELECT config, query_id, 'the query itself' FROM x WHERE id = query_id
UNION ALL SELECT config, query_id, 'a route of another configuration' FROM x WHERE (config = 'content' AND (mask >> 2) & 1 = 1) OR (config = 'style' AND mask <> 4)""")
def p10_plan_rules(spark, sf_dir):
    """Broken rules of a plan whose faults come from ids."""
    h = made_hits(spark, sf_dir).where("not (query_id % 11 = 0 and rank = 3)")
    return gates.plan_errors(h, spark.range(97).where("id % 20 = 3"))


@query(f"""WITH {HITS_SQL}, d AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents), e AS (SELECT config, query_id, rank, id, md5(t) AS m FROM h JOIN d USING (id) WHERE rank <= 2)
SELECT config, query_id, string_agg(id || ':' || m, '|' ORDER BY rank) AS exemplars FROM e GROUP BY 1, 2""")
def j02_hydrated_exemplars(spark, sf_dir):
    """The texts of the first two exemplars of each query, in rank order."""
    p = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("vernacular"), F.lit("styled").alias("original"))
    h = retrieval_plan.hydrate(made_hits(spark, sf_dir), p, 2)
    return h.select("config", "query_id", F.array_join(F.transform("exemplars", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), F.md5(x["plain"]))), "|").alias("exemplars"))


JOBS_SQL = """j AS (SELECT NULL AS config, 0 AS k, 'retrieval-k0' AS name UNION ALL SELECT config, k, 'retrieval-' || config || '-k' || k FROM (SELECT DISTINCT config FROM h), range(1, 4) t(k)),
  p AS (SELECT name, q.item_id, '[{"role":"system","content":"s"}' || coalesce((SELECT string_agg(',{"role":"user","content":"' || 'p' || id || '"},{"role":"assistant","content":"' || 's' || id || '"}', '' ORDER BY rank DESC) FROM h WHERE h.config = j.config AND h.query_id = q.item_id AND rank <= j.k), '') || ',{"role":"user","content":' || to_json(q.text) || '}]' AS m FROM benchmark q, j)"""


@query(f"""WITH {HITS_SQL}, {JOBS_SQL} SELECT count(*) AS rows, count(DISTINCT sha256(m)) AS unique_prompts FROM p""")
def a28_count_work(spark, sf_dir):
    """Prompts of every query under every job, and how many of them differ."""
    return experiments.count_work(job_prompts(spark, sf_dir))


def job_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = made_hits(spark, sf_dir)
    x = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda e: F.struct(e["id"].cast("string").alias("id"), F.concat(F.lit("p"), e["id"].cast("string")).alias("plain"), F.concat(F.lit("s"), e["id"].cast("string")).alias("styled")))
    plan = h.groupBy("config", F.col("query_id").alias("id")).agg(x.alias("exemplars"))  # three a query
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("vernacular"))
    return experiments.job_prompts(asked, plan, experiments.jobs(spark, CONFIGS), "s")


@query(f"""WITH {HITS_SQL}, {JOBS_SQL} SELECT name, item_id AS id, substr(sha256(m), 1, 12) AS output FROM p""")
def g17_sweep(spark, sf_dir):
    """All jobs of a sweep with a generator that answers by the prompt's hash; the control is held against its baseline first."""
    prompts = written(job_prompts(spark, sf_dir), "prompts")
    answer = lambda missing: missing.withColumn("output", F.substring("digest", 1, 12))
    baseline = prompts.where("name = 'retrieval-k0'").select("id", F.substring("digest", 1, 12).alias("output"))
    return experiments.sweep(prompts, baseline, answer).select("name", "id", "output")


@query("SELECT a.n_nationkey AS key, b.n_nationkey AS other FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey AND a.n_name <> b.n_name")
def j15_leave_one_out(spark, sf_dir):
    """Every nation with the 24 others of another name."""
    pool = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return sampling.leave_one_out(pool, "key", "name", 24)


BQ = "SELECT 'd' AS kind, doc_id AS id, coalesce(text, '') AS t FROM documents UNION ALL SELECT 'q', item_id, coalesce(text, '') FROM benchmark"
HYBRID_SQL = f"""WITH {BM25_CTE}, {style_cte(BQ, 'kind, id')}, rf AS (SELECT {REFERENCE_SQL} FROM style WHERE kind = 'd'), zs AS (SELECT kind, id, [{_Z}] AS z FROM style, rf),
  b1 AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM bm WHERE score > 0 AND query_id <> id),
  v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), c1 AS (SELECT q.id AS query_id, d.id, round(list_dot_product(d.v, q.v) / (sqrt(list_dot_product(d.v, d.v)) * sqrt(list_dot_product(q.v, q.v))), 9) AS score FROM v d JOIN v q ON q.id IN (SELECT item_id FROM benchmark) AND q.id <> d.id),
  d1 AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM c1),
  s0x AS (SELECT q.id AS query_id, d.id, round(-list_distance(d.z, list_transform(q.z, lambda x: 0.5 * x)), 9) AS score FROM zs d JOIN zs q ON d.kind = 'd' AND q.kind = 'q' AND d.id <> q.id), s1x AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s0x),
  u AS (SELECT 'bm25' AS route, * FROM b1 WHERE rank <= 20 UNION ALL SELECT 'dense', * FROM d1 WHERE rank <= 20 UNION ALL SELECT 'style', * FROM s1x WHERE rank <= 20),
  w AS (SELECT * FROM (VALUES {', '.join(f"('{c}', '{r}', {w[r]}::DOUBLE)" for c, w in retrieval_plan.CONFIGS.items() for r in retrieval_plan.ROUTES)}) t(config, route, weight) WHERE weight > 0),
  fu AS (SELECT config, query_id, id, round(sum(weight / (60 + rank)), 9) AS score, string_agg(route || ':' || rank, ',' ORDER BY route) AS sources FROM u JOIN w USING (route) GROUP BY ALL),
  fr AS (SELECT *, CAST(row_number() OVER (PARTITION BY config, query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM fu)
SELECT config, query_id, id, rank, score, sources FROM fr WHERE rank <= 3"""


@query(HYBRID_SQL)
def m05_hybrid_search(spark, sf_dir):
    """BM25, dense and style routes fused under all four weightings. A document's or query's vector is that of the same id;
    the style prediction is half of the query's own z."""
    d, q = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    both = d.select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), "text").unionByName(q.select(F.lit("q").alias("kind"), F.col("item_id").alias("id"), "text"))
    f = written(style.style_features(both, "text", ("kind", "id", "text"), LATIN), "features")
    z = style.z_scores(f, style.fit_reference(f.where("kind = 'd'")))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rows = written(z.join(v, "id", "left"), "vectors")
    docs, asked = rows.where("kind = 'd'").drop("kind"), rows.where("kind = 'q'").select(F.col("id").alias("query_id"), "text", F.col("v").alias("q"), "z")
    out = retrieval_plan.hybrid_search(docs, asked, lambda z: F.transform(z, lambda x: 0.5 * x))
    told = F.array_join(F.transform(F.array_sort(F.map_entries("sources")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return out.select("config", "query_id", "id", "rank", "score", told.alias("sources"))


# The loop.


def settings() -> loop.Settings:
    return loop.Settings(most=3, form="system", echo_guard=True, system="s")


def made_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loop over all labelled ids with a generator, verifier and scorer that derive their answers from id and round.

    An answer is blank for one in eight; it names missing entity e1 or title t1 -> t2 by id; a third of them copy the
    feedback's lead or a quoted fragment, which the guard cuts.
    """
    requests = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("input "), F.col("doc_id").cast("string")).alias("input"), F.expr("cast(array() as array<struct<id:string,plain:string,styled:string>>)").alias("exemplars"))

    def generate(df: DataFrame) -> DataFrame:
        key = [F.col("id").cast("string"), (F.col("iter") + 1).cast("string")]
        body = F.concat(F.lit("answer "), key[0], F.lit(" "), key[1])
        echo = pick(3, *key, F.lit("echo"))
        tail = F.when(echo == 0, F.concat(F.lit("\n"), F.lit(agent.LEADS["system"]), F.lit("\n- x"))).when(echo == 1, F.lit("\n要求：\n请写回「e1」。")).otherwise(F.lit(""))
        failed = pick(40, *key, F.lit("error")) == 0
        return df.withColumn("text", F.when(failed, F.lit(None).cast("string")).when(pick(8, *key, F.lit("blank")) == 0, F.lit(" \n")).otherwise(F.concat(body, tail))).withColumn("error", F.when(failed, "Timeout"))

    def verify(df: DataFrame) -> DataFrame:
        key = [F.col("id").cast("string"), (F.col("iter") + 1).cast("string")]
        one = F.struct(F.lit("entity_missing").alias("kind"), F.lit("e1").alias("expected"), F.lit(None).cast("string").alias("actual"))
        two = F.struct(F.lit("title").alias("kind"), F.lit("t1").alias("expected"), F.lit("t2").alias("actual"))
        k = pick(4, *key, F.lit("verify"))
        none = F.expr(f"cast(array() as array<{agent.VIOLATION}>)")
        return df.withColumn("violations", F.when(k == 0, F.array(one)).when(k == 1, F.array(one, two)).when(k == 2, F.array(two)).otherwise(none))

    def score(df: DataFrame) -> DataFrame:
        return df.withColumn("score", -(pick(100, F.col("id").cast("string"), (F.col("iter") + 1).cast("string"), F.lit("score")) / 100.0))

    return loop.run(requests, generate, verify, score, settings())


#: A round's own answers, whatever came before, then the rounds that are reached: none after a failure or a clean version.
LOOP_CTE = f"""lr AS (SELECT doc_id AS id, r, {pick_sql(40, 'doc_id', 'r', "'error'")} = 0 AS failed, {pick_sql(8, 'doc_id', 'r', "'blank'")} = 0 AS blank, {pick_sql(4, 'doc_id', 'r', "'verify'")} AS k, {pick_sql(3, 'doc_id', 'r', "'echo'")} AS echo, -({pick_sql(100, 'doc_id', 'r', "'score'")} / 100.0::DOUBLE) AS s FROM labels, range(1, 4) t(r)),
  ls AS (SELECT *, CASE WHEN failed OR blank THEN 0 ELSE [1, 2, 1, 0][k + 1] END AS v, failed OR (NOT blank AND k = 3) AS stops FROM lr),
  lt AS (SELECT *, coalesce(bool_or(stops) OVER (PARTITION BY id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM ls),
  lp AS (SELECT *, coalesce(lag(CASE WHEN blank THEN 0 ELSE k + 1 END) OVER (PARTITION BY id ORDER BY r), 0) AS pk FROM lt WHERE NOT over),
  lo AS (SELECT *, CASE WHEN blank THEN 1.0 * 0 ELSE s END AS sc, (pk IN (1, 2)) AS sees FROM lp),
  lg AS (SELECT id, max(r) AS total_rounds, bool_or(failed) AS failed, max(r) FILTER (failed) AS failed_at, arg_min(r, v * 1000000 - CAST(round(sc * 100) AS INTEGER) * 10 + r) FILTER (NOT failed AND NOT blank) AS best, arg_max(CASE WHEN failed THEN NULL ELSE v END, r) AS lastv FROM lo GROUP BY 1)"""


@query(f"""WITH {LOOP_CTE}, x AS (SELECT *, CASE WHEN failed_at = 1 THEN NULL ELSE best END AS sel FROM lg)
SELECT x.id, CASE WHEN sel IS NULL THEN 'input ' || x.id ELSE 'answer ' || x.id || ' ' || sel || CASE WHEN o.echo = 1 AND NOT o.sees THEN chr(10) || '要求：' || chr(10) || '请写回「e1」。' ELSE '' END END AS output, CAST(sel AS INTEGER) AS selected_round, CAST(total_rounds AS INTEGER) AS total_rounds,
  CASE WHEN failed_at = 1 THEN 'first_round_error' WHEN sel IS NULL THEN 'all_blank' WHEN x.failed THEN 'later_round_error' END AS fallback_kind,
  CASE WHEN x.failed OR sel IS NULL THEN 'fallback' WHEN total_rounds = 3 AND lastv > 0 THEN 'max_rounds' ELSE 'accepted' END AS termination
FROM x LEFT JOIN lo o ON o.id = x.id AND o.r = x.sel""")
def g11_loop_results(spark, sf_dir):
    """The unrolled loop: outputs, the round kept, the rounds run and how it ended."""
    return made_loops(spark, sf_dir).select("id", "output", "selected_round", "total_rounds", "fallback_kind", "termination")


LOOP_RESULT = f"""{LOOP_CTE}, res AS (SELECT id, total_rounds, CASE WHEN failed_at = 1 THEN NULL ELSE best END AS sel, CASE WHEN failed OR best IS NULL THEN 'fallback' WHEN total_rounds = 3 AND lastv > 0 THEN 'max_rounds' ELSE 'accepted' END AS termination FROM lg)"""


@query(f"""WITH {LOOP_RESULT}, b AS (SELECT * FROM (VALUES ('total_rounds', '1'), ('total_rounds', '2'), ('total_rounds', '3'), ('selected_round', '1'), ('selected_round', '2'), ('selected_round', '3'), ('selected_round', 'none'), ('termination', 'accepted'), ('termination', 'max_rounds'), ('termination', 'recursion_limit'), ('termination', 'fallback')) t(what, bucket)),
  c AS (SELECT 'total_rounds' AS what, total_rounds::VARCHAR AS bucket FROM res UNION ALL SELECT 'selected_round', coalesce(sel::VARCHAR, 'none') FROM res UNION ALL SELECT 'termination', termination FROM res)
SELECT b.what, b.bucket, count(c.what) AS n FROM b LEFT JOIN c USING (what, bucket) GROUP BY 1, 2""")
def a13_round_distribution(spark, sf_dir):
    return experiments.round_distribution(made_loops(spark, sf_dir))


@query(f"""WITH {LOOP_RESULT}, vk AS (SELECT id, r, NOT failed AND NOT blank AND k IN (0, 1) AS e, NOT failed AND NOT blank AND k IN (1, 2) AS t FROM lo), w AS (SELECT res.id, coalesce(f.e, false) AS fe, coalesce(f.t, false) AS ft, coalesce(l.e, false) AS le, coalesce(l.t, false) AS lt FROM res LEFT JOIN vk f ON f.id = res.id AND f.r = 1 LEFT JOIN vk l ON l.id = res.id AND l.r = res.sel),
  y AS (SELECT 'entity_missing' AS kind, fe AS f, le AS l FROM w UNION ALL SELECT 'title', ft, lt FROM w UNION ALL SELECT 'numeral_missing', false, false FROM w UNION ALL SELECT 'entity_hallucination', false, false FROM w)
SELECT kind, count(*) FILTER (f) AS first, count(*) FILTER (l) AS final, count(*) FILTER (f AND NOT l) AS fixed, count(*) FILTER (l AND NOT f) AS introduced, count(*) FILTER (f) AS first_cases, count(*) FILTER (l) AS final_cases FROM y GROUP BY 1""")
def a14_violation_transitions(spark, sf_dir):
    return experiments.violation_transitions(made_loops(spark, sf_dir))


@query(f"""WITH {LOOP_RESULT} SELECT (SELECT count(*) FROM lo WHERE r = 1 AND v > 0) AS first_round_violation_cases, (SELECT count(*) FROM lo WHERE NOT failed AND NOT blank AND (echo = 0 OR (echo = 1 AND sees))) AS echo_stripped_rounds""")
def a15_loop_counters(spark, sf_dir):
    return experiments.loop_counters(made_loops(spark, sf_dir))


@query(f"""WITH {LOOP_RESULT}, e AS (SELECT lo.id, r, NOT failed AND NOT blank AND echo = 1 AND NOT sees AND coalesce(bool_or(NOT failed AND NOT blank AND k IN (0, 1)) OVER (PARTITION BY lo.id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS echoed, row_number() OVER (PARTITION BY lo.id ORDER BY r) AS place, sel FROM lo JOIN res USING (id) WHERE NOT failed)
SELECT count(*) FILTER (echoed AND sel = r) AS final_cases, count(*) FILTER (echoed) AS revision_rounds, count(*) AS revision_rounds_total, count(*) FILTER (echoed AND place = 2) AS second_round, count(*) FILTER (place = 2) AS second_round_total FROM e WHERE place > 1""")
def a16_feedback_echo(spark, sf_dir):
    """Later rounds that still repeat feedback after the guard: a fragment of an earlier round than the last."""
    return experiments.feedback_echo(made_loops(spark, sf_dir))


@query(f"""WITH l AS (SELECT doc_id, {pick_sql(6, 'doc_id')} AS k FROM labels) SELECT doc_id, CASE k WHEN 0 THEN '输入里的「甲」在上一版里不见了，请写回去。' WHEN 1 THEN '输入里的数值「三斤」必须保留且数值不变，请用中文数字书写，不要改成阿拉伯数字。' WHEN 2 THEN '上一版里多出了输入中没有的「乙」，请去掉。' WHEN 3 THEN '输入里的称谓「丞相」被改成了「太监」，请改回「丞相」。' WHEN 4 THEN '输入里的称谓「丞相」在上一版里不见了，请写回去。' ELSE '输入里的「甲」在上一版里不见了，请写回去。' END AS first,
  '改写时必须满足下列要求：' || chr(10) || CASE k WHEN 5 THEN '- 输入里的「甲」在上一版里不见了，请写回去。' || chr(10) || '- 上一版里多出了输入中没有的「乙」，请去掉。' ELSE '- ' || CASE k WHEN 0 THEN '输入里的「甲」在上一版里不见了，请写回去。' WHEN 1 THEN '输入里的数值「三斤」必须保留且数值不变，请用中文数字书写，不要改成阿拉伯数字。' WHEN 2 THEN '上一版里多出了输入中没有的「乙」，请去掉。' WHEN 3 THEN '输入里的称谓「丞相」被改成了「太监」，请改回「丞相」。' ELSE '输入里的称谓「丞相」在上一版里不见了，请写回去。' END END AS feedback FROM l""")
def g03_feedback(spark, sf_dir):
    """Sentences of violations chosen by id, and the feedback in its order, repeats told once."""
    t = "cast(null as string)"

    def v(kind: str, e: str | None, a: str | None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (F.lit(e) if e else F.expr(t)).alias("expected"), (F.lit(a) if a else F.expr(t)).alias("actual"))

    known = [[v("entity_missing", "甲", None)], [v("numeral_missing", "三斤", None)], [v("entity_hallucination", None, "乙")], [v("title", "丞相", "太监")], [v("title", "丞相", None)], [v("entity_hallucination", None, "乙"), v("entity_missing", "甲", None), v("entity_missing", "甲", None)]]
    chosen = F.get(F.array(*[F.array(*x) for x in known]), pick(6, "doc_id").cast("int"))
    rows = table(spark, sf_dir, "labels").select("doc_id", chosen.alias("v"))
    return rows.select("doc_id", agent.sentence(agent.feedback_order(F.col("v"))[0]).alias("first"), agent.feedback(F.col("v"), agent.LEADS["system"]).alias("feedback"))


@query("""WITH l AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'followup' WHEN 1 THEN 'restate' ELSE 'system' END AS form, 'text ' || doc_id AS t, '- 输入里的「甲」在上一版里不见了，请写回去。' AS line FROM labels)
SELECT doc_id, CAST(CASE form WHEN 'followup' THEN 4 ELSE 2 END AS INTEGER) AS n, CASE form WHEN 'followup' THEN 's' WHEN 'restate' THEN 's' ELSE 's' || chr(10) || chr(10) || '改写时必须满足下列要求：' || chr(10) || line END AS first, CASE form WHEN 'followup' THEN '上一版存在以下问题，请按条修正后重写，其余部分尽量保留：' || chr(10) || line WHEN 'restate' THEN t || chr(10) || chr(10) || '请按下列要求改写这段输入，其余内容尽量保留：' || chr(10) || line ELSE t END AS last FROM l""")
def g04_revision_messages(spark, sf_dir):
    """The messages of a later round in each format."""
    v = F.array(F.struct(F.lit("entity_missing").alias("kind"), F.lit("甲").alias("expected"), F.lit(None).cast("string").alias("actual")))
    t = F.concat(F.lit("text "), F.col("doc_id").cast("string"))
    base = agent.prompt(F.lit("s"), F.expr("cast(array() as array<struct<plain:string,styled:string>>)"), t)
    made = {form: agent.revision(base, t, F.lit("before"), v, form) for form in agent.LEADS}
    m = F.when(F.col("doc_id") % 3 == 0, made["followup"]).when(F.col("doc_id") % 3 == 1, made["restate"]).otherwise(made["system"])
    rows = table(spark, sf_dir, "labels").select("doc_id", m.alias("m"))
    return rows.select("doc_id", F.size("m").alias("n"), F.col("m")[0]["content"].alias("first"), F.element_at("m", -1)["content"].alias("last"))


@query("""WITH l AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'plain' WHEN 1 THEN 'kept  ' || chr(10) || '改写时必须满足下列要求：x' WHEN 2 THEN 'kept' || chr(10) || '请改：' || chr(10) || 'fix「甲」now' ELSE 'kept' || chr(10) || 'line' || chr(10) || 'fix「甲」now' END AS t, CASE doc_id % 4 WHEN 0 THEN 'plain' WHEN 3 THEN 'kept' || chr(10) || 'line' ELSE 'kept' END AS kept FROM labels)
SELECT doc_id, kept, CAST(length(t) - length(kept) AS INTEGER) AS removed FROM l""")
def g05_echo_guard(spark, sf_dir):
    """Feedback copied into an output is cut with its reworded lead."""
    lead = agent.LEADS["system"]
    k = F.col("doc_id") % 4
    t = F.when(k == 0, "plain").when(k == 1, f"kept  \n{lead}x").when(k == 2, "kept\n请改：\nfix「甲」now").otherwise("kept\nline\nfix「甲」now")
    v = F.array(F.struct(F.lit("entity_missing").alias("kind"), F.lit("甲").alias("expected"), F.lit(None).cast("string").alias("actual")))
    return table(spark, sf_dir, "labels").select("doc_id", agent.cut_echo(t, v).alias("c")).select("doc_id", "c.kept", "c.removed")


@query("""WITH l AS (SELECT doc_id, range(1, 1 + doc_id % 4) AS rs FROM labels), r AS (SELECT doc_id, unnest(rs) AS r FROM l), s AS (SELECT doc_id, r, (doc_id + r) % 3 AS v, ((doc_id * 7 + r) % 10) AS s, (doc_id + r) % 5 = 0 AS blank FROM r)
SELECT l.doc_id, CAST((SELECT arg_min(r, v * 1000 - s * 10 + r) FROM s WHERE s.doc_id = l.doc_id AND NOT blank) AS INTEGER) AS best, CASE WHEN doc_id % 11 = 0 THEN 'recursion_limit' WHEN doc_id % 7 = 0 THEN 'fallback' WHEN doc_id % 5 = 0 THEN 'max_rounds' ELSE 'accepted' END AS termination FROM l""")
def w11_best_round(spark, sf_dir):
    """The round kept of rounds derived from ids, and how a loop ended."""
    d = F.col("doc_id")

    def one(r: Column) -> Column:
        out = F.when((d + r) % 5 == 0, F.lit(" ")).otherwise(F.lit("x"))
        return F.struct(r.cast("int").alias("round"), out.alias("output"), ((d + r) % 3).cast("int").alias("violations"), ((d * 7 + r) % 10).cast("double").alias("score"))

    rounds = F.when(d % 4 > 0, F.transform(F.sequence(F.lit(1).cast("long"), d % 4), one)).otherwise(F.array().cast("array<struct<round:int,output:string,violations:int,score:double>>"))
    return table(spark, sf_dir, "labels").select("doc_id", agent.best_round(rounds).alias("best"), agent.termination(d % 11 == 0, d % 7 == 0, d % 5 == 0).alias("termination"))


@query(f"""WITH t AS (SELECT conv_id, turn, text, coalesce(length(text), 0) AS n, {pick_sql(9, 'conv_id', 'turn')} = 0 AS failed FROM conversations), p AS (SELECT conv_id, turn, 1 + i AS seq, 'token' AS event, '{{"round":1,"text":' || to_json(substr(text, i * 24 + 1, 24)) || '}}' AS data FROM (SELECT conv_id, turn, text, unnest(range(0, CAST(ceil(n / 24.0) AS BIGINT))) AS i FROM t WHERE n > 0)),
  e AS (SELECT conv_id, turn, 0 AS seq, 'trace' AS event, 'n' AS data FROM t UNION ALL SELECT * FROM p UNION ALL SELECT conv_id, turn, 1 + CAST(ceil(n / 24.0) AS BIGINT), CASE WHEN failed THEN 'error' ELSE 'done' END, CASE WHEN failed THEN '{{"error":"generation failed"}}' ELSE '{{"output_sha256":"' || sha256(text) || '"}}' END FROM t)
SELECT conv_id || '-' || turn AS id, CAST(seq AS INTEGER) AS seq, event, data FROM e""")
def r01_service_events(spark, sf_dir):
    """Every event of finished requests: trace, pieces of each round, done or error."""
    c = table(spark, sf_dir, "conversations")
    rows = c.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.array(F.lit("n")).alias("trace"), F.array(F.struct(F.lit(1).alias("round"), F.col("text").alias("output"))).alias("rounds"), F.col("text").alias("output"), F.when(pick(9, "conv_id", "turn") == 0, "Timeout").alias("error")
    )
    return agent.service_events(rows, "id")


@query("SELECT CASE WHEN lang = 'en' THEN 'a' ELSE 'b' END AS arm, count(*) AS n, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS std, quantile_cont(n_chars::DOUBLE, 0.5) AS median, quantile_cont(n_chars::DOUBLE, 0.25) AS q1, quantile_cont(n_chars::DOUBLE, 0.75) AS q3, min(n_chars) AS min, max(n_chars) AS max FROM documents GROUP BY 1")
def a17_token_spread(spark, sf_dir):
    """The spread of token counts (characters stand for tokens) of two arms."""
    rows = table(spark, sf_dir, "documents").select(F.when(F.col("lang") == "en", "a").otherwise("b").alias("arm"), "n_chars")
    return rounded(experiments.token_spread(rows, "n_chars", ["arm"]), "arm", "n", "min", "max")


@query()
def a19_exact_bootstrap(spark, sf_dir):
    """The standard generator's 10,000 resamples of paired differences; no SQL has its numbers, tests do."""
    return rounded(stats.bootstrap_exact(paired_differences(spark, sf_dir).withColumn("work", F.col("work").cast("string")), "diff", "work", "pair_id"), "work")


@query()
def a24_ablation(spark, sf_dir):
    """Five ways to pick exemplars for a stated set of cases (every twentieth vector): mean gaps by label and overall."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("work"), F.slice("embedding", 1, 4).cast("array<double>").alias("x"), F.slice("embedding", 5, 4).cast("array<double>").alias("y"), (F.col("vec_id") % 3).cast("int").alias("fold"))
    cases = e.where("id % 20 = 0").withColumnRenamed("id", "case_id")
    return rounded(experiments.ablation_summary(experiments.ablation(e, cases, 4)), "arm", "k", "work", "is_total", "n")


@query()
def a27_scorer_audit(spark, sf_dir):
    """Two online scores against the truth, for three versions of every vector."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    part = lambda a: F.slice("v", a, 8)
    versions = e.select("id", F.explode(F.array(*[F.struct(F.lit(n).alias("label"), part(1 + 8 * i).alias("z")) for i, n in enumerate(("vernacular", "base", "lora"))])).alias("x"), part(25).alias("original_z"), part(33).alias("predicted_z"))
    return rounded(experiments.scorer_audit(versions.select("id", "x.label", "x.z", "original_z", "predicted_z")), "candidate", "label")


@query()
def a31_diagnostics(spark, sf_dir):
    """What outputs copy from two exemplars of the same work; the sequence matcher has no SQL form."""
    cases = eval_cases(spark, sf_dir)
    shown = cases.select(F.lit("g").alias("grp"), "id", F.array(F.struct(F.lit("e").alias("id"), F.col("vernacular").alias("plain"), F.col("original").alias("styled"))).alias("exemplars"))
    out = evaluation.diagnostics(cases.select(F.lit("g").alias("grp"), "id", "output"), shown, DIMS, cases)
    return rounded(out, "id", "grp")
