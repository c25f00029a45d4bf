"""Queries of fits, audits, bundles and resumed runs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import _ORDERS, GRAM_CTE, ORACLES, PAIRS_SQL, pairs, query, rounded, table
from .catalog_fidelity import folder
from .functions import fidelity
from .functions.text import LATIN
from .operators import gates, sampling, stats
from .plans import experiments
from .sources.tables import written
from .streaming import jobs

ALPHAS = (0.01, 1.0, 100.0)
_FIT = """(SELECT {g}, alpha, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, count(*) * var_pop(x1) + any_value(alpha) AS a, count(*) * covar_pop(x1, x2) AS b, count(*) * var_pop(x2) + any_value(alpha) AS d, count(*) * covar_pop(x1, y) AS p, count(*) * covar_pop(x2, y) AS q FROM {rows} GROUP BY ALL)"""
_COEF = "(d * p - b * q) / (a * d - b * b) AS b1, (a * q - b * p) / (a * d - b * b) AS b2"


@query(f"""WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS x2, embedding[3]::DOUBLE AS y, (row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) - 1) % 5 AS fold FROM embeddings),
al AS (SELECT unnest({list(ALPHAS)}::DOUBLE[]) AS alpha), o AS (SELECT DISTINCT fold AS held FROM e), tr AS (SELECT held, alpha, x1, x2, y FROM e, o, al WHERE e.fold <> o.held),
c AS (SELECT held, alpha, m1, m2, my, {_COEF} FROM {_FIT.format(g='held', rows='tr')}),
mse AS (SELECT alpha, avg(pow(my + b1 * (x1 - m1) + b2 * (x2 - m2) - y, 2)) AS mse FROM e JOIN c ON e.fold = c.held GROUP BY 1), best AS (SELECT alpha FROM mse ORDER BY mse, alpha LIMIT 1),
wa AS (SELECT e.*, alpha FROM e, best), f AS (SELECT alpha, m1, m2, my, {_COEF} FROM {_FIT.format(g="1 AS one", rows='wa')})
SELECT vec_id, round(my + b1 * (x1 - m1) + b2 * (x2 - m2), 6) AS predicted, alpha FROM e, f""")
def a22_ridge_alpha(spark, sf_dir):
    """Ridge from two embedding components to the third, its alpha chosen by the pooled error of rows out of their fold."""
    part = lambda a, n: F.transform(F.slice("embedding", a, n), lambda v: v.cast("double"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", part(1, 2).alias("x"), part(3, 1).alias("y"))
    e = sampling.folds(e, "vec_id", "label")
    alpha = stats.choose_alpha(e, "x", "y", "fold", (2, 1), list(ALPHAS))
    coef = stats.fit_ridge(e, "x", "y", (2, 1), alpha)
    return e.select("vec_id", F.round(stats.predict(F.col("x"), coef)[0], 6).alias("predicted"), F.lit(alpha).alias("alpha"))


_PART = "[x::DOUBLE for x in embedding[{}:{}]]"
_MEAN_GAP = "list_avg(list_transform(list_zip({a}, {b}), lambda p: abs(p[1] - p[2])))"
ORACLES["a27_scorer_audit"] = f"""WITH v AS (SELECT vec_id AS id, unnest(['vernacular', 'base', 'lora']) AS label, unnest([0, 1, 2]) AS place, unnest([{', '.join(_PART.format(1 + 8 * i, 8 + 8 * i) for i in range(3))}]) AS z, {_PART.format(25, 32)} AS o, {_PART.format(33, 40)} AS p FROM embeddings),
s AS (SELECT id, label, place, {_MEAN_GAP.format(a='z', b='o')} AS truth, abs(sqrt(list_sum(list_transform(z, lambda x: x * x))) / sqrt(8.0::DOUBLE) - 1) AS a, {_MEAN_GAP.format(a='z', b='p')} AS b FROM v),
l AS (SELECT id, label, place, truth, unnest(['A', 'B']) AS candidate, unnest([a, b]) AS g FROM s),
r AS (SELECT candidate, label, rank() OVER (PARTITION BY candidate, label ORDER BY g) + (count(*) OVER (PARTITION BY candidate, label, g) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY candidate, label ORDER BY truth) + (count(*) OVER (PARTITION BY candidate, label, truth) - 1) / 2.0::DOUBLE AS ry FROM l),
t AS (SELECT candidate, id, arg_min(label, {{'v': truth, 'p': place}}) AS t, arg_min(label, {{'v': g, 'p': place}}) AS g FROM l GROUP BY ALL)
SELECT candidate, label, round(corr(rx, ry), 6) AS spearman, CAST(NULL AS DOUBLE) AS pick_rate FROM r GROUP BY ALL
UNION ALL SELECT candidate, NULL, NULL, round(avg((t = g)::INT), 6) FROM t GROUP BY 1"""

_ENTITIES, _BANNED = ("eau", "ment", "ou"), ("que", "tion")


@query(f"""WITH {PAIRS_SQL}, {GRAM_CTE}, m AS (SELECT pair_id, out, list_filter({list(_ENTITIES)}, lambda x: NOT contains(out, x)) AS missing, list_filter({list(_BANNED)}, lambda x: contains(replace(replace(replace(out, 'ment', '#'), 'eau', '#'), 'ou', '#'), x)) AS residue FROM pairs)
SELECT m.pair_id, array_to_string(any_value(missing), '|') AS missing, round(1 - len(any_value(missing)) / 3.0::DOUBLE, 6) AS entity_recall, 3 AS entity_denominator, array_to_string(any_value(residue), '|') AS banned_residue,
  round(any_value(length(l.o)::DOUBLE / greatest(length(l.s), 1)), 6) AS length_ratio, round(max(pinc) FILTER (n = 4), 6) AS pinc4, round(max(pinc) FILTER (n = 6), 6) AS pinc6, round(max(overlap) FILTER (n = 6), 6) AS overlap6
FROM m JOIN l USING (pair_id) LEFT JOIN gr USING (pair_id) GROUP BY 1""")
def f48_measures(spark, sf_dir):
    """The bundle of entity, length, residue and gram measures of every pair."""
    words = lambda some: F.array(*[F.lit(w) for w in some])
    found = fidelity.measures(pairs(spark, sf_dir), "pair_id", "src", "out", words(_ENTITIES), words(_BANNED), LATIN)
    told = found.select("pair_id", F.array_join("missing_entities", "|").alias("missing"), "entity_recall", "entity_denominator", F.array_join("banned_residue", "|").alias("banned_residue"), "length_ratio", "pinc4", "pinc6", "overlap6")
    return rounded(told, "pair_id", "missing", "entity_denominator", "banned_residue")


@query("SELECT CAST(NULL AS VARCHAR) AS arm, CAST(NULL AS INTEGER) AS k, CAST(NULL AS VARCHAR) AS work WHERE false")
def p17_oracle_sanity(spark, sf_dir):
    """No arm of the ablation over the embeddings may be better than the oracle; the rows that are."""
    part = lambda a, n: F.slice("embedding", a, n).cast("array<double>")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("work"), part(1, 4).alias("x"), part(5, 4).alias("y"))
    e = written(sampling.folds(e, "id", "work"), "folded")  # read by each fit
    cases = e.where("id % 20 = 0").withColumnRenamed("id", "case_id")
    return experiments.oracle_violations(experiments.ablation_summary(experiments.ablation(e, cases, 4, ks=(1,)))).where("arm <> 'random' and k = 1")


@query("SELECT count(*) AS n FROM documents")
def p18_same_experiment(spark, sf_dir):
    """A replay of every document's prompt with the same ids, seeds and digests, in another order, passes the guard."""
    first = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.lit(42).alias("seed"))
    gates.require_same_experiment(first.repartition(3, "digest"), first, ("doc_id", "digest", "seed"))
    return first.agg(F.count("*").alias("n"))


@query("SELECT doc_id, length(coalesce(text, '')) AS n, CAST(doc_id % 2 AS INTEGER) AS run FROM documents WHERE doc_id IS NOT NULL")
def r03_resumed(spark, sf_dir):
    """A batch over files that come in two runs, the second of which does only what is new."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    source, sink, checkpoint = (folder(spark, x) for x in ("files", "results", "progress"))
    schema = T.StructType().add("doc_id", "long").add("text", "string")
    for run in (0, 1):
        docs.where(F.col("doc_id") % 2 == run).write.mode("append").json(source)
        work = lambda rows: rows.select("doc_id", F.length("text").cast("long").alias("n"), F.lit(run).alias("run"))  # noqa: B023, E731
        jobs.resumable(spark, source, schema, work, sink, checkpoint).awaitTermination()
    return jobs.results(spark, sink)
