"""Queries of the training-data operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, langid, linededup, mips, mixing, neardup, negatives, packing, pii, repair, suffix, tokencount, toxicity
from .common import documents

WORD_VOCABULARY, BYTE_VOCABULARY, PIECE_VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=20, query_every=20)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(documents(spark, sf_dir)))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary(WORD_VOCABULARY))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir), vocabulary(PIECE_VOCABULARY))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_lines(documents(spark, sf_dir).select("doc_id", "text"), count=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), k=3, percent=85)


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mips.top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=10, query_every=100, scale=1024)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.mix(documents(spark, sf_dir), labels)[0]


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.drop_repeats(documents(spark, sf_dir), window=400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared", (F.col("n_shared") > 0).alias("has_shared"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(documents(spark, sf_dir), vocabulary(BYTE_VOCABULARY), limit=512)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), positives=5, negatives=5, anchor_every=100, scale=256, percent=80, label=label)


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"), damage=True)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_ann,
        op2_pii,
        op3_packing,
        op4_language,
        op5_line_dedup,
        op6_near_dedup,
        op7_exact_topk,
        op8_mixing,
        op9_toxicity,
        op10_suffix_dedup,
        op11_token_counts,
        op12_hard_negatives,
        op13_repair,
        pipeline,
    )
}

#: A full inner product of each query with every other row, in integers.
OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, p.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, p.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v p ON q.vec_id % 100 = 0 AND q.vec_id <> p.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

#: Documents' sets of shingles, classes of equal sets, links by counts of common shingles, and the least document reachable.
OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM w
), g AS (
  SELECT s, min(doc_id) AS rep, len(s) AS n FROM s WHERE len(s) > 0 AND doc_id IS NOT NULL GROUP BY s
), x AS (
  SELECT rep, n, unnest(s) AS h FROM g
), p AS (
  SELECT a.rep AS a, b.rep AS b
  FROM x a JOIN x b ON a.h = b.h AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), e AS (
  SELECT a AS u, b AS v FROM p UNION SELECT b, a FROM p
), r(u, c) AS (
  SELECT u, u FROM e UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.u WHERE r.c < e.v
), c AS (
  SELECT u AS rep, min(c) AS comp FROM r GROUP BY 1
), d AS (
  SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(least(c.comp, g.rep), s.doc_id) AS component_id
  FROM s LEFT JOIN g ON s.s = g.s AND s.doc_id IS NOT NULL LEFT JOIN c ON c.rep = g.rep
)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM d
"""



def repair_sql() -> str:
    """The damage, the faults and a fold over each conversation's rows that holds the best repair by the last retained role.

    Every state is a struct of cost, audit and text, compared in that order; the text follows from the audit.
    """
    say = {"u": "chr(10) || 'user:'", "a": "chr(10) || 'assistant:'"}
    between = {"s": {"e": ""}, "u": {"e": "", "s": "", "u": "a", "a": ""}, "a": {"e": "u", "s": "u", "u": "", "a": "u"}}
    new = {"e": "{'c': r.e.c + 2, 'a': r.e.a || 'D', 't': r.e.t}"}
    for out, gaps in between.items():
        options = [f"{{'c': r.{out}.c + 2, 'a': r.{out}.a || 'D', 't': r.{out}.t}}"]
        for state, more in gaps.items():
            fill = "".join(f" || {say[x]}" for x in more)
            keep = f"x.fault NOT IN ('b', 'd') AND x.initial = '{out}'"
            options.append(f"{{'c': CASE WHEN {keep} THEN r.{state}.c + {5 * len(more)} + x.extra END, 'a': r.{state}.a || '{'I' * len(more)}K', 't': r.{state}.t{fill} || chr(10) || x.role || ':' || x.text}}")
            if out != "s":
                reroll = f"x.fault NOT IN ('b', 'd') AND x.initial <> '{out}'"
                options.append(f"{{'c': CASE WHEN {reroll} THEN r.{state}.c + {5 * len(more) + 1} + x.extra END, 'a': r.{state}.a || '{'I' * len(more)}R', 't': r.{state}.t{fill} || {say[out]} || x.text}}")
        new[out] = f"list_sort(list_filter([{', '.join(options)}], lambda z: z.c IS NOT NULL))[1]"
    none = "{'c': CAST(NULL AS BIGINT), 'a': '', 't': ''}"
    bits = "list_reduce(list_prepend(xor(h, b), range(8)), lambda c, i: xor(c >> 1, (c & 1) * 3988292384))"
    return rf"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations
), k AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda z: CAST(ascii(z) AS BIGINT))),
                            lambda h, b: {bits}), 4294967295) % 20 AS kind
  FROM o
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM k WHERE kind <> 0
), n AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS previous
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), sha256(text), copy)
), f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                 WHEN regexp_matches(text, '[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault
  FROM n
), x AS (
  SELECT *, CASE WHEN fault = 't' THEN 5 ELSE 0 END AS extra FROM f
), r AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS e, {none} AS s, {none} AS u, {none} AS a FROM o
  UNION ALL
  SELECT r.conv_id, x.i, {new['e']}, {new['s']}, {new['u']}, {new['a']}
  FROM r JOIN x ON x.conv_id IS NOT DISTINCT FROM r.conv_id AND x.i = r.i + 1
), z AS (
  SELECT conv_id, list_sort(list_filter([e, a, {{'c': u.c + 5, 'a': u.a || 'I', 't': u.t || {say['a']}}},
                                         {{'c': s.c + 10, 'a': s.a || 'II', 't': s.t || {say['u']} || {say['a']}}}], lambda z: z.c IS NOT NULL))[1] AS best
  FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM x GROUP BY 1
)
SELECT z.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, best.c AS cost, best.a AS audit,
       sha256(substr(best.t, 2)) AS repaired_sha256
FROM z LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM z.conv_id
"""


#: Every anchor's inner product with every other row; the first of its label, then the first of other labels in each window.
OP12_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS anchor_id, q.label AS anchor_label, p.vec_id, p.label,
         CAST(list_sum(list_transform(list_zip(q.v, p.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v p ON q.vec_id % 100 = 0 AND q.vec_id <> p.vec_id AND len(q.v) = len(p.v)
), p AS (
  SELECT * FROM s WHERE label = anchor_label QUALIFY row_number() OVER (PARTITION BY anchor_id, anchor_label ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.anchor_label, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND n.anchor_label = p.anchor_label AND n.label <> n.anchor_label
  AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5
"""


ORACLES: dict[str, str] = {"op6_near_dedup": OP6_SQL, "op7_exact_topk": OP7_SQL, "op12_hard_negatives": OP12_SQL, "op13_repair": repair_sql()}
