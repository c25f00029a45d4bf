"""All registered queries of the style, fidelity and retrieval operators, and their SQL.

Both sides of a query are written to the same contract; real numbers are rounded
on both sides, and hash orders come from MD5, which both engines have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import style, surface, text
from .functions.text import LATIN
from .operators import agent, leak, lexicon, postings, products, retrieval, sampling, stats
from .sources.tables import written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, work, src, out: a user's turn and the assistant's answer to it."""
    c = table(spark, sf_dir, "conversations")
    u = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("src"))
    a = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("out"))
    pair_id = F.concat_ws("-", "conv_id", "turn")
    return u.join(a, ["conv_id", "turn"]).select(pair_id.alias("pair_id"), (F.col("conv_id") % 6).alias("work"), "src", "out")


PAIRS_SQL = """pairs AS (
  SELECT u.conv_id || '-' || a.turn AS pair_id, u.conv_id % 6 AS work, u.text AS src, a.text AS out
  FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'
)"""


def rounded(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    return df.select(*[c if c in keep else F.round(c, digits).alias(c) for c in df.columns])


def _count(chars: str) -> str:
    return f"length(regexp_replace(t, '[^{chars}]', '', 'g'))"


_P = r",.!?;:''\"()"
STYLE_TEMPLATE = rf"""s0 AS (@ROWS), s1 AS (
  SELECT *, CAST(length(t) AS DOUBLE) AS n,
    list_transform(list_filter(list_transform(string_split_regex(t, '[.!?;\n]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 2), lambda x: CAST(length(x) AS DOUBLE)) AS lens,
    regexp_extract_all(lower(t), '\p{{L}}+') AS w,
    CAST({_count(_P)} AS DOUBLE) AS marks,
    CAST({_count('IVX')} AS DOUBLE) AS native, CAST({_count('0-9')} AS DOUBLE) AS arabic
  FROM s0), style AS (
  SELECT @KEYS,
    coalesce(list_avg(lens), 0) AS sent_len_mean, coalesce(list_stddev_pop(lens), 0) AS sent_len_std, coalesce(list_aggregate(lens, 'quantile_cont', 0.9), 0) AS sent_len_p90,
    CASE WHEN marks > 0 THEN {_count(',')} / marks ELSE 0 END AS comma_ratio, CASE WHEN marks > 0 THEN {_count('.')} / marks ELSE 0 END AS period_ratio,
    CASE WHEN n > 0 THEN 100 * {_count("''" + chr(34))} / n ELSE 0 END AS quote_density, CASE WHEN n > 0 THEN 100 * {_count('sqk')} / n ELSE 0 END AS dialogue_verb_density,
    CASE WHEN n > 0 THEN 100 * len(regexp_extract_all(t, 'like|as if|than')) / n ELSE 0 END AS simile_density,
    {', '.join(f"CASE WHEN n > 0 THEN 100 * ((n - length(replace(t, '{w}', ''))) / {len(w)}) / n ELSE 0 END AS fw_{i}" for i, w in enumerate(LATIN.function_words, 1))},
    CASE WHEN len(w) > 0 THEN CAST(len(list_distinct(w)) AS DOUBLE) / len(w) ELSE 0 END AS ttr, coalesce(list_avg(list_transform(w, lambda x: CAST(length(x) AS DOUBLE))), 0) AS avg_word_len,
    CAST(0 AS DOUBLE) AS literary_hit, CASE WHEN native + arabic > 0 THEN native / (native + arabic) ELSE 0 END AS cjk_numeral_ratio,
    CASE WHEN n > 0 THEN 100 * CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '')) AS DOUBLE) / n ELSE 0 END AS para_density
  FROM s1)"""


def style_cte(rows: str, keys: str) -> str:
    """CTEs up to style: the keys and the features of rows with a text t."""
    return STYLE_TEMPLATE.replace("@ROWS", rows).replace("@KEYS", keys)


STYLE_CTE = style_cte("SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents", "doc_id, source, lang")
_ALL = ", ".join(f"round({c}, 6) AS {c}" for c in style.NAMES)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style.style_features(table(spark, sf_dir, "documents"), keep=("doc_id", "source", "lang"), profile=LATIN)


@query(f"WITH {STYLE_CTE} SELECT doc_id, {_ALL} FROM style")
def f20_style_features(spark, sf_dir):
    return rounded(features(spark, sf_dir).drop("source", "lang"), "doc_id")


REFERENCE_SQL = ", ".join(f"avg({c}) AS mean_{c}, greatest(stddev_pop({c}), 1e-6) AS std_{c}" for c in style.NAMES)


@query(f"WITH {STYLE_CTE}, r AS (SELECT {REFERENCE_SQL}, count(*) AS n_texts FROM style) SELECT {', '.join(f'round(mean_{c}, 6) AS mean_{c}, round(std_{c}, 6) AS std_{c}' for c in style.NAMES)}, n_texts FROM r")
def a05_reference_fit(spark, sf_dir):
    return rounded(style.fit_reference(features(spark, sf_dir)), "n_texts")


_Z = ", ".join(f"({c} - mean_{c}) / std_{c}" for c in style.NAMES)
Z_CTE = f"{STYLE_CTE}, r AS (SELECT {REFERENCE_SQL} FROM style), zs AS (SELECT doc_id, source, [{_Z}] AS z FROM style, r)"


def z_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The z vectors of all documents; the features are written, since the reference and the vectors both read them."""
    f = written(features(spark, sf_dir), "features")
    return style.z_scores(f, style.fit_reference(f))


@query(f"WITH {Z_CTE} SELECT doc_id, round(sqrt(list_sum(list_transform(z, lambda x: x * x))) / sqrt(20.0::DOUBLE), 6) AS style_distance FROM zs")
def f28_style_distance(spark, sf_dir):
    return z_table(spark, sf_dir).select("doc_id", F.round(style.distance(F.col("z")), 6).alias("style_distance"))


@query(f"WITH {Z_CTE}, l AS (SELECT source, unnest(z) AS x, unnest(range(20)) AS d FROM zs), m AS (SELECT source, d, avg(x) AS m FROM l GROUP BY ALL) SELECT source, round(avg(abs(m)), 6) AS profile_gap FROM m GROUP BY source")
def a06_profile_gap(spark, sf_dir):
    return rounded(style.set_gap(z_table(spark, sf_dir), "z", ["source"]), "source")


_GRAMS = "CASE WHEN length({0}) >= {1} THEN list_transform(range(1, length({0}) - {1} + 2), lambda i: substr({0}, i, {1})) ELSE [] END"
TOKENS_SQL = r"regexp_extract_all(lower(coalesce({0}, '')), '\p{{L}}+')"


@query(f"""WITH o AS (SELECT unnest({TOKENS_SQL.format('text')}) AS token FROM documents WHERE lang = 'en'), v AS (SELECT unnest({TOKENS_SQL.format('text')}) AS token FROM documents WHERE lang <> 'en'),
  b AS (SELECT token, coalesce(o.n, 0) AS o, coalesce(v.n, 0) AS v FROM (SELECT token, count(*) AS n FROM o GROUP BY 1) o FULL JOIN (SELECT token, count(*) AS n FROM v GROUP BY 1) v USING (token)),
  s AS (SELECT *, ln((o + 1)::DOUBLE / (v + 1)) AS score FROM b)
SELECT token, CASE WHEN score > 0 THEN 'literary' ELSE 'colloquial' END AS side, round(score, 6) AS score FROM s WHERE (score > 1 AND o >= 3) OR (score < -1 AND v >= 3)""")
def a08_log_odds_lexicon(spark, sf_dir):
    """English texts stand for the styled side, the others for the plain one."""
    d = table(spark, sf_dir, "documents")
    return rounded(lexicon.log_odds_lexicon(lexicon.token_counts(d.where("lang = 'en'"), "text", LATIN), lexicon.token_counts(d.where("lang <> 'en'"), "text", LATIN)), "token", "side")


@query(f"WITH w AS (SELECT doc_id, unnest(list_distinct({TOKENS_SQL.format('text')})) AS word FROM documents) SELECT word, count(DISTINCT doc_id) AS texts FROM w WHERE length(word) >= 2 GROUP BY word HAVING count(DISTINCT doc_id) >= 3")
def a09_gazetteer(spark, sf_dir):
    return lexicon.gazetteer(table(spark, sf_dir, "documents"), "doc_id", "text", profile=LATIN)


@query(f"""WITH w AS (SELECT lang, unnest({TOKENS_SQL.format('text')}) AS term FROM documents), c AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(*) >= 2),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, term COLLATE "C") AS INTEGER) AS place FROM c) SELECT lang, term, n, place FROM r WHERE place <= 60""".replace(' COLLATE "C"', ""))
def a29_top_terms(spark, sf_dir):
    return lexicon.top_terms(table(spark, sf_dir, "documents"), "lang", "text", profile=LATIN)


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


BM25_CTE = f"""d AS (SELECT doc_id AS id, {TOKENS_SQL.format('text')} AS w FROM documents), tot AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
  tf AS (SELECT id, dl, token, count(*) AS f FROM (SELECT id, len(w) AS dl, unnest(w) AS token FROM d) GROUP BY ALL), dfs AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
  raw AS (SELECT token, avgdl, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM dfs, tot),
  idf AS (SELECT token, avgdl, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
  q AS (SELECT query_id, token, count(*) AS times FROM (SELECT item_id AS query_id, unnest({TOKENS_SQL.format('text')}) AS token FROM benchmark) GROUP BY ALL),
  bm AS (SELECT query_id, id, round(sum(times * idf * f * 2.5::DOUBLE / (f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score FROM q JOIN idf USING (token) JOIN tf USING (token) GROUP BY ALL),
  bmr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM bm WHERE score > 0)"""


def bm25_route(spark, sf_dir, k):
    return postings.search(postings.index(_docs(spark, sf_dir)), _asked(spark, sf_dir), k)[0]


@query(f"WITH {BM25_CTE} SELECT query_id, id, rank, round(score, 6) AS score FROM bmr WHERE rank <= 10")
def m03_bm25(spark, sf_dir):
    return rounded(bm25_route(spark, sf_dir, 10), "query_id", "id", "rank")


CENTRES_SQL = "e AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings), c AS (SELECT label AS query_id, list(m ORDER BY i) AS q FROM (SELECT label, i, avg(x) AS m FROM e GROUP BY ALL) GROUP BY 1)"


def centres(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    m = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return m.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("s")).select(F.col("label").alias("query_id"), F.col("s.m").alias("q"))


@query(f"""WITH {CENTRES_SQL}, v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
  s AS (SELECT query_id, id, round(list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))), 9) AS score FROM v, c),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s) SELECT query_id, id, rank, round(score, 6) AS score FROM r WHERE rank <= 20""")
def m01_dense_cosine(spark, sf_dir):
    docs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return rounded(products.nearest(docs, written(centres(spark, sf_dir), "centres"), 20), "query_id", "id", "rank")


L2_CTE = f"""{Z_CTE}, zl AS (SELECT source, unnest(z) AS x, unnest(range(20)) AS i FROM zs), zc AS (SELECT source AS query_id, list(m ORDER BY i) AS q FROM (SELECT source, i, avg(x) AS m FROM zl GROUP BY ALL) GROUP BY 1),
  ls AS (SELECT query_id, doc_id AS id, round(-list_distance(z, q), 9) AS score FROM zs, zc), lr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM ls)"""


@query(f"WITH {L2_CTE} SELECT query_id, id, rank, round(score, 6) AS score FROM lr WHERE rank <= 20")
def m02_style_l2(spark, sf_dir):
    z = written(z_table(spark, sf_dir), "z")
    q = z.groupBy("source").agg(F.array(*[F.avg(F.col("z")[i]) for i in range(20)]).alias("q")).withColumnRenamed("source", "query_id")
    z, q = z.select(F.col("doc_id").alias("id"), F.col("z").alias("v")), written(q, "centres")
    return rounded(products.nearest(z, q, 20, "l2"), "query_id", "id", "rank")


@query(f"""WITH {BM25_CTE}, sh AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dl, id) AS INTEGER) AS rank FROM bmr JOIN (SELECT doc_id AS id, length(text) AS dl FROM documents) USING (id)),
  u AS (SELECT query_id, id, 0.5::DOUBLE / (60 + rank) AS part FROM bmr WHERE rank <= 20 UNION ALL SELECT query_id, id, 1.0::DOUBLE / (60 + rank) FROM sh WHERE rank <= 20),
  f AS (SELECT query_id, id, round(sum(part), 9) AS score FROM u GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM f)
SELECT query_id, id, rank, round(score, 9) AS score FROM r WHERE rank <= 3""")
def m04_fused_rank(spark, sf_dir):
    scores = retrieval.bm25_scores(_docs(spark, sf_dir), _asked(spark, sf_dir))
    short = scores.join(_docs(spark, sf_dir).select("id", (-F.length("text")).alias("short")), "id").select("query_id", "id", F.col("short").alias("score"))
    fused = retrieval.fuse({"bm25": retrieval.ranked(scores, 20), "short": retrieval.ranked(short, 20)}, {"bm25": 0.5, "short": 1.0}, 3)
    return fused.select("query_id", "id", "rank", "score")


@query("SELECT lang, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS std, quantile_cont(n_chars::DOUBLE, 0.5) AS median, quantile_cont(n_chars::DOUBLE, 0.25) AS q1, quantile_cont(n_chars::DOUBLE, 0.75) AS q3, min(n_chars) AS min, max(n_chars) AS max, round(stddev_samp(n_chars), 6) AS std_sample FROM documents GROUP BY lang")
def a02_describe(spark, sf_dir):
    return rounded(stats.describe(table(spark, sf_dir, "documents"), "n_chars", ["lang"], large=True), "lang", "n", "min", "max")


@query("""WITH t AS (SELECT d.source, l.quality::DOUBLE AS v FROM documents d LEFT JOIN labels l USING (doc_id)), g AS (SELECT source, CAST(grouping(source) AS INTEGER) AS is_total, count(v) AS n, count(*) - count(v) AS missing, avg(v) AS mean FROM t GROUP BY GROUPING SETS ((source), ()))
SELECT source, is_total, n, missing, round(mean, 6) AS mean, CASE WHEN missing > 0 THEN 'incomplete' WHEN mean BETWEEN 0.51 AND 0.61 THEN 'inside' ELSE 'outside' END AS status FROM g""")
def a03_overall_and_by(spark, sf_dir):
    t = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    out = stats.overall_and_by(t.select("source", F.col("quality").cast("double").alias("v")), "v", "source")
    return out.select("source", F.col("is_total").cast("int").alias("is_total"), "n", "missing", F.round("mean", 6).alias("mean"), "status")


@query("""WITH o AS (SELECT lang, CASE WHEN quality > toxic THEN 'win' WHEN quality < toxic THEN 'loss' WHEN quality = 1 THEN 'tie' ELSE 'identical' END AS o FROM labels JOIN documents USING (doc_id))
SELECT lang, count(*) AS n, round(avg(CASE o WHEN 'win' THEN 1.0 WHEN 'loss' THEN 0.0 ELSE 0.5 END::DOUBLE), 6) AS win_rate, round(avg((o = 'tie')::INT), 6) AS tie_rate, round(avg((o = 'identical')::INT), 6) AS identical_rate FROM o GROUP BY lang""")
def a12_vote_tally(spark, sf_dir):
    o = F.when(F.col("quality") > F.col("toxic"), "win").when(F.col("quality") < F.col("toxic"), "loss").when(F.col("quality") == 1, "tie").otherwise("identical")
    t = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("lang", o.alias("o"))
    return rounded(stats.vote_tally(t, "o", ["lang"]), "lang", "n")


DIFF_SQL = f"""w AS (SELECT pair_id, work, list_distinct({TOKENS_SQL.format('src')}) AS s, list_distinct({TOKENS_SQL.format('out')}) AS o FROM pairs),
  r0 AS (SELECT pair_id, work, CASE WHEN len(s) > 0 THEN len(list_intersect(s, o))::DOUBLE / len(s) ELSE 1 END AS recall, CASE WHEN len(o) > 0 THEN (len(o) - len(list_intersect(o, s)))::DOUBLE / len(o) ELSE 0 END AS hallucination FROM w),
  r AS (SELECT work, recall - hallucination AS x, row_number() OVER (PARTITION BY work ORDER BY pair_id) - 1 AS i, count(*) OVER (PARTITION BY work) AS n FROM r0)"""


def paired_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, work, diff: recall minus hallucination of the tokens of a pair."""
    s, o = F.array_distinct(text.tokens(F.coalesce("src", F.lit("")), LATIN)), F.array_distinct(text.tokens(F.coalesce("out", F.lit("")), LATIN))
    p = pairs(spark, sf_dir).select("pair_id", "work", surface.recall(s, o).alias("recall"), surface.hallucination(s, o).alias("hallucination"))
    return p.select("pair_id", "work", (F.col("recall") - F.col("hallucination")).alias("diff"))


@query(f"""WITH {PAIRS_SQL}, {DIFF_SQL},
  p AS (SELECT work, b, ('0x' || substr(md5(work || ':' || b || ':' || i), 1, 7))::BIGINT % n AS i FROM r, range(10000) t(b)), m AS (SELECT p.work, b, avg(x) AS m FROM p JOIN r ON p.work = r.work AND p.i = r.i GROUP BY ALL)
SELECT work, round((SELECT avg(x) FROM r WHERE r.work = m.work), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY work""")
def a19_bootstrap(spark, sf_dir):
    """10,000 resamples of paired differences, picked by hashed positions."""
    return rounded(stats.bootstrap_hashed(paired_differences(spark, sf_dir), "diff", "pair_id", "work"), "work")


@query("""WITH r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS x, rank() OVER (PARTITION BY lang ORDER BY length(source)) + (count(*) OVER (PARTITION BY lang, length(source)) - 1) / 2.0 AS y FROM documents)
SELECT lang, round(coalesce(corr(x::DOUBLE, y::DOUBLE), 0), 6) AS spearman FROM r GROUP BY lang""")
def a25_spearman(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("lang", "n_chars", F.length("source").alias("y"))
    return rounded(stats.spearman(t, "n_chars", "y", ["lang"]), "lang")


@query("SELECT doc_id, CAST((row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) - 1) % 5 AS INTEGER) AS fold FROM documents")
def w05_folds(spark, sf_dir):
    return sampling.folds(table(spark, sf_dir, "documents"), "doc_id", "source").select("doc_id", "fold")


@query("""SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) <= greatest(1, round_even(count(*) OVER (PARTITION BY source) * 0.08::DOUBLE, 0)) THEN 'eval' ELSE 'train' END AS split FROM documents""")
def w06_stratified_split(spark, sf_dir):
    return sampling.stratified_split(table(spark, sf_dir, "documents"), "doc_id", "source").select("doc_id", "split")


@query("""WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS place FROM documents)
SELECT doc_id, source FROM p ORDER BY place, md5('42-strata:' || source), source LIMIT 50""")
def w07_even_sample(spark, sf_dir):
    return sampling.even_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", "source", 50)


_ORDERS = (1, 2, 3, 4, 6)
_LETTERS = r"regexp_replace(coalesce({0}, ''), '[^\p{{L}}]', '', 'g')"
GRAM_CTE = f"""l AS (SELECT pair_id, {_LETTERS.format('out')} AS o, {_LETTERS.format('src')} AS s FROM pairs),
  gs AS ({' UNION ALL '.join(f"SELECT pair_id, {n} AS n, unnest({_GRAMS.format('s', n)}) AS g, 1 AS s, 0 AS o FROM l UNION ALL SELECT pair_id, {n}, unnest({_GRAMS.format('o', n)}), 0, 1 FROM l" for n in _ORDERS)}),
  gc AS (SELECT pair_id, n, g, sum(s) AS s, sum(o) AS o FROM gs GROUP BY ALL),
  gt AS (SELECT pair_id, n, sum(o) AS total, sum(CASE WHEN s = 0 THEN o ELSE 0 END) AS novel, sum((s > 0 AND o > 0)::INT) AS shared, sum((s > 0)::INT) AS dist, sum(least(s, o)) AS clipped FROM gc GROUP BY ALL),
  gr AS (SELECT pair_id, n, total, clipped, CASE WHEN total > 0 THEN novel::DOUBLE / total END AS pinc, CASE WHEN dist > 0 THEN shared::DOUBLE / dist END AS overlap, sum((clipped = 0)::INT) FILTER (total > 0 AND n <= 4) OVER (PARTITION BY pair_id ORDER BY n) AS zeros FROM gt),
  gb AS (SELECT pair_id, max(n) AS top, sum(CASE WHEN clipped > 0 THEN ln(100.0::DOUBLE * clipped / total) ELSE ln(100.0::DOUBLE / (pow(2, zeros) * total)) END) AS logs FROM gr WHERE total > 0 AND n <= 4 GROUP BY ALL)"""


@query(f"""WITH {PAIRS_SQL}, {GRAM_CTE} SELECT pair_id, {', '.join(f"round(max(pinc) FILTER (n = {n}), 6) AS pinc{n}, round(max(overlap) FILTER (n = {n}), 6) AS overlap{n}" for n in _ORDERS)},
  round((max(pinc) FILTER (n = 1) + max(pinc) FILTER (n = 2) + max(pinc) FILTER (n = 3) + max(pinc) FILTER (n = 4)) / 4, 6) AS pinc_mean,
  round(max(CASE WHEN length(o) = 0 OR length(s) = 0 THEN 0 ELSE (CASE WHEN length(o) >= length(s) THEN 1 ELSE exp(1 - length(s)::DOUBLE / length(o)) END) * exp(logs / top) END), 6) AS bleu
FROM l LEFT JOIN gr USING (pair_id) LEFT JOIN gb USING (pair_id) GROUP BY pair_id""")
def f42_pinc(spark, sf_dir):
    return rounded(surface.gram_measures(pairs(spark, sf_dir), "pair_id", "src", "out", _ORDERS, LATIN), "pair_id")


@query(rf"""WITH b AS (SELECT DISTINCT unnest({_GRAMS.format('t', 12)}) AS w FROM (SELECT regexp_replace(text, '[^\p{{L}}]', '', 'g') AS t FROM benchmark)),
  ln AS (SELECT doc_id, line, unnest(range(1, length(x) + 1)) AS c FROM (SELECT doc_id, generate_subscripts(ls, 1) AS line, regexp_replace(unnest(ls), '[^\p{{L}}]', '', 'g') AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
  pos AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line, c) AS pl FROM ln),
  g AS (SELECT doc_id, unnest({_GRAMS.format('t', 12)}) AS w, unnest(range(1, length(t) - 10)) AS pl FROM (SELECT doc_id, regexp_replace(text, '[^\p{{L}}]', '', 'g') AS t FROM documents) WHERE length(t) >= 12)
SELECT doc_id, CAST(line AS INTEGER) AS line, 'benchmark' AS kind, count(*) AS count, array_to_string(list_sort(list_distinct(list(substr(sha256(w), 1, 12)))), ',') AS hashes FROM g JOIN b USING (w) JOIN pos USING (doc_id, pl) GROUP BY ALL""")
def a30_leak_hits(spark, sf_dir):
    src = leak.source_windows(table(spark, sf_dir, "benchmark"), "text", "benchmark", profile=LATIN)
    return leak.leak_hits(table(spark, sf_dir, "documents"), src, "doc_id", "text", profile=LATIN).withColumn("hashes", F.array_join("hashes", ","))


@query(f"""WITH {PAIRS_SQL}, w AS (SELECT pair_id, list_distinct({TOKENS_SQL.format('src')}) AS s, list_distinct({TOKENS_SQL.format('out')}) AS o FROM pairs)
SELECT pair_id, round(CASE WHEN len(s) > 0 THEN len(list_intersect(s, o))::DOUBLE / len(s) ELSE 1 END, 6) AS recall, round(CASE WHEN len(o) > 0 THEN (len(o) - len(list_intersect(o, s)))::DOUBLE / len(o) ELSE 0 END, 6) AS hallucination,
  round(CASE WHEN len(s) + len(o) > 0 THEN len(list_intersect(s, o))::DOUBLE / (len(s) + len(o) - len(list_intersect(s, o))) ELSE 1 END, 6) AS jaccard FROM w""")
def u01_set_rates(spark, sf_dir):
    s, o = F.array_distinct(text.tokens(F.coalesce("src", F.lit("")), LATIN)), F.array_distinct(text.tokens(F.coalesce("out", F.lit("")), LATIN))
    p = pairs(spark, sf_dir)
    return rounded(p.select("pair_id", surface.recall(s, o).alias("recall"), surface.hallucination(s, o).alias("hallucination"), surface.jaccard(s, o).alias("jaccard")), "pair_id")


@query(f"WITH {PAIRS_SQL} SELECT pair_id, sha256(src) AS text_sha, 'sha256:' || sha256(out) AS labelled_sha, substr(sha256(src), 1, 12) AS short_sha FROM pairs")
def h01_hashes(spark, sf_dir):
    return pairs(spark, sf_dir).select("pair_id", text.sha(F.col("src")).alias("text_sha"), text.sha(F.col("out"), "sha256:").alias("labelled_sha"), text.short_hash(F.col("src")).alias("short_sha"))


@query(f"""WITH {PAIRS_SQL}, p AS (SELECT pair_id, work, src FROM pairs), e AS (SELECT a.pair_id, b.pair_id AS other, row_number() OVER (PARTITION BY a.pair_id ORDER BY md5(b.pair_id), b.pair_id) AS rank FROM p a JOIN p b ON a.work = b.work AND a.pair_id <> b.pair_id AND a.src <> b.src)
SELECT pair_id, CAST(count(other) AS BIGINT) AS exemplars, string_agg(other, '|' ORDER BY rank DESC) AS order_shown FROM e WHERE rank <= 3 GROUP BY pair_id""")
def g01_exemplar_order(spark, sf_dir):
    return agent.exemplar_order(pairs(spark, sf_dir), "pair_id", "work", "src", 3)


@query("""SELECT doc_id, CASE WHEN quality = 0 AND toxic = 1 THEN 'accept' WHEN toxic = 1 AND doc_id % 3 < 2 THEN 'revise' WHEN toxic = 0 AND quality = 0 AND doc_id % 3 < 2 AND doc_id % 2 = 0 THEN 're_retrieve' ELSE 'accept' END AS route FROM labels""")
def g06_routing(spark, sf_dir):
    t = table(spark, sf_dir, "labels")
    halt, blank = (F.col("quality") == 0) & (F.col("toxic") == 1), F.lit(False)
    return t.select("doc_id", agent.route(halt, blank, F.col("toxic"), F.col("quality").cast("double"), F.col("doc_id") % 3, 2, 0.5, F.col("doc_id") % 2 == 1).alias("route"))


@query("""WITH c AS (SELECT conv_id, turn, unnest(list_transform(range(0, CAST(ceil(length(text) / 24.0) AS BIGINT)), lambda i: substr(text, i * 24 + 1, 24))) AS piece, unnest(range(0, CAST(ceil(length(text) / 24.0) AS BIGINT))) AS place FROM conversations WHERE length(text) > 0)
SELECT conv_id, turn, CAST(place AS INTEGER) AS place, piece FROM c""")
def r01_token_events(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.posexplode(text.slices(F.coalesce("text", F.lit("")))).alias("place", "piece"))


@query("SELECT CAST(date_trunc('day', ts) AS VARCHAR)[:10] AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def x01_daily_events(spark, sf_dir):
    """An extension: the reference has no windows over event time."""
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query()
def f40_text_similarity(spark, sf_dir):
    """The sequence matcher's ratio has no SQL form; tests hold it against the standard library."""
    return pairs(spark, sf_dir).select("pair_id", F.round(surface.text_similarity(F.col("out"), F.col("src")), 6).alias("similarity"))


@query()
def a21_ridge(spark, sf_dir):
    """Ridge map of the first four embedding components to the next two, with its out-of-fold alpha."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 4).alias("x"), F.slice("embedding", 5, 2).alias("y"))
    e = sampling.folds(e, "vec_id", "label")
    alpha = stats.choose_alpha(e, "x", "y", "fold", (4, 2), [0.01, 1.0, 100.0])
    coef = stats.fit_ridge(e, "x", "y", (4, 2), alpha)
    return e.select("vec_id", F.transform(stats.predict(F.col("x"), coef), lambda v: F.round(v, 6)).alias("predicted"), F.lit(alpha).alias("alpha"))
