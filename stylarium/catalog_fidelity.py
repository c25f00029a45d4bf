"""Registered queries of fidelity, gates, prompts and scans, and their SQL.

The tables hold no Chinese and no loops: where an operator needs quantities, violations or votes, both engines derive
them from ids in the same way, by MD5.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import GRAM_CTE, PAIRS_SQL, TOKENS_SQL, pairs, query, rounded, table
from .functions import fidelity, numerals, style, surface, text
from .functions.text import LATIN
from .operators import agent, chunking, gates, lexicon, postings, retrieval, sampling, stats
from .sources import records, vectors
from .sources.tables import shared_dir

NAMES = ("tion", "chen", "eau", "ing")
TITLES = ("the", "und", "qu")
WORDS = ("ation", "ver", "ment", "ou", "chens")
DIMS = fidelity.Dimensions(names=NAMES, words=WORDS, titles=TITLES)
_LETTERS = r"length(regexp_replace({0}, '[^\p{{L}}]', '', 'g'))"


def pick(n: int, *parts: Column | str) -> Column:
    return stats.draw(F.lit(n), *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])


def pick_sql(n: int, *parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 7))::BIGINT % {n})"


def folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def counted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairs with a quantity derived from the id put at the end of each text."""
    a, b = pick(4, "pair_id", F.lit("a")), pick(4, "pair_id", F.lit("b"))
    p = pairs(spark, sf_dir)
    return p.select("pair_id", "work", F.concat("src", F.lit(" 第"), a.cast("string"), F.lit("次，约"), a.cast("string"), F.lit("斤")).alias("src"), F.concat("out", F.lit(" 第"), b.cast("string"), F.lit("次，约"), b.cast("string"), F.lit("斤")).alias("out"))


COUNTED_SQL = f"""{PAIRS_SQL}, cp0 AS (SELECT *, {pick_sql(4, 'pair_id', "'a'")} AS a, {pick_sql(4, 'pair_id', "'b'")} AS b FROM pairs),
  cp AS (SELECT pair_id, work, a, b, src || ' 第' || a || '次，约' || a || '斤' AS src, out || ' 第' || b || '次，约' || b || '斤' AS out FROM cp0)"""


def _facts_sql(t: str) -> str:
    """entities and titles of a text column: names take their places by falling length, words that aren't part of one supplement them."""
    names = sorted(NAMES, key=lambda n: -len(n))
    left, found = t, []
    for n in names:
        found.append(f"CASE WHEN contains({left}, '{n}') THEN '{n}' END")
        left = f"replace({left}, '{n}', repeat(chr(1), {len(n)}))"
    manual = f"list_filter([{', '.join(found)}], lambda x: x IS NOT NULL)"
    words = ", ".join(f"CASE WHEN contains({t}, '{w}') THEN '{w}' END" for w in WORDS)
    titles = ", ".join(f"CASE WHEN contains({t}, '{w}') THEN '{w}' END" for w in TITLES)
    return (
        f"{manual} AS m, list_filter([{words}], lambda x: x IS NOT NULL) AS w, list_sort(list_filter([{titles}], lambda x: x IS NOT NULL)) AS titles"
    )


def _entities(side: str) -> str:
    return f"list_sort(list_distinct(list_filter(list_concat({side}.m, list_filter({side}.w, lambda x: len(list_filter({side}.m, lambda n: n <> x AND contains(n, x))) = 0)), lambda x: NOT list_contains({side}.titles, x))))"


FACTS_CTE = f"""{COUNTED_SQL}, fs AS (SELECT pair_id, a, {_facts_sql('src')} FROM cp), fo AS (SELECT pair_id, b, {_facts_sql('out')} FROM cp),
  f AS (SELECT fs.pair_id, a, b, {_entities('fs')} AS se, {_entities('fo')} AS oe, fs.titles AS st, fo.titles AS ot FROM fs JOIN fo USING (pair_id))"""


@query(f"""WITH {FACTS_CTE} SELECT pair_id, round(CASE WHEN len(se) > 0 THEN len(list_intersect(se, oe))::DOUBLE / len(se) ELSE 1 END, 6) AS entity_recall, round(CASE WHEN a = b THEN 1.0 ELSE 0.0 END::DOUBLE, 6) AS numeral_recall,
  round(CASE WHEN len(oe) > 0 THEN len(list_filter(oe, lambda x: NOT list_contains(se, x)))::DOUBLE / len(oe) ELSE 0 END, 6) AS hallucination_rate FROM f""")
def u06_assess(spark, sf_dir):
    """Recalls and hallucination from names, counted words, titles and quantities."""
    return rounded(fidelity.assess(counted_pairs(spark, sf_dir), "src", "out", DIMS, ("pair_id",)).drop("violations"), "pair_id")


@query(f"""WITH {FACTS_CTE}, v AS (SELECT pair_id, list_concat(
    list_transform(list_filter(se, lambda x: NOT list_contains(oe, x)), lambda x: {{'kind': 'entity_missing', 'expected': x, 'actual': NULL::VARCHAR}}),
    CASE WHEN a <> b THEN [{{'kind': 'numeral_missing', 'expected': '第' || a || '次', 'actual': NULL::VARCHAR}}, {{'kind': 'numeral_missing', 'expected': '约' || a || '斤', 'actual': NULL::VARCHAR}}] ELSE [] END,
    list_transform(list_filter(oe, lambda x: NOT list_contains(se, x)), lambda x: {{'kind': 'entity_hallucination', 'expected': NULL::VARCHAR, 'actual': x}}),
    list_transform(list_filter(st, lambda x: NOT list_contains(ot, x)), lambda x, i: {{'kind': 'title', 'expected': x, 'actual': list_filter(ot, lambda y: NOT list_contains(st, y))[i]}})) AS vs FROM f),
  e AS (SELECT pair_id, unnest(vs) AS v, unnest(range(len(vs))) AS seq FROM v) SELECT pair_id, CAST(seq AS INTEGER) AS seq, v.kind AS kind, v.expected AS expected, v.actual AS actual FROM e""")
def u03_violation_list(spark, sf_dir):
    """Missing names, missing quantities by their surface, invented names, paired titles."""
    v = fidelity.assess(counted_pairs(spark, sf_dir), "src", "out", DIMS, ("pair_id",))
    return v.select("pair_id", F.posexplode("violations").alias("seq", "v")).select("pair_id", "seq", "v.kind", "v.expected", "v.actual")


@query(f"""WITH {FACTS_CTE}, x AS (SELECT pair_id, list_filter(oe, lambda x: NOT list_contains(se, x)) AS gone, oe FROM f)
SELECT pair_id, round(CASE WHEN len(oe) > 0 THEN len(list_filter(gone, lambda x: list_contains(['eau', 'ou', 'ment'], x)))::DOUBLE / len(oe) ELSE 0 END, 6) AS leak FROM x""")
def u07_exemplar_leak(spark, sf_dir):
    """What an output invents that its exemplars (here a fixed set) have."""
    f = counted_pairs(spark, sf_dir).select("pair_id", fidelity.facts(F.col("src"), DIMS)["entities"].alias("s"), fidelity.facts(F.col("out"), DIMS)["entities"].alias("o"))
    return f.select("pair_id", F.round(surface.exemplar_leak(F.col("s"), F.col("o"), F.array(*[F.lit(w) for w in ("eau", "ou", "ment")])), 6).alias("leak"))


QUANTITY_SQL = f"""SELECT doc_id, doc_id % 30 + 1 AS n, {pick_sql(5, 'doc_id', "'q'")} AS k FROM documents"""


@query(f"""WITH q AS ({QUANTITY_SQL}) SELECT doc_id, list_transform(list_sort(list_distinct(['第' || n, '约:' || n, '上:10000', n::VARCHAR] )), lambda x: x).list_aggregate('string_agg', '|') AS keys,
  CASE k WHEN 0 THEN '第' || n || '次' ELSE '第' || n || '回' END AS surface, (k <> 4) AS preserved FROM q""")
def n01_quantity_facts(spark, sf_dir):
    """Keys, a surface and preservation of quantities of a text made from the id."""
    n, k = (F.col("doc_id") % 30 + 1).cast("string"), pick(5, "doc_id", F.lit("q"))
    t = F.concat(F.lit("第"), n, F.when(k == 0, "次").otherwise("回"), F.lit("，差不多"), n, F.lit("斤，上万人，上一次，一个，"), n, F.lit("天"))
    other = F.concat(F.lit("第"), n, F.lit("届，约"), n, F.lit("两，上万名"), F.when(k != 4, F.concat(F.lit("，"), n, F.lit("年"))).otherwise(F.lit("")))
    q = table(spark, sf_dir, "documents").select("doc_id", numerals.quantities(t).alias("h"), numerals.quantities(other).alias("o"), F.concat(F.lit("第"), n).alias("key"))
    return q.select("doc_id", F.array_join(numerals.numeral_keys(F.col("h")), "|").alias("keys"), numerals.surface_of(F.col("h"), F.col("key")).alias("surface"), numerals.numerals_preserved(F.col("h"), F.col("o")).alias("preserved"))


CHINESE_DIGITS = "零一二三四五六七八九"


@query(f"""WITH q AS (SELECT doc_id, doc_id % 9000 + 1000 AS n FROM documents), s AS (SELECT doc_id, n, n // 1000 AS a, n // 100 % 10 AS b, n // 10 % 10 AS c, n % 10 AS d FROM q),
  t AS (SELECT doc_id, n, '{CHINESE_DIGITS}'[a + 1] || '千' || CASE WHEN b > 0 THEN '{CHINESE_DIGITS}'[b + 1] || '百' WHEN c > 0 OR d > 0 THEN '零' ELSE '' END || CASE WHEN c > 0 THEN '{CHINESE_DIGITS}'[c + 1] || '十' WHEN b > 0 AND d > 0 THEN '零' ELSE '' END || CASE WHEN d > 0 THEN '{CHINESE_DIGITS}'[d + 1] ELSE '' END AS spoken FROM s)
SELECT doc_id, spoken, n::VARCHAR AS value, (n * 10000)::VARCHAR AS ten_thousands FROM t""")
def n02_spoken_numbers(spark, sf_dir):
    """Numbers of four digits written in Chinese and read again, alone and before a ten thousand."""
    n = (F.col("doc_id") % 9000 + 1000).cast("int")
    sign = lambda v: F.substring(F.lit(CHINESE_DIGITS), v.cast("int") + 1, F.lit(1))
    b, c, d = F.floor(n / 100) % 10, F.floor(n / 10) % 10, n % 10
    hundreds = F.when(b > 0, F.concat(sign(b), F.lit("百"))).when((c > 0) | (d > 0), "零").otherwise("")
    tens = F.when(c > 0, F.concat(sign(c), F.lit("十"))).when((b > 0) & (d > 0), "零").otherwise("")
    spoken = F.concat(sign(F.floor(n / 1000)), F.lit("千"), hundreds, tens, F.when(d > 0, sign(d)).otherwise(""))
    t = table(spark, sf_dir, "documents").select("doc_id", spoken.alias("spoken"))
    return t.select("doc_id", "spoken", numerals.number_text(F.col("spoken")).alias("value"), numerals.number_text(F.concat("spoken", F.lit("万"))).alias("ten_thousands"))


@query(f"""WITH q AS ({QUANTITY_SQL}) SELECT doc_id, list_aggregate(list_sort(list_distinct([n::VARCHAR, '3.5'])), 'string_agg', '|') AS "values", '三点五斤' AS chinese_forms, '一个' AS waivers,
  (k <> 3) AS same_phrases FROM q""")
def n05_numeric_values(spark, sf_dir):
    """The older variant of values, and the multiset of phrases, of a text made from the id."""
    n, k = (F.col("doc_id") % 30 + 1).cast("string"), pick(5, "doc_id", F.lit("q"))
    t = F.concat(n, F.lit("年，三点五斤，一个，那一"))
    other = F.concat(F.lit("三点五斤和"), n, F.when(k == 3, "月").otherwise("年"), F.lit("一个"))
    v = table(spark, sf_dir, "documents").select("doc_id", numerals.numeric_values(t).alias("v"), (numerals.numeral_phrases(t) == numerals.numeral_phrases(other)).alias("same_phrases"))
    return v.select("doc_id", F.array_join("v.values", "|").alias("values"), F.array_join("v.chinese_forms", "|").alias("chinese_forms"), F.array_join("v.waivers", "|").alias("waivers"), "same_phrases")


_NAMES_SQL = _facts_sql("coalesce(text, '')")


@query(f"""WITH m AS (SELECT doc_id, {_NAMES_SQL} FROM documents) SELECT doc_id, list_aggregate(list_sort(m), 'string_agg', '|') AS names, length(replace(replace(replace(replace(coalesce((SELECT text FROM documents d WHERE d.doc_id = m.doc_id), ''), 'chen', '    '), 'tion', '    '), 'eau', '   '), 'ing', '   ')) AS masked FROM m""")
def n07_mentions(spark, sf_dir):
    """Names by falling length, each place once, and the text with names blanked out."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    names = numerals.names_array(NAMES)
    found = F.array_join(numerals.mentions(F.col("t"), names), "|")
    return d.select("doc_id", F.when(found != "", found).alias("names"), F.length(numerals.mask(F.col("t"), names)).cast("long").alias("masked"))


@query(f"""WITH w AS (SELECT token AS word, count(*) AS frequency FROM (SELECT unnest({TOKENS_SQL.format('text')}) AS token FROM benchmark) GROUP BY 1), s AS (SELECT *, {pick_sql(10, 'word')} > 0 AS stable FROM w)
SELECT word, frequency FROM s WHERE NOT list_contains(['the', 'und', 'qu', 'and'], word) AND length(word) >= 2 AND frequency < 20 AND stable AND (list_contains(['tion', 'chen', 'eau', 'ing'], word) OR NOT (contains(word, 'tion') OR contains(word, 'chen') OR contains(word, 'eau') OR contains(word, 'ing')))""")
def n08_supplement(spark, sf_dir):
    """Words that may supplement the names."""
    counts = lexicon.token_counts(table(spark, sf_dir, "benchmark"), "text", LATIN).select(F.col("token").alias("word"), F.col("n").alias("frequency"))
    rows = counts.withColumn("stable", pick(10, "word") > 0)
    return fidelity.supplement(rows, NAMES, TITLES, ("and",), 20).select("word", "frequency")


@query(f"""WITH w AS (SELECT unnest({TOKENS_SQL.format('text')}) AS word FROM documents), f AS (SELECT word, ['i', 'l', 'n', 'nr', 'v'][{pick_sql(5, 'word')} + 1] AS flag FROM w WHERE length(word) BETWEEN 2 AND 4),
  c AS (SELECT word, count(*) AS n, any_value(flag) AS flag FROM f GROUP BY 1 HAVING count(*) >= 2), k AS (SELECT word, n, (flag = 'i' OR (flag = 'l' AND length(word) = 4)) AS idiom, (flag = 'i' OR flag = 'l') AND length(word) = 4 AS four FROM c),
  e AS (SELECT word, n, 'idiom' AS class FROM k WHERE idiom UNION ALL SELECT word, n, 'four_character_expression' FROM k WHERE four), r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY n DESC, word) AS place FROM e)
SELECT DISTINCT word AS term, n, CASE WHEN four THEN 'four_character_expression|idiom' ELSE 'idiom' END AS categories FROM r JOIN k USING (word, n) WHERE place <= 60""")
def n09_class_terms(spark, sf_dir):
    """The most frequent words of each class, under flags derived from the word."""
    w = table(spark, sf_dir, "documents").select(F.explode(text.tokens(F.col("text"), LATIN)).alias("word")).where(F.length("word").between(2, 4))
    flags = F.array(*[F.lit(f) for f in ("i", "l", "n", "nr", "v")])
    out = fidelity.class_terms(w.select("word", F.get(flags, pick(5, "word").cast("int")).alias("flag")))
    return out.select("term", "n", F.array_join("categories", "|").alias("categories"))


@query(f"""WITH t AS (SELECT DISTINCT word AS term FROM (SELECT unnest({TOKENS_SQL.format('text')}) AS word FROM benchmark) WHERE length(word) BETWEEN 9 AND 14)
SELECT doc_id, term FROM documents JOIN t ON contains(text, term)""")
def j10_contained_terms(spark, sf_dir):
    """Terms that are substrings of texts, joined by equal windows."""
    terms = table(spark, sf_dir, "benchmark").select(F.explode(text.tokens(F.col("text"), LATIN)).alias("term")).where(F.length("term").between(9, 14)).distinct()
    return fidelity.contained(table(spark, sf_dir, "documents"), "doc_id", "text", terms, "term")


@query(f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), u AS (SELECT doc_id, t, unnest(string_split(regexp_replace(t, '([.!?;])', '\\1' || chr(10), 'g'), chr(10))) AS u FROM t),
  g AS (SELECT doc_id, sum(CASE WHEN regexp_matches(u, '["'']') THEN {_LETTERS.format('u')} ELSE 0 END) AS inside FROM u GROUP BY 1)
SELECT doc_id, round(CASE WHEN {_LETTERS.format('t')} > 0 THEN inside::DOUBLE / {_LETTERS.format('t')} ELSE 0 END, 6) AS dialogue, CASE WHEN {_LETTERS.format('t')} > 0 AND inside::DOUBLE / {_LETTERS.format('t')} >= 0.5 THEN 0.7 WHEN {_LETTERS.format('t')} > 0 AND inside::DOUBLE / {_LETTERS.format('t')} >= 0.2 THEN 0.68 ELSE 0.65 END::DOUBLE AS tier FROM t JOIN g USING (doc_id)""")
def f47_dialogue_density(spark, sf_dir):
    """The share of letters in dialogue, and the similarity it allows (copy-similarity tier)."""
    d = fidelity.dialogue_density(F.col("text"), LATIN, "[\"']", ".!?;")
    rows = table(spark, sf_dir, "documents").select("doc_id", d.alias("dialogue"))
    return rows.select("doc_id", F.round("dialogue", 6).alias("dialogue"), gates.copy_limit(F.col("dialogue"), F.lit(0.0)).cast("double").alias("tier"))


@query(f"""WITH {COUNTED_SQL}, t AS (SELECT pair_id, a, b, src, out, {_LETTERS.format('out')}::DOUBLE / greatest({_LETTERS.format('src')}, 1) AS r, len(list_filter(string_split(src, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13)) <> '')) AS ps, len(list_filter(string_split(out, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13)) <> '')) AS po,
  list_distinct({TOKENS_SQL.format('src')}) AS ws, list_distinct({TOKENS_SQL.format('out')}) AS wo FROM cp)
SELECT pair_id, round(r, 6) AS length_ratio, array_to_string(list_filter([CASE WHEN r < 0.9 OR r > 1.3 THEN 'length_out_of_range' END, CASE WHEN ps <> po THEN 'paragraph_count_mismatch' END, CASE WHEN a <> b THEN 'numeral_mismatch' END,
  CASE WHEN len(list_intersect(ws, wo))::DOUBLE / (len(ws) + len(wo) - len(list_intersect(ws, wo))) > 0.2 THEN 'insufficient_rewrite' END], lambda x: x IS NOT NULL), ',') AS reasons FROM t""")
def p05_acceptance_gate(spark, sf_dir):
    """Length, paragraphs, quantities and similarity (here of the token sets, against a fixed limit)."""
    p = counted_pairs(spark, sf_dir)
    similar = surface.jaccard(F.array_distinct(text.tokens(F.col("src"), LATIN)), F.array_distinct(text.tokens(F.col("out"), LATIN)))
    return gates.acceptance(p, "pair_id", "src", "out", similar, F.lit(0.2), LATIN)


@query(f"""WITH {COUNTED_SQL}, t AS (SELECT *, list_filter(['che', 'en ', 'qu'], lambda x: contains(src, x) AND NOT contains(out, x)) AS missing, list_filter(['eau', 'ung'], lambda x: contains(src, x) AND NOT contains(out, x)) AS gaps FROM cp)
SELECT pair_id, array_to_string(list_filter([CASE WHEN len(missing) > 0 THEN 'protected_term_missing' END, CASE WHEN a <> b THEN 'numeral_mismatch' END], lambda x: x IS NOT NULL), ',') AS reasons, array_to_string(missing, '|') AS missing_terms, array_to_string(gaps, '|') AS observed_gaps FROM t""")
def p06_content_gate(spark, sf_dir):
    out = gates.content_acceptance(counted_pairs(spark, sf_dir), "pair_id", "src", "out", ("che", "en ", "qu"), ("eau", "ung"))
    return out.select("pair_id", "reasons", F.array_join("missing_terms", "|").alias("missing_terms"), F.array_join("observed_gaps", "|").alias("observed_gaps"))


_P8 = {"pinc4": 11, "pinc6": 11, "length_ratio": 22, "entity_recall": 5, "numeral_recall": 5}


def _p8_sql(side: str, name: str, n: int) -> str:
    x = pick_sql(n, "doc_id", f"'{side}{name}'")
    return {"pinc4": f"CASE WHEN {x} = 10 THEN NULL ELSE {x} / 10.0::DOUBLE END", "pinc6": f"CASE WHEN {x} = 10 THEN NULL ELSE {x} / 10.0::DOUBLE END", "length_ratio": f"{x} / 10.0::DOUBLE"}.get(name, f"least(1, {x} / 3.0::DOUBLE)")


@query(f"""WITH t AS (SELECT doc_id, {', '.join(f"{_p8_sql(s, n, k)} AS {s}_{n}" for s in 'ab' for n, k in _P8.items())}, {', '.join(f"{pick_sql(4, 'doc_id', chr(39) + n + chr(39))} = 0 AS {n}" for n in ('added', 'chinese', 'unparsed', 'residue'))} FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN a_pinc6 IS NULL OR b_pinc6 IS NULL THEN 'pinc6_unassessable' END, CASE WHEN a_pinc6 IS NOT NULL AND b_pinc6 < 0.85 THEN 'pinc6_below_limit' END, CASE WHEN a_pinc6 - b_pinc6 > 1e-12 THEN 'pinc6_repair_decrease' END,
  CASE WHEN a_pinc4 IS NULL OR b_pinc4 IS NULL THEN 'pinc4_unassessable' END, CASE WHEN a_pinc4 IS NOT NULL AND b_pinc4 < 0.75 - 1e-12 THEN 'pinc4_below_limit' END, CASE WHEN a_pinc4 - b_pinc4 > 1e-12 THEN 'pinc4_repair_decrease' END,
  CASE WHEN b_length_ratio < 0.6 OR b_length_ratio > 1.6 THEN 'length_out_of_range' END, CASE WHEN b_entity_recall < 1 THEN 'entity_missing' END, CASE WHEN b_numeral_recall < 1 THEN 'numeral_missing' END, CASE WHEN added THEN 'numeral_added' END, CASE WHEN chinese THEN 'numeric_form_not_colloquial' END,
  CASE WHEN unparsed THEN 'numeral_parse_error' END, CASE WHEN residue THEN 'literary_residue' END], lambda x: x IS NOT NULL), ',') AS reasons FROM t""")
def p08_final_gates(spark, sf_dir):
    """The second pass's gates over measures derived from ids."""

    def value(side: str, name: str, n: int) -> Column:
        x = pick(n, "doc_id", F.lit(side + name))
        if name.startswith("pinc"):
            return F.when(x != 10, x / 10.0)
        return x / 10.0 if name == "length_ratio" else F.least(F.lit(1.0), x / 3.0)

    def measured(side: str) -> Column:
        flag = lambda name: F.when(pick(4, "doc_id", F.lit(name)) == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
        lists = {"added_values": "added", "chinese_forms": "chinese", "unparsed": "unparsed", "banned_residue": "residue"}
        return F.struct(*[value(side, n, k).alias(n) for n, k in _P8.items()], *[flag(v).alias(k) for k, v in lists.items()])

    t = table(spark, sf_dir, "documents").select("doc_id", measured("a").alias("a"), measured("b").alias("b"))
    return t.select("doc_id", F.array_join(gates.final_reasons(F.col("a"), F.col("b")), ",").alias("reasons"))


@query(rf"""WITH t AS (SELECT doc_id::VARCHAR AS id, source AS domain, coalesce(text, '') AS t FROM documents), n AS (SELECT *, {_LETTERS.format('t')} AS n, (contains(t, 'tion')::INT + contains(t, 'chen')::INT + contains(t, 'eau')::INT) AS e FROM t),
  s AS (SELECT count(*) AS d, sum(c) AS n, count(*) FILTER (c <> 5) AS uneven FROM (SELECT domain, count(*) AS c FROM t GROUP BY 1))
SELECT id, 'length out of range' AS error FROM n WHERE trim(t) <> '' AND (n < 100 OR n > 300) UNION ALL SELECT id, 'fewer than two names' FROM n WHERE trim(t) <> '' AND e < 2 UNION ALL SELECT id, 'no digit' FROM n WHERE trim(t) <> '' AND NOT regexp_matches(t, '[0-9]')
UNION ALL SELECT NULL, 'not 6 domains of 5' FROM s WHERE d <> 6 OR n <> 30 OR uneven > 0""")
def p09_human_cases(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("domain"), F.col("text").alias("vernacular"))
    names = F.filter(F.array(F.lit("tion"), F.lit("chen"), F.lit("eau")), lambda n: F.contains(F.coalesce("vernacular", F.lit("")), n))
    return gates.human_case_errors(rows, names, profile=LATIN)


@query("SELECT doc_id, length(text) AS tokens FROM documents WHERE length(text) + 768 > 2048")
def p11_over_budget(spark, sf_dir):
    """Prompts that don't fit the window; a character stands for a token."""
    return gates.over_budget(table(spark, sf_dir, "documents"), "doc_id", F.length("text").cast("long"), 768, 2048)


@query("SELECT doc_id AS id, source AS declared, CASE WHEN doc_id % 50 = 0 THEN 'src0' WHEN doc_id % 50 = 1 THEN NULL ELSE source END AS listed FROM documents WHERE doc_id % 50 = 1 OR (doc_id % 50 = 0 AND source <> 'src0')")
def p13_split_mismatches(spark, sf_dir):
    """Rows whose declared split (the source) is not the listed one (changed by id, and left out by id)."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("split"))
    listed = d.where("id % 50 <> 1").withColumn("split", F.when(F.col("id") % 50 == 0, "src0").otherwise(F.col("split")))
    return records.split_mismatches(d, listed)


@query(f"""SELECT doc_id, {pick_sql(101, 'doc_id')} / 100.0::DOUBLE >= 0.92 AS numeral_recall_met, {pick_sql(101, 'doc_id')} / 10000.0::DOUBLE <= 0.005 AS hallucination_rate_met, {pick_sql(101, 'doc_id')} / 250.0::DOUBLE < 0.204 AS profile_gap_met,
  CASE WHEN {pick_sql(7, 'doc_id', "'l'")} - 4 <= 0 AND {pick_sql(7, 'doc_id', "'l'")} - 4 + {pick_sql(3, 'doc_id', "'w'")} >= 0 THEN 'no difference' WHEN {pick_sql(7, 'doc_id', "'l'")} - 4 > 0 THEN 'improved' ELSE 'worsened' END AS verdict FROM documents""")
def p15_interval_verdict(spark, sf_dir):
    """Targets and interval verdicts over values derived from ids."""
    x, low = pick(101, "doc_id"), pick(7, "doc_id", F.lit("l")) - 4
    met = gates.targets({"numeral_recall": x / 100.0, "hallucination_rate": x / 10000.0, "profile_gap": x / 250.0})
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(f"{n}_met") for n, c in met.items()], stats.verdict(low, low + pick(3, "doc_id", F.lit("w")), True).alias("verdict"))


@query(rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, {_LETTERS.format('t')} AS n_letters, len(list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '')) AS n_paragraphs,
  len(list_filter(string_split_regex(regexp_replace(t, '([.!?;' || chr(10) || '])', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS n_attached, length(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS n_clean, md5(t) AS unfenced FROM t""")
def f12_text_measures(spark, sf_dir):
    """Letters, paragraphs, sentences with their enders, cleaned length, and a fenced text without its fences."""
    t = F.coalesce("text", F.lit(""))
    fenced = F.concat(F.lit("```\n"), t, F.lit("\n```"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text.letters_length(t, LATIN).cast("long").alias("n_letters"),
        F.size(text.paragraphs(t)).cast("long").alias("n_paragraphs"),
        F.size(text.attached_sentences(t, LATIN)).cast("long").alias("n_attached"),
        F.length(text.clean_text(t, "", "")).cast("long").alias("n_clean"),
        F.md5(text.strip_fences(fenced)).alias("unfenced"),
    )


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest({TOKENS_SQL.format('d.text')}) AS token FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) GROUP BY 1")
def a07_token_counts(spark, sf_dir):
    """Token counts of the rows whose ids a training list holds."""
    train = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lexicon.token_counts(lexicon.training_rows(table(spark, sf_dir, "documents"), train, "doc_id"), "text", LATIN)


@query(rf"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(tion|eau|chen|ung|\p{{L}})') AS w FROM documents)
SELECT doc_id, len(w) AS n_words, round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: list_contains(['chen', 'eau', 'tion'], x)))::DOUBLE / len(w) ELSE 0 END, 6) AS name_share,
  array_to_string(list_sort(list_distinct(list_filter(w, lambda x: list_contains(['eau', 'tion'], x)))), '|') AS names FROM t""")
def f14_dictionary_words(spark, sf_dir):
    """A dictionary segmenter and tagger: the longest word from each place, else a single letter."""
    segment = fidelity.dictionary_tokens(("tion", "eau", "chen", "ung"), text.Profile(**{**LATIN.__dict__, "token": r"\p{L}"}))
    tag = fidelity.dictionary_tagger({"tion": "nr", "eau": "ns", "chen": "v", "ung": "n"}, profile=text.Profile(**{**LATIN.__dict__, "token": r"\p{L}"}))
    known = F.array(*[F.lit(w) for w in ("chen", "eau", "tion")])
    d = table(spark, sf_dir, "documents").select("doc_id", segment(F.col("text")).alias("w"), tag(F.coalesce("text", F.lit(""))).alias("t"))
    hits = F.size(F.filter("w", lambda x: F.array_contains(known, x)))
    return d.select("doc_id", F.size("w").cast("long").alias("n_words"), F.round(text.ratio(hits, F.size("w")), 6).alias("name_share"), F.array_join(F.array_sort("t"), "|").alias("names"))


_HIT = ("the", "la", "und", "que")


@query(f"""WITH t AS (SELECT doc_id, {TOKENS_SQL.format('text')} AS w FROM documents) SELECT doc_id, round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: list_contains({list(_HIT)}, x)))::DOUBLE / len(w) ELSE 0 END, 6) AS literary_hit FROM t""")
def f25_literary_hit_rate(spark, sf_dir):
    """The share of a text's tokens in a lexicon."""
    f = style.style_features(table(spark, sf_dir, "documents"), keep=("doc_id",), profile=LATIN, lexicon=F.array(*[F.lit(w) for w in _HIT]))
    return f.select("doc_id", F.round("literary_hit", 6).alias("literary_hit"))


@query(f"""WITH {PAIRS_SQL}, {GRAM_CTE}, p AS (SELECT pair_id, n, pinc, overlap FROM gr WHERE n IN (4, 6)) SELECT pair_id, round(max(overlap) FILTER (n = 4) - 0.1::DOUBLE, 6) AS d_overlap4, round(max(overlap) FILTER (n = 6) - 0.1::DOUBLE, 6) AS d_overlap6, round(max(pinc) FILTER (n = 4) - 0.5::DOUBLE, 6) AS d_pinc4, round(max(pinc) FILTER (n = 6) - 0.5::DOUBLE, 6) AS d_pinc6 FROM (SELECT pair_id FROM pairs) LEFT JOIN p USING (pair_id) GROUP BY pair_id""")
def a32_surface_change(spark, sf_dir):
    """Second pass minus first, the first pass's measures being constants."""
    from .plans import evaluation

    second = surface.gram_measures(pairs(spark, sf_dir), "pair_id", "src", "out", (4, 6), LATIN)
    first = second.select("pair_id", *[F.lit(0.1).alias(f"overlap{n}") for n in (4, 6)], *[F.lit(0.5).alias(f"pinc{n}") for n in (4, 6)])
    return rounded(evaluation.surface_change(first, second, "pair_id"), "pair_id")


@query(f"WITH {PAIRS_SQL} SELECT pair_id, round(CASE WHEN {_LETTERS.format('src')} > 0 THEN {_LETTERS.format('out')}::DOUBLE / {_LETTERS.format('src')} END, 6) AS letter_ratio, round({_LETTERS.format('out')}::DOUBLE / greatest({_LETTERS.format('src')}, 1), 6) AS floor_ratio FROM pairs")
def m08_length_ratio(spark, sf_dir):
    s, o = F.col("src"), F.col("out")
    return pairs(spark, sf_dir).select("pair_id", F.round(gates.length_ratio_or_null(s, o, LATIN), 6).alias("letter_ratio"), F.round(gates.length_ratio(s, o, LATIN), 6).alias("floor_ratio"))


@query(f"""WITH {PAIRS_SQL}, j AS (SELECT pair_id, '[{{"role":"system","content":"rewrite"}},{{"role":"user","content":' || to_json(src) || '}},{{"role":"assistant","content":' || to_json(out) || '}},{{"role":"user","content":' || to_json(out) || '}}]' AS m, out FROM pairs)
SELECT pair_id, sha256(m) AS prompt_sha, sha256(out || 'model') AS vote_key FROM j""")
def h02_prompt_hash(spark, sf_dir):
    """The hash of a prompt's messages as compact JSON, and the key of a cached vote."""
    e = F.array(F.struct(F.col("src").alias("plain"), F.col("out").alias("styled")))
    m = agent.prompt(F.lit("rewrite"), e, F.col("out"))
    return pairs(spark, sf_dir).select("pair_id", agent.messages_hash(m).alias("prompt_sha"), vectors.vote_key(F.col("out"), F.lit("model")).alias("vote_key"))


@query(f"""WITH {PAIRS_SQL}, v AS (SELECT pair_id, src = out AS same, ['A', 'B', 'A.', ' B '][{pick_sql(4, 'pair_id', "'1'")} + 1] AS v, ['B', 'A', 'C', 'A '][{pick_sql(4, 'pair_id', "'2'")} + 1] AS w, src, out FROM pairs)
SELECT pair_id, CASE WHEN same THEN 'identical' WHEN trim(v) = 'A' AND trim(w) = 'B' THEN 'win' WHEN trim(v) = 'B' AND trim(w) = 'A' THEN 'loss' ELSE 'tie' END AS outcome, md5('Original: ' || src || ' A: ' || out || ' B: ' || src) AS prompt_md5 FROM v""")
def g13_judge_outcomes(spark, sf_dir):
    """Outcomes of two votes with the sides swapped; the votes are derived from ids."""
    a, b = F.array(*[F.lit(x) for x in ("A", "B", "A.", " B ")]), F.array(*[F.lit(x) for x in ("B", "A", "C", "A ")])
    vote, swapped = F.get(a, pick(4, "pair_id", F.lit("1")).cast("int")), F.get(b, pick(4, "pair_id", F.lit("2")).cast("int"))
    asked = agent.judge_prompt(F.lit("Original: {original} A: {a} B: {b}"), F.col("src"), F.col("out"), F.col("src"))
    return pairs(spark, sf_dir).select("pair_id", agent.pairwise_vote(F.col("src") == F.col("out"), vote, swapped).alias("outcome"), F.md5(asked).alias("prompt_md5"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS original, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS idx FROM documents)
SELECT doc_id || '_' || CASE WHEN idx < 10000 THEN lpad(idx::VARCHAR, 4, '0') ELSE idx::VARCHAR END AS id, CAST(idx AS INTEGER) AS idx, length(original) AS n FROM l""")
def w09_numbered_lines(spark, sf_dir):
    """Numbered ids of the lines of works."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "original"))
    idx = F.col("i") + 1
    return d.select(chunking.numbered_id(F.col("doc_id").cast("string"), idx).alias("id"), idx.alias("idx"), F.length("original").cast("long").alias("n"))


@query()
def f11_chunks(spark, sf_dir):
    """Chunks of every document as a work; tests hold them against hand-made works and a round trip."""
    out = chunking.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", chunking.LATIN_RULES)
    return out.select("id", "work", "idx", F.length("original").alias("n"), F.md5("original").alias("md5"))


@query()
def f05_simple_chunks(spark, sf_dir):
    out = chunking.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", chunking.LATIN_RULES, simple=True)
    return out.select("id", "work", "idx", F.length("original").alias("n"), F.md5("original").alias("md5"))


@query("SELECT 'First' AS work, md5(string_agg(text, chr(10) ORDER BY item_id)) AS md5 FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT 'Second part', md5(string_agg(text, chr(10) ORDER BY item_id)) FROM benchmark WHERE item_id % 2 = 1")
def f06_anthology(spark, sf_dir):
    """Two works under title lines in one text, made of the benchmark's items, taken apart again."""
    b = table(spark, sf_dir, "benchmark")
    half = lambda r: b.where(F.col("item_id") % 2 == r).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "text"))), lambda x: x["text"]), "\n").alias("t"))
    whole = half(0).crossJoin(F.broadcast(half(1).withColumnRenamed("t", "u"))).select(F.concat(F.lit("preface\n  First \n"), "t", F.lit("\nSecond part\n"), "u").alias("text"))
    return chunking.split_anthology(whole, ("First", "Second part")).select("work", F.md5("text").alias("md5"))


STOP = "lambda x: NOT list_contains(['the', 'la', 'die'], x)"


@query(f"""WITH d AS (SELECT doc_id AS id, list_filter({TOKENS_SQL.format('text')}, {STOP}) AS w FROM documents), tot AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
  tf AS (SELECT id, dl, token, count(*) AS f FROM (SELECT id, len(w) AS dl, unnest(w) AS token FROM d) GROUP BY ALL), dfs AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
  raw AS (SELECT token, avgdl, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM dfs, tot), idf AS (SELECT token, avgdl, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
  q AS (SELECT query_id, token, count(*) AS times FROM (SELECT item_id AS query_id, unnest(list_filter({TOKENS_SQL.format('text')}, {STOP})) AS token FROM benchmark) GROUP BY ALL),
  s AS (SELECT query_id, id, round(sum(times * idf * f * 2.5::DOUBLE / (f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score FROM q JOIN idf USING (token) JOIN tf USING (token) WHERE query_id <> id GROUP BY ALL),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s WHERE score > 0) SELECT query_id, id, rank, round(score, 4) AS score FROM r WHERE rank <= 10""")
def j05_bm25_exclude_self(spark, sf_dir):
    """BM25 with stop words; a query leaves out the document of its own id, and the ranks close up."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    own = asked.select("query_id", F.col("query_id").alias("id"))
    return rounded(postings.search(postings.index(docs, ("the", "la", "die")), asked, 10, own)[0], "query_id", "id", "rank", digits=4)


@query("""WITH h AS (SELECT item_id AS query_id, r AS rank, CASE WHEN item_id % 5 = 0 AND r = 3 THEN 1 ELSE r END AS id FROM benchmark, range(1, 4) t(r) WHERE NOT (item_id % 7 = 0 AND r = 2)) SELECT query_id FROM h GROUP BY 1 HAVING max(rank) <> count(*) OR count(DISTINCT rank) <> count(*) OR count(DISTINCT id) <> count(*)""")
def w03_rank_check(spark, sf_dir):
    """Queries of hits with gaps or repeated ids, which are put in by id."""
    h = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("rank")).where("not (query_id % 7 = 0 and rank = 2)")
    return retrieval.check_ranks(h.withColumn("id", F.when((F.col("query_id") % 5 == 0) & (F.col("rank") == 3), 1).otherwise(F.col("rank")))).select("query_id")


@query("""WITH p AS (SELECT n_nationkey AS key, n_regionkey AS region FROM nation), a AS (SELECT item_id AS asked_key FROM benchmark), j AS (SELECT asked_key, key, region, md5('42:' || asked_key || ':1:' || key) AS h FROM a JOIN p ON asked_key <> key),
  t AS (SELECT *, row_number() OVER (PARTITION BY asked_key, region ORDER BY h, key) AS turn FROM j), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY asked_key ORDER BY turn, h, key) AS INTEGER) AS place FROM t) SELECT asked_key, key, place FROM r WHERE place <= 3""")
def w08_example_rotation(spark, sf_dir):
    """Examples of a small pool (the nations, by region) for every benchmark item."""
    pool = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("region"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("key"))
    return sampling.examples(pool, asked, "key", "region", 1)


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 25")
def t04_first_rows(spark, sf_dir):
    """The first rows in a stated order."""
    return table(spark, sf_dir, "documents").select("doc_id", "source").orderBy("doc_id").limit(25)


# Scans and sinks: what is written is read again under the operator's own checks.


@query(f"WITH {PAIRS_SQL} SELECT pair_id AS id, work::VARCHAR AS work, src AS vernacular FROM pairs WHERE work < 3")
def s01_jsonl_split(spark, sf_dir):
    """Pairs written as JSON Lines and read under their schema, one split of them."""
    path = folder(spark, "pairs")
    p = pairs(spark, sf_dir)
    split = F.when(F.col("work") < 3, "train").otherwise("eval")
    records.overwrite_jsonl(p.select(F.col("pair_id").alias("id"), F.col("work").cast("string").alias("work"), F.lit(1).alias("idx"), F.col("src").alias("vernacular"), F.col("out").alias("original"), split.alias("split")), path)
    return records.read_jsonl(spark, path, records.PAIR, split="train").select("id", "work", "vernacular")


@query(f"WITH {PAIRS_SQL} SELECT pair_id AS id, out AS output, 'unknown' AS model, 'baseline' AS pipeline, 42 AS seed FROM pairs")
def s03_last_generation(spark, sf_dir):
    """Generations appended twice to one file: the last row of an id counts, with defaults for what it lacks."""
    path = folder(spark, "generations")
    p = pairs(spark, sf_dir).select(F.col("pair_id").alias("id"), F.explode(F.array(F.struct(F.lit(1).alias("turn"), F.col("src").alias("output")), F.struct(F.lit(2).alias("turn"), F.col("out").alias("output")))).alias("x"))
    records.overwrite_jsonl(p.select("id", "x.*").coalesce(1).sortWithinPartitions("turn", "id").select("id", "output"), path)
    return records.read_generations(spark, path)


@query("SELECT 3 AS line, 'no record of the schema' AS reason UNION ALL SELECT 5, 'lacks id'")
def s20_bad_lines(spark, sf_dir):
    """A file with a broken third and an incomplete fifth line, reported by number."""
    path = folder(spark, "cases")
    spark.createDataFrame([('{"id":"a","domain":"x","seed":1,"vernacular":""}\n\n{broken\n{"id":"b"}\n{"domain":"x"}',)], "value string").write.text(path)
    return records.bad_lines(spark, path, records.HUMAN_CASE, ("id",)).select(F.col("line").cast("int").alias("line"), "reason")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def s08_embedding_cache(spark, sf_dir):
    """A cache written with its provenance and read under the same one; a text stands for each id."""
    path = folder(spark, "cache")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("text"), "embedding")
    vectors.write_cache(rows, path, "model", "r1", 64, 512)
    back = vectors.read_cache(spark, path, rows.select("id", "text"), model_id="model", revision="r1", dim=64, max_length=512)
    return back.select(F.col("id").alias("vec_id"), F.round(style.array_sum(F.col("embedding")), 6).alias("total"))


@query("""SELECT 'another revision' AS problem, count(*) AS n FROM embeddings WHERE vec_id % 10 <> 1 UNION ALL SELECT 'another text', count(*) FROM embeddings WHERE vec_id % 10 = 3
UNION ALL SELECT 'not in the cache', count(*) FROM embeddings WHERE vec_id % 10 = 1 UNION ALL SELECT 'only in the cache', count(*) FROM embeddings WHERE vec_id % 10 = 2""")
def s08_cache_problems(spark, sf_dir):
    """Every kind of mismatch between a cache and what it is asked for."""
    path = folder(spark, "cache")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("text"), "embedding")
    vectors.write_cache(rows.where("id % 10 <> 1"), path, "model", "r1", 64, 512)
    asked = rows.where("id % 10 <> 2").withColumn("text", F.when(F.col("id") % 10 == 3, "other").otherwise(F.col("text")))
    return vectors.cache_problems(vectors.load(spark, path), asked, model_id="model", revision="r2", dim=64, max_length=512).select("problem", "n")


@query("SELECT item_id AS query_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM benchmark JOIN embeddings ON vec_id = item_id")
def s10_query_vectors(spark, sf_dir):
    """Query vectors by the hash of the query's text, from a cache of the index's encoder."""
    path, index = folder(spark, "queries"), folder(spark, "index")
    b = table(spark, sf_dir, "benchmark")
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    vectors.write_cache(b.join(e, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("id"), "text", "embedding"), path, "model", "r1", 64, 512)
    vectors.write_cache(e.select(F.col("vec_id").alias("id"), F.col("vec_id").cast("string").alias("text"), "embedding"), index, "model", "r1", 64, 512)
    got = vectors.query_vectors(b.select(F.col("item_id").alias("query_id"), "text"), vectors.load(spark, path), vectors.load(spark, index))
    return got.select("query_id", F.round(style.array_sum(F.col("q")), 6).alias("total"))


@query("SELECT 'ok.txt' AS name, 'plain text' AS text, NULL AS skipped UNION ALL SELECT 'large.txt', NULL, 'too large' UNION ALL SELECT 'binary.bin', NULL, 'binary' UNION ALL SELECT 'latin.txt', NULL, 'not UTF-8'")
def s16_guarded_texts(spark, sf_dir):
    """Files read only if they are small, without NUL and UTF-8; the others with the reason."""
    path = folder(spark, "files")
    files = {"ok.txt": b"plain text", "large.txt": b"x" * 2000, "binary.bin": b"a\x00b", "latin.txt": b"\xe9t\xe9"}
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for name, content in files.items():
        at = hadoop.Path(f"{path}/{name}")
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
        out.write(bytearray(content))
        out.close()
    got = records.read_guarded(spark, path, 1000)
    return got.select(F.element_at(F.split("location", "/"), -1).alias("name"), "text", "skipped")


@query("SELECT 'equal' AS config, item_id::VARCHAR AS id, (item_id + 1)::VARCHAR AS exemplar_id, 1 AS rank FROM benchmark UNION ALL SELECT 'style', item_id::VARCHAR, (item_id + 2)::VARCHAR, 1 FROM benchmark")
def s17_plan_scan(spark, sf_dir):
    """A plan document written as JSON and read as a row an exemplar."""
    path = folder(spark, "plan")
    b = table(spark, sf_dir, "benchmark")

    def of(step: int) -> Column:
        x = F.array(F.struct((F.col("item_id") + step).cast("string").alias("id"), F.lit(1).alias("rank"), F.lit(0.5).alias("score"), F.create_map(F.lit("bm25"), F.lit(1)).alias("sources")))
        return F.collect_list(F.struct(F.col("item_id").cast("string").alias("id"), F.lit("w").alias("work"), x.alias("exemplars")))  # a plan is small

    b.agg(of(1).alias("equal"), of(2).alias("style")).select(F.struct("equal", "style").alias("plans")).write.json(path)
    return records.read_plan(spark, path).select("config", "id", "exemplar_id", "rank")


@query(f"WITH {PAIRS_SQL} SELECT pair_id AS id, CASE WHEN {pick_sql(9, 'pair_id')} = 0 THEN 'sha256:' || sha256(src) END AS reported, 'sha256:' || sha256(out) AS own FROM pairs WHERE {pick_sql(9, 'pair_id')} < 2 AND NOT ({pick_sql(9, 'pair_id')} = 0 AND src = out)")
def j18_report_mismatches(spark, sf_dir):
    """Outputs that a report describes otherwise (by id), or not at all (by id)."""
    from .plans import experiments

    p = pairs(spark, sf_dir).select(F.col("pair_id").alias("id"), "src", F.col("out").alias("output"), pick(9, "pair_id").alias("k"))
    told = p.where("k <> 1").select("id", text.sha(F.when(F.col("k") == 0, F.col("src")).otherwise(F.col("output")), "sha256:").alias("output_hash"))
    return experiments.report_mismatches(told, p)


@query(f"WITH {PAIRS_SQL} SELECT pair_id, CASE WHEN {pick_sql(3, 'src')} = 0 THEN 'cached' ELSE 'new' END AS answer FROM pairs")
def j14_memo(spark, sf_dir):
    """Answers from a memo by the hash of the prompt, the missing ones computed once a distinct prompt."""
    p = pairs(spark, sf_dir).select("pair_id", F.sha2("src", 256).alias("key"), pick(3, "src").alias("k"))
    memo = p.where("k = 0").select("key", F.lit("cached").alias("answer")).distinct()
    return vectors.memoized(p, memo, "key", "answer", lambda missing: missing.withColumn("answer", F.lit("new")))[0].select("pair_id", "answer")


@query(f"WITH {PAIRS_SQL} SELECT pair_id FROM pairs WHERE {pick_sql(3, 'pair_id')} <> 0")
def j06_resume_remaining(spark, sf_dir):
    """What a run that starts again still has to do."""
    from .plans import experiments

    p = pairs(spark, sf_dir).select("pair_id")
    return experiments.remaining(p, p.where(pick(3, "pair_id") == 0), ["pair_id"])


@query(f"""WITH {PAIRS_SQL}, k AS (SELECT pair_id, {pick_sql(20, 'pair_id')} AS k FROM pairs) SELECT pair_id, 'repeats' AS error FROM k WHERE k = 0 UNION ALL SELECT pair_id, 'another digest' FROM k WHERE k = 1 UNION ALL SELECT pair_id || 'x', 'not in the plan' FROM k WHERE k = 2""")
def s14_row_errors(spark, sf_dir):
    """Written rows that repeat, are in no plan, or have another digest; the faults are put in by id."""
    p = pairs(spark, sf_dir).select("pair_id", F.md5("src").alias("expected"), pick(20, "pair_id").alias("k"))
    key = F.when(F.col("k") == 2, F.concat("pair_id", F.lit("x"))).otherwise(F.col("pair_id"))
    digest = F.when(F.col("k") == 1, "other").otherwise(F.col("expected"))
    rows = p.select(key.alias("pair_id"), digest.alias("digest"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("k") == 0, 2).otherwise(1))).alias("_"))
    return gates.row_errors(rows, p, "pair_id", "digest", "expected")
