"""Hand-computed expectations on inline texts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stylarium import plugins, service
from stylarium.functions import fidelity, numerals, style, surface, text
from stylarium.operators import agent, chunking, gates, leak, lexicon, retrieval, sampling, stats
from stylarium.plans import evaluation, experiments, loop, retrieval_plan
from stylarium.sources import records, reports, vectors
from stylarium.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def profile_of(spark, t):
    return style.style_features(spark.createDataFrame([(1, t)], "doc_id long, text string")).first().asDict()


def test_style_features(spark):
    p = profile_of(spark, "甲乙。丙丁戊。")
    assert (p["sent_len_mean"], p["sent_len_std"], p["period_ratio"]) == (2.5, 0.5, 1.0)
    assert abs(p["sent_len_p90"] - 2.9) < 1e-9 and abs(p["para_density"] - 100 / 7) < 1e-9
    p = profile_of(spark, "甲，乙。")
    assert (p["comma_ratio"], p["period_ratio"], p["sent_len_mean"], p["sent_len_std"]) == (0.5, 0.5, 3.0, 0.0)
    assert profile_of(spark, "「甲乙」")["quote_density"] == 50
    assert profile_of(spark, "他说道。")["dialogue_verb_density"] == 50
    assert profile_of(spark, "他好像走。")["simile_density"] == 20
    assert profile_of(spark, "仿佛相似。")["simile_density"] == 40
    p = profile_of(spark, "他的书在桌上了。")
    assert [p[f"fw_{i}"] for i in range(1, 8)] == [12.5, 12.5, 0, 0, 0, 0, 0]
    p = profile_of(spark, "甲乙。\n\n丙丁。")
    assert (p["para_density"], p["sent_len_mean"]) == (25, 2)
    assert [profile_of(spark, t)["cjk_numeral_ratio"] for t in ("第四天", "第４天", "三4", "无")] == [1, 0, 0.5, 0]
    assert all(profile_of(spark, "")[c] == 0 for c in style.NAMES)
    p = profile_of(spark, "，。！")
    assert abs(p["comma_ratio"] - 1 / 3) < 1e-9 and p["sent_len_mean"] == 0


def test_gaps(spark):
    df = spark.createDataFrame([([1.0, -2.0],), ([-1.0, 2.0],)], "delta array<double>")
    assert style.set_gap(df).first()["profile_gap"] == 0
    assert [r["g"] for r in df.select(style.gap_per_case(F.col("delta")).alias("g")).collect()] == [1.5, 1.5]


def test_lexicon(spark):
    o = spark.createDataFrame([("书面", 3), ("两边", 3), ("太少", 2)], "token string, n long")
    v = spark.createDataFrame([("口语", 3), ("两边", 1), ("口语少", 2)], "token string, n long")
    got = {r["token"]: (r["side"], r["score"]) for r in lexicon.log_odds_lexicon(o, v).collect()}
    assert got == {"书面": ("literary", math.log(4)), "口语": ("colloquial", math.log(0.25))}


def test_surface(spark):
    texts = [("甲甲丙丙丙", "甲乙"), ("甲乙", "甲甲丙丙丙"), ("甲", "甲乙"), ("甲乙", "甲"), ("甲，乙1", "甲乙"), ("甲乙", "甲乙丙")]
    p = surface.gram_measures(spark.createDataFrame([(i, s, o) for i, (o, s) in enumerate(texts)], "id int, s string, o string"), "id", "s", "o", (1, 2)).orderBy("id").collect()
    assert abs(p[0]["pinc1"] - 0.6) < 1e-9
    assert p[1]["pinc1"] == 0.5
    assert p[2]["pinc2"] is None and p[3]["pinc2"] == 1
    assert p[4]["pinc2"] == 0
    assert p[5]["overlap2"] == 0.5
    assert one(spark, surface.text_similarity(F.lit("tide"), F.lit("diet"))) == 0.5
    pairs = spark.createDataFrame([(1, "甲，乙", "甲乙"), (2, "甲", ""), (3, "甲乙丙丁戊", "甲乙丙丁己")], "id int, s string, o string")
    got = {r["id"]: r for r in surface.gram_measures(pairs, "id", "s", "o").collect()}
    assert abs(got[1]["bleu"] - 100) < 1e-9 and got[2]["bleu"] == 0 and got[2]["pinc1"] is None and got[2]["pinc_mean"] is None
    assert got[3]["pinc4"] == 0.5 and got[3]["overlap4"] == 0.5 and abs(got[3]["bleu"] - 100 * (4 / 5 * 3 / 4 * 2 / 3 * 1 / 2) ** 0.25) < 1e-9
    empty, ab = F.array().cast("array<string>"), F.array(F.lit("a"), F.lit("b"))
    assert one(spark, surface.recall(empty, ab)) == 1 and one(spark, surface.hallucination(ab, empty)) == 0
    assert one(spark, surface.jaccard(empty, empty)) == 1
    assert one(spark, F.size(text.windows(F.lit("甲乙丙丁"), 4))) == 1 and one(spark, F.size(text.windows(F.lit("甲乙丙"), 4))) == 0
    with pytest.raises(ValueError):
        text.grams(F.lit("a"), 0)


def test_violations(spark):
    a = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    got = one(spark, surface.violations({"entities": a("n"), "numerals": a("3"), "titles": a("t")}, {"entities": a("m"), "numerals": a(), "titles": a("u")}))
    assert [(v["kind"], v["expected"], v["actual"]) for v in got] == [("entity_missing", "n", None), ("numeral_missing", "3", None), ("entity_hallucination", None, "m"), ("title", "t", "u")]
    assert [v["kind"] for v in one(spark, agent.feedback_order(surface.violations({"entities": a("n"), "numerals": a("3"), "titles": a("t")}, {"entities": a("m"), "numerals": a(), "titles": a("u")})))] == list(agent.KIND_ORDER)


@pytest.mark.parametrize(
    ("t", "keys"),
    [("十万人", {"100000"}), ("万人", {"10000"}), ("三月初九", {"3", "9"}), ("四斤米", {"4"}), ("二十人", {"20"}), ("一百二十斤", {"120"}), ("三辆马车", {"3"}), ("３辆马车", {"3"}), ("第一次", {"第1"}), ("上万人", {"上:10000"}), ("零零碎碎", set()), ("四太太来了", {"第4"}), ("一个杯子", set()), ("一百五人", {"150"}), ("一百零五人", {"105"})],
)
def test_numerals(spark, t, keys):
    assert set(one(spark, numerals.numeral_keys(numerals.quantities(F.lit(t))))) == keys


@pytest.mark.parametrize(
    ("t", "hits"),
    [
        ("四太太和四太太", [("ordinal", "第4", "四太太")]),
        ("上三百人", []),
        ("上第三次", [("ordinal", "第3", "上第三次")]),
        ("上一百人", [("cardinal", "上:100", "上一百人")]),
        ("第３天", [("ordinal", "第3", "第３天")]),
        ("零零人，十百斤", [("unparsed", "零零人", "零零人"), ("unparsed", "十百斤", "十百斤")]),
        ("四两", [("cardinal", "4", "四两")]),
        ("初三", [("cardinal", "3", "初三")]),
        ("", []),
    ],
)
def test_quantity_hits(spark, t, hits):
    assert [(h["bucket"], h["key"], h["surface"]) for h in one(spark, numerals.quantities(F.lit(t)))] == hits


@pytest.mark.parametrize(
    ("n", "value"),
    [("十", "10"), ("二十三", "23"), ("一百零五", "105"), ("一百五", "150"), ("万", "10000"), ("一万五", "15000"), ("三万二千", "32000"), ("一亿二千万", "120000000"), ("两千零一", "2001"), ("007", "7"), ("0", "0"), ("一九八四", "1984"), ("零零", None), ("十百", None), ("百万", "1000000")],
)
def test_number_text(spark, n, value):
    assert one(spark, numerals.number_text(F.lit(n))) == value


def test_numeric_values(spark):
    v = one(spark, numerals.numeric_values(F.lit("三点五斤，一个，第二，那一，２０年，颂莲一斤"), F.array(F.lit("颂莲"))))
    assert v["values"] == ["1", "2", "20", "3.5"] and v["waivers"] == ["一个"] and "二" in v["chinese_forms"] and not v["unparsed"]


def test_mentions(spark):
    names = lambda *n: numerals.names_array(n)
    assert one(spark, numerals.mentions(F.lit("ab abc"), names("ab", "abc", "c"))) == ["ab", "abc"]
    assert one(spark, numerals.mentions(F.lit("ABCD"), names("AB", "BCD"))) == ["BCD"]
    assert one(spark, numerals.mask(F.lit("xabcx"), names("ab", "abc"))) == "x   x"


def test_facts(spark):
    dims = fidelity.Dimensions(names=("颂莲", "陈佐千"), words=("佐千", "雁儿", "丞相"), titles=("丞相",))
    f = one(spark, fidelity.facts(F.lit("颂莲对陈佐千说，雁儿见过丞相三次"), dims))
    assert (f["entities"], f["titles"], f["numerals"]) == (["陈佐千", "雁儿", "颂莲"], ["丞相"], ["3"])
    df = spark.createDataFrame([(1, "颂莲见丞相三次", "颂莲见太监四次")], "id int, s string, o string")
    r = fidelity.assess(df, "s", "o", fidelity.Dimensions(names=("颂莲",)), ("id",)).first()
    assert (r["entity_recall"], r["numeral_recall"], r["hallucination_rate"]) == (1.0, 0.0, 0.0)
    assert [(v["kind"], v["expected"], v["actual"]) for v in r["violations"]] == [("numeral_missing", "三次", None), ("title", "丞相", "太监")]
    tagger = fidelity.dictionary_tagger({"雁儿": "nr", "说": "v"})
    assert one(spark, tagger(F.lit("雁儿说"))) == ["雁儿"]
    words = spark.createDataFrame([("登基", 1, True), ("雁儿", 1, True), ("白痴", 242, True), ("碎", 1, True), ("断片", 1, False), ("颂莲说", 1, True)], "word string, frequency int, stable boolean")
    assert [r["word"] for r in fidelity.supplement(words, ("颂莲",)).collect()] == ["雁儿"]
    assert abs(one(spark, fidelity.dialogue_density(F.lit("甲乙。“丙丁”。"))) - 0.5) < 1e-9


def test_contained(spark):
    df = spark.createDataFrame([(1, "abcabc"), (2, None), (3, "")], "id int, t string")
    terms = spark.createDataFrame([("bca",), ("c",), ("zz",), ("",)], "term string")
    assert sorted((r["id"], r["term"]) for r in fidelity.contained(df, "id", "t", terms, "term").collect()) == [(1, "bca"), (1, "c")]


def test_measures(spark):
    df = spark.createDataFrame([(1, "颂莲吃了三斤米", "颂莲吃了四斤米仿佛")], "id int, s string, o string")
    m = fidelity.measures(df, "id", "s", "o", F.array(F.lit("颂莲")), F.array(F.lit("仿佛"), F.lit("颂"))).first()
    assert m["entity_recall"] == 1 and m["numeral_recall"] == 0 and m["added_values"] == ["4"] and m["banned_residue"] == ["仿佛"]
    both = spark.createDataFrame([m], fidelity.measures(df, "id", "s", "o", F.array(F.lit("颂莲")), F.array(F.lit("仿佛"))).schema)
    got = experiments.two_pass(both, both).first()["reasons"].split(",")
    assert "numeral_missing" in got and "numeral_added" in got and "literary_residue" in got


RULES = chunking.Rules(target=6, least=4, most=8)


def letters(t):
    return chunking.size_of(t, RULES)


def test_chunk_sizes():
    rng = np.random.default_rng(3)
    for _ in range(200):
        t = "".join(rng.choice(list("甲乙丙丁戊，。！\n"), int(rng.integers(0, 120)), p=[0.15] * 5 + [0.1, 0.1, 0.03, 0.02]))
        got = chunking.chunk_text(t, RULES)
        # Nothing but white space goes, and no chunk exceeds the greatest size.
        assert "".join("".join(got).split()) == "".join(t.split())
        assert all(letters(c) <= RULES.most for c in got)


def test_chunk_rules():
    assert chunking.long_pieces("甲乙丙丁，戊己庚辛，壬癸。", RULES) == ["甲乙丙丁，戊己庚辛，", "壬癸。"]
    assert chunking.long_pieces("甲乙丙丁戊己庚辛壬癸", RULES) == ["甲乙丙丁戊己庚辛", "壬癸"]
    assert chunking.sections("甲\n\n乙\n※※※\n丙\n某人\n丁", chunking.Rules(authors=("某人",))) == [["甲", "乙"], ["丙", "丁"]]
    assert chunking.sections("第十章\n甲\n第2回\n乙") == [["甲"], ["乙"]]
    assert chunking.pack_section(["甲乙丙丁。戊己庚辛。", "壬癸。"], RULES) == ["甲乙丙丁。", "戊己庚辛。\n壬癸。"]
    assert chunking.rebalance(["甲乙丙丁戊。己。", "庚。"], RULES) == ["甲乙丙丁戊。己。", "庚。"]
    assert chunking.rebalance(["甲乙。丙丁。戊己。", "庚辛。"], RULES) == ["甲乙。丙丁。", "戊己。\n庚辛。"]
    assert chunking.simple_chunks("甲" * 240 + "。" + "乙" * 20 + "。" + "丙" * 50 + "。") == ["甲" * 240 + "。" + "乙" * 20 + "。" + "丙" * 50 + "。"]


def test_chunks(spark):
    works = spark.createDataFrame([("w", "甲乙丙丁。戊己庚辛。"), ("none", None), ("empty", "")], "work string, text string")
    got = chunking.chunks(works, rules=RULES).collect()
    assert [(r["id"], r["idx"], r["original"]) for r in got] == [("w_0001", 1, "甲乙丙丁。"), ("w_0002", 2, "戊己庚辛。")]
    texts = spark.createDataFrame([("x\nB A\nmore\n A \nrest",)], "text string")
    assert sorted(map(tuple, chunking.split_anthology(texts, ("A", "B A")).collect())) == [("A", "rest"), ("B A", "more")]
    with pytest.raises(ValueError, match="lack"):
        chunking.split_anthology(texts, ("A", "C"))
    with pytest.raises(ValueError, match="repeat"):
        chunking.split_anthology(spark.createDataFrame([("A\nx\nA\ny",)], "text string"), ("A",))


def test_records(spark, tmp_path):
    p = tmp_path / "rows.jsonl"
    p.write_text('{"id":"a","work":"w","extra":1,"split":"train"}\n\n{"id":"b","split":"eval"}\n', encoding="utf-8")
    assert [r["id"] for r in records.read_jsonl(spark, str(p), records.PAIR, split="eval").collect()] == ["b"]
    with pytest.raises(ValueError, match="no rows"):
        records.read_jsonl(spark, str(p), records.PAIR, split="other")
    p.write_text('{"id":"a"}\n\n{"id":\n{"work":"w"}\n', encoding="utf-8")
    with pytest.raises(ValueError, match=r":3: no record.*:4: lacks id"):
        records.read_jsonl(spark, str(p), records.PAIR)
    words = tmp_path / "stop.txt"
    words.write_text("# c\n的\n\n了\n", encoding="utf-8")
    assert records.read_words(str(words)) == ["的", "了"]
    words.write_text("# c\n", encoding="utf-8")
    with pytest.raises(ValueError):
        records.read_words(str(words))
    (tmp_path / "works").mkdir()
    (tmp_path / "works" / "甲.txt").write_text("甲\r\n正文裏\n", encoding="utf-8")
    assert [tuple(r) for r in records.read_works(spark, str(tmp_path / "works")).collect()] == [("甲", "正文里")]
    split = tmp_path / "split.json"
    split.write_text('{"seed": 1, "train": ["a", "b"], "eval": ["c"]}', encoding="utf-8")
    assert sorted(map(tuple, records.read_split(spark, str(split)).collect())) == [("a", "train"), ("b", "train"), ("c", "eval")]
    assert records.read_dimension(str(split), "eval") == ["c"]
    salvaged = tmp_path / "salvaged.jsonl"
    salvaged.write_text('{"id":"a","original":"甲乙"}\n{"id":"b","maybe_truncated":true}\n{"id":"c"}\n', encoding="utf-8")
    assert [(r["id"], r["n_letters"]) for r in records.read_salvaged(spark, str(salvaged), ["c"]).collect()] == [("a", 2)]


def test_reports(tmp_path):
    path = tmp_path / "r" / "x.json"
    reports.write_json({"b": float("nan"), "a": {"z": 1, "甲": 0.5}}, str(path))
    assert path.read_text(encoding="utf-8") == '{\n  "a": {\n    "z": 1,\n    "甲": 0.5\n  },\n  "b": null\n}\n'
    assert reports.markdown([{"a": 0.5, "b": None}], ("a", "b")).splitlines()[-1] == "| 0.500000 | — |"
    assert reports.nested([{"x": 1, "y": "a", "v": 2}], ("x", "y")) == {"1": {"a": {"v": 2}}}


def test_vectors(spark, tmp_path):
    rows = spark.createDataFrame([("a", "t", [1.0, 0.0]), ("b", "u", [0.0, 1.0])], "id string, text string, embedding array<double>")
    vectors.write_cache(rows, str(tmp_path / "c"), "m", "r", 2, 8)
    assert vectors.read_cache(spark, str(tmp_path / "c"), rows, model_id="m", revision="r", dim=2, max_length=8).count() == 2
    with pytest.raises(ValueError, match="another model_id: 2"):
        vectors.read_cache(spark, str(tmp_path / "c"), rows, model_id="x")
    with pytest.raises(Exception, match="zero"):
        vectors.write_cache(rows.withColumn("embedding", F.array(F.lit(0.0), F.lit(0.0))), str(tmp_path / "d"), "m", "r", 2, 8)
    cache = vectors.load(spark, str(tmp_path / "c"))
    with pytest.raises(Exception, match="no vector"):
        vectors.query_vectors(spark.createDataFrame([(1, "other")], "query_id int, text string"), cache, cache).collect()
    asked = spark.createDataFrame([(1, "k"), (2, "l"), (3, "l")], "id int, key string")
    memo = spark.createDataFrame([("k", "old")], "key string, value string")
    got, fresh = vectors.memoized(asked, memo, "key", "value", lambda m: m.withColumn("value", F.lit("new")))
    assert [r["value"] for r in got.orderBy("id").collect()] == ["old", "new", "new"] and fresh.count() == 1
    with pytest.raises(ValueError, match="several"):
        vectors.memoized(asked, memo.union(spark.createDataFrame([("k", "x")], memo.schema)), "key", "value", lambda m: m)
    assert [r["y"] for r in vectors.complete(asked, "key", "y", lambda: lambda xs: [x.upper() for x in xs]).orderBy("id").collect()] == ["K", "L", "L"]


def test_running(spark):
    df = spark.createDataFrame([(i % 3 if i % 7 else None, (i * 37) % 50, i) for i in range(300)], "s int, v int, id int")
    want: dict = {}
    for s, v, i in sorted(((r["s"], r["v"], r["id"]) for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])):
        want.setdefault(s, []).append((v, i))
    for r in sampling.placed(df, "s", "v", "id").collect():
        assert want[r["s"]][r["place"] - 1] == (r["v"], r["id"])
    q = stats.quantiles(df, "v", [0.0, 0.25, 0.9, 1.0], ["s"])
    for r in q.collect():
        assert np.allclose(r["q"], np.quantile([v for v, _ in want[r["s"]]], [0, 0.25, 0.9, 1]))
    assert abs(stats.seven_numbers(df, "v", large=True).first()["median"] - np.median(df.toPandas()["v"])) < 1e-9
    from plain_ranks import spearman_of

    got = stats.spearman(df.where("s is not null"), "v", "id", ["s"]).collect()
    for r in got:
        assert abs(r["spearman"] - spearman_of(want[r["s"]])) < 1e-9
    b = stats.bootstrap_counts(df.withColumn("g", F.lit("x")), "v", "id", "g", 400).first()
    exact = stats.exact_bootstrap(np.array([r["v"] for r in df.collect()]), 4000)
    assert abs(b["low"] - exact[1]) < 1 and abs(b["high"] - exact[2]) < 1


def test_plan_guards(spark):
    with pytest.raises(ValueError, match="unknown routes"):
        retrieval_plan.config_table(spark, {"x": {"other": 1.0}})
    with pytest.raises(ValueError, match="finite"):
        retrieval_plan.config_table(spark, {"x": {"bm25": -1.0}})
    a, b = spark.range(3), spark.range(2)
    with pytest.raises(ValueError, match="lacks"):
        retrieval_plan.require_same_ids({"a": a, "b": b})
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "id string, n int, d string")
    with pytest.raises(ValueError, match="repeats"):
        gates.require_unique(rows, "id")
    with pytest.raises(ValueError, match="differ"):
        experiments.require_baseline(rows.select("id", F.col("d").alias("output")).limit(1), rows.select("id", F.lit("z").alias("output")).limit(1))
    gates.require_same_experiment(rows, rows, ("id", "n"))
    cases = spark.createDataFrame([("a", "v", "o"), ("b", "v", "")], "id string, vernacular string, original string")
    with pytest.raises(ValueError, match="originals"):
        evaluation.joined_cases(cases, cases.select("id", F.lit("x").alias("output"), F.lit("m").alias("model")))
    with pytest.raises(ValueError, match="partner"):
        evaluation.joined_cases(cases, cases.limit(0).select("id", F.lit("x").alias("output"), F.lit("m").alias("model")))


def test_evaluate(spark):
    rows = [(str(i), f"颂莲走了。第{i}天她说了三句话。", f"颂莲走去，第{i}天说三句话。") for i in range(1, 6)]
    cases = spark.createDataFrame(rows, "id string, vernacular string, original string")
    out = cases.select("id", F.concat("original", F.lit("完。")).alias("output"), F.lit("m").alias("model"))
    reference = style.fit_reference(style.style_features(cases, "original", ("id",)))
    per_case, report = evaluation.evaluate(cases, out, reference, fidelity.Dimensions(names=("颂莲",)), "run")
    assert report["n_cases"] == 5 and report["model"] == "m" and report["aggregate"]["entity_recall"] == 1.0 and report["aggregate"]["ppl"] is None
    assert abs(report["aggregate"]["profile_gap"] - sum(abs(v) for v in report["profile_mean_delta"].values()) / 20) < 1e-12
    control = per_case.withColumn("hallucination_rate", F.lit(1.0))
    judged = evaluation.compare(per_case, control, {"hallucination_rate": "lower", "copy_ratio": None}, draws=100)
    got = {r["metric"]: r["verdict"] for r in judged.collect()}
    assert got == {"hallucination_rate": "improved", "copy_ratio": None} and evaluation.exit_condition(judged).first()["met"]
    whole = evaluation.summary({"main": report, "control": report}, "main", "control", judged)
    assert [g["role"] for g in whole["groups"]] == ["primary", "control"] and "| metric |" in evaluation.summary_markdown(whole)
    assert evaluation.changed_cases(per_case, control).first()["changed"] == 0


def test_loop_fallbacks(spark):
    empty = F.expr("cast(array() as array<struct<id:string,plain:string,styled:string>>)")
    requests = spark.createDataFrame([("a", "in a"), ("b", "in b"), ("c", "in c")], "id string, input string").withColumn("exemplars", empty)

    def generate(df):
        text = F.when(F.col("id") == "a", F.lit(" ")).when((F.col("id") == "c") & (F.col("iter") == 0), F.lit("first"))
        return df.withColumn("text", text).withColumn("error", F.when(F.col("id") == "b", "E").when((F.col("id") == "c") & (F.col("iter") > 0), "E"))

    v = F.array(F.struct(F.lit("entity_missing").alias("kind"), F.lit("x").alias("expected"), F.lit(None).cast("string").alias("actual")))
    got = {r["id"]: r for r in loop.run(requests, generate, lambda df: df.withColumn("violations", v), lambda df: df.withColumn("score", F.lit(-1.0))).collect()}
    assert [(got[i]["output"], got[i]["selected_round"], got[i]["total_rounds"], got[i]["termination"], got[i]["fallback_kind"]) for i in "abc"] == [
        ("in a", None, 3, "fallback", "all_blank"),
        ("in b", None, 1, "fallback", "first_round_error"),
        ("first", 1, 2, "fallback", "later_round_error"),
    ]
    assert all("in " not in t and "first" not in t for r in got.values() for t in r["trace"])


def test_sweep_and_pools(spark):
    asked = spark.createDataFrame([("a", "in a"), ("b", "in b")], "id string, vernacular string")
    shown = spark.createDataFrame([(c, i, [("x", "px", "sx")]) for c in ("content", "style") for i in "ab"], "config string, id string, exemplars array<struct<id:string,plain:string,styled:string>>")
    prompts = experiments.job_prompts(asked, shown, experiments.jobs(spark, ("content", "style"), 1), "s")
    calls = []

    def compute(missing):
        calls.append(missing.count())
        return missing.withColumn("output", F.substring("digest", 1, 6))

    baseline = prompts.where("name = 'retrieval-k0'")
    rows = experiments.sweep(prompts, baseline.select("id", F.substring("digest", 1, 6).alias("output")), compute).collect()
    assert calls == [2, 2] and len(rows) == 6  # both configurations show the same, so their prompts are computed once
    with pytest.raises(ValueError, match="differ"):
        experiments.sweep(prompts, baseline.select("id", F.lit("x").alias("output")), compute)
    pool = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, t string")
    assert sampling.leave_one_out(pool, "id", "t", 2).count() == 6
    with pytest.raises(ValueError, match="another size"):
        sampling.leave_one_out(pool, "id", "t", 12)
    with pytest.raises(Exception, match="too few"):
        experiments.job_prompts(asked, shown, experiments.jobs(spark, ("content",), 2), "s").collect()


def test_attempts(spark):
    chunks = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, original string")

    def generate(rows, attempt):
        return rows.withColumn("output", F.concat("original", F.lit(str(attempt)))).withColumn("model", F.lit("m"))

    def gate(rows):
        return rows.withColumn("reasons", F.when((F.col("id") == "b") & (F.col("attempt") < 3), "length").otherwise(""))

    accepted, records_ = experiments.attempts(chunks, generate, gate)
    assert sorted((r["id"], r["attempt"]) for r in accepted.collect()) == [("a", 1), ("b", 3)] and records_.count() == 4
    assert [r["feedback"] for r in records_.where("id = 'b'").orderBy("attempt").collect()] == ["", "length", "length"]
    assert one(spark, experiments.repaired_json(F.lit('so:\n```json\n{"a": 1}\n```'), "a int"))["a"] == 1


def test_dimensions(spark, tmp_path):
    import json
    import subprocess

    path = tmp_path / "reference.json"
    path.write_text(json.dumps({"feature_names": list(style.NAMES), "n_texts": 3, "mean": [0.0] * 20, "std": [1.0] * 20}), encoding="utf-8")
    z = style.z_scores(style.style_features(spark.createDataFrame([(1, "甲乙。")], "doc_id int, text string")), records.read_reference(spark, str(path))).first()["z"]
    assert z[0] == 2.0
    path.write_text('{"feature_names": [], "mean": [], "std": [], "n_texts": 0}', encoding="utf-8")
    with pytest.raises(ValueError):
        records.read_reference(spark, str(path))
    path.write_text('{"entities": [{"name": "颂莲", "kind": "person", "works": []}]}', encoding="utf-8")
    assert records.read_names(str(path)) == [("颂莲", "person")]
    path.write_text('{"literary": {"书面": 1.5}, "colloquial": {}}', encoding="utf-8")
    assert records.read_lexicon(str(path))["literary"] == {"书面": 1.5}
    repo = tmp_path / "repo"
    repo.mkdir()
    (repo / "a.txt").write_text("old", encoding="utf-8")
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "1")
    (repo / "a.txt").write_text("new", encoding="utf-8")
    git("commit", "-qam", "2")
    assert [r["text"] for r in records.git_texts(spark, str(repo)).collect()] == ["new"]
    assert sorted(r["text"] for r in records.git_texts(spark, str(repo), history=True).collect()) == ["new", "old"]


def test_plan(spark):
    rng = np.random.default_rng(8)
    rows = [(str(i), f"w{i % 4}", " ".join(f"t{(i * 7 + j) % 30}" for j in range(6)), rng.normal(size=4).tolist(), rng.normal(size=20).tolist()) for i in range(40)]
    docs = spark.createDataFrame(rows, "id string, work string, text string, v array<double>, z array<double>")
    asked = docs.limit(5).select(F.concat(F.lit("q"), "id").alias("query_id"), "work", "text", F.col("v").alias("q"), "z")
    made = retrieval_plan.plan(docs, asked, asked.select(F.col("query_id").alias("id")), docs.select("id", "work"), asked.select("query_id", "work"), predict=retrieval_plan.predictor(np.vstack([np.zeros(20), np.eye(20)])))
    hits = made["hits"].collect()
    assert len(hits) == 4 * 5 * 3 and all(set(h["sources"]) == {"style"} for h in hits if h["config"] == "style")
    # The style route alone gives the nearest vector first.
    z = {r[0]: np.array(r[4]) for r in rows}
    for h in hits:
        if h["config"] == "style" and h["rank"] == 1:
            own = z[h["query_id"][1:]]
            assert h["id"] == min(z, key=lambda i: (np.linalg.norm(z[i] - own), i))
    assert made["jaccard"].count() == 6 * 3 and made["gaps"].count() == 4 * 3
    assert all(r["slots"] == 5 * r["k"] for r in made["routes"].where("is_total = 1").collect())
    shown = retrieval_plan.hydrate(made["hits"], docs.select("id", F.col("text").alias("vernacular"), F.lit("s").alias("original")), 2)
    assert all(len(r["exemplars"]) == 2 for r in shown.collect())
    with pytest.raises(ValueError, match="without a pair"):
        retrieval_plan.hydrate(made["hits"], docs.limit(0).select("id", F.col("text").alias("vernacular"), F.lit("s").alias("original")), 2)
    with pytest.raises(ValueError, match="breaks its rules"):
        retrieval_plan.plan(docs, asked, docs.select("id"), docs.select("id", "work"), asked.select("query_id", "work"))


def test_loop_with_facts(spark):
    """The loop with the real verifier and scorer: a lost name is told and written back in the second round."""
    exemplars = F.expr("cast(array() as array<struct<id:string,plain:string,styled:string>>)")
    requests = spark.createDataFrame([("a", "颂莲走了三次。")], "id string, input string").withColumn("exemplars", exemplars)
    told = F.element_at("messages", -1)["content"]

    def generate(df):
        return df.withColumn("text", F.when(told.contains("「颂莲」"), "颂莲走了三次罢。").otherwise("她走了三次罢。")).withColumn("error", F.lit(None).cast("string"))

    texts = spark.createDataFrame([(1, "颂莲走了。"), (2, "她走了三次，又走了。")], "id int, text string")
    reference = style.fit_reference(style.style_features(texts, "text", ("id",)))
    verify = loop.fidelity_verifier(fidelity.Dimensions(names=("颂莲",)))
    score = loop.predictor_scorer(reference, np.vstack([np.zeros(20), np.eye(20)]))
    loops = loop.run(requests, generate, verify, score)
    r = loops.first()
    assert (r["output"], r["selected_round"], r["total_rounds"], r["termination"]) == ("颂莲走了三次罢。", 2, 2, "accepted")
    assert [x["violation_count"] for x in r["rounds"]] == [1, 0] and r["rounds"][0]["violations"][0]["expected"] == "颂莲"
    record = experiments.arm_record(loops)
    assert record["first_round_violation_cases"] == 1 and record["rounds"]["selected_round:2"] == 1
    start = spark.createDataFrame([("a", "other")], "id string, output string")
    assert [x["id"] for x in experiments.first_round_mismatches(loops, start).collect()] == ["a"]
    arms = experiments.arms(spark, sources=("k0",))
    assert sorted(experiments.run_arms(arms, lambda arm: arm["form"])) == ["agent-k0-followup", "agent-k0-restate"]
    assert service.events(loops).where("event = 'done'").count() == 1


def test_small_parts(spark, tmp_path):
    rows = spark.createDataFrame([("a", "甲"), ("b", None)], "id string, output string")
    for _ in range(2):
        records.append_jsonl(rows, str(tmp_path / "log"))
    assert records.read_generations(spark, str(tmp_path / "log")).count() == 2
    assert one(spark, records.as_json(F.struct(F.lit("é/\"").alias("a"), F.lit(None).cast("int").alias("b")))) == '{"a":"é/\\"","b":null}'
    assert one(spark, records.from_json(F.lit('{"a": 1}'), "a int"))["a"] == 1
    told = rows.select("id", F.concat(F.lit("sha256:"), F.sha2(F.lit("甲"), 256)).alias("output_hash"))
    assert [r["id"] for r in records.same_outputs(told, rows).collect()] == ["b"]
    reports.write_markdown([("One", "text")], str(tmp_path / "r.md"))
    assert (tmp_path / "r.md").read_text() == "## One\n\ntext\n"
    found = lexicon.log_odds_lexicon(spark.createDataFrame([("书面", 3), ("两边", 3)], "token string, n long"), spark.createDataFrame([("口语", 3), ("两边", 1)], "token string, n long"))
    assert lexicon.lexicon_payload(found) == {"literary": {"书面": math.log(4)}, "colloquial": {"口语": math.log(0.25)}}
    assert one(spark, fidelity.entity_count(F.lit("颂莲"), fidelity.Dimensions(names=("颂莲",)))) == 1
    words = F.array(F.lit("颂莲"), F.lit("来"))
    assert abs(one(spark, fidelity.proper_density(words, F.lit("颂莲来"), F.array(F.lit("颂莲")))) - 2 / 3) < 1e-9
    assert one(spark, surface.contained_terms(F.lit("abc"), F.array(F.lit("bc"), F.lit("x"), F.lit("a")))) == ["a", "bc"]
    assert one(spark, surface.exemplar_copy_ratio(F.lit("abcd"), F.array(F.lit("abcd"), F.lit("x")))) == 1.0
    assert plugins.utc_clock().endswith("Z") and plugins.monotonic_clock() > 0
    assert one(spark, plugins.message_characters(F.array(agent.message("user", F.lit("abc"))))) == 3


def test_plugins(spark):
    v = one(spark, plugins.hash_embedder(8)(F.lit("甲乙甲")))
    assert len(v) == 8 and abs(sum(x * x for x in v) - 1) < 1e-9
    assert one(spark, plugins.hash_embedder(8)(F.lit(""))) == [0.0] * 8 and one(spark, plugins.character_counter(F.lit(None).cast("string"))) == 0


def test_bootstrap_of_listed_and_long_groups(spark, monkeypatch):
    """Short lists are picked from in tasks, without a row for each pick; longer ones by a join, with the same result."""
    df = spark.createDataFrame([(g, i, float((i * 7 + g) % 11)) for g in range(2) for i in range(30)], "g long, id int, v double")
    joined, draw = [], stats.draw
    monkeypatch.setattr(stats, "draw", lambda *a: joined.append(1) or draw(*a))
    listed = sorted(tuple(r) for r in stats.bootstrap_hashed(df, "v", "id", "g", 300).collect())
    assert not joined
    monkeypatch.setattr(stats, "MOST_LISTED", 10)
    again = sorted(tuple(r) for r in stats.bootstrap_hashed(df, "v", "id", "g", 300).collect())
    assert joined and np.allclose(np.array(listed), np.array(again), atol=1e-12)


def test_ablation(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 2))
    y = x @ np.array([[0.0, 1.0], [-1.0, 0.0]]) + 0.01 * rng.normal(size=(60, 2))
    pool = spark.createDataFrame([(i, "w", i % 3, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id int, work string, fold int, x array<double>, y array<double>")
    gaps = experiments.ablation(pool, pool.where("id < 12").withColumnRenamed("id", "case_id"), 2)
    summary = experiments.ablation_summary(gaps)
    mean = {r["arm"]: r["gap"] for r in summary.where("k = 3 and is_total = 1").collect()}
    assert mean["predicted"] < 0.6 * mean["raw"] and mean["oracle"] <= mean["predicted"] * 1.2 < mean["random"]
    assert all(r["clear"] for r in experiments.advantage(gaps, draws=200).collect()) and experiments.oracle_violations(summary.where("arm = 'oracle'")).isEmpty()


def test_ablation_of_many_cases(spark):
    """More than 10,000 queries (cases times arms), in blocks, against plain loops over some cases."""
    n = 2600
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(n, 2)), rng.integers(0, 40, (n, 2)) / 8.0  # many ties
    pool = spark.createDataFrame([(i, "w", i % 3, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id int, work string, fold int, x array<double>, y array<double>")
    gaps = experiments.ablation(pool, pool.withColumnRenamed("id", "case_id"), 2, alphas=(1.0,))
    got = {(r["case_id"], r["arm"], r["k"]): r["gap"] for r in gaps.where("case_id % 100 = 0").collect()}
    for c in range(0, n, 100):
        rest = [i for i in range(n) if i % 3 != c % 3]
        gap = {i: float(np.abs(y[i] - y[c]).mean()) for i in rest}
        for arm, q in (("raw", x[c]), ("oracle", y[c])):
            order = sorted(rest, key=lambda i: (float(((y[i] - q) ** 2).sum()), i))  # noqa: B023
            for k in (1, 3):
                assert got[c, arm, k] == pytest.approx(np.mean([gap[i] for i in order[:k]]), abs=1e-12)
        assert got[c, "random", 1] == pytest.approx(np.mean(list(gap.values())), abs=1e-9)


def test_resumable(spark, tmp_path):
    source, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, output string")
    rows.write.json(source)
    work = lambda df: df.withColumn("done", F.upper("output"))
    jobs.resumable(spark, source, rows.schema, work, sink, check).awaitTermination()
    spark.createDataFrame([("c", "x")], rows.schema).write.mode("append").json(source)
    jobs.resumable(spark, source, rows.schema, work, sink, check).awaitTermination()
    assert sorted(r["id"] for r in jobs.results(spark, sink).collect()) == ["a", "b", "c"]


def test_service(spark):
    bad = spark.createDataFrame([("a", "", 1), ("b", "x", 4), ("c", "x", 2)], "id string, text string, max_iter int")
    assert sorted(r["id"] for r in service.request_errors(bad).collect()) == ["a", "b"]
    assert service.health({"x": lambda: True, "y": lambda: 1 / 0}) == {"status": "degraded", "dependencies": {"x": "up", "y": "down (ZeroDivisionError)"}}


def test_fusion(spark):
    hits = lambda ids: spark.createDataFrame([(1, i, r) for r, i in enumerate(ids, 1)], "query_id int, id string, rank int")
    routes = {"bm25": hits("ab"), "dense": hits("bc"), "style": hits("c")}
    got = sorted(retrieval.fuse(routes, {}, 5).collect(), key=lambda r: r["rank"])
    assert [r["id"] for r in got][2] == "a"
    assert got[0]["sources"] and retrieval.check_ranks(hits("ab")).count() == 0
    dropped = retrieval.fuse(routes, {"style": 0.0}, 5).collect()
    assert all("style" not in r["sources"] for r in dropped)
    for bad in ({"style": -1.0}, {"other": 1.0}, {"style": float("nan")}):
        with pytest.raises(ValueError):
            retrieval.fuse(routes, bad, 5)


def test_ranks_and_exclusion(spark):
    s = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0), (1, "c", 3.0)], "query_id int, id string, score double")
    out = spark.createDataFrame([(1, "c")], "query_id int, id string")
    assert [(r["id"], r["rank"]) for r in retrieval.ranked(s, 5, out).orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    with pytest.raises(ValueError):
        retrieval.ranked(s, 0)


def test_statistics(spark):
    d = spark.createDataFrame([(v,) for v in (0.2, 0.4, 0.6, 0.8)], "v double")
    r = stats.describe(d, "v").first()
    assert abs(r["std_sample"] - 0.25819888974) < 1e-9 and abs(r["std"] - 0.22360679775) < 1e-9
    assert abs(r["q1"] - 0.35) < 1e-9 and abs(r["q3"] - 0.65) < 1e-9
    assert stats.exact_bootstrap(np.ones(5)) == (1.0, 1.0, 1.0)
    assert one(spark, stats.verdict(F.lit(1), F.lit(1), True)) == "improved"
    assert one(spark, stats.verdict(F.lit(0), F.lit(1), True)) == "no difference"
    t = gates.targets({"numeral_recall": F.lit(0.92), "hallucination_rate": F.lit(0.005), "profile_gap": F.lit(0.204)})
    assert [one(spark, c) for c in t.values()] == [True, True, False]


def test_ridge(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = x @ rng.normal(size=(3, 2)) + 0.5
    df = spark.createDataFrame([(i % 5, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "fold int, x array<double>, y array<double>")
    coef = stats.fit_ridge(df, "x", "y", (3, 2), 1e-9)
    assert np.allclose(np.c_[np.ones(200), x] @ coef, y)
    assert stats.choose_alpha(df, "x", "y", "fold", (3, 2), [100.0, 1e-6]) == 1e-6
    far = stats.fit_ridge(df, "x", "y", (3, 2), 1e12)
    assert np.allclose(far[0], y.mean(axis=0), atol=1e-3)


def test_split(spark):
    df = spark.createDataFrame([(i, i % 6) for i in range(120)], "id int, work int")
    got = sampling.stratified_split(df, "id", "work").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"eval": 12, "train": 108}


def test_leak(spark):
    src = leak.source_windows(spark.createDataFrame([("甲乙丙丁戊己庚辛",)], "t string"), "t", "pairs", 6)
    hit = leak.leak_hits(spark.createDataFrame([("f", "无\n甲乙，丙丁戊己庚辛")], "loc string, t string"), src, "loc", "t", 6).collect()
    assert [(r["line"], r["kind"], r["count"], len(r["hashes"])) for r in hit] == [(2, "pairs", 3, 3)]


def test_loop(spark):
    r = lambda n, out, v, s: F.struct(F.lit(n).alias("round"), F.lit(out).alias("output"), F.lit(v).alias("violations"), F.lit(s).alias("score"))
    assert one(spark, agent.best_round(F.array(r(1, "a", 2, 0.9), r(2, "b", 1, 0.1), r(3, "", 0, 1.0)))) == 2
    assert one(spark, agent.cut_echo(F.lit("正文 " + agent.LEADS["followup"] + "- x")))["kept"] == "正文"
    assert one(spark, agent.pairwise_vote(F.lit(False), F.lit("A"), F.lit("B"))) == "win"
    assert one(spark, gates.copy_limit(F.lit(0.5), F.lit(0.0))) == 0.70


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
