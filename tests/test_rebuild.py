"""The rebuild that goes on where it stopped, and the two-pass experiment with stub models."""

import json

import pytest
from pyspark.sql import functions as F

from stylarium.plans import rebuild
from stylarium.sources import versions


@pytest.fixture
def stores(tmp_path):
    return rebuild.Stores(f"file://{tmp_path}/attempts", f"file://{tmp_path}/pairs")


def model(accepts, name="m", asked=None):
    """Answers each chunk from the attempt that accepts names; ids that it lacks always fail."""

    def generate(df):
        if asked is not None:
            asked.append(sorted((r["id"], r["attempt"], r["feedback"]) for r in df.collect()))
        least = F.create_map(*[F.lit(x) for kv in accepts.items() for x in kv])[F.col("id")]
        good = F.col("attempt") >= least
        return df.withColumn("output", F.when(least.isNotNull(), F.when(good, "good").otherwise("bad"))).withColumn("model", F.lit(name)).withColumn("error", F.when(least.isNull(), "TimeoutError"))

    return generate


def gate(df):
    return df.withColumn("reasons", F.when(F.col("output") == "good", "").otherwise("numeral_mismatch,blank"))


def chunks(spark, ids):
    return spark.createDataFrame([(i, f"text {i}") for i in ids], "id string, original string")


def test_rebuild_goes_on(spark, stores):
    asked = []
    told = rebuild.rebuild(chunks(spark, "abcd"), stores, model({"a": 1, "b": 2, "c": 9}, asked=asked), gate, "m")
    assert told == {"requested": 4, "already_done": 0, "recovered": 0, "succeeded": 2, "failed": 2, "calls": 4 + 3 + 2}
    assert asked[1] == [("b", 2, "numeral_mismatch,blank"), ("c", 2, "numeral_mismatch,blank"), ("d", 2, "TimeoutError")]
    assert sorted(r["id"] for r in versions.load(spark, stores.pairs).collect()) == ["a", "b"]
    # Accepted chunks are never asked for again; those tried in vain are, unless once.
    asked.clear()
    told = rebuild.rebuild(chunks(spark, "abcde"), stores, model({"c": 1, "d": 1, "e": 1}, asked=asked), gate, "m", once=True)
    assert told["already_done"] == 2 and [[i for i, _, _ in x] for x in asked] == [["e"]]
    told = rebuild.rebuild(chunks(spark, "abcde"), stores, model({"c": 1, "d": 1}), gate, "m")
    assert told["succeeded"] == 2 and versions.load(spark, stores.pairs).count() == 5
    assert {r["id"]: (r["attempts"], r["accepted"]) for r in rebuild.history(spark, stores).collect()} == {"a": (1, True), "b": (2, True), "c": (4, True), "d": (4, True), "e": (1, True)}
    assert rebuild.rebuild(chunks(spark, "abcde"), stores, model({}), gate, "m")["calls"] == 0


def test_a_pair_lost_between_the_stores_comes_back(spark, stores):
    rows = gate(model({"a": 1})(chunks(spark, "ab").withColumn("feedback", F.lit("")).withColumn("attempt", F.lit(1))))
    versions.publish(rows.select(*rebuild.ATTEMPT), stores.attempts)  # the run stopped before it published pairs
    told = rebuild.rebuild(chunks(spark, "ab"), stores, model({"b": 1}), gate, "m", once=True)
    assert told["recovered"] == 1 and told["calls"] == 0
    assert [r["output"] for r in versions.load(spark, stores.pairs).collect()] == ["good"]


def test_another_model_is_an_error(spark, stores):
    with pytest.raises(rebuild.ModelMismatch):
        rebuild.rebuild(chunks(spark, "ab"), stores, model({"a": 1}, name="other"), gate, "m")
    assert versions.manifest(spark, stores.pairs) is None
    assert {r["reasons"] for r in rebuild.history(spark, stores).collect()} == {"model_identity_mismatch", "TimeoutError"}


def test_examples_leave_the_chunk_out(spark):
    own = spark.createDataFrame([(i, "x" * n, f"v{i}") for i, n in (("a", 3), ("b", 1), ("c", 2), ("d", 9))], "id string, original string, vernacular string")
    asked = spark.createDataFrame([("b", "?"), ("q", "xx")], "id string, original string")
    got = {r["id"]: [e["id"] for e in r["examples"]] for r in rebuild.leave_one_out(asked, own, 3).collect()}
    assert got == {"b": ["c", "a", "d"], "q": ["b", "a", "d"]}
    with pytest.raises(Exception, match="too few"):
        rebuild.leave_one_out(asked, own, 4).collect()


ORIGINAL = "陈佐千缓缓地走进花园里，凝视着三株梅树，心中怅然若失。"
DRAFT = "老爷慢慢走到院子当中，看见三棵梅花树，觉得很难过，什么也没说出来。"
REPAIRED = "陈佐千慢慢走到院子当中，看见三棵梅花树，觉得很难过，什么也没说出来。"


def stub(df):
    """The case's id tells what its two calls give."""
    good = json.dumps({"issues": [{"category": "entity", "lost_or_changed_fact": "陈佐千", "repair": "写回"}], "repaired_text": REPAIRED}, ensure_ascii=False)
    odd = json.dumps({"issues": [{"category": "style", "lost_or_changed_fact": "x", "repair": "y"}], "repaired_text": REPAIRED}, ensure_ascii=False)
    second = F.when(F.col("id") == 1, "```json\n" + good + "\n```").when(F.col("id") == 2, "no json").when(F.col("id") == 3, odd).when(F.col("id") == 5, '{"issues": [], "repaired_text": ""}').otherwise(good)
    first = F.when(F.col("id") != 4, F.lit(f"```\n{DRAFT}\n```"))
    return df.select(
        "id", F.when(F.col("stage") == 1, first).otherwise(second).alias("raw"), F.when((F.col("id") == 4) & (F.col("stage") == 1), "TimeoutError").alias("error"),
        F.when((F.col("id") == 6) & (F.col("stage") == 2), "length").otherwise("stop").alias("finish"), "prompt", "stage",
    )


def test_two_passes(spark):
    prompts = []

    def generate(df):
        prompts.extend((r["stage"], r["id"], r["prompt"]) for r in df.collect())
        return stub(df)

    cases = spark.createDataFrame([(i, ORIGINAL) for i in range(20)], "id int, original string")
    first = lambda o, banned, entities: F.concat_ws("|", F.lit("first"), o, F.array_join(banned, "、"), F.array_join(entities, "、"))
    second = lambda o, draft, banned, entities: F.concat_ws("|", F.lit("second"), o, draft)
    approved = ("凝视", "怅然", "陈佐千", "仿佛")
    out = {r["id"]: r for r in rebuild.two_pass_run(cases, generate, first, second, approved, ("陈佐千",)).collect()}
    assert len(out) == 20 and sum(s == 1 for s, _, _ in prompts) == 20 and sum(s == 2 for s, _, _ in prompts) == 19
    assert prompts[0][2] == f"first|{ORIGINAL}|凝视、怅然|陈佐千" and ("second|" + ORIGINAL + "|" + DRAFT) in {p for _, _, p in prompts}
    assert out[1]["first"] == DRAFT and out[1]["second"] == REPAIRED and out[1]["issues"][0]["category"] == "entity"
    assert out[0]["reasons"] == out[1]["reasons"] and "entity_missing" not in out[1]["reasons"]
    for i in (2, 3, 5):
        assert out[i]["reasons"] == ["repair_json_invalid", "missing_stage_metrics"] and not out[i]["accepted"]
    assert out[4]["reasons"] == ["TimeoutError", "second_skipped_without_valid_first_call"]
    assert out[6]["reasons"] == ["provider_output_truncated", *out[1]["reasons"]]
    assert out[1]["accepted"] == (out[1]["reasons"] == [])
    with pytest.raises(ValueError, match="exactly 20"):
        rebuild.two_pass_run(cases.limit(19), generate, first, second, approved)
