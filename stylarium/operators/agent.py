"""The deterministic parts of the rewrite loop: prompts, feedback, echo guard, routing, best round, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numerals import bind
from ..functions.text import stripped

#: The leads of the feedback formats.
LEADS = {
    "followup": "上一版存在以下问题，请按条修正后重写，其余部分尽量保留：",
    "restate": "请按下列要求改写这段输入，其余内容尽量保留：",
    "system": "改写时必须满足下列要求：",
}
#: Violation kinds in the order they are told, and what is told of each.
KIND_ORDER = ("entity_missing", "numeral_missing", "entity_hallucination", "title")
SENTENCES = {
    "entity_missing": "输入里的「%s」在上一版里不见了，请写回去。",
    "numeral_missing": "输入里的数值「%s」必须保留且数值不变，请用中文数字书写，不要改成阿拉伯数字。",
    "entity_hallucination": "上一版里多出了输入中没有的「%s」，请去掉。",
    "title": "输入里的称谓「%s」被改成了「%s」，请改回「%s」。",
    "title_lost": "输入里的称谓「%s」在上一版里不见了，请写回去。",
}
TERMINATIONS = ("accepted", "max_rounds", "recursion_limit", "fallback")
VIOLATION = "struct<kind:string,expected:string,actual:string>"
MESSAGE = "struct<role:string,content:string>"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def prompt(system: Column, exemplars: Column, text: Column) -> Column:
    """Messages: system, exemplars from the last rank to the first (plain as user, styled as assistant), the input."""
    shown = F.flatten(F.transform(F.reverse(exemplars), lambda e: F.array(message("user", e["plain"]), message("assistant", e["styled"]))))
    return F.concat(F.array(message("system", system)), F.coalesce(shown, F.expr(f"cast(array() as array<{MESSAGE}>)")), F.array(message("user", text)))


def messages_hash(messages: Column) -> Column:
    """SHA-256 of the compact JSON of the messages; signs stay as they are."""
    return F.sha2(F.to_json(messages, {"ignoreNullFields": "false"}), 256)


def exemplar_order(pairs: DataFrame, key: str, work: str, text: str, k: int) -> DataFrame:
    """For each pair the first k others of its work, with another text, by the work's hash order; shown from the last to the first.

    A pair leaves out one text, its own: the first k + 1 texts of a work, k rows of each, hold the first k of any pair.
    So a work is ranked once and only a bounded head of it is joined. Null texts take no part.
    """
    rows = pairs.where(F.col(text).isNotNull()).select(key, work, text, F.struct(F.md5(F.col(key).cast("binary")).alias("h"), F.col(key).alias("other")).alias("_o"))
    near = rows.withColumn("_n", F.row_number().over(Window.partitionBy(work, text).orderBy("_o"))).where(F.col("_n") <= k)
    texts = near.groupBy(work, text).agg(F.array_sort(F.collect_list("_o")).alias("_os"))  # k at most
    head = texts.withColumn("_n", F.row_number().over(Window.partitionBy(work).orderBy(F.col("_os")[0]))).where(F.col("_n") <= k + 1)
    own = F.transform("_os", lambda o: F.struct(o.alias("o"), F.col(text).alias("t")))
    pool = head.select(work, own.alias("_own")).groupBy(work).agg(F.array_sort(F.flatten(F.collect_list("_own"))).alias("_pool"))
    chosen = F.slice(F.filter("_pool", lambda x: (x["o"]["other"] != F.col(key)) & (x["t"] != F.col(text))), 1, k)
    found = rows.join(pool, work).select(key, chosen.alias("c")).where(F.size("c") > 0)
    return found.select(key, F.size("c").cast("long").alias("exemplars"), F.array_join(F.reverse(F.transform("c", lambda x: x["o"]["other"])), "|").alias("order_shown"))


def feedback_order(violations: Column) -> Column:
    """Distinct violations by kind, then expected, then actual; an unknown kind is an error."""
    known = F.array(*[F.lit(k) for k in KIND_ORDER])

    def keyed(v: Column) -> Column:
        at = F.array_position(known, v["kind"])
        kind = F.when(at > 0, at).otherwise(F.raise_error(F.concat(F.lit("unknown kind of violation "), v["kind"])))
        return F.struct(kind.alias("k"), F.coalesce(v["expected"], F.lit("")).alias("e"), F.coalesce(v["actual"], F.lit("")).alias("a"), v.alias("v"))

    return F.transform(F.array_sort(F.transform(F.array_distinct(violations), keyed)), lambda x: x["v"])


def sentence(v: Column) -> Column:
    """What is told of a violation; one without the sign it needs is an error."""
    need = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(F.raise_error(F.lit("a violation without its text")))
    told = lambda name, *args: F.format_string(SENTENCES[name], *args)
    e, a = v["expected"], v["actual"]
    return (
        F.when(v["kind"] == "entity_missing", told("entity_missing", need(e)))
        .when(v["kind"] == "numeral_missing", told("numeral_missing", need(e)))
        .when(v["kind"] == "entity_hallucination", told("entity_hallucination", need(a)))
        .when((v["kind"] == "title") & (F.coalesce(a, F.lit("")) != ""), told("title", need(e), a, e))
        .when(v["kind"] == "title", told("title_lost", need(e)))
        .otherwise(F.raise_error(F.concat(F.lit("unknown kind of violation "), v["kind"])))
    )


def feedback(violations: Column, lead: Column | str) -> Column:
    """The lead and a line for each violation; without any it is an error."""
    lines = F.transform(feedback_order(violations), lambda v: F.concat(F.lit("- "), sentence(v)))
    whole = F.concat(F.lit(lead) if isinstance(lead, str) else lead, F.lit("\n"), F.array_join(lines, "\n"))
    return F.when(F.size(violations) > 0, whole).otherwise(F.raise_error(F.lit("feedback without violations")))


def revision(base: Column, text: Column, previous: Column, violations: Column, form: str) -> Column:
    """The messages of a later round: feedback as a further turn, in the input's turn, or in the system's."""
    if form not in LEADS:
        raise ValueError(f"unknown feedback format {form!r}")
    block = feedback(violations, LEADS[form])
    if form == "followup":
        return F.concat(base, F.array(message("assistant", previous), message("user", block)))
    if form == "restate":
        return F.concat(F.slice(base, F.lit(1), F.size(base) - 1), F.array(message("user", F.concat(text, F.lit("\n\n"), block))))
    return F.concat(F.array(message("system", F.concat(base[0]["content"], F.lit("\n\n"), block))), F.slice(base, F.lit(2), F.size(base) - 1))


def next_messages(base: Column, text: Column, previous: Column, violations: Column, form: str) -> Column:
    """A revision after a version with violations; else the plain prompt."""
    return F.when(previous.isNotNull() & (F.size(violations) > 0), revision(base, text, previous, violations, form)).otherwise(base)


def cut_echo(output: Column, violations: Column | None = None) -> Column:
    """struct(kept, removed): the output without feedback it copies.

    It ends before the first verbatim lead, or before the first line with a quoted fragment of the violations, or one
    line earlier if that line ends with a colon; trailing white space goes with what is cut.
    """
    quoted = F.lit(None)
    starts = [F.when(F.locate(lead, output) > 0, F.locate(lead, output) - 1) for lead in LEADS.values()]
    if violations is not None:
        marks = F.flatten(F.transform(violations, lambda v: F.array(v["expected"], v["actual"])))
        marks = F.transform(F.filter(marks, lambda m: F.coalesce(m, F.lit("")) != ""), lambda m: F.concat(F.lit("「"), m, F.lit("」")))

        def line_start(b: Column) -> Column:
            lines = b["lines"]
            hits = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.exists(b["marks"], lambda m: F.contains(F.get(lines, i), m)))
            hit = F.get(hits, F.lit(0))
            back = (hit > 0) & F.get(lines, hit - 1).rlike(r"[：:]\s*$")
            first = F.when(back, hit - 1).otherwise(hit)
            before = F.aggregate(F.slice(lines, F.lit(1), F.coalesce(first, F.lit(0))), F.lit(0), lambda s, x: s + F.length(x) + 1)
            return F.when(hit.isNotNull(), before)

        quoted = bind(F.struct(F.split(output, "\n").alias("lines"), marks.alias("marks")), line_start)
    at = F.least(*starts, quoted.cast("int"))
    kept = F.when(at.isNotNull(), F.regexp_replace(F.substring(output, F.lit(1), at), r"\s+$", "")).otherwise(output)
    return bind(kept, lambda k: F.struct(k.alias("kept"), (F.length(output) - F.length(k)).alias("removed")))


def route(halt: Column, blank: Column, violations: Column, score: Column, done: Column, limit: int, least: float | None, retried: Column) -> Column:
    """accept, revise or re_retrieve; done: rounds so far. Without a least score nothing is retrieved again."""
    out = F.when(halt, "accept").when(blank & (done < limit), "revise").when((violations > 0) & (done < limit), "revise")
    if least is not None:
        out = out.when((violations == 0) & (score < least) & (done < limit) & ~retried, "re_retrieve")
    return out.otherwise("accept")


def best_round(rounds: Column) -> Column:
    """Of non-blank rounds the one of fewest violations, then best score, then earliest; null if all are blank."""
    full = F.filter(rounds, lambda r: stripped(F.coalesce(r["output"], F.lit(""))) != "")
    keyed = F.transform(full, lambda r: F.struct(r["violations"].alias("v"), (-r["score"]).alias("s"), r["round"].alias("r")))
    return F.array_min(keyed)["r"]


def termination(recursed: Column, halted: Column, unfinished: Column) -> Column:
    return F.when(recursed, "recursion_limit").when(halted, "fallback").when(unfinished, "max_rounds").otherwise("accepted")


def transitions(first: Column, final: Column) -> dict[str, Column]:
    """Violations fixed and introduced between two rounds."""
    last = F.coalesce(final, F.expr(f"cast(array() as array<{VIOLATION}>)"))
    return {"fixed": F.array_except(first, last), "introduced": F.array_except(last, first)}


def pairwise_vote(same: Column, vote: Column, swapped: Column) -> Column:
    """Outcome of asking twice with the sides swapped; only a bare A or B counts, disagreement is a tie."""
    return (
        F.when(same, "identical")
        .when((stripped(vote) == "A") & (stripped(swapped) == "B"), "win")
        .when((stripped(vote) == "B") & (stripped(swapped) == "A"), "loss")
        .otherwise("tie")
    )


def judge_prompt(template: Column, original: Column, a: Column, b: Column) -> Column:
    """The template with its places filled in literally."""
    return F.replace(F.replace(F.replace(template, F.lit("{original}"), original), F.lit("{a}"), a), F.lit("{b}"), b)


def service_events(results: DataFrame, key: str, size: int = 24) -> DataFrame:
    """key, seq, event, data of finished requests (trace, rounds, output, error): a trace event a node, the tokens of each
    round in pieces, then done; a request that failed ends with an error that tells no prose."""
    none = F.expr("cast(array() as array<struct<event:string,data:string>>)")
    event = lambda name, data: F.struct(F.lit(name).alias("event"), data.alias("data"))
    traced = F.transform(F.coalesce("trace", F.expr("cast(array() as array<string>)")), lambda t: event("trace", t))

    def pieces(r: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.greatest(F.length(r["output"]), F.lit(1)) - 1) / size).cast("int"))
        told = F.transform(starts, lambda i: event("token", F.to_json(F.struct(r["round"].alias("round"), F.substring(r["output"], i * size + 1, F.lit(size)).alias("text")))))
        return F.when(F.length(r["output"]) > 0, told).otherwise(none)

    end = F.when(F.col("error").isNull(), event("done", F.to_json(F.struct(F.sha2("output", 256).alias("output_sha256"))))).otherwise(event("error", F.lit('{"error":"generation failed"}')))
    every = F.concat(traced, F.flatten(F.transform("rounds", pieces)), F.array(end))
    return results.select(key, F.posexplode(every).alias("seq", "e")).select(key, "seq", "e.event", "e.data")
