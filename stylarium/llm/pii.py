"""PII (operator 2), DataFrame functions only: candidate generators, boosted trees, calibrated thresholds.

Four base patterns (email, ip, card, phone) with their checks give spans that
always stay. High-recall generators propose further, overlapping spans of these
kinds and of secrets (keys, tokens, passwords). Each candidate has features of
its format (length, digits, capitals, separators, different signs, spelled-out
signs) and context (the characters beside it), all in a few steps. Trees of two
levels are boosted on counts by feature values, a table of bounded size.

No table labels personal data, so labels are weak: a candidate that passes the
base check, or that follows a word that announces its kind, is a positive, all
others are negatives (numbers that fail a check, versions, dates, long words).
The features see neither the check nor the word, so that the trees must find
the form. A threshold for each kind is calibrated on held-out rows. What the
trees accept is added, best score first, where it meets no base span and no
better candidate.

Edge cases: null text is empty. Rows are treated one by one, so repeated rows,
null ids and ties need no rule; an empty table gives an empty result, and
without training candidates nothing is added. Patterns are written so that
matching time is linear and the stack bounded, for texts of any length. Other
columns are ignored. Offsets are code points.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = (*KINDS, "secret")
#: The base patterns, possessive and anchored where that changes no match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:(?![ -](?![0-9]))[0-9 -])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
HINT = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Candidate generators, broader than the base patterns; a kind's alternatives overlap those of the others.
SIGNS = "[A-Za-z0-9_+/=-]"
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+ ?(?:@|\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{2,64}+ ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,24}+(?![A-Za-z])",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}+(?::[0-9]{2,5})?|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){5,7}+)",
    "card": r"(?<![0-9])[0-9]{4}[ .-]?[0-9]{4,6}[ .-]?[0-9]{4,5}[ .-]?[0-9]{1,4}",
    "phone": r"(?<![0-9])[+(]?[0-9]{2,4}[) .-]{1,2}[0-9]{2,4}[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4})?",
    "secret": rf"(?<!{SIGNS})(?=[0-9_+/=-]*+[A-Za-z])(?=[A-Za-z_+/=-]*+[0-9]){SIGNS}{{16,}}+",
}
#: Words that announce a kind, right before a candidate.
ANNOUNCED = {
    "email": r"(?:mail|contact|write|reach|address)(?: (?:me|us|to|at|is))*+[\s:=<\"']{0,4}$",
    "ip": r"(?:ip|host|server|login|addr(?:ess)?|from)[\s:=\"']{0,4}$",
    "card": r"(?:card|visa|credit|account)(?: (?:no|number|is))?+[\s:=.\"']{0,4}$",
    "phone": r"(?:call|tel|phone|fax|mobile)(?: (?:no|number|us|me|is))?+[\s:=.\"']{0,4}$",
    "secret": r"(?:token|key|secret|passw(?:or)?d|pwd|auth|bearer)[\s:=\"']{1,6}$",
}
FEATURES = ("length", "digits", "capitals", "separators", "different", "spelled", "before", "after")
LEVELS = 4  # of each feature
ROUNDS, RATE, PRECISION, DOUBT = 12, 0.5, 0.9, 0.4
FOUND = "array<struct<kind:string,s:int,e:int,mask:int,good:boolean,meets:boolean>>"


def placed(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches: array of (s, e, m), in code points."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["g"])
        e = s + F.length(x["h"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["h"].alias("m")))).alias("out"))

    zipped = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("g"), h.alias("h")))
    return F.when(F.size(hits) > 0, F.aggregate(zipped, start, add)["out"]).otherwise(start["out"])


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    values = F.transform(F.split(F.reverse(number), ""), lambda c: c.try_cast("int"))
    total = F.aggregate(
        F.transform(values, lambda v, i: F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v)),
        F.lit(0),
        lambda a, v: a + F.coalesce(v, F.lit(0)),
    )
    return total % 10 == 0


def passes(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        # A part over 255 has more than three digits after its zeros, or three that exceed it.
        return ~F.exists(
            F.split(m, "\\."),
            lambda p: (F.length(F.regexp_replace(p, "^0+", "")) > 3)
            | F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int") > 255, F.lit(False)),
        )
    n = F.length(digits(m))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits(m))).otherwise(False)
    return n.between(9, 15)


def base_spans(text: Column) -> dict[str, Column]:
    none = F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)")

    def of(kind: str) -> Column:
        good = F.filter(placed(text, BASE[kind]), lambda x: passes(kind, x["m"]))
        return F.when(F.contains(text, F.lit(HINT[kind])), good).otherwise(none)

    return {k: of(k) for k in KINDS}


def candidates(text: Column, kind: str, base: Column) -> Column:
    """Generated spans with features, the weak label, and whether a base span of any kind meets them."""

    def step(x: Column, *bounds: float) -> Column:
        return reduce(lambda a, b: a + b, [(x > b).cast("int") for b in bounds])

    def features(x: Column) -> Column:
        m = x["m"]
        before = F.lower(F.substring(text, F.greatest(x["s"] - 31, F.lit(1)), F.least(x["s"], F.lit(32))))
        beside = F.substring(before, -1, 1)
        after = F.substring(text, x["e"] + 1, F.lit(1))
        n = F.length(m)
        share = lambda pattern: F.regexp_count(m, F.lit(pattern)) / n
        levels = {
            "length": step(n, 11, 19, 31),
            "digits": step(share("[0-9]"), 0.0, 0.3, 0.9),
            "capitals": step(share("[A-Z]"), 0.0, 0.2, 0.6),
            "separators": step(F.regexp_count(m, F.lit("[^A-Za-z0-9]")), 0, 1, 3),
            "different": step(F.size(F.array_distinct(F.split(m, ""))), 7, 11, 15),
            "spelled": F.lower(m).rlike(r"[(\[](?:at|dot)[)\]]").cast("int") + 2 * F.lower(m).rlike(" (?:at|dot) ").cast("int"),
            "before": F.when(beside.rlike("[\"'=:<(]"), 3).when(beside.rlike("[0-9a-z]"), 2).when(beside.rlike("\\S"), 1).otherwise(0),
            "after": F.when(after.rlike("[\"'>)]"), 3).when(after.rlike("[0-9A-Za-z]"), 2).when(after.rlike("\\S"), 1).otherwise(0),
        }
        mask = reduce(lambda a, b: a + b, [levels[f].cast("int") * LEVELS**i for i, f in enumerate(FEATURES)])
        announced = before.rlike(ANNOUNCED[kind])
        checked = F.lit(False) if kind not in BASE else F.exists(base, lambda b: (b["kind"] == kind) & (b["s"] < x["e"]) & (b["e"] > x["s"]))
        meets = F.exists(base, lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"]))
        return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), mask.alias("mask"), (announced | checked).alias("good"), meets.alias("meets"))

    return F.transform(placed(text, WIDE[kind]), features)


def level(mask: int, feature: int) -> int:
    return mask // LEVELS**feature % LEVELS


def boost(rows: list[tuple[int, float, float]]) -> list[tuple]:
    """Trees fitted to (mask, positives, negatives) by logistic loss: (split, (split, value, value), (split, value, value)).

    A split is (feature, least level of its right side).
    """
    splits = [(f, v) for f in range(len(FEATURES)) for v in range(1, LEVELS)]
    trees: list[tuple] = []
    margin = [0.0] * len(rows)

    def best(some: list[int], grads: list[tuple[float, float]]) -> tuple:
        found = None
        for f, v in splits:
            g, h = [0.0, 0.0], [1.0, 1.0]
            for i in some:
                side = level(rows[i][0], f) >= v
                g[side] += grads[i][0]
                h[side] += grads[i][1]
            gain = g[0] * g[0] / h[0] + g[1] * g[1] / h[1]
            if found is None or gain > found[0] + 1e-12:
                found = (gain, (f, v), RATE * g[0] / h[0], RATE * g[1] / h[1])
        return found

    for _ in range(ROUNDS):
        grads = []
        for (_, pos, neg), x in zip(rows, margin, strict=True):
            p = 1 / (1 + math.exp(-x))
            grads.append((pos * (1 - p) - neg * p, (pos + neg) * p * (1 - p)))
        everyone = list(range(len(rows)))
        top = best(everyone, grads)[1]
        sides = [[i for i in everyone if (level(rows[i][0], top[0]) >= top[1]) == side] for side in (False, True)]
        tree = (top, *[best(some, grads)[1:] for some in sides])
        trees.append(tree)
        margin = [x + value_of([tree], m) for (m, _, _), x in zip(rows, margin, strict=True)]
    return trees


def value_of(trees: list[tuple], mask: int) -> float:
    total = 0.0
    for top, left, right in trees:
        split, low, high = right if level(mask, top[0]) >= top[1] else left
        total += high if level(mask, split[0]) >= split[1] else low
    return total


def accepted_masks(train: list[tuple[int, float, float]], held: list[tuple[int, float, float]]) -> dict[int, float]:
    """The masks over the threshold that reaches PRECISION on held-out candidates, with the trees' margins."""
    if not any(p for _, p, _ in train) or not held:
        return {}
    trees = boost(train)
    value = {m: value_of(trees, m) for m in {r[0] for r in (*train, *held)}}
    # Calibration: the lowest margin from which up the held-out precision suffices, smoothed by DOUBT negatives.
    held = sorted(held, key=lambda r: -value[r[0]])
    pos = neg = 0.0
    threshold = None
    for i, (m, p, n) in enumerate(held):
        pos, neg = pos + p, neg + n
        if (i + 1 == len(held) or value[held[i + 1][0]] < value[m]) and pos / (pos + neg + DOUBT) >= PRECISION:
            threshold = value[m]
    return {} if threshold is None else {m: v for m, v in value.items() if v >= threshold}


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, email, ip, card, phone (base spans: s, e, m) and added (kind, s, e)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spans = docs.select("doc_id", text.alias("text")).select("doc_id", "text", *[c.alias(k) for k, c in base_spans(F.col("text")).items()])
    spans = spans.withColumn("base", F.concat(*[_kinded(k) for k in KINDS]))
    # Most texts have no candidate of a kind: the cheap test comes first.
    some = {k: F.when(F.col("text").rlike(WIDE[k]), candidates(F.col("text"), k, F.col("base"))) for k in ADDED_KINDS}
    none = F.expr(f"cast(array() as {FOUND})")
    table = cut(spans.select("doc_id", *KINDS, F.concat(*[F.coalesce(some[k], none) for k in ADDED_KINDS]).alias("found")), "spans")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held")
    counts = (
        table.select(held, F.explode("found").alias("c"))
        .groupBy("held", "c.kind", "c.mask")
        .agg(F.sum(F.col("c.good").cast("int")).alias("pos"), F.sum((~F.col("c.good")).cast("int")).alias("neg"))
        .orderBy("kind", "mask", "held")
        .collect()  # at most 2 folds x 5 kinds x LEVELS ** 8 masks, of which few occur
    )
    scores: dict[tuple[str, int], float] = {}
    for kind in ADDED_KINDS:
        fold = {h: [(r["mask"], float(r["pos"]), float(r["neg"])) for r in counts if r["kind"] == kind and r["held"] is h] for h in (True, False)}
        scores.update({(kind, m): v for m, v in accepted_masks(fold[False], fold[True]).items()})
    if not scores:
        return table.select("doc_id", *KINDS, F.expr("cast(array() as array<struct<kind:string,s:int,e:int>>)").alias("added"))
    known = F.create_map(*[x for (k, m), v in scores.items() for x in (F.lit(f"{k}:{m}"), F.lit(float(v)))])
    scored = F.transform("found", lambda x: F.struct((-F.element_at(known, F.concat_ws(":", x["kind"], x["mask"].cast("string")))).alias("v"), x["s"], x["e"], x["kind"], x["meets"]))
    good = F.array_sort(F.filter(scored, lambda x: ~x["meets"] & x["v"].isNotNull()))
    start = F.expr("cast(array() as array<struct<kind:string,s:int,e:int>>)")

    def take(kept: Column, x: Column) -> Column:
        clash = F.exists(kept, lambda k: (k["s"] < x["e"]) & (k["e"] > x["s"]))
        return F.when(clash, kept).otherwise(F.array_append(kept, F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))))

    return table.select("doc_id", *KINDS, F.aggregate(good, start, take).alias("added"))


def _kinded(kind: str) -> Column:
    return F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


def joined(kind: str, s: Column, e: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), s.cast("string"), e.cast("string"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of base spans, all spans as a string, and the numbers of added spans and of all.

    Kinds come as listed, secrets last.
    """

    def own(k: str) -> Column:
        return F.transform(k, lambda x: joined(k, x["s"], x["e"]))

    def both(k: str) -> Column:
        stay = F.transform(F.col(k), lambda x: F.struct(x["s"], x["e"])) if k in KINDS else F.expr("cast(array() as array<struct<s:int,e:int>>)")
        more = F.transform(F.filter("added", lambda x: x["kind"] == k), lambda x: F.struct(x["s"], x["e"]))
        return F.transform(F.array_sort(F.concat(stay, more)), lambda x: joined(k, x["s"], x["e"]))

    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.concat(*[own(k) for k in KINDS]), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*[both(k) for k in ADDED_KINDS]), ",").alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        (sum((F.size(k) for k in KINDS), F.lit(0)) + F.size("added")).cast("long").alias("n_spans"),
    )
