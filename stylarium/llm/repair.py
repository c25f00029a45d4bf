"""Conversation structure repair (operator 13): a dynamic program over the retained turns.

A conversation's rows are kept, rerolled to user or assistant, or deleted, and
empty turns inserted, so that the role initials read (s?(ua)+)? at the least
cost. Only retained rows are states of the program: the price of a gap between
two of them is a difference of prefix deletion sums plus the inserts that their
two roles call for, so that one running minimum for each role of the last retained
row prices all gaps at once. Of equally cheap repairs the one whose audit (the
edits' initials in order) is ASCII-least wins. Audits of equally many rows are
equal or differ within both, as each ends with a row's edit: so their ranks
among the few running minima decide all later ties, and no audit is built
before the end.

Rows are dealt by range of (conversation, turn, role, text), so a conversation
of any size lies in consecutive bounded segments. A conversation within one
segment is solved there. Of the others (fewer than there are segments) every
segment gives its costs and audit ranks from each role before it to each role
after it; these small matrices are chained, and the segments then write the
audits of the chosen roles. Only the digest of a repaired conversation is a
chain over its texts: the rows stream past it in order, in one task a
conversation, which holds one batch and the audits.

Edge cases: null conversations are one conversation, null turns come first, null
role and text are one space. Rows of one turn go by role, the text's first 64
characters, then its digest. Rows that repeat are rows of their own (all but the first
are duplicates). A role without letters can only be rerolled or deleted, as
can one whose initial is none of s, u and a. Conversations without any row
left have zeros, an empty audit and the digest of nothing. An empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, cut, lean

DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEGAL = ("su", "ua", "au")
#: Inserts between the last retained role and the next; a system turn stands at the beginning only.
BETWEEN = {
    SYSTEM: {START: 0},
    USER: {START: 0, SYSTEM: 0, USER: 1, ASSISTANT: 0},
    ASSISTANT: {START: 1, SYSTEM: 1, USER: 0, ASSISTANT: 1},
}
CLOSING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
NAMES = {USER: "user", ASSISTANT: "assistant"}


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after the stated damage, repeats as rows of their own; nulls of role and text are one space."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(key) % 20
    text = F.coalesce("text", blank)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(F.coalesce("role", blank))
    times = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def whole(rows: DataFrame) -> DataFrame:
    """Undamaged rows; nulls of role and text are one space."""
    return rows.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))


def visible(text: Column) -> Column:
    return text.rlike(r"[^\x20\x09-\x0D]")


def ordered(rows: DataFrame) -> DataFrame:
    """Rows in order over the written table's parts: part, and pos, which grows along a conversation."""
    head, digest = F.substring("text", 1, 64), F.unhex(F.sha2("text", 256))
    salt = F.xxhash64(F.monotonically_increasing_id())  # parts rows that are alike in all else
    keyed = rows.withColumns({"head": head, "digest": digest, "salt": salt})
    order = ["conv_id", "turn", "role", "head", "digest", "salt"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(
        dealt.select(F.monotonically_increasing_id().alias("pos"), F.spark_partition_id().alias("part"), "conv_id", "turn", "role", "text"), "turns"
    )


def faults(rows: DataFrame) -> DataFrame:
    """pos, part, conv_id, turn, the role's initial and each row's first fault: b(lank), d(uplicate), t(runcated) or none."""
    same = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text")
    light = rows.select(
        "pos", "part", "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), visible(F.col("text")).alias("visible"),
        F.col("text").rlike(r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z").alias("open"), F.unhex(F.sha2(same, 256)).alias("same"),
    )
    seen = light.where("visible").groupBy("same").agg(F.min("pos").alias("first"), F.count("*").alias("times")).where("times > 1")
    fault = F.when(~F.col("visible"), "b").when(F.col("pos") > F.col("first"), "d").when(F.col("open"), "t").otherwise("")
    joined = light.join(seen.select(F.col("same").alias("key"), "first"), (F.col("same") == F.col("key")) & F.col("visible"), "left")
    return joined.select("pos", "part", "conv_id", "turn", "initial", fault.alias("fault"))


class Gaps:
    """Running minima over retained rows, one for each (role before the segment, role of the last retained row).

    A lane is (cost less the deletion of every row so far, rank of its audit among the lanes).
    """

    def __init__(self, starts: tuple[int, ...]) -> None:
        self.lanes = {(s, s): (0, 0) for s in starts}
        self.size, self.steps = 0, []  # steps: (row, {lane: (lane before, edits)}), for the lanes that retain the row

    def row(self, initial: str, fault: str) -> None:
        at, self.size = self.size, self.size + 1
        if fault == "b" or fault == "d":
            return  # every lane deletes it: costs and ranks stay
        own = INITIALS.get(initial, START)
        extra = (TRUNCATED if fault == "t" else 0) - DELETE
        best = {lane: (cost, rank, "D", lane) for lane, (cost, rank) in self.lanes.items()}
        for out in (SYSTEM, USER, ASSISTANT) if own == SYSTEM else (USER, ASSISTANT):
            price, edit = (extra, "K") if out == own else (extra + REROLE, "R")
            between = BETWEEN[out]
            for lane, (cost, rank) in self.lanes.items():
                n = between.get(lane[1])
                if n is None:
                    continue
                to = (lane[0], out)
                made = (cost + price + INSERT * n, rank, "I" + edit if n else edit, lane)
                if to not in best or made < best[to]:
                    best[to] = made
        audits = {a: i for i, a in enumerate(sorted({(rank, edits) for _, rank, edits, _ in best.values()}))}
        self.lanes = {lane: (cost, audits[rank, edits]) for lane, (cost, rank, edits, _) in best.items()}
        kept = {lane: (before, edits) for lane, (_, _, edits, before) in best.items() if edits != "D"}
        if kept:
            self.steps.append((at, kept))

    def cost(self, lane: tuple[int, int]) -> int:
        return self.lanes[lane][0] + DELETE * self.size

    def audit(self, lane: tuple[int, int]) -> str:
        edits = ["D"] * self.size
        for at, kept in reversed(self.steps):
            if lane in kept:
                lane, edits[at] = kept[lane]
        return "".join(edits)

    def end(self) -> tuple[int, str]:
        """Least cost and audit of a whole conversation."""
        _, _, closing, lane = min((cost + INSERT * CLOSING[lane[1]], rank, "I" * CLOSING[lane[1]], lane) for lane, (cost, rank) in self.lanes.items())
        return self.cost(lane) + INSERT * len(closing), self.audit(lane) + closing


def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def tables(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Record batches of rows, each of bounded rows and, by length of strings, of bounded bytes beyond its last row."""
    held, used = [], 0
    for row in rows:
        held.append(row)
        used += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= size or used >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, used = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


SEGMENT = (
    "conv_id long, part int, blank long, duplicate long, truncated long, illegal long, turns long, least long, most long, "
    "first string, last string, cost long, audit string, matrix array<array<long>>"
)
REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def as_arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(schema))


def solver(schema: pa.Schema):
    """Rows sorted by conversation, part and position (conv_id, part, turn, initial, fault, low, high, enter, leave, closing)
    -> one row a segment: counts of faults and turns, and its audit, or where it is not known yet its matrix.

    low, high: first and last part of a conversation that spans several, else null. enter, leave: the roles
    chosen, once known.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def segments() -> Iterator[tuple]:
            now, state = None, None
            for conv, part, turn, initial, fault, low, _, enter, leave, closing in records(batches):
                if now != (conv, part) or state is None:
                    if state is not None:
                        yield close(now, state)
                    now = (conv, part)
                    starts = (enter,) if enter is not None else (START,) if low is None or low == part else (START, SYSTEM, USER, ASSISTANT)
                    state = {"gaps": Gaps(starts), "b": 0, "d": 0, "t": 0, "illegal": 0, "turns": 0, "first": initial, "last": None, "turn": None,
                             "first_turn": None, "span": low is not None, "chosen": (enter, leave, closing)}
                state["gaps"].row(initial, fault)
                if fault:
                    state[fault] += 1
                if state["last"] is not None and state["last"] + initial not in LEGAL:
                    state["illegal"] += 1
                state["last"] = initial
                if turn is not None and turn != state["turn"]:
                    state["turns"] += 1
                    if state["first_turn"] is None:
                        state["first_turn"] = turn
                    state["turn"] = turn
            if state is not None:
                yield close(now, state)

        def close(at: tuple, s: dict) -> tuple:
            gaps, (enter, leave, closing), matrix = s["gaps"], s["chosen"], None
            if enter is not None:
                cost, audit = gaps.cost((enter, leave)) + INSERT * closing, gaps.audit((enter, leave)) + "I" * closing
            elif s["span"]:
                cost, audit = None, None
                matrix = [[*lane, gaps.cost(lane), gaps.lanes[lane][1]] for lane in gaps.lanes]
            else:
                cost, audit = gaps.end()
            return (*at, s["b"], s["d"], s["t"], s["illegal"], s["turns"], s["first_turn"], s["turn"], s["first"], s["last"], cost, audit, matrix)

        yield from tables(segments(), schema)

    return lean(run)


def chain(key, pdf):
    """The roles between the segments of a conversation, from the segments' matrices: conv_id, part, enter, leave, closing."""
    import pandas as pd

    pdf = pdf.sort_values("part")
    lanes, steps = {START: (0, 0)}, []
    for matrix in pdf["matrix"]:
        best: dict[int, tuple] = {}
        for enter, leave, cost, rank in (tuple(int(x) for x in m) for m in matrix):
            if enter in lanes:
                made = (lanes[enter][0] + cost, lanes[enter][1], rank, enter)
                if leave not in best or made < best[leave]:
                    best[leave] = made
        audits = {a: i for i, a in enumerate(sorted({m[1:3] for m in best.values()}))}
        lanes = {leave: (m[0], audits[m[1:3]]) for leave, m in best.items()}
        steps.append({leave: m[3] for leave, m in best.items()})
    at = min(lanes, key=lambda s: (lanes[s][0] + INSERT * CLOSING[s], lanes[s][1], CLOSING[s]))
    out, closing = [], CLOSING[at]
    for part, step in zip(reversed(pdf["part"].tolist()), reversed(steps), strict=True):
        out.append((part, step[at], at, closing))
        at, closing = step[at], 0
    made = pd.DataFrame(out, columns=["part", "enter", "leave", "closing"])
    made.insert(0, "conv_id", pd.array([None if pd.isna(key[0]) else int(key[0])] * len(made), dtype="Int64"))
    return made


def finisher(schema: pa.Schema):
    """Sorted rows of markers, segments and texts -> one row a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def conversations() -> Iterator[tuple]:
            now, s = None, None
            for conv, kind, segment, role, text in records(batches):
                if s is None or now != conv:
                    if s is not None:
                        yield close(now, s)
                    now = conv
                    s = {"sum": [0] * 5, "least": None, "most": None, "turn": None, "last": None, "audits": [], "edits": iter(()), "rest": "",
                         "state": START, "sha": hashlib.sha256(), "any": False, "cost": 0}
                if kind == 1:
                    join(s, segment)
                elif kind == 2:
                    for edit in s["edits"]:
                        if edit != "I":
                            break
                        insert(s)
                    if edit != "D":
                        to = INITIALS[role[:1]] if edit == "K" else USER if s["state"] != USER else ASSISTANT
                        say(s, role if edit == "K" else NAMES[to], text, to)
            if s is not None:
                yield close(now, s)

        def join(s: dict, g: dict) -> None:
            for _ in s["edits"]:  # inserts that end a segment stand after its rows
                insert(s)
            for i, name in enumerate(("blank", "duplicate", "truncated", "illegal", "turns")):
                s["sum"][i] += g[name]
            if s["last"] is not None and s["last"] + g["first"] not in LEGAL:
                s["sum"][3] += 1
            s["last"] = g["last"]
            if g["least"] is not None:
                s["sum"][4] -= g["least"] == s["turn"]
                s["least"] = g["least"] if s["least"] is None else s["least"]
                s["most"] = s["turn"] = g["most"]
            s["cost"] += g["cost"]
            s["audits"].append(g["audit"])
            s["edits"] = iter(g["audit"])

        def say(s: dict, role: str, text: str, to: int) -> None:
            s["sha"].update((("\n" if s["any"] else "") + role + ":" + text).encode())
            s["any"], s["state"] = True, to

        def insert(s: dict) -> None:
            to = ASSISTANT if s["state"] == USER else USER
            say(s, NAMES[to], "", to)

        def close(conv, s: dict) -> tuple:
            for _ in s["edits"]:
                insert(s)
            gaps = s["most"] - s["least"] + 1 - s["sum"][4] if s["least"] is not None else 0
            return (conv, gaps, *s["sum"][:4], s["cost"], "".join(s["audits"]), s["sha"].hexdigest())

        yield from tables(conversations(), schema, most=1 << 24)

    return lean(run)


def repair(rows: DataFrame, damage: bool = False, id_col: str = "conv_id") -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""
    spark = rows.sparkSession
    bound_batches(spark)
    rows = rows.select(F.col(id_col).cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    turns = ordered(damaged(rows) if damage else whole(rows))
    light = cut(faults(turns), "turn-faults")
    # Parts are ranges, so fewer conversations than parts lie in several: a bound for both broadcasts.
    spans = light.groupBy("conv_id").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    spans = F.broadcast(spans.withColumnRenamed("conv_id", "own"))
    marked = light.join(spans, F.col("conv_id").eqNullSafe(F.col("own")), "left").drop("own")

    def solve(df: DataFrame, known: tuple[str, ...]) -> DataFrame:
        chosen = [F.col(c) if c in known else F.lit(None).cast("int").alias(c) for c in ("enter", "leave", "closing")]
        dealt = df.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "pos")
        return dealt.select("conv_id", "part", "turn", "initial", "fault", "low", "high", *chosen).mapInArrow(solver(as_arrow(SEGMENT)), SEGMENT)

    first = cut(solve(marked, ()), "turn-segments")
    roles = first.where("matrix is not null").groupBy("conv_id").applyInPandas(chain, "conv_id long, part int, enter int, leave int, closing int")
    roles = F.broadcast(roles.toDF("own", "own_part", "enter", "leave", "closing"))
    known = marked.where("low is not null").join(roles, F.col("conv_id").eqNullSafe(F.col("own")) & (F.col("part") == F.col("own_part")))
    segments = first.where("matrix is null").unionByName(solve(known, ("enter", "leave", "closing"))).drop("matrix")
    none = F.lit(None)
    pack = F.struct(*[c for c in segments.columns if c not in ("conv_id", "part")])
    stream = (
        segments.select("conv_id", "part", F.lit(1).alias("kind"), F.lit(-1).cast("long").alias("pos"), pack.alias("segment"), none.cast("string").alias("role"), none.cast("string").alias("text"))
        .unionByName(turns.select("conv_id", "part", "pos", "role", "text").withColumn("kind", F.lit(2)), allowMissingColumns=True)
        .unionByName(rows.select("conv_id").distinct().select("conv_id", F.lit(-1).alias("part"), F.lit(0).alias("kind")), allowMissingColumns=True)
    )
    dealt = stream.repartition("conv_id").sortWithinPartitions("conv_id", "part", "kind", "pos")
    return dealt.select("conv_id", "kind", "segment", "role", "text").mapInArrow(finisher(as_arrow(REPAIRED)), REPAIRED)
