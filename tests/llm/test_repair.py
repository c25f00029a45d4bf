"""Conversation repair against every edit sequence of small conversations, and against SQL where a conversation spans segments."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from stylarium.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows, conv):
    """Every choice of edits for the rows and of up to two inserts in each gap."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3][:64].encode(), hashlib.sha256(r[3].encode()).digest()))
    seen, faults, places = set(), [], [t for _, t, _, _ in rows if t is not None]
    for _, _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None
    choices = []
    for (_, _, role, _), f in zip(rows, faults, strict=True):
        extra = 5 * (f == "t")
        keep = [] if f in ("b", "d") else [("K", extra, role)] + [("R", extra + 1, r) for r in ("user", "assistant")]
        choices.append([("D", 2, None), *keep])
    fills = [f for n in range(3) for f in itertools.product(("user", "assistant"), repeat=n)]
    for pick in itertools.product(*choices):
        base = sum(c for _, c, _ in pick)
        if best and base > best[0]:
            continue
        for gaps in itertools.product(fills, repeat=len(rows) + 1):
            cost = base + 5 * sum(map(len, gaps))
            if best and cost > best[0]:
                continue
            roles, audit, said = [], "", []
            for i, fill in enumerate(gaps):
                audit += "I" * len(fill)
                roles += fill
                said += [f"{r}:" for r in fill]
                if i < len(rows):
                    audit += pick[i][0]
                    if pick[i][0] != "D":
                        roles.append(pick[i][2])
                        said.append(f"{pick[i][2]}:{rows[i][3]}")
            if all(roles) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r in roles)):
                made = (cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
                best = min(best, made) if best else made
    pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(rows)]
    gap = max(places) - min(places) + 1 - len(set(places)) if places else 0
    counts = [sum(f == k for f in faults) for k in "bdt"]
    return (conv, gap, *counts, sum(p not in ("su", "ua", "au") for p in pairs), *best)


def conversations(rng, n, most):
    rows = []
    for conv in [None, *range(n)]:
        for _ in range(rng.randint(0, most)):
            role = rng.choice(["user", "assistant", "assistant", "system", "tool", "", None, "user"])
            text = rng.choice(["Yes.", "No!", "Why", "Well? ", " \t", "", None, "So é.\n", "ab"])
            rows.append((conv, rng.choice([None, 0, 1, 1, 2, 5]), role, text))
    return rows


def sql(rows, statement):
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    if rows:
        con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    return {r[0]: r for r in con.execute(f"select {', '.join(COLUMNS)} from ({statement})").fetchall()}


@pytest.mark.parametrize("damaged", [False, True])
def test_repair_is_the_cheapest_of_all(spark, damaged):
    rows = conversations(random.Random(5 + damaged), 40, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r[0]: tuple(r) for r in repair.repair(df, damage=damaged).select(*COLUMNS).collect()}
    assert set(got) == {r[0] for r in rows}
    after = damage(rows) if damaged else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    for conv in got:
        assert got[conv] == brute([r for r in after if r[0] == conv], conv)


def test_long_conversations_span_segments(spark):
    """Conversations far longer than a segment, null turns and repeats among them, agree with SQL's fold over all rows."""
    rng = random.Random(11)
    rows = [(7, i // 2 if i % 9 else None, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", f"Line {i}.", f"Line {i}"])) for i in range(900)]
    rows += [(8, i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(300)]
    rows += [(None, i, "user", f"Turn {i // 2}") for i in range(200)] + conversations(rng, 60, 8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)

        got = {r[0]: tuple(r) for r in repair.repair(df, damage=True).select(*COLUMNS).collect()}
        light = repair.ordered(repair.damaged(df)).selectExpr("conv_id", "part").distinct().groupBy("conv_id").count().where("count > 1").count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert light >= 2
    assert got == sql(rows, queries.ORACLES["op13_repair"])


def test_repair_edges(spark):
    """An empty table, a conversation whose rows all go, other columns with clashing names, and a text of megabytes."""
    assert repair.repair(spark.createDataFrame([], SCHEMA), damage=True).count() == 0
    gone = next((c, t) for c in range(100) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    long = "word " * 600_000 + "."
    rows = [(*gone, "user", "Hi."), (1000, 2, "user", long), (1000, 3, "assistant", "Yes.")]
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], SCHEMA + ", pos int, part string, kind double")
    got = {r["conv_id"]: r for r in repair.repair(df, damage=True).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(got[gone[0]])[1:] == (0, 0, 0, 0, 0, 0, "", empty)
    assert got[1000]["audit"] == brute([r for r in damage(rows) if r[0] == 1000], 1000)[7]
    assert got[1000]["repaired_sha256"] == brute([r for r in damage(rows) if r[0] == 1000], 1000)[8]
