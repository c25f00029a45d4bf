import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import base_spans, near_components, pieces_ok, repeats

pytest.importorskip("stylarium.llm")
from pyspark.sql import Row, functions as F, types as T  # noqa: E402

from stylarium.llm import (  # noqa: E402
    ann,
    langid,
    linededup,
    mips,
    mixing,
    neardup,
    packing,
    pii,
    queries,
    suffix,
    toxicity,
)
from stylarium.llm.common import ByteHasher  # noqa: E402

DOC = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("k", T.IntegerType()), T.StructField("own", T.StringType())]
)
WORDS = [f"w{i}x" for i in range(400)]
LONG = " ".join(WORDS[(i * i) % 400] for i in range(4000))
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one two"),
    (5, "One TWO"),
    (5, "one two"),
    (None, "one two three four"),
    (None, None),
    (6, LONG),
    (7, LONG),
    (8, "x" * 5000),
    (9, "é😀 mail a@b.co +1 (234) 567-8901 4111 1111 1111 1111 10.0.0.255 10.0.0.256 1.2.3.4.5"),
    (10, LONG + " end"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", 1, "own") for i, t in ODD], DOC).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def docs(spark, small):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def vectors(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    return np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)


VEC = "vec_id long, embedding array<float>, dim int, rank string"
ODD_VECTORS = [(0, [1.0, 0.0]), (1, None), (2, [float("nan"), 1.0]), (3, [0.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (5, [None, 1.0]), (20, [0.5, 0.5]), (40, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (100, [-1.0, 0.25])]


def test_ann_recall(spark, small):
    ids, x = vectors(spark, small)
    got = {}
    for r in queries.op1_ann(spark, small).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        order = [i for i in np.lexsort((ids, -s)) if i != q][:20]
        rows = got[ids[q]]
        assert sorted(rows) == list(range(1, 21))
        for v, score in rows.values():
            assert abs(score - float(x[ids == v][0] @ x[q])) < 1e-12
        hit += len({ids[i] for i in order} & {v for v, _ in rows.values()})
        total += 20
    assert hit / total >= 0.9


def test_ann_odd(spark):
    df = spark.createDataFrame([(i, v, 7, "z") for i, v in ODD_VECTORS], VEC)
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df, k=3, query_every=20).collect()]
    assert sorted(got) == [(0, 1, 4), (0, 2, 20), (0, 3, 100), (20, 1, 0), (20, 2, 4), (20, 3, 100), (100, 1, 20), (100, 2, 0), (100, 3, 4)]
    assert ann.nearest(df.limit(0)).collect() == []


def test_ann_many_equal(spark):
    df = spark.createDataFrame([(i, [1.0, 0.5] if i % 3 else [float(i), 1.0], 1, "") for i in range(200)], VEC)
    got = [r for r in ann.nearest(df, k=5, query_every=100).collect() if r["query_id"] == 100]
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [198, 195, 192, 189, 186]


def test_exact_topk(spark, small):
    ids, x = vectors(spark, small)
    v = np.floor(1024 * x).astype(np.int64)
    want = set()
    for q in np.flatnonzero(ids % 100 == 0):
        s = v @ v[q]
        for rank, i in enumerate([i for i in np.lexsort((ids, -s)) if i != q][:10], 1):
            want.add((ids[q], rank, ids[i], s[i]))
    assert {tuple(r) for r in queries.op7_exact_topk(spark, small).collect()} == want


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_exact_topk_lengths(spark, spread):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=8)
    x = (centre + spread * rng.normal(size=(900, 8))) * rng.lognormal(0, 1, 900)[:, None]
    x[::7] = 0
    df = spark.createDataFrame([(i, [float(e) for e in r], 1, "") for i, r in enumerate(x)], "vec_id long, embedding array<double>, dim int, rank string")
    v = np.floor(64 * x).astype(np.int64)
    want = set()
    for q in range(0, 900, 50):
        s = v @ v[q]
        want |= {(q, r, i, s[i]) for r, i in enumerate([i for i in np.lexsort((np.arange(900), -s)) if i != q][:10], 1)}
    assert {tuple(r) for r in mips.top_products(df, query_every=50, scale=64).collect()} == want


def test_exact_topk_odd(spark):
    df = spark.createDataFrame([(i, v, 7, "z") for i, v in ODD_VECTORS], VEC)
    got = {(r["query_id"], r["rank"], r["vec_id"]) for r in mips.top_products(df, k=3, query_every=20).collect()}
    assert {(0, 1, 4), (0, 2, 20), (0, 3, 3), (20, 1, 0), (20, 2, 4), (20, 3, 3)} <= got
    assert mips.top_products(df.limit(0)).collect() == []


def digest_of(text):
    return hashlib.sha256(",".join(base_spans(text)).encode()).hexdigest()


def test_pii_base(spark, small, docs, odd, nothing):
    got = by_id(queries.op2_pii(spark, small))
    for i, t in docs:
        spans = base_spans(t)
        assert got[i]["base_sha256"] == digest_of(t), (i, spans, got[i])
        assert got[i]["n_email"] == sum(s.startswith("email") for s in spans)
        assert set(spans) <= set(got[i]["spans"].split(",")) | {""}
    rows = pii.digest(pii.find(odd)).collect()
    assert len(rows) == len(ODD)
    assert by_id(pii.digest(pii.find(odd)))[9]["base_sha256"] == digest_of(dict(ODD)[9])
    assert pii.digest(pii.find(nothing)).collect() == []


def test_pii_hard(spark):
    texts = [
        "a@b.c+x@y.z.", "a@b@c.d", "..@..a@b.c.d-", "1.2.3.4.5.6.7.8", "300.1.1.1.1", "0001.2.3.4", "00000000000000000000001.2.3.4",
        "4111-1111 1111-1111 1", "4111  1111", "12-", "+1 2", "+12345678", "+1 (23) 45--67 89.", "++1 234 567 890 12", "1" * 3000, "1 " * 4000,
        "a." * 3000 + "@b" + ".c" * 3000, "@" * 2000, "+1" + "-" * 4000, "x" * 30000, "1.1." * 2000, "\U0001f600 a@b.c \U0001f600 10.1.1.1",
        "٣ 4111111111111111", "4111 1111 1111 1111\n5500005555555559",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(pii.digest(pii.find(df)))
    for i, t in enumerate(texts):
        assert got[i]["base_sha256"] == digest_of(t), (t[:60], base_spans(t)[:5], got[i]["spans"][:100])


def planted(n, rng):
    """Texts with announced and bare secrets and spelled addresses, and others with versions, dates and long words; what is planted."""
    rows, spans = [], {}
    for i in range(n):
        words = [str(rng.choice(WORDS)) for _ in range(30)]
        sign = "".join(rng.choice(list("0123456789abcdef"), 40))
        name = f"{rng.choice(list('abcdef'))}{int(rng.integers(10, 99))}"
        kind = [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 2, 2, 3, 3, 4, 4, 5][i % 20]
        more = {
            0: [f'token = "{sign}"'],
            1: [f'see "{sign}"'],
            2: [f"write to {name} (at) host{int(rng.integers(9))} (dot) com"],
            3: ["version 2024.10.300.7 of 2024-01-02, 12-34-56"],
            4: ["internationalisation-2 antidisestablishmentarianism", "look at this. That"],
            5: [],
        }[kind]
        text = " ".join([*words[:15], *more, *words[15:]])
        rows.append((i, text))
        if kind in (0, 1):
            spans[i] = f"secret:{text.index(sign)}:{text.index(sign) + 40}"
        if kind == 2:
            at = text.index(f"{name} (at)")
            spans[i] = f"email:{at}:{at + len(f'{name} (at) host0 (dot) com')}"
    return rows, spans


def test_pii_added(spark):
    """Learned on announced ones alone, bare secrets and spelled addresses of held-out rows are found, and little else."""
    rows, spans = planted(1200, np.random.default_rng(4))
    found = by_id(pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))))
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    hits = sum(spans[i] in found[i]["spans"].split(",") for i in held if i in spans)
    wrong = sum(bool(set(found[i]["spans"].split(",")) - {spans.get(i), ""}) for i in held)
    assert hits >= 0.95 * sum(i in spans for i in held) and wrong <= 0.02 * len(held)
    assert all(found[i]["base_sha256"] == digest_of(t) for i, t in rows)
    assert all(r["n_spans"] == len([x for x in r["spans"].split(",") if x]) for r in found.values())


def test_pii_trees():
    """Trees part what one split cannot, and the calibrated threshold keeps the precision."""
    mask = lambda a, b: a + pii.LEVELS * b
    rows = [(mask(a, b), 90.0 if (a > 1) != (b > 1) else 2.0, 2.0 if (a > 1) != (b > 1) else 90.0) for a in range(4) for b in range(4)]
    good = pii.accepted_masks(rows, rows)
    assert set(good) == {mask(a, b) for a in range(4) for b in range(4) if (a > 1) != (b > 1)}
    assert pii.accepted_masks(rows, [(m, 1.0, 5.0) for m, _, _ in rows]) == {} and pii.accepted_masks([], []) == {}


def test_packing(spark, small, docs, odd, nothing):
    rows = queries.op3_packing(spark, small).collect()
    tokens, sequences = pieces_ok(rows, docs, queries.vocabulary(queries.WORD_VOCABULARY))
    assert sequences <= tokens / 2048 * 1.02 + 1
    unique = odd.where("doc_id is not null and doc_id <> 5")
    path = queries.vocabulary(queries.WORD_VOCABULARY)
    pieces_ok(packing.pack(unique, path).collect(), [(r["doc_id"], r["text"]) for r in unique.collect()], path)
    assert sum(r["start"] == 0 for r in packing.pack(odd, path).collect()) == len(ODD)
    assert packing.pack(nothing, path).collect() == []


def test_first_fit():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 100, 300).tolist()
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    room: list[int] = []
    plain = {}
    for i in sorted(range(300), key=lambda i: -lengths[i]):
        b = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
        room += [100] * (b == len(room))
        plain[i] = (b, 100 - room[b])
        room[b] -= lengths[i]
    assert [plain[i] for i in range(300)] == list(zip(bins, offsets, strict=True))


def test_tokens_of_odd_texts():
    w = packing.WordPieces(queries.vocabulary(queries.WORD_VOCABULARY))
    texts = ["I'm it's 12 ab_c ÉÀx 'LL d'M\x00\x1cq", "Σας İx ﬁ é 日本語 ½ ²", "<|endoftext|> a", "a" * 300 + " b'", "", "  \n"]
    for t, ids in zip(texts, w.encode(texts), strict=True):
        assert ids.tolist() == w.whole.encode(t, add_special_tokens=False).ids


def test_language(spark, small, odd, nothing):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op4_language(spark, small).collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.93
    assert all(0 <= r["score"] <= 1 for r in rows)
    path = queries.vocabulary(queries.PIECE_VOCABULARY)
    got = langid.identify(odd, path).collect()
    assert len(got) == len(ODD)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert langid.identify(nothing, path).collect() == []


def test_forward_is_the_sum_over_segmentations():
    index = {"▁a": 0, "▁ab": 1, "b": 2, "c": 3, "bc": 4}
    table = np.array([[0.1], [0.2], [0.3], [0.15], [0.2], [0.05]])
    got = np.exp(langid.forward(["abc", "x", "a" * 300], index, table))[:, 0]
    assert abs(got[0] - (0.1 * 0.3 * 0.15 + 0.2 * 0.15 + 0.1 * 0.2)) < 1e-12
    assert abs(got[1] - 0.05) < 1e-12
    log = langid.forward(["a" * 300], index, table)[0, 0]
    assert abs(log - (np.log(0.1) + 299 * np.log(0.05))) < 1e-6


def plain_templates(docs, min_docs):
    import re

    def template(line):
        return re.sub(r"\s+", " ", re.sub(r"(?<!\S)(?:[^\s0-9@]*[0-9@]|[a-z]+://)\S*", "<*>", line.lower().strip(" ")))

    lines = [(i, [template(x) for x in t.split("\n")]) for i, t in docs if t is not None]
    first = {}
    for i, ts in lines:
        for a, t in enumerate(ts):
            if t:
                key = (t, ts[a - 1] if a else None, ts[a + 1] if a + 1 < len(ts) else None)
                first[key] = min(first.get(key, i), i)
    docs_of = {}
    for (t, _, _), i in first.items():
        docs_of.setdefault(t, set()).add(i)
    leaves = {}
    for t in docs_of:
        leaves.setdefault((len(t.split(" ")), " ".join(t.split(" ")[:3])), []).append(t)
    drop = {t for t, d in docs_of.items() if len(d) >= min_docs}
    for (n, _), ts in leaves.items():
        if len(ts) > 1 and sum(len(docs_of[t]) for t in ts) >= min_docs:
            same = sum(len({t.split(" ")[p] for t in ts}) == 1 for p in range(n)) / n
            if 0.6 <= same < 1:
                drop |= set(ts)
    return {i: [a for a, t in enumerate(ts) if t and t in drop] for i, ts in lines}


def test_line_dedup(spark, small, docs, odd, nothing):
    want = plain_templates(docs, 4)
    out = by_id(linededup.drop_lines(spark.read.parquet(f"{small}/documents.parquet"), count=True))
    for i, t in docs:
        kept = [x for a, x in enumerate(t.split("\n")) if a not in set(want[i])]
        assert out[i]["n_dropped"] == len(want[i]) and out[i]["text"] == "\n".join(kept)
    again = linededup.drop_lines(odd)
    assert again.columns == odd.columns
    assert sorted(map(repr, again.collect())) == sorted(map(repr, odd.collect()))
    assert linededup.drop_lines(nothing).collect() == []


def test_line_templates(spark):
    log = [(i, f"alpha {chr(97 + i)} text\nuser login from host number {i}: took {chr(97 + i)} seconds\nbeta {chr(110 + i)} more") for i in range(6)]
    copies = [(100 + i, "the same first line\nthe same second line") for i in range(9)]
    got = by_id(linededup.drop_lines(spark.createDataFrame(log + copies, "doc_id long, text string")))
    assert all("login" not in got[i]["text"] and "alpha" in got[i]["text"] for i in range(6))
    assert all(got[100 + i]["text"] == copies[i][1] for i in range(9))


def prose(rng, n):
    return " ".join(WORDS[j] for j in rng.integers(0, 400, n)).replace("x", "").translate(str.maketrans("0123456789", "abcdefghij"))


def test_line_near_copies_stay(spark):
    """Near copies by substituted words, and short clean lines of one beginning, are no templates."""
    rng = np.random.default_rng(5)
    text = [prose(rng, 20).split(" ") for _ in range(8)]
    rows = []
    for i in range(9):
        mine = [x.copy() for x in text]
        for x in mine[: 8 if i else 0]:
            x[int(rng.integers(3, 20))] = f"new{chr(97 + i)}"
        rows.append((i, "\n".join([*map(" ".join, mine), "a line all copies keep"])))
    rows += [(100 + i, f"{prose(rng, 30)}\nwe saw the {chr(97 + i)}\n{prose(rng, 30)}") for i in range(9)]
    got = by_id(linededup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all(got[i]["text"] == t for i, t in rows)


def test_line_boilerplate_blocks(spark):
    """Lines set off by blank lines, and all lines of a block, recur across unrelated documents; copies' lines do not."""
    rng = np.random.default_rng(6)
    head, foot = "some site of news\nhome about contact\nall the latest", "privacy and terms\nall rights are ours\nback to top"
    own = [(prose(rng, 40), prose(rng, 50)) for _ in range(7)]
    rows = [(i, f"{head}\n\n{a}\n\nshare this with friends\n\n{b}\n\n{foot}") for i, (a, b) in enumerate(own)]
    rows += [(100 + i, f"{prose(np.random.default_rng(1), 40)}\n\na copied line\n\n{prose(np.random.default_rng(2), 40)}") for i in range(9)]
    got = by_id(linededup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all([x for x in got[i]["text"].split("\n") if x] == [a, b] for i, (a, b) in enumerate(own))
    assert all(got[100 + i]["text"] == rows[7 + i][1] for i in range(9))


def test_line_families_of_a_leaf(spark):
    """Two families of one length and beginning recur, and lines unlike them neither hinder nor join them."""
    rng = np.random.default_rng(7)
    odd_line = "the old job went far beyond what most people had thought"
    line = lambda i: f"the old job named {chr(97 + i)}o has ended without errors on time" if i % 2 else f"the old job was started by {chr(97 + i)}o from the main queue"
    rows = [(i, f"{prose(rng, 30)}\n{line(i)}\n{prose(rng, 30)}") for i in range(12)] + [(50, f"{prose(rng, 30)}\n{odd_line}")]
    assert len({len(x.split()) for x in [odd_line, line(0), line(1)]}) == 1
    got = by_id(linededup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all(len(got[i]["text"].split("\n")) == 2 and "job" not in got[i]["text"] for i in range(12))
    assert got[50]["text"] == rows[12][1]


def test_near_duplicates(spark, small, docs, odd, nothing):
    want = near_components(docs, 3, 85)
    for r in queries.op6_near_dedup(spark, small).collect():
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(odd).collect()]
    assert len(got) == len(ODD)
    assert {(4, 4, True), (5, 4, False), (6, 6, True), (7, 6, False), (10, 6, False), (1, 1, True), (None, None, True)} <= set(got)
    kept = neardup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 2, 3, 4, 6, 8, 9]
    assert neardup.near_duplicates(nothing).collect() == []


def test_near_duplicate_chains(spark):
    """Edited copies of copies: a link to some member must be found even if none is close to the others."""
    rng = np.random.default_rng(2)
    rows, text = [], [WORDS[i] for i in rng.integers(0, 400, 220)]
    for i in range(120):
        rows.append((i, " ".join(text)))
        if i % 3 == 2:
            text = text.copy()
            text[int(rng.integers(0, 220))] = f"new{i}"
        else:
            side = text.copy()
            side[int(rng.integers(0, 220))] = f"side{i}"
            rows.append((1000 + i, " ".join(side)))
    rows += [(2000 + i, " ".join(WORDS[j] for j in rng.integers(0, 400, n))) for i, n in enumerate([3, 4, 6, 9, 250, 260, 300] * 3)]
    want = near_components(rows, 3, 85)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=85, star_rounds=1).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_near_copies_of_one_text_cross_once(spark, monkeypatch):
    """A large family of near copies that mostly have no link: no table grows with the pairs of its blocks, and no link is lost."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = np.random.default_rng(8)
    base, rows = [WORDS[i] for i in rng.integers(0, 400, 150)], []
    for i in range(300):
        text = base.copy()
        for j in range(int(rng.integers(1, 14))):
            text[int(rng.integers(0, 150))] = f"e{i}x{j}"
        rows.append((i, " ".join(text)))
    write, tables = neardup.cut, []

    def counted(df, tag, keep=False):
        out = write(df, tag, keep)
        tables.append((tag, out.count()))
        return out

    monkeypatch.setattr(neardup, "cut", counted)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == near_components(rows, 3, 85)
    assert len({r["component_id"] for r in got}) > 30
    assert max(n for _, n in tables) <= dict(tables)["buckets"], tables


def test_near_duplicates_shuffle_few_texts(spark):
    """Texts that resemble no other, and rows that stay, are not shuffled."""
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"{x:06x}" for x in rng.integers(0, 1 << 24, 1500))) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(5)] + [(2000, rows[7][1]), (None, rows[8][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    status, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    bus, none = spark.sparkContext._jsc.sc().listenerBus(), gateway.new_array(gateway.jvm.double, 0)

    def stages():
        bus.waitUntilEmpty(30_000)
        found = status.stageList(None, False, False, none, gateway.jvm.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (found.apply(i) for i in range(found.size()))}

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    try:
        before = stages()
        got = {r["doc_id"] for r in neardup.drop_near_duplicates(docs).collect()}
        moved = sum(n for at, n in stages().items() if at not in before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {*range(300), None}
    assert moved < 0.5 * sum(len(t) for _, t in rows), moved


def test_near_duplicates_across_register_kinds(spark):
    """At 80%, pairs whose sizes lie on both sides of the border of the register kinds."""
    rng = np.random.default_rng(4)
    rows = []
    for i, (a, b) in enumerate([(206, 257), (208, 260), (210, 260), (212, 264), (214, 267), (216, 270), (206, 259), (216, 271)]):
        words = [f"p{i}q{j}" for j in rng.permutation(b + 4)]
        rows += [(2 * i, " ".join(words[: a + 4])), (2 * i + 1, " ".join(words))]
    want = near_components(rows, 5, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    assert [want[2 * i + 1][1] == 2 * i for i in range(8)] == [True] * 6 + [False] * 2


def test_mixing(spark, small, odd, nothing):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = mixing.label_domains(spark.read.parquet(f"{small}/labels.parquet"))
    out, report = mixing.mix(docs, labels)
    rows = out.collect()
    p, n, r = np.array([x["posterior"] for x in rows]), np.array([x["n_tokens"] for x in rows], float), np.array([x["rate"] for x in rows])
    goal, size = np.array(report["targets"]), n.sum()
    assert (r >= 0).all() and np.allclose(p.sum(axis=1), 1)
    assert np.allclose(report["after"], (r * n) @ p)

    # The loss is strictly convex: rates that stand under a projected gradient step are the only minimum.
    def stands(r, goal):
        e = ((r * n) @ p - goal) / goal
        return np.abs(r - np.maximum(0, r - (p @ e + mixing.RIDGE * (r - 1)) / mixing.RIDGE)).max()

    assert stands(r, goal) < 0.01 * max(1, r.max())
    even = {d: 1.0 for d in report["domains"]}
    out, report = mixing.mix(docs, labels, even)
    r = np.array([x["rate"] for x in out.collect()])
    assert stands(r, np.array(report["targets"])) < 0.01 * max(1, r.max()) and report["steps"] < mixing.STEPS
    assert np.allclose(report["after"], report["targets"], rtol=0.05) and not np.allclose(report["before"], report["targets"], rtol=0.05)
    assert len(mixing.mix(odd, labels)[0].collect()) == len(ODD)
    assert mixing.mix(nothing, labels)[0].collect() == []
    # Mean posteriors of the rows kept back are the domains' shares, and a constant guess is worse.
    told = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), mixing.label_domains(spark.read.parquet("/root/testdata/sf0.01/labels.parquet")))[1]["classifier"]
    share = np.array(told["label_share"])
    assert np.allclose(told["mean_posterior"], share, rtol=0.2, atol=0.002)
    assert told["log_loss"] < -(share[share > 0] * np.log(share[share > 0])).sum()
    copies = mixing.resample(odd, mixing.mix(odd, labels.limit(0))[0])
    assert copies.columns == odd.columns and copies.count() == len(ODD)
    with pytest.raises(RuntimeError):
        mixing.mix(docs, labels, even, steps=0)
    with pytest.raises(ValueError):
        mixing.mix(docs, labels, {"no such domain": 1})


def test_toxicity(spark, small, odd, nothing):
    for sf, least in (("/root/testdata/sf0.01", 0.86), ("/root/testdata/sf0.1", 0.95)):
        labels = spark.read.parquet(f"{sf}/labels.parquet")
        truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
        # Only rows that nothing was learned from count.
        rows = [r for r in queries.op9_toxicity(spark, sf).collect() if r["doc_id"] in truth and r["held_out"]]
        pos = [r["score"] for r in rows if truth[r["doc_id"]] == 1]
        neg = [r["score"] for r in rows if truth[r["doc_id"]] == 0]
        assert np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]) > least
        assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)
        hits = sum(s >= 0.7 for s in pos)
        assert hits >= 0.7 * len(pos) and hits >= 0.9 * (hits + sum(s >= 0.7 for s in neg))
    # A word with a learned part scores, though no row holds it.
    model = toxicity.learn(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    for text, more in (("und idiotenhaft so " * 4, True), ("und das so " * 4, False)):
        n, segs = toxicity.found(text, model["odds"], {}, model["drift"])
        assert (np.interp(toxicity.evidence(segs, n, model["lam"], model["log_k"]), *model["map"]) >= 0.7) == more


def test_law_and_map_stand_outliers():
    rng = np.random.default_rng(3)
    sizes = np.full(2000, 200.0)
    best = np.maximum(rng.exponential(0.8, 2000) - 0.5, 0)
    plain = toxicity.extreme_law(best, sizes)
    best[:10] = 180.0
    assert np.allclose(toxicity.extreme_law(best, sizes), plain, rtol=0.2)
    x = np.concatenate([rng.uniform(0, 5, 500), rng.uniform(4, 30, 100)])
    at, p = toxicity.monotone(x, np.repeat([0.0, 1.0], [500, 100]))
    assert sorted(at) == at and sorted(p) == p and 0 < p[0] < 0.1 and 0.9 < p[-1] < 1


def test_toxicity_edges(spark, odd, nothing):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    assert len(toxicity.score(odd, labels).collect()) == len(ODD)
    assert toxicity.score(nothing, labels).collect() == []
    assert {r["score"] for r in toxicity.score(odd, labels.limit(0)).collect()} == {0.0}


def test_segments_are_maximal():
    rng = np.random.default_rng(4)
    for _ in range(200):
        x = np.where(rng.random(30) < 0.7, -0.35, rng.uniform(0.5, 2, 30))
        places = [i for i in range(30) if x[i] > 0]

        def plain(lo, hi):
            best = max(((x[a : b + 1].sum(), a, b) for a in range(lo, hi) for b in range(a, hi)), default=(0, 0, 0), key=lambda s: (round(s[0], 9), s[1] - s[2]))
            return [] if best[0] <= 0 else [*plain(lo, best[1]), best, *plain(best[2] + 1, hi)]

        got = toxicity.segments(places, [x[i] for i in places], 0.35)
        assert abs(sum(s for s, _, _ in got) - sum(s for s, _, _ in plain(0, 30))) < 1e-9


def test_repeats(spark, small, docs, odd, nothing):
    got = by_id(queries.op10_suffix_dedup(spark, small))
    for (i, _), want in zip(docs, repeats(docs, 400), strict=True):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == want, i
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = sorted((str(i), *w) for (i, _), w in zip(rows, repeats(rows, 100), strict=True))
    have = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.drop_repeats(odd, 100).collect())
    assert have == want
    assert suffix.drop_repeats(nothing).collect() == []


def test_shared_passages(spark):
    """Passages of 51 words are noticed in both documents, however short their words; 31 shared words or one document's own repeats are not."""
    rng = np.random.default_rng(12)
    fresh = lambda n: [f"{a}{b}" for a, b in zip(rng.integers(0, 10**6, n), rng.choice(list("xyz"), n), strict=True)]
    tiny = lambda n: list(rng.choice(list("abcdefgh"), n))
    long_, short, below = fresh(51), tiny(51), fresh(31)
    texts = [fresh(80) + long_ + fresh(90), fresh(3) + long_, fresh(70) + short + fresh(5), short + fresh(60), fresh(60) + below + fresh(60), below + fresh(80)]
    own = fresh(60)
    rows = [(i, " ".join(t)) for i, t in enumerate([*texts, own + own, fresh(200), []])] + [(50, None), (51, " ".join(fresh(100))), (51, " ".join(fresh(100)))]
    got = suffix.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_shared"] > 0 for r in got} == {0: True, 1: True, 2: True, 3: True, 4: False, 5: False, 6: False, 7: False, 8: False, 50: False, 51: False}


@pytest.mark.parametrize("group", [2000, 2])
def test_repeats_of_all_shapes(spark, group, monkeypatch):
    """Small alphabets, nested passages, edited copies; with group 2 nearly all anchors go the way of hot ones."""
    monkeypatch.setattr(suffix, "GROUP", group)
    rng = np.random.default_rng(9)
    base = "".join(rng.choice(list("abcdefgh "), 900))
    rows = []
    for i in range(60):
        a, b = sorted(rng.integers(0, 900, 2))
        head, tail = ("".join(rng.choice(list("ab"), rng.integers(0, 150))) for _ in range(2))
        rows.append((i, head + base[a:b] + tail))
    rows += [(100, "ab" * 300), (101, "é" * 200), (102, base), (103, base[:450] + "#" + base[450:])]
    want = repeats(rows, 64)
    got = by_id(suffix.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 64))
    for (i, _), w in zip(rows, want, strict=True):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == w, i


CLASHES = ("node", "key", "held_out", "__row", "row", "lines", "marks", "own", "k", "comp", "p", "slots", "rate", "__rate", "t")


def test_clashing_columns(spark):
    """Operators that keep a table's other columns keep them whatever their names."""
    columns = ", ".join(f"{c} string" for c in CLASHES)
    rows = [(i, f"line {i}\nsame boilerplate line here\n" + " ".join(WORDS[i : i + 60]), *CLASHES) for i in range(8)]
    df = spark.createDataFrame([*rows, (9, None, *CLASHES), (None, "x", *CLASHES)], f"doc_id long, text string, {columns}")
    for out in (linededup.drop_lines(df), mixing.resample(df, spark.createDataFrame([(i, 1.0) for i in range(10)], "doc_id long, rate double")), neardup.drop_near_duplicates(df)):
        assert out.columns == df.columns
        assert all(tuple(r)[2:] == CLASHES for r in out.collect())
    kept = langid.keep_identified(df.withColumn("lang", F.lit("en")), queries.vocabulary(queries.PIECE_VOCABULARY))
    assert kept.columns == [*df.columns, "lang"] and all(r["node"] == "node" for r in kept.collect())


def test_language_rejects(spark):
    """Texts in no learned language go; short clean texts stay."""
    docs = [(i, "the cat sat on the mat and the dog ran to the house with a ball", "en") for i in range(40)]
    docs += [(100, "xqzvk jjqwx zzkqv wxqjz kvqxz", "en"), (101, "12345 !!", "en"), (102, None, None), (103, "the dog", None), (104, "дом стоит на холме", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in langid.keep_identified(df, queries.vocabulary(queries.PIECE_VOCABULARY)).collect()}
    assert set(range(40)) | {103} <= kept and not kept & {100, 101, 102, 104}


def test_pieces_of_long_texts(monkeypatch):
    """What is worked out over pieces does not depend on where they end."""
    rng = np.random.default_rng(6)
    text = " ".join("".join(rng.choice(list("abé "), int(rng.integers(1, 9)))) for _ in range(900))
    raw, hasher = text.encode(), ByteHasher()
    whole = set(zip(*(x.tolist() for x in suffix.anchors_of(raw, 100, hasher)), strict=True))
    words, keys = neardup.word_hashes(raw, hasher), suffix.passage_keys(raw, hasher)
    spoken = [w for some in langid.parts([text, None, text]) for row, found in some if row == 2 for w in found]
    monkeypatch.setattr(neardup, "PIECE", 61)
    monkeypatch.setattr(langid, "SLICE", 37)
    assert all(np.array_equal(a, b) for a, b in zip(words, neardup.word_hashes(raw, hasher), strict=True))
    assert np.array_equal(keys, suffix.passage_keys(raw, hasher)) and len(keys)
    assert spoken == [w for some in langid.parts([text, None, text]) for row, found in some if row == 2 for w in found]
    # An anchor at a border may stand for two runs of windows there; together they cover the same windows at the same gram.
    monkeypatch.setattr(suffix, "PIECE", 700)
    cut = list(zip(*(x.tolist() for x in suffix.anchors_of(raw, 100, hasher)), strict=True))
    covered = lambda rows: sorted((w, h, p) for h, p, lo, hi, _ in rows for w in range(lo, hi + 1))
    assert covered(cut) == covered(whole)


def test_scratch(spark, tmp_path):
    """A scope's tables go at its end, but for those that are kept; without spark.checkpoint.dir a cluster is refused."""
    from stylarium.llm import common

    with common.scratch(spark):
        with common.scratch(spark):
            gone = common.cut(spark.range(3), "gone")
            stays = common.cut(gone, "stays", keep=True)
        assert stays.count() == 3
        with pytest.raises(Exception):
            spark.read.parquet(gone.inputFiles()[0]).count()


def test_pipeline(spark, small, tmp_path):
    import corpus_pipeline as c

    source = spark.read.parquet(f"{small}/documents.parquet")
    tables = [source]
    for name, stage in c.STAGES:
        stage(spark, tables[-1], small).write.parquet(str(tmp_path / name))
        tables.append(spark.read.parquet(str(tmp_path / name)))
    read = [[(r["doc_id"], r["text"]) for r in t.collect()] for t in tables[:5]]
    docs, language, lines, near, mixed = read
    assert all(t.columns == source.columns for t in tables[:5])
    # Language: everything of some length in a learned language stays as it is.
    assert {i for i, t in docs if t and len(t.split()) >= 5} <= dict(language).keys() and set(language) <= set(docs)
    # Line dedup: every row stays, and only whole lines go, those that stay in their order.
    assert [i for i, _ in sorted(lines)] == [i for i, _ in sorted(language)]
    before = dict(language)
    for i, t in lines:
        left = iter(before[i].split("\n"))
        assert t == "" or all(line in left for line in t.split("\n"))
    # Near copies: the least document of each group by full sets.
    assert {i for i, _ in near} == {i for i, (_, comp) in near_components(lines, 5, 80).items() if i == comp}
    # Mixing: each row as often as its rate says, up to the draw.
    labels = mixing.label_domains(spark.read.parquet(f"{small}/labels.parquet"))
    rates = {r["doc_id"]: r["rate"] for r in mixing.mix(tables[3], labels)[0].collect()}
    times = Counter(i for i, _ in mixed)
    assert all(int(rates[i]) <= times[i] <= int(rates[i]) + 1 for i, _ in near) and set(mixed) <= set(near)
    # Packing: a piece for every copy, sequences without gaps.
    rows = tables[5].collect()
    assert Counter(r["doc_id"] for r in rows if r["start"] == 0) == times
    ends: dict = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048
    assert set(c.run(spark, small).columns) == set(Row(doc_id=1, start=1, length=1, ids_crc32=1, doc_tokens=1, sequence_id=1, offset=1).asDict())


def test_pipeline_odd(spark, odd, nothing, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables go through every stage but the last."""
    import corpus_pipeline as c

    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in c.STAGES:
        for n, table in enumerate((odd, nothing)):
            out = stage(spark, table, str(tmp_path))
            rows = out.collect()
            assert n == 0 or rows == []
            assert name == "pack_sequences" or out.columns == table.columns


def test_whole_pieces_and_whole_secrets(spark):
    """A piece of twenty letters is an edge like any other, and a token of two thousand signs is one span."""
    long = "abcdefghijklmnopqrst"
    index = {"▁" + long: 0, long: 1} | {c: 2 + i for i, c in enumerate(sorted(set(long)))}
    table = np.full((len(index) + 1, 1), 1e-3)
    table[0] = 0.5
    log = langid.forward([long, long + long], index, table)[:, 0]
    assert abs(log[0] - np.log(0.5 + 0)) < 0.01 and abs(log[1] - np.log(0.5 * 1e-3)) < 0.01
    assert any(len(w) > 13 for w in langid.vocabulary(queries.vocabulary(queries.PIECE_VOCABULARY)))
    sign = "aB3" * 667
    text = f"The token: {sign} is mine."
    found = spark.createDataFrame([(1, text)], "doc_id long, text string").select(pii.placed(F.col("text"), pii.WIDE["secret"]).alias("x")).first()["x"]
    assert [(r[0], r[1]) for r in found] == [(11, 11 + len(sign))]
