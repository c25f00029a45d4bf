"""Suffix-array dedup (operator 10): repeated byte strings of a least length, over a common-prefix interval tree.

Every string of WINDOW bytes has one anchor, the leftmost of its gram positions
with the least hash, so equal strings have equal anchors at equal offsets. An
anchor stands for a run of windows; its context is the bytes they cover. Only
anchors whose gram occurs more than once go on. Equal contexts repeat as a
whole. Of the others, one of each different context of an anchor meets in an
enhanced suffix array: the suffixes at the anchor sorted, with common-prefix
lengths; a stack scan gives the interval tree, and each interval's members are
tested for their left extensions, so that each occurrence, not just
neighbours, gets the longest repeat through it. Anchors with more different
contexts than GROUP never meet in one task: their runs of windows are halved
again and again, and counted by content, until every piece is decided.

Passages of many short words can be shorter than the window. Beside the spans
each row therefore has n_shared, the number of its sampled strings of WORDS
words that stand in another document too: of each run of RUN such strings the
one of least hash is sampled, so that any passage of WORDS + RUN - 1 words or more that
two documents share is noticed, and a document that shares no WORDS words has 0.
Equal rows of one doc_id count as one document there.

Edge cases: null text is empty; strings never cross rows; texts shorter than
the window repeat nothing. Rows repeated with one doc_id (or a null one) count
as documents of their own, so equal rows remove each other's text. Bytes are
those of UTF-8. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ByteHasher, bound_batches, cut, lean, mix64, scratch
from .neardup import word_hashes

GRAM, GROUP, PIECE = 48, 2000, 1 << 19
LOW = (1 << 24) - 1
WORDS, RUN = 32, 20  # passages of over 50 words are noticed


def least_in_windows(v: np.ndarray, width: int) -> np.ndarray:
    """The least value of each run of width values."""
    n = len(v) - width + 1
    pad = -len(v) % width
    x = np.concatenate([v, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors_of(raw: bytes, window: int, hasher: ByteHasher) -> tuple[np.ndarray, ...]:
    """hash, position, first and last window start, context hash of each anchor."""
    gram = min(GRAM, window)
    parts = []
    for at in range(0, len(raw) - window + 1, PIECE):
        data = np.frombuffer(raw, np.uint8, min(PIECE + window - 1, len(raw) - at), at)
        prefix = hasher.prefix(data)
        i = np.arange(len(data) - gram + 1)
        h = hasher.ranges(prefix, i, i + gram)
        low = least_in_windows((h & np.uint64(~LOW & (1 << 64) - 1)) | i.astype(np.uint64), window - gram + 1)
        pos = (low & np.uint64(LOW)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], pos[1:] != pos[:-1])))
        last = np.concatenate((first[1:], [len(pos)])) - 1
        p = pos[first]
        ctx = hasher.ranges(prefix, first, last + window) ^ ((p - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        parts.append((h[p].view(np.int64), p + at, first + at, last + at, ctx.view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else tuple(np.zeros(0, np.int64) for _ in range(5))


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def anchorer(window: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = ByteHasher()
        for pdf in it:
            cols: list[list] = [[] for _ in range(7)]
            for doc, own, text in zip(pdf["doc_id"], pdf["own"], pdf["text"], strict=True):
                raw = encoded(text)
                if len(raw) >= window:
                    got = anchors_of(raw, window, hasher)
                    n = len(got[0])
                    for c, x in zip(cols, (np.full(n, -1 if pd.isna(doc) else int(doc)), np.full(n, own), *got), strict=True):
                        c.append(x)
            if cols[0]:
                yield pd.DataFrame({k: np.concatenate(c) for k, c in zip(("doc_id", "own", "anchor", "pos", "lo", "hi", "ctx"), cols, strict=True)})

    return run


def common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


def range_least(levels: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo:hi] for each pair, from a table of power-of-two ranges."""
    k = np.log2(hi - lo).astype(int)
    out = np.empty(len(lo), np.int64)
    for j in np.unique(k):
        m = k == j
        out[m] = np.minimum(levels[j][lo[m]], levels[j][hi[m] - (1 << j)])
    return out


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of the interval tree's inner nodes, from a stack scan of the common-prefix lengths."""
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > value:
            depth, first = stack.pop()
            if depth >= least:
                yield depth, first, i
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def extents(left: list[bytes], right: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """How far to either side of the anchor each occurrence is covered by strings of window bytes that others share; 0, 0 for none.

    left: the bytes before the anchor, reversed.
    """
    n = len(right)
    far_left, far_right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n == 2:
        x, y = common(left[0], left[1]), common(right[0], right[1])
        if x + y >= window:
            far_left[:], far_right[:] = x, y
        return far_left, far_right
    array = sorted(range(n), key=right.__getitem__)
    lcp = [common(right[a], right[b]) for a, b in zip(array, array[1:], strict=False)]
    by_left = sorted(range(n), key=left.__getitem__)
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    levels = [np.array([common(left[a], left[b]) for a, b in zip(by_left, by_left[1:], strict=False)], np.int64)]
    while len(levels[-1]) > 1 << (len(levels) - 1):
        step = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
    best = np.maximum(np.concatenate((levels[0], [0])), np.concatenate(([0], levels[0])))[rank]
    order = np.array(array)
    for depth, first, last in intervals(lcp, gram):
        own = order[first : last + 1]
        own = own[best[own] + depth >= window]  # the others have no left extension long enough anywhere
        if len(own) < 2:
            continue
        own = own[np.argsort(rank[own])]
        r = rank[own]
        shared = range_least(levels, r[:-1], r[1:])
        if len(shared) and shared.min() == shared.max() and shared[0] + depth < window:
            continue
        reach = np.maximum(np.concatenate((shared, [0])), np.concatenate(([0], shared)))
        ok = reach + depth >= window
        far_left[own[ok]] = np.maximum(far_left[own[ok]], reach[ok])
        far_right[own[ok]] = np.maximum(far_right[own[ok]], depth)
    return far_left, far_right


def slicer(window: int):
    """The contexts of a document's listed anchors."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for doc, own, text, items in zip(pdf["doc_id"], pdf["own"], pdf["text"], pdf["items"], strict=True):
                raw = encoded(text)
                rows += [
                    (doc, own, x["anchor"], x["n"], x["size"], x["pos"], x["lo"], x["hi"], raw[x["lo"] : x["hi"] + window])
                    for x in items
                ]
            yield pd.DataFrame(rows, columns=["doc_id", "own", "anchor", "n", "size", "pos", "lo", "hi", "bytes"])

    return run


def scanner(window: int):
    """Sorted by anchor: the spans of each group's occurrences."""
    gram = min(GRAM, window)

    def spans(group: list) -> list[tuple]:
        left = [g[7][: g[4] - g[5]][::-1] for g in group]
        right = [g[7][g[4] - g[5] :] for g in group]
        x, y = extents(left, right, window, gram)
        return [(g[0], g[1], g[4] - a, g[4] + b) for g, a, b in zip(group, x.tolist(), y.tolist(), strict=True) if b and g[3] == 1]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: list = []
        for pdf in it:
            out: list[tuple] = []
            columns = [pdf[c].tolist() for c in ("doc_id", "own", "anchor", "n", "pos", "lo", "hi", "bytes")]
            for row in zip(*columns, strict=True):
                if group and group[0][2] != row[2]:
                    out += spans(group) if len(group) > 1 else []
                    group = []
                group.append(row)
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "own", "start", "end"])
        if len(group) > 1 and (out := spans(group)):
            yield pd.DataFrame(out, columns=["doc_id", "own", "start", "end"])

    return run


def refined(hot: DataFrame, window: int) -> DataFrame:
    """Spans for anchors of very many contexts, by counting halves of their runs of windows.

    A window l bytes before the anchor lies in the aligned range of its l. All
    windows of a range share its core; a core that occurs once repeats nothing,
    a piece whose whole content occurs again repeats as a whole, and the rest is
    halved, down to single windows, which are decided by the count.
    """
    size = 1
    while size * 4 <= window:
        size *= 2
    live = hot.select("doc_id", "own", "anchor", "pos", (F.col("pos") - F.col("hi")).alias("l1"), (F.col("pos") - F.col("lo")).alias("l2"), "bytes", "n")
    live = live.withColumn(
        "d", F.explode(F.sequence(F.expr(f"l1 div {size} * {size}"), F.expr(f"l2 div {size} * {size}"), F.lit(size).cast("long")))
    )
    spans = None
    while True:
        top = f"least(d + {size - 1}, l2)"
        bottom = "greatest(d, l1)"
        piece = live.select(
            "*",
            F.expr(f"md5(substring(bytes, int(l2 - d + 1), {window - size + 1}))").alias("core"),
            F.expr(f"md5(substring(bytes, int(l2 - {top} + 1), int({window} + {top} - {bottom})))").alias("whole"),
            F.expr(bottom).alias("from_l"),
            F.expr(top).alias("to_l"),
        )
        piece = cut(piece, "pieces")
        # A context that several rows share stands here once, with n of them.
        cores = piece.groupBy("anchor", "d", "core").agg(F.count("*").alias("cores")).where("cores > 1")
        wholes = piece.groupBy("anchor", "from_l", "to_l", "whole").agg(F.count("*").alias("wholes")).where("wholes > 1")
        marked = piece.join(cores, ["anchor", "d", "core"]).join(wholes, ["anchor", "from_l", "to_l", "whole"], "left")
        marked = cut(marked, "marked")
        done = marked.where("wholes is not null and n = 1").select(
            "doc_id", "own", (F.col("pos") - F.col("to_l")).alias("start"), (F.col("pos") - F.col("from_l") + window).alias("end")
        )
        spans = done if spans is None else spans.union(done)
        if size == 1:
            return spans
        # Pieces that repeat as a whole stay as partners of those still open.
        size //= 2
        live = (
            marked.select("doc_id", "own", "anchor", "pos", "l1", "l2", "bytes", "n", F.explode(F.array(F.col("d"), F.col("d") + size)).alias("d"), "wholes")
            .where(f"d <= l2 and d + {size - 1} >= l1")
            .withColumn("n", F.when(F.col("wholes").isNotNull(), F.greatest("n", F.lit(2))).otherwise(F.col("n")))
            .drop("wholes")
        )


def repeated_spans(docs: DataFrame, window: int = 400) -> DataFrame:
    """doc_id, own, start, end: byte ranges (they may overlap) covered by strings of window bytes that start elsewhere too.

    docs: doc_id long, own long (a hash that tells rows of one doc_id apart), text.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    anchors = cut(
        docs.mapInPandas(anchorer(window), "doc_id long, own long, anchor long, pos long, lo long, hi long, ctx long"), "anchors"
    )
    classes = cut(
        anchors.groupBy("anchor", "ctx").agg(
            F.count("*").alias("n"), F.min(F.struct("doc_id", "own", "pos", "lo", "hi")).alias("rep")
        ),
        "classes",
    )
    # Only anchors with a context of its own beside another one need their bytes.
    groups = classes.groupBy("anchor").agg(F.count("*").alias("size"), F.min("n").alias("least")).where("size > 1 and least = 1")
    whole = anchors.join(classes.where("n > 1").select("anchor", "ctx").hint("merge"), ["anchor", "ctx"]).select(
        "doc_id", "own", F.col("lo").alias("start"), (F.col("hi") + window).alias("end")
    )
    work = (
        classes.join(groups.hint("merge"), "anchor")
        .select("rep.doc_id", "rep.own", F.struct("anchor", "n", "size", "rep.pos", "rep.lo", "rep.hi").alias("item"))
        .groupBy("doc_id", "own")
        .agg(F.collect_list("item").alias("items"))  # no more than the document is long
    )
    contexts = cut(
        docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))
        .join(work.hint("merge"), ["doc_id", "own"])  # dealt alike at every size
        .mapInPandas(
            slicer(window), "doc_id long, own long, anchor long, n long, size long, pos long, lo long, hi long, bytes binary"
        ),
        "contexts",
    )
    small = contexts.where(F.col("size") <= GROUP)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    found = (
        small.repartition(n, "anchor")
        .sortWithinPartitions("anchor")
        .mapInPandas(scanner(window), "doc_id long, own long, start long, end long")
    )
    hot = contexts.where(F.col("size") > GROUP)
    spans = whole.union(found)
    return spans if hot.isEmpty() else spans.union(refined(hot, window))


def passage_keys(raw: bytes, hasher: ByteHasher, words: int = WORDS, run: int = RUN) -> np.ndarray:
    """The distinct hashes of the sampled strings of words."""
    each = word_hashes(raw, hasher)[1]
    n = len(each) - words + 1
    if n < run:
        return np.zeros(0, np.int64)
    hasher.reserve(len(each))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each * hasher.up[: len(each)], dtype=np.uint64)))
    strings = mix64((total[words:] - total[:-words]) * hasher.down[:n])
    return np.unique(least_in_windows(strings, run)).view(np.int64)


def sampler(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hasher = ByteHasher()
    for pdf in it:
        keys = [passage_keys(encoded(t), hasher) for t in pdf["text"]]
        ids = np.repeat(pdf["id"].to_numpy(np.int64), [len(k) for k in keys])
        yield pd.DataFrame({"id": ids, "key": np.concatenate([np.zeros(0, np.int64), *keys])})


def shared_passages(docs: DataFrame) -> DataFrame:
    """id, n_shared of the rows (id, text) that share sampled strings with a row of another id."""
    keys = cut(docs.mapInPandas(lean(sampler), "id long, key long"), "passages")
    both = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    return keys.join(both.hint("merge"), "key", "left_semi").distinct().groupBy("id").agg(F.count("*").alias("n_shared"))


def cutter(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cuts the spans out of each text."""
    for pdf in it:
        rows = []
        for doc, text, starts, ends, shared in zip(pdf["doc_id"], pdf["text"], pdf["starts"], pdf["ends"], pdf["n_shared"], strict=True):
            raw, kept, at, runs, removed = encoded(text), [], 0, [], 0
            if starts is not None:
                for a, b in sorted(zip(starts, ends, strict=True)):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], int(b))
                    else:
                        runs.append([int(a), int(b)])
            for a, b in runs:
                kept.append(raw[at:a])
                removed += b - a
                at = b
            rest = b"".join([*kept, raw[at:]])
            rows.append((doc, len(raw), removed, len(runs), hashlib.sha256(rest).hexdigest(), rest, [tuple(r) for r in runs], shared))
        out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans", "n_shared"])
        yield out.astype({"doc_id": "Int64"})


def drop_repeats(docs: DataFrame, window: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary), spans (array of start, end), n_shared."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("own", F.xxhash64("text"))
    row_id = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "own")
    with scratch(docs.sparkSession):
        spans = (
            repeated_spans(docs, window)
            .distinct()
            .groupBy("doc_id", "own")
            .agg(F.collect_list(F.struct("start", "end")).alias("s"))  # no more than the document is long
            .select(F.col("doc_id").alias("k"), F.col("own").alias("o"), F.col("s.start").alias("starts"), F.col("s.end").alias("ends"))
        )
        spans = cut(spans, "spans", keep=True)
    with scratch(docs.sparkSession):
        shared = cut(shared_passages(docs.select(row_id.alias("id"), "text")), "shared", keep=True)
    # Both small tables are joined first, so that the texts are dealt once.
    marks = spans.withColumn("id", F.xxhash64("k", "o")).join(shared, "id", "full")
    found = docs.withColumn("id", row_id).join(marks.hint("merge"), "id", "left")
    own = (F.coalesce("doc_id", F.lit(-1)) == F.col("k")) & (F.col("own") == F.col("o"))
    return found.select("doc_id", "text", F.when(own, F.col("starts")).alias("starts"), F.when(own, F.col("ends")).alias("ends"), F.coalesce("n_shared", F.lit(0)).alias("n_shared")).mapInPandas(
        lean(cutter),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:long,end:long>>, n_shared long",
    )
