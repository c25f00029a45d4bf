"""MinHash near-dedup (operator 6): HyperMinHash registers, banding, corrected estimates, full-set verification.

A document's set is its distinct k-word shingles, A-Z lower-cased, words the
runs of non-white-space. A register holds the leading-zero count and mantissa
bits of the smallest hash of its bucket, in 16 bits. Documents of many shingles
fill the registers by one permutation, those of few by one permutation per
register, and sizes near the border by both.

Rows of equal sets are one class before anything else. Classes that share a
band key are candidates. Texts, registers and copies meet what is asked of them
by joins, but behind a Bloom filter of bounded size, so that rows nothing is
asked of stay in their scan; a full filter only lets more rows reach the join. In each star round every bucket compares its members
with one pseudo-random member by corrected register estimates, confirmed on full sets, so that large
groups of near copies merge without all pairs. Members of buckets that still
hold several components then meet their bucket's centre once, and keep only the
shingles in which they differ from it; those, in blocks of bounded size, decide
every pair of different components exactly. Links inside a component are never
needed.

Edge cases: null text, and text without words, has the empty set, n_shingles 0,
and is linked with nothing; fewer than k words give one shingle, the whole
sequence. Rows that repeat a doc_id stay as they are, each with the component
of its own set; a null doc_id is never compared and forms its own component
(null). An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import filter_of, may_hold
from .common import ByteHasher, bound_batches, components, cut, lean, mix64, scratch

REGISTERS, BANDS, ROWS, MANTISSA = 256, 36, 7, 10
FEW = 256  # shingles up to which each register has a permutation of its own
EMPTY = 0xFFFF
BLOCK, BLOCK_BYTES, COLUMNS = 256, 4 << 20, 4096  # members and bytes of a block; columns of a product
PIECE = 1 << 19  # bytes hashed at once
GAP = re.compile(rb"[\x20\x09-\x0d]")
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
ODD = np.random.default_rng(7).integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(raw: bytes, hasher: ByteHasher) -> tuple[np.ndarray, np.ndarray]:
    """The start and the hash of each word, worked out over pieces of PIECE bytes that end between words."""
    starts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    at = 0
    while at < len(raw):
        space = GAP.search(raw, at + PIECE)
        stop = space.start() if space else len(raw)
        data = np.frombuffer(raw, np.uint8, stop - at, at)
        solid = ~WHITE[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).astype(np.int8)))
        starts.append(edge[::2] + at)
        hashes.append(hasher.ranges(hasher.prefix(data), edge[::2], edge[1::2]))
        at = stop
    return np.concatenate(starts), np.concatenate(hashes)


def shingles(texts: list[str | None], k: int, hasher: ByteHasher) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    ends_doc = np.cumsum([len(r) + 1 for r in raw])
    start, words = word_hashes(b"\n".join([*raw, b""]), hasher)
    first = np.searchsorted(start, np.concatenate(([0], ends_doc)))
    grams = np.zeros(len(words), np.uint64)
    if len(words) >= k:
        acc = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            acc = (acc ^ words[j : len(words) - k + 1 + j]) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(j + 1)
        grams[: len(acc)] = mix64(acc)
    out = []
    for i in range(len(raw)):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            x = np.array([b - a], np.uint64)  # arrays wrap around silently
            for w in words[a:b]:
                x = (x ^ w) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(77)
            out.append(mix64(x))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def compress(value: np.ndarray, bits: int) -> np.ndarray:
    """Leading-zero count and MANTISSA bits after the leading one, of values of so many bits."""
    v = value >> np.uint64(max(0, bits - 52))
    bits = min(bits, 52)
    v = np.maximum(v, np.uint64(1))
    exponent = np.frexp(v.astype(np.float64))[1]
    zeros = (bits - exponent).astype(np.uint64)
    mantissa = ((v << (zeros + np.uint64(1))) & np.uint64((1 << bits) - 1)) >> np.uint64(bits - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


def registers(s: np.ndarray, percent: int) -> tuple[np.ndarray | None, np.ndarray | None]:
    """One-permutation registers (many shingles), and those of a permutation each (few).

    Sizes that may reach percent with more than FEW shingles have both, so that each pair at the threshold shares a kind.
    """
    many = few = None
    if len(s) >= percent * (FEW + 1) // 100 - 1:
        shift = np.uint64(64 - REGISTERS.bit_length() + 1)
        which = (s >> shift).astype(np.int64)
        mask = (np.uint64(1) << shift) - np.uint64(1)
        first = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
        many = np.full(REGISTERS, EMPTY, np.uint16)
        many[which[first]] = compress(s[first] & mask, int(shift))  # s is sorted: the first of a bucket is its least
    if 0 < len(s) <= FEW:
        x = s[:, None] * ODD[None, :]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        few = compress(x.min(axis=0), 64)
    return many, few


def band_keys(reg: np.ndarray, kind: int) -> np.ndarray:
    """A 64-bit key for each band; bands without any filled register give none."""
    x = reg[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    used = (x != EMPTY).any(axis=1)
    acc = np.arange(BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(kind)
    for j in range(ROWS):
        acc = mix64((acc ^ x[:, j]) * np.uint64(0x9FB21C651E98DF25) + np.uint64(j + 1))
    return acc[used].view(np.int64)


def signer(k: int, percent: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = ByteHasher()
        for pdf in it:
            rows = []
            size = pdf["text"].str.len().fillna(0).to_numpy().cumsum()
            for _, part in pdf.groupby((size // 500_000).astype(int), sort=False):
                for doc, own, row, s in zip(part["doc_id"], part["own"], part["row"], shingles(list(part["text"]), k, hasher), strict=True):
                    many, few = registers(s, percent)
                    keys = [band_keys(r, kind) for kind, r in enumerate((many, few)) if r is not None]
                    rows.append(
                        (
                            doc,
                            own,
                            row,
                            len(s),
                            hashlib.md5(s.tobytes()).digest() if len(s) else None,
                            np.concatenate(keys) if keys else np.zeros(0, np.int64),
                            None if many is None else many.tobytes(),
                            None if few is None else few.tobytes(),
                        )
                    )
            out = pd.DataFrame(rows, columns=["doc_id", "own", "row", "n_shingles", "set_id", "keys", "many", "few"])
            yield out.astype({"doc_id": "Int64"})

    return lean(run)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of two (n, REGISTERS) arrays, row by row."""
    filled = (a != EMPTY) | (b != EMPTY)
    same = ((a == b) & filled).sum(axis=-1)
    ratio = same / np.maximum(filled.sum(axis=-1), 1)
    chance = 0.17 * 2.0**-MANTISSA  # of equal registers of two unrelated sets
    return (ratio - chance) / (1 - chance)


def _tables(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    have = column.notna().to_numpy()
    empty = bytes(2 * REGISTERS)
    return have, np.frombuffer(b"".join(x if h else empty for x, h in zip(column, have, strict=True)), np.uint16).reshape(
        -1, REGISTERS
    )


def screener(least: float):
    """Keeps the pairs whose estimate may reach the threshold."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            keep = np.zeros(len(pdf), bool)
            for kind in ("many", "few"):
                (ha, xa), (hb, xb) = _tables(pdf[f"{kind}_a"]), _tables(pdf[f"{kind}_b"])
                keep |= ha & hb & (estimate(xa, xb) >= least)
            yield pdf.loc[keep, ["a", "b"]]

    return run


def differ(k: int):
    """The shingles in which a member and its centre differ: with both sizes they hold all that is asked of the full sets."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = ByteHasher()
        last, centre = None, np.zeros(0, np.uint64)
        for pdf in it:
            size, delta = [], []
            for i in range(0, len(pdf), 64):
                part = pdf.iloc[i : i + 64]
                for at, text, s in zip(part["centre"], part["centre_text"], shingles(list(part["text"]), k, hasher), strict=True):
                    if at != last:  # rows come sorted by centre
                        last, centre = at, shingles([text], k, hasher)[0]
                    size.append(len(s))
                    delta.append(np.setxor1d(s, centre, assume_unique=True).tobytes())
            yield pd.DataFrame({"centre": pdf["centre"], "node": pdf["node"], "comp": pdf["comp"], "main": pdf["main"], "size": size, "delta": delta})

    return lean(run)


def _shared(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of one shares with each of two; a set has no element twice."""
    sides = [(np.concatenate(x), np.repeat(np.arange(len(x)), [len(v) for v in x])) for x in (one, two)]
    both = np.intersect1d(sides[0][0], sides[1][0])
    out = np.zeros((len(one), len(two)), np.int64)
    if not len(both):
        return out
    places = []
    for values, rows in sides:
        at = np.minimum(np.searchsorted(both, values), len(both) - 1)
        hit = both[at] == values
        places.append((rows[hit], at[hit]))
    for low in range(0, len(both), COLUMNS):
        a, b = (np.zeros((len(x), COLUMNS), np.float32) for x in (one, two))
        for m, (rows, at) in zip((a, b), places, strict=True):
            here = (at >= low) & (at < low + COLUMNS)
            m[rows[here], at[here] - low] = 1
        out += (a @ b.T).astype(np.int64)
    return out


def crosser(percent: int):
    """Links of two blocks of a family between different components, exact from the members' differences to one centre.

    With d the differences of a set to the centre, two sets differ in |d| + |e| - 2 |d and e| shingles. Pairs go by falling
    similarity, and those that links found before them have joined are left out.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples():
                one, two = pd.DataFrame(list(r.x)), pd.DataFrame(list(r.y))
                sets = [[np.frombuffer(v, np.uint64) for v in frame["delta"]] for frame in (one, two)]
                (ca, sa), (cb, sb) = ((frame["comp"].to_numpy(), frame["size"].to_numpy()) for frame in (one, two))
                da, db = (np.array([len(v) for v in x]) for x in sets)
                total = sa[:, None] + sb[None, :]
                both = (total - da[:, None] - db[None, :]) // 2 + _shared(*sets)
                i, j = np.nonzero((ca[:, None] != cb[None, :]) & (100 * both >= percent * (total - both)))
                root: dict[int, int] = {}

                def find(c: int, root: dict[int, int] = root) -> int:
                    while root.get(c, c) != c:
                        c = root[c]
                    return c

                links = []
                for n in np.argsort(-(both[i, j] / (total[i, j] - both[i, j])), kind="stable"):
                    x, y = find(int(ca[i[n]])), find(int(cb[j[n]]))
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        links.append((one["node"][i[n]], two["node"][j[n]]))
                if links:
                    ids = np.array(links, np.int64)
                    yield pd.DataFrame({"a": ids.min(axis=1), "b": ids.max(axis=1)})

    return lean(run)


def verifier(k: int, percent: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = ByteHasher()
        for pdf in it:
            keep = []
            for i in range(0, len(pdf), 256):
                part = pdf.iloc[i : i + 256]
                for x, y in zip(
                    shingles(list(part["text_a"]), k, hasher), shingles(list(part["text_b"]), k, hasher), strict=True
                ):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both) > 0)
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    return run


def held_by(hashes: DataFrame, h: Column) -> Column:
    """Whether a filter of the hashes, worked out once and written, may hold h."""
    held = filter_of(hashes)
    return may_hold(replace(held, words=cut(held.words, "filter")), h)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose key, a long, is not in gone; only those that a filter of gone may hold are shuffled."""
    held = held_by(gone.select(F.xxhash64(key)), F.xxhash64(F.col(key).cast("long")))
    return rows.where(~held).union(rows.where(held).join(gone, key, "left_anti").select(*rows.columns))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, star_rounds: int = 2
) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    with scratch(docs.sparkSession):
        found = _near_duplicates(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), k, percent, star_rounds)
        return cut(found, "components", keep=True)


def _near_duplicates(docs: DataFrame, k: int, percent: int, star_rounds: int) -> DataFrame:
    bound_batches(docs.sparkSession)
    docs = docs.withColumn("own", F.xxhash64("text"))
    j = percent / 100
    least = j - 4.2 * (j * (1 - j) / REGISTERS) ** 0.5
    signed = cut(
        docs.withColumn("row", F.monotonically_increasing_id()).mapInPandas(
            signer(k, percent),
            "doc_id long, own long, row long, n_shingles long, set_id binary, keys array<long>, many binary, few binary",
        ),
        "signed",
    )
    # A class is written by one row of its least doc_id.
    classes = signed.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min(F.struct("doc_id", "row", "own")).alias("rep"))
    classes = cut(classes.select(F.xxhash64("set_id").alias("node"), "set_id", "rep.*"), "classes")
    members = signed.where("set_id is not null and doc_id is not null")
    copies = cut(members.select("set_id", "row").join(classes.select("set_id", "row"), ["set_id", "row"], "left_anti").select("row"), "copies")
    pairs_of = without(members.select("row", "set_id", "keys"), copies, "row").select(F.xxhash64("set_id").alias("node"), F.explode("keys").alias("key"))
    sizes = (
        pairs_of.groupBy("key")
        .agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("sum"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("xor"))
        .where("n > 1")
        .groupBy("n", "sum", "xor")
        .agg(F.min("key").alias("key"))  # buckets of the same members, by two 64-bit hashes, count once
    )
    with scratch(docs.sparkSession):  # the shuffle files of all keys go
        buckets = cut(pairs_of.join(sizes.select("key", "n"), "key").select("key", "n", "node"), "buckets", keep=True)
    busy = cut(classes.select("node", "doc_id", "own", "row").join(buckets.select("node").distinct(), "node", "left_semi"), "busy")
    # Rows of one doc_id may differ in text: the text's hash names the row, and equal rows count once.
    # Tables of texts and registers are dealt by key at every size, small ones too, so that plans behave alike.
    read = docs.where(held_by(busy.select(F.xxhash64("doc_id")), F.xxhash64("doc_id")))
    texts = cut(read.join(busy.select("node", "doc_id", "own").hint("merge"), ["doc_id", "own"]).dropDuplicates(["doc_id", "own"]).select("node", "text"), "texts")
    read = signed.where(held_by(busy.select(F.xxhash64("row")), F.xxhash64("row")))
    regs = cut(read.join(busy.select("node", "row").hint("merge"), "row").select("node", "many", "few"), "regs")

    def confirmed(candidates: DataFrame) -> DataFrame:
        left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        return candidates.join(left.hint("merge"), "a").join(right.hint("merge"), "b").mapInPandas(verifier(k, percent), "a long, b long")

    links = cut(buckets.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0), "links")
    labels = buckets.select("node", F.col("node").alias("comp")).limit(0)
    for t in range(star_rounds):
        centre = buckets.groupBy("key").agg(F.min_by("node", F.xxhash64("node", F.lit(t))).alias("centre"))
        named = buckets.join(labels, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
        star = named.join(
            centre.join(labels.withColumnRenamed("node", "centre"), "centre", "left").select(
                "key", "centre", F.coalesce("comp", "centre").alias("at")
            ),
            "key",
        ).where("comp <> at")
        pairs = star.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        pairs = (
            pairs.join(regs.toDF("a", "many_a", "few_a").hint("merge"), "a")
            .join(regs.toDF("b", "many_b", "few_b").hint("merge"), "b")
            .mapInPandas(screener(least), "a long, b long")
        )
        new = cut(confirmed(pairs), "links")
        if new.isEmpty():
            break
        links = links.union(new)
        with scratch(docs.sparkSession):
            labels = cut(components(links), "labels", keep=True)
    # Buckets that hold several components still go to families, a centre and all members of its buckets: neighbouring
    # buckets mostly share their centre, so that a pair meets a few times and not once a bucket.
    named = buckets.join(labels, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    open_ = (
        named.groupBy("key")
        .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by(F.struct("node", "comp"), F.xxhash64("node", F.lit(0))).alias("c"))
        .where("lo < hi")
        .select("key", F.col("c.node").alias("centre"), F.col("c.comp").alias("home"))
    )
    family = named.join(open_, "key").select("centre", "node", "comp", (F.col("comp") == F.col("home")).alias("main")).distinct()
    deltas = cut(
        family.join(texts.hint("merge"), "node")
        .join(texts.toDF("centre", "centre_text").hint("merge"), "centre")
        .mapInPandas(differ(k), "centre long, node long, comp long, main boolean, size long, delta binary"),
        "deltas",
    )
    counts = deltas.groupBy("centre", "main").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.length("delta")) / BLOCK_BYTES)).alias("n"))
    blocks = cut(
        deltas.join(counts, ["centre", "main"])
        .groupBy("centre", "main", F.pmod(F.xxhash64("node"), "n").alias("block"))
        .agg(F.collect_list(F.struct("node", "comp", "size", "delta")).alias("x")),  # about BLOCK
        "blocks",
    )
    # Members of the centre's own component need no links among each other.
    at = blocks.select("centre", "main", "block")
    met = at.where("not main").select("centre", F.col("block").alias("own")).join(at, "centre").where("main or own <= block")
    left = blocks.where("not main").select("centre", F.col("block").alias("own"), "x")
    right = blocks.withColumnRenamed("x", "y")
    new = cut(met.join(left, ["centre", "own"]).join(right, ["centre", "main", "block"]).select("x", "y").mapInPandas(crosser(percent), "a long, b long").distinct(), "links")
    labels = cut(components(links.union(new)), "labels")
    ids = labels.join(classes.select("node", "doc_id"), "node")
    roots = ids.groupBy("comp").agg(F.min("doc_id").alias("component"))
    of_set = (
        labels.join(roots, "comp").join(classes.select("node", "set_id"), "node").select("set_id", "component")
    )
    return (
        signed.select("doc_id", "n_shingles", "set_id")
        .join(classes.select("set_id", F.col("doc_id").alias("rep")), "set_id", "left")
        .join(of_set, "set_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without those that a smaller doc_id of their group stands for.

    Rows of one doc_id stay or go together, so rows repeated as they are stay
    repeated; rows of null doc_id stay.
    """
    found = near_duplicates(docs, k=k, percent=percent).where("not kept").select("doc_id").distinct()
    return without(docs, found, "doc_id")
