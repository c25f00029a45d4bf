"""Packing (operator 3): first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

A document becomes the ids of a public tokenizer, then an end id. Full
sequences are cut off its front; the rest of each document is one item. Items
are dealt by a hash of doc_id and row over groups of bounded expected size, and in each
group put, longest first, into the first sequence with room, found by descending
a tournament tree whose inner nodes hold the most room below them.

Tokenization is exact: texts of a proven-safe alphabet are split by an
equivalent pattern, each different word is encoded once by merging vectorised
over all words; any other text goes through the tokenizer itself.

Edge cases: null text is empty and gives just the end id. Rows that repeat a
doc_id, and rows of null doc_id, are packed as rows of their own. An empty table
gives an empty result. Other columns are ignored. The vocabulary's path is a
parameter and must be readable on the executors.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ByteHasher, bound_batches, cut, lean

SIZE, GROUP_ITEMS, LONG_WORD = 2048, 8192, 48
SLICE, KNOWN_RUNS = 1_000_000, 400_000  # characters encoded at once; runs remembered
NONE = 1 << 30  # the rank of no merge
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
LETTERS = "a-zß-öø-ÿā-ſ"
SAFE = re.compile(r"[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-įı-ſ]")
WORDS = re.compile(rf"[{LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^ \t\n\v\f\r{LETTERS}0-9]+")


class WordPieces:
    """The ids of texts under a word-end BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.hasher = ByteHasher()
        self.forget()
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(plain))}
        self.inner = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[shown[b] + "</w>"] for b in range(256)], np.int32)
        pair = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        # Ranks by pair: a large hash table, and a second one for the few pairs that meet in the first.
        rng = np.random.default_rng(5)
        self.slots: list[tuple[np.uint64, np.ndarray, np.ndarray]] = []
        left = np.arange(len(pair))
        while len(left):
            odd = rng.integers(0, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            keys, ranks = np.full(1 << 20, -1, np.int64), np.full(1 << 20, NONE, np.int32)
            at = ((pair[left].view(np.uint64) * odd) >> np.uint64(44)).astype(np.int64)
            keys[at], ranks[at] = pair[left], left
            self.slots.append((odd, keys, ranks))
            left = left[keys[at] != pair[left]]

    def forget(self) -> None:
        self.known: dict[int, int] = {}  # of runs, by hash
        self.flat, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        key[(left < 0) | (right < 0)] = -2
        out = np.full(len(key), NONE, np.int32)
        for odd, keys, ranks in self.slots:
            at = ((key.view(np.uint64) * odd) >> np.uint64(44)).astype(np.int64)
            hit = keys[at] == key
            out[hit] = ranks[at[hit]]
        return out

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words of at most LONG_WORD bytes: the least rank merges, leftmost first, one merge a word and round."""
        out: list[np.ndarray | None] = [None] * len(words)
        sizes = np.array([len(w) for w in words])
        order = np.argsort(sizes, kind="stable")
        for lo in range(0, len(order), 4096):
            some = order[lo : lo + 4096]
            width = int(sizes[some].max())
            x = np.full((len(some), width), -1, np.int32)
            flat = np.frombuffer(b"".join(words[i] for i in some), np.uint8)
            n = sizes[some]
            x[np.arange(width)[None, :] < n[:, None]] = self.inner[flat]
            x[np.arange(len(some)), n - 1] = self.final[flat[np.cumsum(n) - 1]]
            n = n.copy()
            rank = self.rank_of(x[:, :-1].ravel(), x[:, 1:].ravel()).reshape(len(some), width - 1)
            live = np.flatnonzero(rank.min(axis=1) < NONE) if width > 1 else np.zeros(0, int)
            while len(live):
                j = rank[live].argmin(axis=1)
                r = rank[live, j]
                col = np.arange(width)[None, :]
                y = x[live]
                y = np.where(col > j[:, None], np.concatenate([y[:, 1:], np.full((len(live), 1), -1, np.int32)], axis=1), y)
                y[np.arange(len(live)), j] = self.made[r]
                x[live] = y
                n[live] -= 1
                k = rank[live]
                k = np.where(col[:, :-1] > j[:, None], np.concatenate([k[:, 1:], np.full((len(live), 1), NONE, np.int32)], axis=1), k)
                for off in (-1, 0):
                    at = j + off
                    ok = (at >= 0) & (at < width - 1)
                    row = np.flatnonzero(ok)
                    k[row, at[ok]] = self.rank_of(y[row, at[ok]], y[row, at[ok] + 1])
                rank[live] = k
                live = live[k.min(axis=1) < NONE]
            for i, row, m in zip(some.tolist(), x.astype(np.uint32), n.tolist(), strict=True):
                out[i] = row[:m]
        return out  # type: ignore[return-value]

    def learn_runs(self, hashes: np.ndarray, runs: list[str]) -> None:
        """Adds the ids of new runs of characters without white space."""
        split = [WORDS.findall(r) for r in runs]
        codes, words = pd.factorize(np.array([w for f in split for w in f], dtype=object))
        raw = [w.encode() for w in words]
        ids: list[np.ndarray | None] = [None] * len(raw)
        short = [i for i, w in enumerate(raw) if len(w) <= LONG_WORD]
        for i, x in zip(short, self.merge([raw[i] for i in short]), strict=True):
            ids[i] = x
        long_ = [i for i in range(len(raw)) if ids[i] is None]
        for i, e in zip(long_, self.whole.encode_batch([words[i] for i in long_], add_special_tokens=False), strict=True):
            ids[i] = np.array(e.ids, np.uint32)
        flat, size = spread(np.concatenate(ids), np.array([len(x) for x in ids], np.int64), codes)
        own = np.cumsum(size)[np.cumsum([len(f) for f in split]) - 1]
        self.known.update(zip(hashes.tolist(), range(len(self.sizes), len(self.sizes) + len(runs)), strict=True))
        self.flat = np.concatenate((self.flat, flat))
        self.sizes = np.concatenate((self.sizes, np.diff(own, prepend=0)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        odd = [i for i, t in enumerate(texts) if SAFE.search(t)]
        for i, e in zip(odd, self.whole.encode_batch([texts[i] for i in odd], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32)
        fine = sorted(set(range(len(texts))) - set(odd))
        # No token spans white space: each different run of other characters is split and encoded once.
        raw = [texts[i].lower().encode() for i in fine]
        data = b"\n".join([*raw, b""])
        solid = ~WHITE[np.frombuffer(data, np.uint8)]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        if not len(start):
            return out
        hashes = self.hasher.ranges(self.hasher.prefix(np.frombuffer(data, np.uint8)), start, end)
        codes, different = pd.factorize(hashes)
        if len(self.known) > KNOWN_RUNS:
            self.forget()
        new = np.array([h not in self.known for h in different.tolist()])
        if new.any():
            first = np.empty(len(different), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            first = first[new]
            runs = [data[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
            self.learn_runs(different[new], runs)
        index = np.array([self.known[h] for h in different.tolist()], np.int64)[codes]
        stream, sizes = spread(self.flat, self.sizes, index)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        cuts = ends[np.searchsorted(start, np.cumsum([0] + [len(r) + 1 for r in raw]))]
        for i, a, b in zip(fine, cuts[:-1], cuts[1:], strict=True):
            out[i] = stream[a:b]
        return out


def spread(flat: np.ndarray, size: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of flat (of these sizes) named by codes, one after the other, and their sizes."""
    at = np.concatenate(([0], np.cumsum(size)[:-1]))
    sizes = size[codes]
    ends = np.cumsum(sizes)
    return flat[np.arange(int(ends[-1])) + np.repeat(at[codes] - (ends - sizes), sizes)], sizes


def tokenizer(path: str, end_id: int, size: int):
    """Per piece: full sequences first, then the rest."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = WordPieces(path)
        for pdf in it:
            length = pdf["text"].str.len().fillna(0).to_numpy().cumsum()
            for _, part in pdf.groupby((length // SLICE).astype(int), sort=False):
                rows = []
                for doc, ids in zip(part["doc_id"], pieces.encode(list(part["text"].fillna(""))), strict=True):
                    raw = np.concatenate((ids, [end_id])).astype("<u4").tobytes()
                    n = len(raw) // 4
                    for start in range(0, n, size):
                        cutout = raw[4 * start : 4 * (start + size)]
                        rows.append((doc, start, len(cutout) // 4, zlib.crc32(cutout), n))
                out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
                yield out.astype({"doc_id": "Int64"})

    return lean(run)


def first_fit_decreasing(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """bin and offset of each length, in the given order, bins opened as needed."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    room = [size] * (2 * leaves)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for i in order:
        need, node = lengths[i], 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, size - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


def packer(size: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(pdf["length"].tolist(), size)
        out = pdf.drop(columns="group")
        out["sequence_id"] = (int(pdf["group"].iloc[0]) << 32) + np.array(bins, np.int64)
        out["offset"] = np.array(offsets, np.int64)
        return out

    return run


def pack(
    docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    bound_batches(spark)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = cut(docs.mapInPandas(tokenizer(vocabulary, end_id, size), schema), "pieces")
    groups = max(1, math.ceil(pieces.count() / GROUP_ITEMS))
    return (
        # The written table's row numbers part rows that are alike in all else.
        pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(groups)))
        .groupBy("group")
        .applyInPandas(packer(size), f"{schema}, sequence_id long, offset long")
    )
