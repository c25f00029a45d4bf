"""Language identification (operator 4): segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of the vocabulary. A word's
probability is the sum over all its segmentations into pieces, by a forward
algorithm; a text's is the product over its words. The piece probabilities are
fitted by expectation-maximisation (forward-backward) on the word counts of a
bounded, hash-chosen sample of labelled rows per language (at most SAMPLE_DOCS
rows and, after the first row, SAMPLE_CHARS characters each); every text is
scored whole, in parts of bounded size.

keep_identified rejects a text if it has no letters, if its language is more
doubtful than asked, or if even its best language explains it worse than
letters drawn evenly from ALPHABET would: it is in none of the languages.

Edge cases: text that is null or has no letters is `und` with score 0. Rows
repeated stay as they are; null doc_id is neither held out nor learned from.
Without any labelled row every text is `und`. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, lean

SAMPLE_DOCS = 300  # labelled rows a language that the model is fitted on
SAMPLE_CHARS = 5_000_000  # and characters a language, beyond its first row
PART = 60  # letters of a word that are learned from at once
WORDS_AT_ONCE, CELLS_AT_ONCE = 20_000, 100_000  # of a lattice that is worked on at once
SLICE, KNOWN_WORDS, KNOWN_LETTERS = 1_000_000, 200_000, 4_000_000  # characters split at once; words remembered
ALPHABET = 32  # letters of the model that a language must beat
WORD = re.compile(r"[^\W\d_]+")
NO_LETTER = re.compile(r"[\W\d_]")
PIECE_START = "▁"


def vocabulary(path: str) -> list[str]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    words = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    words = {w.lower() for w in words if WORD.fullmatch(w.removeprefix(PIECE_START) or "a")}
    return sorted(words - {"", PIECE_START})


class Trie:
    """The pieces as a tree: child nodes by (node, character), and the piece that ends at a node or -1."""

    def __init__(self, pieces: dict[str, int]) -> None:
        edges: dict[int, int] = {}
        ends = {0: -1}
        self.longest = max((len(p.removeprefix(PIECE_START)) for p in pieces), default=1)  # letters of a piece
        for piece, p in pieces.items():
            node = 0
            for c in piece:
                node = edges.setdefault(node << 21 | ord(c), len(edges) + 1)
                ends.setdefault(node, -1)
            ends[node] = p
        self.keys = np.array(sorted(edges), np.int64)
        self.child = np.array([edges[k] for k in self.keys.tolist()], np.int64)
        self.piece = np.array([ends[n] for n in range(len(ends))], np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which nodes have a child by char, and those children."""
        key = node << 21 | char
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        have = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        return have, self.child[at[have]] if len(self.keys) else node[have]


def lattice(words: list[str], trie: Trie, unknown: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges (word, from, to, piece) in this order; single characters outside the vocabulary are the unknown piece.

    All words walk down the tree together, a character a step. A word's first piece starts with the mark.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    chars = np.frombuffer("".join(PIECE_START + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ends = np.cumsum(sizes + 1)
    word = np.repeat(np.arange(len(words)), sizes)
    start = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    single = np.ones(len(word), bool)  # no piece of this one letter so far
    place = np.arange(len(word))
    at = (ends - sizes)[word] + start
    at[start == 0] -= 1
    node = np.zeros(len(word), np.int64)
    have, node = trie.step(node, chars[at])
    place, at = place[have], at[have] + 1
    found = []
    marked = start == 0
    for _ in range(trie.longest + 1):
        length = at - (ends - sizes)[word[place]] - start[place]
        full = (trie.piece[node] >= 0) & (length > 0)
        found.append((place[full], length[full], trie.piece[node[full]]))
        single[place[full & (length == 1)]] = False
        inside = at < ends[word[place]]
        place, at, node = place[inside], at[inside], node[inside]
        have, node = trie.step(node, chars[at])
        place, at = place[have], at[have] + 1
        if not len(place):
            break
    alone = np.flatnonzero(single)
    found.append((alone, np.ones(len(alone), np.int64), np.full(len(alone), unknown)))
    place, length, piece = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(place * (trie.longest + 1) + length, kind="stable")
    place, length, piece = place[order], length[order], piece[order]
    return word[place], start[place], start[place] + length, piece


def chunks(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of words by rising size, so many at once that words times letters stay bounded; a longer word is alone."""
    order = np.argsort(sizes, kind="stable")
    lo = 0
    while lo < len(order):
        hi = min(lo + WORDS_AT_ONCE, len(order))
        while hi > lo + 1 and (hi - lo) * (int(sizes[order[hi - 1]]) + 1) > CELLS_AT_ONCE:
            hi = lo + (hi - lo) // 2
        yield order[lo:hi]
        lo = hi


def forward(words: list[str], index: Trie | dict[str, int], table: np.ndarray) -> np.ndarray:
    """(words, languages) log-probabilities, all segmentations summed. table: (pieces + 1, languages) probabilities."""
    trie = index if isinstance(index, Trie) else Trie(index)
    out = np.empty((len(words), table.shape[1]))
    sizes = np.array([len(w) for w in words], np.int64)
    for some in chunks(sizes):
        w, i, j, p = lattice([words[s] for s in some], trie, len(table) - 1)
        n = sizes[some]
        width = int(n[-1]) + 1
        alpha = np.zeros((len(some), width, table.shape[1]))
        alpha[:, 0] = 1
        scale = np.zeros(len(some))
        by_end = np.argsort(j, kind="stable")
        w, i, j, p = w[by_end], i[by_end], j[by_end], p[by_end]
        bounds = np.searchsorted(j, np.arange(width + 1))
        done = np.searchsorted(n, np.arange(width + 1))
        for t in range(1, width):
            a, b = bounds[t], bounds[t + 1]
            at = np.flatnonzero(np.concatenate(([True], w[a + 1 : b] != w[a : b - 1]))) if b > a else []
            if len(at):
                alpha[w[a:b][at], t] = np.add.reduceat(alpha[w[a:b], i[a:b]] * table[p[a:b]], at, axis=0)
            if t % 24 == 0:  # long words: keep the numbers in range
                near = alpha[:, max(0, t - trie.longest) : t + 1]
                top = near.max(axis=(1, 2))
                top = np.where(top > 0, top, 1)
                near /= top[:, None, None]
                scale += np.log(top)
            x = slice(done[t], done[t + 1])  # the words that end here
            out[some[x]] = np.log(np.maximum(alpha[x, t], 1e-300)) + scale[x, None]
    return out


def fit(counts: dict[str, dict[str, float]], pieces: list[str], rounds: int = 3) -> tuple[list[str], np.ndarray]:
    """Languages and the (pieces + 1, languages) table, by expectation-maximisation over word counts."""
    langs = sorted(counts)
    trie = Trie({p: i for i, p in enumerate(pieces)})
    unknown = len(pieces)
    table = np.empty((unknown + 1, len(langs)))
    for c, lang in enumerate(langs):
        words = list(counts[lang])
        weight = np.array([counts[lang][w] for w in words], float)
        sizes = np.array([len(w) for w in words], int)
        prob = np.full(unknown + 1, 1.0 / (unknown + 1))
        parts = [(lattice([words[s] for s in some], trie, unknown), weight[some], sizes[some]) for some in chunks(sizes)]
        for _ in range(rounds):
            got = np.full(unknown + 1, 0.01)
            for (w, i, j, p), wt, n in parts:
                width = int(n.max(initial=0)) + 1
                fwd, bwd = np.zeros((len(n), width)), np.zeros((len(n), width))
                fwd[:, 0] = 1
                bwd[np.arange(len(n)), n] = 1
                by = np.argsort(j, kind="stable")
                ends = np.searchsorted(j[by], np.arange(width + 1))
                for t in range(1, width):
                    e = by[ends[t] : ends[t + 1]]
                    np.add.at(fwd, (w[e], t), fwd[w[e], i[e]] * prob[p[e]])
                by = np.argsort(i, kind="stable")
                starts = np.searchsorted(i[by], np.arange(width + 1))
                for t in range(width - 1, -1, -1):
                    e = by[starts[t] : starts[t + 1]]
                    np.add.at(bwd, (w[e], t), bwd[w[e], j[e]] * prob[p[e]])
                total = np.maximum(fwd[np.arange(len(n)), n], 1e-300)
                share = fwd[w, i] * prob[p] * bwd[w, j] / total[w] * wt[w]
                got += np.bincount(p, share, unknown + 1)
            prob = got / got.sum()
        table[:, c] = prob
    return langs, table


def learn(
    docs: DataFrame, pieces: list[str], sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS
) -> tuple[list[str], np.ndarray]:
    """Fits on the sample_docs rows of least hash a language, of those that are not held out and have a language.

    Once a language has sample_chars characters, its further rows are left out; its first row never is.
    """
    rows = docs.where("lang is not null and not held_out and text is not null and doc_id is not null")
    draw = F.xxhash64("doc_id", F.lit(11))
    # A bound on the hash, by the language's number of rows, leaves few more rows to rank than are taken. The model
    # has a column a language on the driver, so their numbers of rows fit there too.
    sizes = [x for r in rows.groupBy("lang").count().collect() for x in (F.lit(r["lang"]), F.lit(3.0 * sample_docs / r["count"] + 1e-6))]
    if not sizes:
        return [], np.empty((len(pieces) + 1, 0))
    near = rows.select("doc_id", "lang", draw.alias("draw"))
    near = near.where((F.col("draw") / float(1 << 63) + 1) / 2 <= F.element_at(F.create_map(*sizes), F.col("lang")))
    order = Window.partitionBy("lang").orderBy("draw", "doc_id")
    chosen = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample_docs)
    # The ids are of bounded number, so that their texts need no shuffle.
    texts = rows.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id").select("lang", "text")
    counts: dict[str, dict[str, float]] = {}
    used: dict[str, int] = {}
    for lang, text in texts.orderBy(F.xxhash64("text")).toLocalIterator():
        if used.get(lang, 0) < sample_chars:
            used[lang] = used.get(lang, 0) + len(text)
            own = counts.setdefault(lang, {})
            for w in WORD.findall(text.lower()):
                for at in range(0, len(w), PART):
                    part = w[at : at + PART]
                    own[part] = own.get(part, 0) + 1
    return fit(counts, pieces)


def parts(texts: list) -> Iterator[list[tuple[int, list[str]]]]:
    """(row, words) of the texts, so many at once that their characters are about SLICE; longer texts come in parts."""
    some: list[tuple[int, list[str]]] = []
    size = 0
    for row, text in enumerate(texts):
        at = 0
        while isinstance(text, str) and at < len(text):
            cut_at = NO_LETTER.search(text, at + SLICE) if len(text) - at > SLICE else None
            end = cut_at.start() if cut_at else len(text)
            if words := WORD.findall(text[at:end].lower()):
                some.append((row, words))
            size += end - at
            at = end
            if size >= SLICE:
                yield some
                some, size = [], 0
    if some:
        yield some


def scorer(langs: list[str], table, pieces, least: float | None = None):
    """Adds predictions; with least, instead keeps the identified rows of at least this score, as they are."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, probs = langs, table.value
        trie = Trie({p: i for i, p in enumerate(pieces.value)})
        known: dict[str, int] = {}
        logs = np.empty((0, len(names)))
        letters_known = 0
        for pdf in it:
            total, letters = np.zeros((len(pdf), max(len(names), 1))), np.zeros(len(pdf))
            for some in parts(pdf["text"].tolist()):
                sizes = np.array([len(words) for _, words in some])
                at = np.array([row for row, _ in some])
                codes, words = pd.factorize(np.array([w for _, found in some for w in found], dtype=object))
                begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                length = np.array([len(w) for w in words])
                np.add.at(letters, at, np.add.reduceat(length[codes], begin))
                if len(known) > KNOWN_WORDS or letters_known > KNOWN_LETTERS:
                    known, logs, letters_known = {}, np.empty((0, len(names))), 0
                fresh = [w for w in words if w not in known]
                if fresh and len(names):
                    logs = np.concatenate([logs, forward(fresh, trie, probs)])
                    known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
                    letters_known += sum(map(len, fresh))
                if len(names):
                    each = logs[np.array([known[w] for w in words], int)[codes]]
                    np.add.at(total, at, np.add.reduceat(each, begin, axis=0))
            pred, score = np.full(len(pdf), "und", dtype=object), np.zeros(len(pdf))
            full = np.flatnonzero(letters > 0)
            best = total.max(axis=1)
            if len(full) and len(names):
                pred[full] = np.array(names, dtype=object)[total[full].argmax(axis=1)]
                score[full] = 1 / np.exp(np.minimum(total[full] - best[full, None], 0)).sum(axis=1)
            if least is not None:
                yield pdf[(pred != "und") & (score >= least) & (best >= -letters * np.log(ALPHABET))]
                continue
            out = pdf[["doc_id", "held_out"]].copy()
            out["lang_pred"], out["score"] = pred, score
            yield out.astype({"doc_id": "Int64"})

    return lean(run)


def _model(docs: DataFrame, vocabulary_path: str, id_col: str, text_col: str, lang_col: str, folds: int, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS):
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 1, F.lit(False)))
    pieces = vocabulary(vocabulary_path)
    langs, table = learn(rows, pieces, sample_docs, sample_chars)
    send = spark.sparkContext.broadcast
    return rows, langs, send(table), send(pieces)


def identify(
    docs: DataFrame,
    vocabulary_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 3,
    sample_docs: int = SAMPLE_DOCS,
    sample_chars: int = SAMPLE_CHARS,
) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    rows, langs, table, pieces = _model(docs, vocabulary_path, id_col, text_col, lang_col, folds, sample_docs, sample_chars)
    return rows.select("doc_id", "held_out", "text").mapInPandas(
        scorer(langs, table, pieces), "doc_id long, held_out boolean, lang_pred string, score double"
    )


def keep_identified(
    docs: DataFrame, vocabulary_path: str, least: float = 0.0, lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS
) -> DataFrame:
    """The rows of docs that are in a learned language, found with at least this score, with all their columns."""
    _, langs, table, pieces = _model(docs, vocabulary_path, "doc_id", "text", lang_col, 3, sample_docs, sample_chars)
    return docs.mapInPandas(scorer(langs, table, pieces, least), docs.schema)
