"""Toxicity (operator 9): maximum-scoring segments of token log-odds, with extreme-value calibration.

The units of a word are the word and its five-letter parts. Each unit gets the
log-odds of toxic against other labelled rows under an informative Dirichlet
prior (the units' counts in both), kept where the rows that hold it are toxic more
often than chance explains, given how many units are tried. A word scores the most
of its units, so that spellings and compounds never seen score too; all other words
score a negative drift, what their absence tells, so that the expected score is
negative. A linear scan finds all disjoint maximal-scoring segments of a text; those that an
extreme-value law of the untoxic rows' segment scores makes significant are its
toxic passages. The law is fitted to the middle of the tail, which a few rows of
any score cannot move. A text's evidence is minus the log of that law's probability of such segments by
chance in a text of its length, mapped to 0..1 by a monotone fit on labelled rows that
the units were not learned from. Rows whose least three-word hash is equal (copies, mostly) teach once.

Edge cases: null, empty and wordless texts have no segment and get the score of
none. Rows that repeat, or of null doc_id, are scored like any other; null
labels teach nothing. Without labels of both kinds every score is 0. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, lean, mix64

FOLDS = 5
SAMPLE_ROWS = 4000  # labelled rows of each class that the model is fitted on, chosen by hash
SAMPLE_CHARS = 12_000_000  # and characters of each class, beyond its first row
PRIOR, FLOOR, LEAST_ROWS, TOP = 40.0, 0.5, 3, 6.0
GRAM, MOST_TIMES = 5, 5  # letters of a part; occurrences of a unit that count in a row
CHANCE = 20.0  # units that may be as clear by chance
LEAST_DRIFT, KNOWN_WORDS = 0.005, 400_000  # words whose score a task remembers
WORD = re.compile(r"[^\W\d_]+")


def units(word: str) -> set[str]:
    return {"^" + word} | {word[i : i + GRAM] for i in range(len(word) - GRAM + 1)}


def log_odds(times: np.ndarray, rows: np.ndarray, n_words: np.ndarray, n_rows: np.ndarray) -> np.ndarray:
    """A unit's score, 0 for those that chance explains. times, rows: its counts in untoxic and toxic rows (2 x units).

    The prior is the units' distribution in all rows, with FLOOR for any unit.
    """
    every, share = rows.sum(axis=0), n_rows[1] / n_rows.sum()
    part = np.divide(rows[1], every, out=np.zeros(len(every)), where=every > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        told = np.nan_to_num(part * np.log(part / share)) + np.nan_to_num((1 - part) * np.log((1 - part) / (1 - share)))
    clear = (part > share) & (rows[1] >= LEAST_ROWS) & (every * told > math.log(max((every > 0).sum(), 1) / CHANCE))
    pseudo = PRIOR * times.sum(axis=0) / n_words.sum() + FLOOR
    odds = np.log((times[1] + pseudo) / (n_words[1] + PRIOR)) - np.log((times[0] + pseudo) / (n_words[0] + PRIOR))
    return np.where(clear & (odds > 0), np.minimum(odds, TOP), 0.0)


def segments(places: list[int], scores: list[float], drift: float) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first word, last word) in one pass over the words of positive score.

    places: their word positions; every other word scores -drift.
    """
    stack: list[tuple[int, int, float, float]] = []  # first, last, sum before it, sum with it
    total, at = 0.0, 0
    for place, score in zip(places, scores, strict=True):
        total -= drift * (place - at)
        at = place + 1
        first, last, low, high = place, place, total, total + score
        total = high
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j -= 1
            if j < 0 or stack[j][3] >= high:
                stack.append((first, last, low, high))
                break
            first, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(high - low, first, last) for first, last, low, high in stack]


def found(text: str | None, odds: dict[str, float], known: dict[str, float], drift: float) -> tuple[int, list[tuple[float, int, int]]]:
    """Number of words and segments of a text. known: scores of words met before."""
    words, places, scores = WORD.findall(text.lower()) if text else [], [], []
    for i, w in enumerate(words):
        score = known.get(w)
        if score is None:
            if len(known) >= KNOWN_WORDS:
                known.clear()
            score = known[w] = max((odds.get(u, 0.0) for u in units(w)), default=0.0)
        if score:
            places.append(i)
            scores.append(score)
    return len(words), segments(places, scores, drift)


def extreme_law(best: np.ndarray, sizes: np.ndarray) -> tuple[float, float]:
    """lambda and log K of the law of the greatest segment score in so many words, from untoxic rows.

    The tail beyond the 90 % point is exponential; its median, and the share of rows beyond the point, fix both.
    """
    some = sizes > 0
    if not some.any():
        return 1.0, -2.0
    best, sizes = best[some], sizes[some]
    at = float(np.quantile(best, 0.9))
    excess = best[best > at] - at
    lam = min(max(math.log(2) / max(float(np.median(excess)), 1e-9), 0.3), 3.0) if len(excess) >= 5 else 1.0
    beyond = max(len(excess), 0.5) / len(best)
    return lam, math.log(-math.log1p(-min(beyond, 0.5))) + lam * at - float(np.log(sizes).mean())


def evidence(segs: list[tuple[float, int, int]], size: int, lam: float, log_k: float) -> float:
    """Minus the log of the chance of the significant segments under the law: of the best one, and less for each further one."""
    out = 0.0
    for rank, (score, _, _) in enumerate(sorted(segs, reverse=True)):
        e = log_k + math.log(max(size, 1)) - lam * score  # log of the expected number of segments as good
        p = -e if e < -30 else -math.log(max(-math.expm1(-math.exp(min(e, 30))), 1e-300))
        if rank and p < 3:
            break
        out += p / (1 + rank)
    return out


def monotone(x: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float]]:
    """Knots (evidence, probability) of the best nondecreasing fit: neighbours out of order are pooled.

    Each pool is drawn half a row towards the share of all rows.
    """
    share = float(y.mean())
    values, inverse, sizes = np.unique(x, return_inverse=True, return_counts=True)
    pools: list[tuple] = []  # least and greatest evidence, sum of labels, rows
    for v, hits, n in zip(values.tolist(), np.bincount(inverse, y), sizes, strict=True):
        pools.append((v, v, hits, n))
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            (low, _, a, m), (_, high, b, n) = pools[-2:]
            pools[-2:] = [(low, high, a + b, m + n)]
    p = np.maximum.accumulate([(h + share / 2) / (n + 0.5) for _, _, h, n in pools]).tolist()
    knots = [(at, q) for (low, high, _, _), q in zip(pools, p, strict=True) for at in ([low, high] if low < high else [low])]
    knots.append((knots[-1][0] + 1, (p[-1] + 1) / 2))
    return [at for at, _ in knots], [float(q) for _, q in knots]


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> dict | None:
    """Word scores, extreme-value law and logistic map, from a bounded hash-chosen sample of labelled rows not held out.

    The sample has at most sample_rows rows of each class; once a class has sample_chars characters, its further
    rows are left out.
    """
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where((F.crc32(F.col("doc_id").cast("string")) % 3) != 1)
    parts = [marks.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(sample_rows) for t in (1, 0)]
    chosen = parts[0].union(parts[1])
    sample = docs.where("text is not null").join(F.broadcast(chosen), "doc_id")  # bounded by sample_rows
    vocabulary: dict[str, int] = {}
    hashes: list[int] = []
    rows, used, seen = [], [0, 0], set()
    for text, toxic in sample.orderBy(F.xxhash64("doc_id", "text")).select("text", "toxic").toLocalIterator():
        if used[toxic] >= sample_chars:
            continue
        used[toxic] += len(text)
        words = WORD.findall(text.lower())
        for w in words:
            if w not in vocabulary:
                vocabulary[w] = len(vocabulary)
                hashes.append(zlib.crc32(w.encode()))
        at = np.array([vocabulary[w] for w in words], np.int32)
        marks_ = np.array([hashes[i] for i in at], np.uint64)
        threes = mix64(marks_[:-2] * np.uint64(0x9E3779B97F4A7C15) + marks_[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + marks_[2:]) if len(at) > 2 else marks_
        key = int(threes.min()) if len(threes) else -1
        if (key, toxic) not in seen:
            seen.add((key, toxic))
            rows.append((at, toxic, key % FOLDS))
    if len({t for _, t, _ in rows}) < 2:
        return None

    # Counts of units by fold, class and unit: occurrences, MOST_TIMES a row at most, and rows.
    parts_of: dict[str, int] = {}
    own = [np.array([parts_of.setdefault(u, len(parts_of)) for u in sorted(units(w))], np.int32) for w in vocabulary]
    first = np.cumsum([0, *map(len, own)])[:-1]
    flat = np.concatenate(own) if own else np.zeros(0, np.int32)
    times, held = np.zeros((2, FOLDS, 2, len(parts_of)), np.int32)
    n_words, n_rows = np.zeros((2, FOLDS, 2))
    for at, toxic, fold in rows:
        different, n = np.unique(at, return_counts=True)
        n_words[fold, toxic] += len(at)
        n_rows[fold, toxic] += 1
        if len(at):
            ids = np.concatenate([own[i] for i in different])
            ids, inverse = np.unique(ids, return_inverse=True)
            n = np.bincount(inverse, np.repeat(n, [len(own[i]) for i in different]))
            times[fold, toxic, ids] += np.minimum(n, MOST_TIMES).astype(np.int32)
            held[fold, toxic, ids] += 1

    def model(out: int | None) -> np.ndarray:
        """Scores of units, learned from all folds but one."""
        use = [f for f in range(FOLDS) if f != out]
        if not n_rows[use].sum(axis=0).all():
            return np.zeros(len(parts_of))
        return log_odds(times[use].sum(axis=0), held[use].sum(axis=0), n_words[use].sum(axis=0), n_rows[use].sum(axis=0))

    # Rows that the scores were not learned from tell the drift, the law and the map.
    places = []
    scores = [np.maximum.reduceat(np.append(m[flat], 0.0), first) if len(own) else np.zeros(0) for m in (model(f) for f in range(FOLDS))]
    for at, _, fold in rows:
        score = scores[fold][at]
        hits = np.flatnonzero(score)
        places.append((len(at), hits.tolist(), score[hits].tolist()))
    y = np.array([t for _, t, _ in rows], float)
    sizes = np.array([n for n, _, _ in places], float)
    rate = [sum(len(p) for (_, p, _), t in zip(places, y, strict=True) if t == c) / max(sizes[y == c].sum(), 1) for c in (0, 1)]
    mean = sum(sum(x) for (_, _, x), t in zip(places, y, strict=True) if not t) / max(sizes[y == 0].sum(), 1)
    drift = max(rate[1] - rate[0], 2 * mean, LEAST_DRIFT)
    segs = [(n, segments(p, x, drift)) for n, p, x in places]
    best = np.array([max((s[0] for s in found_), default=0.0) for _, found_ in segs])
    lam, log_k = extreme_law(best[y == 0], sizes[y == 0])
    x = np.array([evidence(found_, n, lam, log_k) for n, found_ in segs])
    all_odds = model(None)
    odds = {u: float(all_odds[i]) for u, i in parts_of.items() if all_odds[i] > 0}
    return {"odds": odds, "drift": drift, "lam": lam, "log_k": log_k, "map": monotone(x, y)}


def scorer(model):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, known = model.value, {}
        for pdf in it:
            rows = []
            for doc, held, text in zip(pdf["doc_id"], pdf["held_out"], pdf["text"], strict=True):
                if m is None:
                    rows.append((doc, held, 0.0, 0, []))
                    continue
                n, segs = found(text, m["odds"], known, m["drift"])
                score = float(np.interp(evidence(segs, n, m["lam"], m["log_k"]), *m["map"]))
                keep = [(a, b + 1, s) for s, a, b in segs if m["log_k"] + math.log(n) - m["lam"] * s < -1]
                rows.append((doc, held, score, int(score >= 0.7), keep))
            out = pd.DataFrame(rows, columns=["doc_id", "held_out", "score", "predicted", "passages"])
            yield out.astype({"doc_id": "Int64"})

    return lean(run)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, passages (first word, word after the last, segment score)."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = spark.sparkContext.broadcast(learn(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInPandas(
        scorer(model),
        "doc_id long, held_out boolean, score double, predicted int, passages array<struct<first:long,end:long,score:double>>",
    )
