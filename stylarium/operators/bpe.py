"""Token counts under a public byte-level pair vocabulary: words split, counted and summed by Spark, each different word merged once.

A word's tokens depend on the word alone, so texts become (text, word, times), the different words are
merged in the tasks, and the counts come back by a join. Special strings of the vocabulary count one each, and
words do not reach over them.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the words of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_signs() -> list[str]:
    """The sign that stands for each byte in such vocabularies: itself if it is visible, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def vocabulary(path: str) -> tuple[dict[tuple[str, str], int], list[str]]:
    """Ranks of pairs, and special strings, of a tokenizers file; one that is not byte-level is an error."""
    with open(path, encoding="utf-8") as f:
        setting = json.load(f)
    split = setting.get("pre_tokenizer") or {}
    if split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space") or setting.get("normalizer") or setting["model"]["type"] != "BPE":
        raise ValueError(f"{path} is not a plain byte-level pair vocabulary")
    pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in setting["model"]["merges"])
    return {p: i for i, p in enumerate(pairs)}, [t["content"] for t in setting.get("added_tokens", []) if t["content"]]


def merged(word: str, ranks: dict[tuple[str, str], int], signs: list[str]) -> int:
    """The number of tokens of a word: the pair of least rank, the leftmost of equals, is joined until none has a rank."""
    parts: list[str | None] = [signs[b] for b in word.encode()]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    left = len(parts)
    queue = [(r, i) for i in range(left - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
    heapq.heapify(queue)
    while queue:
        rank, i = heapq.heappop(queue)
        j = after[i]
        if parts[i] is None or j >= len(parts) or ranks.get((parts[i], parts[j])) != rank:
            continue  # one side has been joined since
        parts[i], parts[j], after[i] = parts[i] + parts[j], None, after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        left -= 1
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(parts) and (r := ranks.get((parts[a], parts[b]))) is not None:
                heapq.heappush(queue, (r, a))
    return left


def token_counts(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """key, tokens of every row; keys are unique, a null text has none. path must be readable on the executors."""
    _, special = vocabulary(path)
    t = F.coalesce(F.col(text), F.lit(""))
    marks = "|".join(re.escape(s) for s in sorted(special, key=lambda s: (-len(s), s)))
    segments = F.split(t, marks) if special else F.array(t)
    words = F.flatten(F.transform("_segments", lambda s: F.regexp_extract_all(s, F.lit(f"(?U)({PATTERN})"), F.lit(1))))
    rows = df.select(F.col(key).alias("_key"), segments.alias("_segments")).select("_key", (F.size("_segments") - 1).alias("specials"), words.alias("words"))
    each = rows.select("_key", F.explode("words").alias("word")).groupBy("_key", "word").agg(F.count("*").alias("times"))

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks, signs = vocabulary(path)[0], byte_signs()
        for pdf in it:
            yield pd.DataFrame({"own": pdf["word"], "n": [merged(w, ranks, signs) for w in pdf["word"]]})

    counts = each.select("word").distinct().mapInPandas(count, "own string, n long")
    sums = each.join(counts, F.col("word") == F.col("own")).groupBy("_key").agg(F.sum(F.col("times") * F.col("n")).alias("n"))
    sums = sums.withColumnRenamed("_key", "_own")
    out = rows.select("_key", "specials").join(sums, F.col("_key").eqNullSafe(F.col("_own")), "left")
    return out.select(F.col("_key").alias(key), (F.col("specials") + F.coalesce("n", F.lit(0))).cast("long").alias("tokens"))


def over_budget(df: DataFrame, key: str, text: str, path: str, most_new: int, most: int) -> DataFrame:
    """key, tokens of the prompts that, with the longest answer, exceed the window."""
    return token_counts(df, key, text, path).where(F.col("tokens") + most_new > most)


def budget_numbers(counts: DataFrame, tokens: Column | str = "tokens") -> DataFrame:
    """One row: n, least, mean, median and most of the tokens."""
    c = F.col(tokens) if isinstance(tokens, str) else tokens
    return counts.agg(F.count(c).alias("n"), F.min(c).alias("least"), F.avg(c).alias("mean"), F.percentile(c, 0.5).alias("median"), F.max(c).alias("most"))
