"""Raw works to chunks: anthologies, sections and paragraphs, greedy packing of sentences, rebalanced short chunks.

A work is one row and its text is cut as a whole, so nothing is shuffled. All
lengths are counts of letters of a script; they add up over joined pieces, so
that packing and rebalancing decide on numbers alone and join texts once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text


@dataclass(frozen=True)
class Rules:
    """Signs of a script and the sizes of chunks, in letters."""

    letters: str = "[㐀-鿿]"
    sentence_enders: str = "。！？；"
    clause_enders: str = "，、："
    heading: str = "※※※|第[零〇一二三四五六七八九十百0-9]+[章节回部]"
    authors: tuple[str, ...] = ()
    target: int = 260
    least: int = 200
    most: int = 400


CHINESE = Rules()
LATIN_RULES = Rules(letters=r"[^\W\d_]", sentence_enders=".!?;", clause_enders=",:", heading=r"\*\*\*|Chapter [0-9IVX]+")


@dataclass(frozen=True)
class Atom:
    """A piece that is never cut; opens: it begins a paragraph."""

    text: str
    opens: bool
    size: int


def size_of(text: str, rules: Rules) -> int:
    return len(re.findall(rules.letters, text))


def after(text: str, enders: str) -> list[str]:
    """Stripped pieces, each with its ender."""
    return [p for p in (x.strip() for x in re.split(f"(?<=[{re.escape(enders)}])", text)) if p]


def runs(sizes: Sequence[int], starts_new: Callable[[int, int], bool]) -> list[slice]:
    """Greedy runs of consecutive sizes; starts_new is asked with the run's total and the next size."""
    out, begin, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > begin and starts_new(total, n):
            out.append(slice(begin, i))
            begin, total = i, 0
        total += n
    return [*out, slice(begin, len(sizes))] if sizes else []


def long_pieces(sentence: str, rules: Rules = CHINESE) -> list[str]:
    """A sentence in pieces of at most the greatest size: whole clauses if they fit, else cut after every so many letters."""
    sentence, most = sentence.strip(), rules.most
    places = [m.end() for m in re.finditer(rules.letters, sentence)]
    if len(places) <= most:
        return [sentence]
    clauses = after(sentence, rules.clause_enders)
    sizes = [size_of(c, rules) for c in clauses]
    if len(clauses) > 1 and max(sizes) <= most:
        return ["".join(clauses[r]) for r in runs(sizes, lambda total, n: total + n > most)]
    cuts = [0, *places[most - 1 :: most], len(sentence)]
    return [p for p in (sentence[a:b].strip() for a, b in zip(cuts, cuts[1:], strict=False)) if p]


def atoms(paragraph: str, rules: Rules = CHINESE) -> list[Atom]:
    pieces = [p for s in after(paragraph, rules.sentence_enders) for p in long_pieces(s, rules)]
    return [Atom(p, i == 0, size_of(p, rules)) for i, p in enumerate(pieces)]


def joined(some: Sequence[Atom]) -> str:
    return "".join(("\n" if i and a.opens else "") + a.text for i, a in enumerate(some)).strip()


def sections(text: str, rules: Rules = CHINESE) -> list[list[str]]:
    """Paragraphs by section. Headings end sections; blank lines and lines that are an author's name end paragraphs."""
    lines = [line.strip() for line in re.sub("\r\n?", "\n", text).split("\n")]
    heading = re.compile(f"(?:{rules.heading})")
    out = []
    for between, part in groupby(lines, key=lambda x: bool(heading.fullmatch(x))):
        if not between:
            blocks = groupby(part, key=lambda x: not x or x in rules.authors)
            if paragraphs := ["\n".join(block) for empty, block in blocks if not empty]:
                out.append(paragraphs)
    return out


def pack_section(paragraphs: Sequence[str], rules: Rules = CHINESE) -> list[str]:
    """Chunks near the target; a tail under the least size joins the chunk before it if both fit."""
    all_ = [a for p in paragraphs for a in atoms(p, rules)]
    sizes = [a.size for a in all_]
    parts = runs(sizes, lambda total, n: total + n > rules.most or (total >= rules.least and total + n > rules.target))
    if len(parts) > 1 and sum(sizes[parts[-1]]) < rules.least and sum(sizes[parts[-2].start :]) <= rules.most:
        parts[-2:] = [slice(parts[-2].start, len(sizes))]
    return [c for c in (joined(all_[p]) for p in parts) if c]


def shared_out(left: str, right: str, rules: Rules) -> tuple[str, str]:
    """Two chunks, the border moved to the sentence end that evens them best within the sizes, or to the middle; else as they were."""
    fits = lambda n: rules.least <= n <= rules.most
    all_ = [a for p in f"{left}\n{right}".split("\n") for a in atoms(p, rules)]
    upto = list(accumulate(a.size for a in all_))
    borders = [(abs(2 * n - upto[-1]), i) for i, n in enumerate(upto[:-1], 1) if fits(n) and fits(upto[-1] - n)] if upto else []
    if borders:
        at = min(borders)[1]
        return joined(all_[:at]), joined(all_[at:])
    both = f"{left}\n{right}"
    places = [m.end() for m in re.finditer(rules.letters, both)]
    half = len(places) // 2
    at = places[half - 1] if half else 0
    new = both[:at].strip(), both[at:].strip()
    return new if all(fits(size_of(x, rules)) for x in new) else (left, right)


def rebalance(chunks: Sequence[str], rules: Rules = CHINESE) -> list[str]:
    """Every short chunk but the first shares out its text with the one before it."""
    out: list[str] = []
    for chunk in chunks:
        if out and size_of(chunk, rules) < rules.least:
            out[-1:] = shared_out(out[-1], chunk, rules)
        else:
            out.append(chunk)
    return out


def chunk_text(text: str, rules: Rules = CHINESE) -> list[str]:
    return rebalance([c for s in sections(text, rules) for c in pack_section(s, rules)], rules)


def simple_chunks(text: str, rules: Rules = CHINESE, target: int = 250, most: int = 400, short: int = 100) -> list[str]:
    """Sentences appended up to the target in characters; a tail under short goes to the chunk before it if that fits."""
    parts = after(re.sub("\r\n?", "\n", text), rules.sentence_enders)
    sizes = [len(p) for p in parts]
    found = runs(sizes, lambda total, n: total >= target or total + n > most)
    if len(found) > 1 and sum(sizes[found[-1]]) < short and sum(sizes[found[-2].start :]) <= most:
        found[-2:] = [slice(found[-2].start, len(sizes))]
    return ["".join(parts[r]) for r in found]


def chunks(works: DataFrame, work: str = "work", text: str = "text", rules: Rules = CHINESE, simple: bool = False) -> DataFrame:
    """id (work_0001 ...), work, idx from 1, original: the chunks of each work. Null text has none."""
    make = simple_chunks if simple else chunk_text
    schema = "work string, idx int, original string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for w, t in zip(pdf["work"], pdf["text"], strict=True):  # a work at a time
                got = make(t or "", rules)
                yield pd.DataFrame({"work": [w] * len(got), "idx": range(1, len(got) + 1), "original": got}).astype({"work": object, "idx": "int32", "original": object})

    rows = works.select(F.col(work).cast("string").alias("work"), clean_text(F.col(text)).alias("text"))
    return rows.mapInPandas(run, schema).select(numbered_id(F.col("work"), F.col("idx")).alias("id"), "work", "idx", "original")


def numbered_id(work: Column, idx: Column) -> Column:
    return F.concat(work, F.lit("_"), F.when(idx < 10_000, F.lpad(idx.cast("string"), 4, "0")).otherwise(idx.cast("string")))


def split_anthology(texts: DataFrame, titles: Sequence[str], text: str = "text") -> DataFrame:
    """work, text of texts that hold works under title-only lines; a title that repeats or lacks is an error.

    What stands before the first title belongs to none.
    """
    any_ = "|".join(re.escape(t) for t in sorted(titles, key=len, reverse=True))
    line = rf"(?m)^[^\S\n]*({any_})[^\S\n]*$"
    t = clean_text(F.col(text))
    found = texts.select(F.regexp_extract_all(t, F.lit(line), F.lit(1)).alias("works"), F.split(t, line.replace(f"({any_})", f"(?:{any_})")).alias("parts"))
    rows = found.select(F.posexplode("works").alias("i", "work"), "parts").select("work", F.regexp_replace(F.get("parts", F.col("i") + 1), r"^\s+|\s+$", "").alias("text"))
    counts = {r["work"]: r["count"] for r in rows.groupBy("work").count().collect()}  # at most the titles
    if twice := sorted(w for w, n in counts.items() if n > 1):
        raise ValueError(f"titles that repeat: {twice}")
    if missing := sorted(set(titles) - set(counts)):
        raise ValueError(f"titles that lack: {missing}")
    return rows
