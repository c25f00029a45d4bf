"""What a caller can put in: embedders, taggers, routes, models, token counters and clocks, with plain defaults.

A text function is an expression over a column, so that a default stays in the engine; a model outside it is a function
that a task makes for itself (see sources.vectors.complete).
"""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.numerals import bind
from .functions.text import CJK, Profile, tokens


class Embedder(Protocol):
    """A vector column of a text column, all of one dimension."""

    def __call__(self, text: Column) -> Column: ...


class Tagger(Protocol):
    """The names of a text."""

    def __call__(self, text: Column) -> Column: ...


class Route(Protocol):
    """query_id, id, score of queries against an index."""

    def __call__(self, docs: DataFrame, queries: DataFrame) -> DataFrame: ...


class Step(Protocol):
    """A step of the loop: rows in, rows with its columns out (retriever, generator, verifier, scorer)."""

    def __call__(self, rows: DataFrame) -> DataFrame: ...


class Completer(Protocol):
    """Made once a task: answers to a list of prompts, in their order (chat model, judge, embedding server)."""

    def __call__(self) -> Callable[[list], list]: ...


class TokenCounter(Protocol):
    """The number of tokens of a text or prompt."""

    def __call__(self, text: Column) -> Column: ...


Clock = Callable[[], str]


def hash_embedder(dim: int = 64, profile: Profile = CJK) -> Embedder:
    """Token counts in dim hashed slots with hashed signs, of length 1; all zeros without tokens."""

    def embed(text: Column) -> Column:
        marks = F.transform(tokens(F.coalesce(text, F.lit("")), profile), lambda w: F.xxhash64(w))

        def counted(hashes: Column) -> Column:
            sign = lambda h: F.when(F.shiftrightunsigned(h, 63) == 1, -1.0).otherwise(1.0)
            slot = lambda i: F.aggregate(F.filter(hashes, lambda h: F.pmod(h, F.lit(dim)) == i), F.lit(0.0), lambda s, h: s + sign(h))
            return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), slot)

        def unit(v: Column) -> Column:
            n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
            return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0))

        return bind(bind(marks, counted), unit)

    return embed


def character_counter(text: Column) -> Column:
    """A character stands for a token."""
    return F.length(F.coalesce(text, F.lit("")))


def message_characters(messages: Column) -> Column:
    return F.aggregate(messages, F.lit(0), lambda s, m: s + F.length(m["content"]))


def utc_clock() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def monotonic_clock() -> float:
    return time.monotonic()
