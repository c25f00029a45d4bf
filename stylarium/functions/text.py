"""Text cleaning, splitting and counting as column expressions; character classes come from a profile."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Profile:
    """Character classes (regular-expression class bodies) and words of a script."""

    letters: str
    enders: str
    commas: str
    periods: str
    punctuation: str
    quotes: str
    speech: str
    similes: tuple[str, ...]
    function_words: tuple[str, ...]
    native_digits: str
    digits: str
    token: str


#: The classes, markers and function words of the feature definitions.
CJK = Profile(
    letters=r"\x{3400}-\x{9fff}",
    enders="。！？；\n",
    commas="，,",
    periods="。",
    punctuation="，。！？；：、…—～·「」『』“”‘’（）《》〈〉【】\\[\\](){}.,!?;:\"'`~",
    quotes="「」『』“”‘’\"'",
    speech="说道问答喊嚷",
    similes=("好像", "仿佛", "犹如", "好比", "像", "似", "般"),
    function_words=("的", "了", "着", "地", "而", "其", "之"),
    native_digits="零〇一二两三四五六七八九十百千万亿",
    digits="0-9０-９",
    token=r"[\x{3400}-\x{9fff}]|[A-Za-z0-9]+",
)
LATIN = Profile(
    letters=r"\p{L}",
    enders=r".!?;\n",
    commas=",",
    periods=r"\.",
    punctuation=r",.!?;:'\"()",
    quotes="\"'",
    speech="sqk",
    similes=("like", "as if", "than"),
    function_words=("the", "de", "und", "of", "la", "que", "in"),
    native_digits="IVX",
    digits="0-9",
    token=r"\p{L}+",
)


#: Traditional characters and their simplified forms.
OLD_CHARACTERS, NEW_CHARACTERS = "麽麼裏裡牠", "么么里里它"


def clean_text(t: Column, old: str = OLD_CHARACTERS, new: str = NEW_CHARACTERS) -> Column:
    """Unix line ends; single characters of old become those of new."""
    t = F.regexp_replace(t, "\r\n?", "\n")
    return F.translate(t, old, new) if old else t


def only(t: Column, chars: str) -> Column:
    return F.regexp_replace(t, f"[^{chars}]+", "")


def count_of(t: Column, chars: str) -> Column:
    return F.length(only(t, chars))


def letters_length(t: Column, profile: Profile = CJK) -> Column:
    return count_of(t, profile.letters)


def stripped(t: Column) -> Column:
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def sentences(t: Column, profile: Profile = CJK) -> Column:
    """Runs between sentence enders, stripped, of two characters or more."""
    return F.filter(F.transform(F.split(t, f"[{profile.enders}]+"), stripped), lambda s: F.length(s) >= 2)


def attached_sentences(t: Column, profile: Profile = CJK) -> Column:
    """Sentences that keep their ender."""
    return F.filter(F.split(t, f"(?<=[{profile.enders}])"), lambda s: s != "")


def paragraphs(t: Column) -> Column:
    return F.filter(F.split(t, "\n"), lambda s: stripped(s) != "")


def strip_fences(t: Column) -> Column:
    """Without a first and last line of three back ticks."""
    inner = F.regexp_extract(t, r"(?s)^\s*```[^\n]*\n(.*?)\n?```\s*$", 1)
    return F.when(stripped(t).rlike(r"(?s)^```.*```$"), inner).otherwise(t)


def fold_width(t: Column) -> Column:
    return F.translate(t, "０１２３４５６７８９", "0123456789")


def tokens(t: Column, profile: Profile = CJK, lower: bool = True) -> Column:
    return F.regexp_extract_all(F.lower(t) if lower else t, F.lit(f"({profile.token})"), F.lit(1))


def grams(t: Column, n: int) -> Column:
    """All n-character windows, in order; none for a shorter text."""
    if n < 1:
        raise ValueError("n must be at least 1")
    return F.regexp_extract_all(t, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1))  # one pass: each match is empty and looks ahead


def windows(t: Column, n: int = 12, profile: Profile = CJK) -> Column:
    """Distinct n-character windows of the letters alone."""
    return F.array_distinct(grams(only(t, profile.letters), n))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a.cast("double") / b).otherwise(F.lit(0.0))


def slices(t: Column, n: int = 24) -> Column:
    """Pieces of n characters, the last may be shorter; none for an empty text."""
    starts = F.sequence(F.lit(0), F.floor((F.greatest(F.length(t), F.lit(1)) - 1) / n).cast("int"))
    return F.when(F.length(t) > 0, F.transform(starts, lambda i: F.substring(t, i * n + 1, F.lit(n)))).otherwise(
        F.array().cast("array<string>")
    )


def sha(t: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.sha2(t, 256))


def short_hash(t: Column) -> Column:
    return F.substring(F.sha2(t, 256), 1, 12)
