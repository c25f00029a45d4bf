"""Token counts, log-odds lexicons, gazetteers and term extraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CJK, Profile, tokens


def token_counts(df: DataFrame, text: str, profile: Profile = CJK, segment: Callable[[Column], Column] | None = None) -> DataFrame:
    """token, n of the profile's tokens, or of a segmenter's that have a letter of the profile."""
    found = tokens(F.col(text), profile) if segment is None else F.filter(segment(F.col(text)), lambda w: w.rlike(f"[{profile.letters}]"))
    return df.select(F.explode(found).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def training_rows(df: DataFrame, train: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose id is one of the training ids; a null id is none."""
    return df.join(train.select(key).distinct(), key, "left_semi")


def log_odds_lexicon(styled: DataFrame, plain: DataFrame, least: int = 3, cut: float = 1.0) -> DataFrame:
    """token, side, score = ln((styled + 1) / (plain + 1)): over the cut and counted often enough on its side."""
    both = styled.withColumnRenamed("n", "o").join(plain.withColumnRenamed("n", "v"), "token", "full")
    o, v = F.coalesce("o", F.lit(0)), F.coalesce("v", F.lit(0))
    scored = both.select("token", o.alias("o"), v.alias("v"), F.log((o + 1) / (v + 1)).alias("score"))
    side = F.when((F.col("score") > cut) & (F.col("o") >= least), "literary").when((F.col("score") < -cut) & (F.col("v") >= least), "colloquial")
    return scored.select("token", side.alias("side"), "score").where("side is not null")


def lexicon_payload(lexicon: DataFrame, most: int = 100_000) -> dict[str, dict[str, float]]:
    """Both sides as maps in word order, for a report; a lexicon that isn't small is an error."""
    rows = lexicon.orderBy("token").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a lexicon of more than {most} words: write it as a table")
    return {side: {r["token"]: r["score"] for r in rows if r["side"] == side} for side in ("literary", "colloquial")}


def gazetteer(df: DataFrame, key: str, text: str, least: int = 3, profile: Profile = CJK, titles: tuple[str, ...] = ()) -> DataFrame:
    """Words of two characters or more by the number of texts they are in."""
    words = df.select(key, F.explode(F.array_distinct(tokens(F.col(text), profile))).alias("word")).where(F.length("word") >= 2)
    if titles:
        words = words.where(~F.col("word").isin(list(titles)))
    return words.groupBy("word").agg(F.countDistinct(key).alias("texts")).where(F.col("texts") >= least)


def top_terms(df: DataFrame, category: str, text: str, k: int = 60, least: int = 2, profile: Profile = CJK) -> DataFrame:
    counts = df.select(category, F.explode(tokens(F.col(text), profile)).alias("term")).groupBy(category, "term").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    place = F.row_number().over(Window.partitionBy(category).orderBy(F.desc("n"), "term"))
    return counts.withColumn("place", place).where(F.col("place") <= k)
