"""The 20-dimensional style profile, its reference distribution and distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import CJK, Profile, count_of, paragraphs, ratio, sentences, tokens

#: The order of the dimensions.
NAMES = (
    "sent_len_mean", "sent_len_std", "sent_len_p90", "comma_ratio", "period_ratio", "quote_density",
    "dialogue_verb_density", "simile_density", "fw_1", "fw_2", "fw_3", "fw_4", "fw_5", "fw_6", "fw_7",
    "ttr", "avg_word_len", "literary_hit", "cjk_numeral_ratio", "para_density",
)


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def array_mean(a: Column) -> Column:
    return ratio(array_sum(a), F.size(a))


def array_std(a: Column) -> Column:
    """Population standard deviation; the mean is bound once."""
    spread = F.transform(F.array(array_mean(a)), lambda m: F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)))
    return F.sqrt(ratio(spread[0], F.size(a)))


def array_quantile(a: Column, q: float) -> Column:
    """Linear interpolation between order statistics; 0 for an empty array."""
    s = F.array_sort(a)
    at = (F.size(a) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    x, y = F.get(s, low), F.get(s, F.least(low + 1, F.size(a) - 1))
    return F.when(F.size(a) > 0, x + (y - x) * (at - low)).otherwise(F.lit(0.0))


def style_features(
    docs: DataFrame,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    profile: Profile = CJK,
    lexicon: Column | None = None,
    words: Column | None = None,
) -> DataFrame:
    """The kept columns and the 20 features; empty texts are all zeros. Densities are per 100 characters of the whole text.

    lexicon: an array of literary words; words: an array of the text's tokens by a segmenter, instead of the profile's. What several features share is its own
    projection below, so it is computed once a row.
    """
    own = tokens(F.coalesce(F.col(text), F.lit("")), profile) if words is None else words
    raw = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"), own.alias("_words"))
    t = F.col("_t")
    rows = raw.select(
        *keep,
        "_t",
        F.length(t).alias("_n"),
        F.transform(sentences(t, profile), lambda s: F.length(s)).alias("_lens"),
        "_words",
        count_of(t, profile.punctuation).alias("_marks"),
        count_of(t, profile.native_digits).alias("_native"),
    )
    n, lens, words, marks, native = (F.col(c) for c in ("_n", "_lens", "_words", "_marks", "_native"))
    hit = F.size(F.filter(words, lambda w: F.array_contains(lexicon, w))) if lexicon is not None else F.lit(0)
    density = lambda x: ratio(100 * x, n)
    out = {
        "sent_len_mean": array_mean(lens),
        "sent_len_std": array_std(lens),
        "sent_len_p90": array_quantile(lens, 0.9).cast("double"),
        "comma_ratio": ratio(count_of(t, profile.commas), marks),
        "period_ratio": ratio(count_of(t, profile.periods), marks),
        "quote_density": density(count_of(t, profile.quotes)),
        "dialogue_verb_density": density(count_of(t, profile.speech)),
        "simile_density": density(F.regexp_count(t, F.lit("|".join(profile.similes)))),
        "ttr": ratio(F.size(F.array_distinct(words)), F.size(words)),
        "avg_word_len": array_mean(F.transform(words, lambda w: F.length(w))),
        "literary_hit": ratio(hit, F.size(words)),
        "cjk_numeral_ratio": ratio(native, native + count_of(t, profile.digits)),
        "para_density": density(F.size(paragraphs(t))),
    }
    for i, w in enumerate(profile.function_words, 1):
        out[f"fw_{i}"] = density((n - F.length(F.replace(t, F.lit(w), F.lit("")))) / len(w))
    return rows.select(*keep, *[out[c].alias(c) for c in NAMES])


def fit_reference(features: DataFrame, floor: float = 1e-6) -> DataFrame:
    """One row: mean_<name>, std_<name> (population, floored); empty input is an error."""
    row = features.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in NAMES],
        *[F.greatest(F.stddev_pop(c), F.lit(floor)).alias(f"std_{c}") for c in NAMES],
        F.count("*").alias("n_texts"),
    )
    checked = F.when(F.col("n_texts") > 0, F.col("n_texts")).otherwise(F.raise_error(F.lit("no texts to fit a reference on")))
    return row.withColumn("n_texts", checked.cast("long"))


def z_scores(features: DataFrame, reference: DataFrame) -> DataFrame:
    """features with an array z of 20; the reference is one row."""
    z = F.array(*[(F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}") for c in NAMES])
    kept = [c for c in features.columns if c not in NAMES]
    return features.join(F.broadcast(reference)).select(*kept, z.alias("z"))


def distance(z: Column) -> Column:
    """L2 norm over the square root of the dimension; a typical text has 1."""
    return F.sqrt(F.aggregate(z, F.lit(0.0), lambda s, x: s + x * x)) / F.sqrt(F.size(z).cast("double"))


def gap_per_case(delta: Column) -> Column:
    return array_mean(F.transform(delta, lambda x: F.abs(x)))


def set_gap(cases: DataFrame, delta: str = "delta", by: list[str] | None = None) -> DataFrame:
    """Mean over dimensions of the absolute mean over rows: opposite errors cancel."""
    by = by or []
    long = cases.select(*by, F.posexplode(delta).alias("dim", "x"))
    return long.groupBy(*by, "dim").agg(F.avg("x").alias("m")).groupBy(*by).agg(F.avg(F.abs("m")).alias("profile_gap"))
