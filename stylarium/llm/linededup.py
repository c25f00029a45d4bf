"""Line dedup (operator 5), DataFrame functions only: a fixed-depth log-template tree.

A line's variable fields (white-space-free runs with a digit, an at sign or a
URL scheme) become a wildcard; what is left is its template. The tree's levels
are the number of tokens and the first LEAD tokens; a leaf holds the templates
that agree in these. Where at least SIMILAR of a template's positions after the LEAD
hold tokens that recur at their place in the leaf, the others are generalised; a
leaf has as many generalised templates as lines of it differ in what is left.

A template, plain or generalised, recurs if it stands in at least min_docs
documents that are not copies of each other: documents whose two-word shingles
are alike to ALIKE or more are linked, and a class of linked documents counts
once, whatever lines surround the template. Every line of a recurring template
is dropped.

Edge cases: null text has no lines and stays null; blank lines are never
dropped; a text all of whose lines go becomes empty. Rows with equal doc_id and
text get the same result each; rows that only share a doc_id count as one
document. A null doc_id counts as one document too. An empty table gives an
empty result. Other columns are kept by drop_lines, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, scratch

LEAD, SIMILAR, MIN_DOCS, SLOTS = 3, 0.6, 4, 1 << 18
SKETCH, BANDS, ALIKE = 64, 8, 0.5
VARIABLE = r"(?<!\S)(?:[^\s0-9@]*+[0-9@]|[a-z]++://)\S*+"


def templates(text: Column) -> Column:
    """The template of each line; the patterns run only over lines that have something for them."""

    def varied(x: Column) -> Column:
        return F.when(x.contains("://") | x.rlike("[0-9@]"), F.regexp_replace(x, VARIABLE, "<*>")).otherwise(x)

    def spaced(x: Column) -> Column:
        return F.regexp_replace(x, r"\s+", " ")

    # One step after another binds each result, which nested conditions would work out again.
    lines = F.transform(F.transform(F.split(F.lower(text), "\n"), lambda x: F.trim(x)), varied)
    odd = text.contains("  ")
    for c in "\t\x0b\f\r":
        odd = odd | text.contains(c)
    return F.when(odd, F.transform(lines, spaced)).otherwise(lines)


def leaf(template: Column) -> Column:
    tokens = F.octet_length(template) - F.octet_length(F.replace(template, F.lit(" "), F.lit(""))) + 1
    return F.xxhash64(tokens, F.substring_index(template, " ", LEAD))


def copies(docs: DataFrame) -> DataFrame:
    """node, comp: the documents (k) that have copies or near copies, and the class each belongs to.

    A document's sketch is the least SKETCH hashes of its two-word shingles. Documents that share a band of two
    minima are compared, each with the least document of the band; links are pairs whose sketches give a Jaccard
    of ALIKE or more. Null doc_ids (-1) are linked with nothing.
    """
    words = F.split(F.replace(F.lower("text"), F.lit("\n"), F.lit(" ")), " ")
    grams = F.transform(
        F.array(words),  # bound once for all positions
        lambda w: F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1))),
    )[0]
    least = F.slice(F.sort_array(F.array_distinct(grams)), 1, SKETCH)
    least = docs.where("k <> -1 and trim(text) <> ''").select("k", F.transform(least, lambda x: x.bitwiseAND(0x7FFFFFFF).cast("int")).alias("sketch"))
    least = cut(least, "sketches")

    def low(b: int) -> Column:
        return F.array_min(F.filter("sketch", lambda x: x.bitwiseAND(2 * BANDS - 1) == b))

    bands = F.array(*[F.struct(F.lit(b).alias("band"), low(2 * b).alias("x"), low(2 * b + 1).alias("y")) for b in range(BANDS)])
    keys = least.select("k", F.explode(bands).alias("b")).where("b.x is not null or b.y is not null")
    keys = keys.select("k", F.xxhash64("b").alias("key"))
    stars = keys.groupBy("key").agg(F.min("k").alias("a"), F.max("k").alias("z")).where("a < z").select("key", "a")
    pairs = cut(keys.join(stars, "key").where("a < k").select("a", F.col("k").alias("b")).distinct(), "pairs")
    one, two = least.toDF("a", "x"), least.toDF("b", "y")
    # Jaccard by the least SKETCH of both: rows of one doc_id may have several texts, any of which may link it.
    both = F.size(F.array_intersect("x", "y"))
    links = pairs.join(one, "a").join(two, "b").where(both >= ALIKE * (F.size("x") + F.size("y") - both))
    return components(links.select("a", "b"))


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """k, own, lines: for each document (id and text hash) the numbers of its lines to drop."""
    docs = docs.where("text is not null")
    lines = docs.select("k", "own", templates(F.col("text")).alias("t"))
    # The outer form: texts have a line at least, and no filter that splits them a second time is inferred.
    lines = lines.select("k", "own", F.posexplode_outer("t").alias("line", "t"))
    lines = lines.where("t <> ''").withColumn("template", F.xxhash64("t")).withColumn("leaf", leaf(F.col("t")))
    lines = cut(lines, "lines")
    # Leaves that may hold a recurring template. Only lines whose slot, of SLOTS at most whatever the input, has
    # such a leaf are shuffled.
    broad = lines.groupBy("leaf").agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    broad = cut(broad.where((F.col("n") >= min_docs) & (F.col("lo") < F.col("hi"))).select("leaf"), "leaves")
    slot = F.pmod("leaf", F.lit(SLOTS)).alias("slot")
    lines = (
        lines.withColumn("slot", slot)
        .join(F.broadcast(broad.select(slot).distinct()), "slot", "left_semi")
        .drop("slot")
        .join(broad, "leaf", "left_semi")
    )
    lines = cut(lines, "lines")
    # Copies are one document: a template's documents are counted by class.
    classes = copies(docs).toDF("k", "comp")
    found = cut(
        lines.select("leaf", "template", "k").distinct().join(classes, "k", "left")
        .select("leaf", "template", F.coalesce("comp", "k").alias("doc")).distinct(),
        "templates",
    )
    plain = found.groupBy("template").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select("template")
    drop = plain.union(general(lines, found, min_docs)).distinct()
    gone = lines.join(drop, "template", "left_semi").select("k", "own", "line").distinct()
    return gone.groupBy("k", "own").agg(F.collect_set("line").alias("lines"))  # no more than the document's lines


def general(lines: DataFrame, found: DataFrame, min_docs: int) -> DataFrame:
    """template: those of generalised templates that recur.

    A token is fixed if it stands at its place of the leaf in min_docs documents. A template generalises to its
    fixed tokens, so that a leaf holds as many generalised templates as it has families; others of the leaf
    neither join nor split them. So that the values of one more field may recur themselves, each form with one
    fixed token less is tried too.
    """
    wide = found.groupBy("leaf").agg(
        F.min("template").alias("lo"), F.max("template").alias("hi"), F.count_distinct("doc").alias("docs")
    )
    wide = wide.where((F.col("lo") < F.col("hi")) & (F.col("docs") >= min_docs)).select("leaf")
    words = F.split("t", " ")
    tokens = (
        lines.groupBy("leaf", "template")
        .agg(F.first("t").alias("t"))
        .join(wide, "leaf", "left_semi")
        .select("leaf", "template", (F.size(words) - LEAD).alias("n"), F.posexplode(words).alias("place", "token"))
        .where(F.col("place") >= LEAD)
    )
    tokens = cut(tokens.withColumn("token", F.xxhash64("token")), "tokens")
    fixed = (
        tokens.join(found, ["leaf", "template"])
        .select("leaf", "place", "token", "doc")
        .distinct()
        .groupBy("leaf", "place", "token")
        .agg(F.count("*").alias("docs"))
        .where(F.col("docs") >= min_docs)
        .select("leaf", "place", "token")
    )
    # A form is the exclusive or of its fixed tokens' hashes, so that a token is left out in one step.
    at = F.xxhash64("place", "token")
    forms = (
        tokens.join(fixed, ["leaf", "place", "token"])
        .groupBy("leaf", "template", "n")
        .agg(F.bit_xor(at).alias("form"), F.collect_list(at).alias("parts"))  # no more than the line's tokens
        .where(F.size("parts") >= SIMILAR * F.col("n"))
    )
    less = F.when(
        F.size("parts") - 1 >= SIMILAR * F.col("n"), F.transform("parts", lambda x: x.bitwiseXOR(F.col("form")))
    ).otherwise(F.array().cast("array<bigint>"))
    forms = cut(forms.select("leaf", "template", F.explode(F.concat(F.array("form"), less)).alias("form")), "forms")
    recur = (
        forms.join(found, ["leaf", "template"])
        .groupBy("leaf", "form")
        .agg(F.count_distinct("doc").alias("docs"))
        .where(F.col("docs") >= min_docs)
    )
    return forms.join(recur, ["leaf", "form"], "left_semi").select("template").distinct()


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    k = F.coalesce(F.col(id_col).cast("long"), F.lit(-1))
    return docs.select(k.alias("k"), F.xxhash64(text_col).alias("own"), F.col(text_col).alias("text"))


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", count: bool = False) -> DataFrame:
    """docs with the lines of recurring templates dropped from text; with count, also n_lines and n_dropped."""
    with scratch(docs.sparkSession):
        found = cut(recurring(keyed(docs, id_col, text_col), min_docs), "dropped", keep=True)
    packed = docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("k"),
        F.xxhash64(text_col).alias("own"),
    )
    both = packed.join(found, ["k", "own"], "left")
    lines = F.split(F.col("row")[text_col], "\n")
    # Line numbers become a map, so that long texts take time in proportion.
    marks = F.map_from_arrays("lines", F.transform("lines", lambda x: F.lit(True)))
    kept = F.filter(lines, lambda x, i: ~F.coalesce(F.element_at(F.col("marks"), i), F.lit(False)))
    text = F.when(F.col("lines").isNull(), F.col("row")[text_col]).otherwise(F.array_join(kept, "\n"))
    out = both.withColumn("marks", marks).select(
        *[(text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns],
        *(
            [
                F.when(F.col("row")[text_col].isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
                F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_dropped"),
            ]
            if count
            else []
        ),
    )
    return out
