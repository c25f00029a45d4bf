"""JSON Lines and text scans with declared schemas, row guards, small dimensions, and the sinks beside them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import style
from ..functions.text import CJK, Profile, clean_text, letters_length, stripped



def record(texts: str, numbers: str = "", flags: str = "") -> T.StructType:
    """A schema of string, int and boolean fields."""
    kinds = ((texts, T.StringType()), (numbers, T.IntegerType()), (flags, T.BooleanType()))
    return T.StructType([T.StructField(n, kind) for names, kind in kinds for n in names.split()])


PAIR = record("id work vernacular original split", "idx")
CHUNK = record("id work original", "idx")
CASE = record("id vernacular original split")
GENERATION = record("id output model pipeline", "seed")
HUMAN_CASE = record("id domain vernacular", "seed")
SALVAGED = record("id work original vernacular", flags="maybe_truncated")
EXEMPLAR = "struct<id:string,rank:int,score:double,sources:map<string,int>>"
PLAN = f"plans map<string,array<struct<id:string,work:string,exemplars:array<{EXEMPLAR}>>>>"
BAD = "_bad"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (byte offset of the split), place (order inside it), value, of text files of any size."""
    raw = spark.read.text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value"
    )


def numbered(rows: DataFrame) -> DataFrame:
    """file, line (from 1), value of rows of lines(), from one count a split."""
    sizes = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("file", "block", "first", before.alias("before"))
    return rows.join(F.broadcast(sizes), ["file", "block"]).select(  # a row a file split
        "file", (F.col("place") - F.col("first") + F.col("before") + 1).alias("line"), "value"
    )


def parsed(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of lines() that aren't blank, with the parsed record r; r._bad holds what is no record of the schema."""
    wide = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    return rows.where(stripped(F.col("value")) != "").withColumn("r", F.from_json("value", wide, options))


def bad_lines(spark: SparkSession, path: str, schema: T.StructType, required: Iterable[str] = ()) -> DataFrame:
    """file, line, reason of every row that is no record, or lacks a required field."""
    rows = parsed(lines(spark, path), schema)
    absent = F.filter(F.array(*[F.when(F.col(f"r.{c}").isNull(), F.lit(c)) for c in required]).cast("array<string>"), lambda c: c.isNotNull())
    reason = F.when(F.col(f"r.{BAD}").isNotNull(), "no record of the schema").when(F.size(absent) > 0, F.concat(F.lit("lacks "), F.array_join(absent, ", ")))
    told = rows.withColumn("reason", reason).where("reason is not null").select("file", "block", "place", "reason")
    # Line numbers need the blank lines too, so they are counted before anything is dropped.
    places = numbered(lines(spark, path).withColumn("value", F.struct("block", "place").cast("string")))
    return told.withColumn("value", F.struct("block", "place").cast("string")).join(places, ["file", "value"]).select("file", "line", "reason")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, required: Iterable[str] = ("id",), split: str | None = None) -> DataFrame:
    """Typed records, blank lines skipped and unknown fields ignored; a row that fails is an error that names file and line.

    split keeps the rows of that value and must leave some.
    """
    required = list(required)
    rows = parsed(lines(spark, path), schema)
    broken = F.col(f"r.{BAD}").isNotNull()
    for c in required:
        broken = broken | F.col(f"r.{c}").isNull()
    if not rows.where(broken).isEmpty():
        some = bad_lines(spark, path, schema, required).orderBy("file", "line").limit(5).collect()
        raise ValueError("; ".join(f"{r['file']}:{r['line']}: {r['reason']}" for r in some))
    out = rows.select("r.*").drop(BAD)
    return out if split is None else only_split(out, split)


def only_split(df: DataFrame, split: str) -> DataFrame:
    kept = df.where(F.col("split") == split)
    if kept.isEmpty():
        raise ValueError(f"no rows of split {split!r}")
    return kept


def read_generations(spark: SparkSession, path: str) -> DataFrame:
    """One row an id: the last of the file (files in name order); model, pipeline and seed have defaults."""
    rows = parsed(lines(spark, path), GENERATION).where(f"r.{BAD} is null and r.id is not null")
    last = rows.groupBy("r.id").agg(F.max_by("r", F.struct("file", "block", "place")).alias("r"))
    given = F.col("r").withField("model", F.coalesce("r.model", F.lit("unknown"))).withField("pipeline", F.coalesce("r.pipeline", F.lit("baseline")))
    return last.select(given.withField("seed", F.coalesce("r.seed", F.lit(42))).alias("r")).select("r.*").drop(BAD)


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """config, id, work, exemplar id, rank, score, sources: a row an exemplar of a plan report."""
    plan = spark.read.schema(PLAN).option("multiLine", True).json(path)
    queries = plan.select(F.explode("plans").alias("config", "q")).select("config", F.explode("q").alias("q"))
    return queries.select("config", F.col("q.id").alias("id"), F.col("q.work").alias("work"), F.explode("q.exemplars").alias("x")).select(
        "config", "id", "work", F.col("x.id").alias("exemplar_id"), "x.rank", "x.score", "x.sources"
    )


def read_works(spark: SparkSession, path: str) -> DataFrame:
    """work (the file's stem), text: whole cleaned texts without a first line that is the title."""
    raw = spark.read.text(path, wholetext=True)
    work = F.regexp_replace(F.element_at(F.split(F.url_decode(F.col("_metadata.file_path")), "/"), -1), r"\.[^.]*$", "")
    rows = raw.select(work.alias("work"), clean_text(F.col("value")).alias("text"))
    first = stripped(F.substring_index("text", "\n", 1))
    rest = F.when(F.contains("text", F.lit("\n")), F.substring(F.col("text"), F.locate("\n", F.col("text")) + 1, F.length("text"))).otherwise(F.lit(""))
    return rows.select("work", F.regexp_replace(F.when(first == F.col("work"), rest).otherwise(F.col("text")), r"^\s+|\s+$", "").alias("text"))


def read_guarded(spark: SparkSession, path: str, most: int = 5 << 20) -> DataFrame:
    """location, text, skipped: why a file is not read (too large, binary, not UTF-8), null where it is."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    skipped = F.when(F.col("length") > most, "too large").when(F.contains("content", F.lit(b"\x00")), "binary").when(~valid, "not UTF-8")
    return raw.select(F.col("path").alias("location"), F.when(skipped.isNull(), F.col("content").cast("string")).alias("text"), skipped.alias("skipped"))


def read_salvaged(spark: SparkSession, path: str, without: Iterable[str] = (), profile: Profile = CJK) -> DataFrame:
    """Reference rows that aren't marked as possibly cut off, without some ids; n_letters orders them by length."""
    rows = read_jsonl(spark, path, SALVAGED)
    kept = rows.where(~F.coalesce("maybe_truncated", F.lit(False)) & ~F.col("id").isin(list(without)))
    return kept.withColumn("n_letters", letters_length(F.coalesce("original", F.lit("")), profile))


def same_outputs(report: DataFrame, generations: DataFrame) -> DataFrame:
    """Ids for which the report (id, output_hash) does not describe the generations (id, output), or that one side lacks."""
    own = generations.select("id", F.concat(F.lit("sha256:"), F.sha2("output", 256)).alias("own"))
    both = report.select("id", "output_hash").join(own, "id", "full")
    return both.where(~F.col("own").eqNullSafe(F.col("output_hash"))).select("id", "output_hash", "own")


def read_words(path: str) -> list[str]:
    """A word list: one a line, # starts a comment; an empty list is an error. A small dimension, read on the driver."""
    words = [line.strip() for line in Path(path).read_text(encoding="utf-8").splitlines()]
    words = [w for w in words if w and not w.startswith("#")]
    if not words:
        raise ValueError(f"{path}: no words")
    return words


def read_config(path: str, make: Callable | None = None):
    """A mapping from JSON, or from YAML where a reader is installed; make checks and builds it."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        value = yaml.safe_load(text)
    else:
        value = json.loads(text)
    if not isinstance(value, dict):
        raise ValueError(f"{path}: not a mapping")
    return make(**value) if make else value


def read_dimension(path: str, field: str) -> list:
    """One array of a small JSON document, such as the words of a gazetteer or the ids of a split."""
    value = read_config(path).get(field)
    if not isinstance(value, list):
        raise ValueError(f"{path}: no array {field!r}")
    return value


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """id, split of a split document {train: [...], eval: [...]}; an id in both is an error."""
    doc = spark.read.schema("train array<string>, eval array<string>").option("multiLine", True).json(path)
    rows = doc.select(F.explode(F.col("train")).alias("id"), F.lit("train").alias("split")).union(doc.select(F.explode(F.col("eval")), F.lit("eval")))
    twice = rows.groupBy("id").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"ids twice in the split: {[r['id'] for r in twice]}")
    return rows


def split_mismatches(rows: DataFrame, split: DataFrame) -> DataFrame:
    """id, declared, listed where rows (id, split) and the split document disagree, either way round."""
    both = rows.select("id", F.col("split").alias("declared")).join(split.select("id", F.col("split").alias("listed")), "id", "full")
    return both.where(~F.col("declared").eqNullSafe(F.col("listed")))


def git_texts(spark: SparkSession, repository: str, history: bool = False, most: int = 5 << 20) -> DataFrame:
    """location, text of the tracked files of a local repository, or of every distinct blob of its history.

    Blobs stream through the driver, which holds the repository; text that is large, binary or not UTF-8 is left out.
    """
    import subprocess

    def git(*args: str) -> bytes:
        return subprocess.run(["git", "-C", repository, *args], check=True, capture_output=True).stdout

    def texts() -> Iterable[tuple[str, str]]:
        if history:
            named = dict(x.split(" ", 1) for x in git("rev-list", "--objects", "--all").decode().splitlines() if " " in x)
            found = ((sha, f"{name}@{sha[:12]}") for sha, name in named.items() if git("cat-file", "-t", sha).strip() == b"blob")
            contents = ((name, git("cat-file", "blob", sha)) for sha, name in found)
        else:
            paths = [p for p in git("ls-files", "-z").decode().split("\0") if p]
            contents = ((p, (Path(repository) / p).read_bytes()) for p in paths if (Path(repository) / p).is_file())
        for name, raw in contents:
            if len(raw) <= most and b"\0" not in raw:
                try:
                    yield name, raw.decode("utf-8")
                except UnicodeDecodeError:
                    continue

    return spark.createDataFrame(list(texts()), "location string, text string")


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """The style reference of a JSON document (feature_names, n_texts, mean, std) as the one row that z scores are made with."""
    doc = read_config(path)
    if tuple(doc.get("feature_names", ())) != style.NAMES or not len(doc["mean"]) == len(doc["std"]) == len(style.NAMES):
        raise ValueError(f"{path}: not a reference of the {len(style.NAMES)} features")
    row = {f"mean_{n}": float(m) for n, m in zip(style.NAMES, doc["mean"], strict=True)} | {f"std_{n}": float(x) for n, x in zip(style.NAMES, doc["std"], strict=True)}
    columns = [*row, "n_texts"]
    return spark.createDataFrame([(*row.values(), int(doc["n_texts"]))], ", ".join(f"{c} double" for c in row) + ", n_texts long").select(*columns)


def read_lexicon(path: str) -> dict[str, dict[str, float]]:
    """Both sides of a lexicon document."""
    doc = read_config(path)
    return {side: {str(w): float(x) for w, x in doc[side].items()} for side in ("literary", "colloquial")}


def read_names(path: str) -> list[tuple[str, str]]:
    """(name, kind) of a document of checked names; a name without a kind of person or place, or twice, is an error."""
    rows = [(str(e["name"]), str(e["kind"])) for e in read_dimension(path, "entities")]
    if bad := [n for n, k in rows if k not in ("person", "place")] or len({n for n, _ in rows}) < len(rows):
        raise ValueError(f"{path}: names without a kind, or twice: {bad}")
    return rows


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path, ignoreNullFields=False)


def overwrite_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def as_json(row: Column) -> Column:
    """Compact JSON; nulls stay."""
    return F.to_json(row, {"ignoreNullFields": "false"})


def from_json(text: Column, ddl: str) -> Column:
    """A record; text that is none is an error."""
    got = F.from_json(text, ddl, {"mode": "FAILFAST"})
    return got
