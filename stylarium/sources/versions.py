"""Tables in versions: data first, a manifest last, so that readers see all of a version or none of it.

A version's files are written to a folder of their own and never changed. The manifest that names them is
put in place by one step of the file system that fails if the place is taken (a hard link on a local disk, elsewhere a rename
that does not replace, as on HDFS). So a writer that dies half way leaves a folder that no manifest names, a second writer
takes the next number, and one that appends does so onto what is there by then. Files go only by sweep().
"""

from __future__ import annotations

import json
import os
import time
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MANIFESTS, DATA, DIGITS = "manifests", "data", 12


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, time of change in milliseconds) of a folder's entries; none if it is missing."""
    fs, at = _files(spark, path)
    return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(at)] if fs.exists(at) else []


def _text(spark: SparkSession, path: str) -> str:
    fs, at = _files(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _claim(spark: SparkSession, path: str, text: str) -> bool:
    """Puts a file with this text at path in one step; False if something is there."""
    fs, _ = _files(spark, path)
    draft = f"{path.rsplit('/', 1)[0]}/.draft-{uuid.uuid4().hex}"
    _, at = _files(spark, draft)
    stream = fs.create(at, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    try:
        if fs.getScheme() == "file":
            try:
                os.link(urlparse(draft).path, urlparse(path).path)
            except FileExistsError:
                return False
            return True
        return fs.rename(at, _files(spark, path)[1])
    finally:
        fs.delete(at, False)


def versions(spark: SparkSession, root: str) -> list[int]:
    names = (n for n, _ in _listed(spark, f"{root}/{MANIFESTS}"))
    return sorted(int(n[:DIGITS]) for n in names if n.endswith(".json") and n[:DIGITS].isdigit())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict | None:
    """What a version (the last, by default) says of itself; None where there is none."""
    known = versions(spark, root)
    if not known or (version is not None and version not in known):
        return None
    return json.loads(_text(spark, f"{root}/{MANIFESTS}/{known[-1] if version is None else version:0{DIGITS}}.json"))


def publish(df: DataFrame, root: str, facts: dict | None = None, append: bool = False, form: str = "parquet", tries: int = 50) -> int:
    """Writes df as the next version and returns its number; append: with all that the version before it has.

    An append to another schema or form is an error. facts: what the manifest tells beside version, form, schema, rows and parts.
    """
    spark, part = df.sparkSession, f"{DATA}/{uuid.uuid4().hex}"
    df.write.format(form).save(f"{root}/{part}")
    rows = spark.read.schema(df.schema).format(form).load(f"{root}/{part}").count()
    fs, at = _files(spark, f"{root}/{MANIFESTS}")
    fs.mkdirs(at)
    for _ in range(tries):
        before = manifest(spark, root)
        told = {"version": (before["version"] if before else 0) + 1, "form": form, "schema": json.loads(df.schema.json()), "rows": rows, "parts": [part], "facts": facts or {}}
        if append and before:
            if [(f["name"], f["type"]) for f in before["schema"]["fields"]] != [(f["name"], f["type"]) for f in told["schema"]["fields"]] or before["form"] != form:
                raise ValueError("an append must have the schema and form of what is there")
            told |= {"rows": before["rows"] + rows, "parts": [*before["parts"], part], "facts": before["facts"] | told["facts"]}
        if _claim(spark, f"{root}/{MANIFESTS}/{told['version']:0{DIGITS}}.json", json.dumps(told, ensure_ascii=False)):
            return told["version"]
    raise RuntimeError(f"{tries} versions were published by others in the meantime")


def load(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the last by default. What is published later does not change them."""
    told = manifest(spark, root, version)
    if told is None:
        raise FileNotFoundError(f"no version {'' if version is None else version} in {root}")
    schema = T.StructType.fromJson(told["schema"])
    return spark.read.schema(schema).format(told["form"]).load([f"{root}/{p}" for p in told["parts"]])


def sweep(spark: SparkSession, root: str, keep: int = 2, older: float = 86_400.0) -> list[str]:
    """Removes manifests before the last keep ones, then folders that no manifest names and that are older (seconds); tells which.

    older must exceed the time that a writer needs, as what it has written is not named yet.
    """
    if keep < 1:
        raise ValueError("the last version stays")
    for v in versions(spark, root)[:-keep]:
        fs, at = _files(spark, f"{root}/{MANIFESTS}/{v:0{DIGITS}}.json")
        fs.delete(at, False)
    named = {p for v in versions(spark, root) for p in manifest(spark, root, v)["parts"]}
    gone = []
    for name, changed in _listed(spark, f"{root}/{DATA}"):
        if f"{DATA}/{name}" not in named and time.time() - changed / 1000 >= older:
            fs, at = _files(spark, f"{root}/{DATA}/{name}")
            fs.delete(at, True)
            gone.append(f"{DATA}/{name}")
    return sorted(gone)
