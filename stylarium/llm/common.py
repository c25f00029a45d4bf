"""Shared helpers: written tables in the cluster's shared folder, text hashing, components."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

M64 = (1 << 64) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


BATCH_BYTES = 4 << 20  # of an Arrow batch; one value for all operators, so that the order of calls is of no matter
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where that is unset, a local session gets a folder of its own, removed when the driver ends; on a cluster it is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="stylarium-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        conf = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What cut() writes inside goes at the end, and shuffle files that nothing refers to any more with it.

    Results made inside must be written inside, or cut() with keep: they are plans over what goes. Without a scope
    tables belong to the owner of spark.checkpoint.dir.
    """
    _scopes.append([])
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for path in _scopes.pop():
            at = hadoop.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives lost executors.

    keep: the table outlives the innermost scope; the one around it, if any, removes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    owners = _scopes[:-1] if keep else _scopes
    if owners:
        owners[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def lean(run):
    """run, with what its worker no longer needs given back to the machine at the end: workers wait for later stages."""

    def wrapped(it):
        try:
            yield from run(it)
        finally:
            import ctypes

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class ByteHasher:
    """Hashes of many byte ranges of a buffer from one prefix sum (polynomial modulo 2^64 over random byte values)."""

    P = 0x9DDFEA08EB382D69

    def __init__(self) -> None:
        rng = np.random.default_rng(20240607)
        self.values = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.inverse = pow(self.P, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def reserve(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            for name, base in (("up", self.P), ("down", self.inverse)):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self.reserve(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(np.uint64))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components: (node, comp), comp the smallest node reachable, for the nodes of edges.

    Alternating large and small stars; each half-step is one partial
    aggregation and one join, so a hot centre is pre-aggregated and its join
    can be split. Converges in a logarithmic number of rounds.
    """
    e = cut(
        edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct(), "cc"
    )
    last = None
    for _ in range(max_rounds):
        # Large star: every larger neighbour of u goes to the least of u's neighbourhood.
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        )
        # Small star: u and its smaller neighbours go to the least of them.
        large = cut(large, "cc")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        j = large.join(least, "v")
        e = cut(
            j.select(F.col("m").alias("p"), F.col("u").alias("q"))
            .union(j.select(F.col("m").alias("p"), F.col("v").alias("q")))
            .where("p < q")
            .distinct()
            .toDF("u", "v"),
            "cc",
        )
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("connected components did not converge")
    return e.select(F.col("v").alias("node"), F.col("u").alias("comp")).union(
        e.select(F.col("u").alias("node"), F.col("u").alias("comp")).distinct()
    )
