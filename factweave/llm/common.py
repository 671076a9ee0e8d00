"""Helpers that the operators share: tables that cut lineage, text as bytes, connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
M1, M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where the session is local and has none."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-factweave-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


@contextlib.contextmanager
def _tidy(spark: SparkSession):
    """Within it, a query's shuffle files go as soon as it has written its result."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def keep(df: DataFrame, *by: str) -> DataFrame:
    """df written as Parquet into the shared folder, in folders of the columns by, and read again."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/factweave-{uuid.uuid4().hex}"
    with _tidy(spark):
        df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def free(*frames: DataFrame, part: str = "") -> None:
    """Delete tables of keep(), or one folder of them, that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_kept_at", None):
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(f"{path}/{part}" if part else path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(df: DataFrame, text: str, each: int = 64 << 20) -> int:
    """How many parts to deal what derives from df's texts into: one for each of so many bytes, width() at least."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(width(df.sparkSession), -(-total // each))


def trim() -> None:
    """Give memory that this Python process no longer uses back to the machine; workers outlive their tasks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(rows):
    """A mapInArrow function that leaves no unused memory behind when a task ends."""

    def run(batches):
        try:
            yield from rows(batches)
        finally:
            trim()

    return run


def lean_group(make):
    """The same for an applyInArrow function, after each group; for groups of megabytes."""

    def run(*tables):
        try:
            return make(*tables)
        finally:
            trim()

    return (lambda left, right: run(left, right)) if make.__code__.co_argcount == 2 else lambda table: run(table)


def per_worker(key: str, make):
    """make(), once for each Python worker: tasks that reuse the worker share it."""
    import sys
    import types

    cache = sys.modules.setdefault("_factweave_worker", types.ModuleType("_factweave_worker")).__dict__
    if key not in cache:
        cache[key] = make()
    return cache[key]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> U64(33))
    x = x * M1
    x ^= x >> U64(33)
    x *= M2
    x ^= x >> U64(33)
    return x


def byte_column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column (null: empty) and the offsets of its rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "").cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if len(col) and col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def row_blocks(offsets: np.ndarray, limit: int):
    """(first row, end row) of runs of whole rows with at most limit bytes, or one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


class Rolling:
    """Polynomial hashes modulo 2**64 over random byte codes; any substring's hash in O(1)."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.code = rng.integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
        base = int(rng.integers(2**62, 2**63)) * 2 + 1
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, U64)

    def over(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums; of() reads them."""
        if (n := len(data) + 1) > len(self.up):
            size = max(n, 1 << 20)
            self.up, self.down = (np.concatenate([np.ones(1, U64), np.cumprod(np.full(size, b, U64))]) for b in (self.base, self.inverse))
        out = np.zeros(len(data) + 1, U64)
        np.cumsum(self.code[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(U64) * M2)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v long, component long: the smallest id reachable) for every end of an edge.

    Each round gives every vertex its closed neighbourhood's member of the smallest hash and contracts;
    a round's salt makes the live vertices fall by a constant factor whatever the graph's shape.
    """
    salt, maps = 0, []
    live = keep(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    while not live.isEmpty():
        salt += 1
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(salt)).alias("h"), F.col(c).alias("v"))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        step = keep(best.select(F.col("a").alias("v"), F.least(F.col("m"), rank("a"))["v"].alias("root")))
        maps.append(step)
        ends = live.join(step.select(F.col("v").alias("a"), F.col("root").alias("ra")), "a").join(step.select(F.col("v").alias("b"), F.col("root").alias("rb")), "b")
        nxt = keep(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b").distinct())
        free(live)
        live = nxt
    if not maps:
        return live.select(F.col("a").alias("v"), F.col("b").alias("component"))
    root = maps[0]
    for step in maps[1:]:
        root = root.join(step.select(F.col("v").alias("root"), F.col("root").alias("up")), "root", "left").select("v", F.coalesce("up", "root").alias("root"))
    root = keep(root)
    free(*maps, live)
    least = keep(root.groupBy("root").agg(F.min(F.least("v", "root")).alias("component")))  # kept: a join of two tables can be split where skewed
    return root.join(least, "root").select("v", "component")


def keep_bucketed(df: DataFrame, key: str) -> DataFrame:
    """df written into the shared folder in buckets of key: later groupings by key move none of its rows."""
    spark, name, n = df.sparkSession, f"factweave_{uuid.uuid4().hex}", width(df.sparkSession)
    path = f"{shared_dir(spark)}/{name}"
    with _tidy(spark):
        df.repartition(n, key).write.option("path", path).option("compression", "zstd").option("parquet.block.size", 16 << 20).bucketBy(n, key).saveAsTable(name)
    return spark.table(name)
