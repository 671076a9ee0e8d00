"""Cosine similarity join of vectors by epsilon grid order.

Unit vectors with cosine >= c lie within epsilon = sqrt(2 - 2c).  They are rotated onto their principal axes and
sorted by their cells in a grid of that width on the leading axes; the sequence is cut into blocks with bounding
boxes over all axes.  From one interval over the whole sequence, pairs of intervals are split into pairs of
their eighths, level by level, and a pair whose boxes lie further apart than epsilon is dropped.  What remains
are pairs of blocks; a task compares two blocks in slices with boxes of their own, in single precision with a
margin, and decides in double precision.  It returns sums of links and a local spanning forest, no pairs.  Equal
vectors are joined as one with a weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import components, keep, width
from factweave.llm.vectors import local_roots, matrix, usable

BLOCK, SLICE, AXES, SLACK = 1024, 128, 8, 1e-4


def _moments(dim: int):
    def rows(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                x = _unit(x)
                total += x.T @ x
        yield pa.RecordBatch.from_pydict({"cell": np.arange(dim * dim), "v": total.ravel()})

    return rows


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two (exact) that brings its largest component near 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(axes: np.ndarray, eps: float):
    def rows(batches):
        for batch in batches:
            if batch.num_rows:
                p = _unit(matrix(batch.column(2))) @ axes[:, :AXES]
                cell = (np.floor(p / eps) + 128).clip(0, 255).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in cell], pa.binary())], names=["rep", "weight", "key", "cell"])

    return rows


BLOCKS = "block long, low array<double>, high array<double>, reps binary, weights binary, rows binary"


def _blocks(axes: np.ndarray):
    def rows(batches):
        from pyspark import TaskContext

        part, k, held = TaskContext.get().partitionId(), 0, None

        def one(t: pa.Table, k: int):
            p = _unit(matrix(t.column("key"))) @ axes
            raw = [t.column(c).to_numpy().astype("<i8").tobytes() for c in ("rep", "weight")]
            return pa.RecordBatch.from_pylist([{"block": (part << 20) + k, "low": p.min(0).tolist(), "high": p.max(0).tolist(), "reps": raw[0], "weights": raw[1], "rows": matrix(t.column("key")).tobytes()}], schema=pa.schema([("block", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("reps", pa.binary()), ("weights", pa.binary()), ("rows", pa.binary())]))

        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held else pa.Table.from_batches([batch])
            while held.num_rows >= BLOCK:
                yield one(held.slice(0, BLOCK), k)
                held, k = held.slice(BLOCK), k + 1
        if held and held.num_rows:
            yield one(held, k)

    return rows


def _near(eps: float):
    def test(a_low, a_high, b_low, b_high):
        gaps = F.zip_with(F.arrays_zip(a_low.alias("l"), a_high.alias("h")), F.arrays_zip(b_low.alias("l"), b_high.alias("h")), lambda a, b: F.greatest(F.lit(0.0), a["l"] - b["h"], b["l"] - a["h"]))
        return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= (eps + 1e-6) ** 2

    return test


LINKS = "rep long, links long, root long"


def _compare(cosine: float, axes: np.ndarray):
    eps = np.sqrt(2 - 2 * cosine) + 1e-6

    def slices(p):
        at = range(0, len(p), SLICE)
        return np.array([p[k : k + SLICE].min(0) for k in at]), np.array([p[k : k + SLICE].max(0) for k in at])

    def compare(x: dict, y: dict, same: bool):
        """(members' rep, links, root) of a block pair, or None."""
        (al, ah), (bl, bh) = ((v["slice_low"], v["slice_high"]) for v in (x, y))
        hits_a, hits_b = [], []
        for i in range(len(al)):
            gap = np.maximum(0, np.maximum(al[i] - bh, bl - ah[i]))
            for j in np.flatnonzero((gap * gap).sum(1) <= eps * eps):
                if same and j < i:
                    continue
                a, b = np.nonzero(x["single"][i * SLICE : (i + 1) * SLICE] @ y["single"][j * SLICE : (j + 1) * SLICE].T >= cosine - SLACK)
                a, b = a + i * SLICE, b + j * SLICE
                if same:
                    a, b = a[a < b], b[a < b]
                hits_a.append(a)
                hits_b.append(b)
        a, b = (np.concatenate(h) if h else np.zeros(0, np.int64) for h in (hits_a, hits_b))
        ok = np.empty(len(a), bool)
        for k in range(0, len(a), 100_000):
            va, vb = x["full"][a[k : k + 100_000]], y["full"][b[k : k + 100_000]]
            ok[k : k + 100_000] = (va * vb).sum(1) / (np.sqrt((va * va).sum(1)) * np.sqrt((vb * vb).sum(1))) >= cosine
        a, b = a[ok], b[ok]
        if not len(a):
            return None
        base = 0 if same else len(x["reps"])
        both, weight = (x["reps"], x["weights"]) if same else (np.concatenate([x["reps"], y["reps"]]), np.concatenate([x["weights"], y["weights"]]))
        n = np.bincount(a, weight[b + base], len(both)) + np.bincount(b + base, weight[a], len(both))
        root = local_roots(a, b + base, len(both))
        on = np.flatnonzero(n)
        return both[on], n[on].astype(np.int64), both[root[on]]

    def opened(block: int, raw: dict) -> dict:
        reps, weights = (np.frombuffer(raw[c], "<i8") for c in ("reps", "weights"))
        full = _scaled(np.frombuffer(raw["rows"], "<f8").reshape(len(reps), -1))
        unit = _unit(full)
        low, high = slices(unit @ axes)
        return {"block": block, "reps": reps, "weights": weights, "full": full, "single": unit.astype(np.float32), "slice_low": low, "slice_high": high}

    def tile(t: pa.Table) -> pa.Table:
        """Links of all pairs of a block of node x and one of node y."""
        out, sides = [], [[], []]
        for raw in t.to_pylist():
            for k in (0, 1):
                if raw["node"] == raw["xy"[k]]:
                    sides[k].append(opened(raw["block"], raw))
        for x in sides[0]:
            for y in sides[1]:
                if t.column("x")[0].as_py() != t.column("y")[0].as_py() or x["block"] <= y["block"]:
                    out.append(compare(x, y, x["block"] == y["block"]))
        out = [o for o in out if o]
        return pa.table({c: pa.array(np.concatenate([o[k] for o in out]) if out else [], pa.int64()) for k, c in enumerate(("rep", "links", "root"))})

    return tile


def _pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """(x, y) with x <= y: the nodes (eight blocks each) whose boxes lie within eps, found by splitting intervals."""
    top = blocks.agg(F.max("block")).first()[0] or 0
    levels = 1
    while top >> (3 * levels):
        levels += 1
    node = lambda level: blocks.select(F.shiftright("block", 3 * level).alias("node"), F.posexplode(F.arrays_zip("low", "high")).alias("d", "b")).groupBy("node", "d").agg(F.min("b.low").alias("low"), F.max("b.high").alias("high")).groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "low", "high"))), lambda s: s["low"]).alias("low"), F.transform(F.array_sort(F.collect_list(F.struct("d", "low", "high"))), lambda s: s["high"]).alias("high"))
    test = _near(eps)
    pairs = keep(blocks.sparkSession.range(1).select(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")))
    for level in range(levels - 1, 0, -1):
        nodes = keep(node(level))
        side = lambda s: nodes.select(F.shiftright("node", 3).alias(s), F.col("node").alias(f"new_{s}"), F.col("low").alias(f"low_{s}"), F.col("high").alias(f"high_{s}"))  # noqa: E731, B023
        split = pairs.join(side("x"), "x").join(side("y"), "y").where("new_x <= new_y").where(test(F.col("low_x"), F.col("high_x"), F.col("low_y"), F.col("high_y")))
        pairs = keep(split.select(F.col("new_x").alias("x"), F.col("new_y").alias("y")))
    return pairs


def cosine_components(df: DataFrame, cosine: float = 0.95, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id (long), kept for every row, linking vectors with at least this cosine.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and so do rows
    without an id.  Vectors of other dimensions than a row's own link with it never.  Repeated vectors link with
    each other.  An empty df gives no rows.
    """
    eps = float(np.sqrt(2 - 2 * cosine))
    rows = keep(usable(df, id, vector))
    distinct = keep(rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")).withColumn("size", F.length("key")))
    found = None
    for size in [r["size"] for r in distinct.select("size").distinct().orderBy("size").collect()]:
        own, dim = distinct.where(F.col("size") == size).select("rep", "weight", "key"), size // 8
        moments = own.select("key").mapInArrow(_moments(dim), "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
        square = np.zeros(dim * dim)
        square[[r["cell"] for r in moments]] = [r["v"] for r in moments]
        axes = np.linalg.eigh(square.reshape(dim, dim))[1][:, ::-1].copy()
        n = width(df.sparkSession)
        ordered = own.mapInArrow(_cells(axes, eps), "rep long, weight long, key binary, cell binary").repartitionByRange(max(2, n // 4), "cell", "rep").sortWithinPartitions("cell", "rep")
        blocks = keep(ordered.select("rep", "weight", "key").mapInArrow(_blocks(axes), BLOCKS))
        pairs = _pairs(blocks.select("block", "low", "high"), eps)
        # a task meets the eight blocks of either node once, not once for each pair of blocks
        ends = pairs.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("node"))
        given = blocks.select(F.shiftright("block", 3).alias("node"), "block", "reps", "weights", "rows")
        made = keep(ends.join(given, "node").groupBy("x", "y").applyInArrow(_compare(cosine, axes), LINKS))
        found = made if found is None else found.unionByName(made)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    each = distinct.join(sums, "rep", "left").join(comp.withColumnRenamed("v", "rep"), "rep", "left")
    each = each.select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(each, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5_epsilon_grid_join(spark, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector, for cosines of 0.95 and more."""
    return cosine_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


__all__ = ["cosine_components", "op5_epsilon_grid_join"]
