"""Largest-inner-product neighbours through a graph that NN-descent builds and a greedy search walks.

Equal vectors are one node.  The first graph joins each node with the others of its blocks in a few random
one-dimensional orders, whose cells grow in number with the table.  A round of NN-descent brings, by joins on both
edge directions, every node's neighbours together in one place, compares the pairs that hold a new edge, proposes
each member's PROPOSED best partners there, and keeps each node's DEGREE best; rounds go on until less than DELTA of
the edges that two steps meet are new.  Joined rows carry vectors scaled by a power of two, in the precision they were given in, and
are compared in double precision, so near-copies and vectors about one common point are told apart; scores that leave
the operator are exact.  A query starts at its own node and expands the unexpanded ones among its FRONT best nodes,
EXPAND at a step, until there are none.  Results are expanded from nodes to rows, of
which a node keeps as many smallest ids as a result can hold, so ties stay exact under any number of copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm.common import free, keep, width
from factweave.llm.vectors import matrix, usable

DEGREE, REVERSE, TREES, BLOCK, PROPOSED, DELTA = 44, 24, 4, 128, 12, 0.03
FRONT, EXPAND, BEAM = 96, 32, 128
LOG = 2500  # above the logarithm of the inverse of any scaled product that isn't zero

EDGE, MARKED = "u long, v long, s double", "u long, v long, s double, new boolean"


def _encode(dim: int, signs: int, kind: str):
    """Adds an order key for each random direction and the code (exponent and bytes a component, then components)."""

    def rows(batches):
        axes = np.random.default_rng(5).normal(size=(dim, TREES * signs))
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                up = np.frexp(np.abs(x).max(1))[1]
                x = np.ldexp(x, -up[:, None])
                p = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ axes
                gray = []
                for t in range(TREES):  # nearby in the order: the same signs in most directions
                    bits = (p[:, t * signs : (t + 1) * signs] > 0).astype(np.int64)
                    flip = np.bitwise_xor.accumulate(bits, axis=1)
                    gray.append(flip @ (1 << np.arange(signs - 1, -1, -1)) + 0.0)
                head = np.stack([up, np.full(len(up), np.dtype(kind).itemsize)], 1).astype("<i4")
                raw = [h.tobytes() + c.tobytes() for h, c in zip(head, x.astype(kind), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(list(np.stack(gray, 1)), pa.list_(pa.float64()))], names=["u", "code", "orders"])

    return rows


def _decode(col) -> tuple[np.ndarray, np.ndarray]:
    """(scaled components, scales' logarithms) of codes."""
    raw = np.frombuffer(b"".join(x.as_buffer() for x in col), np.uint8).reshape(len(col), -1)
    head = np.ascontiguousarray(raw[:, :8]).view("<i4")
    kind = f"<f{head[0, 1]}" if len(head) else "<f8"
    return np.ascontiguousarray(raw[:, 8:]).view(kind).astype(np.float64), head[:, 0].astype(np.float64)


def _measure(dot: np.ndarray, log: np.ndarray) -> np.ndarray:
    """What orders the partners of one node as their inner products do: the node's own scale is left out and the
    partner's counts by its logarithm, so no magnitude that a double can have gets lost."""
    size = np.abs(dot)
    return np.sign(dot) * (np.log2(np.where(size > 0, size, 1)) + log + LOG)


def _best(owner: np.ndarray, other: np.ndarray, score: np.ndarray, k: int, new: np.ndarray | None = None):
    """Indices of each owner's k best different others; of equal pairs one that isn't new."""
    if not len(owner):
        return np.zeros(0, np.int64)
    order = np.lexsort((new if new is not None else score, other, owner))
    order = order[np.concatenate([[True], (np.diff(owner[order]) != 0) | (np.diff(other[order]) != 0)])]
    order = order[np.lexsort((other[order], -score[order], owner[order]))]
    at = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
    return order[at < k]


def _edges(u, v, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s.astype(np.float64))], names=["u", "v", "s"])


def _block_edges(batches):
    held = None
    for batch in batches:
        held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held else pa.Table.from_batches([batch])
        while held.num_rows >= 2 * BLOCK:
            yield _all_pairs(held.slice(0, BLOCK))
            held = held.slice(BLOCK)
    if held and held.num_rows > 1:
        yield _all_pairs(held)


def _all_pairs(t: pa.Table) -> pa.RecordBatch:
    u, (x, log) = t.column("u").to_numpy(), _decode(t.column("code").combine_chunks())
    s = _measure(x @ x.T, log)
    np.fill_diagonal(s, -np.inf)
    k = min(DEGREE, len(u) - 1)
    at = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return _edges(np.repeat(u, k), u[at].ravel(), np.take_along_axis(s, at, 1).ravel())


def _groups(batches, most: int):
    """Tables of whole groups of column u (rows arrive sorted by u), of about most rows."""
    held = None
    for batch in batches:
        held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held else pa.Table.from_batches([batch])
        if held.num_rows >= most:
            u = held.column("u").to_numpy()
            cut = int(np.searchsorted(u, u[-1]))
            if cut:
                yield held.slice(0, cut).combine_chunks()
                held = held.slice(cut)
    if held and held.num_rows:
        yield held.combine_chunks()


def _local_join(batches):
    """Better edges among each node's neighbours: rows u, v, new, low (v's worst kept score), code of v."""
    for t in _groups(batches, 40_000):
        u, v, new, low = (t.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v", "new", "low"))
        x, log = _decode(t.column("code").combine_chunks())
        cut = np.flatnonzero(np.diff(u, prepend=u[0] - 1))
        size = np.diff(np.append(cut, len(u)))
        out = []
        for n in np.unique(size[size > 1]):
            rows = cut[size == n][:, None] + np.arange(n)
            s = _measure(x[rows] @ x[rows].transpose(0, 2, 1), log[rows][:, None, :])
            ok = (new[rows][:, :, None] | new[rows][:, None, :]) & (v[rows][:, :, None] != v[rows][:, None, :]) & (s > low[rows][:, :, None])
            s = np.where(ok, s, -np.inf)
            k = min(PROPOSED, n - 1)
            at = np.argpartition(-s, k - 1, axis=2)[:, :, :k]
            best = np.take_along_axis(s, at, 2)
            hit = np.isfinite(best)
            out.append((np.broadcast_to(v[rows][:, :, None], at.shape)[hit], np.take_along_axis(v[rows], at.reshape(len(rows), -1), 1).reshape(at.shape)[hit], best[hit]))
        if out:
            a, b, s = (np.concatenate(c) for c in zip(*out, strict=True))
            i = _best(a, b, s, DEGREE)
            yield _edges(a[i], b[i], s[i])


def _top(k: int):
    def rows(batches):
        for t in _groups(batches, 60_000):
            u, v, s, new = (t.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v", "s", "new"))
            i = _best(u, v, s, k, new)
            yield pa.RecordBatch.from_arrays([*_edges(u[i], v[i], s[i]).columns, pa.array(new[i])], names=["u", "v", "s", "new"])

    return rows


def _moving(graph: DataFrame) -> float:
    """The share of new edges among those that two steps from any node meet: where few nodes are the neighbours of
    most, it is their edges that count."""
    met = graph.groupBy(F.col("v").alias("u")).agg(F.count("*").alias("times"))
    new, all_ = graph.groupBy("u").agg(F.count("*").alias("n"), F.count_if("new").alias("new")).join(met, "u").agg(F.sum(F.col("times") * F.col("new")), F.sum(F.col("times") * F.col("n"))).first()
    return new / all_ if all_ else 0.0


def build_graph(nodes: DataFrame) -> DataFrame:
    """(u, v, s) with up to DEGREE neighbours v of every node u, from nodes (u, code, orders)."""
    n = width(nodes.sparkSession)
    start = None
    for t in range(TREES):
        order = nodes.select("u", "code", F.col("orders")[t].alias("o"), F.xxhash64("u", F.lit(t)).alias("tie"))  # a cell of many parts otherwise each time
        made = order.repartitionByRange(max(2, n // 4), "o", "tie").sortWithinPartitions("o", "tie").select("u", "code").mapInArrow(_block_edges, EDGE)
        start = made if start is None else start.unionByName(made)
    best = lambda e: keep(e.repartition(n, "u").sortWithinPartitions("u").mapInArrow(_top(DEGREE), MARKED))
    graph = best(start.withColumn("new", F.lit(True)))
    while _moving(graph) > DELTA:
        back = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "new").withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("new"), F.xxhash64("u", "v"))))
        both = graph.select("u", "v", "new").unionByName(back.where(f"rank <= {REVERSE}").drop("rank")).groupBy("u", "v").agg(F.max("new").alias("new"))
        low = graph.groupBy("u").agg(F.when(F.count("*") < DEGREE, F.lit(float("-inf"))).otherwise(F.min("s")).alias("low"))
        member = nodes.select(F.col("u").alias("v"), "code").join(low.withColumnRenamed("u", "v"), "v")
        better = both.join(member, "v").repartition(n, "u").sortWithinPartitions("u").mapInArrow(_local_join, EDGE)
        next_ = best(graph.withColumn("new", F.lit(False)).unionByName(better.withColumn("new", F.lit(True))))
        free(graph)
        graph = next_
    return graph.drop("new")


def _score(batches):
    for batch in batches:
        if batch.num_rows:
            x, log = _decode(batch.column("code"))
            dot = np.einsum("ij,ij->i", _decode(batch.column("q_code"))[0], x)
            yield _edges(batch.column("u").to_numpy(), batch.column("v").to_numpy(), _measure(dot, log))


def _exact(batches):
    for batch in batches:
        if batch.num_rows:
            a, b = matrix(batch.column("q_key")), matrix(batch.column("key"))
            up = [np.frexp(np.abs(x).max(1))[1] for x in (a, b)]  # powers of two keep sums exact and products in range
            with np.errstate(over="ignore"):
                score = np.ldexp((np.ldexp(a, -up[0][:, None]) * np.ldexp(b, -up[1][:, None])).sum(1), up[0] + up[1])
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(score)], names=["u", "v", "score"])


def search(df: DataFrame, queries: str = "vec_id % 20 = 0", k: int = 20, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row of df that meets queries.

    Nearness is the largest inner product; score is exact, in double precision, on the given vectors; ties go to
    the smaller id; a query's own id is no candidate.  Vectors that are null, empty, zero, or hold null or
    non-finite components take no part, nor do rows without an id; only vectors of one dimension meet.  With
    fewer than k candidates all are returned.  Any finite magnitudes may meet; a product beyond a double is infinite.
    The search widens with k.  An empty df gives no rows.
    """
    front, beam_size = max(FRONT, 3 * k), max(BEAM, 5 * k)
    rows = keep(usable(df, id, vector).where("key is not null"))
    by_id = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    first = keep(rows.distinct().withColumn("at", by_id).where(f"at <= {k + 1}"))
    kind = "<f4" if df.schema[vector].dataType.elementType.typeName() == "float" else "<f8"
    nodes = keep(first.where("at = 1").select(F.col("vec_id").alias("u"), "key", F.length("key").alias("size")))
    sizes = [r["size"] for r in nodes.select("size").distinct().collect()]
    asked = rows.where(queries).distinct().join(nodes.select("key", "u"), "key").select(F.col("vec_id").alias("query_id"), "u")
    asked = keep(asked)
    found = None
    n = width(df.sparkSession)
    for size in sizes:
        own = nodes.where(F.col("size") == size)
        signs = min(50, max(12, (own.count() // BLOCK).bit_length() + 4))
        codes = keep(own.select("u", "key").mapInArrow(_encode(size // 8, signs, kind), "u long, code binary, orders array<double>"))
        graph = build_graph(codes)
        turned = F.row_number().over(Window.partitionBy("u").orderBy(F.xxhash64("u", "v")))
        back = graph.select(F.col("v").alias("u"), F.col("u").alias("v")).withColumn("rank", turned).where(f"rank <= {REVERSE}").drop("rank")
        ways = keep(graph.select("u", "v").unionByName(back).distinct())
        code = codes.select(F.col("u").alias("v"), "code")
        # beam rows: query node u, reached node v, score s, expanded or not
        q = keep(asked.select("u").distinct().join(codes.select("u", F.col("code").alias("q_code")), "u"))
        by_score = Window.partitionBy("u").orderBy(F.desc("s"), "v")
        open_ = (~F.col("done") & (F.row_number().over(by_score) <= front)).alias("open")
        beam = keep(q.select("u", F.col("u").alias("v"), "q_code", F.col("q_code").alias("code")).mapInArrow(_score, EDGE).withColumn("done", F.lit(False)).withColumn("open", F.lit(True)))
        while not beam.where("open").isEmpty():
            nth = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("open"), F.desc("s"), "v"))
            front = beam.select("u", "v", "s", "done", (F.col("open") & (nth <= EXPAND)).alias("go"))
            next_ = front.where("go").select("u", F.col("v").alias("w")).join(ways.withColumnRenamed("u", "w"), "w").select("u", "v").distinct()
            next_ = next_.join(beam.select("u", "v"), ["u", "v"], "left_anti").join(code, "v").join(q, "u").select("u", "v", "q_code", "code").mapInArrow(_score, EDGE)
            merged = front.select("u", "v", "s", (F.col("done") | F.col("go")).alias("done")).unionByName(next_.withColumn("done", F.lit(False)))
            reached = keep(merged.withColumn("rank", F.row_number().over(by_score)).where(f"rank <= {beam_size}").select("u", "v", "s", "done", open_))
            free(beam)
            beam = reached
        last = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))
        near = beam.withColumn("rank", last).where(f"rank <= {4 * k}").select("u", "v")
        key = own.select(F.col("u").alias("v"), "key")
        exact = near.join(key, "v").join(key.select(F.col("v").alias("u"), F.col("key").alias("q_key")), "u").select("u", "v", "q_key", "key").mapInArrow(_exact, "u long, v long, score double")
        found = exact if found is None else found.unionByName(exact)
    if found is None:
        return rows.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    found = keep(found.repartition(n, "u"))
    members = first.join(nodes.select("key", F.col("u").alias("v")), "key").select("v", "vec_id")
    every = asked.join(found, "u").join(members, "v").where("vec_id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", place).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def op2_nn_descent(spark, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: 20 neighbours of every twentieth id among all other rows."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


__all__ = ["build_graph", "search", "op2_nn_descent"]
