"""Product codes of vectors in exact integer arithmetic.

Components become integers, and a codebook of few entries for each part of the vector is refined by rounds of
nearest-entry assignment and floor means.  Distances come from matrix products of limbs: an integer is cut into limbs
of 15 bits (the last one signed), so that every float64 product of two limb matrices stays below 2**53 and is exact
whatever order BLAS adds in; the products are shifted into place and added in int64, and the first smallest distance
wins.  Sums for the means are matrix products of the same limbs with the one-hot assignment.  Where the components are
so large that int64 can't hold a distance, the limb products are added as Python integers instead, so nothing is ever
rounded.  A round is one scan: tasks add up their rows and emit one number for each limb, part, entry and position.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import keep

BITS = 15
BLOCK_BYTES = 16 << 20
SAFE = 1 << 62
LONG = (1 << 63) - 1


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): int64, or Python integers where a component is too large for that."""
    if not x.size or np.abs(x).max() < SAFE / scale:
        return np.floor(x * scale).astype(np.int64)
    return np.array([(Fraction(c) * scale).__floor__() for c in x.ravel().tolist()], object).reshape(x.shape)


def limbs(a: np.ndarray) -> list[np.ndarray]:
    """float64 matrices whose sum, the i-th times 2**(BITS * i), is a."""
    out = []
    while a.size and np.abs(a).max() >= 1 << BITS:
        out.append((a & ((1 << BITS) - 1)).astype(np.float64))
        a = a >> BITS
    return [*out, a.astype(np.float64)]


def _largest(a: np.ndarray) -> int:
    return int(np.abs(a).max()) if a.size else 0


def _whole(exact: np.ndarray, kind) -> np.ndarray:
    """float64 holding integers below 2**53 as integers of the given kind."""
    return exact.astype(np.int64) if kind is np.int64 else exact.astype(np.int64).astype(object)


def nearest(a: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest book entry, the first of equals."""
    kind = np.int64 if a.shape[1] * (_largest(a) + _largest(book)) ** 2 < SAFE else object
    dot = np.zeros((len(a), len(book)), kind)
    right = limbs(book)
    for i, left in enumerate(limbs(a)):
        for j, other in enumerate(right):
            dot += _whole(left @ other.T, kind) << (BITS * (i + j))
    norm = lambda m: (m.astype(kind) ** 2).sum(1)
    far = norm(book)[None, :] - 2 * dot
    index = far.argmin(1)
    return index, norm(a) + far[np.arange(len(a)), index]


def _blocks(batches, dim: int, scale: int):
    """(first columns, integer matrix) of blocks of rows; the last column holds the vectors."""
    step = max(1, BLOCK_BYTES // (8 * dim))
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            yield part.columns[:-1], integers(part.columns[-1].flatten().to_numpy().reshape(-1, dim), scale)


def _sums(books: np.ndarray, dim: int, scale: int):
    parts, entries, d = books.shape

    def rows(batches):
        total, count = {}, np.zeros((parts, entries), np.int64)
        for _, a in _blocks(batches, dim, scale):
            cut = limbs(a)
            for p in range(parts):
                index, _ = nearest(a[:, p * d : (p + 1) * d], books[p])
                hot = (index == np.arange(entries)[:, None]).astype(np.float64)
                count[p] += hot.sum(1).astype(np.int64)
                for i, limb in enumerate(cut):
                    total.setdefault(i, np.zeros(books.shape, np.int64))[p] += (hot @ limb[:, p * d : (p + 1) * d]).astype(np.int64)
        for i, x in [(-1, count), *total.items()]:
            at = np.arange(x.size, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(x.size, i, np.int32)), pa.array(at), pa.array(x.ravel())], names=["limb", "slot", "total"])

    return rows


def _codes(books: np.ndarray, dim: int, scale: int, names: list[str]):
    parts, _, d = books.shape

    def rows(batches):
        for kept, a in _blocks(batches, dim, scale):
            found = [nearest(a[:, p * d : (p + 1) * d], books[p]) for p in range(parts)]
            digits = np.stack([x for x, _ in found], 1).astype(np.uint8).tobytes().hex()
            width = 2 * parts
            error = sum(e.astype(object) for _, e in found)
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array([digits[k : k + width] for k in range(0, len(digits), width)], pa.string()), pa.array([e if e <= LONG else None for e in error], pa.int64())],
                names=[*names, "code", "error"],
            )

    return rows


class Codes:
    """Codebooks fitted on a table: books[part, entry] is a row of integers."""

    def __init__(self, df: DataFrame, id: str = "vec_id", vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096):
        if scale & (scale - 1) or not 0 < entries <= 256:
            raise ValueError("scale has to be a power of two, and entries at most 256")
        self.id, self.vector, self.scale = id, vector, scale
        whole = F.col(vector).isNotNull() & F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))
        sizes = df.where(whole & (F.size(vector) > 0)).groupBy(F.size(vector).alias("dim")).count()
        usual = sizes.orderBy(F.desc("count"), "dim").first()
        self.dim = usual["dim"] if usual and usual["dim"] % parts == 0 else 0
        self.usable = whole & (F.size(vector) == (self.dim or -1))
        d = self.dim // parts
        first = df.where(self.usable).select(F.col(id).alias("i"), F.col(vector).cast("array<double>").alias("v")).orderBy(F.asc_nulls_last("i"), "v").limit(entries)
        start = integers(np.array([r["v"] for r in first.collect()], np.float64).reshape(-1, self.dim or 1), scale)
        self.books = np.stack([start[:, p * d : (p + 1) * d] for p in range(parts)])
        for _ in range(rounds if self.dim else 0):
            self._refine(df)

    def _rows(self, df: DataFrame, *columns: str) -> DataFrame:
        return df.where(self.usable).select(*columns, F.col(self.vector).cast("array<double>").alias("vector"))

    def _refine(self, df: DataFrame) -> None:
        parts, entries, d = self.books.shape
        sums = self._rows(df).mapInArrow(_sums(self.books, self.dim, self.scale), "limb int, slot long, total long").groupBy("limb", "slot").agg(F.sum("total").alias("total"))
        total, count = [0] * self.books.size, [0] * (parts * entries)
        for r in sums.collect():  # limbs x dim x entries numbers, however many rows there are
            if r["limb"] < 0:
                count[r["slot"]] = r["total"]
            else:
                total[r["slot"]] += r["total"] << (BITS * r["limb"])
        old = self.books.ravel().tolist()
        new = [t // count[k // d] if count[k // d] else o for k, (t, o) in enumerate(zip(total, old, strict=True))]
        kind = np.int64 if max(map(abs, new), default=0) < SAFE else object
        self.books = np.array(new, kind).reshape(self.books.shape)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def assign(self, df: DataFrame, *columns: str) -> DataFrame:
        """The columns of every usable row, its code (two hex digits for each part) and its squared distance, null beyond a long."""
        from pyspark.sql.types import StringType, LongType, StructType

        rows = self._rows(df, *columns)
        if not self.dim:
            return rows.select(*columns, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")).where("false")
        schema = StructType(rows.schema.fields[:-1]).add("code", StringType()).add("error", LongType())
        return rows.mapInArrow(_codes(self.books, self.dim, self.scale, list(columns)), schema)


def encode(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", **fit) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable row.

    Left out are rows whose vector is null, holds null or non-finite components, or has not the length that most
    vectors have (the smaller one if tied; all rows, if that can't be cut into equal parts).  Of repeated ids each row
    is coded; codebooks start from the rows of smallest id, null ids last and equal ids by their components; with
    fewer rows than entries a codebook is as small.  error and label_error are null where they don't fit a long;
    label_error then counts the errors that do.  Further columns are not looked at; an empty df gives no rows.
    """
    model = Codes(df, id, vector, **fit)
    rows = keep(model.assign(df, id, label).toDF("vec_id", "label", "code", "error"))
    totals = keep(rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")))
    out = rows.join(totals.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(model.digest()).alias("codebooks_sha256"))


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """The product codes of all embeddings."""
    return encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The same in SQL, round by round."""
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS HUGEINT)) AS v, len(embedding) // {parts} AS d FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"cells AS MATERIALIZED (SELECT vec_id, label, p, i, v[p * d + i + 1] AS x FROM (SELECT *, unnest(range(d)) AS i FROM kept), range({parts}) AS a(p))",
        f"firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept ORDER BY vec_id LIMIT {entries})",
        "book0 AS MATERIALIZED (SELECT p, k, i, x AS c FROM cells JOIN firsts USING (vec_id))",
    ]
    for r in range(rounds + 1):
        steps.append(f"far{r} AS (SELECT vec_id, any_value(label) AS label, p, k, sum((x - c) * (x - c)) AS e FROM cells JOIN book{r} USING (p, i) GROUP BY vec_id, p, k)")
        steps.append(f"near{r} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, p, min(e) AS e, CAST(min(e * {entries} + k) % {entries} AS BIGINT) AS k FROM far{r} GROUP BY vec_id, p)")
        if r < rounds:
            mean = "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)"
            steps.append(f"mean{r} AS (SELECT p, k, i, {mean} AS c FROM cells JOIN near{r} USING (vec_id, p) GROUP BY p, k, i)")
            steps.append(f"book{r + 1} AS MATERIALIZED (SELECT p, k, i, coalesce(m.c, b.c) AS c FROM book{r} AS b LEFT JOIN mean{r} AS m USING (p, k, i))")
    steps.append(f"coded AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, string_agg(lower(lpad(to_hex(k), 2, '0')), '' ORDER BY p) AS code, CAST(sum(e) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id)")
    steps.append(f"digest AS (SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY p, k, i)) AS codebooks_sha256 FROM book{rounds})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest"


__all__ = ["Codes", "encode", "op13_vector_codes", "oracle"]
