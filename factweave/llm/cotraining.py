"""Quality classifier by co-training on two views of a document: its text and its metadata.

The text view averages hashed word weights and adds a few shape statistics; the metadata view knows source,
language, length and their pairs.  A view's weights start from sums that Spark takes over all documents known to it
(log odds of counts by class, distances of the classes' mean statistics) and are refined by logistic steps on a sample
of LABELLED labelled documents, drawn back to where they started.  In each round each view scores all unlabelled
documents, names the most confident of them, in the proportion of the classes and by quantiles over all, and Spark adds
them to the other view's sums beside all labelled documents.  What one view names grows with the rounds, up to one in
SHARE; a view that documents held back don't show to be better than chance names none.  Both views are then calibrated and combined by a logistic model on
CALIBRATION labelled documents at most, of a quarter that no view was fitted on.  The driver sees sums of a fixed
size, quantiles and those samples.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import U64, Rolling, byte_column, keep, row_blocks

LABELLED, CALIBRATION, ROUNDS, SHARE, TABLE, META = 6000, 4000, 4, 5, 1 << 15, 1 << 12
BLOCK_BYTES, CHUNK, PSEUDO = 1 << 20, 1 << 10, 0.5
BROADCAST = 2_000_000  # labels of 12 bytes each that every executor may hold
_KIND = np.zeros(256, np.uint8)  # 1 letter, 2 capital, 3 digit, 4 symbol, 5 space, 6 line end, 7 other bytes
_KIND[33:127], _KIND[128:] = 4, 7
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[9, 11, 12, 13, 32]], _KIND[10] = 1, 2, 3, 5, 6
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
STATS = 11
CELLS = 2 * (TABLE + META + 2 * STATS + 1)
#: Observations by which weights of hashed entries and of statistics are drawn to where they start.
PRIOR = (0.3, 1.0)


def text_view(text: pa.Array):
    """(row of each word, its hashed id, statistics by row, words by row) of a column of texts."""
    roll = Rolling(29)
    data, offsets = byte_column(text)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    kind, n = _KIND[data], len(offsets) - 1
    inside = np.isin(kind, (1, 2, 3, 4, 7))
    start = np.zeros(len(data) + 1, bool)
    start[offsets] = True
    first = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | start[:-1])) if len(data) else np.zeros(0, np.int64)
    last = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | start[1:])) + 1 if len(data) else first
    sums = roll.over(_LOWER[data])
    word = (roll.of(sums, first, last) >> U64(40)).astype(np.int64) % TABLE
    row = np.searchsorted(offsets, first, "right") - 1
    size = np.maximum(np.diff(offsets), 1)
    count = np.bincount(row, minlength=n)
    rows = np.repeat(np.arange(n), np.diff(offsets))
    share = [np.bincount(rows[kind == k], minlength=n) / size for k in (2, 3, 4, 5, 6, 7)]
    pairs = np.unique(row * TABLE + word) // TABLE
    distinct = np.bincount(pairs, minlength=n) / np.maximum(count, 1)
    length = np.bincount(row, last - first, n) / np.maximum(count, 1)
    stats = np.stack([*share, distinct, np.log1p(length), np.log1p(count), np.sqrt(share[2]), count == 0], 1)
    return row, word, stats, count


def meta_view(source: pa.Array, lang: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """Hashed ids of a row's metadata features, a fixed number for each row."""
    import zlib

    s, g = (pc.fill_null(c.cast(pa.string()), "\0").to_pylist() for c in (source, lang))
    size = [int(np.log2(max(x, 0) + 1) * 2) if x is not None else -1 for x in n_chars.to_pylist()]
    feature = lambda *x: zlib.crc32("\1".join(map(str, x)).encode("utf-8", "replace")) % META
    return np.array([[feature("s", a), feature("l", b), feature("n", c), feature("sl", a, b), feature("ln", b, c)] for a, b, c in zip(s, g, size, strict=True)], np.int64).reshape(-1, 5)


FEATURES = "doc_id long, words binary, times binary, stats binary, meta binary"
NAMES = [c.split()[0] for c in FEATURES.split(", ")]


def _features(batches):
    """A row's distinct word ids, their counts, statistics and metadata ids: all that any later step reads."""
    for batch in batches:
        _, offsets = byte_column(batch.column(1))
        for lo, hi in row_blocks(offsets, BLOCK_BYTES):
            part = batch.slice(lo, hi - lo)
            row, word, stats, _ = text_view(part.column(1))
            pairs, times = np.unique(row * TABLE + word, return_counts=True)
            cuts = np.searchsorted(pairs, np.arange(len(stats) + 1) * TABLE)
            ids = meta_view(*(part.column(k) for k in (2, 3, 4)))
            each = lambda x, t: pa.array([x[i:j].astype(t).tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())  # noqa: B023, E731
            made = [each(pairs % TABLE, "<u2"), each(times, "<i4"), *(pa.array([r.astype(t).tobytes() for r in x], pa.binary()) for x, t in ((stats, "<f4"), (ids, "<u2")))]
            yield pa.RecordBatch.from_arrays([part.column(0), *made], names=NAMES)


def _opened(batch: pa.RecordBatch):
    """(row of each distinct word, id, count; statistics; metadata ids) of feature rows."""
    whole = lambda name, t: np.frombuffer(b"".join(x.as_buffer() for x in batch.column(name)), t)
    n = pc.binary_length(batch.column("words")).to_numpy() // 2
    return np.repeat(np.arange(batch.num_rows), n), whole("words", "<u2").astype(np.int64), whole("times", "<i4").astype(np.float64), whole("stats", "<f4").reshape(-1, STATS).astype(np.float64), whole("meta", "<u2").reshape(-1, 5).astype(np.int64)


def score_of(weights: tuple[np.ndarray, np.ndarray], row, word, share, dense) -> np.ndarray:
    """Log odds by weights of hashed entries (row, id, weight) and of dense columns."""
    return dense @ weights[1] + np.bincount(row, weights[0][word] * share, len(dense))


def fitted(start: tuple[np.ndarray, np.ndarray], row, word, share, dense, y, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Weights refined by full-batch Adam, drawn to where they start by as much as PRIOR observations draw them away."""
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3)) / len(y)
    now = [x.copy() for x in start]
    state = [np.zeros_like(x) for x in (now[0], now[0], now[1], now[1])]
    for k in range(1, steps + 1):
        g = weight * (1 / (1 + np.exp(-np.clip(score_of(now, row, word, share, dense), -30, 30))) - y)
        grads = np.bincount(word, g[row] * share, len(now[0])), dense.T @ g
        for i, (w, first, grad) in enumerate(zip(now, start, grads, strict=True)):
            grad = grad + PRIOR[i] / len(y) * (w - first)
            m, v = state[2 * i], state[2 * i + 1]
            m += 0.1 * (grad - m)
            v += 0.02 * (grad * grad - v)
            w -= (0.3, 0.1)[i] * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.98**k)) + 1e-9)
    return tuple(now)


def _entries(opened, mean, spread):
    """Both views of feature rows, each as Logistic takes it."""
    row, word, times, stats, meta = opened
    total = np.maximum(np.bincount(row, times, len(stats)), 1)
    one = np.ones((len(stats), 1))
    return (row, word, times / total[row], np.concatenate([(stats - mean) / spread, one], 1)), (np.repeat(np.arange(len(meta)), 5), meta.ravel(), np.full(meta.size, 0.2), one)


def views(sums: np.ndarray, sample, y: np.ndarray) -> dict:
    """Both views' weights from sums (by class: words, metadata features, statistics, their squares, rows) and the
    labelled sample.  The sums say where the weights start and are drawn to, so what a view was told by the other holds
    where labels are few and gives way where they are many."""
    bad, good = sums.reshape(2, -1)
    cut = np.cumsum([TABLE, META, STATS, STATS])
    mean, spread = sample[3].mean(0), sample[3].std(0) + 1e-6
    centre, rows = [(x[cut[1] : cut[2]] / max(x[-1], 1) - mean) / spread for x in (bad, good)], (bad[-1], good[-1])
    inner = [np.maximum(x[cut[2] : cut[3]] / max(x[-1], 1) - (x[cut[1] : cut[2]] / max(x[-1], 1)) ** 2, 0) / spread**2 for x in (bad, good)]
    apart = (centre[1] - centre[0]) / (0.1 + sum(v * n for v, n in zip(inner, rows, strict=True)) / max(sum(rows), 1))
    weights = []
    for entries, part in zip(_entries(sample, mean, spread), (slice(0, TABLE), slice(TABLE, TABLE + META)), strict=True):
        rate = [np.log(x[part] + 0.5) - np.log(x[part].sum() + 0.5 * len(x[part])) for x in (bad, good)]
        hashed, dense = rate[1] - rate[0], np.zeros(entries[3].shape[1])
        parts = [score_of((hashed, dense), *entries)]
        if len(dense) > 1:
            parts.append(entries[3][:, :-1] @ apart)
        scale = _line(np.stack(parts, 1), y)
        dense[-1] = scale[-1]
        if len(dense) > 1:
            dense[:-1] = apart * max(scale[1], 0)
        weights.append(fitted((hashed * max(scale[0], 0), dense), *entries, y))
    return {"weights": weights, "mean": mean, "spread": spread}


def view_scores(model: dict, opened) -> np.ndarray:
    """(row, view): log odds by the text and by the metadata."""
    return np.stack([score_of(w, *e) for w, e in zip(model["weights"], _entries(opened, model["mean"], model["spread"]), strict=True)], 1)


def better_than_chance(score: np.ndarray, y: np.ndarray) -> bool:
    """Whether a score ranks the good before the bad by more than two standard errors of what chance does."""
    n = int(y.sum()), int(len(y) - y.sum())
    if not min(n):
        return False
    order = np.argsort(score, kind="stable")
    place = np.empty(len(y))
    _, at, size = np.unique(score[order], return_index=True, return_counts=True)
    place[order] = np.repeat(at + (size + 1) / 2, size)  # equal scores share their mean place
    area = (place[y == 1].sum() - n[0] * (n[0] + 1) / 2) / (n[0] * n[1])
    return area > 0.5 + 2 * np.sqrt((n[0] + n[1] + 1) / (12 * n[0] * n[1]))


def _summed(shared):
    """Sums over labelled rows and, where there are models, over what each view names for the other."""

    def rows(batches):
        model, cuts = shared.value
        sums = np.zeros((2, CELLS // 2))
        for batch in batches:
            if not batch.num_rows:
                continue
            opened = _opened(batch)
            row, word, times, stats, meta = opened
            label, held = batch.column("quality").to_numpy(), batch.column("held").to_numpy(zero_copy_only=False)
            score = view_scores(model, opened) if model else None
            for c in (0, 1):
                own = ((label == c) & ~held).astype(float)
                text, other = own, own
                if model:  # the metadata view names rows for the text view and the other way round
                    named = [(label < 0) & ((s >= hi) & (s > lo) if c else (s <= lo) & (s < hi)) for s, (lo, hi) in zip(score.T, cuts, strict=True)]
                    text, other = own + PSEUDO * named[1], own + PSEUDO * named[0]
                sums[c, :TABLE] += np.bincount(word, times * text[row] / np.maximum(np.bincount(row, times, len(stats)), 40)[row], TABLE)
                sums[c, TABLE : TABLE + META] += np.bincount(meta.ravel(), np.repeat(other, 5), META)
                sums[c, TABLE + META :] += np.concatenate([text @ stats, text @ stats**2, [text.sum()]])
        flat = sums.ravel()
        on = [k for k in range(0, CELLS, CHUNK) if flat[k : k + CHUNK].any()]
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(on, pa.int64()), "part": pa.array([flat[k : k + CHUNK].tobytes() for k in on], pa.binary())})

    return rows


def _add(t: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x.as_buffer(), np.float64) for x in t.column("part")], axis=0)
    return pa.table({"chunk": t.column("chunk").slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})


def _scored(shared):
    def rows(batches):
        for batch in batches:
            s = view_scores(shared.value, _opened(batch)) if batch.num_rows else np.zeros((0, 2))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "quality", "held")] + [pa.array(s[:, 0]), pa.array(s[:, 1])], names=["doc_id", "quality", "held", "s_text", "s_meta"])

    return rows


SCORED = "doc_id long, quality int, held boolean, s_text double, s_meta double"


def _line(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and offset of a small logistic model, by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + 1e-2 * np.eye(len(w)), x.T @ (p - y) + 1e-2 * w)
    return w


def quality(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, threshold: float = 0.5) -> DataFrame:
    """doc_id, p_text, p_meta, score, keep of every row of docs (doc_id, text, lang, source, n_chars).

    score is the combined probability of quality 1 and keep says whether it reaches threshold.  Nulls count as
    values of their own, a null text as empty; of repeated labels the lowest counts; rows may repeat, and each
    counts in the sums.  Without labels of both classes, in the part that is fitted and in the quarter held back for
    calibration, every score is the labels' mean, or 0.5.  An empty docs gives no rows.
    """
    spark = docs.sparkSession
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars")]
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    known = keep(known)
    small = known.count() <= BROADCAST  # beyond it the features are shuffled to their labels
    given = docs.select(*columns).mapInArrow(_features, FEATURES).join(F.broadcast(known) if small else known, "doc_id", "left")
    order = F.xxhash64("doc_id", F.lit(7))
    rows = keep(given.withColumn("quality", F.coalesce("quality", F.lit(-1))).withColumn("held", F.pmod(order, F.lit(4)) == 0))
    count = {(r["quality"], r["held"]): r["n"] for r in rows.where("quality >= 0").groupBy("quality", "held").agg(F.count("*").alias("n")).collect()}
    if len(count) < 4:
        rate = sum(n for (q, _), n in count.items() if q) / sum(count.values()) if count else 0.5
        plain = [F.lit(float(rate)).alias(c) for c in ("p_text", "p_meta", "score")]
        return rows.select("doc_id", *plain).withColumn("keep", F.col("score") >= threshold)
    rate = count[1, False] / (count[0, False] + count[1, False])

    def sums(model, cuts) -> np.ndarray:
        out = np.zeros(-(-CELLS // CHUNK) * CHUNK)
        shared = spark.sparkContext.broadcast((model, cuts))
        for r in rows.mapInArrow(_summed(shared), "chunk long, part binary").groupBy("chunk").applyInArrow(_add, "chunk long, part binary").collect():
            x = np.frombuffer(r["part"], np.float64)
            out[r["chunk"] : r["chunk"] + len(x)] = x
        return out[:CELLS]

    def scored(model) -> DataFrame:
        return rows.mapInArrow(_scored(spark.sparkContext.broadcast(model)), SCORED)

    def collected(which: str, most: int):
        some = rows.where(f"quality >= 0 and {which}").orderBy(order, "doc_id", "words").limit(most).toArrow().combine_chunks().to_batches()[0]
        return _opened(some), some.column("quality").to_numpy()

    (sample, y), (held, y_held) = collected("not held", LABELLED), collected("held", CALIBRATION)
    model = views(sums(None, None), sample, y)
    for turn in range(rounds):
        share = (turn + 1) / (SHARE * rounds)
        at = [share * (1 - rate), 1 - share * rate]
        cut = scored(model).where("quality < 0").agg(*(F.percentile_approx(c, at, 10_000).alias(c) for c in ("s_text", "s_meta"))).first()
        if cut["s_text"] is None:  # no unlabelled row
            break
        known = view_scores(model, held)
        names = [tuple(cut[c]) if better_than_chance(s, y_held) else (-np.inf, np.inf) for c, s in zip(("s_text", "s_meta"), known.T, strict=True)]
        model = views(sums(model, names), sample, y)
    final = keep(scored(model))
    sample = final.where("quality >= 0 and held").orderBy(order, "doc_id").limit(CALIBRATION).select("quality", "s_text", "s_meta").toPandas()
    y, s = sample.quality.to_numpy(), sample[["s_text", "s_meta"]].to_numpy()
    lines = [_line(s[:, [k]], y) for k in range(2)]
    both = _line(np.stack([s[:, k] * c[0] + c[1] for k, c in enumerate(lines)], 1), y)
    chance = lambda x: 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))
    logit = [F.col(c) * float(w[0]) + float(w[1]) for c, w in zip(("s_text", "s_meta"), lines, strict=True)]
    mixed = logit[0] * float(both[0]) + logit[1] * float(both[1]) + float(both[2])
    out = final.select("doc_id", chance(logit[0]).alias("p_text"), chance(logit[1]).alias("p_meta"), chance(mixed).alias("score"))
    return out.withColumn("keep", F.col("score") >= threshold)


def op6_cotraining_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, p_text, p_meta, score, keep of every document."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


__all__ = ["views", "view_scores", "quality", "op6_cotraining_quality"]
