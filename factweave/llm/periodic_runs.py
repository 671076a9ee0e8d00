"""Maximal periodic runs of words: longest common extensions by a difference cover, over a harmonic grid.

A task works through blocks of whole texts.  For every period p the grid of each p-th word is compared with the words
p later; a run of two periods or more holds such a pair of equal words, so all others are passed over.  At an equal pair
the extension to the right and to the left says how far the period holds.  An extension compares fewer than V words
until both places are in the cover, whose places have every difference modulo V; there it is the least of the common
prefixes between the two in the sorted order of the sampled suffixes, by a sparse table.  Only sampled suffixes are
sorted: by their first V words, then by doubling, each time only where they are still equal, and suffixes of one text
among themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import byte_column, lean, row_blocks

BLOCK_BYTES = 4 << 20
CHUNK = 1 << 20  # pairs that are extended at once
#: A perfect difference set, whose pairs have every difference modulo V once.
V, COVER = 73, (0, 1, 3, 7, 15, 31, 36, 54, 63)
_M = len(COVER)
_SPOT = np.full(V, -1)
_SPOT[list(COVER)] = np.arange(_M)
#: By two places modulo V: the fewest words after which both are in the cover.
_SHIFT = np.array([[next(t for t in range(V) if _SPOT[(a + t) % V] >= 0 and _SPOT[(b + t) % V] >= 0) for b in range(V)] for a in range(V)], np.int64)


class Extensions:
    """Longest common extensions to the right between places of one text; word: codes, end: where each place's text ends."""

    def __init__(self, word: np.ndarray, end: np.ndarray):
        self.word, self.end, self.lcp = word, end, None

    def _sort(self) -> None:
        """Ranks of the sampled suffixes and a sparse table over the common prefixes of neighbours."""
        word, end, n = self.word, self.end, len(self.word)
        place = (np.arange(-(-n // V))[:, None] * V + np.array(COVER)).ravel()
        count = int(np.searchsorted(place, n))
        place = place[:count]
        stop = end[place]
        rank = np.searchsorted(stop, stop)  # suffixes of one text are one group, whose rank is its first place in the order
        order = np.arange(count)
        live = order
        padded = np.append(word + 1, 0)

        def refine(key: np.ndarray) -> np.ndarray:
            """Sort the live places of the order by (rank, key); what is live after it."""
            at = order[live]
            turn = np.lexsort((key, rank[at]))
            at, key = at[turn], key[turn]
            order[live] = at
            old = rank[at]
            new = np.append(True, (old[1:] != old[:-1]) | (key[1:] != key[:-1]))
            rank[at] = live[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            alone = new & np.append(new[1:], True)
            return live[~alone]

        live = live[np.isin(rank, rank[np.append(False, rank[1:] == rank[:-1])])] if count else live
        for t in range(0, V, 2):
            if not len(live):
                break
            at = order[live]
            read = lambda k: padded[np.where(place[at] + k < stop[at], place[at] + k, n)].astype(np.int64)  # noqa: E731, B023
            live = refine(read(t) << 32 | (read(t + 1) if t + 1 < V else 0))
        levels, k = [rank.copy()], 0
        while len(live):
            at = order[live]
            far = at + (_M << k)
            inside = place[at] + (V << k) < stop[at]
            live = refine(np.where(inside, levels[-1][np.where(inside, far, 0)] + 1, 0))
            levels.append(rank.copy())
            k += 1
        self.rank = rank
        a, b = order[:-1], order[1:]
        same = np.flatnonzero(stop[a] == stop[b])
        a, b, size = a[same].copy(), b[same].copy(), np.zeros(len(same), np.int64)
        limit = stop[a] - np.maximum(place[a], place[b])
        for k in range(len(levels) - 1, -1, -1):
            open_ = np.flatnonzero(size < limit)
            equal = open_[levels[k][a[open_]] == levels[k][b[open_]]]
            size[equal] += V << k
            go = equal[size[equal] < limit[equal]]
            a[go] += _M << k
            b[go] += _M << k
        rest = np.flatnonzero(size < limit)
        size[rest] += self._compare(place[a[rest]], place[b[rest]], np.minimum(limit[rest] - size[rest], V))
        lcp = np.zeros(max(count - 1, 0), np.int32)
        lcp[same] = size
        self.lcp = [lcp]
        while len(self.lcp[-1]) > 1 << (len(self.lcp) - 1):
            last, step = self.lcp[-1], 1 << (len(self.lcp) - 1)
            self.lcp.append(np.minimum(last[:-step], last[step:]))

    def _compare(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words at i and j are equal, up to most."""
        size, live = most.copy(), np.arange(len(i))
        for t in range(int(most.max()) if len(most) else 0):
            live = live[most[live] > t]
            if not len(live):
                break
            differ = self.word[i[live] + t] != self.word[j[live] + t]
            size[live[differ]] = t
            live = live[~differ]
        return size

    def between(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are equal, for i < j of one text."""
        limit = self.end[j] - j
        shift = _SHIFT[i % V, j % V]
        size = self._compare(i, j, np.minimum(shift, limit))
        far = np.flatnonzero((size == shift) & (shift < limit))
        if len(far):
            if self.lcp is None:
                self._sort()
            spot = lambda x: x // V * _M + _SPOT[x % V]
            p, q = self.rank[spot(i[far] + shift[far])], self.rank[spot(j[far] + shift[far])]
            p, q = np.minimum(p, q), np.maximum(p, q)
            level = np.frexp((q - p).astype(np.float64))[1] - 1
            for k in np.unique(level):
                x = np.flatnonzero(level == k)
                size[far[x]] += np.minimum(self.lcp[k][p[x]], self.lcp[k][q[x] - (1 << k)])
        return size


def _shortest(rows: np.ndarray, n: int) -> np.ndarray:
    """Of the rows of one stretch that of the smallest period."""
    stretch = rows[:, 0] * (n + 1) + rows[:, 1]
    order = np.lexsort((rows[:, 2], stretch))
    stretch = stretch[order]
    return rows[order[np.append(True, stretch[1:] != stretch[:-1])[: len(rows)]]]


def periodic(word: np.ndarray, bounds: np.ndarray, least: int) -> np.ndarray:
    """Rows (start, end, period) of all runs of least words and two periods or more, in the order of the words; texts
    lie side by side at bounds."""
    n, length = int(bounds[-1]), np.diff(bounds)
    order = np.argsort(-length, kind="stable")  # longest first, so that a period's grid ends where texts become too short
    size = length[order]
    ends = np.cumsum(size)
    put = np.repeat(bounds[:-1][order] - (ends - size), size)  # what takes a place here back to the text's own
    word = word[put + np.arange(n)]
    end, begin = np.repeat(ends, size), np.repeat(ends - size, size)
    right, left = Extensions(word, end), Extensions(word[::-1].copy(), n - begin[::-1])
    found: list[np.ndarray] = []

    def extend(pairs: list) -> None:
        period = np.repeat([p for p, _ in pairs], [len(x) for _, x in pairs]).astype(np.int64)
        i = np.concatenate([x for _, x in pairs]) * period
        ok = end[i] == end[i + period]
        i, period = i[ok], period[ok]
        ahead = right.between(i, i + period)
        back = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > begin[i])
        back[inner] = left.between(n - i[inner] - period[inner], n - i[inner])
        ok = (ahead + back >= period) & (ahead + back + period >= least)
        rows = np.stack([i - back, i + period + ahead, period], 1)[ok]
        found.append(_shortest(rows, n))

    pairs, held = [], 0
    for p in range(1, int(size[0]) // 2 + 1 if len(size) else 0):
        m = int(ends[np.searchsorted(-size, -2 * p, "right") - 1])
        hit = np.flatnonzero(word[: m - p : p] == word[p:m:p])
        if len(hit):
            pairs.append((p, hit))
            held += len(hit)
            if held >= CHUNK:
                extend(pairs)
                pairs, held = [], 0
    if pairs:
        extend(pairs)
    rows = _shortest(np.concatenate([np.zeros((0, 3), np.int64), *found]), n)
    rows[:, :2] += put[rows[:, 0]][:, None]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _rows(least: int):
    def rows(batches):
        for batch in batches:
            _, offsets = byte_column(batch.column(1))
            for lo, hi in row_blocks(offsets, BLOCK_BYTES):
                split = pc.ascii_split_whitespace(pc.fill_null(batch.column(1).slice(lo, hi - lo).cast(pa.large_string()), ""))
                flat, cut = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
                real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # gaps at a text's ends leave empty words
                bounds = np.concatenate([[0], np.cumsum(real)])[cut]
                coded = flat.filter(pa.array(real)).dictionary_encode()
                word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                runs = periodic(word, bounds, least)
                n = np.diff(bounds)
                text = np.searchsorted(bounds, runs[:, 0], "right") - 1
                depth = np.zeros(len(word) + 1, np.int64)
                np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
                np.add.at(depth, runs[:, 1], -1)
                kept = np.cumsum(depth[:-1]) == 0
                left = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)])[bounds]), coded.dictionary.take(pa.array(word[kept])))
                fields = [runs[:, 0] - bounds[text], runs[:, 1] - runs[:, 0], runs[:, 2]]
                of = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in fields], ["start", "length", "period"])
                listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(hi - lo + 1)), pa.int32()), of)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), listed, pc.binary_join(left, pa.scalar(" ", pa.large_string())).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return rows


def word_runs(df: DataFrame, id: str = "doc_id", text: str = "text", least: int = 12) -> DataFrame:
    """doc_id, n_words, runs, collapsed of every row.

    runs: start (word number from 0), length and period of each stretch of words with that smallest period which no
    neighbouring word continues, of least words and two periods or more, by start, then period.  collapsed: the words
    joined by one space, without those that a run holds after its first period.  Words are what stands between ASCII
    white space; a null text has none.  Rows are judged one by one, so repeated rows and ids and null ids stay, further
    columns of df are not looked at, and an empty df gives no rows.
    """
    rows = df.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lean(_rows(least)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, runs {RUN}, collapsed string")


WORD = "[^\\x20\\x09-\\x0D]+"


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text of documents, a tenth of them, by a hash of the id, made periodic from some word on; null ids stay."""
    docs = docs.select("doc_id", "text").withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    docs = docs.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    docs = docs.withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    docs = docs.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    tail, room = F.slice("words", F.col("a") + 1, F.col("p")), F.col("n") - F.col("a")
    again = F.slice(F.flatten(F.array_repeat(tail, F.ceil(room / F.col("p")).cast("int"))), F.lit(1), room)
    whole = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), again), " ")
    return docs.select("doc_id", F.when(F.col("n") > 0, whole).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Every document's runs of repeated words: their number, the longest, digests of all and of the text without them."""
    rows = word_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    rows = rows.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
    return rows.withColumn("exponent_milli", F.expr("1000 * length div period"))


#: Equal words of one text that stand q apart, as islands: an island of q places or more is a stretch of period q.
ORACLE = """
WITH hashed AS (
  SELECT doc_id, text, xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda crc, c: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, c)), 4294967295), 4294967295) AS h
  FROM documents),
split AS (SELECT doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM hashed),
placed AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) END AS a FROM split),
words AS MATERIALIZED (
  SELECT doc_id, i, CASE WHEN a IS NULL OR i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM placed)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM words AS x JOIN words AS y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i),
islands AS (SELECT doc_id, q, min(i) AS s, count(*) AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS o FROM pairs) GROUP BY doc_id, q, o),
runs AS MATERIALIZED (SELECT doc_id, s, m + q AS length, min(q) AS q FROM islands WHERE m >= q AND m + q >= 12 GROUP BY doc_id, s, m + q),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
best AS (SELECT doc_id, count(*) AS n_runs, max({'length': length, 's': -s, 'q': -q}) AS b, string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, -b.s AS start, b.length AS length, -b.q AS period, 1000 * b.length // -b.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM documents AS d LEFT JOIN best ON d.doc_id = best.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

__all__ = ["word_runs", "planted", "op11_periodic_runs"]
