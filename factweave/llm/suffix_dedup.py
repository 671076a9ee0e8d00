"""Removal of long byte strings that repeat anywhere in a corpus, by merging Burrows-Wheeler transforms.

Every text is cut into phrases at content-defined anchors (the smallest hash in a sliding window), which are
the same wherever the same bytes stand.  A shard is about 16 MB of whole texts; it sorts the suffixes of its
phrase sequence once and keeps the transform (the phrase before each suffix), the backward step and the text.
The shards' transforms are then merged by refining their interleave round by round: a round steps every
interval of equal suffixes one phrase backwards within its shard, and a window over the new common prefix adds
up the shards' shares.  A prefix that all shards together hold once is settled and leaves; the others are the
repeated intervals, their common prefix is known in bytes, and no suffix is sorted again.  Intervals whose
common prefix reaches what any repeated string must share give the anchors whose windows can repeat.  An exact
step follows on these alone: ranges of window starts are compared by the hash of what all of the range's windows
share (a core) and of what they span (a full), in ranges of 64, 8 and 1, so that copies settle as whole ranges.

Shards exchange packed arrays: a shard adds up what it holds of a prefix or range before it sends it, so a
reducer sees as many entries of one as there are shards, however often it occurs.  Nothing passes through the
driver but whether a round left anything, and a shard's memory is bounded by its bytes (one longer text is a
shard alone).
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import M1, U64, Rolling, byte_column, free, keep, keep_bucketed, lean, lean_group, mix, parts_for, row_blocks

GRAM, SLIDE, GRID = 16, 128, (64, 8, 1)
SHARD_BYTES = 16 << 20
BLOCK_BYTES = 1 << 20
#: The pipeline's repeats: 51 words are seldom shorter (of windows of 51 words of sf0.1 with 25 different ones, 1 % of the
#: English and fewer of the others).
PASSAGE, PASSAGE_SLIDE = 256, 96


def _anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, slide: int, roll: Rolling):
    """Anchors of the texts data[starts:ends]: position, first and last window offset (first > last: no window),
    phrase hash and length (0: the text's last anchor), the text's index; and the prefix sums."""
    sums = roll.over(data)
    at = np.arange(len(data) - GRAM + 1) if len(data) >= GRAM else np.zeros(0, np.int64)
    value = (roll.of(sums, at, at + GRAM) >> U64(32) << U64(32)) | (U64(0xFFFFFFFF) - at.astype(U64))
    step = 1
    while step < slide:  # the minimum over slide grams, by doubling
        shift = min(step, slide - step)
        value = np.minimum(value[:-shift], value[shift:]) if len(value) > shift else value[:0]
        step += shift
    span = slide + GRAM - 1
    doc = np.repeat(np.arange(len(starts)), np.maximum(ends - starts - span + 1, 0))
    first = np.cumsum(np.concatenate([[0], np.maximum(ends - starts - span + 1, 0)]))[:-1]
    p = np.arange(len(doc)) - first[doc] + starts[doc]
    a = (U64(0xFFFFFFFF) - (value[p] & U64(0xFFFFFFFF))).astype(np.int64)
    edge = np.flatnonzero(np.diff(a, prepend=-1) | np.diff(doc, prepend=-1))
    last = np.concatenate([edge[1:], [len(a)]]) - 1 if len(a) else edge
    b, d = a[edge], doc[edge]
    low, high = b - np.minimum(p[last], ends[d] - window), b - p[edge]
    more = np.concatenate([d[1:] == d[:-1], [False]]) if len(d) else np.zeros(0, bool)
    length = np.where(more, np.concatenate([b[1:], [0]]) - b, 0) if len(b) else b
    sym = np.where(length > 0, roll.of(sums, b, b + length) | U64(1), U64(0))
    return b, low, high, sym, length, d, sums


def _ranges(b, low, high, grid, window, sums, roll):
    """Ranges of window offsets within cells of a grid: anchor index, low, high, core and full hashes."""
    own = np.flatnonzero(low <= high)
    n = high[own] // grid - low[own] // grid + 1
    i = np.repeat(own, n)
    j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + low[i] // grid
    lo, hi = np.maximum(low[i], j * grid), np.minimum(high[i], j * grid + grid - 1)
    core = roll.of(sums, b[i] - grid * j, b[i] - grid * j - grid + 1 + window)
    full = mix(roll.of(sums, b[i] - hi, b[i] - lo + window) + (lo * 1024 + hi).astype(U64) * M1)
    return i, lo, hi, core.view(np.int64), full.view(np.int64)


def _suffixes(sym: np.ndarray) -> np.ndarray:
    """The suffix array of a phrase sequence; each 0 ends a text and differs from every other."""
    ends = np.flatnonzero(sym == 0)
    rank = np.unique(sym, return_inverse=True)[1].astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    n, k = len(sym), 1
    order = np.argsort(rank, kind="stable")
    while True:
        key = rank * (n + len(ends) + 2)
        key[:-k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        k *= 2
        if new[-1] == n - 1 or k >= n:
            return order


SHARD = "shard long, meta binary, text binary, bounds binary, bwt binary, before binary, step binary, sa binary, ranges binary"
SENT, HELD = "shard long, part int, pack binary", "shard long, kind int, pack binary"
LIVE = ("<i8", "<i4", "<i4", "<u2", "u1", "u1")  # prefix, first row, rows, bytes, bytes without the last phrase, front
ASK = ("<i8", "<i8", "<i4", "<i4", "u1")  # core, full, members here, their number here, whether undecided
MEMBER = ("<i4", "u1", "u1", "<i4", "u1")  # anchor, low, high, number here, whether undecided and twice the index of the window
ANSWER = ("<i4", "u1")  # number, 1: repeats, 2: look closer, 4: undecided


def _pack(kinds, columns) -> bytes:
    return b"".join(np.ascontiguousarray(c, k).tobytes() for c, k in zip(columns, kinds, strict=True))


def _unpack(kinds, raws) -> list[np.ndarray]:
    """The columns of packs, one pack after the other."""
    size, parts = sum(np.dtype(k).itemsize for k in kinds), [[] for _ in kinds]
    for raw in raws:
        raw = raw.as_buffer()
        n, at = len(raw) // size, 0
        for k, out in zip(kinds, parts, strict=True):
            out.append(np.frombuffer(raw, k, n, at))
            at += n * np.dtype(k).itemsize
    return [np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(parts, kinds, strict=True)]


def _dealt(shard: int, key: np.ndarray, parts: int, kinds, columns) -> list[tuple]:
    """(shard, part, pack) rows of the columns, dealt by key."""
    to = (mix(key.view(U64)) % U64(parts)).astype(np.int64)
    order = np.lexsort((key, to))
    cuts = np.searchsorted(to[order], np.arange(parts + 1))
    return [(shard, p, _pack(kinds, [c[order[cuts[p] : cuts[p + 1]]] for c in columns])) for p in range(parts) if cuts[p] < cuts[p + 1]]


def _rows(ddl: str, rows: list[tuple]) -> pa.Table:
    schema = _arrow(ddl)
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _back(shard: np.ndarray, kinds, columns, kind: int) -> pa.Table:
    """(shard, kind, pack) rows of the columns, by shard."""
    order = np.argsort(shard, kind="stable")
    cut = np.flatnonzero(np.diff(shard[order], prepend=-1))
    stop = np.append(cut[1:], len(order))[: len(cut)]
    return _rows(HELD, [(int(shard[order[i]]), kind, _pack(kinds, [c[order[i:j]] for c in columns])) for i, j in zip(cut, stop, strict=True)])


def _senders(table: pa.Table, kinds) -> np.ndarray:
    size = sum(np.dtype(k).itemsize for k in kinds)
    return np.repeat(table.column("shard").to_numpy(), [len(x.as_buffer()) // size for x in table.column("pack")])


def _build(window: int, slide: int, names: list[str], shard_bytes: int):
    def shards(batches):
        from pyspark import TaskContext

        part, made, rows, size = TaskContext.get().partitionId(), 0, [], 0
        roll = Rolling(11)

        def one(table: pa.Table) -> pa.RecordBatch:
            data, offsets = byte_column(table.column(0))
            base = offsets[0]
            data, offsets = data[base : offsets[-1]], offsets - base
            seqs, positions = [], []
            for lo, hi in row_blocks(offsets, BLOCK_BYTES):
                at = offsets[lo]
                long = np.flatnonzero(np.diff(offsets[lo : hi + 1]) >= window) + lo
                b, low, high, sym, length, _, _ = _anchors(data[at : offsets[hi]], offsets[long] - at, offsets[long + 1] - at, window, slide, roll)
                empty = low > high
                seqs.append((sym, length, np.where(empty, 1, low), np.where(empty, 0, high)))
                positions.append(b + at)
            sym, length, low, high = (np.concatenate([s[k] for s in seqs]) for k in range(4))
            pos = np.concatenate(positions)
            n = len(sym)
            sa = _suffixes(sym) if n else np.zeros(0, np.int64)
            inverse = np.empty(n, np.int64)
            inverse[sa] = np.arange(n)
            prev = sa - 1  # the first suffix wraps to the last phrase, which is a text's end
            meta = table.drop_columns(table.column_names[:1])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, meta.schema) as out:
                out.write_table(meta)
            row = {
                "shard": (part << 20) + made, "meta": sink.getvalue().to_pybytes(), "text": _squeeze(data), "bounds": offsets.astype("<i8").tobytes(),
                "bwt": sym[prev].tobytes(), "before": length[prev].astype("u1").tobytes(), "step": inverse[prev].astype("<i4").tobytes(),
                "sa": sa.astype("<i4").tobytes(), "ranges": pos.astype("<i4").tobytes() + low.astype("u1").tobytes() + high.astype("u1").tobytes(),
            }
            return pa.RecordBatch.from_pylist([row], schema=_arrow(SHARD))

        for batch in batches:
            data, offsets = byte_column(batch.column(0))
            for lo, hi in row_blocks(offsets, shard_bytes):
                if rows and size + offsets[hi] - offsets[lo] > shard_bytes:
                    yield one(pa.Table.from_batches(rows))
                    made, rows, size = made + 1, [], 0
                rows.append(batch.slice(lo, hi - lo))
                size += int(offsets[hi] - offsets[lo])
        if rows:
            yield one(pa.Table.from_batches(rows))

    return shards


def _squeeze(data: np.ndarray) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data.tobytes(), "zstd", asbytes=True)


def _text(left: pa.Table) -> np.ndarray:
    raw = left.column("text")[0].as_buffer() if left.num_rows else None
    if raw is None:
        return np.zeros(0, np.uint8)
    return np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8].to_pybytes(), "little"), "zstd"), np.uint8)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))])


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    """A binary cell of a one-row table as an array."""
    return np.frombuffer(table.column(name)[0].as_buffer(), kind) if table.num_rows else np.zeros(0, kind)


def _spread(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each run's lo, lo + 1, ..., the run of each)."""
    owner = np.repeat(np.arange(len(lo)), n)
    return np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + lo[owner], owner


def _first(parts: int):
    """Every shard's intervals of one phrase."""

    def rows(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                left = pa.Table.from_batches([batch.slice(k, 1)])
                bwt, before, back = _column(left, "bwt", U64), _column(left, "before", "u1"), _column(left, "step", "<i4")
                first, length = np.empty(len(bwt), U64), np.empty(len(bwt), np.int64)
                first[back], length[back] = bwt, before  # a suffix begins with the phrase before its step
                lo = np.flatnonzero(np.diff(first.view(np.int64), prepend=~first.view(np.int64)[:1]))
                n = np.diff(np.append(lo, len(first)))
                lo, n = lo[first[lo] != 0], n[first[lo] != 0]
                block = mix(first[lo]).view(np.int64)
                made = _dealt(left.column("shard")[0].as_py(), block, parts, LIVE, (block, lo, n, length[lo], np.zeros(len(lo)), np.ones(len(lo))))
                yield from _rows(SENT, made).to_batches()

    return rows


def _merge(table: pa.Table) -> pa.Table:
    """The intervals whose prefix all shards together hold more than once."""
    columns = _unpack(LIVE, table.column("pack"))
    shard = _senders(table, LIVE)
    order = np.argsort(columns[0], kind="stable")
    cut = np.flatnonzero(np.diff(columns[0][order], prepend=~columns[0][order][:1]))
    total = np.add.reduceat(columns[2][order].astype(np.int64), cut)
    on = order[np.repeat(total > 1, np.diff(np.append(cut, len(order))))]
    return _back(shard[on], LIVE, [c[on] for c in columns], 0)


def _extend(need: int, steps: int, parts: int):
    """Steps intervals of equal suffixes backwards by 1 to steps phrases; the last step's are the new front."""

    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        bwt, before, back = _column(left, "bwt", U64), _column(left, "before", "u1"), _column(left, "step", "<i4")
        block, lo, n, length, rest, front = _unpack(LIVE, right.column("pack"))
        on = (front == 1) & (rest < need - 1)
        block, lo, n, length, rest = block[on], lo[on].astype(np.int64), n[on].astype(np.int64), length[on].astype(np.int64), rest[on].astype(np.int64)
        out = []
        for k in range(steps):
            row, owner = _spread(lo, n)
            ok = (bwt[row] != 0) & (before[row] + rest[owner] < need)
            row, owner = row[ok], owner[ok]
            if not len(row):
                break
            order = np.argsort(back[row])
            row, owner = row[order], owner[order]
            to, sym = back[row].astype(np.int64), bwt[row]
            cut = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (sym[1:] != sym[:-1])]))
            own, add = owner[cut], before[row[cut]].astype(np.int64)
            block = mix(sym[cut] + M1 * mix(block[own].view(U64))).view(np.int64)
            lo, n, length, rest = to[cut], np.diff(np.append(cut, len(to))), length[own] + add, rest[own] + add
            out.append((block, lo, n, length, rest, np.full(len(cut), k == steps - 1)))
        if not out:
            return _rows(SENT, [])
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return _rows(SENT, _dealt(right.column("shard")[0].as_py(), columns[0], parts, LIVE, columns))

    return step


def _asked(shard: int, anchor, low, high, which, core, full, need, parts: int) -> pa.Table:
    """Members by number, and what the shard holds of each range, dealt by core."""
    if not len(anchor):
        return _rows(SENT, [])
    order = np.lexsort((full, core))
    new = np.concatenate([[True], (np.diff(core[order]) != 0) | (np.diff(full[order]) != 0)])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    one = order[new]
    n = np.bincount(number)
    open_ = np.zeros(len(one), np.uint8)
    np.maximum.at(open_, number, need.astype(np.uint8))
    rows = [(shard, -1, _pack(MEMBER, (anchor, low, high, number, need + 2 * which)))]
    return _rows(SENT, rows + _dealt(shard, core[one], parts, ASK, (core[one], full[one], n, np.arange(len(one)), open_)))


def _judge(last: bool):
    def answer(table: pa.Table) -> pa.Table:
        core, full, n, number, need = _unpack(ASK, table.column("pack"))
        shard = _senders(table, ASK)
        order = np.lexsort((number, shard, full, core))
        core, full = core[order], full[order]
        new_core = np.concatenate([[True], np.diff(core) != 0])
        new = new_core | np.concatenate([[True], np.diff(full) != 0])
        cut = np.flatnonzero(new)
        total = np.add.reduceat(n[order].astype(np.int64), cut)
        undecided = (np.maximum.reduceat(need[order], cut) > 0) & (total == 1)
        status = np.repeat((total > 1).astype(np.uint8), np.diff(np.append(cut, len(order))))
        if not last:
            cores = np.cumsum(new_core[cut]) - 1
            look = ((np.bincount(cores) > 1) & (np.bincount(cores, undecided) > 0))[cores]
            status[cut[look]] |= 2  # the first of each range stands for it
            status[cut[look & undecided]] |= 4
        on = order[status > 0]
        return _back(shard[on], ANSWER, (number[on], status[status > 0]), 1)

    return answer


def _settled(right: pa.Table):
    """(members that repeat, members to look closer at and whether they are undecided) from members and answers; each with its window's index."""
    kind = right.column("kind").to_numpy()
    anchor, low, high, number, need = _unpack(MEMBER, [x for x, k in zip(right.column("pack"), kind, strict=True) if k == 0])
    which, need = need >> 1, need & 1
    asked, status = _unpack(ANSWER, [x for x, k in zip(right.column("pack"), kind, strict=True) if k == 1])
    by_number = np.zeros(int(number.max()) + 1 if len(number) else 0, np.uint8)
    by_number[asked] = status
    mine = by_number[number]
    done = (mine & 1 > 0) & (need > 0)
    look = np.flatnonzero(mine & 2)
    look = look[np.unique(number[look], return_index=True)[1]]
    return (anchor[done], low[done], high[done], which[done]), (anchor[look], low[look], high[look], which[look], mine[look] & 4 > 0)


def _grid(b, low, high, which, need, data, bounds, grid: int, windows: list[int], shard: int, parts: int) -> pa.Table:
    """Asks about the ranges of a grid over windows of the anchors b; b, low and high are as the cells above had them,
    which is each one's index in windows.  Ranges of different windows never meet: their hashes tell lengths apart."""
    roll, second, out = Rolling(11), Rolling(13), []
    order = np.argsort(b, kind="stable")
    b, low, high, which, need = b[order].astype(np.int64), low[order].astype(np.int64), high[order].astype(np.int64), which[order], need[order]
    for lo, hi in row_blocks(bounds, BLOCK_BYTES):
        x, y = np.searchsorted(b, [bounds[lo], bounds[hi]])
        if x == y:
            continue
        part = data[bounds[lo] : bounds[hi]]
        sums = roll.over(part)
        for k, window in enumerate(windows):
            own = np.flatnonzero(which[x:y] == k) + x
            if not len(own):
                continue
            at = b[own] - bounds[lo]
            i, c_lo, c_hi, core, full = _ranges(at, low[own], high[own], grid, window, sums, roll)
            if grid == 1:  # core and full are the same bytes: full from hashes of its own
                full = second.of(second.over(part), at[i] - c_lo, at[i] - c_lo + window).view(np.int64)
            out.append((b[own][i], c_lo, c_hi, np.full(len(i), k, np.uint8), core, full, need[own][i]))
    return _asked(shard, *(np.concatenate(c) for c in zip(*out, strict=True)), parts) if out else _rows(SENT, [])


def _live_cells(need: int, windows: list[int], parts: int):
    def cells(left: pa.Table, right: pa.Table) -> pa.Table:
        """Asks about the cells of the anchors in repeated intervals."""
        _, lo, n, length, _, _ = _unpack(LIVE, right.column("pack"))
        row, _ = _spread(lo[length >= need].astype(np.int64), n[length >= need].astype(np.int64))
        if not len(row) or not left.num_rows:
            return _rows(SENT, [])
        raw = left.column("ranges")[0].as_buffer()
        total = len(raw) // 6
        live = np.unique(_column(left, "sa", "<i4")[row])
        pos, low, high = np.frombuffer(raw, "<i4", total), np.frombuffer(raw, "u1", total, 4 * total), np.frombuffer(raw, "u1", total, 5 * total)
        pos, low, high, bounds = pos[live].astype(np.int64), low[live].astype(np.int64), high[live], _column(left, "bounds", "<i8")
        end = bounds[np.searchsorted(bounds, pos, "right")]
        lows = [np.maximum(low, pos - end + w) for w in windows]  # a longer window ends within the text from fewer offsets
        some = [np.flatnonzero(x <= high) for x in lows]
        which = np.repeat(np.arange(len(windows)), [len(x) for x in some])
        low, some = np.concatenate([x[o] for x, o in zip(lows, some, strict=True)]), np.concatenate(some)
        return _grid(pos[some], low, high[some], which, np.ones(len(some), bool), _text(left), bounds, GRID[0], windows, left.column("shard")[0].as_py(), parts)

    return cells


def _finer(windows: list[int], grid: int, parts: int):
    def cells(left: pa.Table, right: pa.Table) -> pa.Table:
        _, (b, low, high, which, need) = _settled(right)
        if not len(b):
            return _rows(SENT, [])
        return _grid(b, low, high, which, need, _text(left), _column(left, "bounds", "<i8"), grid, windows, left.column("shard")[0].as_py(), parts)

    return cells


def _strip(windows: list[int], schema: pa.Schema):
    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        data, bounds = _text(left), _column(left, "bounds", "<i8")
        meta = pa.ipc.open_stream(left.column("meta")[0].as_buffer()).read_all() if left.num_rows else None
        if meta is None:
            return schema.empty_table()
        levels = np.unique(right.column("level").to_numpy())
        found = [_settled(right.filter(pc.equal(right.column("level"), level)))[0] for level in levels]
        counts, kept = [], []
        for k, window in enumerate(windows):
            gone = np.zeros(len(data) + 1, np.int32)
            for anchor, low, high, which in found:
                b, low, high = (c[which == k].astype(np.int64) for c in (anchor, low, high))
                np.add.at(gone, b - high, 1)
                np.add.at(gone, b - low + window, -1)
            stay = np.cumsum(gone, dtype=np.int32)[: len(data)] == 0
            del gone
            removed, spans = [], []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                mask = stay[lo:hi]
                removed.append(int(hi - lo - np.count_nonzero(mask)))
                spans.append(int(np.count_nonzero(~mask & np.concatenate([[True], mask[:-1]]))) if removed[-1] else 0)
                if k == 0:
                    kept.append((data[lo:hi][mask] if removed[-1] else data[lo:hi]).tobytes())
            counts += [removed, spans]
        made = [pa.array(c, pa.int64()) for c in (np.diff(bounds), *counts)]
        made.insert(3, pa.array(kept, pa.binary()))
        return pa.Table.from_arrays([c.combine_chunks().cast(f.type) for c, f in zip(meta.columns, schema, strict=False)] + made, schema=schema)

    return rows


def remove_repeats(df: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), window: int = 400, slide: int = SLIDE, shard_bytes: int = SHARD_BYTES, passage: int | None = None) -> DataFrame:
    """df's carry columns with n_bytes, n_removed, n_spans (long) and kept (binary): each text's UTF-8 bytes
    without those covered by a window-byte string that also starts anywhere else in df.

    A null text counts as empty; texts below window bytes lose nothing; rows may repeat (each is a text of its
    own, so that a repeated long text loses all its bytes); an empty df gives no rows.  Strings are judged on
    the input, overlaps count, and no string spans two rows.  Other columns are not read.  With passage, the columns
    passage_bytes and passage_spans (long) count what strings of so many bytes, judged alike, would cover; kept is as
    without it.
    """
    if passage == window:
        raise ValueError("passage and window must differ")
    windows = [window] if passage is None else [window, passage]
    shortest = min(windows)
    need = shortest - (slide + GRAM - 1) - (slide - 1)
    if need < 1:
        raise ValueError("window is too short for this slide")
    source = df.select(F.col(text).cast("string").alias("_text"), *carry)
    shards = keep_bucketed(source.mapInArrow(lean(_build(shortest, slide, list(carry), shard_bytes)), SHARD), "shard")
    parts = parts_for(source, "_text")  # so that what one reducer reads doesn't grow with the corpus
    merged = lambda sent: keep(sent.groupBy("part").applyInArrow(_merge, HELD))
    live = merged(shards.select("shard", "bwt", "before", "step").mapInArrow(_first(parts), SENT))
    rounds = []
    while not live.isEmpty():
        rounds.append(live)
        moved = shards.select("shard", "bwt", "before", "step").groupBy("shard").cogroup(live.groupBy("shard"))
        live = merged(moved.applyInArrow(_extend(need, 1 if len(rounds) < 6 else 16, parts), SENT))  # few intervals live on past that, in runs of short phrases
    reached = live
    for x in rounds:
        reached = reached.unionByName(x)
    body = shards.select("shard", "text", "bounds", "sa", "ranges").groupBy("shard")
    asked = keep(body.cogroup(reached.groupBy("shard")).applyInArrow(lean_group(_live_cells(need, windows, parts)), SENT))
    free(live, *rounds)
    spans = None
    for level, finer in enumerate((*GRID[1:], None)):
        answers = keep(asked.where("part >= 0").groupBy("part").applyInArrow(_judge(finer is None), HELD))
        told = asked.where("part < 0").select("shard", F.lit(0).alias("kind"), "pack").unionByName(answers)
        told_at = told.withColumn("level", F.lit(level))
        spans = told_at if spans is None else spans.unionByName(told_at)
        if finer:
            asked = keep(shards.select("shard", "text", "bounds").groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(_finer(windows, finer, parts), SENT))
    longs = lambda *names: (F.lit(0).cast("long").alias(c) for c in names)
    more = ("passage_bytes", "passage_spans")[: 2 * len(windows) - 2]
    out = source.select(*carry, *longs("n_bytes", "n_removed", "n_spans"), F.lit(b"").alias("kept"), *longs(*more)).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    return shards.select("shard", "meta", "text", "bounds").groupBy("shard").cogroup(spans.groupBy("shard")).applyInArrow(lean_group(_strip(windows, to_arrow_schema(out))), out)


def _kept_text():
    """kept as a string; where a cut parts a character, its bytes become U+FFFD."""
    valid = F.expr("try_validate_utf8(cast(kept as string))")
    return F.when(F.col("n_removed") == 0, F.col("kept").cast("string")).otherwise(F.coalesce(valid, F.expr("make_valid_utf8(cast(kept as string))")))


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept text of every document, for strings of 400 bytes;
    passage_bytes and passage_spans for strings of PASSAGE bytes, so for repeated passages of over 50 words."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), slide=PASSAGE_SLIDE, passage=PASSAGE)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), _kept_text().alias("text"), "passage_bytes", "passage_spans")


def strip_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without strings of PASSAGE bytes that repeat, so without repeated passages of over
    50 words; what a cut leaves of a character becomes U+FFFD.

    Every row stays, null and repeated ids too; a null text becomes an empty one, and n_chars is counted anew.
    """
    out = remove_repeats(docs, carry=("doc_id", "lang", "source"), window=PASSAGE, slide=PASSAGE_SLIDE)
    return out.select("doc_id", _kept_text().alias("text"), "lang", "source").withColumn("n_chars", F.char_length("text").cast("long"))


__all__ = ["remove_repeats", "op1_suffix_dedup", "strip_stage"]
