"""Exact Jaccard join of word n-gram sets: size-banded tiles, bitmap bounds, sorted-array intersection.

A text's set is split by hash into more buckets than two linked sets of its size band can differ in elements, so
that linked sets agree on a whole bucket: the tile (band, bucket, content) holds both.  There are a few spare
buckets, and a set with no more empty buckets than spare ones skips those: it agrees with any partner on one that
holds something.  A set near a band's lower end also enters the tiles of the band below.  Tiles meet in two steps: each map task compares its
own members and sends one member of each tile on, so that no reducer sees more rows of a tile than there are
map tasks, however common its content is.  Within a tile only (member, smallest member) pairs are tried first:
a hashed bitmap of each set bounds their overlap from above by bit counts, and what remains is decided by
intersecting the sorted arrays.  Linked sets are contracted to components.  Only tiles that still hold several
components go on to the exact rest, block by block: a first pass names the members whose bitmaps allow a link to
another component, a second one has their arrays at hand, intersects what the bound leaves and returns a spanning
forest of the links.  So no link is lost, and no group's pairs are written out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm.common import M1, M2, U64, Rolling, byte_column, components, free, keep, keep_bucketed, lean, mix, parts_for, row_blocks

BITS, BITS_EACH, MOST_BITS, LISTED = 2048, 4, 1 << 16, 256
BLOCK_BYTES = 2 << 20
TILE_BLOCK, TILE_ELEMENTS = 512, 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def bands(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowest set size of each size band (sizes up to half as much again as the lowest), and the most elements
    in which two linked sets can differ if the smaller is of the band."""
    low = [1]
    while low[-1] < 2**40:
        low.append(max(low[-1] + 1, low[-1] * 3 // 2))
    top = np.array(low[1:]) - 1
    return np.array(low[:-1]), (top + top * 100 // percent) * (100 - percent) // (100 + percent)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int, roll: Rolling):
    """(row of each shingle, its hash): not yet distinct.  data: the rows' bytes; offsets: from 0."""
    data = _LOWER[data]
    space = _SPACE[data]
    begin = np.zeros(len(data) + 1, bool)
    begin[offsets] = True
    prior = np.concatenate([[True], space[:-1]]) if len(data) else space
    start = np.flatnonzero(~space & (prior | begin[:-1]))
    after = np.concatenate([space[1:], [True]]) if len(data) else space
    end = np.flatnonzero(~space & (after | begin[1:])) + 1
    sums = roll.over(data)
    w = roll.of(sums, start, end)
    row = np.searchsorted(offsets, start, "right") - 1
    if len(w) < words:
        full = np.zeros(0, np.int64)
    else:
        full = np.flatnonzero(row[words - 1 :] == row[: len(row) - words + 1])
    power = [U64(pow(int(M1), k + 1, 2**64)) for k in range(words)]
    h = np.zeros(len(full), U64)
    for k in range(words):
        h += w[full + k] * power[k]
    count = np.bincount(row, minlength=len(offsets) - 1)
    few = np.flatnonzero((count > 0) & (count < words))
    short = np.zeros(len(few), U64)
    first = np.searchsorted(row, few)
    for k in range(words - 1):
        has = count[few] > k
        short[has] += w[first[has] + k] * power[k]
    short += count[few].astype(U64) * M2  # a short sequence is never a shingle of the full length
    rows = np.concatenate([row[full], few])
    order = np.argsort(rows, kind="stable")
    return rows[order], mix(np.concatenate([h, short])[order])


def _sets(batch: pa.RecordBatch, column: int, words: int, roll: Rolling):
    """(row, sorted distinct shingle hashes) for every row of a batch."""
    data, offsets = byte_column(batch.column(column))
    for lo, hi in row_blocks(offsets, BLOCK_BYTES):
        base = offsets[lo]
        row, h = shingles(data[base : offsets[hi]], offsets[lo : hi + 1] - base, words, roll)
        cuts = np.searchsorted(row, np.arange(hi - lo + 1))
        for k in range(hi - lo):
            yield lo + k, np.unique(h[cuts[k] : cuts[k + 1]])


def _set_key(s: np.ndarray) -> int:
    return int((mix(s + M2).sum(dtype=U64) + U64(len(s))).view(np.int64)) if len(s) else 0


def bitmap(s: np.ndarray) -> bytes:
    """BITS_EACH bits for each element, rounded up to a power of two between BITS and MOST_BITS."""
    size = min(max(BITS, 1 << (len(s) * BITS_EACH - 1).bit_length()), MOST_BITS)
    bits = np.zeros(size, bool)
    bits[(s >> U64(40)) % U64(size)] = True
    return np.packbits(bits).tobytes()


def _tiles(s: np.ndarray, low: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    t = int(np.searchsorted(low, len(s), "right")) - 1
    least = int(np.searchsorted(low, max(1, -(-len(s) * percent // 100)), "right")) - 1  # the smallest partner's band
    out = []
    for tile in range(t, least - 1, -1):
        spare = 1 + int(differ[tile]) // 6
        m = int(differ[tile]) + 1 + spare
        part = (s % U64(m)).astype(np.int64)
        order = np.argsort(part)
        cut = np.flatnonzero(np.diff(part[order], prepend=-1))
        total = np.zeros(m, U64)
        total[part[order][cut]] = np.add.reduceat(mix(s[order] ^ M1), cut)
        made = mix(total + mix(np.arange(m, dtype=U64) + U64(tile << 40)))
        out.append(made[part[order][cut]] if m - len(cut) <= spare else made)
    return np.concatenate(out)


PASS = "kind int, doc_id long, row long, n long, key long, bits binary, tile long, part int, pack binary"


def _pass(words: int, percent: int, parts: int):
    def rows(batches):
        low, differ = bands(percent)
        roll = Rolling(17)
        names = ["kind", "doc_id", "row", "n", "key", "bits", "tile", "part", "pack"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]

        def made(k: int, **x):
            n = len(next(iter(x.values())))
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)) if c == "kind" else pa.array(x[c], t) if c in x else pa.nulls(n, t) for c, t in zip(names, kinds, strict=True)], names=names)

        def packs(tiles, owners):
            tile, own = np.concatenate(tiles), np.concatenate(owners)
            order = np.lexsort((own, tile))
            tile, own = tile[order], own[order]
            first = np.diff(tile.view(np.int64), prepend=~tile.view(np.int64)[:1]) != 0
            fresh = first | (np.diff(own, prepend=own[:1]) != 0)  # copies of one set count once
            tile, own, first = tile[fresh], own[fresh], first[fresh]
            group = np.cumsum(first) - 1
            many = np.bincount(group)[group] > 1
            for k in range(0, np.count_nonzero(many), 500_000):
                yield made(2, key=own[many][k : k + 500_000], tile=tile[many][k : k + 500_000].view(np.int64))
            tile, own = tile[first], own[first]
            part = (tile % U64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            full = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
            yield made(1, part=full, pack=[np.concatenate([np.ascontiguousarray(tile[i].view("u1").reshape(-1, 8).T).ravel(), own[i].view("u1")]).tobytes() for p in full for i in [order[cuts[p] : cuts[p + 1]]]])

        tiles, owners, held = [], [], 0
        for batch in batches:
            n, keys, maps = [], [], []
            for _, s in _sets(batch, 1, words, roll):
                n.append(len(s))
                keys.append(_set_key(s))
                maps.append(bitmap(s) if len(s) else None)
                if len(s):
                    tiles.append(_tiles(s, low, differ, percent))
                    owners.append(np.full(len(tiles[-1]), keys[-1], np.int64))
                    held += len(tiles[-1])
                if held > 1_000_000:
                    yield from packs(tiles, owners)
                    tiles, owners, held = [], [], 0
            yield made(0, doc_id=batch.column(0), row=batch.column(2), n=n, key=keys, bits=maps)
        if held:
            yield from packs(tiles, owners)

    return rows


MEMBER = "tile long, key long"


def _meet(table: pa.Table) -> pa.Table:
    """The members of tiles that several map tasks sent."""
    tiles, owners = [], []
    for raw in table.column("pack"):
        x = np.frombuffer(raw.as_buffer(), "u1")
        n = len(x) // 16
        tiles.append(np.ascontiguousarray(x[: 8 * n].reshape(8, n).T).view(np.int64).ravel())
        owners.append(x[8 * n :].view(np.int64))
    tile, own = np.concatenate(tiles), np.concatenate(owners)
    order = np.lexsort((own, tile))
    tile, own = tile[order], own[order]
    first = np.concatenate([[True], tile[1:] != tile[:-1]])
    fresh = first | np.concatenate([[True], own[1:] != own[:-1]])
    tile, own, first = tile[fresh], own[fresh], first[fresh]
    group = np.cumsum(first) - 1
    many = np.bincount(group)[group] > 1
    return pa.table({"tile": tile[many], "key": own[many]})


def _could_link(na, nb, a, b, percent: int) -> np.ndarray:
    """Whether bit counts let sets of na and nb elements with bitmaps a and b (rows of 64-bit words) link."""
    most = np.minimum(na - np.bitwise_count(a & ~b).sum(-1, dtype=np.int64), nb - np.bitwise_count(b & ~a).sum(-1, dtype=np.int64))
    return 100 * most >= percent * (na + nb - most)


def _words(col, size: int | None = None) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, folded to the shortest one or to size bytes."""
    raw = [np.frombuffer(x.as_buffer(), U64) for x in col]
    size = (size or min((x.nbytes for x in raw), default=8)) // 8
    return np.stack([x if len(x) == size else np.bitwise_or.reduce(x.reshape(-1, size)) for x in raw]) if raw else np.zeros((0, size), U64)


def _bound(percent: int):
    def rows(batches):
        for x in batches:
            na, nb = x.column("na").to_numpy(), x.column("nb").to_numpy()
            size = np.minimum(*(pc.binary_length(x.column(c)).to_numpy() for c in ("bits_a", "bits_b")))
            ok = np.zeros(x.num_rows, bool)
            for one in np.unique(size):
                at = np.flatnonzero(size == one)
                for k in range(0, len(at), max(1, (8 << 20) // int(one))):
                    i = at[k : k + max(1, (8 << 20) // int(one))]
                    ok[i] = _could_link(na[i], nb[i], *(_words(x.column(c).take(pa.array(i)), int(one)) for c in ("bits_a", "bits_b")), percent)
            yield pa.RecordBatch.from_arrays([x.column(c).filter(pa.array(ok)) for c in ("a", "b", "votes")], names=["a", "b", "votes"])

    return rows


def _intersect(percent: int):
    def rows(batches):
        for x in batches:
            a, b = [], []
            for ka, kb, sa, sb in zip(x.column("a").to_pylist(), x.column("b").to_pylist(), x.column("set_a"), x.column("set_b"), strict=True):
                sa, sb = np.frombuffer(sa.as_buffer(), U64), np.frombuffer(sb.as_buffer(), U64)
                both = len(np.intersect1d(sa, sb, assume_unique=True))
                if 100 * both >= percent * (len(sa) + len(sb) - both):
                    a.append(ka)
                    b.append(kb)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows


SUSPECT = "tile long, i int, j int, side int, key long, comp long, n long, tiles array<long>, bits binary"


def _earlier(x: pa.Table) -> np.ndarray:
    """For each member, which tiles before this one it lists, as rows of packed bits.

    A member lists its LISTED smallest tiles, so that a pair of very long sets may be compared in several tiles;
    none is left out.
    """
    lists = x.column("tiles").combine_chunks()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    at = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
    inside = np.zeros((len(lists), at.max() + 1 if len(at) else 1), bool)
    inside[row, at] = True
    return np.packbits(inside, axis=1)


def _candidates(x: pa.Table, percent: int):
    """(member, the other members of its block pair that the bound leaves, that another component holds, and that
    it meets in no tile before this one)."""
    side, key, comp, n = (x.column(c).to_numpy() for c in ("side", "key", "comp", "n"))
    bits, earlier = _words(x.column("bits").combine_chunks()), _earlier(x)
    right, block = np.flatnonzero(side != 0), 1 + (4 << 20) // (8 * bits.shape[1])
    for i in np.flatnonzero(side != 1):
        other = right[(comp[right] != comp[i]) & ((key[right] > key[i]) | (side[i] == 0))]
        other = other[~(earlier[other] & earlier[i]).any(1)]
        for k in range(0, len(other), block):
            some = other[k : k + block]
            yield i, some[_could_link(n[i], n[some], bits[i], bits[some], percent)]


def _suspects(percent: int):
    def members(x: pa.Table) -> pa.Table:
        """The rows that might link with another component's."""
        on = np.zeros(x.num_rows, bool)
        for i, other in _candidates(x, percent):
            on[other] = True
            on[i] |= len(other) > 0
        x = x.set_column(x.column_names.index("tiles"), "tiles", x.column("tiles").cast(pa.list_(pa.field("element", pa.int64()))))
        return x.select([c.split()[0] for c in SUSPECT.split(", ")]).filter(pa.array(on))

    return members


def _forest(percent: int):
    def links(x: pa.Table) -> pa.Table:
        """Links of one block pair of a tile that connect its components, none that others make needless."""
        key, comp = x.column("key").to_numpy(), x.column("comp").to_numpy()
        sets = [np.frombuffer(v.as_buffer(), U64) for v in x.column("elements").combine_chunks()]
        root = np.unique(comp, return_inverse=True)[1]
        a, b = [], []
        for i, other in _candidates(x, percent):
            for j in other.tolist():
                if root[i] == root[j]:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a.append(key[i])
                    b.append(key[j])
                    root[root == root[j]] = root[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return links


def _shingle_sets(words: int):
    def rows(batches):
        roll = Rolling(17)
        for batch in batches:
            keys, want, sets = [], batch.column(0).to_pylist(), []
            for i, s in _sets(batch, 1, words, roll):
                if _set_key(s) == want[i]:
                    keys.append(want[i])
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], names=["key", "elements"])

    return rows


def _row_key(*columns: Column) -> Column:
    """A 64-bit hash of a row's columns that tells nulls from values."""
    return F.xxhash64(*columns, *(c.isNull() for c in columns))


def _rooted(source: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, row, n, root of every row of source (doc_id, text, row), where row is equal only for equal ids and texts.

    Linked sets have one root.
    """
    if not 1 <= percent <= 100 or words < 1:
        raise ValueError("percent is a whole number from 1 to 100, words is at least 1")
    parts = parts_for(source, "text")
    first = keep(source.mapInArrow(lean(_pass(words, percent, parts)), PASS), "kind")
    docs = first.where("kind = 0").select("doc_id", "row", "n", "key", "bits")
    sets = docs.where("n > 0").groupBy("key").agg(F.min("n").alias("n"), F.min("bits").alias("bits"), F.min("row").alias("row"))
    met = first.where("kind = 1").select("part", "pack").groupBy("part").applyInArrow(_meet, MEMBER)
    members = keep(met.unionByName(first.where("kind = 2").select("tile", "key")).distinct())
    free(first, part="kind=1")
    free(first, part="kind=2")
    # pairs of each tile's smallest member and the others
    pivot = members.groupBy("tile").agg(F.min("key").alias("b"))
    star = members.join(pivot, "tile").where("key <> b").groupBy(F.col("key").alias("a"), "b").agg(F.count("*").alias("votes"))
    known = keep(members.select("key").distinct().join(sets, "key"))
    side = lambda x: known.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}"))
    pairs = keep(star.join(side("a"), "a").join(side("b"), "b").mapInArrow(_bound(percent), "a long, b long, votes long"))
    text_of = source.join(known.select("key", "row"), "row").select("key", "text")
    arrays = keep_bucketed(text_of.mapInArrow(lean(_shingle_sets(words)), "key long, elements binary").groupBy("key").agg(F.min("elements").alias("elements")), "key")

    def linked(some: DataFrame) -> DataFrame:
        x = some.select("a", "b").join(arrays.select(F.col("key").alias("a"), F.col("elements").alias("set_a")), "a")
        return keep(x.join(arrays.select(F.col("key").alias("b"), F.col("elements").alias("set_b")), "b").mapInArrow(_intersect(percent), "a long, b long"))

    def apart(some: DataFrame, comp: DataFrame) -> DataFrame:
        """The pairs whose ends are not connected yet."""
        c = lambda x: comp.select(F.col("v").alias(x), F.col("component").alias(f"c{x}"))
        x = some.join(c("a"), "a", "left").join(c("b"), "b", "left")
        return x.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "votes")

    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("votes"), "b"))
    links = linked(pairs.withColumn("rank", best).where("rank = 1"))
    comp = components(links)
    links = links.unionByName(linked(keep(apart(pairs, comp))))
    comp = keep(components(links))
    # the exact rest: tiles that hold several components
    inside = members.join(comp.select(F.col("v").alias("key"), "component"), "key", "left").select("tile", "key", F.coalesce("component", "key").alias("comp"))
    inside = inside.join(known.select("key", "n"), "key")
    size = inside.groupBy("tile").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m"), F.sum("n").alias("sum")).where("x < y and m > 2")
    size = keep(size.select("tile", F.greatest(F.ceil(F.col("m") / TILE_BLOCK), F.ceil(F.col("sum") / TILE_ELEMENTS)).cast("int").alias("blocks")))
    mixed = keep(inside.join(size, "tile"))
    tiles = mixed.groupBy("key").agg(F.slice(F.array_sort(F.collect_set("tile")), 1, LISTED).alias("tiles"))
    rest = mixed.withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rest = rest.select("tile", "key", "comp", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rest = rest.select("tile", "key", "comp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"))
    rest = rest.join(tiles.join(known.select("key", "n", "bits"), "key"), "key").withColumn("tiles", F.filter("tiles", lambda t: t < F.col("tile")))
    suspects = keep(rest.groupBy("tile", "i", "j").applyInArrow(_suspects(percent), SUSPECT))
    more = keep(suspects.join(arrays, "key").groupBy("tile", "i", "j").applyInArrow(_forest(percent), "a long, b long"))
    if not more.isEmpty():
        links = links.unionByName(more)
        comp = keep(components(links))
    free(pairs, suspects, size, mixed, members)
    joined = docs.select("doc_id", "row", "n", "key").join(comp.select(F.col("v").alias("key"), "component"), "key", "left")
    return joined.select("doc_id", "row", "n", F.coalesce("component", "key").alias("root"))


def jaccard_components(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id (long) for every row of df, linking rows whose sets of distinct
    word n-grams have 100 * intersection >= percent * union.

    Words are runs of other bytes than ASCII white space, after A-Z are lower-cased; a text with fewer than
    words words is one shingle; a null or blank text has no shingles and links with nothing (component_id: its
    own id).  Rows may repeat; ids should be unique, and a null id belongs to the component of its set.  An
    empty df gives no rows.  Shingles and sets are told apart by 64-bit hashes.
    """
    source = df.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    root = _rooted(source.withColumn("row", _row_key(F.col("doc_id"), F.col("text"))), words, percent)
    root = keep(root)
    least = keep(root.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least")))
    out = root.join(least, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document, for three words and 90 %."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def one_of_each_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of every group that five-word shingles link at 80 %, the document of the smallest id.

    Rows are told apart by all their columns: null ids come after all others, and between texts of one id a hash
    decides, so each group keeps exactly one row.  Texts without shingles link with nothing and all stay.
    """
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = docs.select(*columns).withColumn("row", _row_key(*map(F.col, columns)))
    found = keep(_rooted(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "row"), 5, 80))
    one = found.where("n > 0").groupBy("root").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "row"))["row"].alias("row")).select("row", F.lit(False).alias("blank"))
    kept = one.unionByName(found.where("n = 0").select("row", F.lit(True).alias("blank")).distinct())
    copy = F.row_number().over(Window.partitionBy("row").orderBy("row"))  # rows of one key are equal in all columns
    return rows.join(kept, "row").withColumn("copy", copy).where("blank or copy = 1").select(*columns)


__all__ = ["jaccard_components", "op3_ngram_jaccard_join", "one_of_each_stage"]
