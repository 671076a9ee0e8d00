"""Sum-of-squares packing of tokenised documents into sequences of a fixed length.

Tokens: the tokenizer splits at white space first, so every distinct word is encoded once for each task and a
text's ids are looked up.  Packing: pieces are dealt by hash into groups of about group_size, each packed by a
task of its own: a piece goes where the sum over residual gaps of the squared number of open bins becomes
smallest (a new bin counts as one more gap).  A group's end leaves a few open bins, which is the whole cost of
packing groups apart; so waste falls with the group size and not with the number of machines.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import byte_column, keep, lean, lean_group, per_worker, row_blocks

BLOCK_BYTES = 4 << 20
GROUP = 40_000


def _tokenizer(path: str | None):
    def make():
        import public_tokenizers
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))

    return per_worker(f"tokenizer {path}", make)


_TAIL = ".,#$%&*|!?;:"
#: Letters that the tokenizer leaves as they are but for their case, each to one letter (U+0130 becomes two).
_LETTERS = "A-Za-zÀ-ÖØ-öø-\u012f\u0131-\u024f"
#: How byte-level vocabularies write the 256 bytes: printable ones as themselves, the others from U+0100 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _PLAIN} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in _PLAIN)}


class _Words:
    """Ids of distinct words, appended as they come up; emptied when it holds too many.

    A word of Latin letters with punctuation after it is kept as these two, which the tokenizer parts as well.
    Such letters are one unit to the tokenizer's model, so the steps before the model are skipped for them.  Any
    other word is encoded as it is: its signs may join with that punctuation, or its letters compose before their
    case is changed.
    """

    def __init__(self, tokenizer, most: int = 200_000):
        from array import array

        self.tokenizer, self.most, self.array = tokenizer, most, array
        # the shortcut holds for tokenizers that lower-case, part letters from punctuation and then map bytes
        self.letters = tokenizer.encode("Aé,b", add_special_tokens=False).ids == [i for x in ("aÃ©", ",", "b") for i in self._model(x)]
        self.clear()

    def _model(self, word: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(word)]

    def clear(self):
        self.at, self.flat, self.used, self.start, self.length = {"": 0}, np.zeros(1 << 20, np.uint32), 0, self.array("q", [0]), self.array("q", [0])

    def _add(self, word: str, ids: list[int]):
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[word] = len(self.start)
        self.start.append(self.used)
        self.length.append(len(ids))
        self.used += len(ids)

    def parts(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the words' stems and tails."""
        if len(self.at) > self.most:
            self.clear()
        if not self.letters:
            return self._codes(words), np.zeros(len(words), np.int64)
        plain = pc.match_substring_regex(words, f"^[{_LETTERS}]*[{_TAIL}]*$")
        stems = pc.if_else(plain, pc.utf8_lower(pc.utf8_rtrim(words, characters=_TAIL)), words)
        tails = pc.if_else(plain, pc.struct_field(pc.extract_regex(words, f"(?P<tail>[{_TAIL}]*)$"), [0]), "")
        return self._codes(stems), self._codes(tails)

    def _codes(self, words: pa.Array) -> np.ndarray:
        words = words.dictionary_encode()
        distinct, at, rest = words.dictionary.to_pylist(), self.at, []
        for w in distinct:
            if w not in at:
                if self.letters and re.fullmatch(f"[{_LETTERS}]+", w):
                    self._add(w, self._model(w if w.isascii() else w.encode().decode("latin-1").translate(_BYTES)))
                else:
                    rest.append(w)
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self._add(w, e.ids)
        return np.array([at[w] for w in distinct], np.int64)[words.indices.to_numpy(zero_copy_only=False)] if distinct else np.zeros(0, np.int64)


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[0], start[0] + 1, ... for each of the runs in turn."""
    ends = np.cumsum(length)
    return np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


def token_ids(texts: pa.Array, words: _Words, end_id: int | None):
    """(all rows' ids in one array, offsets): each row's ids, then end_id."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    flat = split.flatten().dictionary_encode()
    stem, tail = words.parts(flat.dictionary)  # a leading or trailing gap gives an empty word, which has no ids
    start, length = np.frombuffer(words.start, np.int64), np.frombuffer(words.length, np.int64)
    both = np.stack([stem, tail], 1).ravel()
    known = words.flat[_spread(start[both], length[both])]  # the distinct words' ids, side by side
    n = length[stem] + length[tail]
    which = flat.indices.to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, np.int64)
    ids = known[_spread((np.cumsum(n) - n)[which], n[which])] if len(which) else np.zeros(0, np.uint32)
    ends = np.concatenate([[0], np.cumsum(n[which])]) if len(which) else np.zeros(1, np.int64)
    bounds = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
    if end_id is None:
        return ids, bounds
    return np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(len(bounds))


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def _pieces(path, size: int, end_id: int, with_ids: bool):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def rows(batches):
        words = per_worker(f"words {path}", lambda: _Words(_tokenizer(path)))
        for batch in batches:
            _, offsets = byte_column(batch.column(1))
            for lo, hi in row_blocks(offsets, BLOCK_BYTES):
                ids, bounds = token_ids(batch.column(1).slice(lo, hi - lo), words, end_id)
                ids = ids.astype("<u4")
                n = -(-np.diff(bounds) // size)
                doc = np.repeat(np.arange(hi - lo), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * size
                length = np.minimum(size, np.diff(bounds)[doc] - start)
                at = bounds[doc] + start
                raw = [ids[a : a + k] for a, k in zip(at, length, strict=True)]
                crc = [zlib.crc32(x) for x in raw]
                kept = pa.array([x.tobytes() for x in raw], pa.binary()) if with_ids else pa.nulls(len(raw), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), *(pa.array(x, t) for x, t in zip((piece, start, length, crc), kinds[1:5], strict=True)), kept], names=names)

    return rows


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length in 1..size, in the given order."""
    open_ = np.zeros(size + 1, np.int64)  # open bins by residual gap; gap 0 is closed and stays 0
    by_gap: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    never = np.iinfo(np.int64).max
    for k, s in enumerate(lengths.tolist()):
        gap, to = size, 0
        if s < size:
            here = open_[s:size]
            cost = 2 * (open_[: size - s] - here) + 2
            if here[0]:
                cost[0] -= 1  # a closed bin adds no gap
            cost[here == 0] = never
            best = int(cost.argmin())
            if cost[best] <= 2 * open_[size - s] + 1:
                gap = best + s
        if gap == size:
            to, made = made, made + 1
        else:
            to = by_gap[gap].pop()
            open_[gap] -= 1
        bins[k], offset[k] = to, size - gap
        if gap > s:
            by_gap[gap - s].append(to)
            open_[gap - s] += 1
    return bins, offset


def _pack(size: int):
    def group(t: pa.Table) -> pa.Table:
        order = np.lexsort((t.column("piece").to_numpy(), pc.fill_null(t.column("doc_id"), -1).to_numpy(), t.column("deal").to_numpy()))
        b, o = sum_of_squares(t.column("length").to_numpy()[order], size)
        bins, offset = np.empty(len(b), np.int64), np.empty(len(b), np.int64)
        bins[order], offset[order] = b, o
        t = t.append_column("sequence_id", pa.array(bins + (t.column("group")[0].as_py() << 32)))
        return t.append_column("offset", pa.array(offset)).drop_columns(["deal", "group"])

    return group


def pack(df: DataFrame, id: str = "doc_id", text: str = "text", size: int = 2048, end_id: int = 0, tokenizer: str | None = None, with_ids: bool = False, group_size: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset of every piece of every row's tokens.

    A row's tokens end with end_id, so a null, empty or blank text is one piece of one token.  Only rows of more
    than size tokens are cut.  ids holds the piece's unsigned 32-bit ids if with_ids, else null.  Repeated rows
    and ids are packed apart; an empty df gives no rows.  tokenizer: a file; by default the public word BPE.
    """
    source = df.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    pieces = keep(source.mapInArrow(lean(_pieces(tokenizer, size, end_id, with_ids)), PIECE).withColumn("row", F.monotonically_increasing_id()))
    groups = -(-max(1, pieces.count()) // group_size)
    dealt = pieces.withColumn("deal", F.xxhash64("row")).drop("row").withColumn("group", F.pmod("deal", F.lit(groups)))  # by row: ids may be null or repeat
    return dealt.groupBy("group").applyInArrow(lean_group(_pack(size)), f"{PIECE}, sequence_id long, offset long")


def op8_sum_of_squares_packing(spark, sf_dir: str) -> DataFrame:
    """The pieces of every document, packed into sequences of 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of every row, null and repeated ids too, packed; a null text is one piece of one token."""
    return pack(docs).drop("ids")


__all__ = ["pack", "sum_of_squares", "op8_sum_of_squares_packing", "pack_stage"]
