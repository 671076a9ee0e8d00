"""Sampled SentencePiece segmentations by forward filtering and backward sampling, and lossless decoding.

A text is written as the model writes it (spaces as U+2581, one in front) and falls into units that no piece
crosses.  For every distinct unit of a block the piece lattice is filtered forward once: each node keeps the
distribution of the last piece of a segmentation that ends there.  Every occurrence then samples its pieces
backward from these, with numbers drawn from the seed, the row's key and the place in the text alone, so a row
has the same segmentation in any partitioning.  A character without a piece, and a U+2581 of the text itself, is
written in byte pieces, so decoding gives back every text.  Piece weights: a unigram model's scores; for a BPE
model, whose scores are merge ranks, -log(3 + rank).  Both are times alpha.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import U64, byte_column, mix, per_worker, row_blocks

BLOCK_BYTES = 3 << 20
LOWER_BAR, BAR_ITSELF = 0x2581, 0x110001


class Pieces:
    """A model's pieces as hashed code point strings, with the hashes of their prefixes."""

    def __init__(self, path: str | None, alpha: float):
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        n = sp.get_piece_size()
        names, score = [sp.id_to_piece(i) for i in range(n)], np.array([sp.get_score(i) for i in range(n)])
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.byte = np.zeros(256, np.int64)
        for i in range(n):
            if sp.is_byte(i):
                self.byte[int(names[i][3:5], 16)] = i
        ranks = score[plain] == np.round(score[plain])
        if ranks.all() and score[plain].min() < -1000:
            rank = np.where(score < -1e8, n, -score)
            score = -np.log(3 + rank)
        codes = [np.array([ord(c) for c in names[i]], np.uint64) for i in plain]
        self.longest = max(map(len, codes))
        prefixes, whole = set(), {}
        for i, c in zip(plain, codes, strict=True):
            h = U64(0)
            for k, x in enumerate(c):
                h = self.push(np.array([h], U64), np.array([x], U64))[0]
                prefixes.add((k + 1, int(h)))
            whole[int(h)] = i
        keys = np.array(sorted({h for _, h in prefixes}), U64)
        self.keys, self.id = keys, np.array([whole.get(int(h), -1) for h in keys], np.int64)
        self.weight = np.exp(alpha * (score - score[plain].mean()))
        self.fallback = float(np.exp(alpha * (score[plain].min() - 5 - score[plain].mean())))
        self.bytes = [bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else names[i].replace("▁", " ").encode() if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) else b"" for i in range(n)]
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.size = np.array([len(b) for b in self.bytes])
        self.start = np.cumsum(self.size) - self.size

    @staticmethod
    def push(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        return mix(h + code + U64(0x9E3779B97F4A7C15))

    def lattice(self, code: np.ndarray, length: np.ndarray):
        """(cdf, piece) by end node and piece length, for units of the given lengths in code points side by side.

        Node p stands after code point p; cdf[p, l - 1] is the chance that the last piece has at most l points.
        """
        n, ends = len(code), np.cumsum(length)
        left = np.repeat(ends, length) - np.arange(n)  # points from here to the unit's end
        piece = np.full((n, self.longest), -1, np.int32)
        at, h = np.arange(n), np.zeros(n, U64)
        for k in range(self.longest):
            ok = left[at] > k
            at, h = at[ok], h[ok]
            h = self.push(h, code[at + k].astype(U64))
            spot = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            ok = self.keys[spot] == h
            at, h, spot = at[ok], h[ok], spot[ok]
            found = self.id[spot]
            piece[(at + k)[found >= 0], k] = found[found >= 0]
        single = piece[:, 0] < 0
        weight = np.where(piece >= 0, self.weight[piece], 0).astype(np.float64)
        weight[single, 0] = self.fallback
        by_size = np.argsort(-length, kind="stable")
        first, size = (ends - length)[by_size], length[by_size]
        window = np.zeros((len(length), self.longest))
        window[:, 0] = 1  # window[:, l]: the mass of the node l + 1 points back
        cdf = np.empty((n, self.longest), np.float32)
        for j in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -j, "left"))
            p = first[:live] + j
            part = window[:live] * weight[p]
            total = part.sum(1, keepdims=True)
            cdf[p] = np.cumsum(part, 1) / total
            window = np.concatenate([np.ones((live, 1)), window[:live, :-1] / total], 1)
        last = self.longest - 1 - (weight[:, ::-1] > 0).argmax(1)
        cdf[np.arange(self.longest) >= last[:, None]] = 2
        return cdf, piece

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes: the pieces' bytes without the space that encoding put in front."""
        n = self.size[ids]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.start[ids] - ends + n, n) + np.arange(ends[-1] if len(ids) else 0)].tobytes()[1:]


def _units(text: pa.Array) -> pa.ListArray:
    """Each row's units without their first space."""
    odd = pc.match_substring_regex(text, "^ |  ").to_numpy(zero_copy_only=False)
    if not odd.any():
        return pc.split_pattern(text, " ")
    rows = pc.split_pattern(text, " ").to_pylist()
    for i in np.flatnonzero(odd):
        rows[i] = [u[1:] for u in re.findall(r" +[^ ]*", " " + text[i].as_py())]
    return pa.array(rows, pa.list_(pa.string()))


def encode_block(text: pa.Array, key: np.ndarray, pieces: Pieces, seed: int):
    """(ids of all rows side by side, offsets)."""
    units = _units(text)
    flat = units.flatten().dictionary_encode()
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(len(text) + 1, np.int64)
    size = pc.utf8_length(flat.dictionary).to_numpy().astype(np.int64) + 1
    raw = np.frombuffer("".join(["\u0000" + w for w in flat.dictionary.to_pylist()]).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(raw == LOWER_BAR, BAR_ITSELF, np.where(raw == 32, LOWER_BAR, raw)).astype(np.int64)
    begin = np.cumsum(size) - size
    code[begin] = LOWER_BAR
    cdf, piece = pieces.lattice(code, size)
    which = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = pc.list_parent_indices(units).to_numpy(zero_copy_only=False)
    n = size[which]
    place = np.cumsum(n) - n
    bounds = units.offsets.to_numpy() - units.offsets[0].as_py()
    place -= np.concatenate([place, [0]])[np.minimum(bounds[:-1], len(place))][row]  # code points before the unit in its row
    stream = mix(key.view(U64) + U64(seed))[row] + place.astype(U64)
    node, left, live = begin[which] + n - 1, n.copy(), np.arange(len(which))
    count, drawn = np.zeros(len(which), np.int64), []
    while len(live):
        u = (mix(stream[live] + left[live].astype(U64)) >> U64(11)).astype(np.float64) * 2.0**-53
        length = (cdf[node[live]] <= u[:, None]).sum(1) + 1
        got = piece[node[live], length - 1].astype(np.int64)
        got = np.where(got < 0, -code[node[live]] - 1, got)
        drawn.append((live, got))
        count[live] += 1
        node[live] -= length
        left[live] -= length
        live = live[left[live] > 0]
    ends = np.cumsum(count)
    ids = np.empty(ends[-1], np.int64)
    at = ends - 1
    for live, got in drawn:
        ids[at[live]] = got
        at[live] -= 1
    bounds = np.concatenate([[0], ends])[bounds]
    if (bad := np.flatnonzero(ids < 0)).size:
        spelled = [[int(pieces.byte[b]) for b in chr(0x2581 if c == BAR_ITSELF else c).encode("utf-8", "surrogatepass")] for c in (-ids[bad] - 1).tolist()]
        grown = np.array([len(s) for s in spelled])
        times = np.ones(len(ids), np.int64)
        times[bad] = grown
        shift = np.concatenate([[0], np.cumsum(times)])
        ids, where = np.repeat(ids, times), np.repeat(shift[bad] - (np.cumsum(grown) - grown), grown) + np.arange(grown.sum())
        ids[where] = [i for s in spelled for i in s]
        bounds = shift[bounds]
    return ids, bounds


def _encode(path, alpha: float, seed: int, with_ids: bool):
    def rows(batches):
        pieces = per_worker(f"pieces {path} {alpha}", lambda: Pieces(path, alpha))
        for batch in batches:
            _, offsets = byte_column(batch.column(1))
            for lo, hi in row_blocks(offsets, BLOCK_BYTES):
                raw = batch.column(1).slice(lo, hi - lo)
                text = pc.fill_null(raw, "")
                ids, bounds = encode_block(text, pc.fill_null(batch.column(2).slice(lo, hi - lo), 0).to_numpy().astype(np.int64), pieces, seed)
                each = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                data, off = byte_column(text)
                same = [pieces.decode(x) == data[a:b].tobytes() for x, a, b in zip(each, off[:-1], off[1:], strict=True)]
                crc = [zlib.crc32(x.astype("<u4")) for x in each]
                out = [batch.column(0).slice(lo, hi - lo), pa.array([len(x) for x in each], pa.int64()), pa.array(crc, pa.int64()), pa.array(same)]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_pieces", "ids_crc32", "lossless", "ids"][: len(out)])

    return rows


def encode(df: DataFrame, id: str = "doc_id", text: str = "text", model: str | None = None, alpha: float = 1.0, seed: int = 0, with_ids: bool = True) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of unsigned 32-bit ids), lossless (decoding gave the text) and ids of every row.

    A null text counts as empty; an empty text is one space piece.  Repeated rows get equal segmentations; a null
    id draws as id 0.  An empty df gives no rows.  model: a SentencePiece file; by default the public 32k BPE.
    """
    schema = "doc_id long, n_pieces long, ids_crc32 long, lossless boolean" + ", ids array<int>" * with_ids
    source = df.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(id).cast("long").alias("key"))
    return source.mapInArrow(_encode(model, alpha, seed, with_ids), schema)


def decode(df: DataFrame, ids: str = "ids", model: str | None = None) -> DataFrame:
    """df with a column text: what the ids spell (null ids: null; bytes that are no UTF-8 are replaced)."""

    def rows(batches):
        pieces = per_worker(f"pieces {model} 1.0", lambda: Pieces(model, 1.0))
        for batch in batches:
            out = [None if x is None else pieces.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in batch.column(ids).to_pylist()]
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(out, pa.string())], names=[*rest, "text"])

    rest = df.select(*(c for c in df.columns if c != "text"))
    return df.mapInArrow(rows, rest.withColumn("text", F.lit("")).schema)


def op10_ffbs_pieces(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, lossless of every document's sampled segmentation."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)


__all__ = ["Pieces", "encode", "decode", "encode_block", "op10_ffbs_pieces"]
