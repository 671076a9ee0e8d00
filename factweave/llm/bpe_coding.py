"""Encoding with byte-pair vocabularies by batched merge rounds, and decoding.

A block's texts fall into units that no merge crosses, each distinct one encoded once.  The symbols of all units stand
in one flat array; a round looks up every adjacent pair by binary search over the sorted pair keys, takes each unit's
lowest rank and merges its places at once, leftmost first where they overlap.  That is what merging one place at a
time gives, as long as no merge with the new symbol ranks before the one just made; the few ranks for which the
vocabulary breaks that rule are merged one place a round.  Units are cut further where no token of the vocabulary
holds the two bytes side by side, so long runs take few rounds.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import byte_column, lean, per_worker, row_blocks

BLOCK_BYTES = 4 << 20
NEVER = np.iinfo(np.int32).max

#: How byte-level vocabularies write the 256 bytes, printable ones as themselves, the others from U+0100 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_CHAR = {b: chr(b) for b in _PLAIN} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in _PLAIN)}
_BYTE = {ord(c): b for b, c in _CHAR.items()}
#: The steps before the model for which words are cut without the library.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_STEPS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Code points from here on, and the one letter below that becomes two, are left to the library.
FAR, TWO = 0x250, 0x130
LETTER, DIGIT, OTHER, SPACE = range(4)


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[0], start[0] + 1, ... for each of the runs in turn."""
    ends = np.cumsum(length)
    return np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


class Vocabulary:
    """Merges, symbols and the steps before and after them, of a tokenizer file with a byte-level BPE model."""

    def __init__(self, path: str | None):
        import public_tokenizers
        from tokenizers import Tokenizer

        path = path or public_tokenizers.path("word_bpe_49k.json")
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout"):
            raise ValueError(f"{path} holds no plain byte-level BPE")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        into = np.array([vocab[a + b if not suffix else a.removesuffix(suffix) + b] for a, b in merges], np.int64)
        rank = np.arange(len(merges))
        used = np.full(max(vocab.values()) + 1, NEVER)
        np.minimum.at(used, left, rank)
        np.minimum.at(used, right, rank)
        self.into, self.alone = into, used[into] < rank
        order = np.argsort(left << 32 | right)
        self.keys, self.rank = (left << 32 | right)[order], rank[order].astype(np.int32)
        self.inner = np.array([vocab[_CHAR[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[_CHAR[b] + suffix] for b in range(256)], np.int64)
        self.joined = np.zeros((256, 256), bool)
        for token in vocab:
            raw = [_BYTE.get(ord(c), 0) for c in token.removesuffix(suffix)] if suffix else [_BYTE.get(ord(c), 0) for c in token]
            self.joined[raw[:-1], raw[1:]] = True
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        decoder = (spec.get("decoder") or {}).get("type")
        if decoder not in (None, "ByteLevel"):
            raise ValueError(f"{path} has the decoder {decoder}")
        self.gap = b"" if decoder else b" "
        plain = lambda t: bytes(_BYTE[ord(c)] for c in t) if decoder and all(ord(c) in _BYTE for c in t) else t.encode()
        self.token = pa.array([plain(names.get(i, "")) for i in range(max(names) + 1)], pa.large_binary())
        pre = spec.get("pre_tokenizer") or {}
        stages = pre.get("pretokenizers") or [pre]
        self.by_words = (
            (spec.get("normalizer") or {}).get("normalizers") == _STEPS and len(stages) == 2 and stages[0].get("pattern") == {"Regex": _PATTERN}
            and stages[0].get("invert") and stages[0].get("behavior") == "Removed" and stages[1].get("use_regex") is False and not stages[1].get("add_prefix_space")
        )
        self.lower, self.kind = np.arange(FAR, dtype=np.uint32), np.full(FAR, OTHER, np.int8)
        for c in range(FAR):
            low = chr(c).lower() if c != TWO else chr(c)
            self.lower[c] = ord(low)
            self.kind[c] = {"L": LETTER, "N": DIGIT}.get(unicodedata.category(low)[0], OTHER)
        self.kind[[*range(9, 14), 32, 0x85, 0xA0]] = SPACE

    # units

    def _odd(self, text: str) -> list:
        """The units of a text as bytes, special tokens as their ids, by the library's steps before the model."""
        out, at = [], 0
        for m in [*(self.cut.finditer(text) if self.cut else ()), None]:
            part = text[at : m.start() if m else len(text)]
            if part:
                if self.library.normalizer:
                    part = self.library.normalizer.normalize_str(part)
                out += [bytes(_BYTE[ord(c)] for c in unit) for unit, _ in self.library.pre_tokenizer.pre_tokenize_str(part)]
            if m:
                out.append(self.special[m.group()])
                at = m.end()
        return out

    def _near(self, words: pa.Array):
        """(bytes, unit starts, word of each unit) of words below U+0250."""
        code = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
        length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        word = np.repeat(np.arange(len(words)), length)
        code, kind = self.lower[code], self.kind[code]
        n = len(code)
        new = np.ones(n, bool)
        new[1:] = (word[1:] != word[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        left = np.cumsum(length)[word] - np.arange(n) if n else word  # code points from here to the word's end
        quote = np.flatnonzero((code == 39) & (left > 1))
        quote = quote[(quote == 0) | new[quote]]  # inside a run of other signs it starts nothing
        padded = np.concatenate([code, np.zeros(2, np.uint32)])
        one, two = padded[quote + 1], padded[quote + 2]
        two = np.where(left[quote] > 2, two, 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        for at, size in ((quote[short], 2), (quote[long], 3)):
            new[at + 1] = False
            after = at + size
            after = after[after < n]
            new[after] = True
        raw = np.frombuffer(code.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        size = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF)
        at, first = np.cumsum(size) - size, np.flatnonzero(new)
        end = np.append(at[first[1:]], len(raw)) if len(first) else first
        real = kind[first] != SPACE
        return raw, at[first][real], end[real], word[first][real]

    def units(self, words: pa.Array):
        """(distinct units, the units of all words in turn, each word's first and number of units); special tokens are
        numbered after the distinct units, in the order of self.special."""
        text = words.to_pylist() if not self.by_words else None
        odd = np.ones(len(words), bool)
        if self.by_words and len(words):
            data, offsets = byte_column(words)
            far = np.concatenate([[0], np.cumsum(data >= 0xC9)])  # lead bytes of U+0240 and above
            odd = far[offsets[1:]] > far[offsets[:-1]]
            for t in ["İ", *self.special]:
                odd |= pc.match_substring(words, t).to_numpy(zero_copy_only=False)
        raw, start, end, word = self._near(words.filter(pa.array(~odd)))
        rest = [self._odd(t) for t in (words.filter(pa.array(odd)).to_pylist() if text is None else text)]
        more = [u for units in rest for u in units]
        extra = b"".join(u for u in more if isinstance(u, bytes))
        sizes = np.array([len(u) for u in more if isinstance(u, bytes)], np.int64)
        begin = np.concatenate([start, len(raw) + np.cumsum(sizes) - sizes])
        size = np.concatenate([end - start, sizes])
        whole = np.concatenate([raw, np.frombuffer(extra, np.uint8)])[spread(begin, size)]
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(whole)])
        coded = column.dictionary_encode()
        which, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        number = {i: len(distinct) + k for k, i in enumerate(self.special.values())}
        flat, tail = np.empty(len(start) + len(more), np.int64), iter(which[len(start) :].tolist())
        flat[: len(start)] = which[: len(start)]
        flat[len(start) :] = [next(tail) if isinstance(u, bytes) else number[u] for u in more]
        count, first = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        count[~odd] = np.bincount(word, minlength=int((~odd).sum()))
        count[odd] = [len(u) for u in rest]
        for mask, base in ((~odd, 0), (odd, len(start))):
            first[mask] = base + np.cumsum(count[mask]) - count[mask]
        return distinct, flat, first, count

    # merges

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NEVER)

    def merged(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units in turn, their number for each unit)."""
        data, offsets = byte_column(units)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.diff(offsets)
        unit = np.repeat(np.arange(len(units)), np.diff(offsets))
        symbol = self.inner[data]
        symbol[offsets[1:][np.diff(offsets) > 0] - 1] = self.final[data[offsets[1:][np.diff(offsets) > 0] - 1]]
        cut = np.ones(n, bool)
        cut[1:] = (unit[1:] != unit[:-1]) | ~self.joined[data[:-1], data[1:]]
        place, part = np.arange(n), np.cumsum(cut) - 1  # place: the first byte of a symbol
        rank = np.full(n, NEVER, np.int32)
        inside = np.flatnonzero(part[1:] == part[:-1])
        rank[inside] = self._ranks(symbol[inside], symbol[inside + 1])
        done = []
        while len(symbol):
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            low = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(part))))
            live = low < NEVER
            done.append((place[~live], symbol[~live]))
            place, symbol, part, rank, low = place[live], symbol[live], part[live], rank[live], low[live]
            hit = np.flatnonzero(rank == low)
            if not len(hit):
                break
            run = np.append(True, np.diff(hit) > 1)  # in a run of overlapping places every other one is merged
            hit = hit[(np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))) % 2 == 0]
            single = self.alone[rank[hit]]
            if single.any():
                again = np.append(False, part[hit][1:] == part[hit][:-1])
                hit = hit[~(single & again)]
            symbol[hit] = self.into[rank[hit]]
            stay = np.ones(len(symbol), bool)
            stay[hit + 1] = False
            moved = (np.cumsum(stay) - 1)[hit]
            place, symbol, part, rank = place[stay], symbol[stay], part[stay], rank[stay]
            changed = np.zeros(len(symbol) + 1, bool)
            changed[moved] = changed[moved - 1] = True  # the place before the first is the spare one at the end
            near = np.flatnonzero(changed[:-1])
            ok = near < len(symbol) - 1
            ok[ok] = part[near[ok]] == part[near[ok] + 1]
            rank[near[~ok]] = NEVER
            rank[near[ok]] = self._ranks(symbol[near[ok]], symbol[near[ok] + 1])
        place, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place, kind="stable")
        return symbol[order], np.bincount(unit[place], minlength=len(units))

    # texts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn as unsigned 32-bit numbers, offsets of the texts); null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.by_words:
            split = pc.ascii_split_whitespace(texts)
            flat, bounds = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
        else:
            flat, bounds = texts, np.arange(len(texts) + 1)
        coded = flat.dictionary_encode()
        distinct, of_word, first, count = self.units(coded.dictionary)
        ids, n = self.merged(distinct)
        ids, n = np.concatenate([ids, [*self.special.values()]]).astype("<u4"), np.concatenate([n, np.ones(len(self.special), np.int64)])
        start, pick = np.cumsum(n) - n, of_word[spread(first, count)]
        ids = ids[spread(start[pick], n[pick])]  # the distinct words' ids, side by side
        ends = np.concatenate([[0], np.cumsum(n[pick])])
        at = np.concatenate([[0], np.cumsum(count)])
        start, n = ends[at[:-1]], ends[at[1:]] - ends[at[:-1]]
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(n[which])])
        return ids[spread(start[which], n[which])], ends[bounds]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The texts of runs of ids, bounds being their offsets; ids that the vocabulary lacks are left out."""
        known = np.isin(ids, np.arange(len(self.token)))
        if not known.all():
            bounds = np.concatenate([[0], np.cumsum(known)])[bounds]
            ids = ids[known]
        column = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), self.token.take(pa.array(ids.astype(np.int64))))
        raw = pc.binary_join(column, pa.scalar(self.gap, pa.large_binary()))
        try:
            return raw.cast(pa.large_string())
        except pa.ArrowInvalid:  # tokens need not end at characters
            return pa.array([x.decode(errors="replace") for x in raw.to_pylist()], pa.large_string())


def _vocabulary(path: str | None) -> Vocabulary:
    return per_worker(f"vocabulary {path}", lambda: Vocabulary(path))


def _runs(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 4).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())


def _encode(path: str | None, decoded: bool):
    def rows(batches):
        model = _vocabulary(path)
        for batch in batches:
            _, offsets = byte_column(batch.column(1))
            for lo, hi in row_blocks(offsets, BLOCK_BYTES):
                ids, bounds = model.encode(batch.column(1).slice(lo, hi - lo))
                text = model.decode(ids, bounds).cast(pa.string()) if decoded else pa.nulls(hi - lo, pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds)), _runs(ids, bounds), text], names=["doc_id", "n_tokens", "ids", "decoded"])

    return rows


def _decode(path: str | None):
    def rows(batches):
        model = _vocabulary(path)
        for batch in batches:
            data, offsets = byte_column(batch.column(1))
            for lo, hi in row_blocks(offsets, BLOCK_BYTES):
                ids = np.frombuffer(data[offsets[lo] : offsets[hi]].tobytes(), "<u4")
                text = model.decode(ids, (offsets[lo : hi + 1] - offsets[lo]) // 4)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), text.cast(pa.string())], names=["doc_id", "text"])

    return rows


def encode(df: DataFrame, id: str = "doc_id", text: str = "text", tokenizer: str | None = None, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids, decoded of every row: ids as little-endian unsigned 32-bit numbers, and the text that they
    decode to if decoded, else null.

    The ids are those of the tokenizers library without special tokens added; the strings of special tokens in a text
    become their ids.  A null text counts as empty and has no ids.  Rows are judged one by one, so repeated rows and ids
    and null ids stay as they are, further columns of df are not looked at, and an empty df gives no rows.
    tokenizer: a file of a byte-level BPE, by default the public word BPE.
    """
    rows = df.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(_encode(tokenizer, decoded)), f"doc_id {kind}, n_tokens long, ids binary, decoded string")


def decode(df: DataFrame, id: str = "doc_id", ids: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """doc_id and the text of every row's ids (as encode() gives them; null: an empty text)."""
    rows = df.select(F.col(id).alias("doc_id"), F.col(ids).alias("ids"))
    return rows.mapInArrow(lean(_decode(tokenizer)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def op12_bpe_coding(spark, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text that they decode to."""
    rows = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), decoded=True)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


__all__ = ["encode", "decode", "op12_bpe_coding"]
