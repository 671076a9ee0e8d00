"""Language of every word and text by a linear-chain conditional random field.

A word's features are hashed byte n-grams with its boundaries, affixes, the word itself and its membership in
lexicons drawn from the training texts; transitions between neighbouring words' languages are learned with them.
A run without ASCII white space of more than RUN bytes is cut between characters into several words that cover it
whole, so texts written without spaces are read to their end.
The field is fitted by gradient steps on forward-backward marginals, on a bounded sample of whole labelled
texts whose spans are spliced into code-switched sequences.  All texts are labelled by forward-backward over all
their words; a text's language is the one of the most expected words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm.common import M1, U64, Rolling, byte_column, lean, row_blocks, trim

BLOCK_BYTES = 3 << 19
WORD_BYTES = 1 << 18
TABLE = 1 << 18
LEXICON = 4000
RUN = 48


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts and the offsets of each text's own; runs of over RUN bytes are cut into words."""
    split = pc.ascii_split_whitespace(texts)
    data, offsets = byte_column(split.flatten())
    pieces = np.maximum(-(-np.diff(offsets) // RUN), 1)
    before = np.concatenate([[0], np.cumsum(pieces)])
    word = np.repeat(np.arange(len(pieces)), pieces)
    begin = offsets[word] + (np.arange(len(word)) - before[word]) * RUN
    for _ in range(3):  # back to the first byte of a character
        inside = np.flatnonzero(begin > offsets[word])
        inside = inside[(data[begin[inside]] & 0xC0) == 0x80]
        begin[inside] -= 1
    ends = np.append(begin, offsets[-1])
    words = pa.Array.from_buffers(pa.large_string(), len(word), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
    lists = split.offsets.to_numpy().astype(np.int64)
    return words.cast(pa.string()), before[lists - lists[0]]


class Features:
    """Hashed features of distinct words: (word index of each feature, feature id), ordered by word."""

    def __init__(self, lexicons: list[np.ndarray]):
        self.roll, self.lexicons = Rolling(23), lexicons

    @staticmethod
    def framed(words: pa.Array):
        data, offsets = byte_column(pc.binary_join_element_wise("\x01", pc.utf8_lower(words), "\x02", ""))
        return data[offsets[0] : offsets[-1]], offsets - offsets[0]

    def word_hash(self, words: pa.Array) -> np.ndarray:
        data, offsets = self.framed(words)
        return self.roll.of(self.roll.over(data), offsets[:-1], offsets[1:])

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = self.framed(words)
        sums, start, end = self.roll.over(data), offsets[:-1], offsets[1:]
        size, index, owners, ids = end - start, np.arange(len(words)), [], []

        def add(owner, value, kind):
            owners.append(owner)
            ids.append(((value + U64(kind * int(M1) % 2**64)) >> U64(20)) % U64(TABLE))

        for n in (2, 3, 4):  # n-grams; the first and last hold the boundary
            count = np.maximum(size - n + 1, 0)
            owner = np.repeat(index, count)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + start[owner]
            add(owner, self.roll.of(sums, at, at + n), n)
        for n in (4, 6):  # affixes
            long = np.flatnonzero(size >= n)
            add(long, self.roll.of(sums, start[long], start[long] + n), 10 + n)
            add(long, self.roll.of(sums, end[long] - n, end[long]), 20 + n)
        whole = self.roll.of(sums, start, end)
        add(index, whole, 31)
        for k, lexicon in enumerate(self.lexicons):
            inside = np.flatnonzero(np.isin(whole, lexicon))
            add(inside, np.full(len(inside), k * int(M1) % 2**64, U64), 40)
        owner, ids = np.concatenate(owners), np.concatenate(ids).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        return owner[order], ids[order]

    def emissions(self, words: pa.Array, weights: np.ndarray) -> np.ndarray:
        """Scores (word, language), over blocks of words of WORD_BYTES."""
        out = np.zeros((len(words), weights.shape[1]), np.float32)
        for lo, hi in row_blocks(byte_column(words)[1], WORD_BYTES):
            owner, ids = self.of(words.slice(lo, hi - lo))
            first = np.searchsorted(owner, np.arange(hi - lo))  # every word has a feature
            out[lo:hi] = np.add.reduceat(weights[ids], first, axis=0)
        return out


def forward_backward(score: np.ndarray, row: np.ndarray, rows: int, transition: np.ndarray):
    """Marginals (word, language) of the sequences given by row (ascending), and the pairwise expectations.

    All sequences step together, longest first, so a step's work is one product for all of them.
    """
    n = np.bincount(row, minlength=rows)
    rank = np.empty(rows, np.int64)
    by_size = np.argsort(-n, kind="stable")
    rank[by_size] = np.arange(rows)
    first = np.cumsum(n) - n
    t = np.arange(len(row)) - first[row]
    order = np.lexsort((rank[row], t))
    live = np.bincount(t) if len(t) else np.zeros(0, np.int64)
    cut = np.concatenate([[0], np.cumsum(live)])
    psi = np.exp(score - score.max(1, keepdims=True))[order].astype(np.float64)
    step = np.exp(transition).astype(np.float64)
    alpha, beta = np.empty_like(psi), np.ones_like(psi)
    for k in range(len(live)):
        a = psi[cut[k] : cut[k + 1]] * (alpha[cut[k - 1] : cut[k - 1] + live[k]] @ step) if k else psi[: cut[1]]
        alpha[cut[k] : cut[k + 1]] = a / a.sum(1, keepdims=True)
    pair = np.zeros_like(step)
    for k in range(len(live) - 2, -1, -1):
        m = live[k + 1]
        right = psi[cut[k + 1] : cut[k + 2]] * beta[cut[k + 1] : cut[k + 2]]
        b = right @ step.T
        z = (alpha[cut[k] : cut[k] + m] * b).sum(1, keepdims=True)
        pair += step * (alpha[cut[k] : cut[k] + m].T @ (right / z))
        beta[cut[k] : cut[k] + m] = b / b.sum(1, keepdims=True)
    gamma = alpha * beta
    out = np.empty_like(gamma)
    out[order] = gamma / gamma.sum(1, keepdims=True)
    return out, pair


def train(texts: list[str], langs: list[str], steps: int = 240, batch: int = 96, seed: int = 1) -> dict:
    """The field's languages, weights, transitions and lexicons, from whole labelled texts."""
    names = sorted(set(langs))
    if not names:
        return {"names": [], "weights": None, "transition": None, "lexicons": []}
    rng = np.random.default_rng(seed)
    flat, ends = tokens(pa.array(texts, pa.string()))
    flat = flat.dictionary_encode()
    words, code = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    label = np.repeat(np.array([names.index(x) for x in langs]), np.diff(ends))
    counts = np.zeros((len(words), len(names)))
    np.add.at(counts, (code, label), 1)
    rate = (counts + 0.1) / counts.sum(0)
    share = rate / rate.sum(1, keepdims=True)
    plain = Features([]).word_hash(words)
    lexicons = [np.sort(plain[np.argsort(-np.where(share[:, k] > 0.8, counts[:, k], 0), kind="stable")[:LEXICON]]) for k in range(len(names))]
    features = Features(lexicons)
    parts = []
    for lo, hi in row_blocks(byte_column(words)[1], WORD_BYTES):  # in blocks: the driver's memory is small
        owner, some = features.of(words.slice(lo, hi - lo))
        parts.append(((owner + lo).astype(np.int32), some.astype(np.int32)))
    owner, ids = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int32),) * 2
    begin = np.searchsorted(owner, np.arange(len(words) + 1))
    del owner, parts
    shape = (TABLE, len(names))
    weights, mean, square = (np.zeros(shape, np.float32) for _ in range(3))
    transition = np.zeros((len(names), len(names)))
    t_mean, t_square = np.zeros_like(transition), np.zeros_like(transition)
    full = np.flatnonzero(np.diff(ends) > 0)
    by_lang = [full[[langs[i] == x for i in full]] for x in names]
    by_lang = [x for x in by_lang if len(x)]
    for k in range(1, steps + 1):
        at, row = [], []
        for s in range(batch):  # spans of one to four texts, each of any language
            for _ in range(int(rng.integers(1, 5))):
                i = rng.choice(by_lang[rng.integers(len(by_lang))])
                n = min(int(rng.integers(4, 30)), ends[i + 1] - ends[i])
                a = int(rng.integers(ends[i], ends[i + 1] - n + 1))
                at.append(np.arange(a, a + n))
                row.append(np.full(n, s))
        at, row = np.concatenate(at), np.concatenate(row)
        used, local = np.unique(code[at], return_inverse=True)
        f = np.concatenate([ids[begin[u] : begin[u + 1]] for u in used])
        n = begin[used + 1] - begin[used]
        score = np.add.reduceat(weights[f], np.cumsum(n) - n, axis=0)[local]
        gamma, pair = forward_backward(score, row, batch, transition)
        gold = np.zeros_like(gamma)
        gold[np.arange(len(at)), label[at]] = 1
        grad_word = np.zeros((len(used), len(names)))
        np.add.at(grad_word, local, gamma - gold)
        touched, where = np.unique(f, return_inverse=True)
        grad = np.zeros((len(touched), len(names)))
        np.add.at(grad, where, np.repeat(grad_word, n, axis=0))
        grad = grad / len(at) * 100 + 1e-3 * weights[touched]
        mean[touched] = 0.9 * mean[touched] + 0.1 * grad
        square[touched] = 0.99 * square[touched] + 0.01 * grad**2
        rate = 0.05 * (1 - k / (steps + 1))
        weights[touched] -= rate * mean[touched] / (np.sqrt(square[touched]) + 1e-3)
        same = row[1:] == row[:-1]
        seen = np.zeros_like(transition)
        np.add.at(seen, (label[at][:-1][same], label[at][1:][same]), 1)
        t_grad = (pair - seen) / len(at) * 10 + 1e-3 * transition
        t_mean, t_square = 0.9 * t_mean + 0.1 * t_grad, 0.99 * t_square + 0.01 * t_grad**2
        transition -= rate * t_mean / (np.sqrt(t_square) + 1e-3)
    return {"names": names, "weights": weights, "transition": transition, "lexicons": lexicons}


def _label(model, detail: bool, carry: dict[str, int]):
    def rows(batches):
        m = model.value
        names, features = m["names"], Features(m["lexicons"])
        for batch in batches:
            _, offsets = byte_column(batch.column(1))
            for lo, hi in row_blocks(offsets, BLOCK_BYTES):
                text = pc.fill_null(batch.column(1).slice(lo, hi - lo), "")
                has = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False) if names else np.zeros(hi - lo, bool)
                share = np.zeros((hi - lo, max(1, len(names))))
                words, ends = tokens(text)
                flat = words.dictionary_encode()
                best = np.zeros(0, np.int64)
                if names and len(flat):
                    row = np.repeat(np.arange(hi - lo), np.diff(ends))
                    code = flat.indices.to_numpy(zero_copy_only=False)
                    counts = pc.match_substring_regex(flat.dictionary, r"\p{L}").to_numpy(zero_copy_only=False)[code]
                    gamma, _ = forward_backward(features.emissions(flat.dictionary, m["weights"])[code], row, hi - lo, m["transition"])
                    best = gamma.argmax(1)
                    for k in range(len(names)):
                        share[:, k] = np.bincount(row, np.where(counts, gamma[:, k], 0), hi - lo)
                total = share.sum(1)
                share /= np.where(total > 0, total, 1)[:, None]
                top = share.argmax(1)
                lang = pa.array([names[k] if ok else "und" for k, ok in zip(top, has, strict=True)], pa.string())
                score = pa.array(np.clip(np.where(has, share[np.arange(hi - lo), top], 0.0), 0, 1))
                out = [batch.column(0).slice(lo, hi - lo), lang, score]
                if detail:
                    tags = pa.array(np.array(names or ["und"], object)[best], pa.string()) if names else pa.array(["und"] * len(flat), pa.string())
                    out += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (words, tags)]
                names_out = ["doc_id", "lang_pred", "score", "words", "word_langs"][: len(out)] + list(carry)
                yield pa.RecordBatch.from_arrays(out + [batch.column(k).slice(lo, hi - lo) for k in carry.values()], names=names_out)

    return rows


def sample(df: DataFrame, per_lang: int, id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], list[str]]:
    """per_lang whole texts at most of every non-null language, taken by the hash of their ids; rows of one id are ranked
    by their texts' hashes, and equal rows count once, so what comes here is per_lang rows a language whatever repeats."""
    known = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(id).alias("i"), F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(text).alias("th"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("i"), "i", "th"))
    chosen = known.select("i", "l", "th").distinct().withColumn("rank", rank).where(f"rank <= {int(per_lang)}").select(F.col("i").alias("ci"), F.col("l").alias("cl"), F.col("th").alias("ct"))
    same = F.col("i").eqNullSafe(F.col("ci")) & (F.col("l") == F.col("cl")) & (F.col("th") == F.col("ct"))
    rows = known.join(F.broadcast(chosen), same, "left_semi").groupBy("i", "l", "th").agg(F.first("t").alias("t")).select("t", "l", F.xxhash64("i").alias("h")).toArrow()
    rows = rows.sort_by([("h", "ascending"), ("l", "ascending"), ("t", "ascending")])
    return rows.column("t").to_pylist(), rows.column("l").to_pylist()


def label_texts(df: DataFrame, model: dict, id: str = "doc_id", text: str = "text", detail: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score of every row; with detail also its words (see tokens()) and the language of each.

    score is the share of the text's lettered words that the field expects to be of lang_pred.  A null text, one
    without a letter, and any text under a model without languages is `und` with score 0.  Ties go to the first
    language by name.  Rows may repeat; an empty df gives no rows.
    carry names further columns of df that each row keeps; text goes to Python once.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, lang_pred string, score double" + ", words array<string>, word_langs array<string>" * detail
    more = [c for c in carry if c != text]
    given = df.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *(F.col(c).alias(f"carry_{c}") for c in more))
    types = dict(zip(more, (f.dataType.simpleString() for f in given.schema[2:]), strict=True)) | {text: "string"}
    at = {c: 1 if c == text else 2 + more.index(c) for c in carry}
    return given.mapInArrow(lean(_label(shared, detail, at)), schema + "".join(f", `{c}` {types[c]}" for c in carry))


PER_LANG = 300


def _model(docs: DataFrame) -> dict:
    """A field fitted on PER_LANG texts of each language whose crc32(doc_id) mod 4 isn't 2."""
    model = train(*sample(docs.where(_remainder() != 2), PER_LANG))
    trim()
    return model


def _remainder():
    return F.crc32(F.col("doc_id").cast("string")) % 4


def op7_language_crf(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return label_texts(docs, _model(docs)).select("doc_id", F.coalesce(_remainder() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def known_language_stage(spark, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Pipeline stage: documents of a learned language with a score of least or more; lang becomes the prediction.

    Each row is judged by its own text, whatever its id: null and repeated ids stay.
    """
    found = label_texts(docs, _model(docs), carry=("text", "source", "n_chars")).where(f"lang_pred <> 'und' and score >= {least}")
    return found.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


__all__ = ["train", "sample", "label_texts", "forward_backward", "op7_language_crf", "known_language_stage"]
