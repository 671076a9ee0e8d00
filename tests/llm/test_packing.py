import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from factweave.llm import packing as P

TEXTS = [None, "", "  \n", "Hello, World's best... it's <|endoftext|> ok", "É x é ́a ΑΣ ΣΑ Straße ﬁ 日本 a b", "word ### $$$ &&& a1b2 3.14 don't 'S" * 40, "naïve,, café! " * 3000, "x" * 9000, "tab\x1cq\x85z\vw"]


def test_ids_and_places(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS * 3)], "doc_id long, text string, piece int").repartition(3)
    rows = P.pack(df, with_ids=True, group_size=10).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(r.ids) == r.ids_crc32
    for i, t in enumerate(TEXTS * 3):
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        want = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist() == want
        assert [r.start for r in pieces] == list(range(0, len(want), 2048)) and all(r.length == 2048 for r in pieces[:-1])
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048


def test_ids_of_odd_words():
    """Signs that join with the punctuation after them, letters that compose only in one case, one letter that becomes two."""
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["İ WORD É", "(see it). [x], 'a', \"b\"!", "H\u0331 T\u0308", "x\u037e; a\u1fef.", "don't. 'S, 3.14, 50%.", "a<|endoftext|>. B", "ƀɎ! ŉ; ǅ", "e\u0301. ²³,"]
    for together in (texts, *([t] for t in texts)):
        ids, bounds = P.token_ids(pa.array(together), P._Words(tok), None)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [e.ids for e in tok.encode_batch(together, add_special_tokens=False)]


def test_few_sequences():
    lengths = np.minimum(np.random.default_rng(0).lognormal(6, 1, 20_000).astype(int) + 1, 2048)
    bins, _ = P.sum_of_squares(lengths, 2048)
    assert np.bincount(bins, lengths).max() <= 2048
    assert len(np.unique(bins)) < 1.01 * lengths.sum() / 2048


def test_rule_against_plain_search():
    lengths = np.random.default_rng(1).integers(1, 21, 400)
    bins, offset = P.sum_of_squares(lengths, 20)
    gaps = {}
    for s, b, o in zip(lengths.tolist(), bins.tolist(), offset.tolist(), strict=True):
        def cost(old):
            n = defaultdict(int)
            for g in gaps.values():
                n[g] += g > 0
            n[old] -= old < 20
            n[old - s] += old > s
            return sum(v * v for v in n.values())

        choices = {g for g in gaps.values() if g >= s} | {20}
        assert cost(20 - o) == min(map(cost, choices))
        gaps[b] = 20 - o - s


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_rows_of_one_id_are_dealt_out(spark):
    """Equal rows, with a null id, share out over the groups."""
    df = spark.createDataFrame([(None, "one two three")] * 3000, "doc_id long, text string").repartition(4)
    rows = P.pack(df, group_size=500).collect()
    groups = np.bincount([r.sequence_id >> 32 for r in rows])
    assert len(rows) == 3000 and len(groups) == 6 and groups.max() < 600
