from collections import Counter

import numpy as np
import pyarrow as pa

from factweave.llm import piece_sampling as S

TEXTS = [None, "", " ", "  two  spaces ", "hello world", "the ▁ bar ▁▁x", "tab\t\nline\r\n\x00 end", "日本語テキスト 🎉 é ñ", "a" * 5000, "word " * 3000, "mixed <0x0A> <s> </s> <unk>"]


def test_round_trip_and_reproducible(spark):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int")
    one = {r.doc_id: r for r in S.encode(df.repartition(4)).collect()}
    two = {r.doc_id: r.ids for r in S.encode(df.coalesce(1)).collect()}
    other = {r.doc_id: r.ids for r in S.encode(df, seed=9).collect()}
    assert all(r.lossless and list(r.ids) == list(two[i]) and r.n_pieces == len(r.ids) for i, r in one.items())
    assert other[9] != two[9]
    back = {r.doc_id: r.text for r in S.decode(S.encode(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert S.encode(df.limit(0)).collect() == []


def test_distribution_against_enumeration():
    pieces = S.Pieces(None, 0.4)
    names = {i: b.decode() for i, b in enumerate(pieces.bytes) if b and i > 258}

    def walk(rest):
        if not rest:
            return [((), 1.0)]
        out = []
        for i, n in names.items():
            if rest.startswith(n):
                out += [((i, *t), pieces.weight[i] * w) for t, w in walk(rest[len(n) :])]
        return out

    paths = walk(" then")
    total = sum(w for _, w in paths)
    n = 20_000
    ids, bounds = S.encode_block(pa.array(["then"] * n), np.arange(n), pieces, 3)
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:]))
    assert set(seen) <= {p for p, _ in paths}
    for p, w in paths:
        q = w / total
        assert abs(seen[p] / n - q) < 5 * (q * (1 - q) / n) ** 0.5 + 1e-3
