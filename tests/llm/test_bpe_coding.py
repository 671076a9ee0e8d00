import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from factweave.llm import bpe_coding as B

ODD = [
    None, "", "  \n", "Hello, World's best... it's <|endoftext|> ok", "a<|startoftext|>b's<|endoftext|>", "É x é ́a ΑΣ ΣΑ Straße ﬁ 日本 a b İstanbul IŞIK",
    "word ### $$$ &&& a1b2 3.14 don't 'S \"'s 's's we'll'x I'VE 'r 're" * 4, "naïve,, café! " * 300, "x" * 9000, "tab\x1cq\x85z\vw\xa0a", "".join(map(chr, range(1, 0x300))),
    " ".join(chr(c) + "a" + chr(c) for c in range(1, 0x600)), "'", "''s", "a'", "ab" * 5000 + "the" * 3000, "😀 👍🏽x",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_against_the_library(name):
    path, rng = public_tokenizers.path(name), random.Random(0)
    tokenizer, model = Tokenizer.from_file(path), B.Vocabulary(path)
    texts = ODD + ["".join(rng.choice("abc'stmdrelv 12.,!éÉ́\n") for _ in range(60)) for _ in range(500)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x250), rng.randrange(0x250, 0xD7FF), 0x1F600 + rng.randrange(50)])) for _ in range(40)) for _ in range(500)]
    ids, bounds = model.encode(pa.array(texts))
    back = model.decode(ids, bounds).to_pylist()
    for k, text in enumerate(texts):
        want = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert ids[bounds[k] : bounds[k + 1]].tolist() == want
        assert back[k] == tokenizer.decode(want, skip_special_tokens=False)


def test_one_by_one_where_ranks_fall():
    """A vocabulary whose merges give a symbol that ranks before them is merged one place a round."""
    model = B.Vocabulary(None)
    a, b, c, d, ab, abc, abcd = range(7)
    model.keys, model.rank = np.array([a << 32 | b, abc << 32 | d, ab << 32 | c]), np.array([0, 1, 2], np.int32)
    order = np.argsort(model.keys)
    model.keys, model.rank, model.into, model.alone = model.keys[order], model.rank[order], np.array([ab, abcd, abc]), np.array([False, False, True])
    model.inner = model.final = np.array([0] * 97 + [a, b, c, d] + [0] * 155)
    model.joined = np.ones((256, 256), bool)
    ids, n = model.merged(pa.array([b"abcabcd", b"abcdabcabcd", b"", b"dcba"], pa.large_binary()))

    def plain(word):
        s, rank = [{97: a, 98: b, 99: c, 100: d}[x] for x in word], {(a, b): (0, ab), (abc, d): (1, abcd), (ab, c): (2, abc)}
        while hits := [(rank[p][0], k) for k, p in enumerate(zip(s, s[1:], strict=False)) if p in rank]:
            k = min(hits)[1]
            s[k : k + 2] = [rank[s[k], s[k + 1]][1]]
        return s

    assert ids.tolist() == [x for w in (b"abcabcd", b"abcdabcabcd", b"", b"dcba") for x in plain(w)] and n.sum() == len(ids)


def test_rows(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(i if i != 3 else None, t, 1, "c") for i, t in enumerate(ODD)] + [(0, ODD[0], 1, "c"), (5, ODD[5], 1, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string").repartition(3)
    coded = B.encode(df, decoded=True)
    out = coded.collect()
    assert len(out) == len(rows)
    for r in out:
        want = tokenizer.encode(ODD[3 if r.doc_id is None else r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want) and r.decoded == tokenizer.decode(want, skip_special_tokens=False)
    assert sorted(r.text for r in B.decode(coded).collect()) == sorted(r.decoded for r in out)
    assert B.encode(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in B.op12_bpe_coding(spark, sf).collect():
        ids = tokenizer.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
