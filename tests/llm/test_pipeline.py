import os
from collections import Counter

import pytest
from test_jaccard_join import brute

import corpus_pipeline
from factweave.llm import jaccard_join as J
from factweave.llm import language_crf as L

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def kept_by_brute_force(rows):
    """Of each group the row of the smallest id, null ids last; rows without shingles all stay."""
    groups = {}
    for row, (n, root) in zip(rows, brute([r[1] for r in rows], 5, 80)):
        groups.setdefault(root if n else (len(groups), "blank"), []).append(row)
    return [min(((r[0] is None, r[0] or 0) for r in g)) for g in groups.values()], groups


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_null_and_repeated_ids(spark, tmp_path):
    base = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").where("text is not null and n_chars between 300 and 3000").select("doc_id", "text", "lang", "source", "n_chars").orderBy("doc_id").limit(160).collect()]
    some, shared = base[:110], base[0][0]
    for k, (_, *rest) in enumerate(base[110:]):
        some.append((None if k % 2 else shared, *rest))  # null ids, and different texts of one id
    some += [(None, *base[3][1:]), (None, *base[111][1:]), base[4], base[112], (10**6, "12 34", "en", "s", 5), (None, None, "en", "s", None)]
    docs = spark.createDataFrame(some, SCHEMA).repartition(5)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    label = {r.doc_id: r for r in L.label_texts(spark.createDataFrame([(i, r[1]) for i, r in enumerate(some)], "doc_id long, text string"), L._model(docs)).collect()}
    want = [(r[0], r[1], label[i].lang_pred, *r[3:]) for i, r in enumerate(some) if label[i].lang_pred != "und" and label[i].score >= 0.5]
    known = L.known_language_stage(spark, docs, str(tmp_path))
    assert known.columns == docs.columns and Counter(map(tuple, known.collect())) == Counter(want)
    assert sum(r[0] is None for r in want) > 20 and sum(r[0] == shared for r in want) > 20

    ids, groups = kept_by_brute_force(want)
    got = [tuple(r) for r in J.one_of_each_stage(spark, spark.createDataFrame(want, SCHEMA).repartition(3), "").collect()]
    assert Counter((r[0] is None, r[0] or 0) for r in got) == Counter(ids)
    assert all(sum(r in g for r in got) == 1 for g in groups.values())

    packed = corpus_pipeline.run(spark, str(tmp_path)).where("piece = 0").select("doc_id").collect()
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in packed) == Counter(ids)


def test_blank_rows_and_copies_in_the_near_duplicate_stage(spark):
    rows = [(None, "a b c d e f", "en", "s", 11), (None, "A b c d e f", None, "s", 11), (2, "g h i j k l", "en", None, 11), (2, "g h i j k l", None, "en", 11), (2, "g h i j k l", None, "en", 11), (2, "m n o p q r", "en", "s", 11), (3, "", "en", "s", 0), (3, "", "en", "s", 0), (None, None, "en", "s", None)]
    got = [tuple(r) for r in J.one_of_each_stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()]
    assert Counter((r[0], (r[1] or "").lower()) for r in got) == Counter([(None, "a b c d e f"), (2, "g h i j k l"), (2, "m n o p q r"), (3, ""), (3, ""), (None, "")])
