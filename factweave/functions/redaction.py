"""Secrets in free and in JSON texts: free text by SQL functions, members of JSON at any depth in one pass of batches."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What names a secret, and the shapes of bearer tokens and keys.
SECRET_KEY = r"(?i)(token|secret|passw(?:or)?d|api[_-]?key|authorization|credential|cookie|private[_-]?key)"
ASSIGNMENT = r"""(?i)\b((?:receipt_)?token|secret|passw(?:or)?d|api[_-]?key)(["']?\s*[:=]\s*["']?)([^\s"',}\]]{6,})"""
BEARER = r"(?i)\b(bearer\s+)([A-Za-z0-9._~+/=-]{8,})"
KEY_SHAPES = r"\b(?:apikey_[A-Za-z0-9_]{16,}|sk-[A-Za-z0-9_-]{20,}|gh[pousr]_\w{20,})"

#: What a text in lower case holds wherever a pattern can match it.
_SIGNS = {ASSIGNMENT: ("token", "secret", "passw", "apikey", "api_key", "api-key"), BEARER: ("bearer",), KEY_SHAPES: ("apikey_", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")}
_TOKEN = r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+'
DEEP = 500  # what is nested deeper stays as it is


def members(text: str) -> tuple[str, int]:
    """(text, n): a JSON text whose members with telling names, however deep, have "[redacted]" for a value, and their number.

    Names decide before values: what stands under such a name goes as a whole, an empty text or null stays.  A text within
    the JSON that is JSON itself is read the same way.  What isn't replaced keeps its layout.
    """
    secret, out, n, done = re.compile(SECRET_KEY), [], 0, 0
    stack: list[bool] = []  # objects (True) and arrays around a token
    name, hidden = None, None  # the member's name that a value belongs to; (depth, start) of a container that goes
    expects = False  # in an object: whether a name comes next
    for m in re.finditer(_TOKEN, text, re.DOTALL):
        t = m.group()
        if t in "{[":
            if hidden is None and name is not None and secret.search(name):
                hidden = (len(stack), m.start())
            stack.append(t == "{")
            name, expects = None, t == "{"
            if len(stack) > DEEP:
                return text, 0
        elif t in "}]":
            stack.pop()
            if hidden and len(stack) == hidden[0]:
                out += [text[done : hidden[1]], '"[redacted]"']
                done, n, hidden = m.end(), n + 1, None
            name, expects = None, False
        elif t == ",":
            name, expects = None, bool(stack) and stack[-1]
        elif t == ":":
            expects = False
        elif expects:
            name = json.loads(t)
        elif hidden is None:
            put, found = None, 1
            if name is not None and secret.search(name):
                put = '"[redacted]"' if t not in ('""', "null") else None
            elif t[0] == '"' and "{" in t and (inner := json.loads(t)).lstrip()[:1] in ("{", "[") and _valid(inner):
                inner, found = members(inner)
                put = json.dumps(inner, ensure_ascii=False) if found else None
            if put is not None:
                out += [text[done : m.start()], put]
                done, n = m.end(), n + found
    return ("".join([*out, text[done:]]), n) if n else (text, 0)


def _valid(text: str) -> bool:
    try:
        return isinstance(json.loads(text), dict | list)
    except (ValueError, RecursionError):
        return False


def _each(texts: pd.Series) -> pd.DataFrame:
    """For rows that aren't null: members(), where the text is JSON."""
    found = [members(t) if t is not None and _valid(t) else (t, 0) for t in texts]
    return pd.DataFrame(found, columns=["text", "n"])


def redacted(text: Column) -> Column:
    """(text, n): text without its secrets, and how many were replaced; both are null for a null text.

    In a text that is a JSON object or array the values of members with telling names go first, at any depth; then, in
    every text, values assigned to telling names, bearer tokens and keys by shape.  Only texts that begin like JSON and
    hold such a name leave the JVM, and only texts that hold a pattern's signs are searched for it.
    """
    low = F.lower(text)
    json_like = text.rlike(r"\A\s*[{\[]") & (low.rlike(SECRET_KEY) | low.contains("\\u"))  # names may be escaped
    seen = F.pandas_udf(_each, "text string, n long")(F.when(json_like, text))
    n, out = F.when(json_like, seen["n"]).otherwise(F.lit(0)), F.when(json_like, seen["text"]).otherwise(text)
    for pattern, by in ((ASSIGNMENT, "$1$2[redacted]"), (BEARER, "$1[redacted]"), (KEY_SHAPES, "[redacted]")):
        has = F.lit(False)
        for sign in _SIGNS[pattern]:
            has |= low.contains(sign)
        n, out = n + F.when(has, F.regexp_count(out, F.lit(pattern))).otherwise(F.lit(0)), F.when(has, F.regexp_replace(out, pattern, by)).otherwise(out)
    return F.struct(out.alias("text"), F.when(text.isNotNull(), n.cast("long")).alias("n"))
