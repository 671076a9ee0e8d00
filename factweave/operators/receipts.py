"""What a transcript's tool events say: receipts, commands, outputs, handles and times, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def well_formed(event: dict[str, Column], receipt: Column, function: str) -> Column:
    """Whether a tool event is a write that its JSON receipt confirms.

    event: function, name, payload (its arguments), namespace (null: not given), error, pending, truncated.  The
    receipt must be accepted, name the same name and, where given, namespace and payload, digest the payload, and
    hold a string namespace and event id.
    """
    return F.transform(F.array(F.try_parse_json(receipt)), lambda r: confirms(event, r, function))[0]  # parsed once


def confirms(event: dict[str, Column], r: Column, function: str) -> Column:
    """well_formed() for a receipt that is parsed already."""
    text = lambda path: F.try_variant_get(r, f"$.{path}", "string")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(r, f"$.{path}", "variant"))
    is_text = lambda path: F.coalesce(kind(path) == "STRING", F.lit(False))
    quiet = (event["function"] == function) & event["error"].isNull() & ~event["pending"] & ~event["truncated"]
    accepted = F.coalesce((kind("accepted") == "BOOLEAN") & F.try_variant_get(r, "$.accepted", "boolean"), F.lit(False))
    agrees = (text("name") == event["name"]) & (event["namespace"].isNull() | (text("namespace") == event["namespace"]))
    digest = (text("sha256") == F.sha2(event["payload"], 256)) & (text("payload").isNull() | (text("payload") == event["payload"]))
    return F.coalesce(quiet & accepted & agrees & digest & is_text("namespace") & is_text("event_id"), F.lit(False))


def claim_key(receipt: Column, ok: Column) -> Column:
    """struct(namespace, name) that a well-formed receipt claims, else null: launches and refusals claim none."""
    part = lambda p: F.try_variant_get(F.try_parse_json(receipt), f"$.{p}", "string")
    return F.when(ok, F.struct(part("namespace").alias("namespace"), part("name").alias("name")))


def launched(error: Column, receipt: Column) -> Column:
    """The job a start call launched, or null."""
    r = F.try_parse_json(receipt)
    job = F.try_variant_get(r, "$.job_id", "string")
    return F.when(error.isNull() & F.coalesce(F.try_variant_get(r, "$.started", "boolean"), F.lit(False)), job)


def command_argument(arguments: Column) -> Column:
    """The first of the arguments cmd, command and code that is a text."""
    a = F.try_parse_json(arguments)
    return F.coalesce(*(F.try_variant_get(a, f"$.{p}", "string") for p in ("cmd", "command", "code")))


#: Programs whose argument after a command flag is what they run.
SHELLS = ("bash", "sh", "zsh", "dash", "python", "python3", "python3.13", "python3.12", "node")
#: A run of white space, a quoted part, an escaped sign or a run of plain signs.
_PIECE = r"""(?s)[ \t\r\n]+|'[^']*'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|\\.|[^ \t\r\n'"\\]+"""


def unwrapped(command: Column, flags: tuple[str, ...] = ("-c", "-lc", "-e"), programs: tuple[str, ...] = SHELLS) -> Column:
    """The argument after the first of the flags, if a shell or interpreter is called with one; other commands as they are.

    Words are parted as a POSIX shell does: quotes and backslashes join what they touch, in double quotes a backslash
    stays but before a quote or backslash.  A command whose quotes don't close is left as it is.
    """
    pieces = F.regexp_extract_all(command, F.lit(_PIECE), F.lit(0))
    mark = F.substring
    plain = lambda p: F.when(p.startswith("'"), F.substring(p, F.lit(2), F.length(p) - 2)).when(p.startswith('"'), F.regexp_replace(F.substring(p, F.lit(2), F.length(p) - 2), r'(?s)\\(["\\])', "$1")).when(p.startswith("\\"), mark(p, 2, 1)).otherwise(p)
    text = lambda c=None: F.lit(c).cast("string")
    start = F.struct(text().alias("word"), text().alias("program"), F.lit(False).alias("armed"), text().alias("run"))

    def close(s):
        """The state after a word has ended: the first is the program, the one after the first flag is what it runs."""
        flagged = ~s["armed"] & s["program"].isNotNull() & s["word"].isin(*flags)
        run = F.when(s["run"].isNull() & s["armed"], s["word"]).otherwise(s["run"])
        done = F.struct(text().alias("word"), F.coalesce(s["program"], s["word"]).alias("program"), (s["armed"] | flagged).alias("armed"), run.alias("run"))
        return F.when(s["word"].isNull(), s).otherwise(done)

    def step(s, p):
        more = F.struct(F.concat(F.coalesce(s["word"], F.lit("")), plain(p)).alias("word"), s["program"].alias("program"), s["armed"].alias("armed"), s["run"].alias("run"))
        return F.when(p.rlike(r"\A[ \t\r\n]"), close(s)).otherwise(more)

    end = F.aggregate(pieces, start, step, close)
    whole = F.length(F.array_join(pieces, "")) == F.length(command)
    known = F.element_at(F.split(end["program"], "/"), -1).isin(*programs)
    asked = command.rlike(r"\s-\w") | command.rlike(r"""['"\\]""")  # a cheap look before words are parted
    return F.when(asked, F.when(whole & known, F.coalesce(end["run"], command)).otherwise(command)).otherwise(command)


def normalised(command: Column) -> Column:
    return F.trim(F.regexp_replace(command, r"\s+", " "))


def prepared(output: Column) -> Column:
    """struct(lines, text) of an output without blank lines and trailing spaces; what same_prepared() compares."""
    lines = F.filter(F.transform(F.split(F.coalesce(output, F.lit("")), "\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x != "")
    return F.struct(F.slice(lines, 1, 3).alias("head"), F.array_join(lines, "\n").alias("text"))


def same_prepared(a: Column, b: Column) -> Column:
    s, t = a["text"], b["text"]
    return F.when((s == "") | (t == ""), F.lit(None).cast("boolean")).otherwise(s.contains(t) | t.contains(s) | (a["head"] == b["head"]))


def same_output(a: Column, b: Column) -> Column:
    """Whether two outputs say the same: blank lines and trailing spaces aside, one holds the other or the first three
    lines are equal; null where either is empty."""
    return same_prepared(prepared(a), prepared(b))


def handles(messages: DataFrame, pattern: str) -> DataFrame:
    """(id, handle) of every match of the pattern's one group in system and user messages (id, role, text)."""
    if re.compile(pattern).groups != 1:
        raise ValueError("a handle pattern has exactly one group")
    return messages.where("role in ('system', 'user')").select("id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("handle"))


def interval(text: Column, uncertainty: Column) -> Column:
    """struct(lo, hi) in epoch seconds of an ISO time with its zone, wider by the uncertainty; null without a zone, and
    open (null bounds) without an uncertainty."""
    zoned = text.rlike(r"(?:Z|[+-]\d\d:\d\d)$")
    t = F.unix_micros(F.try_to_timestamp(text)) / 1e6
    return F.when(zoned & t.isNotNull(), F.struct((t - uncertainty).alias("lo"), (t + uncertainty).alias("hi")))


def family_outcome(confidence: Column, least: float = 0.8) -> Column:
    """supported for the word high or a number of at least least, else ambiguous."""
    return F.when((confidence == "high") | (confidence.try_cast("double") >= least), "supported").otherwise("ambiguous")


def latin1_bytes(body: Column) -> Column:
    """The bytes of a text whose characters stand for one byte each."""
    return F.encode(body, "ISO-8859-1")


def expected_score(probabilities: Column) -> Column:
    """The expectation of a map from score to probability."""
    return F.aggregate(F.map_entries(probabilities), F.lit(0.0), lambda s, e: s + e["key"] * e["value"])
