"""Transcripts as cited tables: sessions, tool events, executions, messages, handles and jobs, from one scan.

A source is JSON Lines.  A line names its transcript (transcript_id) and holds lists of events and messages, or one
event or message, nested as their writers nest them.  Lines are parsed once; each item becomes the few facts it states,
which are written by table, so that no transcript is ever gathered in one row or task.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators.receipts import command_argument
from factweave.sources.files import entity_id, scratch

#: Fixed value: how a handle is written where a case doesn't say otherwise.
HANDLE = r"(?m)^Handle:\s*(\S+)"
#: A fact's place in its source: file, split, line within it, item within the line.
PLACE = ("file", "at", "seq", "pos")
FACT = (
    "table string, transcript string, key string, via string, name string, time_lower timestamp, time_upper timestamp, completed timestamp, command string, output string, arguments string, "
    "receipt string, error string, pending boolean, truncated boolean, claimed string, sha256 string, file string, at long, seq long, pos int"
)


def text_of(value: Column) -> Column:
    """What a result or a message's content says: a text, the texts of a list's parts by lines, an object's text, else its JSON."""
    kind = F.schema_of_variant(value)
    own = lambda v: F.when(F.schema_of_variant(F.try_variant_get(v, "$.text", "variant")) == "STRING", F.try_variant_get(v, "$.text", "string"))
    parts = F.array_join(F.filter(F.transform(F.try_variant_get(value, "$", "array<variant>"), own), lambda x: x.isNotNull()), "\n")
    text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(kind.startswith("ARRAY"), parts)
    return F.when(value.isNull() | (kind == "VOID"), "").otherwise(F.coalesce(text, F.when(kind.startswith("OBJECT"), own(value)), F.to_json(value)))


def items(spark: SparkSession, path: str) -> DataFrame:
    """(transcript, kind, body, place) of every event and message, and one row without kind for a line that has none; the
    text of a line that is no such JSON stays in broken."""
    raw = spark.read.option("lineSep", "\n").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("seq"), "value")
    line = raw.where(~F.col("value").rlike(r"\A\s*\z")).withColumn("v", F.try_parse_json("value"))
    many = lambda one, all: F.coalesce(F.try_variant_get("v", f"$.{all}", "array<variant>"), F.array_compact(F.array(F.try_variant_get("v", f"$.{one}", "variant"))))
    tag = lambda kind, all: F.transform(all, lambda b, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), b.alias("body")))
    both = F.concat(tag("event", many("event", "events")), tag("message", many("message", "messages")))
    transcript = F.try_variant_get("v", "$.transcript_id", "string")
    out = line.select("file", "at", "seq", transcript.alias("transcript"), F.when(transcript.isNull(), F.col("value")).alias("broken"), F.explode_outer(F.when(transcript.isNotNull(), both)).alias("x"))
    return out.select("file", "at", "seq", "transcript", "broken", F.coalesce("x.pos", F.lit(0)).alias("pos"), F.col("x.kind").alias("kind"), F.col("x.body").alias("body"))


def facts(rows: DataFrame, patterns: Sequence[str] = (HANDLE,), launcher: str = "start_job") -> DataFrame:
    """Every item's facts: one for the event or message itself, one for each handle it names and job it says it started,
    and one in problems for what can't be read."""
    for p in patterns:
        if re.compile(p).groups != 1:
            raise ValueError("a handle pattern has exactly one group")
    get = lambda path, type="string": F.try_variant_get("body", f"$.{path}", type)
    truth = lambda path: F.coalesce(get(path, "boolean"), F.lit(False))
    is_event, type = F.col("kind") == "event", get("event")
    tool, box = is_event & (type == "tool"), is_event & (type == "sandbox")
    x = rows.withColumns({
        "id": F.when(is_event, get("uuid")).otherwise(get("id")), "type": type, "tool": F.coalesce(tool, F.lit(False)), "box": F.coalesce(box, F.lit(False)),
        "t0": F.try_to_timestamp(get("timestamp")), "t1": F.try_to_timestamp(get("completed")), "said": F.when(F.col("kind") == "message", text_of(get("content", "variant"))).when(tool, text_of(get("result", "variant"))).when(box, F.coalesce(get("output"), F.lit(""))),
        "role": get("role"), "function": get("function"), "args": F.to_json(get("arguments", "variant")), "cmd": get("cmd"), "fault": F.when(F.schema_of_variant(get("error", "variant")) != "VOID", F.to_json(get("error", "variant"))),
        "pending": truth("pending"), "truncated": truth("truncated"), "digest": F.sha2(F.to_json("body"), 256), "version": get("arguments.version"),
    })
    x = x.withColumn("receipt", F.when(F.col("tool"), F.try_parse_json("said"))).withColumn("key", F.concat("transcript", F.lit(":"), "id"))
    answer = lambda path, type="string": F.try_variant_get("receipt", f"$.{path}", type)
    job = answer("job_id")
    started = F.schema_of_variant(answer("started", "variant")) == "BOOLEAN"
    started &= answer("started", "boolean") & (job != "")
    names = [f.split(" ")[0] for f in FACT.split(", ")]

    def fact(table: Column | str, **given: Column) -> Column:
        given = {"transcript": F.col("transcript"), "time_lower": F.when(F.col("kind") == "event", F.col("t0")), "time_upper": F.when(F.col("kind") == "event", F.coalesce("t1", "t0")), "completed": F.col("t1"), "sha256": F.col("digest"), **{c: F.col(c) for c in PLACE}} | given
        kinds = {f.split(" ")[0]: f.split(" ")[1] for f in FACT.split(", ")}
        return F.struct(*((F.lit(table) if n == "table" and isinstance(table, str) else table if n == "table" else given.get(n, F.lit(None)).cast(kinds[n])).alias(n) for n in names))

    has = F.col("id").isNotNull()
    own = F.when(F.col("tool"), "tool_event").when(F.col("box"), "sandbox_exec").when(is_event, "other_event").otherwise("message")
    itself = fact(
        own, key=F.col("key"), name=F.when(F.col("tool"), F.col("function")).when(is_event, F.col("type")).otherwise(F.col("role")), output=F.when(F.col("tool") | F.col("box"), F.col("said")),
        command=F.when(F.col("tool"), command_argument(F.col("args"))).when(F.col("box"), F.col("cmd")), arguments=F.when(F.col("tool"), F.col("args")), receipt=F.to_json("receipt"), error=F.when(F.col("tool"), F.col("fault")),
        pending=F.when(F.col("tool"), F.col("pending")), truncated=F.when(F.col("tool"), F.col("truncated")), claimed=F.when(F.col("kind") == "message", F.sha2("said", 256)).when(F.col("tool") | F.col("box"), F.sha2("said", 256)),
    )
    launch = F.col("tool") & (F.col("function") == launcher) & F.col("fault").isNull() & started
    told = F.concat(*(F.regexp_extract_all("said", F.lit(p), F.lit(1)) for p in patterns))
    handles = F.when((F.col("kind") == "message") & F.col("role").isin("system", "user") & has, F.transform(told, lambda h: fact("handle", key=F.concat("transcript", F.lit(":"), h), via=F.col("key"), name=h)))
    lost = F.when(F.col("broken").isNotNull(), "no_transcript").when(F.col("kind").isNull(), "no_items").when(~has, F.when(is_event, "event_without_uuid").otherwise("message_without_id"))
    every = F.concat(
        F.array(F.when(has, itself), F.when(has & launch, fact("job", key=job, via=F.col("key"), claimed=F.col("version"))), F.when(lost.isNotNull(), fact("problem", name=lost, output=F.col("broken")))),
        F.coalesce(handles, F.array().cast(f"array<struct<{', '.join(f.replace(' ', ': ', 1) for f in FACT.split(', '))}>>")),
    )
    return x.select(F.explode(F.array_compact(every)).alias("f")).select("f.*")


def first(rows: DataFrame, *key: str) -> DataFrame:
    """Of the rows that share a key the first of the source, and n, how many there are."""
    rest = [c for c in rows.columns if c not in key]
    one = F.min_by(F.struct(*rest), F.struct(*PLACE))
    return rows.groupBy(*key).agg(one.alias("o"), F.count("*").alias("n")).select(*key, "o.*", "n")


def node_id(kind: Column | str, key: Column) -> Column:
    return entity_id(F.lit(kind) if isinstance(kind, str) else kind, key)


@dataclass
class Transcripts:
    """The tables of a source whose facts lie at path.

    tool_event: name (the function), command, output, arguments, receipt, error, pending, truncated, claimed (the output's
    digest); sandbox_exec: command, output, claimed; message: name (the role), claimed (the text's digest); handle: name,
    via (the message); job: via (the call), claimed (the version it says it runs).  time_lower, time_upper and completed
    (null: no end was recorded) are the event's; sha256 digests the item as JSON, which cites it.
    """

    spark: SparkSession
    path: str

    def of(self, table: str) -> DataFrame:
        return self.spark.read.schema(FACT).parquet(self.path).where(F.col("table") == table)

    @property
    def nodes(self) -> DataFrame:
        """(entity_id, subkind, key, transcript, first fact's columns, n) of tool events, executions, messages, handles
        and jobs; a later one of the same id leaves the first as it is."""
        rows = self.spark.read.schema(FACT).parquet(self.path).where(F.col("table").isin("tool_event", "sandbox_exec", "message", "handle", "job"))
        return first(rows.withColumnRenamed("table", "subkind"), "subkind", "key").withColumn("entity_id", node_id(F.col("subkind"), F.col("key")))

    @property
    def sessions(self) -> DataFrame:
        """(entity_id, key, events, messages, final_event, final_type, final_time): a transcript and the last of its timed events."""
        rows = self.spark.read.schema(FACT).parquet(self.path).where("transcript is not null")
        timed = F.col("table").isin("tool_event", "sandbox_exec", "other_event") & F.col("time_upper").isNotNull()
        last = F.max_by(F.when(timed, F.struct("key", "table", "name", "time_lower", "time_upper")), F.when(timed, F.struct("time_upper", *PLACE)))
        by = rows.groupBy("transcript").agg(F.count_if(timed).alias("events_considered"), F.count_if(F.col("table") == "message").alias("messages"), last.alias("last"))
        type = F.when(F.col("last.table") == "tool_event", "tool").when(F.col("last.table") == "sandbox_exec", "sandbox").otherwise(F.col("last.name"))
        return by.select(node_id("transcript", F.col("transcript")).alias("entity_id"), "transcript", "events_considered", "messages", F.col("last.key").alias("final_event"), type.alias("final_type"), F.col("last.time_lower").alias("final_lower"), F.col("last.time_upper").alias("final_upper"))

    @property
    def edges(self) -> DataFrame:
        """(subject, kind, object, method, outcome): what belongs to a session, what it sent, and the jobs that calls say
        they started, which is never more than a claim."""
        rows = self.spark.read.schema(FACT).parquet(self.path)
        session, me, table = node_id("transcript", F.col("transcript")), node_id(F.col("table"), F.col("key")), F.col("table")
        edge = lambda s, k, o, m, out: F.struct(s.alias("subject"), F.lit(k).alias("kind"), o.alias("object"), F.lit(m).alias("method"), F.lit(out).alias("outcome"))
        of = F.when(table.isin("tool_event", "sandbox_exec"), edge(me, "member_of", session, "transcript_locator", "supported"))
        of = of.when(table == "handle", edge(me, "member_of", session, "handle_pattern", "ambiguous")).when(table == "message", edge(session, "sent", me, "transcript_message", "supported"))
        of = of.when(table == "job", edge(node_id("tool_event", F.col("via")), "launched", me, "launch_receipt", "ambiguous"))
        return rows.select(of.alias("e")).where("e is not null").select("e.*").distinct()

    @property
    def problems(self) -> DataFrame:
        """(reason, transcript, key, n): lines without a transcript, items without an id, and events whose id comes again."""
        lost = self.of("problem").where("name <> 'no_items'").groupBy(F.col("name").alias("reason"), "transcript").agg(F.count("*").alias("n")).select("reason", "transcript", F.lit(None).cast("string").alias("key"), "n")
        events = self.spark.read.schema(FACT).parquet(self.path).where(F.col("table").isin("tool_event", "sandbox_exec"))
        again = events.groupBy("transcript", "key").agg(F.count("*").alias("n")).where("n > 1")
        return lost.unionByName(again.select(F.lit("repeated_event").alias("reason"), "transcript", "key", "n"))

    def final_of_handles(self) -> DataFrame:
        """(handle, transcript, n_sessions, final_event, final_type, final_upper, events_considered) of every session that
        names a handle; whoever asks for one endpoint takes handles of one session."""
        named = first(self.of("handle"), "key").select(F.col("name").alias("handle"), "transcript")
        several = named.groupBy("handle").agg(F.countDistinct("transcript").alias("n_sessions"))
        ends = self.sessions.where("final_event is not null").drop("entity_id", "messages", "final_lower")
        return named.join(ends, "transcript").join(several, "handle")


def load(spark: SparkSession, path: str, patterns: Sequence[str] = (HANDLE,), out: str | None = None) -> Transcripts:
    """Read the transcripts at path, once, into facts by table (at out, or in the shared folder)."""
    out = out or scratch(spark, "transcripts")
    facts(items(spark, path), patterns).write.partitionBy("table").option("compression", "zstd").parquet(out)
    return Transcripts(spark, out)
