"""Queries over transcripts: events and conversations written as nested JSON lines and read as cited tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.operators import reconcile as R
from factweave.plans.bindings import table
from factweave.plans.catalogue import query
from factweave.sources import files, transcripts


def _source(spark, d):
    """A transcript for each user and conversation of the same number.  Clicks are tool calls, every sixth a launch; views
    are sandbox runs; other events are neither, and every fiftieth has no id.  Every twentieth call comes twice."""
    k = F.col("event_id")
    at = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    words = F.concat(F.lit("echo "), (k % 5).cast("string"))
    result = F.when(k % 6 == 0, F.concat(F.lit('{"started":'), F.when(k % 4 == 0, "false").otherwise("true"), F.lit(',"job_id":"j'), (k % 400).cast("string"), F.lit('"}'))).when(k % 8 == 1, "").otherwise(F.concat((k % 3).cast("string"), F.lit("\n\nran  ")))
    body = {
        "click": F.to_json(F.struct(F.lit("tool").alias("event"), F.concat(F.lit("u"), k).alias("uuid"), at(F.col("ts")).alias("timestamp"), F.when(k % 10 != 7, at(F.col("ts") + F.expr("interval 1 hour"))).alias("completed"),
            F.when(k % 6 == 0, "start_job").otherwise("bash").alias("function"), F.when(k % 6 == 0, F.create_map(F.lit("version"), F.sha2(k.cast("string"), 256))).otherwise(F.create_map(F.lit("cmd"), F.concat(F.lit(" "), words))).alias("arguments"),
            result.alias("result"), F.when(k % 35 == 0, "refused").alias("error"))),
        "view": F.to_json(F.struct(F.lit("sandbox").alias("event"), F.concat(F.lit("u"), k).alias("uuid"), at(F.col("ts")).alias("timestamp"), F.concat(F.lit("bash -c '"), words, F.lit("'")).alias("cmd"), F.concat((k % 3).cast("string"), F.lit("\nran\nmore")).alias("output"))),
    }
    other = F.to_json(F.struct(F.lit("model").alias("event"), F.when(k % 50 != 0, F.concat(F.lit("u"), k)).alias("uuid"), at(F.col("ts")).alias("timestamp")))
    event = F.when(F.col("event_type") == "click", body["click"]).when(F.col("event_type") == "view", body["view"]).otherwise(other)
    line = lambda id, part, text: F.concat(F.lit('{"transcript_id":"t'), id.cast("string"), F.lit(f'","{part}":'), text, F.lit("}"))
    e = table(spark, d, "events").select("event_id", "event_type", line(F.col("user_id"), "event", event).alias("value"))
    c, turn = table(spark, d, "conversations"), F.col("turn").cast("string")
    said = F.concat(F.when(F.col("turn") == 0, F.concat(F.lit("Handle: a"), (F.col("conv_id") % 97).cast("string"), F.lit("\n"))).otherwise(F.lit("")), F.coalesce("text", F.lit("")))
    message = F.to_json(F.struct(F.concat(F.lit("m"), turn).alias("id"), "role", F.when(F.col("turn") % 2 == 0, F.to_json(F.array(F.struct(said.alias("text"))))).alias("parts"), said.alias("content")))
    m = c.select(line(F.col("conv_id"), "message", message).alias("value"))
    return e.select("value").unionByName(e.where("event_type = 'click' and event_id % 20 = 0").select("value")).unionByName(m)


def _tables(spark, d):
    path = files.scratch(spark, "lines")
    _source(spark, d).write.text(path)
    return transcripts.load(spark, path)


_ID = "'e-' || substr(sha256({0} || chr(0) || {1}), 1, 24)"
_SQL = f"""WITH ev AS (SELECT event_id AS k, 't' || user_id AS transcript, 'u' || event_id AS id, 't' || user_id || ':u' || event_id AS key, ts, event_type,
      CASE WHEN event_type = 'click' AND event_id % 10 <> 7 THEN ts + interval '1 hour' ELSE ts END AS upper,
      CASE WHEN event_id % 6 = 0 THEN '{{"started":' || CASE WHEN event_id % 4 = 0 THEN 'false' ELSE 'true' END || ',"job_id":"j' || event_id % 400 || '"}}' WHEN event_id % 8 = 1 THEN '' ELSE event_id % 3 || chr(10) || chr(10) || 'ran  ' END AS result FROM events),
    msg AS (SELECT 't' || conv_id AS transcript, 't' || conv_id || ':m' || turn AS key, role, turn, CASE WHEN turn = 0 THEN 'Handle: a' || conv_id % 97 || chr(10) ELSE '' END || coalesce(text, '') AS said, 'a' || conv_id % 97 AS handle FROM conversations),
    jobs AS (SELECT 'j' || k % 400 AS key, key AS via, k FROM ev WHERE event_type = 'click' AND k % 6 = 0 AND k % 4 <> 0 AND k % 35 <> 0),
    named AS (SELECT transcript, handle, transcript || ':' || handle AS key FROM msg WHERE turn = 0 AND role IN ('system', 'user'))
"""


@query(_SQL + f"""SELECT {_ID.format("subkind", "key")} AS entity_id, subkind, key, name, claimed, n FROM (
    SELECT 'tool_event' AS subkind, key, CASE WHEN k % 6 = 0 THEN 'start_job' ELSE 'bash' END AS name, sha256(result) AS claimed, CASE WHEN k % 20 = 0 THEN 2 ELSE 1 END AS n FROM ev WHERE event_type = 'click'
    UNION ALL SELECT 'sandbox_exec', key, 'sandbox', sha256(k % 3 || chr(10) || 'ran' || chr(10) || 'more'), 1 FROM ev WHERE event_type = 'view'
    UNION ALL SELECT 'message', key, role, sha256(said), 1 FROM msg
    UNION ALL SELECT 'handle', key, handle, NULL, 1 FROM named
    UNION ALL SELECT 'job', key, NULL, NULL, count(*) + count(*) FILTER (k % 20 = 0) FROM jobs GROUP BY key)""")
def transcript_nodes(spark, d):
    """Every node once with the number of facts that state it; a job's claimed version is that of its first launch, which
    the files' order decides, so it is left out here."""
    return _tables(spark, d).nodes.select("entity_id", "subkind", "key", "name", F.when(F.col("subkind") != "job", F.col("claimed")).alias("claimed"), "n")


@query(_SQL + f""", e AS (SELECT {_ID.format("CASE event_type WHEN 'click' THEN 'tool_event' ELSE 'sandbox_exec' END", "key")} AS subject, 'member_of' AS kind, {_ID.format("'transcript'", "transcript")} AS object, 'supported' AS outcome FROM ev WHERE event_type IN ('click', 'view')
    UNION ALL SELECT {_ID.format("'transcript'", "transcript")}, 'sent', {_ID.format("'message'", "key")}, 'supported' FROM msg
    UNION ALL SELECT {_ID.format("'handle'", "key")}, 'member_of', {_ID.format("'transcript'", "transcript")}, 'ambiguous' FROM named
    UNION ALL SELECT {_ID.format("'tool_event'", "via")}, 'launched', {_ID.format("'job'", "key")}, 'ambiguous' FROM jobs) SELECT DISTINCT subject, kind, object, outcome FROM e""")
def transcript_edges(spark, d):
    return _tables(spark, d).edges.drop("method")


@query(_SQL + """SELECT 'event_without_uuid' AS reason, transcript, NULL AS key, count(*) AS n FROM ev WHERE event_type NOT IN ('click', 'view') AND k % 50 = 0 GROUP BY transcript
    UNION ALL SELECT 'repeated_event', transcript, key, 2 FROM ev WHERE event_type = 'click' AND k % 20 = 0""")
def transcript_problems(spark, d):
    return _tables(spark, d).problems


@query(_SQL + """, timed AS (SELECT transcript, key, event_type, upper, CASE WHEN event_type = 'click' AND k % 20 = 0 THEN 2 ELSE 1 END AS m FROM ev WHERE event_type IN ('click', 'view') OR k % 50 <> 0),
    ends AS (SELECT transcript, sum(m)::BIGINT AS events_considered, arg_max(key, upper) AS final_event, arg_max(CASE event_type WHEN 'click' THEN 'tool' WHEN 'view' THEN 'sandbox' ELSE 'model' END, upper) AS final_type, max(upper) AS upper FROM timed GROUP BY transcript),
    several AS (SELECT handle, count(DISTINCT transcript) AS n_sessions FROM named GROUP BY handle),
    refresh AS (SELECT transcript, min(ts) AS ts FROM ev WHERE event_type = 'signup' GROUP BY transcript),
    x AS (SELECT handle, transcript, n_sessions, final_event, final_type, events_considered, CAST(epoch_us(r.ts) - epoch_us(upper) AS DOUBLE) / 1000000 AS delta FROM named JOIN ends USING (transcript) JOIN several USING (handle) LEFT JOIN refresh AS r USING (transcript))
    SELECT *, CASE WHEN n_sessions <> 1 OR delta IS NULL THEN 'not_assessable' WHEN delta > 86400 THEN 'supported' WHEN delta < -86400 THEN 'contradicted' ELSE 'ambiguous' END AS outcome FROM x""")
def lq7_handles(spark, d):
    """Each handle's sessions, their final events, and whether a refresh came after them, by more than a declared bound of
    a day either way; an answer needs one session and one refresh."""
    ends = _tables(spark, d).final_of_handles()
    refresh = table(spark, d, "events").where("event_type = 'signup'").groupBy(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("transcript")).agg(F.min("ts").cast("timestamp").alias("ts"))
    delta = (F.unix_micros("ts") - F.unix_micros("final_upper")) / F.lit(1e6)
    x = ends.join(refresh, "transcript", "left").withColumn("delta", delta)
    unsure = (F.col("n_sessions") != 1) | F.col("delta").isNull()
    outcome = F.when(unsure, "not_assessable").when(F.col("delta") > 86400, "supported").when(F.col("delta") < -86400, "contradicted").otherwise("ambiguous")
    return x.select("handle", "transcript", "n_sessions", "final_event", "final_type", "events_considered", "delta", outcome.alias("outcome"))


@query(_SQL + """, tools AS (SELECT transcript, key AS tool, ts AS t0, CASE WHEN k % 10 <> 7 THEN upper END AS t1, k % 5 AS cmd, result FROM ev WHERE event_type = 'click' AND k % 6 <> 0),
    execs AS (SELECT transcript, key AS exec, ts AS t, k % 5 AS cmd, k % 3 AS out FROM ev WHERE event_type = 'view')
    SELECT tool, exec, CASE WHEN exec IS NULL THEN 'no_pair' WHEN t.cmd <> e.cmd THEN 'unmatched' WHEN result = '' THEN 'not_assessable' WHEN result[1] = CAST(out AS VARCHAR) THEN 'supported' ELSE 'contradicted' END AS outcome
    FROM tools t LEFT JOIN execs e ON t.transcript = e.transcript AND (t1 IS NULL OR (e.t >= t.t0 - interval '2 seconds' AND e.t <= t1 + interval '2 seconds'))""")
def transcript_corroboration(spark, d):
    """Tool calls against sandbox runs within two seconds of their window; calls without an end meet the whole transcript."""
    nodes = _tables(spark, d).nodes
    tools = nodes.where("subkind = 'tool_event'").select(F.col("key").alias("tool"), "transcript", F.col("time_lower").alias("t0"), F.col("completed").alias("t1"), F.col("command").alias("cmd"), "output")
    execs = nodes.where("subkind = 'sandbox_exec'").select(F.col("key").alias("exec"), "transcript", F.col("time_lower").alias("t"), F.col("command").alias("cmd"), "output")
    return R.corroborate(tools, execs, "2 seconds")
