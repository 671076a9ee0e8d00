"""Streams over growing folders: ingest, live corroboration, live candidates.  Each runs until its input is
used up (availableNow), keeps its place in a checkpoint and can be started again for what came since."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators.reconcile import binding, pair_outcome, said_and_done


def follow(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files at path, a folder or one file; the schema is that of the files there now."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")  # the source takes folders and patterns


def drain(stream: DataFrame, out: str, state: str) -> DataFrame:
    """Append what the stream yields to the Parquet table at out; its rows."""
    spark = stream.sparkSession
    run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def ingest(rows: DataFrame, key: str, ts: str, late: str = "30 days") -> DataFrame:
    """Rows whose key was not seen within the delay; rows later than the watermark are dropped."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def corroborate(tools: DataFrame, execs: DataFrame, slack: str = "12 hours", late: str = "30 days", how: str = "inner", longest: str = "1 hour") -> DataFrame:
    """(tool, exec, outcome) of tool calls and executions as both arrive.

    With how="left" a call without execution follows once the watermark has passed its window, so the last
    ones stay open until more rows come.  No call may last more than longest: this bounds the state."""
    s = F.expr(f"interval {slack}")
    tools, execs = said_and_done(tools.where("cmd is not null"), "cmd", "output", False), said_and_done(execs, "cmd", "output", True)
    a = tools.withColumn("t0", F.col("t0").cast("timestamp")).withColumn("t1", F.col("t1").cast("timestamp")).withWatermark("t0", late)
    b = execs.select(F.col("transcript").alias("e_transcript"), "exec", F.col("t").cast("timestamp").alias("t"), F.col("cmd").alias("e_cmd"), F.col("output").alias("e_output")).withWatermark("t", late)
    on = (F.col("transcript") == F.col("e_transcript")) & (F.col("t") >= F.col("t0") - s) & (F.col("t") <= F.col("t1") + s) & (F.col("t") <= F.col("t0") + F.expr(f"interval {longest}") + s)
    return a.join(b, on, how).select("tool", "exec", pair_outcome(F.col("exec"), F.col("cmd"), F.col("e_cmd"), F.col("output"), F.col("e_output")).alias("outcome"))


def candidates(claims: DataFrame, records: DataFrame) -> DataFrame:
    """(event_id, cid, bind) of a stream of claims against the ledger as it stands."""
    held = records.select("event_id", "token_sha")
    return claims.join(held, "event_id").select("event_id", "cid", binding(F.col("token"), F.col("token_sha")).alias("bind"))
