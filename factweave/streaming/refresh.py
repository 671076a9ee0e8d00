"""Results that follow their sources: what is unchanged stays, what changed is derived anew, one source at a time.

A table of state has a row for each source: the digest of its content and of the configuration, and the build of the
code, that its results were derived from.  A source whose row differs in any of them is stale.  Results and state are
partitioned by source and overwritten partition by partition, so a run touches what is stale alone.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "content string, configuration string, build string, source string"


@dataclass
class Incremental:
    """derive: rows with the column source -> results with the column source.  build: a name of the code's version."""

    spark: SparkSession
    root: str
    derive: Callable[[DataFrame], DataFrame]
    configuration: dict
    build: str

    @property
    def digest(self) -> str:
        return hashlib.sha256(json.dumps(self.configuration, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(schema).parquet(path) if there else self.spark.createDataFrame([], schema)

    @property
    def state(self) -> DataFrame:
        return self._table("state", STATE)

    def contents(self, rows: DataFrame) -> DataFrame:
        """(source, content) of rows: a digest of all of a source's rows that doesn't depend on their order."""
        columns = [c for c in rows.columns if c != "source"]
        row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
        part = lambda k: F.sum(F.conv(F.substring(row, k, 12), 16, 10).cast("decimal(38,0)")).cast("string")
        by = rows.groupBy("source").agg(F.count("*").cast("string").alias("n"), part(1).alias("a"), part(13).alias("b"))
        return by.select(F.col("source").cast("string").alias("source"), F.sha2(F.concat_ws("|", "n", "a", "b"), 256).alias("content"))

    def stale(self, rows: DataFrame) -> DataFrame:
        """(source, content, reason) of the sources of rows whose results don't stand: new, content, configuration or build."""
        s = self.state.select("source", F.col("content").alias("was"), "configuration", "build")
        x = self.contents(rows).join(s, "source", "left")
        reason = F.when(F.col("was").isNull(), "new").when(F.col("was") != F.col("content"), "content").when(F.col("configuration") != self.digest, "configuration").when(F.col("build") != self.build, "build")
        return x.withColumn("reason", reason).where("reason is not null").select("source", "content", "reason")

    def run(self, rows: DataFrame) -> DataFrame:
        """Derive what is stale anew and note it; what was stale, with its reason.  A run that is cut off leaves the state as
        it was, and the next one derives the same again."""
        path = f"{self.root}/runs/{uuid.uuid4().hex}"  # as it stands before the state changes
        self.stale(rows).write.parquet(path)
        stale = self.spark.read.schema("source string, content string, reason string").parquet(path)
        if not stale.isEmpty():
            results = self.derive(rows.join(stale.select("source"), "source", "left_semi"))
            self._overwrite(results, "results")
            self._overwrite(stale.select("content", F.lit(self.digest).alias("configuration"), F.lit(self.build).alias("build"), "source"), "state")
        return stale

    def _overwrite(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(f"{self.root}/{name}")

    def follow(self, stream: DataFrame, checkpoint: str) -> None:
        """The same for what a stream brings, batch by batch, until its input is used up: each batch holds whole sources."""
        run = stream.writeStream.foreachBatch(lambda batch, _: (self.run(batch), None)[1]).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()

    def results(self, schema: str) -> DataFrame:
        """The results, if all sources stand under this configuration and build; else a ValueError that names some."""
        bad = self.state.where((F.col("configuration") != self.digest) | (F.col("build") != self.build)).select("source").orderBy("source").limit(5).collect()
        if bad:
            raise ValueError(f"derived under another configuration or build: {', '.join(r.source for r in bad)}")
        return self._table("results", schema)
