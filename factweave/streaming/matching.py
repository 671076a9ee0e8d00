"""Live counts of claims by record while both arrive, in any order."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

COUNTS = "event_id long, version long, recorded boolean, n_claims long, bound long, mismatch long, unbound long, unavailable long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Counts(StatefulProcessor):
    """By event id: the record's commitment, and how many claims carry each token's digest.

    A claim is kept as its token's digest, so what is held for an event grows with its distinct tokens and not with its
    claims.  A claim counts as bound, mismatch, unbound or unavailable once its record is there, and as none of them before.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.record = handle.getValueState("record", "commitment string, version long, recorded boolean")
        self.digests = handle.getMapState("digests", "digest string", "n long")

    def handleInputRows(self, key, rows, timerValues):
        commitment, version, recorded = self.record.get() if self.record.exists() else (None, 0, False)
        for frame in rows:
            for kind, value in zip(frame["kind"], frame["value"], strict=True):
                value = None if pd.isna(value) else value
                if kind == "record":
                    commitment, recorded = value, True
                    continue
                digest = "" if value is None else hashlib.sha256(value.encode()).hexdigest()
                before = self.digests.getValue((digest,))[0] if self.digests.containsKey((digest,)) else 0
                self.digests.updateValue((digest,), (before + 1,))
        self.record.update((commitment, version + 1, recorded))
        n = {"bound": 0, "mismatch": 0, "unbound": 0, "unavailable": 0}
        total = 0
        for (digest,), (count,) in self.digests.iterator():
            total += count
            if recorded:
                n["unavailable" if commitment is None else "unbound" if digest == "" else "bound" if digest == commitment else "mismatch"] += count
        yield pd.DataFrame({"event_id": [key[0]], "version": [version + 1], "recorded": [recorded], "n_claims": [total], **{k: [v] for k, v in n.items()}})

    def close(self) -> None:
        pass


def live_counts(records: DataFrame, claims: DataFrame) -> DataFrame:
    """A stream of event_id, version and counts: a row whenever a record (event_id, token_sha) or claims (event_id, token)
    of an event came; the row of the highest version says how things stand (see latest()).

    Of repeated records of one id the last counts.  State is kept without an end, in RocksDB: a record or claim may come any
    time after its counterpart.
    """
    spark = records.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    one = records.select("event_id", F.lit("record").alias("kind"), F.col("token_sha").alias("value"))
    two = claims.select("event_id", F.lit("claim").alias("kind"), F.col("token").alias("value"))
    return one.unionByName(two).groupBy("event_id").transformWithStateInPandas(statefulProcessor=_Counts(), outputStructType=COUNTS, outputMode="Update", timeMode="None")


def latest(rows: DataFrame) -> DataFrame:
    """Of live_counts() as written so far, how each event stands."""
    rest = [c for c in rows.columns if c not in ("event_id", "version")]
    return rows.groupBy("event_id").agg(F.max_by(F.struct(*rest), "version").alias("x")).select("event_id", "x.*")


def run(stream: DataFrame, out: str, state: str) -> DataFrame:
    """Append what the stream yields to the table at out until its input is used up; how each event stands."""
    spark = stream.sparkSession
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")  # a batch that is run again replaces itself
    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return latest(spark.read.schema(COUNTS + ", batch long").parquet(out).drop("batch"))
