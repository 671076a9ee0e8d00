"""Cited sources and sinks: rows with the place they were read from, file inventories, tables of a graph."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factweave.sources import trace


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; a temporary folder only where the session is local and has none."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-factweave-"))
        at = spark.sparkContext.getCheckpointDir()
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: While plans are traced (operators.trace): what the tables written on the way were made from, by path.
WRITTEN: dict[str, set[tuple[str, str]]] = {}


def through(df: DataFrame, name: str) -> DataFrame:
    """df written to a new path in the shared folder and read again."""
    path = scratch(df.sparkSession, name)
    if trace.active:
        WRITTEN[path] = trace.columns_read(df)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_buckets(df: DataFrame, name: str, key: str, dealt: bool = False) -> DataFrame:
    """through(), in as many buckets of key as shuffles have parts: joins and groupings by key then move none of its rows.
    dealt: df's rows lie together by key already (else they are dealt out once); it changes no row, only the number of files."""
    spark, path, n = df.sparkSession, scratch(df.sparkSession, name), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if trace.active:
        WRITTEN[path] = trace.columns_read(df)
    at = f"factweave_{uuid.uuid4().hex}"
    rows = df if dealt else df.repartition(n, key)
    rows.write.option("path", path).option("compression", "zstd").bucketBy(n, key).saveAsTable(at)
    return spark.table(at)


def cited_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text, sha256) of every line that is not blank; line counts physical lines from 1, blank ones too.

    A line ends at LF; one CR before it belongs to neither text nor digest.  Numbers come from the counts of the
    file splits before a line's own, so only a split (spark.sql.files.maxPartitionBytes) is ever sorted together.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("seq"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    splits = raw.groupBy("file", "at").agg(F.count("*").alias("n")).select("file", "at", F.coalesce(before, F.lit(0)).alias("before"))
    line = F.col("before") + F.row_number().over(Window.partitionBy("file", "at").orderBy("seq"))
    text = F.regexp_replace("value", r"\r\z", "")
    out = raw.join(splits, ["file", "at"]).select("file", line.alias("line"), text.alias("text"))
    return out.where(~F.col("text").rlike(r"\A\s*\z")).withColumn("sha256", F.sha2("text", 256))


def cited_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns of CSV files with header, and (file, record, sha256): records count from 1, one that spans lines
    counts once; the digest is that of the row's JSON with sorted keys, its values as text."""
    rows = spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"').csv(path)
    names = sorted(StructType.fromDDL(schema).names)
    rows = rows.select(*names, F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("seq"))
    record = F.row_number().over(Window.partitionBy("file").orderBy("seq")).cast("long")
    body = F.to_json(F.struct(*(F.col(n).cast("string").alias(n) for n in names)), {"ignoreNullFields": "false"})
    return rows.select(*names, "file", record.alias("record"), F.sha2(body, 256).alias("sha256"))


def json_fragment(text: Column, path: str, type: str) -> Column:
    """The value at path of a JSON text; null where the text breaks the rules (a repeated key, NaN) or has no such path."""
    return F.try_variant_get(F.try_parse_json(text), path, type)


#: Larger files are digested in pieces of about so many bytes, each by a task of its own.
PIECE = 128 << 20


def inventory(spark: SparkSession, pattern: str) -> DataFrame:
    """(name, bytes, sha256) of the files that match.

    A file above PIECE is read by its splits, as lines of bytes, and digested in pieces one after the other: a task takes
    the digest's state over from the piece before, so none reads more than a piece (and the line across its end) of a file.
    Only files that are named as compressed ones are read whole by one task however large, and 2 GB is their limit.
    """
    f = spark.read.format("binaryFile").load(pattern)
    name, packed = F.element_at(F.split("path", "/"), -1).alias("name"), r"(?i)\.(gz|bz2|deflate|snappy|lz4|zst|lzo|xz|br|passthrough)$"
    large = (F.col("_metadata.file_size") > PIECE) & ~F.col("_metadata.file_path").rlike(packed)  # by what is known before a file is opened
    whole = f.where(~large).select(name, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    found = f.where(large).select(name, "length", F.col("_metadata.file_path").alias("file")).collect()
    if not found:
        return whole
    digests = _chained(spark.read.option("lineSep", "\n").text(pattern).where(large), {r.file: r.length for r in found})
    return whole.unionByName(spark.createDataFrame([(r.name, r.length, digests[r.file]) for r in found], "name string, bytes long, sha256 string"))


def _chained(rows: DataFrame, sizes: dict[str, int]) -> dict[str, str]:
    """SHA-256 of each file of sizes (its bytes by its path) from its lines; what is kept here is a state for each."""
    spark, path, mark = rows.sparkSession, scratch(rows.sparkSession, "pieces"), b"\xef\xbb\xbf"

    def joined(batches):
        """The lines of each split, a LF before each, as few values in their order."""
        import pyarrow as pa
        import pyarrow.compute as pc

        seq = 0
        for b in batches:
            ends = [k for k in range(1, b.num_rows) if b["at"][k] != b["at"][k - 1] or b["file"][k] != b["file"][k - 1]] if b.num_rows and (pc.count_distinct(b["at"]).as_py() > 1 or pc.count_distinct(b["file"]).as_py() > 1) else []
            for lo, hi in zip([0, *ends], [*ends, b.num_rows], strict=True):
                if lo < hi:
                    lines = pa.ListArray.from_arrays([0, hi - lo], b["value"].slice(lo, hi - lo))
                    body = b"\n" + pc.binary_join(lines, b"\n")[0].as_py()
                    yield pa.RecordBatch.from_pydict({"file": [b["file"][lo].as_py()], "at": [b["at"][lo].as_py()], "seq": [seq], "n": [len(body)], "body": [body]})
                    seq += 1

    def digest(state: bytes, parts, last: bool = False) -> bytes:
        """SHA-256's state after parts, or its digest; hashlib keeps its state to itself, OpenSSL beneath it does not."""
        import _hashlib
        import ctypes

        lib, at, out = ctypes.CDLL(_hashlib.__file__), ctypes.create_string_buffer(state, 112), ctypes.create_string_buffer(32)
        if not state:
            lib.SHA256_Init(at)
        for part in parts:
            lib.SHA256_Update(at, part, ctypes.c_size_t(len(part)))
        if last:
            lib.SHA256_Final(out, at)
        return out.raw if last else at.raw

    def step(states):
        def run(batches):
            import pyarrow as pa

            now = {}
            for b in batches:
                for file, at, seq, body in zip(*(b[c].to_pylist() for c in ("file", "at", "seq", "body")), strict=True):
                    first = file not in begun and file not in now
                    now[file] = digest(now.get(file, states[file]), [body[1:] if first else body])
            yield pa.RecordBatch.from_pydict({"file": pa.array(list(now), pa.string()), "state": pa.array(list(now.values()), pa.binary())})

        begun = done.copy()
        return run

    lines = rows.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    pieces = lines.mapInArrow(joined, "file string, at long, seq long, n long, body binary").withColumn("piece", F.floor(F.col("at") / PIECE))
    pieces.write.partitionBy("piece").options(**{"compression": "none", "parquet.enable.dictionary": "false"}).parquet(path)
    pieces = spark.read.parquet(path)
    read = {r.file: r.n - 1 for r in pieces.groupBy("file").agg(F.sum("n").alias("n")).collect()}
    short = {x: size - read[x] for x, size in sizes.items()}  # the last LF is not in a line, nor is a byte order mark
    if any(n not in (0, 1, 3, 4) for n in short.values()):
        raise ValueError(f"files changed while they were read: {sorted(x for x, n in short.items() if n not in (0, 1, 3, 4))}")
    states, done = {x: digest(b"", [mark] if n > 2 else []) for x, n in short.items()}, set()
    for k in sorted(r.piece for r in pieces.select("piece").distinct().collect()):
        part = pieces.where(F.col("piece") == k).repartition(4 * len(sizes), "file").sortWithinPartitions("file", "at", "seq")
        new = {r.file: bytes(r.state) for r in part.select("file", "at", "seq", "body").mapInArrow(step(states), "file string, state binary").collect()}
        states, done = states | new, done | set(new)
    return {x: digest(state, [b"\n"] if short[x] in (1, 4) else [], True).hex() for x, state in states.items()}


def verify(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, status): ok, changed, missing (listed only) or extra (found only)."""
    m = manifest.select("name", F.col("bytes").alias("m_bytes"), F.col("sha256").alias("m_sha256"))
    status = F.when(F.col("sha256").isNull(), "missing").when(F.col("m_sha256").isNull(), "extra")
    status = status.when((F.col("sha256") == F.col("m_sha256")) & (F.col("bytes") == F.col("m_bytes")), "ok").otherwise("changed")
    return found.join(m, "name", "full_outer").select("name", status.alias("status"))


def checked_ledger(rows: DataFrame) -> DataFrame:
    """(event_id, status) of ledger rows: duplicate where the id occurs again, digest_differs where the payload's
    digest is not the one given, else ok; a null payload passes."""
    times = rows.groupBy("event_id").agg(F.count("*").alias("times"))
    status = F.when(F.col("times") > 1, "duplicate").when(F.sha2("payload", 256) != F.col("sha256"), "digest_differs").otherwise("ok")
    return rows.join(times, "event_id").select("event_id", status.alias("status"))


def checked_population(rows: DataFrame) -> DataFrame:
    """(ns, status): count_differs where the declared count is not the number of ids, or not that of distinct ids;
    unordered where it ends before it starts."""
    size = F.size("event_ids")
    bad = (F.col("n") != size) | (size != F.size(F.array_distinct("event_ids")))
    return rows.select("ns", F.when(bad, "count_differs").when(F.col("started_at") > F.col("stopped_at"), "unordered").otherwise("ok").alias("status"))


def checked_declaration(ids: DataFrame, heads: DataFrame) -> DataFrame:
    """(ns, status) as checked_population() has it, for ids as rows (ns, event_id), so no namespace is one value."""
    each = ids.groupBy("ns", "event_id").agg(F.count("*").alias("m")).groupBy("ns").agg(F.sum("m").alias("rows"), F.count("*").alias("ids"))
    bad = (F.col("n") != F.coalesce("rows", F.lit(0))) | (F.col("rows") != F.col("ids"))
    return heads.join(each, "ns", "left").select("ns", F.when(bad, "count_differs").when(F.col("started_at") > F.col("stopped_at"), "unordered").otherwise("ok").alias("status"))


def entity_id(kind: Column, key: Column) -> Column:
    """Id of a node: recomputing it gives the same, null parts count as empty."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(F.lit("e-"), F.substring(F.sha2(F.concat(part(kind), F.lit("\0"), part(key)), 256), 1, 24))


def nodes(df: DataFrame, kind: str, key: str) -> DataFrame:
    """(entity_id, subkind, key), once for each key; a null key is no node."""
    x = df.where(F.col(key).isNotNull()).select(F.lit(kind).alias("subkind"), F.col(key).cast("string").alias("key")).distinct()
    return x.select(entity_id(F.col("subkind"), F.col("key")).alias("entity_id"), "subkind", "key")


def edges(df: DataFrame, kind: str, subject: tuple[str, str], object: tuple[str, str]) -> DataFrame:
    """(subject, kind, object), once for each pair of keys; subject and object name a kind and a key column."""
    x = df.where(F.col(subject[1]).isNotNull() & F.col(object[1]).isNotNull())
    end = lambda e: entity_id(F.lit(e[0]), F.col(e[1]))
    return x.select(end(subject).alias("subject"), F.lit(kind).alias("kind"), end(object).alias("object")).distinct()


def save_stage(df: DataFrame, path: str, stage: str) -> None:
    """One stage's rows of a graph table."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/stage={stage}")


def load_graph(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All stages of a graph table with the column stage."""
    return spark.read.schema(f"{schema}, stage string").parquet(path)


def address(text: str) -> Column:
    """An IPv4 address as a number; null where it isn't one."""
    parts = [F.split_part(F.col(text), F.lit("."), F.lit(k)).try_cast("long") for k in (1, 2, 3, 4)]
    value = parts[0] * 16777216 + parts[1] * 65536 + parts[2] * 256 + parts[3]
    return F.when((F.greatest(*parts) < 256) & F.col(text).rlike(r"^\d+(\.\d+){3}$"), value)


def network(text: str) -> Column:
    """struct(lo, hi) of an IPv4 network in prefix notation."""
    size = F.expr(f"shiftleft(1L, 32 - cast(split_part({text}, '/', 2) as int))")
    parts = [F.split_part(F.split_part(F.col(text), F.lit("/"), F.lit(1)), F.lit("."), F.lit(k)).try_cast("long") for k in (1, 2, 3, 4)]
    value = parts[0] * 16777216 + parts[1] * 65536 + parts[2] * 256 + parts[3]
    lo = value - value % size
    return F.struct(lo.alias("lo"), (lo + size - 1).alias("hi"))


def read_log(rows: DataFrame) -> DataFrame:
    """(read_id, status, digest): what was served, by digest; a payload leaves the log here."""
    return rows.select("read_id", "status", F.sha2("payload", 256).alias("digest"))


def refresh_log(rows: DataFrame) -> DataFrame:
    """(refresh, digest) of the rows that commit to a digest."""
    return rows.where(F.col("digest").rlike("^[0-9a-f]{64}$")).select("refresh", "digest")


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(name, status) of content-addressed files: ok where the name is the digest of the bytes."""
    f = inventory(spark, path)
    return f.select("name", F.when(F.col("name") == F.col("sha256"), "ok").otherwise("digest_differs").alias("status"))
