"""Adapters as data sources: files of an export become rows (table, key, attributes) with their citations.

An adapter says which files it takes and which table and key a row of each belongs to; splitting, strict parsing, digests
and the rows that are rejected are the same for all.  spark.read.format(name) reads one after register(spark).  Files are
opened by the tasks through Arrow's file systems (local and shared folders, file:, hdfs:, s3:, gs:), JSON Lines in splits
of any size.  A row that breaks a rule is no error of the whole read: it comes with what is wrong, in the column problem.
One more row for each split of JSON Lines, of locator #, says in n how many lines it has, blank ones too.
"""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, split long, n long, locator string, sha256 string, tbl string, key string, attrs string, problem string"
LIMIT, SPLIT, BATCH = 32 << 20, 64 << 20, 4 << 20


class Rejected(ValueError):
    """What makes a row no row."""


def strict(raw: bytes, limit: int = LIMIT):
    """The JSON value of raw: no repeated keys, no NaN or infinity, no number beyond a double, no more than limit bytes, no
    deeper than the parser goes, in UTF-8 that can be written again."""
    if len(raw) > limit:
        raise Rejected(f"longer than {limit} bytes")

    def once(pairs):
        out = dict(pairs)
        if len(out) < len(pairs):
            raise Rejected("repeated key")
        return out

    def finite(text):
        value = float(text)
        if not math.isfinite(value):
            raise Rejected("number beyond a double")
        return value

    def never(text):
        raise Rejected(f"constant {text}")

    try:
        value = json.loads(raw, object_pairs_hook=once, parse_float=finite, parse_constant=never)
        canonical(value).encode()
        return value
    except RecursionError:
        raise Rejected("nested too deep") from None
    except UnicodeError:
        raise Rejected("not UTF-8") from None
    except json.JSONDecodeError:
        raise Rejected("not JSON") from None


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Split(InputPartition):
    path: str
    kind: str
    start: int
    end: int
    whole: bool


class AdapterReader(DataSourceReader):
    def __init__(self, adapter: Adapter):
        self.adapter, self.path = adapter, adapter.options["path"]
        self.size, self.limit = int(adapter.options.get("split", SPLIT)), int(adapter.options.get("limit", LIMIT))

    def partitions(self) -> list[Split]:
        from pyarrow import fs

        system, path = _opened(self.path)
        top = system.get_file_info(path)
        if top.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [top] if top.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        out = []
        for f in sorted((f for f in files if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            kind = next((part for part in reversed(f.path.split("/")) if part in self.adapter.files), None)
            if kind is None:
                raise ValueError(f"{self.adapter.name()} has no table for {f.path}")
            whole = kind.endswith(".json")
            cuts = [0] if whole else range(0, max(f.size, 1), self.size)
            out += [Split(f.path, kind, a, f.size if whole else min(a + self.size, f.size), whole) for a in cuts]
        return out

    def _lines(self, split: Split):
        """(number in the split, offset, raw bytes) of the lines that start in a split; a line ends at LF, and one CR before it
        belongs to neither its text nor its digest."""
        system, _ = _opened(self.path)
        with system.open_input_file(split.path) as f:
            at, rest, n = split.start, b"", 0
            if at:  # the line that is under way belongs to the split before
                f.seek(at - 1)
                while (got := f.read(1 << 16)) and b"\n" not in got:
                    at += len(got)
                if not got:
                    yield 0, None, b""
                    return
                cut = got.index(b"\n") + 1
                at, rest = at - 1 + cut, got[cut:]
            else:
                f.seek(0)
            while at < split.end:
                while b"\n" not in rest and (got := f.read(1 << 20)):
                    rest += got
                if not rest:
                    break
                line, found, rest = rest.partition(b"\n")
                n += 1
                yield n, at, line[:-1] if line.endswith(b"\r") else line
                at += len(line) + len(found)
            yield n, None, b""

    def _values(self, split: Split):
        """(number, locator, digest, value or what is wrong)."""
        if split.whole:
            system, _ = _opened(self.path)
            with system.open_input_file(split.path) as f:
                raw = f.read(self.limit + 1)
            try:
                value = strict(raw, self.limit)
            except Rejected as e:
                yield 0, "$", hashlib.sha256(raw).hexdigest(), e
                return
            for k, row in enumerate(value if isinstance(value, list) else [value]):
                yield k, f"$[{k}]" if isinstance(value, list) else "$", hashlib.sha256(canonical(row).encode()).hexdigest(), row
            return
        for n, at, raw in self._lines(split):
            if at is None:
                yield n, "#", None, None
            if not raw.strip():
                continue
            try:
                value = strict(raw, self.limit)
            except Rejected as e:
                value = e
            yield n, str(at), hashlib.sha256(raw).hexdigest(), value

    def read(self, split: Split):
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6]
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        rows, size = [], 0
        for n, locator, digest, value in self._values(split):
            table = key = attrs = problem = None
            if locator == "#":
                pass
            elif isinstance(value, Rejected):
                problem = str(value)
            elif not isinstance(value, dict):
                problem = "not an object"
            else:
                try:
                    table, key, value = self.adapter.row(split.kind, n, value)
                    attrs = canonical(value)
                except Rejected as e:
                    problem = str(e)
            rows.append((split.path, split.start, n, locator, digest, table, key, attrs, problem))
            size += 200 + len(attrs or "")
            if size > BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class Adapter(DataSource):
    """To be subclassed: files maps the names it takes (of files, or of folders of part files) to tables and keys."""

    files: dict[str, tuple[str, str | None]] = {}

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> AdapterReader:
        return AdapterReader(self)

    def row(self, name: str, n: int, value: dict) -> tuple[str, str, dict]:
        """(table, key, attributes) of a row of the file of that name; Rejected where it breaks a rule.  Without a key field
        rows are numbered."""
        table, field = self.files[name]
        if field is None:
            return table, str(n), value
        if field not in value or value[field] is None:
            raise Rejected(f"no {field}")
        return table, str(value[field]), value


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class RegistryFiles(Adapter):
    """A registry's ledger, its populations, refreshes and reads; payloads leave the read log here, by digest."""

    files = {"ledger.jsonl": ("registry_mutation", "id"), "population.json": ("population", "namespace"), "registry-refresh.json": ("refresh", None), "registry-reads.json": ("read", None)}

    @classmethod
    def name(cls) -> str:
        return "factweave_registry"

    def row(self, name, n, value):
        table, key, value = super().row(name, n, value)
        payload = value.get("payload")
        if table == "registry_mutation" and payload is not None and _digest(str(payload)) != value.get("sha256"):
            raise Rejected("payload digest differs")
        if table == "population":
            ids = value.get("event_ids") or []
            if value.get("count") != len(ids) or len({canonical(i) for i in ids}) != len(ids):
                raise Rejected("count differs from the ids")
        if table == "read":
            value = {k: v for k, v in value.items() if k != "payload"} | {"payload_sha256": _digest(payload) if isinstance(payload, str) else None}
        return table, key, value


class WikiExport(Adapter):
    """A wiki's export: revisions, pages, events, labels, records and links.  Bodies and texts stay behind: digests go on.

    A revision's body holds its bytes as characters; they have to have the digest given and are read in the encoding declared.
    """

    files = {
        "revisions.jsonl": ("revision", "rev_id"), "pages.jsonl": ("page", "page_key"), "events.jsonl": ("wiki_event", "event_id"),
        "labels.jsonl": ("label", "label"), "records.jsonl": ("record", "id"), "links.jsonl": ("link", "url"),
    }

    @classmethod
    def name(cls) -> str:
        return "factweave_wiki"

    def row(self, name, n, value):
        table, key, value = super().row(name, n, value)
        attrs = {k: v for k, v in value.items() if k not in ("body", "text", "hunks")}
        if table == "revision":
            try:
                raw = value["body"].encode("latin-1")
                text = raw.decode("utf-8" if value.get("body_encoding") == "utf8" else "latin-1")
            except (KeyError, AttributeError, UnicodeError):
                raise Rejected("body is no bytes in its encoding") from None
            if hashlib.sha256(raw).hexdigest() != value.get("body_sha256"):
                raise Rejected("body digest differs")
            attrs |= {"body_hash_verified": True, "normalized_sha256": _digest(" ".join(text.split()))}
        elif table == "record" and isinstance(value.get("text"), str):
            attrs["normalized_sha256"] = _digest(" ".join(value["text"].split()))
        elif table == "label":
            attrs |= {"anonymous": key == "", "authenticated": False}
        return table, key, attrs


def register(spark: SparkSession) -> None:
    for source in (RegistryFiles, WikiExport):
        spark.dataSource.register(source)


def numbered(rows: DataFrame) -> DataFrame:
    """rows with line, the physical line from 1 of JSON Lines (blank and rejected ones count; null for a JSON document): the
    lines of a file's earlier splits, of which there are few, are added up."""
    last = rows.where("locator = '#'").select("file", "split", F.col("n").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = last.withColumn("before", before).drop("m")
    line = F.when(~F.col("locator").startswith("$"), F.col("before") + F.col("n"))
    return rows.where("locator <> '#'").join(splits, ["file", "split"], "left").withColumn("line", line).drop("before")


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("tbl is not null").drop("problem")


def rejected(rows: DataFrame) -> DataFrame:
    """(file, locator, tbl, key, problem) of rejected rows, and of every row whose key stands in its table before."""
    again = rows.where("tbl is not null").groupBy("tbl", "key").agg(F.count("*").alias("m"), F.min(F.struct("file", "split", "n", "locator")).alias("first")).where("m > 1")
    repeated = rows.where("tbl is not null").join(again, ["tbl", "key"]).where(F.struct("file", "split", "n", "locator") != F.col("first"))
    return rows.where("problem is not null").select("file", "locator", "tbl", "key", "problem").unionByName(repeated.select("file", "locator", "tbl", "key", F.lit("repeated key of the table").alias("problem")))
