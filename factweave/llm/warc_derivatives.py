"""WARC derivatives: each response becomes a metadata record and a plain-text conversion record.

Both refer to the response by WARC-Refers-To, keep its target URI, date, headers and digests, and carry digests
and record ids of their own; ids derive from the response's, so a rerun gives the same records.  Everything is
row by row: nothing is shuffled.  Readers and writers of WARC bytes are at the end.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z!?][^<>]*>")
_LINK = re.compile(r"<a\s[^<>]*?\bhref\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)'|([^\s\"'<>]+))", re.I)
_LANG = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)
_BLANK, _LINES = re.compile(r"[^\S\n]+"), re.compile(r" ?(?:\n ?)+")

RECORD = (
    "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, "
    "source_headers map<string,string>, source_digest string, block_digest string, content_length long, content string"
)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256('\0'.join(parts).encode('utf-8', 'surrogatepass')).digest()[:16], version=5)}>"


def plain_text(page: str) -> tuple[str, dict]:
    """A page's visible text, a line for each block, and its title, language and links."""
    title, lang = _TITLE.search(page), _LANG.search(page)
    page = _DROP.sub(" ", page)
    links = [html.unescape(a or b or c) for a, b, c in _LINK.findall(page)]
    text = html.unescape(_TAG.sub("", _BREAK.sub("\n", page)))
    text = _LINES.sub("\n", _BLANK.sub(" ", text.replace("\r", "\n"))).strip()
    clean = lambda m: " ".join(html.unescape(_TAG.sub("", m[1])).split()) if m else None
    return text, {"title": clean(title), "lang": lang[1] if lang else None, "links": links}


def _http(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, headers (the first of each name, in lower case) and body of an HTTP message."""
    if not block.startswith(b"HTTP/"):
        return "", {}, block
    m = re.search(rb"\r?\n\r?\n", block)
    head, body = (block[: m.start()], block[m.end() :]) if m else (block, b"")
    lines = head.decode("latin-1").splitlines()
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields.setdefault(name.strip().lower(), value.strip())
    return lines[0], fields, body


def _decoded(body: bytes, content_type: str) -> str:
    m = _CHARSET.search(content_type.encode("latin-1", "replace")) or _CHARSET.search(body[:1024])
    try:
        return body.decode(m[1].decode() if m else "utf-8", "replace")
    except (LookupError, UnicodeError):
        return body.decode("utf-8", "replace")


def derive_one(rid: str, uri: str | None, date: str | None, headers: dict, block: bytes):
    """The metadata and conversion records of one response, as tuples in the order of RECORD."""
    status, fields, body = _http(block)
    source = {**headers, **{f"http-{k}": v for k, v in fields.items()}}
    payload = headers.get("WARC-Payload-Digest") or digest(body)
    text, seen = plain_text(_decoded(body, fields.get("content-type", "")))
    source["WARC-Block-Digest"] = headers.get("WARC-Block-Digest") or digest(block)
    about = json.dumps({"status": status, "http": fields, "payload-digest": payload, **seen}, ensure_ascii=False, sort_keys=True)
    for kind, mime, content in (("metadata", "application/json", about), ("conversion", "text/plain", text)):
        content = content.encode("utf-8", "replace")
        yield kind, record_id(rid, kind), rid, uri, date, mime, list(source.items()), payload, digest(content), len(content), content.decode()


def derive(responses: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Two records for each row of responses (record_id, target_uri, date strings, headers map, block binary).

    A null block counts as empty, null headers as none; a null record_id is derived from URI and block.  Carried
    columns stand in front; repeated responses give repeated records, an empty table none.
    """
    schema = responses.select(*carry).schema
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields), RECORD])
    kinds = [pa.string()] * 6 + [pa.map_(pa.string(), pa.string())] + [pa.string()] * 2 + [pa.int64(), pa.string()]
    names = ["record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "source_headers", "source_digest", "block_digest", "content_length", "content"]

    def rows(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rid, uri, date, headers, block = (batch.column(len(carry) + k).to_pylist() for k in range(5))
                out, of = [], []
                for i in range(batch.num_rows):
                    b = block[i] or b""
                    made = derive_one(rid[i] or record_id(uri[i] or "", digest(b)), uri[i], date[i], dict(headers[i] or {}), b)
                    for record in made:
                        out.append(record)
                        of.append(i)
                columns = [batch.column(k).take(pa.array(of, pa.int64())) for k in range(len(carry))]
                columns += [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=[*carry, *names])

    given = responses.select(*carry, "record_id", "target_uri", "date", "headers", F.col("block").cast("binary").alias("block"))
    return given.mapInArrow(rows, ddl)


def responses_of_pages(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Response rows of crawled pages: id, record_id, target_uri, date, headers, block.

    A null page is an empty body.  The record id derives from the page's id, URL and content.
    """
    body = F.encode(F.coalesce(F.col(page).cast("string"), F.lit("")), "UTF-8")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    h = F.sha2(F.concat_ws("\0", F.coalesce(F.col(id).cast("string"), F.lit("")), F.coalesce(F.col(url), F.lit("")), F.sha2(body, 256)), 256)
    rid = F.concat(F.lit("<urn:uuid:"), *(x for k, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ((F.lit("-"),) if k else ()) + (F.substring(h, a, n),)), F.lit(">"))
    headers = F.map_from_arrays(F.array(*map(F.lit, ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Type"))), F.array(F.lit("response"), rid, F.lit(date), F.lit("application/http; msgtype=response")))
    return pages.select(F.col(id).alias("page_id"), rid.alias("record_id"), F.col(url).alias("target_uri"), F.lit(date).alias("date"), headers.alias("headers"), F.concat(F.encode(head, "UTF-8"), body).alias("block"))


def to_warc(row: dict, compress: bool = True) -> bytes:
    """One derived record in WARC/1.1 format, as a gzip member of its own if compress."""
    content = row["content"].encode()
    head = {"WARC-Type": row["record_type"], "WARC-Record-ID": row["record_id"], "WARC-Date": row["date"], "WARC-Target-URI": row["target_uri"], "WARC-Refers-To": row["refers_to"], "WARC-Block-Digest": row["block_digest"], "Content-Type": row["content_type"], "Content-Length": str(len(content))}
    raw = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None) + "\r\n"
    data = raw.encode() + content + b"\r\n\r\n"
    return gzip.compress(data, mtime=0) if compress else data


def parse_warc(data: bytes):
    """(headers, block) of each record of WARC bytes, gzip members or plain; a cut last record is left out."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0 and (end := data.find(b"\r\n\r\n", start)) >= 0:
        fields = {}
        for line in data[start:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip()] = value.strip()
        size = int(fields.get("Content-Length", "0"))
        if end + 4 + size > len(data):
            return
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def read_warc(spark, path: str, types: tuple[str, ...] = ("response",)) -> DataFrame:
    """The records of WARC files as rows record_id, target_uri, date, headers, block; a file is one task's work."""
    kinds = [pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]

    def rows(batches):
        for batch in batches:
            for content in batch.column("content"):
                for h, block in parse_warc(content.as_py()):
                    if h.get("WARC-Type") in types:
                        one = [h.get("WARC-Record-ID"), h.get("WARC-Target-URI"), h.get("WARC-Date"), list(h.items()), block]
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(one, kinds, strict=True)], names=["record_id", "target_uri", "date", "headers", "block"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "record_id string, target_uri string, date string, headers map<string,string>, block binary")


def op4_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    """page_id and the metadata and conversion records of every page."""
    return derive(responses_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")), ("page_id",))


__all__ = ["derive", "derive_one", "responses_of_pages", "read_warc", "to_warc", "parse_warc", "plain_text", "op4_warc_derivatives"]
