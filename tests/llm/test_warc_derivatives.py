import base64
import hashlib
import json
from html.parser import HTMLParser

from factweave.llm import warc_derivatives as W


class Visible(HTMLParser):
    def __init__(self):
        super().__init__()
        self.off, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.off:
            self.out.append(data)


def sha1(b):
    return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r.page_id: r for r in pages.collect()}
    rows = W.op4_warc_derivatives(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 2 * len(source) and len({r.record_id for r in rows}) == len(rows)
    refers = {}
    for r in rows:
        page = source[r.page_id]
        assert r.target_uri == page.url and r.source_digest == sha1(page.html.encode()) and r.source_headers["http-content-type"].startswith("text/html")
        assert r.block_digest == sha1(r.content.encode()) and r.content_length == len(r.content.encode())
        assert refers.setdefault(r.page_id, r.refers_to) == r.refers_to == r.source_headers["WARC-Record-ID"]
        p = Visible()
        p.feed(page.html)
        if r.record_type == "conversion":
            assert "".join(r.content.split()) == "".join("".join(p.out).split())
        else:
            assert json.loads(r.content)["payload-digest"] == r.source_digest


def test_edges_and_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, None, None, "x"), (1, "u", "", "x"), (2, "u", "<p>a &amp; b<br>c<script>x</p></script><!-- no --> d<a href='/l?a=1&amp;b'>e</a> < 5 <style>" + "z" * 100_000, "x"), (2, "u", "<p " * 20_000, "x")], "page_id long, url string, html string, content string")
    rows = W.derive(W.responses_of_pages(df), ("page_id",)).collect()
    assert len(rows) == 8
    texts = [r.content for r in rows if r.record_type == "conversion"]
    assert texts[:2] == ["", ""] and texts[2] == "a & b\nc de < 5"
    assert json.loads([r for r in rows if r.record_type == "metadata"][2].content)["links"] == ["/l?a=1&b"]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(W.to_warc(r.asDict()) for r in rows))
    back = W.read_warc(spark, str(tmp_path), ("metadata", "conversion")).collect()
    assert sorted((r.record_id, bytes(r.block)) for r in back) == sorted((r.record_id, r.content.encode()) for r in rows)
    assert all(r.headers["WARC-Refers-To"] for r in back)
    assert W.derive(W.responses_of_pages(df.limit(0))).collect() == []
