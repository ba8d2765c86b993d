import base64
import hashlib
import html
from html.parser import HTMLParser

from affinity.llm import warc_derivatives as wd

BLOCKS = set("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main "
             "nav ol p pre section table td th title tr ul".split())


class Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "noscript", "template")
        self.out.append("\n" if tag in BLOCKS else "")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "noscript", "template")
        self.out.append("\n" if tag in BLOCKS else "")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def brute_text(markup):
    p = Text()
    p.feed(markup)
    p.close()
    lines = [" ".join(x.split()) for x in "".join(p.out).split("\n")]
    return [x for x in lines if x]


PAGES = ["<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style><script>var t='</p>';</script></head>"
         "<body><nav><ul><li><a href='/x'>One</a></li></ul></nav><!-- ad --><p>Two <b>bold</b><br>three &copy; &#233;</p>"
         "<noscript>no</noscript><div>1 &lt; 2</div></body></html>",
         "plain", "", "<p>a<p>b<table><tr><td>c</td><td>d</td></tr></table>"]


def test_text_matches_a_full_parser():
    for page in PAGES:
        got = [x.strip() for x in wd.plain_text(page).split("\n") if x.strip()]
        assert got == brute_text(page)


def test_custom_elements_and_quoted_attributes():
    assert wd.plain_text("<p>a</p><template-card><p>keep me</p></template-card><p>tail text</p>") == "a\nkeep me\ntail text"
    assert wd.plain_text("<style-guide>x</style-guide><script-x>y</script-x>") == "xy"
    assert wd.plain_text("a<p-card>b</p-card>c") == "abc"
    assert wd.plain_text('<a title="x > y">t</a> <a title=\'<b>\'>u</a>') == "t u"
    assert wd.plain_text("<a title=\"x>t") == "t"
    assert wd.plain_text("<p class=a\"b>t</p>1 < 2 > 0") == "t\n1 < 2 > 0"
    assert wd.plain_text("<script>x</script >y<template\nid=a>z</template\n>w<script/src=a>q</script>v") == "y w v"


def test_every_page_of_the_table_matches_a_full_parser(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    assert len(pages) > 100
    for page in pages:
        got = [x.strip() for x in wd.plain_text(page or "").split("\n") if x.strip()]
        assert got == brute_text(page or "")


def _response(body, *headers):
    block = b"\r\n".join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", *headers]) + b"\r\n\r\n" + body
    return wd.Record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Target-URI", "http://h/"),
                      ("WARC-IP-Address", "192.0.2.1"), ("WARC-Truncated", "length"), ("Content-Length", str(len(block)))], block)


def test_transfer_and_content_encodings_are_undone():
    import gzip
    import zlib
    page = "<p>caf\u00e9</p><p>two</p>".encode()
    raw = zlib.compressobj(9, zlib.DEFLATED, -15)
    raw = raw.compress(page) + raw.flush()

    def chunked(data):
        parts = [data[k:k + 7] for k in range(0, len(data), 7)]
        return b"".join(b"%x;x=1\r\n%s\r\n" % (len(c), c) for c in parts) + b"0\r\nTrailer: x\r\n\r\n"

    cases = [(page,), (gzip.compress(page), b"Content-Encoding: gzip"), (zlib.compress(page), b"content-encoding: deflate"),
             (raw, b"Content-Encoding: deflate"), (chunked(page), b"Transfer-Encoding: chunked"),
             (chunked(gzip.compress(page)), b"Transfer-Encoding: chunked", b"Content-Encoding: x-gzip"),
             (gzip.compress(zlib.compress(page)), b"Content-Encoding: deflate, gzip"),
             (gzip.compress(page[:9]) + gzip.compress(page[9:]), b"Content-Encoding: gzip"),
             (page, b"Transfer-Encoding: chunked"), (page, b"Content-Encoding: identity")]
    for body, *headers in cases:
        source = wd.parse_record(_response(body, *headers).render())
        metadata, conversion = wd.derive(source)
        assert conversion.block.decode() == "caf\u00e9\ntwo", headers
        fields = dict(x.split(": ", 1) for x in metadata.block.decode().split("\r\n") if x)
        assert fields["warc-header-warc-ip-address"] == "192.0.2.1" and fields["warc-header-warc-truncated"] == "length"
    for body, header in ((b"\x0b\x02", b"Content-Encoding: br"), (b"no gzip", b"Content-Encoding: gzip")):
        metadata, conversion = wd.derive(_response(body, header))
        assert conversion.block == b"" and b"content-left-encoded: " in metadata.block


def test_unclosed_and_long_markup_is_linear():
    import time
    began = time.time()
    for page in ("<!--" * 100_000, "<script>" * 50_000, "<a " * 200_000, "<p" * 200_000, "<a b=\"" * 100_000, "<a =" * 100_000, "<a " + "b=" * 200_000, "x" * 3_000_000, "&amp;" * 200_000):
        wd.plain_text(page)
    assert time.time() - began < 20


def test_records_of_the_table(spark):
    pages = [(i, f"http://h/{i}", p, "x", "y") for i, p in enumerate(PAGES)]
    pages += [(10, None, None, "x", "y"), (None, "http://n", "<p>n", "x", "y"), pages[0], (11, "http://l\r\nX: y", "é " * 300_000, "x", "y")]
    got = wd.derive_pages(spark.createDataFrame(pages, "page_id long, url string, html string, block string, record_id string"))
    rows = got.collect()
    assert len(rows) == 2 * len(pages)
    for r in rows:
        body = r["block"].encode()
        assert r["content_length"] == len(body)
        assert r["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    by_id = {r["record_id"]: r for r in rows}
    assert len(by_id) == 2 * (len(pages) - 1)  # the repeated row gives the same records
    for i, url, page, *_ in pages:
        source = wd.page_response(i, url, page)
        mine = {r["record_type"]: r for r in rows if r["refers_to"] == source.get("WARC-Record-ID")}
        assert mine.keys() == {"metadata", "conversion"}
        payload = (page or "").encode()
        sha = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for r in mine.values():
            assert r["source_payload_digest"] == sha and r["source_key"] == i and r["warc_date"] == wd.DATE
        fields = dict(x.split(": ", 1) for x in mine["metadata"]["block"].split("\r\n") if x)
        assert fields["conversion-record-id"] == mine["conversion"]["record_id"]
        assert fields["http-status"] == "HTTP/1.1 200 OK" and fields["http-header-content-length"] == str(len(payload))
        assert fields["source-block-digest"] == source.get("WARC-Block-Digest")
        assert [x for x in mine["conversion"]["block"].split("\n") if x.strip()] == brute_text(page or "")


def test_raw_records_round_trip(spark):
    source = wd.page_response(1, "http://h/1", PAGES[0])
    request = wd.Record([("WARC-Type", "request"), ("Content-Length", "0")], b"")
    folded = source.render().replace(b"Content-Type: application/http;", b"Content-Type: application/http;\r\n ")
    assert wd.parse_record(source.render()) == source
    raw = spark.createDataFrame([(1, bytearray(source.render())), (2, bytearray(request.render())), (3, None), (4, bytearray(folded)),
                                 (5, bytearray(b"junk"))], "key long, raw binary")
    got = wd.derive_records(raw)
    assert sorted(r["source_key"] for r in got.collect()) == [1, 1, 4, 4]
    assert {r["refers_to"] for r in got.collect()} == {source.get("WARC-Record-ID")}
    for r in wd.render(got.where("source_key = 1")).collect():
        record = wd.parse_record(bytes(r["raw"]))
        assert record in wd.derive(source) and record.render() == bytes(r["raw"])


def test_charsets_and_empty(spark):
    block = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html; charset=latin-1\r\nX-A: b: c\r\n\r\n<p>caf\xe9 " + html.escape("<x>").encode()
    source = wd.Record([("WARC-Type", "response"), ("Content-Length", str(len(block)))], block)
    meta, text = wd.derive(source)
    assert text.block.decode() == "café <x>" and b"http-header-x-a: b: c\r\n" in meta.block and b"404 Not Found" in meta.block
    assert text.get("WARC-Refers-To") == meta.get("WARC-Refers-To") != ""
    assert wd.derive_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
