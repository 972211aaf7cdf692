import base64
import gzip
import hashlib
import time
import zlib
from html.parser import HTMLParser

from loomset.llm import warc as W
from tests.conftest import SF_SMALL


class Slow(HTMLParser):
    """Visible text by the standard parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in W.HIDDEN - {"head"}
        self.out.append("\n" if tag in W.BREAKS else "")

    def handle_startendtag(self, tag, attrs):
        self.out.append("\n" if tag in W.BREAKS else "")

    def handle_endtag(self, tag):
        self.hidden -= tag in W.HIDDEN - {"head"} and self.hidden > 0
        self.out.append("\n" if tag in W.BREAKS else "")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data.replace("\n", " "))

    def text(self):
        return "\n".join(x for x in (" ".join(y.split()) for y in "".join(self.out).split("\n")) if x)


def test_text_is_that_of_the_standard_parser(spark):
    for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect():
        slow = Slow()
        slow.feed(r.html)
        slow.close()
        assert "\n".join(" ".join(x.split()) for x in W.plain_text(r.html)[0].split("\n")) == slow.text()


def test_pages_with_loose_ends():
    assert W.plain_text("") == ("", "", [])
    assert W.plain_text("a < b <!-- c")[0] == "a < b"
    assert W.plain_text("<p>x<script>y")[0] == "x"
    assert W.plain_text("<title>T &amp; t</title><a href='u?a&amp;b'>v</a><br/>w &lt;b&gt;") == ("v\nw <b>", "T & t", ["u?a&b"])
    assert len(W.plain_text("<" * 200000)[0]) == 200000


def test_records_are_linked_and_whole(spark):
    pages = spark.createDataFrame([(1, "http://a/ b", "<p>né</p>"), (2, None, None), (None, "u", ""), (1, "http://a/ b", "<p>né</p>")], "page_id long, url string, html string")
    source = W.responses(pages.selectExpr("*", "1 as warc", "2 as kind"))
    ids = {r.page_id: dict(W.split_record(bytes(r.warc))[0]) for r in source.collect()}
    rows = W.derivatives(source).collect()
    assert len(rows) == 8 and sum(r.kind == "metadata" for r in rows) == 4
    for r in rows:
        head, block = W.split_record(bytes(r.record))
        head = dict(head)
        assert head["WARC-Refers-To"] == r.refers_to == ids[r.page_id]["WARC-Record-ID"] and head["WARC-Type"] == r.kind
        assert head["WARC-Block-Digest"] == r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        assert int(head["Content-Length"]) == len(block) and block.decode() == r.content
        assert r.source_payload_digest == ids[r.page_id]["WARC-Payload-Digest"] and head["WARC-Target-URI"] == ids[r.page_id]["WARC-Target-URI"]
        if r.kind == "metadata":
            for k, v in ids[r.page_id].items():
                assert k == "Content-Length" or f"source-{k.lower()}: {v}\r\n" in r.content
            assert "http-status: 200 OK\r\n" in r.content and "payload-digest-verified: true" in r.content
    assert {r.content for r in rows if r.kind == "conversion" and r.page_id == 1} == {"né"}
    assert len({r.record_id for r in rows}) == 6
    broken = spark.createDataFrame([(1, None), (2, b"junk"), (3, b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nx")], "page_id long, warc binary")
    assert W.derivatives(broken).count() == 0 and W.derivatives(W.responses(pages.limit(0))).count() == 0


def made(payload, http=(), warc=(), kind="WARC-Type"):
    block = "".join(f"{x}\r\n" for x in ("HTTP/1.1 200 OK", *http)).encode() + b"\r\n" + payload
    return W.record([*warc, (kind, "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Date", "d"), ("WARC-Target-URI", "u")], block)


def test_loose_tags_take_linear_time():
    began = time.perf_counter()
    assert W.plain_text("<a b" * 1_250_000)[0].startswith("<a b<a b")
    assert W.plain_text('<a "' * 500_001 + ">x")[0] == "x" and W.plain_text("<a '>" * 500_001 + "x")[0] == "x"
    W.plain_text("<p>x</p" * 200_000)
    assert time.perf_counter() - began < 20
    assert W.plain_text("""<a title="a > b" href='c'>d</a> <p class="e>f""")[0::2] == ("d\nf", ["c"])


def test_codings_and_charsets(spark):
    latin = "<p>caf\xe9</p>".encode("latin-1")
    chunked = b"5;x=y\r\n" + latin[:5] + b"\r\n6\r\n" + latin[5:] + b"\r\n0\r\n\r\n"
    squeezed = gzip.compress(b"<p>z\xc3\xa9</p>")
    cases = [
        (made(latin, ["Content-Type: text/html; charset=ISO-8859-1"]), "caf\xe9"),
        (made(b"<meta charset='latin1'>" + latin), "caf\xe9"),
        (made(chunked, ["transfer-encoding: chunked", "content-type: text/html;charset=latin1"], [("WARC-Payload-Digest", "sha256:" + hashlib.sha256(latin).hexdigest())]), "caf\xe9"),
        (made(squeezed, ["Content-Encoding: gzip"], [("WARC-Payload-Digest", "md5:" + hashlib.md5(squeezed).hexdigest())]), "z\xe9"),
        (made(zlib.compress(b"<p>d</p>")[2:-4], ["Content-Encoding: deflate"]), "d"),
        (made(b"\x00\x01", ["Content-Encoding: br"]), ""),
        (made("<p>u</p>".encode("utf-16")), "u"),
        (made(b"<p>late type</p>", (), [("X-Long", "y" * 10_000)], "warc-type"), "late type"),
        (made(b"<p>bad digest</p>", (), [("WARC-Payload-Digest", "sha1:AAAA")]), "bad digest"),
    ]
    rows = W.derivatives(spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases)], "page_id long, warc binary")).collect()
    assert {r.page_id: r.content for r in rows if r.kind == "conversion"} == {i: t for i, (_, t) in enumerate(cases)}
    fields = {r.page_id: dict(x.split(": ", 1) for x in r.content.splitlines() if ": " in x) for r in rows if r.kind == "metadata"}
    assert [fields[i]["payload-digest-verified"] for i in range(9)] == ["unknown", "unknown", "true", "true", "unknown", "unknown", "unknown", "unknown", "false"]
    assert fields[5]["content-encoding-undone"] == "false" and fields[0]["charset"] == "cp1252"
    assert not any(b"WARC-Concurrent-To" in bytes(r.record) for r in rows if r.kind == "conversion")


def test_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i}</p>" * 50) for i in range(20)], "page_id long, url string, html string")
    source = W.responses(pages)
    (tmp_path / "a.warc.gz").write_bytes(b"".join(bytes(r.member) for r in W.gz_members(source, "warc").collect()))
    plain = b"".join(bytes(r.warc) for r in source.collect())
    (tmp_path / "b.warc").write_bytes(plain)
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(plain)[:-30])
    found = W.read_files(spark, str(tmp_path))
    want = {W.split_record(bytes(r.warc))[1] for r in source.collect()}
    assert {W.split_record(bytes(r.warc))[1] for r in found.collect()} == want and 40 <= found.count() < 60
    assert W.derivatives(found).where("kind = 'conversion'").select("content").distinct().count() == 20
