"""WARC derivatives: metadata and plain-text conversion records from responses."""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.llm import common

_SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122: names that are URLs
#: Elements whose text isn't shown, and elements that end a line.
HIDDEN = frozenset("script style head title noscript template iframe svg math".split())
BREAKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_INSIDE = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
_HREF = re.compile(r"""(?i)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_BLANKS = re.compile(r"[^\S\n]+")


def plain_text(page: str) -> tuple[str, str, list[str]]:
    """(visible text, title, link targets) of a page. Lines end at block elements; runs of white space become one space; an element left open runs to the end.

    A tag ends at the first > outside of quotes. From the first tag with a quote that nothing closes, quotes don't count any more; and where no >
    follows, no tag does. So the page is gone through once, whatever is in it.
    """
    out: list[str] = []
    quoted, last = True, page.rfind(">")
    title, links, at, n = "", [], 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            start = n
        if start > at:
            out.append(_BLANKS.sub(" ", page[at:start].replace("\n", " ")))
        if start == n:
            break
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = n if end < 0 else end + 1
        elif start < last and (m := _NAME.match(page, start)) and m.end() <= last:
            name, end = m[2].lower(), _INSIDE.match(page, m.end()).end() if quoted else n
            if page[end : end + 1] != ">":
                quoted, end = False, page.find(">", m.end())
            inside, at = page[m.end() : end], end + 1
            if name in BREAKS:
                out.append("\n")
            if name == "a" and not m[1] and (href := _HREF.search(inside)):
                links.append(html.unescape(href[1] or href[2] or href[3] or ""))
            if name in HIDDEN and name != "head" and not m[1] and not inside.endswith("/"):
                close = re.compile(rf"(?i)</{re.escape(name)}\s*>").search(page, at)
                end = close.start() if close else n
                if name == "title" and not title:
                    title = " ".join(html.unescape(page[at:end]).split())
                at = close.end() if close else n
        else:
            out.append("<")
            at = start + 1
    lines = (_BLANKS.sub(" ", x).strip() for x in html.unescape("".join(out)).split("\n"))
    return "\n".join(x for x in lines if x), title, links


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def verified(declared: str | None, *bodies: bytes) -> str:
    """Whether a labelled digest (md5 or of the SHA family, base 32 or hexadecimal) is that of one of the bodies: true, false, or unknown."""
    name, _, value = (declared or "").partition(":")
    name = name.strip().lower().replace("-", "")
    if not value or name not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return "unknown"
    value = value.strip()
    for body in bodies:
        raw = hashlib.new(name, body).digest()
        if value.lower() == raw.hex() or value.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("="):
            return "true"
    return "false"


def unchunked(body: bytes) -> bytes:
    """The body without its chunked transfer coding; unchanged where it isn't in that coding; up to where it breaks off."""
    out, at = [], 0
    while m := re.compile(rb"([0-9A-Fa-f]{1,15})[^\r\n]*\r?\n").match(body, at):
        size, at = int(m[1], 16), m.end()
        if not size:
            return b"".join(out)
        out.append(body[at : at + size])
        at += size
        at += 2 if body[at : at + 2] == b"\r\n" else 1 if body[at : at + 1] == b"\n" else 0
    return b"".join(out) if out else body


def decoded(body: bytes, codings: str) -> tuple[bytes, bool]:
    """The body without its content codings, outermost last (gzip, deflate, zstd), and whether all could be undone; as far as they go where data break off."""
    for name in reversed([x.strip().lower() for x in codings.split(",") if x.strip()]):
        try:
            if name in ("gzip", "x-gzip"):
                out = zlib.decompressobj(47).decompress(body)
            elif name == "deflate":
                out = zlib.decompressobj(15 if body[:1] and body[0] & 15 == 8 and int.from_bytes(body[:2], "big") % 31 == 0 else -15).decompress(body)
            elif name == "zstd":
                out = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(body)).read()
            elif name == "identity":
                continue
            else:
                return body, False
        except (zlib.error, zstandard.ZstdError):
            return body, False
        body = out
    return body, True


_META = re.compile(rb"""(?i)<meta[^>]{0,500}?charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]+)""")
_CHARSET = re.compile(r"""(?i)charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]+)""")


def charset(content_type: str, body: bytes) -> str:
    """The encoding of a page: its byte order mark, what HTTP says, what a meta element in its first 1,024 bytes says (as HTML's own rule has it), else UTF-8."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if body.startswith(mark):
            return name
    said = m[1] if (m := _CHARSET.search(content_type)) else m[1].decode() if (m := _META.search(body[:1024])) else "utf-8"
    try:
        name = codecs.lookup(said).name
    except LookupError:
        return "utf-8"
    return "cp1252" if name in ("iso8859-1", "ascii") else name  # as browsers read them


def record_id(*parts: str) -> str:
    """The same parts give the same identifier, so a task that runs again writes the same records."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE_ID, chr(31).join(parts))}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def split_record(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers in order, continuation lines joined, and the block of the record at the start of `data`."""
    if not data.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    head, found, rest = data.partition(b"\r\n\r\n")
    headers: list[tuple[str, str]] = []
    for line in head.split(b"\r\n")[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and headers:
            headers[-1] = headers[-1][0], f"{headers[-1][1]} {text.strip()}"
        else:
            name, _, value = text.partition(":")
            headers.append((name.strip(), value.strip()))
    length = next((int(v) for k, v in headers if k.lower() == "content-length" and v.isdigit()), None)
    if not found or length is None or length > len(rest):
        raise ValueError("a record without its whole block")
    return headers, rest[:length]


def _safe(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]+", lambda m: "".join(f"%{ord(c):02X}" for c in m[0]), url or "")


def response(page_id: int | None, url: str | None, page: str | None, date: str) -> bytes:
    """A response record around a page. A null page has an empty payload."""
    payload = (page or "").encode("utf-8", "surrogatepass")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    return record(
        [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", str(page_id), url or "", digest(payload))), ("WARC-Date", date), ("WARC-Target-URI", _safe(url)),
         ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http;msgtype=response")], block)


def derive(data: bytes) -> list[tuple[str, str, str, str, str, str, bytes, bytes]]:
    """The metadata and the conversion record of a response record.

    A payload's chunked coding and content coding are undone, and its characters read by the charset that is told; what can't be undone gives an
    empty text, and the metadata's fields say so. Each as (kind, record id, refers-to, target, block digest, payload digest of the source, text or fields, record). Both name the response in
    WARC-Refers-To, with its target and date; source headers and digests stand in the metadata's fields.
    """
    headers, block = split_record(data)
    get = {k.lower(): v for k, v in headers}.get
    if get("warc-type", "").lower() != "response":
        raise ValueError("not a response")
    http, _, payload = block.partition(b"\r\n\r\n")
    lines = http.decode("latin-1").split("\r\n")
    said = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}.get
    body = unchunked(payload) if "chunked" in said("transfer-encoding", "").lower() else payload
    page, undone = decoded(body, said("content-encoding", ""))
    encoding = charset(said("content-type", ""), page)
    text, title, links = plain_text(page.decode(encoding, "replace") if undone else "")
    source, target, date = get("warc-record-id", ""), get("warc-target-uri", ""), get("warc-date", "")
    declared, actual = get("warc-payload-digest"), digest(payload)
    fields = [("source-" + k.lower(), v) for k, v in headers if k.lower() not in ("content-length",)]
    fields += [("http-status", lines[0].partition(" ")[2])] + [("http-" + k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]) if k]
    fields += [("payload-digest-verified", verified(declared, payload, body)), ("charset", encoding), ("content-encoding-undone", str(undone).lower()), ("title", title), ("text-chars", str(len(text))), *(("outlink", _safe(x)) for x in links)]
    fields += [("conversion", record_id("conversion", source, actual))]
    kinds = (("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields)), ("conversion", "text/plain; charset=utf-8", text))
    ids = {kind: record_id(kind, source, actual) for kind, *_ in kinds}
    out = []
    for kind, mime, body in kinds:
        raw = body.encode("utf-8", "replace")
        linked = [("WARC-Concurrent-To", source)] if kind == "metadata" else []  # a conversion record has no such field
        made = record(
            [("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date),
             *linked, ("WARC-Block-Digest", digest(raw)), ("Content-Type", mime)], raw)
        out.append((kind, ids[kind], source, target, digest(raw), actual, raw, made))
    return out


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """page_id and warc (binary): a response record for each row of `pages`. Null ids, addresses and pages count as empty values; repeated rows give
    equal records; long pages stand whole in one record; other columns are left out; an empty table gives none."""
    common.tune(pages.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("warc", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [response(*x, date) for x in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], schema=schema)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, warc binary")


DERIVED = "page_id long, kind string, record_id string, refers_to string, target_uri string, block_digest string, source_payload_digest string, content string, record binary"


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows, metadata and conversion, for each response record in column warc (with page_id); other and broken records give none.

    Identifiers follow from the source's, so running again gives the same rows; repeated rows stay; long records stand whole; other columns are
    left out; an empty table gives none. One pass, no shuffle.
    """
    common.tune(records.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), *((n, pa.string()) for n in ("kind", "record_id", "refers_to", "target_uri", "block_digest", "source_payload_digest", "content")), ("record", pa.binary())])

    def one(data: bytes | None) -> list:
        try:
            return derive(data) if data else []
        except ValueError:
            return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ((i, k, own, src, uri, dig, pay, raw.decode(), made) for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, own, src, uri, dig, pay, raw, made in one(data))
            yield from common.batches(rows, schema, 256)

    return records.select("page_id", "warc").mapInArrow(run, DERIVED)


def split_file(data: bytes) -> Iterator[bytes]:
    """The records of a .warc file, or of a .warc.gz file of one member for each record or of one for all; up to where the file breaks off."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data))
    try:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            head, length = [line], 0
            while (line := stream.readline()).strip():
                head.append(line)
                name, _, value = line.partition(b":")
                if name.strip().lower() == b"content-length" and value.strip().isdigit():
                    length = int(value)
            block = stream.read(length)
            if len(block) < length:
                return
            yield b"".join(x.rstrip(b"\r\n") + b"\r\n" for x in head) + b"\r\n" + block
    except (EOFError, zlib.error, gzip.BadGzipFile):
        return


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """page_id (null) and warc: the records of the WARC files at a path that Spark's readers open. A file is a task; what breaks off ends its file."""
    common.tune(spark)
    schema = pa.schema([("page_id", pa.int64()), ("warc", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from common.batches(((None, r) for r in split_file(batch.column(0)[i].as_py())), schema, 64)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "page_id long, warc binary")


def gz_members(records: DataFrame, name: str = "record") -> DataFrame:
    """Column `name` as gzip members: members one after the other are a .warc.gz file. The same record gives the same bytes."""
    common.tune(records.sparkSession)
    schema = pa.schema([("member", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(x or b"", mtime=0) for x in batch.column(0).to_pylist()], pa.binary())], schema=schema)

    return records.select(name).mapInArrow(run, "member binary")
