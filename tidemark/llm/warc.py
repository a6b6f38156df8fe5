"""WARC derivatives: metadata and plain-text conversion records for response records.

``to_response`` writes a page as a WARC/1.1 response record, ``read_records`` parses records, ``derive``
makes of one response its two derivatives.  Both refer to the response by ``WARC-Refers-To`` and keep its
target URI and date; the metadata record holds the source's HTTP headers, digests and outlinks, the conversion
record the text.  Identifiers are name-based, so a repeated task writes the same records.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_texts, bound_batches

DATE = "1970-01-01T00:00:00Z"
#: Elements whose content isn't shown, and those that begin a line.
HIDDEN = frozenset(("script", "style", "template", "noscript"))
BREAK = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table article section nav header footer title head body html blockquote pre td th hr main aside".split())
NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9-]*")
ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
#: Bytes of a page in which a meta element may name the charset.
HEAD = 1024


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(map(str, parts)))}>"


def one_line(text: str) -> str:
    return re.sub(r"[\r\n]+", " ", text) if "\n" in text or "\r" in text else text


def lowered(text: str) -> str:
    """With A-Z in lower case and all other characters, and so all places, as they were."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def write_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {one_line(v)}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Broken(ValueError):
    """A record that can't be read, and where the next one may begin."""

    def __init__(self, why: str, after: int):
        super().__init__(why)
        self.after = after


def read_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers (names in lower case), block and end of the record at byte ``at``."""
    after = data.find(b"WARC/1.", at + 1)
    after = len(data) if after < 0 else after
    end = data.find(b"\r\n\r\n", at)
    version, *lines = data[at : max(end, at)].decode("utf-8", "replace").split("\r\n")
    if end < 0 or not version.startswith("WARC/"):
        raise Broken(f"no WARC record at byte {at}", after)
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise Broken(f"record at byte {at} has no length", after)
    block = data[end + 4 : end + 4 + int(size)]
    stop = end + 4 + int(size)
    if len(block) < int(size) or data[stop : stop + 4] != b"\r\n\r\n":
        raise Broken(f"record at byte {at} is cut off", after)
    return headers, block, stop + 4


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record; a broken record is an error."""
    at = 0
    while at < len(data):
        headers, block, at = read_record(data, at)
        yield headers, block


def to_response(page_id: int | None, url: str, html: str) -> bytes:
    body = html.encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http + body
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", page_id, url, sha1(body))), ("WARC-Target-URI", url), ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", sha1(body)), ("WARC-Block-Digest", sha1(block))]
    return write_record(headers, block)


def pieces(html: str) -> Iterator[tuple[str, str, str]]:
    """Text and tags in order, as (name, text or attributes, content of a title); closing tags' names begin with ``/``, text has no name.

    One pass: what is looked for is always beyond what is settled, and what isn't there is looked for once.
    Comments and the content of hidden elements are left out, to the end if they aren't closed.
    """
    low, at, n = lowered(html), 0, len(html)
    while at < n:
        begin = html.find("<", at)
        if begin < 0:
            yield "", html[at:], ""
            return
        if begin > at:
            yield "", html[at:begin], ""
        if html.startswith("<!--", begin):
            end = html.find("-->", begin + 4)
            yield "", " ", ""
            at = n if end < 0 else end + 3
            continue
        slash = html.startswith("/", begin + 1)
        name = NAME.match(low, begin + 1 + slash)
        if not name and not html.startswith(("!", "?", "/"), begin + 1):
            yield "", "<", ""
            at = begin + 1
            continue
        end = html.find(">", begin)
        if end < 0:  # no tag ends any more
            yield "", html[begin:], ""
            return
        at = end + 1
        if name and not slash and (name[0] in HIDDEN or name[0] == "title"):
            close = low.find(f"</{name[0]}", at)
            if name[0] == "title":
                yield "title", html[name.end() : end], html[at:close] if close >= 0 else ""
            else:
                yield "", " ", ""
                at = n if close < 0 else close
        elif name:
            yield "/" * slash + name[0], html[name.end() : end], ""


def attribute(text: str, wanted: str) -> str | None:
    return next((next((v for v in m.groups()[1:] if v is not None), "") for m in ATTRIBUTE.finditer(text) if m[1].lower() == wanted), None)


def read_page(html: str) -> dict:
    """``text`` (one line per block element, white space within a line collapsed, empty lines dropped), ``title``, ``language`` and ``links``."""
    out, links, title, language = [], [], None, None
    for name, content, inner in pieces(html):
        if not name:
            out.append(content)
            continue
        if name.lstrip("/") in BREAK:
            out.append("\n")
        if name == "title" and title is None and inner:
            title = " ".join(entities.unescape(inner).split())
        elif name == "html" and language is None:
            language = attribute(content, "lang")
        elif name == "a" and (href := attribute(content, "href")) is not None:
            links.append(entities.unescape(href))
    lines = (" ".join(x.split()) for x in entities.unescape("".join(out)).split("\n"))
    return {"text": "\n".join(x for x in lines if x), "title": title, "language": language, "links": links}


def plain_text(html: str) -> str:
    return read_page(html)["text"]


def decoded(http: str, body: bytes) -> str:
    """The page under the charset of its HTTP header, else of a meta element near its start, else UTF-8; what doesn't fit is replaced."""
    kind = next((x for x in http.split("\r\n") if x.lower().startswith("content-type:")), "")
    found = CHARSET.search(kind) or CHARSET.search(body[:HEAD].decode("latin-1"))
    try:
        return body.decode(found[1] if found else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def derive(headers: dict[str, str], block: bytes) -> list[tuple[list[tuple[str, str]], bytes]]:
    """Metadata and conversion record of a response record."""
    http, _, body = block.partition(b"\r\n\r\n")
    http = http.decode("latin-1")
    page = read_page(decoded(http, body))
    source, uri, date = (headers.get(k) for k in ("warc-record-id", "warc-target-uri", "warc-date"))
    if source is None or uri is None or date is None:
        raise Broken("a response without record ID, target URI or date", 0)
    shared = [("WARC-Refers-To", source), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Refers-To-Date", date)]
    status, *fields = http.split("\r\n")
    facts = [("source-status", status), *((f"source-header-{k.strip().lower()}", v.strip()) for k, _, v in (x.partition(":") for x in fields))]
    facts += [("source-payload-digest", headers.get("warc-payload-digest", sha1(body))), ("source-block-digest", headers.get("warc-block-digest", sha1(block)))]
    facts += [(k, page[k]) for k in ("title", "language") if page[k] is not None]
    facts += [("outlink", x) for x in page["links"]]
    about = "".join(f"{k}: {one_line(v)}\r\n" for k, v in facts).encode("utf-8", "replace")
    out = []
    for kind, mime, data in (("metadata", "application/warc-fields", about), ("conversion", "text/plain; charset=utf-8", page["text"].encode("utf-8", "replace"))):
        out.append(([("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, source)), *shared, ("Content-Type", mime), ("WARC-Block-Digest", sha1(data))], data))
    return out


DERIVED = "page_id long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, source_digest string, block_digest string, content_length long, block string, record binary"


def responses(pages: DataFrame) -> DataFrame:
    """``(page_id, record)``: a response record for each row; a null url or html is empty."""
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [to_response(i, u, h) for i, u, h in zip(b.column(0).to_pylist(), as_texts(b.column(1)), as_texts(b.column(2)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["page_id", "record"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, record binary")


def derived(page: int | None, data: bytes) -> Iterator[tuple]:
    """Rows of ``DERIVED`` for the response records in ``data``; a row of type ``rejected`` with the reason for each that is broken."""
    at = 0
    while at < len(data):
        try:
            headers, block, at = read_record(data, at)
            if headers.get("warc-type") == "response":
                for fields, made in derive(headers, block):
                    f = dict(fields)
                    yield page, f["WARC-Type"], f["WARC-Record-ID"], f["WARC-Refers-To"], f["WARC-Target-URI"], f["WARC-Date"], f["Content-Type"], headers.get("warc-payload-digest"), f["WARC-Block-Digest"], len(made), made.decode(), write_record(fields, made)
        except Broken as e:
            at = max(at, e.after)
            yield page, "rejected", None, None, None, None, None, None, None, 0, str(e), None


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows (``DERIVED``) for each response record in ``records (page_id, record)``; other records give none.

    A broken record, or a response without record ID, target URI or date, gives one row of type ``rejected``
    with the reason as its ``block``; reading goes on at the next record.  Repeated rows and equal pages give the
    same records again.  Null and empty records give none.  A long page is read in one pass.  Without a shuffle, so neither
    hot hosts nor repeated pages matter.  Further columns are not read.  An empty table gives an empty table.
    """
    bound_batches(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row for page, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for row in derived(page, data or b"")]
            kinds = [pa.int64(), *[pa.string()] * 8, pa.int64(), pa.string(), pa.binary()]
            names = [x.split()[0] for x in DERIVED.split(", ")]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return records.select("page_id", "record").mapInArrow(run, DERIVED)
