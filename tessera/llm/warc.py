"""Derivatives of web archives: a metadata and a plain-text conversion record for each response, linked by Refers-To."""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import slices

#: Capture time given to pages that come without one.
DATE = "2024-01-01T00:00:00Z"
HTTP_HEADERS = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
RESPONSE = "response_id string, target_uri string, date string, http_header string, payload binary, payload_digest string, block_digest string"
DERIVED = "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, block binary, block_digest string, payload_digest string, source_digest string, source_header string"

#: Elements whose content is no text of the page; the content of ``RAW`` holds no tags either.
RAW, HIDDEN = ("script", "style"), ("head", "noscript", "template", "svg")
#: Elements that begin a line of their own.
BREAKS = frozenset("p div br h1 h2 h3 h4 h5 h6 li ul ol tr table section article header footer nav main aside blockquote pre form hr dl dt dd figure title".split())
NAME = re.compile(r"/?([A-Za-z][^\s/<>]*)")
END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in (*RAW, "title")}
ATTRIBUTE = re.compile(r"""(?<![\w-])([\w-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""")


def digest(data: bytes) -> str:
    """A digest as WARC headers carry it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """A record id that is a function of what the record holds: a rerun names records alike."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(parts).encode('utf-8', 'replace')).digest()[:16], version=5)}>"


def scan(page: str) -> tuple[list[str], dict]:
    """Pieces of visible text, with a line feed for each block element, and title, metas and links: one pass from left to right.

    A tag is ``<``, a letter (or ``/`` and one) and what follows up to ``>``; an unclosed one, and any other ``<``, is text, but
    for comments and declarations. An element of ``RAW`` or ``HIDDEN`` that is never closed hides the rest (a body ends the head).
    Nothing is looked for twice from two places, so the time is in proportion to the page whatever it holds.
    """
    out, title, metas, links, hidden, at = [], None, [], [], None, 0
    last = page.rfind(">")
    while (lt := page.find("<", at)) >= 0:
        follows = page[lt + 1 : lt + 2]
        if not hidden:
            out.append(html.unescape(page[at:lt]))
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else len(page)
            out.append(" ")
            continue
        tag = NAME.match(page, lt + 1) if lt < last else None
        if lt >= last or not (tag or follows in ("!", "?")):
            out.append("" if hidden else "<")
            at = lt + 1
            continue
        gt = page.find(">", lt)
        at = gt + 1
        name = tag[1].lower() if tag else ""
        opens = follows != "/"
        if not hidden or name == hidden:
            out.append("\n" if name in BREAKS else " ")
        if hidden and (name == hidden and not opens or name == "body" and hidden == "head"):
            hidden = None
        elif opens and not hidden and name in HIDDEN:
            hidden = name
        if not opens:
            continue
        if name in ("a", "meta"):
            found = {}
            for k, *value in ATTRIBUTE.findall(page, tag.end(), gt):
                found.setdefault(k.lower(), html.unescape("".join(value)))
            if name == "meta":
                metas.append(found)
            elif "href" in found:
                links.append(found["href"])
        elif name == "title" and title is None:
            if (end := END["title"].search(page, at)) is None:
                title = ""
            else:
                title = " ".join(html.unescape(page[at : end.start()]).split())
        elif name in RAW:
            if (end := END[name].search(page, at)) is None:
                at = len(page)
            else:
                at = end.start()
    if not hidden:
        out.append(html.unescape(page[at:]))
    return out, {"Title": title or None, "Metas": metas, "Links": links}


def parsed(page: str) -> tuple[str, dict]:
    """Visible text, one line for each block element, white space collapsed; title (null if there is none), attributes of
    metas and addresses of links, in the order of the page."""
    pieces, found = scan(page)
    return "\n".join(x for line in "".join(pieces).split("\n") if (x := " ".join(line.split()))), found


def responses(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """Pages as response records: ``id`` and the columns of ``RESPONSE``. Null addresses and pages are empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                s = b.slice(at, 512)
                rows = []
                for url, page in zip(s.column(1).to_pylist(), s.column(2).to_pylist(), strict=True):
                    page, head = page or b"", HTTP_HEADERS.format(len(page or b""))
                    payload = digest(page)
                    rows.append((record_id("response", url or "", date, payload), url or "", date, head, page, payload, digest(head.encode() + page)))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([s.column(0), *[pa.array(c, pa.binary() if i == 4 else pa.string()) for i, c in enumerate(cols)]], names=["id", *(x.split()[0] for x in RESPONSE.split(", "))])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("u"), F.col(html_col).cast("binary").alias("h"))
    return rows.mapInArrow(run, f"id {kind}, {RESPONSE}")


def derive(records: DataFrame) -> DataFrame:
    """Response records to two records each: ``id`` and the columns of ``DERIVED``.

    ``refers_to`` is the response's id; address, date, HTTP headers and digests are the response's own. The metadata block
    is JSON (envelope with the response's WARC and HTTP headers, title, metas, links), the conversion block is plain text.
    Bytes that are not UTF-8 are replaced before parsing; digests are of the bytes as they came. Pages of any length are read
    whole, in time proportional to their length; null or empty payloads give an empty text; repeated responses give records with the same ids; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = []
                for r in b.slice(at, 256).to_pylist():
                    page = (r["payload"] or b"").decode("utf-8", "replace")
                    head, of = r["http_header"] or "", r["response_id"]
                    text, found = parsed(page)
                    lines = [x.partition(":") for x in head.split("\r\n")[1:] if x]
                    envelope = {
                        "WARC-Header-Metadata": {"WARC-Type": "response", "WARC-Record-ID": of, "WARC-Target-URI": r["target_uri"], "WARC-Date": r["date"], "WARC-Payload-Digest": r["payload_digest"], "WARC-Block-Digest": r["block_digest"]},
                        "Payload-Metadata": {"HTTP-Response-Metadata": {"Status": head.split("\r\n")[0], "Headers": {k.strip(): v.strip() for k, _, v in lines}, "HTML-Metadata": found}},
                    }
                    for kind, content, block in (("metadata", "application/json", json.dumps({"Envelope": envelope}, ensure_ascii=False).encode("utf-8", "replace")), ("conversion", "text/plain", text.encode("utf-8", "replace"))):
                        own = digest(block)
                        rows.append((r["id"], kind, record_id(kind, of or "", own), of, r["target_uri"], r["date"], content, block, own, own, r["payload_digest"], head))
                cols = list(zip(*rows, strict=True)) if rows else [()] * 12
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [b.schema.field("id").type, *[pa.string()] * 6, pa.binary(), *[pa.string()] * 4], strict=True)], names=["id", *(x.split()[0] for x in DERIVED.split(", "))])

    return records.mapInArrow(run, f"id {records.schema['id'].dataType.simpleString()}, {DERIVED}")


def serialized(derived: DataFrame) -> DataFrame:
    """``record_id`` and ``warc``: each record in the bytes of the file format."""
    headers = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("Content-Type", "content_type"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest")]
    text = F.concat(F.lit("WARC/1.0\r\n"), *[F.concat(F.lit(f"{h}: "), F.coalesce(F.col(c), F.lit("")), F.lit("\r\n")) for h, c in headers], F.lit("Content-Length: "), F.octet_length("block").cast("string"), F.lit("\r\n\r\n"))
    return derived.select("record_id", F.concat(text.cast("binary"), F.col("block"), F.lit("\r\n\r\n").cast("binary")).alias("warc"))


def records_of(data: bytes) -> Iterator[dict]:
    """Records of a file of the format as headers and ``block``, by their Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k: v.strip() for k, _, v in (x.partition(":") for x in lines)}
        at = end + 4 + int(headers["Content-Length"])
        yield {**headers, "block": data[end + 4 : at]}
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"the record before byte {at} doesn't end there")
        at += 4


def read(files: DataFrame, column: str = "warc") -> DataFrame:
    """Rows of files in binary ``column`` (several records each) to one row a record: its headers (map) and ``block``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for data in b.column(0).to_pylist():
                found = list(records_of(data or b""))
                heads = [[(k, v) for k, v in r.items() if k != "block"] for r in found]
                yield pa.RecordBatch.from_arrays([pa.array(heads, pa.map_(pa.string(), pa.string())), pa.array([r["block"] for r in found], pa.binary())], names=["headers", "block"])

    return files.select(F.col(column).cast("binary").alias("w")).mapInArrow(run, "headers map<string,string>, block binary")
