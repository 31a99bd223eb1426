"""Operator 5: metadata and plain-text conversion records derived from WARC response records.

responses() turns pages into response records (HTTP head and payload). derive() makes of each one two
linked records: `metadata` (title, language, links and the source's HTTP headers as warc-fields) and
`conversion` (its plain text). Both keep WARC-Refers-To, its target URI and date, and the source's
payload digest, carry digests of their own blocks, and name each other by WARC-Concurrent-To. Record
ids follow from the source's id and block digest, so that a rerun gives the same. write() puts records
into .warc.gz files, a gzip member each, one file a task, whose names and record offsets come back as a
table through Spark's commit; read() parses them from there.

Defined results: null HTML is an empty payload, which still gives both records; without a URL there is
no target URI; repeated rows are each derived, with the same ids; an empty table gives no records;
further columns of the pages play no part.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import common

DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6f0a63ad-6a5c-4c37-9d36-0c5d2f2bb3f1")
RECORD = "page_id long, headers map<string,string>, block binary"
_PLACES = "path string, records long, bytes long"

# Elements whose content is no text, and those that end a line.
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_LINE = re.compile(r"<(?:/?(?:p|div|h[1-6]|ul|ol|li|tr|table|article|section|header|footer|nav|blockquote|pre|title|head|body|main|aside)|br|hr)\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")
_BLANKS, _LINES = re.compile(r"[ \t\r\f\v]+"), re.compile(r" ?\n[ \n]*")
_TITLE, _TITLE_END = re.compile(r"<title[^>]*>", re.I), re.compile(r"</title", re.I)
_HTML, _LANG = re.compile(r"<html[^>]*>", re.I), re.compile(r"\blang\s*=\s*[\"']?([\w-]+)", re.I)
_ANCHOR, _HREF, _VALUE = re.compile(r"<a\b[^>]*>", re.I), re.compile(r"\bhref\s*=\s*", re.I), re.compile(r"\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)")

# Patterns of whole tags only see a page up to its last ">": a tag that begins there ends there too, so
# every page is read in linear time, tags that are never closed as well.


def plain(page: str) -> str:
    """The visible text of a page, a line for each block element."""
    page = _HIDDEN.sub(" ", page)
    last = page.rfind(">") + 1
    page = _TAG.sub("", _LINE.sub("\n", page[:last])) + page[last:]
    return _LINES.sub("\n", _BLANKS.sub(" ", html.unescape(page))).strip()


def title(page: str) -> str:
    start = _TITLE.search(page, 0, page.rfind(">") + 1)
    end = _TITLE_END.search(page, start.end()) if start else None
    inner = page[start.end() : end.start()] if end else ""
    last = inner.rfind(">") + 1
    return html.unescape(_TAG.sub("", inner[:last]) + inner[last:])


def language(page: str) -> str:
    for tag in _HTML.finditer(page, 0, page.rfind(">") + 1):
        if found := _LANG.search(page, tag.start(), tag.end()):
            return found[1]
    return ""


def links(page: str) -> list[str]:
    """The targets of a page's anchors; of several in one, the last."""
    out = []
    for tag in _ANCHOR.finditer(page, 0, page.rfind(">") + 1):
        for at in reversed(list(_HREF.finditer(page, tag.start(), tag.end()))):
            if value := _VALUE.match(page, at.end()):
                out.append(html.unescape(value[1] or value[2] or value[3] or ""))
                break
    return out


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, '|'.join(parts))}>"


def _line(value: str) -> str:
    """A header's value: one line."""
    return " ".join(value.split())


def response(page_id: int | None, url: str | None, page: str | None) -> tuple[dict[str, str], bytes]:
    """A response record of a page."""
    body = (page or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    head = {"WARC-Type": "response", "WARC-Record-ID": _id("response", str(page_id), url or "", digest(block)), "WARC-Date": DATE}
    if url is not None:
        head["WARC-Target-URI"] = _line(url)
    head |= {"WARC-Payload-Digest": digest(body), "WARC-Block-Digest": digest(block), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return head, block


def derived(head: dict[str, str], block: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The metadata and conversion records of a response."""
    http, _, body = block.partition(b"\r\n\r\n")
    page = body.decode("utf-8", "replace")
    source, uri = head["WARC-Record-ID"], head.get("WARC-Target-URI")
    names = {t: _id(t, source, head["WARC-Block-Digest"]) for t in ("metadata", "conversion")}
    fields = [("title", title(page)), ("language", language(page)), *[("outlink", x) for x in links(page)]]
    fields += [("http-status", http.split(b"\r\n")[0].decode("latin-1"))]
    for row in http.decode("latin-1").split("\r\n")[1:]:
        name, _, value = row.partition(":")
        fields.append((f"http-header-{name.strip().lower()}", value))
    made = []
    for kind, other, mime, data in (
        ("metadata", "conversion", "application/warc-fields", "".join(f"{k}: {_line(v)}\r\n" for k, v in fields if v.strip()).encode()),
        ("conversion", "metadata", "text/plain; charset=utf-8", plain(page).encode()),
    ):
        own = {"WARC-Type": kind, "WARC-Record-ID": names[kind], "WARC-Date": head["WARC-Date"], "WARC-Refers-To": source, "WARC-Refers-To-Date": head["WARC-Date"], "WARC-Concurrent-To": names[other]}
        if uri is not None:
            own |= {"WARC-Target-URI": uri, "WARC-Refers-To-Target-URI": uri}
        made.append((own | {"WARC-Source-Payload-Digest": head["WARC-Payload-Digest"], "WARC-Block-Digest": digest(data), "Content-Type": mime, "Content-Length": str(len(data))}, data))
    return made


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, heads, blocks = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([list(h.items()) for h in heads], pa.map_(pa.string(), pa.string())), pa.array(blocks, pa.binary())], ["page_id", "headers", "block"])


def responses(pages: DataFrame) -> DataFrame:
    """Response records of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                yield _batch([(r["page_id"], *response(r["page_id"], r["url"], r["html"])) for r in b.slice(k, 500).to_pylist()])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, RECORD)


def derive(records: DataFrame) -> DataFrame:
    """Of response records, the linked metadata and conversion records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                rows = b.slice(k, 500).to_pylist()
                if rows:
                    yield _batch([(r["page_id"], *d) for r in rows for d in derived(dict(r["headers"]), r["block"])])

    return records.filter("headers['WARC-Type'] = 'response'").mapInArrow(run, RECORD)


def raw(head: dict[str, str], block: bytes) -> bytes:
    """A record's bytes."""
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and block of a record; raises where length or digest is wrong."""
    top, _, rest = data.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    head = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(head["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or digest(block) != head["WARC-Block-Digest"]:
        raise ValueError(f"a damaged record: {head.get('WARC-Record-ID')}")
    return head, block


def write(records: DataFrame, folder: str) -> DataFrame:
    """Puts records into .warc.gz files; returns path, records and bytes of each file, written."""
    local = common.posix(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, path = None, 0, ""
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    os.makedirs(local, exist_ok=True)
                    path = f"{local}/part-{uuid.uuid4().hex}.warc.gz"
                    out = open(path, "wb")  # noqa: SIM115
                head = dict(r["headers"])
                if r["page_id"] is not None:
                    head["X-Page-ID"] = str(r["page_id"])
                out.write(gzip.compress(raw(head, r["block"]), 1, mtime=0))
                n += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return common.written(records.mapInArrow(run, _PLACES), "warc-files")


def _members(path: str) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    import zlib

    with open(path, "rb") as f:
        rest = f.read(1 << 20)
        while rest:
            z, parts = zlib.decompressobj(31), []
            while not z.eof:
                if not rest:
                    raise ValueError(f"{path} is cut off")
                parts.append(z.decompress(rest))
                rest = z.unused_data if z.eof else f.read(1 << 20)
            yield b"".join(parts)
            rest = rest or f.read(1 << 20)


def read(files: DataFrame) -> DataFrame:
    """The records of the files in a table as write() returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            for path in b.column("path").to_pylist():
                for member in _members(path):
                    head, block = parsed(member)
                    page = head.pop("X-Page-ID", None)
                    rows.append((None if page is None else int(page), head, block))
                    if len(rows) == 500:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)

    each = max(files.sparkSession.sparkContext.defaultParallelism, 64)
    return files.repartition(each, "path").mapInArrow(run, RECORD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the derived records of all pages, written as WARC files and read back."""
    made = derive(responses(common.table(spark, sf_dir, "pages")))
    back = read(write(made, common.scratch_path(spark, "warc")))
    h = lambda name: F.col("headers")[name]
    return back.select(
        "page_id",
        h("WARC-Type").alias("record_type"),
        h("WARC-Record-ID").alias("record_id"),
        h("WARC-Refers-To").alias("refers_to"),
        h("WARC-Concurrent-To").alias("linked_to"),
        h("WARC-Target-URI").alias("target_uri"),
        h("WARC-Source-Payload-Digest").alias("source_digest"),
        h("WARC-Block-Digest").alias("block_digest"),
        h("Content-Type").alias("content_type"),
        h("Content-Length").cast("long").alias("content_length"),
        F.decode("block", "UTF-8").alias("block"),
    )
