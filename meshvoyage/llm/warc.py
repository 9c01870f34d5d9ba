"""WARC derivatives: responses become linked metadata and plain-text conversion records.

A conversion record holds the text of a response's html and refers to the response by
its record id; a metadata record refers to the same response and repeats its source
headers and digests.  Record ids are derived from the response's own id, so that the
same input gives the same archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "warc-derivatives")
COLUMNS = "key string, record_id string, record_type string, refers_to string, target_uri string, date string, content_type string, content_length bigint, block_digest string, payload_digest string, headers map<string,string>, block binary"
BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
_SILENT = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
#: The rest of a tag; a quoted value may hold ``>``.
_REST = r"""(?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+>"""
_BLOCK = re.compile(rf"</?(?:{BLOCKS})\b{_REST}", re.I)
_TAG = re.compile(rf"<[!/?a-zA-Z]{_REST}")
_BLANK = re.compile(r"[^\S\n]+")
_LINES = re.compile(r"\s*\n\s*")


def plain_text(source: str) -> str:
    """All text of a page without markup, scripts and styles, a line for each block."""
    text = _TAG.sub("", _BLOCK.sub("\n", _SILENT.sub("", re.sub(r"\s+", " ", source))))
    return _LINES.sub("\n", _BLANK.sub(" ", html.unescape(text))).strip()


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, ' '.join(parts))}>"


def _record(kind: str, refers_to: str | None, uri: str, date: str, content_type: str, block: bytes, headers: dict[str, str], payload: str | None, rid: str, key: str | None) -> tuple:
    return key, rid, kind, refers_to, uri, date, content_type, len(block), digest(block), payload, list(headers.items()), block


def _unchunked(body: bytes) -> bytes:
    parts, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return body  # stored without its chunks
        if size == 0:
            break
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
    return b"".join(parts)


def _inflated(body: bytes, kind: str) -> bytes:
    """``body`` as far as it can be inflated; a body that is stored inflated, or coded otherwise, stays."""
    for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(kind, ()):
        try:
            return zlib.decompressobj(bits).decompress(body)
        except zlib.error:
            continue
    return body


def decoded(payload: bytes, headers: dict[str, str]) -> str:
    """The text of an HTTP body by its transfer and content coding and its charset, from the header or the page itself."""
    named = {k.lower(): v or "" for k, v in headers.items()}
    body = _unchunked(payload) if "chunked" in named.get("transfer-encoding", "").lower() else payload
    for kind in reversed(named.get("content-encoding", "").lower().split(",")):
        body = _inflated(body, kind.strip())
    found = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", named.get("content-type", ""), re.I)
    found = found or re.search(r"<meta\b[^>]*?charset\s*=\s*[\"']?([\w.:-]+)", body[:1024].decode("latin-1"), re.I)
    try:
        return body.decode(found[1] if found else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def _derive(batches) -> Iterator[pa.RecordBatch]:
    """From (record_id, target_uri, date, http headers, html, key, payload, its digest, block digest) two records for each response."""
    for batch in batches:
        rows = []
        for rid, uri, date, headers, source, key, held, told, block in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
            uri, date, body = uri or "", date or "", (source or "").encode() if held is None else held
            payload = told or digest(body)
            source_headers = dict(headers or [])
            text = plain_text(source or "").encode("utf-8", "replace")
            conversion = record_id(rid, "conversion")
            fields = {"source-id": rid, "source-payload-digest": payload, "source-length": str(len(body)), "conversion-id": conversion, "conversion-length": str(len(text))}
            fields |= {"source-block-digest": block} if block else {}
            fields |= {f"source-header-{k.lower()}": re.sub(r"\s+", " ", v or "") for k, v in source_headers.items()}
            about = "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode()
            rows.append(_record("metadata", rid, uri, date, "application/warc-fields", about, source_headers, payload, record_id(rid, "metadata"), key))
            rows.append(_record("conversion", rid, uri, date, "text/plain", text, source_headers, payload, conversion, key))
        types = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
        names = "key record_id record_type refers_to target_uri date content_type content_length block_digest payload_digest headers block".split()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def responses_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Pages as response records: key, record_id, target_uri, date, headers, html; ids follow from page id and url."""
    key = F.concat_ws(" ", F.lit("response"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(url_col, F.lit("")))
    hex_ = F.sha2(key, 256)
    rid = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(hex_, 1, 8), F.substring(hex_, 9, 4), F.concat(F.lit("8"), F.substring(hex_, 14, 3)), F.concat(F.lit("8"), F.substring(hex_, 18, 3)), F.substring(hex_, 21, 12)), F.lit(">"))
    headers = F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=utf-8"))
    return pages.select(F.col(id_col).cast("string").alias("key"), rid.alias("record_id"), F.col(url_col).alias("target_uri"), F.lit(date).alias("date"), headers.alias("headers"), F.col(html_col).alias("html"))


def derivatives(responses: DataFrame) -> DataFrame:
    """Two records for each response: metadata, and conversion to plain text.

    ``responses`` has record_id, target_uri, date, headers and html, and may have a key,
    which the records keep, and the source's payload, payload_digest and block_digest,
    which are kept as they are; other columns are ignored.  refers_to is the response's id, headers and payload_digest are those of
    the response, block_digest is that of the record's own block.  A null html is an
    empty payload with an empty conversion block; a null uri or date is empty; a null
    id refers to nothing and gives null.  Repeated rows give repeated records; an
    empty table gives none.
    """
    given = lambda n, t="string": (F.col(n) if n in responses.columns else F.lit(None)).cast(t).alias(n)
    rows = responses.select(F.coalesce("record_id", F.lit("")).alias("r"), "target_uri", "date", "headers", "html", given("key"), given("payload", "binary"), given("payload_digest"), given("block_digest"))
    made = rows.mapInArrow(_derive, COLUMNS)
    return made.withColumn("refers_to", F.nullif(F.col("refers_to"), F.lit("")))


def serialize(row) -> bytes:
    """One record as it stands in a WARC file."""
    lines = [VERSION, f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {row['record_id']}", f"WARC-Date: {row['date']}"]
    if row["refers_to"]:
        lines.append(f"WARC-Refers-To: {row['refers_to']}")
    if row["target_uri"]:
        lines.append(f"WARC-Target-URI: {re.sub(r'[\r\n]', '', row['target_uri'])}")
    lines += [f"WARC-Block-Digest: {row['block_digest']}"]
    if row["record_type"] in ("response", "resource") and row["payload_digest"]:
        lines.append(f"WARC-Payload-Digest: {row['payload_digest']}")
    lines += [f"Content-Type: {row['content_type']}", f"Content-Length: {len(row['block'])}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + bytes(row["block"]) + b"\r\n\r\n"


def _files(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [gzip.compress(serialize(r), mtime=0) for r in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["member"])


def to_members(records: DataFrame) -> DataFrame:
    """Each record as a gzip member; members laid end to end are a WARC file."""
    return records.mapInArrow(_files, "member binary")


def _fields(head: bytes) -> dict[str, str]:
    """Header lines after the first; values of a repeated name are joined by commas, as HTTP reads them."""
    found: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            name, value = name.strip(), value.strip()
            found[name] = f"{found[name]}, {value}" if name in found else value
    return found


def parse(archive: bytes) -> Iterator[dict]:
    """Records of a WARC file, gzipped or not: type, ids, headers and block."""
    data = gzip.decompress(archive) if archive[:2] == b"\x1f\x8b" else archive
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", start)
        fields = _fields(data[start:end])
        size = int(fields.get("Content-Length") or 0)
        yield {"record_type": fields.get("WARC-Type"), "record_id": fields.get("WARC-Record-ID"), "refers_to": fields.get("WARC-Refers-To"), "target_uri": fields.get("WARC-Target-URI"), "date": fields.get("WARC-Date"), "fields": fields, "block": data[end + 4 : end + 4 + size]}
        at = end + 4 + size


def _parsed(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for content in batch.column(0).to_pylist():
            for r in parse(content or b""):
                if r["record_type"] == "response":
                    head, _, body = r["block"].partition(b"\r\n\r\n")
                    headers = _fields(head)
                    rows.append((r["record_id"], r["target_uri"], r["date"], list(headers.items()), decoded(body, headers), body, r["fields"].get("WARC-Payload-Digest"), r["fields"].get("WARC-Block-Digest")))
        types = [pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.binary(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["record_id", "target_uri", "date", "headers", "html", "payload", "payload_digest", "block_digest"])


def read_responses(spark, path: str) -> DataFrame:
    """Response records of the WARC files under ``path``; each file is read by one task."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parsed, "record_id string, target_uri string, date string, headers map<string,string>, html string, payload binary, payload_digest string, block_digest string")
