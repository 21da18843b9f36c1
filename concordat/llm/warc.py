"""WARC derivative builder: responses become linked metadata and plain-text conversion records.

A response record gives two more: a metadata record (links, title, language, description) and, if its payload is HTML or
text, a conversion record with the plain text. Both refer to the response by WARC-Refers-To and repeat its target address,
date and payload digest: the source's own digest where its record states one, else one made of the payload as it lies
there. The metadata's block keeps the headers of the source: those of HTTP as http-*, the record's own named fields as
warc-*. Chunked transfer encoding and gzip or deflate content encoding are undone before the text is read.

Identifiers are made from the response's identifier and the kind, so a task that runs again after a loss gives the same
records. Each record is one row; `record` holds it as bytes of WARC/1.1, ready to be concatenated or gzipped one by one.
The work is one pass over whole payloads without a shuffle.

WARC files are read by Spark's text source with the border of two records as its separator, so that a task holds one
record, not a file, and uncompressed files are split. Files in which a payload holds that border are found by their
Content-Length fields and read whole, one a task.

Defined results: a null payload counts as empty. A null identifier gives one made from address and payload. Repeated rows
give repeated records. Payloads that aren't UTF-8 are read by the declared charset, else as UTF-8 with replacements. A
payload that can't be decoded as it says, or is in an encoding other than these, has a metadata record only. An empty
table gives an empty result. A carried column named like an output is left out.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.llm.shared import carried

VERSION = "WARC/1.1"
SCHEMA = "warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, block_digest string, payload_digest string, content_length bigint, block string, record binary"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122

#: Start tags that end an svg element which lacks its end tag.
_BREAKOUT = r"<(?:/?body|/html|article|aside|blockquote|center|div|dl|dd|dt|footer|form|h[1-6]|header|hr|img|li|main|nav|ol|p|pre|section|span|table|ul)(?=[\s/>])"
#: Comments, elements that show no text, and a head: up to its end tag, or to the first element or text that can't be in one.
_DROPPED = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<svg(?=[\s/>])[^>]*/>"
    rf"|<svg(?=[\s/>])[^>]*>(?:.*?</svg\s*>|.*?(?={_BREAKOUT})|.*)"
    r"|<head(?=[\s/>])[^>]*>(?:\s+|<!--.*?(?:-->|\Z)|<(title|script|style|noscript|template)(?=[\s/>])[^>]*>.*?(?:</\2\s*>|\Z)|</?(?:meta|link|base|basefont|bgsound|noframes)(?=[\s/>])[^>]*>)*+(?:</head\s*>)?",
    re.S | re.I,
)
_SCRIPTS = re.compile(r"<!--.*?(?:-->|\Z)|(<(script|style)\b[^>]*>).*?(?:</\2\s*>|\Z)", re.S | re.I)
_SOURCE = re.compile(r"""<script[\s/](?:.*[\s"'/])?src\s*=""", re.S | re.I)
_BREAKS = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|option|p|pre|section|table|td|th|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z!?][^>]*>")
_BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_LINK = re.compile(r"<(a|area|link|img|script|iframe|source)\b([^>]*)>", re.S | re.I)
_TARGET = re.compile(r"""\b(?:href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_LANGUAGE = re.compile(r"""<html\b[^>]*?\slang\s*=\s*["']?([A-Za-z0-9-]+)""", re.I)
_CHARSET = re.compile(r"""charset\s*=\s*["']?([A-Za-z0-9_-]+)""", re.I)
_META = re.compile(r"""<meta\b[^>]*?\bname\s*=\s*["']?description["']?[^>]*?\bcontent\s*=\s*(?:"([^"]*)"|'([^']*)')""", re.I)


def sha1(data: bytes) -> str:
    """A digest as WARC writes it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """An identifier that the same parts always get."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, chr(31).join(parts))}>"


def plain_text(page: str) -> str:
    """The text of an HTML page: a line for each block, blanks run together, entities resolved, no empty lines."""
    body = _TAG.sub("", _BREAKS.sub("\n", _DROPPED.sub(" ", page).replace("\n", " ")))
    lines = (_BLANKS.sub(" ", x).strip() for x in entities.unescape(body).split("\n"))
    return "\n".join(x for x in lines if x)


def links(page: str, base: str) -> list[tuple[str, str]]:
    """(element, absolute address) of each link, in order, each once."""
    found: dict[tuple[str, str], None] = {}
    for m in _LINK.finditer(_SCRIPTS.sub(lambda s: s[1] if s[1] and _SOURCE.match(s[1]) else " ", page)):
        if t := _TARGET.search(m[2]):
            raw = entities.unescape(next(x for x in t.groups() if x is not None).strip())
            if raw and not raw.lower().startswith(("javascript:", "data:")):
                try:
                    found[m[1].lower(), urljoin(base, raw)] = None
                except ValueError:
                    found[m[1].lower(), raw] = None
    return list(found)


def _field(value: str) -> str:
    """A value as one header line."""
    return re.sub(r"\s+", " ", value).strip()


def to_bytes(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record of WARC/1.1."""
    head = "".join(f"{k}: {_field(v)}\r\n" for k, v in fields if v)
    return f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields in lower case, block) of each record in uncompressed WARC bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size
        while data[at : at + 2] == b"\r\n":
            at += 2


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, payload) of a response block."""
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)], payload


def unchunked(data: bytes) -> bytes | None:
    """The body behind chunked transfer encoding; None if it isn't well formed."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        size = data[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not size or size.strip(b"0123456789abcdefABCDEF"):
            return None
        length = int(size, 16)
        if not length:
            return b"".join(out)
        if len(data) < end + 2 + length:
            return None
        out.append(data[end + 2 : end + 2 + length])
        at = end + 2 + length + 2


def _inflated(data: bytes, modes: tuple[int, ...]) -> bytes | None:
    """All members of compressed data in the first of zlib's window modes that reads it."""
    for mode in modes:
        out, rest = [], data
        try:
            while rest:
                one = zlib.decompressobj(mode)
                out.append(one.decompress(rest) + one.flush())
                if not one.eof:
                    break
                rest = one.unused_data
            else:
                return b"".join(out)
        except zlib.error:
            continue
    return None


def body_of(payload: bytes, headers: list[tuple[str, str]]) -> bytes | None:
    """The payload without its transfer and content encodings; None where they can't be undone.

    Many crawlers undo them and keep the headers, so a payload that plainly isn't encoded stays as it is.
    """
    listed = lambda name: [x.strip().lower() for k, v in headers if k.lower() == name for x in v.split(",") if x.strip()]
    data = payload
    if "chunked" in listed("transfer-encoding"):
        opened = unchunked(data)
        data = data if opened is None else opened
    for encoding in reversed(listed("content-encoding")):
        if encoding in ("identity", "none"):
            continue
        if encoding in ("gzip", "x-gzip"):
            opened = _inflated(data, (31,)) if data[:2] == b"\x1f\x8b" else data
        elif encoding == "deflate":
            opened = _inflated(data, (15, -15))
        else:
            opened = None
        if opened is None:
            return None
        data = opened
    return data


def decoded(payload: bytes, content_type: str) -> str:
    m = _CHARSET.search(content_type) or _CHARSET.search(payload[:2048].decode("latin-1"))
    try:
        return payload.decode(m[1] if m else "utf-8")
    except (UnicodeDecodeError, LookupError):
        return payload.decode("utf-8", "replace")


#: Named fields of a response that its derivatives have of their own.
_OWN_FIELDS = ("warc-type", "warc-record-id", "warc-block-digest", "content-length", "content-type", "warc-target-uri", "warc-date", "warc-payload-digest")


def derive(record: str | None, uri: str | None, date: str | None, headers: list[tuple[str, str]], payload: bytes, fields: list[tuple[str, str]] = ()) -> Iterator[tuple]:
    """The values of SCHEMA for the metadata record and the conversion record of one response. fields: its record's own."""
    uri, date = uri or "", date or ""
    stated = next((v for k, v in fields if k.lower() == "warc-payload-digest" and v.strip()), "")
    digest = stated or sha1(payload)
    source = record or record_id("response", uri, digest)
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    data = body_of(payload, headers)
    as_text = data is not None and re.match(r"text/plain\b", kind, re.I)
    as_page = data is not None and (not kind or re.match(r"text/html\b|application/xhtml", kind, re.I))
    body = decoded(data, kind) if as_text or as_page else ""
    title = _TITLE.search(body) if as_page else None
    about = _META.search(body) if as_page else None
    language = _LANGUAGE.search(body) if as_page else None
    lines = [("title", entities.unescape(title[1]) if title else ""), ("language", language[1] if language else ""), ("description", entities.unescape(about[1] or about[2] or "") if about else "")]
    lines += [(f"http-{k.lower()}", v) for k, v in headers]
    lines += [(k.lower() if k.lower().startswith("warc-") else f"warc-{k.lower()}", v) for k, v in fields if k.lower() not in _OWN_FIELDS]
    lines += [("outlink", f"{where} {name}") for name, where in links(body, uri)] if as_page else []
    made = [("metadata", "application/warc-fields", "".join(f"{k}: {_field(v)}\r\n" for k, v in lines if _field(v)))]
    if as_text or as_page:
        made.append(("conversion", "text/plain; charset=UTF-8", plain_text(body) if as_page else body))
    for name, content, block in made:
        own, data = record_id(name, source), block.encode("utf-8", "replace")
        named = [("WARC-Type", name), ("WARC-Record-ID", own), ("WARC-Refers-To", source), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Payload-Digest", digest), ("WARC-Block-Digest", sha1(data)), ("Content-Type", content)]
        yield name, own, source, uri, date, content, sha1(data), digest, len(data), data.decode(), to_bytes(named, data)


def build(responses: DataFrame, *, record: str = "record_id", uri: str = "target_uri", date: str = "warc_date", headers: str = "http_headers", payload: str = "payload", fields: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Metadata and conversion records of responses: (*carry, SCHEMA), two rows a response, or one if it has no text.

    headers, and fields (the source record's own, where there are any): array of struct(name, value); payload: binary.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    carry = carried(carry, *names)
    own_fields = F.col(fields) if fields else F.lit(None).cast("array<struct<name:string,value:string>>")
    rows = responses.select(*carry, F.col(record).alias("__r"), F.col(uri).alias("__u"), F.col(date).cast("string").alias("__d"), F.col(headers).alias("__h"), F.col(payload).alias("__p"), own_fields.alias("__f"))
    types = [{"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in SCHEMA.split(", ")]
    n = len(carry)
    listed = lambda values: [(y["name"] or "", y["value"] or "") for y in values or [] if y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for at in range(0, x.num_rows, 256):
                part = x.slice(at, 256)
                own, out = [], []
                for k, (r, u, d, h, p, f) in enumerate(zip(*(c.to_pylist() for c in part.columns[n:]))):
                    for values in derive(r, u, d, listed(h), p or b"", listed(f)):
                        own.append(k)
                        out.append(values)
                kept = part.select(list(range(n))).take(pa.array(own, pa.int64())).columns if n else []
                columns = zip(*out) if out else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, columns, types)], [*carry, *names])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n]]
    return rows.mapInArrow(run, ", ".join([*kinds, SCHEMA]))


#: Where one record ends and the next begins.
BORDER = "\r\n\r\nWARC/1."
RESPONSE = "record_id string, target_uri string, warc_date string, http_headers array<struct<name:string,value:string>>, payload binary, warc_fields array<struct<name:string,value:string>>"


def _response(fields: list[tuple[str, str]], block: bytes) -> tuple:
    """The values of RESPONSE of a response record."""
    own = {k.lower(): v for k, v in reversed(fields)}
    _, headers, payload = split_http(block)
    pairs = lambda values: [{"name": k, "value": v} for k, v in values]
    return own.get("warc-record-id"), own.get("warc-target-uri"), own.get("warc-date"), pairs(headers), payload, pairs(fields)


def _responses(records: DataFrame, parsed) -> DataFrame:
    """RESPONSE rows of records: one binary column that parsed takes apart into (fields, block)."""
    kind = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
    types = [pa.string(), pa.string(), pa.string(), kind, pa.binary(), kind]
    names = ["record_id", "target_uri", "warc_date", "http_headers", "payload", "warc_fields"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for k in range(x.num_rows):
                for fields, block in parsed(x.column(0)[k].as_py() or b""):
                    if any(a.lower() == "warc-type" and b.lower() == "response" for a, b in fields):
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(_response(fields, block), types)], names)

    return records.mapInArrow(run, RESPONSE)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files (.warc, or .warc.gz with a member for each record): RESPONSE."""
    pieces = spark.read.option("lineSep", BORDER).text(path).select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"))
    # What is left of a record that was cut at a border within its payload is shorter than its Content-Length says.
    head = F.substring_index(F.decode("piece", "ISO-8859-1"), "\r\n\r\n", 1)
    size = F.regexp_extract(head, r"(?i)(?:^|\n)content-length:[ \t]*([0-9]+)", 1).try_cast("bigint")
    whole_record = F.coalesce(F.octet_length("piece") - F.length(head) - 4 >= size, F.lit(False))
    cut = [r.file for r in pieces.filter(~whole_record & (F.length(F.trim(head)) > 0)).select("file").distinct().toLocalIterator()]
    found = _responses(pieces.filter(~F.col("file").isin(cut)).select("piece") if cut else pieces.select("piece"), _piece)
    if not cut:
        return found
    return found.union(_responses(spark.read.format("binaryFile").load(cut).select("content"), _file))


def _piece(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(fields, block) of what stands between two borders."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]  # after the version
    fields = [(k.strip(), v.strip()) for k, mark, v in (x.partition(":") for x in lines) if mark]
    size = next((int(v) for k, v in fields if k.lower() == "content-length"), 0)
    yield fields, rest[:size]


def _file(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(fields, block) of each record of a whole file."""
    if data[:2] == b"\x1f\x8b":
        data = _inflated(data, (31,)) or b""
    return ((list(fields.items()), block) for fields, block in parse(data))


def as_responses(pages: DataFrame, *, url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z", carry: tuple[str, ...] = ()) -> DataFrame:
    """Crawled pages as response records with the headers of HTML in UTF-8; the identifier is made later."""
    header = F.array(F.struct(F.lit("Content-Type").alias("name"), F.lit("text/html; charset=UTF-8").alias("value")))
    return pages.select(*carry, F.lit(None).cast("string").alias("record_id"), F.col(url).alias("target_uri"), F.lit(date).alias("warc_date"), header.alias("http_headers"), F.encode(F.coalesce(html, F.lit("")), "UTF-8").alias("payload"))
