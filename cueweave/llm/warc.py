"""WARC derivatives: metadata and plain-text conversion records from responses.

A response record is taken apart into its WARC header, HTTP header and payload;
chunked, gzip and deflate bodies are undone.  It yields two linked records: a
``metadata`` record, whose block lists what was found (status, content type, title,
length, outgoing links) and every header of the source, WARC and HTTP, and a
``conversion`` record, whose block is the payload as plain text.  Both carry
WARC-Refers-To with the response's record identifier, its target URI and date, and the
digest of the source payload; each has its own block digest.  Identifiers are
name-based, so a rerun gives the same records.  One map over the responses; no shuffle.
Pages are read a bounded number of times, whatever they leave unclosed.

Defined results: a null or empty record yields nothing that can refer to it, so it
gives no rows; a record that is no response gives no rows; bad bytes are replaced;
an HTTP response without a body gives an empty text, and so does a body that is no
text (by its content type) or whose coding is unknown or broken, which the metadata
tells.  An element or comment that hides text but is never closed hides nothing.  A page with a null address
has the target URI ``about:blank``, a null page is empty.  Repeated rows give
repeated records.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public name space of URLs
_hiding = re.compile(r"<!--|<(script|style|template|noscript)\b", re.IGNORECASE)
_closing = {"": re.compile("-->")} | {k: re.compile(rf"</{k}\s*>", re.IGNORECASE) for k in ("script", "style", "template", "noscript")}
_break = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>", re.IGNORECASE)
_tag = re.compile(r"<[a-zA-Z/!?][^>]*>")
_title, _title_end = re.compile(r"<title\b[^>]*>", re.IGNORECASE), re.compile(r"</title\s*>", re.IGNORECASE)
_anchor = re.compile(r"<a\b([^>]*)>", re.IGNORECASE)
_href = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_textual = re.compile(r"text/|html|xml|json|javascript", re.IGNORECASE)
_charset = re.compile(r"charset=\"?([\w-]+)", re.IGNORECASE)
_blank = re.compile(r"[^\S\n]+")


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>"


def one_line(value: str) -> str:
    return " ".join(value.split())


def build(headers: dict[str, str], block: bytes) -> bytes:
    """A WARC/1.1 record."""
    lines = ["WARC/1.1", *(f"{k}: {one_line(v)}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(record: bytes | None) -> Record | None:
    """Header (names in lower case) and block of one record; None if it isn't one."""
    head, sep, rest = (record or b"").partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"WARC/"):
        return None
    headers: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:  # a folded line goes on with the one before
            headers[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            headers[name] = value.strip()
    length = headers.get("content-length", "")
    return Record(headers, rest[: int(length)] if length.isascii() and length.isdigit() else rest)


def shown(page: str) -> str:
    """A page without comments and elements that are not shown.

    What has no end after one place has none after a later one, so each kind of end
    is missed once at most.
    """
    parts, done, at, missing = [], 0, 0, set()
    while m := _hiding.search(page, at):
        kind, at = (m[1] or "").lower(), m.end()
        if kind not in missing:
            if end := _closing[kind].search(page, at):
                parts += [page[done : m.start()], " "]
                done = at = end.end()
            else:
                missing.add(kind)
    return "".join([*parts, page[done:]])


def halves(page: str) -> tuple[str, str]:
    """What tags can be in, up to the last ">", and the rest."""
    last = page.rfind(">") + 1
    return page[:last], page[last:]


def plain_text(page: str) -> str:
    """Visible text: hidden elements dropped, block elements end lines, entities resolved."""
    tagged, rest = halves(shown(page))
    page = _tag.sub("", _break.sub("\n", tagged)) + rest
    lines = (_blank.sub(" ", x).strip() for x in entities.unescape(page).replace("\r", "\n").split("\n"))
    return "\n".join(x for x in lines if x)


def title_of(page: str) -> str:
    tagged, _ = halves(page)
    start = _title.search(tagged)
    end = start and _title_end.search(tagged, start.end())
    return one_line(entities.unescape(_tag.sub("", tagged[start.end() : end.start()]))) if end else ""


def links_of(page: str) -> list[str]:
    """The address of every anchor that has one."""
    found = (_href.search(tag) for tag in _anchor.findall(halves(shown(page))[0]))
    return [entities.unescape(m[1] or m[2] or m[3] or "") for m in found if m]


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; what is left of a broken one stays as it is."""
    parts, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].partition(b";")[0], 16)
        except ValueError:
            return b"".join(parts) + body[at:]
        if size <= 0:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(parts)


def inflated(body: bytes, window: int, several: bool) -> bytes | None:
    """Decompressed data, of all members if there may be ``several``; None if it is cut short,
    followed by anything but zeros, or larger than MOST_CONTENT."""
    parts, size = [], 0
    while True:
        stream = zlib.decompressobj(window)
        parts.append(stream.decompress(body, MOST_CONTENT + 1 - size))
        size += len(parts[-1])
        if size > MOST_CONTENT or not stream.eof:
            return None
        body = stream.unused_data
        if not body.strip(b"\0"):
            return b"".join(parts)
        if not several:
            return None


def uncoded(body: bytes, codings: str) -> bytes | None:
    """The content of a payload after its content codings (a payload of no bytes has none);
    None if a coding is unknown, broken or cut short, or the content is too large."""
    for coding in reversed([c.strip().lower() for c in codings.split(",") if c.strip()]):
        if coding not in ("gzip", "x-gzip", "deflate", "identity"):
            return None
        if coding == "identity" or not body:
            continue
        try:
            body = inflated(body, 31, True) if "gzip" in coding else inflated(body, 15 if body[:1] == b"\x78" else -15, False)
        except zlib.error:
            return None
        if body is None:
            return None
    return body


def response_of(page_id: int | None, url: str | None, page: str | None) -> bytes:
    """The response record of a stored page."""
    body = (page or "").encode("utf-8", "surrogatepass")
    uri = url or "about:blank"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    headers = {
        "WARC-Type": "response", "WARC-Record-ID": record_id(f"response {page_id} {uri}"), "WARC-Date": DATE, "WARC-Target-URI": uri,
        "WARC-Payload-Digest": digest(body), "WARC-Block-Digest": digest(http), "Content-Type": "application/http; msgtype=response",
    }
    return build(headers, http)


def derive(record: bytes | None) -> list[tuple[str, str, str, str, str, str, str, int, int, str, bytes]]:
    """The metadata and conversion records of a response, as rows of DERIVED."""
    source = parse(record)
    if source is None or source.headers.get("warc-type", "").lower() != "response":
        return []
    own = source.headers
    head, _, sent = source.block.partition(b"\r\n\r\n")
    lines = head.decode("iso-8859-1").split("\r\n")
    status = lines[0].split(" ")[1] if lines[0].startswith("HTTP/") and " " in lines[0] else ""
    fields = [(k.strip().lower(), v.strip()) for k, sep, v in (x.partition(":") for x in lines[1:]) if sep]
    http = dict(reversed(fields))  # the first of repeated headers counts
    body = unchunked(sent) if "chunked" in http.get("transfer-encoding", "").lower() else sent
    content = uncoded(body, http.get("content-encoding", ""))
    kind = http.get("content-type", "")
    charset = m[1] if (m := _charset.search(kind)) else "utf-8"
    page = ""
    if content is not None and (not kind or _textual.search(kind)):
        try:
            page = content.decode(charset, "replace")
        except LookupError:
            page = content.decode("utf-8", "replace")
    is_page = "html" in kind.lower() or not kind
    text, title, links = (plain_text(page), title_of(page), links_of(page)) if is_page else (page, "", [])
    refers, uri = own.get("warc-record-id", ""), own.get("warc-target-uri", "")
    payload = digest(body)
    claimed = own.get("warc-payload-digest", "")
    fields = [("status", status), ("content-type", kind), ("payload-length", str(len(body))), ("payload-digest", payload),
              ("source-payload-digest", claimed), ("digest-agrees", str(claimed in (payload, digest(sent))).lower()), ("content-decoded", str(content is not None).lower()), ("title", title),
              *((f"source-warc-{k}", v) for k, v in own.items()), *((f"source-http-{k}", v) for k, v in fields), *(("outlink", x) for x in links)]
    about = "".join(f"{k}: {one_line(v)}\r\n" for k, v in fields).encode("utf-8", "replace")
    out = []
    for what, block, made in (("metadata", about, "application/warc-fields"), ("conversion", text.encode("utf-8", "replace"), "text/plain; charset=utf-8")):
        headers = {"WARC-Type": what, "WARC-Record-ID": record_id(f"{what} {refers}"), "WARC-Date": own.get("warc-date", DATE), "WARC-Target-URI": uri,
                   "WARC-Refers-To": refers, "WARC-Refers-To-Target-URI": uri, "WARC-Refers-To-Date": own.get("warc-date", DATE),
                   "WARC-Source-Payload-Digest": claimed or payload, "WARC-Block-Digest": digest(block), "Content-Type": made}
        out.append((what, headers["WARC-Record-ID"], refers, uri, headers["WARC-Date"], headers["WARC-Source-Payload-Digest"], headers["WARC-Block-Digest"], len(block), len(links), title, build(headers, block)))
    return out


#: Larger content is told as not decoded, so that a small body can not fill a worker's memory.
MOST_CONTENT = 256 << 20
DERIVED = "record_type string, record_id string, refers_to string, target_uri string, warc_date string, source_digest string, block_digest string, content_length long, n_links long, title string, record binary"
_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def responses(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, record): a response record for each stored page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [response_of(i.as_py(), u.as_py(), h.as_py()) for i, u, h in zip(*batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["page_id", "record"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col), F.col(html_col)).mapInArrow(run, "page_id long, record binary")


def derivatives(records: DataFrame, *, id_col: str = "page_id", record_col: str = "record") -> DataFrame:
    """The derived records of response records: page_id and the columns of DERIVED."""
    names = [c.split()[0] for c in DERIVED.split(", ")]
    kinds = [_KINDS[c.split()[1]] for c in DERIVED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i.as_py(), *row) for i, r in zip(*batch.columns, strict=True) for row in derive(r.as_py())]
            columns = list(zip(*rows, strict=True)) or [()] * (len(names) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), *kinds], strict=True)], ["page_id", *names])

    return records.select(F.col(id_col).cast("long").alias("page_id"), F.col(record_col)).mapInArrow(run, "page_id long, " + DERIVED)
