"""WARC derivatives: from response records to linked metadata and conversion records.

``responses`` turns pages (url, html) into WARC response records with an HTTP
head, digests and an id made from their content. ``derive`` makes two records
for each response: a ``metadata`` record (application/warc-fields: title,
language, links, the source's HTTP headers) and a ``conversion`` record with the
page's plain text. Both carry WARC-Refers-To (the response's id), the target
URI, the date and the payload digest of the response, and a block digest of
their own.  ``write_warc`` writes records as .warc.gz files.

Record ids are name-based (SHA-256 of type, id column, URI and payload), so a
task that runs again makes the same records. Digests are ``sha256:<hex>``.

Pages are read by a scanner that passes over them once: quoted attributes may
hold ``>``, the content of scripts, styles and titles is no markup, and a tag or
comment that is never closed ends the page.

Defined cases: null html is an empty payload, whose text is empty; without a
URI the WARC-Target-URI line is left out; repeated pages give records with the
same ids; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATE = "1970-01-01T00:00:00Z"   # of the records, unless the caller knows better
ROWS = 256

#: Elements that stand on lines of their own, whose content is not shown, and whose content is no markup. Fixed values.
BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd tr table thead tbody section article header footer nav main "
                   "aside blockquote pre form figure figcaption address br hr".split())
CELLS = frozenset(("td", "th"))
HIDDEN = frozenset(("template", "noscript", "svg"))
RAW = frozenset(("script", "style", "title", "textarea"))
HEAD_ONLY = frozenset(("title", "meta", "link", "base", "script", "style", "noscript", "template", "head"))

# Possessive: what has been read is never read again, so a page takes time in proportion to its length.
_TAG_END = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_COMMENT_END = re.compile("--!?>")
_BLANKS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")


def markup(page: str):
    """The page's parts in order, in one pass: ("text", text), ("start", name,
    source of the attributes), ("end", name) and ("raw", name, text) for an
    element whose content is no markup. Comments and declarations are left out;
    a tag or comment that the page never closes ends it."""
    at, n = 0, len(page)
    while at < n:
        i = page.find("<", at)
        if i < 0:
            yield "text", page[at:]
            return
        if i > at:
            yield "text", page[at:i]
        mark = page[i + 1:i + 2]
        if mark == "!" and page.startswith("<!--", i):
            if page.startswith((">", "->"), i + 4):
                at = page.index(">", i + 4) + 1
                continue
            end = _COMMENT_END.search(page, i + 4)
            if not end:
                return
            at = end.end()
        elif mark in ("!", "?") or mark == "/" and not page[i + 2:i + 3].isalpha():
            end = page.find(">", i + 2)
            if end < 0:
                if mark == "/" and i + 2 >= n:
                    yield "text", page[i:]
                return
            at = end + 1
        elif name := _NAME.match(page, i + 2 if mark == "/" else i + 1):
            end = _TAG_END.match(page, name.end())
            if not end:
                return
            tag, at = name[0].lower(), end.end()
            if mark == "/":
                yield "end", tag
                continue
            yield "start", tag, page[name.end():at - 1]
            if tag in RAW:
                end = _RAW_END[tag].search(page, at)
                yield "raw", tag, page[at:end.start() if end else n]
                at = end.start() if end else n
        else:
            yield "text", "<"
            at = i + 1


def attribute(source: str, name: str) -> str | None:
    """The value of a tag's first attribute of that name, entities resolved."""
    for m in _ATTRIBUTE.finditer(source):
        if m[1].lower() == name:
            return html.unescape(next((g for g in m.groups()[1:] if g is not None), ""))
    return None


def read_page(page: str) -> tuple[str, str | None, str | None, list[str]]:
    """(visible text, title, language, links). The text has blocks on lines of
    their own and entities resolved; the head, hidden elements, scripts and
    comments are not shown, but links among them count."""
    out: list[str] = []
    title = language = None
    links: list[str] = []
    inside: dict[str, int] = {}   # open hidden elements by name
    in_head = False
    for part in markup(page):
        kind, name = part[0], part[1]
        if kind == "text":
            in_head = in_head and not (name.strip() and not inside)  # words end a head
            if not inside and not in_head:
                out.append(html.unescape(name).replace("\n", " "))
        elif kind == "raw":
            if name == "title" and title is None and "svg" not in inside:
                title = part[2]
            if name == "textarea" and not inside and not in_head:
                out.append(html.unescape(part[2]).replace("\n", " "))
        elif kind == "start":
            if name == "head":
                in_head = True
            elif in_head and not inside and name not in HEAD_ONLY:
                in_head = False
            if name == "html" and language is None:
                language = attribute(part[2], "lang") or None
            if name == "a" and (link := attribute(part[2], "href")) is not None:
                links.append(link)
            if name in HIDDEN and not (name == "svg" and part[2].endswith("/")):
                inside[name] = inside.get(name, 0) + 1
        elif name == "head":
            in_head = False
        elif name in inside:
            inside[name] -= 1
            if not inside[name]:
                del inside[name]
        if kind in ("start", "end") and not inside and not in_head:
            out.append("\n" if name in BLOCKS else " " if name in CELLS else "")
    return _LINES.sub("\n", _BLANKS.sub(" ", "".join(out))).strip(), title, language, links


def _one_line(text: str) -> str:
    return " ".join(text.split())


def _fields(title: str | None, language: str | None, links: list[str], http_head: str) -> str:
    """The block of a metadata record."""
    lines = [f"title: {_one_line(html.unescape(title))}"] if title is not None else []
    lines += [f"language: {_one_line(language)}"] if language else []
    lines += [f"outlink: {_one_line(x)} L a/@href" for x in links]
    lines += [f"http-{line}" for line in http_head.split("\r\n")[1:] if line]
    return "".join(f"{x}\r\n" for x in lines)


def _digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def _record_id(*parts) -> str:
    h = hashlib.sha256("\0".join("" if p is None else str(p) for p in parts).encode("utf-8", "surrogatepass"))
    return f"<urn:uuid:{uuid.UUID(bytes=h.digest()[:16], version=5)}>"


def _head(fields: list[tuple[str, str | None]]) -> str:
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)


def _clean_uri(uri: str | None) -> str | None:
    return None if uri is None else re.sub(r"[\r\n]", "", uri)


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              date: str = DATE) -> DataFrame:
    """page_id, record_id, target_uri, date, http_head, payload and payload_digest of each page's response."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    digest = F.concat(F.lit("sha256:"), F.sha2(payload, 256))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    key = F.sha2(F.concat_ws("\0", F.lit("response"), F.coalesce(F.col(id_col).cast("string"), F.lit("")),
                             F.coalesce(F.col(url_col), F.lit("")), digest), 256)
    part = lambda a, n: F.substring(key, a, n)
    return pages.select(
        F.col(id_col).alias("page_id"),
        F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-8"),
                 part(18, 3), F.lit("-"), part(21, 12), F.lit(">")).alias("record_id"),
        F.regexp_replace(url_col, "[\r\n]", "").alias("target_uri"), F.lit(date).alias("date"),
        head.alias("http_head"), payload.alias("payload"), digest.alias("payload_digest"))


def _derive(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS).to_pydict()
            out: dict[str, list] = {k: [] for k in
                                    ("page_id", "warc_type", "record_id", "refers_to", "target_uri", "content_type",
                                     "content_length", "source_payload_digest", "block_digest", "header", "block")}
            for page_id, rid, uri, date, head, payload, digest in zip(*(part[k] for k in (
                    "page_id", "record_id", "target_uri", "date", "http_head", "payload", "payload_digest"))):
                text, title, language, links = read_page(payload)
                for kind, content, block in (("metadata", "application/warc-fields", _fields(title, language, links, head)),
                                             ("conversion", "text/plain; charset=utf-8", text)):
                    data = block.encode("utf-8", "surrogatepass")
                    own, block_digest = _record_id(kind, rid, digest), _digest(data)
                    header = _head([
                        ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date),
                        ("WARC-Target-URI", uri), ("WARC-Refers-To", rid), ("WARC-Refers-To-Target-URI", uri),
                        ("WARC-Refers-To-Date", date), ("WARC-Source-Payload-Digest", digest),
                        ("WARC-Block-Digest", block_digest), ("Content-Type", content),
                        ("Content-Length", str(len(data)))])
                    for k, v in zip(out, (page_id, kind, own, rid, uri, content, len(data), digest, block_digest, header, block)):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["page_id"], batch.schema.field("page_id").type),
                 *(pa.array(v, pa.int64() if k == "content_length" else pa.string()) for k, v in out.items() if k != "page_id")],
                names=list(out))


def derive(response_rows: DataFrame) -> DataFrame:
    """Two records for each response: page_id, warc_type, record_id,
    refers_to, target_uri, content_type, content_length,
    source_payload_digest, block_digest, header and block."""
    kind = response_rows.schema["page_id"].dataType.simpleString()
    return response_rows.mapInArrow(_derive, f"""page_id {kind}, warc_type string, record_id string, refers_to string,
        target_uri string, content_type string, content_length long, source_payload_digest string,
        block_digest string, header string, block string""")


def write_warc(records: DataFrame, path: str) -> None:
    """Writes records (header, block) as gzipped WARC files, one for each
    partition; the two line ends after a block are the line separator."""
    records.select(F.concat("header", F.lit("\r\n"), "block").alias("value")).write.option(
        "lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
