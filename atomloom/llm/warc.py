"""WARC derivatives: metadata and plain-text conversion records linked to the responses they come from.

``derive`` takes response records (record_id, target_uri, date, headers: the WARC header as a map, block: the HTTP
message) and makes, for each, a metadata record and, where the payload is text, a conversion record. Both refer to the
response by WARC-Refers-To, with its target URI and date; the metadata body keeps the response's WARC header, its HTTP
status line and header, its digests as given and as computed, the title and the outlinks. Ids are derived from the
response's id, so a task that runs again makes the same records. Each record comes with its fields and with ``warc``,
its bytes as one gzip member: members in any order are a WARC file. ``parse`` reads such bytes back.

Payloads with chunked transfer or gzip/deflate coding are decoded first. What can't be decoded (broken, of a coding that
isn't known, or of more than ``MOST_PAYLOAD`` bytes when decoded) counts as it stands, gives no conversion record and has
``problem`` in the metadata. Plain text: script, style, template, noscript, head and comments go, block elements break
lines, entities are resolved, white space collapses, empty lines go. Pages are read in one go whatever they hold: "<"
without an end, tags that never close and numbers without end take time in proportion to their length.

``read_responses`` takes whole files (binaryFile rows, below 2 GB each) and ``stream_responses`` files of any size, which
a task reads piece by piece; both hold two records at a time. A record with a bad length, a file that ends inside a record,
bytes that are no record and broken gzip are rows with ``problem`` set, and reading goes on at the next record: after broken
gzip at the next member that begins with one, and the row says so if none was found.

Defined cases: a null block is an empty message (metadata only); a null id is derived from URI, date and block; a null
URI or date is an empty field; line breaks in header values become spaces; no Content-Type counts as HTML if the payload
starts with "<"; an unknown charset, or one that isn't made for text, is read as UTF-8; a record field takes the place of
a kept column of the same name; an empty table gives none. Everything is record by record: there is no shuffle.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html
import re
import uuid
import zlib
from itertools import chain

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomloom.llm.common import quoted, slices

RECORD = "source_id string, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, headers map<string,string>, text string, block_digest string, n_links long, warc binary"
#: Fixed values of HTML: elements that are dropped with their content, and elements that break lines.
DROPPED = "script|style|template|noscript|head|svg"
BREAKING = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_DROPPED = re.compile(rf"<({DROPPED})\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(rf"</?(?:{BREAKING})\b[^>]*>", re.I)
_TAG = re.compile(r"<[/!?a-zA-Z][^>]*>")
_TITLE, _TITLE_END = re.compile(r"<title\b[^>]*>", re.I), re.compile(r"</title", re.I)
_LINK = re.compile(r"<a\b[^>]*>", re.I)
_HREF = re.compile(r"""\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_SPACE = re.compile(r"\s+")
_NUMBER = re.compile(r"&#(?:[xX]([0-9a-fA-F]{9,})|([0-9]{9,}));?")
#: Python codecs that aren't character sets of pages.
NOT_CHARSETS = {"idna", "punycode", "undefined", "unicode_escape", "raw_unicode_escape", "utf_7", "mbcs", "oem"}
MOST_PAYLOAD, MOST_HEADER, CHUNK = 256 << 20, 1 << 20, 1 << 20
#: How a gzip member begins; compressed bytes kept of a member to look for the next one in, and looked at to tell that it is one.
GZIP, RESCAN, LOOK = b"\x1f\x8b\x08", 8 << 20, 4096


def unescaped(text: str) -> str:
    """Entities resolved; numbers too long for a character count as the replacement character."""

    def short(m: re.Match) -> str:
        number = (m[1] or m[2]).lstrip("0") or "0"
        return "�" if len(number) > 8 else f"&#{'x' if m[1] else ''}{number};"

    return html.unescape(_NUMBER.sub(short, text) if "&#" in text else text)


def without(pattern: re.Pattern, by: str, page: str) -> str:
    """``page`` with tags replaced. One that never ends does so at the end of the page, so that looking for it is linear."""
    out = pattern.sub(by, page + "\0>\0")
    return out.removesuffix("\0>\0") if out.endswith("\0>\0") else out.removesuffix("\0")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source}#{kind}')}>"


def plain_text(page: str) -> str:
    page = without(_BREAK, "\n", without(_DROPPED, " ", _COMMENT.sub(" ", page)))
    lines = (_SPACE.sub(" ", x).strip() for x in unescaped(without(_TAG, "", page)).split("\n"))
    return "\n".join(x for x in lines if x)


def outlinks(page: str) -> list[str]:
    found = (_HREF.search(m[0]) for m in _LINK.finditer(page + ">"))
    return [unescaped(x[1].strip("\"'")) for x in found if x]


def title(page: str) -> str:
    begin = _TITLE.search(page[: page.rfind(">") + 1])
    end = _TITLE_END.search(page, begin.end()) if begin else None
    return _SPACE.sub(" ", unescaped(page[begin.end() : end.start()])).strip() if end else ""


def split_message(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, header fields, payload as sent) of an HTTP message."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        return "", [], block
    first, *rest = head.decode("utf-8", "replace").split("\r\n")
    return first, [(a.strip(), b.strip()) for a, _, b in (x.partition(":") for x in rest)], body


def _dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while at < len(body):
        end = body.find(b"\r\n", at, at + 1024)
        if end < 0:
            raise ValueError("no chunk size")
        n = int(body[at:end].split(b";")[0], 16)
        if n < 0:
            raise ValueError("negative chunk size")
        if n == 0:
            break
        if end + 2 + n > len(body):
            raise ValueError("cut chunk")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out)


def inflated(body: bytes, wbits: int, most: int = MOST_PAYLOAD) -> bytes:
    """The members of ``body`` unpacked; a ValueError beyond ``most`` bytes or if the last is cut."""
    out, size = [], 0
    while body:
        one = zlib.decompressobj(wbits)
        out.append(one.decompress(body, most + 1 - size))
        size += len(out[-1])
        if size > most:
            raise ValueError("too large")
        if not one.eof:
            raise ValueError("cut")
        body = one.unused_data if wbits == 31 and one.unused_data[:2] == b"\x1f\x8b" else b""
    return b"".join(out)


def decoded_payload(fields: list[tuple[str, str]], body: bytes, most: int = MOST_PAYLOAD) -> tuple[bytes, str]:
    """(payload, problem): without transfer and content coding, or as sent with what is wrong with it."""
    by = {k.lower(): v.lower() for k, v in fields}
    coding = by.get("content-encoding", "").strip()
    try:
        out = _dechunked(body) if "chunked" in by.get("transfer-encoding", "") else body
        if coding in ("gzip", "x-gzip"):
            out = inflated(out, 31, most)
        elif coding == "deflate":
            out = inflated(out, 15 if out[:1] == b"\x78" else -15, most)
        elif coding not in ("", "identity"):
            return body, f"payload coding: {coding[:40]} is not known"
    except (ValueError, zlib.error) as e:
        return body, f"payload coding: {e}"
    return out, ""


def decoded_text(payload: bytes, charset: str | None) -> str:
    try:
        name = codecs.lookup(charset or "utf-8").name.replace("-", "_")
        return payload.decode("utf-8" if name in NOT_CHARSETS else name, "replace")
    except (LookupError, ValueError):
        return payload.decode("utf-8", "replace")


def record_bytes(header: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {_SPACE.sub(' ', v)}\r\n" for k, v in header.items())
    return gzip.compress(f"WARC/1.1\r\n{lines}\r\n".encode("utf-8", "replace") + block + b"\r\n\r\n", 6, mtime=0)


class Reader:
    """Records out of WARC bytes that come piece by piece: (header, block, problem); ``wanted`` types keep their block."""

    def __init__(self, wanted: tuple[str, ...] | None = None):
        self.wanted, self.held, self.header, self.size, self.looked, self.lost = wanted, bytearray(), None, 0, 0, False

    def _fail(self, header: dict, problem: str):
        self.lost, self.looked = True, 0
        return header, b"", problem

    def feed(self, data: bytes):
        self.held += data
        while True:
            if self.header is not None:
                keep = self.wanted is None or self.header.get("WARC-Type") in self.wanted
                if not keep:  # passed over without being held
                    n = min(len(self.held), self.size)
                    del self.held[:n]
                    self.size -= n
                if len(self.held) < self.size or (not keep and self.size):
                    return
                if keep:
                    block = bytes(self.held[: self.size])
                    del self.held[: self.size]
                    yield self.header, block, None
                self.header, self.looked = None, 0
                continue
            if self.lost:
                at = self.held.find(b"\nWARC/")
                if at < 0:
                    del self.held[:-5]
                    return
                del self.held[: at + 1]
                self.lost = False
            if not self.looked:
                blank = 0
                while blank < len(self.held) and self.held[blank] in b"\r\n":
                    blank += 1
                del self.held[:blank]
            end = self.held.find(b"\r\n\r\n", self.looked)
            if not b"WARC/".startswith(bytes(self.held[:5])) or (end < 0 and len(self.held) > MOST_HEADER):
                yield self._fail({}, "no WARC header")
                continue
            if end < 0:
                self.looked = max(0, len(self.held) - 3)
                return
            _, *lines = bytes(self.held[:end]).decode("utf-8", "replace").split("\r\n")
            header = {a.strip(): b.strip() for a, _, b in (x.partition(":") for x in lines)}
            length = header.get("Content-Length", "")
            if not (length.isascii() and length.isdigit() and len(length) < 16):
                yield self._fail(header, f"Content-Length: {length[:40]}")
                continue
            del self.held[: end + 4]
            self.header, self.size = header, int(length)

    def finish(self, problem: str = "the file ends inside a record"):
        if self.header is not None:
            yield self.header, bytes(self.held), problem
        elif self.held.strip(b"\r\n") and not self.lost:
            yield {}, b"", problem


def starts_record(data: bytes) -> bool:
    """Whether a gzip member that holds a record begins here."""
    try:
        return zlib.decompressobj(31).decompress(data, 5) == b"WARC/"
    except zlib.error:
        return False


def next_member(held: bytes, pieces) -> bytes | None:
    """What follows from the next member with a record on, looked for behind the first byte of ``held``; None without one."""
    at = 1
    while True:
        at = held.find(GZIP, at)
        if at < 0 or len(held) - at < LOOK:
            piece = next(pieces, None)
            if piece is not None:
                at = len(held) - 2 if at < 0 else at
                at = max(at, 0)
                held, at = held[at:] + piece, 0
                continue
            if at < 0:
                return None
        if starts_record(held[at : at + LOOK]):
            return held[at:]
        at += 1


def unzipped(pieces):
    """Events from the bytes of a file: (plain, bytes) of one that isn't gzipped; else, in any number of members, (data, bytes),
    (end, None) after a whole member, and (broken, why), after which reading goes on at the next member that begins with a record."""
    pieces = iter(pieces)
    rest = next(pieces, b"")
    while 0 < len(rest) < 2 and (piece := next(pieces, None)) is not None:
        rest += piece
    if not rest.startswith(GZIP[:2]):
        yield from (("plain", piece) for piece in chain([rest] if rest else [], pieces))
        return
    one, held = None, bytearray()
    while True:
        if one is None:
            rest = rest.lstrip(b"\0")  # padding
            while not rest:
                piece = next(pieces, None)
                if piece is None:
                    return
                rest = piece.lstrip(b"\0")
            one, held = zlib.decompressobj(31), bytearray()
        try:
            out = one.decompress(rest, CHUNK)
        except zlib.error as e:
            # the damage may lie before the place where it shows, and reach into the next member
            rest = next_member(bytes(held) + rest, pieces)
            one = None
            yield "broken", f"broken gzip: {e}" + ("; no record was found behind it" if rest is None else "")
            if rest is None:
                return
            continue
        held += rest[: len(rest) - len(one.unused_data) - len(one.unconsumed_tail)]
        del held[:-RESCAN]
        rest = one.unused_data if one.eof else one.unconsumed_tail
        if out:
            yield "data", out
        if one.eof:
            one = None
            yield "end", None
        elif not out and not rest:
            piece = next(pieces, None)
            if piece is None:
                yield "broken", "broken gzip: it ends early"
                return
            rest = piece


def cut(data: bytes):
    view = memoryview(data)
    return (bytes(view[k : k + CHUNK]) for k in range(0, len(data), CHUNK))


def parse(data: bytes):
    """(header, block) of each whole record in WARC bytes, gzipped or not."""
    return ((h, b) for h, b, problem in records(cut(data)) if problem is None)


def records(pieces, wanted: tuple[str, ...] | None = None):
    """(header, block, problem) of each record of a file that comes in ``pieces``, and of each place where it is broken.

    A record comes out when the next one does or when its gzip member has ended whole; else it has the member's problem.
    """
    reader, last = Reader(wanted), []
    for kind, x in unzipped(pieces):
        if kind == "plain":
            yield from reader.feed(x)
            continue
        if kind == "data":
            for r in reader.feed(x):
                if r[2] is None:  # bytes that are no record may come from the same damage
                    yield from last
                    last = []
                last.append(r)
            continue
        if kind == "broken":
            lost = [(h, b, x) for h, b, _ in [*last, *reader.finish(x)] if h]
            last, reader = lost or [({}, b"", x)], Reader(wanted)
        yield from last
        last = []
    yield from last
    yield from reader.finish()


def derive_one(record_id: str | None, uri: str | None, date: str | None, header: dict[str, str], block: bytes | None) -> list[dict]:
    """The derivative records of one response."""
    block, uri, date = block or b"", uri or "", date or ""
    source = record_id or derived_id(f"{uri} {date} {digest(block)}", "response")
    status, fields, body = split_message(block)
    payload, problem = decoded_payload(fields, body)
    kind = next((v for k, v in fields if k.lower() == "content-type"), "")
    charset = re.search(r"charset=\"?([\w.-]+)", kind, re.I)
    page = decoded_text(payload, charset[1] if charset else None)
    is_html = not problem and ("html" in kind.lower() or (not kind and payload.lstrip()[:1] == b"<"))
    is_text = bool(payload) and not problem and (is_html or kind.lower().startswith("text/"))
    links = outlinks(page) if is_html else []
    common = {"WARC-Refers-To": source, "WARC-Refers-To-Target-URI": uri, "WARC-Refers-To-Date": date, "WARC-Target-URI": uri, "WARC-Date": date}

    def made(kind_: str, content: str, body_: bytes, text: str | None, n_links: int) -> dict:
        own = derived_id(source, kind_)
        head = {"WARC-Type": kind_, "WARC-Record-ID": own, **common, "Content-Type": content, "WARC-Block-Digest": digest(body_), "Content-Length": str(len(body_))}
        return {"source_id": source, "record_type": kind_, "record_id": own, "refers_to": source, "target_uri": uri, "date": date, "content_type": content, "headers": list(head.items()), "text": text, "block_digest": head["WARC-Block-Digest"], "n_links": n_links, "warc": record_bytes(head, body_)}

    lines = [("http-status", status), *((f"http-{k.lower()}", v) for k, v in fields), *((f"source-{k}", v) for k, v in sorted(header.items()))]
    lines += [("block-digest", digest(block)), ("payload-digest", digest(payload)), ("title", title(page) if is_html else ""), ("problem", problem), *(("outlink", x) for x in links)]
    facts = "".join(f"{_SPACE.sub(' ', k)}: {_SPACE.sub(' ', v)}\r\n" for k, v in lines if v)
    out = [made("metadata", "application/warc-fields", facts.encode("utf-8", "replace"), facts, len(links))]
    if is_text:
        text = plain_text(page) if is_html else page
        out.append(made("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"), text, len(links)))
    return out


def derive(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The derivative records of response records (record_id, target_uri, date, headers, block), with columns ``keep``."""
    from pyspark.sql import types as T

    made = T._parse_datatype_string(RECORD)
    keep = tuple(c for c in keep if c.lower() not in {f.name for f in made})
    schema = T.StructType([responses.schema[c] for c in keep] + list(made))
    names = [f.name for f in made]
    arrow = [pa.map_(pa.string(), pa.string()) if n == "headers" else pa.int64() if n == "n_links" else pa.binary() if n == "warc" else pa.string() for n in names]

    def run(batches):
        for batch in slices(batches, "block"):
            cols = [batch.column(c).to_pylist() for c in ("record_id", "target_uri", "date", "headers", "block")]
            found = [derive_one(i, u, d, dict(h or []), b) for i, u, d, h, b in zip(*cols, strict=True)]
            at = pa.array([k for k, x in enumerate(found) for _ in x], pa.int64())
            flat = [r for x in found for r in x]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keep), *(pa.array([r[n] for r in flat], t) for n, t in zip(names, arrow, strict=True))], names=[*keep, *names])

    wanted = dict.fromkeys([*keep, "record_id", "target_uri", "date", "headers", "block"])
    return responses.select(*[quoted(c).alias(c) for c in wanted]).mapInArrow(run, schema)


def responses_from_pages(pages: DataFrame, date: str, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Response records for crawled pages; the id follows from key and URL, ``date`` is that of the crawl."""
    payload = F.coalesce(quoted(body).cast("string"), F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    hexed = F.md5(F.concat_ws("|", quoted(key).cast("string"), quoted(url)).cast("binary"))
    dashed = F.concat_ws("-", *[F.substring(hexed, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    rid = F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">"))
    block = F.concat(head.cast("binary"), payload)
    header = F.map_from_arrays(F.array(*[F.lit(x) for x in ("WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Date", "Content-Type")]), F.array(F.lit("response"), rid, F.coalesce(quoted(url), F.lit("")), F.lit(date), F.lit("application/http;msgtype=response")))
    return pages.select(quoted(key).alias(key), rid.alias("record_id"), quoted(url).alias("target_uri"), F.lit(date).alias("date"), header.alias("headers"), block.alias("block"))


RESPONSE = "record_id string, target_uri string, date string, headers map<string,string>, block binary, problem string"
_KINDS = [pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string()]


def _rows(found):
    """One-row batches of responses and of broken places."""
    for header, block, problem in found:
        if problem is not None or header.get("WARC-Type") == "response":
            row = [header.get("WARC-Record-ID"), header.get("WARC-Target-URI"), header.get("WARC-Date"), list(header.items()), block, problem]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _KINDS, strict=True)], names=[x.split()[0] for x in RESPONSE.split(", ")])


def read_responses(files: DataFrame) -> DataFrame:
    """Response records (and broken places, with ``problem``) from rows of ``spark.read.format("binaryFile")``."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield from _rows(records(cut(batch.column("content")[k].as_py() or b""), ("response",)))

    return files.select("content").mapInArrow(run, RESPONSE)


def stream_responses(spark: SparkSession, path: str) -> DataFrame:
    """The same from files of any size, gzipped or not: a task reads a file piece by piece, where it lies.

    Spark lists the files; the file system must be one that pyarrow opens by its address. For others there is
    ``read_responses``. A file that can't be opened is a row with ``problem``.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    # largest first, and one task for each file
    files = files.orderBy(F.desc("length")).repartition(max(1, files.count()))

    def pieces(file: str):
        store, at = fs.FileSystem.from_uri(file if "://" in file else "file://" + file.removeprefix("file:"))
        with store.open_input_stream(at, compression=None) as f:
            while piece := f.read(CHUNK):
                yield piece

    def run(batches):
        for batch in batches:
            for file in batch.column("path").to_pylist():
                try:
                    yield from _rows(records(pieces(file), ("response",)))
                except (OSError, pa.ArrowInvalid) as e:
                    yield from _rows([({}, b"", f"{file} can't be read: {e}")])

    return files.mapInArrow(run, RESPONSE)
