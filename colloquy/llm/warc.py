"""Web archives: writing pages as WARC records, and a reader that salvages damaged files.

The writer is a text sink whose line separator is the blank lines that end a record,
so any store that Spark writes to can hold the archives. Of equal payloads one record
is the response, others revisit it. The reader takes whole files and reads record by
record, plain or from gzip members of one or more records; where a check fails it searches for the next
version line or member that reads well, and logs the bytes between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.support import settle

#: payloads of at least so many bytes are compared
REVISIT_BYTES = 1000
#: records and bytes per archive file; a file is read as one row, which holds less than 2 GB
FILE_RECORDS, FILE_BYTES = 2000, 1 << 30
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = (
    "file string, begin long, end long, record_id string, record_type string, uri string, refers_to string, payload_bytes long, "
    "payload_digest string, payload binary, reason string"
)
VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
MEMBER = b"\x1f\x8b\x08"
END = b"\r\n\r\n"
VERSION_LINE = b"WARC/1."
#: the headers of a record, and what a gzip member may take before it gives content
HEADER_BYTES, MEMBER_BYTES = 1 << 16, 4096


def _one_line(text: Column) -> Column:
    """A header value: control characters would end it."""
    return F.regexp_replace(text, r"[\x00-\x1F\x7F]", "%20")


def records(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(record): the text of a WARC record for each row of (page_id, url, html), without its last blank lines.

    The payload is the html in UTF-8, null is the empty payload. Of rows with equal
    payloads of at least ``REVISIT_BYTES`` bytes the one with the largest page_id is
    the response, others are revisits without payload. Repeated rows with that page_id
    are all responses. Rows with a null page_id are responses. A null url has no target header;
    control characters in urls become %20. Other columns are ignored, an empty table
    gives no rows.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).alias("size"))
    # only digests that occur with several pages go back to the rows
    copies = rows.where(f"size >= {REVISIT_BYTES} and page_id is not null").groupBy(F.col("digest").alias("same"), F.col("size").alias("as_large"))
    copies = copies.agg(F.max("page_id").alias("first"), F.min("page_id").alias("least")).where("first != least").drop("least")
    # with its size known, a small table of copies meets the pages without a shuffle of their html
    copies = settle(copies, "page-copies")
    joined = rows.join(copies, (F.col("digest") == F.col("same")) & (F.col("size") == F.col("as_large")), "left")
    revisit = F.coalesce(F.col("first") != F.col("page_id"), F.lit(False))
    line = "\r\n"
    answer = F.concat(F.lit(f"HTTP/1.1 200 OK{line}Content-Type: text/html; charset=utf-8{line}Content-Length: "), F.col("size").cast("string"), F.lit(line * 2))
    block = F.when(revisit, answer).otherwise(F.concat(answer, F.col("html")))
    joined = joined.select("page_id", "url", "digest", "size", "first", revisit.alias("revisit"), block.alias("block"))
    own = lambda x: F.concat(F.lit("<urn:x-page:"), F.coalesce(x.cast("string"), F.lit("none")), F.lit(">"))
    header = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(line))
    head = F.concat(
        F.lit(f"WARC/1.1{line}"), header("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        header("WARC-Record-ID", own(F.col("page_id"))), header("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNotNull(), header("WARC-Target-URI", _one_line(F.col("url")))).otherwise(F.lit("")),
        F.when(F.col("revisit"), F.concat(header("WARC-Profile", F.lit(PROFILE)), header("WARC-Refers-To", own(F.col("first"))))).otherwise(F.lit("")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), header("X-Payload-Length", F.col("size").cast("string")),
        header("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1("block"))), header("Content-Type", F.lit("application/http; msgtype=response")),
        header("Content-Length", F.octet_length("block").cast("string")), F.lit(line),
    )
    return joined.select(F.concat(head, F.col("block")).alias("record"))


def write_archives(pages: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """Write WARC files of at most ``file_records`` records and ``FILE_BYTES`` bytes below ``path``; a larger record is a file alone.

    Pages of a payload that lets fewer records into a file are written apart, by classes of
    eightfold size, so that one large page doesn't make small files of all others. Equal payloads have one class.
    """
    payload = F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")
    # a control character of a url becomes three; other headers have less than 2048 bytes
    size = payload + 3 * F.coalesce(F.octet_length("url"), F.lit(0)) + 2048
    usual, grade = FILE_BYTES // file_records, F.lit(0)
    for k in range(1, 12):
        grade = F.when(payload > usual * 8 ** (k - 1), k).otherwise(grade)
    grades = sorted(tuple(x) for x in pages.groupBy(grade.alias("grade")).agg(F.max(size)).collect()) or [(0, 1)]
    for k, (one, largest) in enumerate(grades):
        part = pages.where(grade == one) if len(grades) > 1 else pages
        writer = records(part).write.mode("append" if k else "errorifexists").option("lineSep", END.decode())
        writer.option("maxRecordsPerFile", max(1, min(file_records, FILE_BYTES // largest))).text(path)


@dataclass
class Record:
    begin: int
    end: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    reason: str | None = None


def _member(data: bytes, at: int) -> tuple[bytes, int | None]:
    """The content of the gzip member at a place and the place behind it; None if it is damaged, with the content before the damage."""
    reader, parts, view, begin = zlib.decompressobj(31), [], memoryview(data), at
    try:
        parts.append(reader.decompress(view[at: at + MEMBER_BYTES]))
        at = min(at + MEMBER_BYTES, len(data))
        if not parts[0] and not reader.eof:
            return b"", None
        while not reader.eof and at < len(data):
            parts.append(reader.decompress(view[at: at + 65536]))
            at = min(at + 65536, len(data))
    except zlib.error:
        return b"".join([*parts, _before_damage(view, begin, at)]), None
    return b"".join(parts), at - len(reader.unused_data) if reader.eof else None


def _before_damage(view: memoryview, begin: int, at: int) -> bytes:
    """What the piece of a member at a place still gives, byte by byte, before it fails."""
    reader, parts = zlib.decompressobj(31), []
    for k in range(begin, at, 65536):
        reader.decompress(view[k: min(k + 65536, at)])
    try:
        for k in range(at, min(at + 65536, len(view))):
            parts.append(reader.decompress(view[k: k + 1]))
    except zlib.error:
        pass
    return b"".join(parts)


def _digest_holds(value: str | None, block: bytes) -> bool:
    """Digests of other algorithms than SHA-1 are not checked."""
    kind, _, text = (value or "").partition(":")
    if kind.lower() != "sha1" or not text:
        return True
    found = hashlib.sha1(block)
    return text.lower() == found.hexdigest() or text.upper() == base64.b32encode(found.digest()).decode()


@dataclass
class _Head:
    """The header lines that end at one pair of blank lines, shared by all version lines before it."""

    good: int
    fault: str
    last: dict[str, tuple[int, str]]
    lines: list[tuple[int, str, str]]
    checked: dict[tuple, str | None] = field(default_factory=dict)


class _Bytes:
    """Records of some bytes by their places. Looking for places in rising order takes time linear in the bytes."""

    def __init__(self, data: bytes):
        self.data = data
        self._next: dict[bytes, tuple[int, int]] = {}
        self._head: tuple[int, _Head] | None = None

    def find(self, what: bytes, at: int) -> int:
        """The next place of some bytes (``VERSION_LINE``: of a version line); -1 for none. The last answer is kept while it holds."""
        asked, found = self._next.get(what, (0, -2))
        if found == -2 or not asked <= at or 0 <= found < at:
            if what == VERSION_LINE:
                version = VERSION.search(self.data, at)
                found = version.start() if version else -1
            else:
                found = self.data.find(what, at)
            self._next[what] = at, found
        return found

    def _headers(self, stop: int) -> _Head:
        if self._head is None or self._head[0] != stop:
            low = max(0, stop - HEADER_BYTES)
            end, good, fault, last, lines = stop, low, "headers do not end", {}, []
            for line in reversed(self.data[low:stop].split(b"\r\n")):
                begin = end - len(line)
                name, colon, value = line.partition(b":")
                if b"\n" in line or (line and not colon):
                    good, fault = end + 2, "line feed in a header" if b"\n" in line else "header without colon"
                    break
                entry = begin, *_texts(name, value)
                lines.append(entry)
                last.setdefault(entry[1], (begin, entry[2]))
                end = begin - 2
            self._head = stop, _Head(good, fault, last, lines[::-1])
        return self._head[1]

    def record(self, at: int) -> Record | str:
        """The record at a place, or what is wrong with it."""
        data = self.data
        version = VERSION.match(data, at)
        if not version:
            return "no version line"
        first = version.end()
        stop = self.find(END, first - 2)
        if stop < 0 or stop - first > HEADER_BYTES:
            return "headers do not end"
        if stop < first:
            return "header missing"
        feed = data.find(b"\n", first, stop + 2)
        if data[feed - 1: feed] != b"\r":
            return "line feed in a header"
        head, rest = self._headers(stop), feed + 1
        name, colon, value = data[first: feed - 1].partition(b":")
        if feed - 1 > first and not colon:
            return "header without colon"
        if rest < head.good and rest < stop:
            return head.fault
        own = _texts(name, value)

        def get(wanted: str) -> str | None:
            place, text = head.last.get(wanted, (-1, ""))
            return text if place >= rest else own[1] if own[0] == wanted else None

        length = _number(get("content-length"))
        if length is None or get("warc-type") is None:
            return "header missing"
        # equal lengths and digests behind one pair of blank lines are checked once
        key = length, get("warc-type"), get("warc-block-digest"), get("warc-payload-digest")
        if key not in head.checked:
            head.checked[key] = _fault(data, stop + len(END), *key)
        if head.checked[key]:
            return head.checked[key]
        headers = {own[0]: own[1]}
        headers.update((x, text) for place, x, text in head.lines if place >= rest)
        begin = stop + len(END)
        return Record(at, begin + length + len(END), headers, data[begin: begin + length])


def _texts(name: bytes, value: bytes) -> tuple[str, str]:
    return name.decode("utf-8", "replace").strip().lower(), value.decode("utf-8", "replace").strip()


def _number(text: str | None) -> int | None:
    """A number of bytes; numbers of more than 15 digits are larger than any file, null is anything else."""
    if text is None or not (text.isascii() and text.isdecimal()):
        return None
    digits = text.lstrip("0") or "0"
    return int(digits) if len(digits) <= 15 else 10**15


def _fault(data: bytes, begin: int, length: int, kind: str, block_digest: str | None, payload_digest: str | None) -> str | None:
    """What is wrong with a block."""
    end = begin + length
    if end > len(data):
        return "block is cut off"
    if data[end: end + len(END)] != END:
        return "no blank lines at the end"
    block = data[begin:end]
    if not _digest_holds(block_digest, block):
        return "block digest differs"
    if kind == "response" and not _digest_holds(payload_digest, payload_of(block)):
        return "payload digest differs"
    return None


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP headers of a response block."""
    head, blank, body = block.partition(END)
    return body if blank and head.startswith(b"HTTP/") else block


def _read(source: _Bytes, at: int) -> tuple[list[Record], int, str | None]:
    """The records and inner gaps at a place, the place behind them, and what is wrong there."""
    data = source.data
    if data[at: at + 3] != MEMBER:
        found = source.record(at)
        return ([found], found.end, None) if isinstance(found, Record) else ([], at, found)
    content, end = _member(data, at)
    found = list(_contents(content))
    if end is None:
        # no checksum speaks for the content: a record counts with a digest of its own, and more content behind it
        proven = [x for x in found if x.reason is None and x.end < len(content) and x.headers.get("warc-block-digest", "").lower().startswith("sha1:")]
        return proven, at, "member is damaged"
    if all(x.reason for x in found):
        return [], at, found[0].reason if found else "no version line"
    return found, end, None


def _contents(content: bytes) -> Iterator[Record]:
    """Records and gaps of a member's content, by their places in it."""
    source, at, size = _Bytes(content), 0, len(content)
    found = source.record(0) if content else ""
    while at < size:
        if isinstance(found, Record):
            yield found
            at = found.end
            found = source.record(at)
            continue
        begin, reason = at, found
        while at < size and not isinstance(found, Record):
            at = source.find(VERSION_LINE, at + 1)
            at = size if at < 0 else at
            found = source.record(at)
        yield Record(begin, at, reason=reason)


def salvage(data: bytes) -> Iterator[Record]:
    """The records of an archive in order, and a record with a reason for each gap.

    Reading starts at the first byte. Where a record fails a check (version line,
    headers, length, blank lines, digests, gzip checksum), the bytes up to the next
    version line or gzip member that reads well, or to the end, are one gap with the
    first failure as its reason. Headers have at most ``HEADER_BYTES`` bytes and no line
    feeds within a line; a length that is no number fails as a missing header. Records and gaps inside a gzip
    member all have the member's begin and end; of a damaged member, the records before
    the damage that their block digests prove come first, with the span of the gap; a mark
    whose first ``MEMBER_BYTES`` bytes give no content is no member. An empty file has no records.
    """
    source, at, size = _Bytes(data), 0, len(data)
    ahead = _read(source, 0) if data else None
    while at < size:
        begin = at
        found, at, reason = ahead
        ahead = None
        while reason:
            at = min((x for x in (source.find(VERSION_LINE, at + 1), source.find(MEMBER, at + 1)) if x >= 0), default=size)
            # only a record that passes all checks ends the gap
            ahead = _read(source, at) if at < size else None
            if ahead is None or ahead[0]:
                break
        for x in found:
            x.begin, x.end = begin, at
            yield x
        if reason:
            yield Record(begin, at, reason=reason)
        if ahead is None and at < size:
            ahead = _read(source, at)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records and gaps of the archives below ``path``, columns ``RECORDS``.

    A record has a null reason; a gap only file, begin, end and reason. ``refers_to``
    is the record that a revisit stands for; payload_bytes and payload_digest (bare
    hex) are those of the full payload, for revisits from their headers, and
    ``payload`` is null for revisits. A revisit's length that is no number, and a digest
    that is no SHA-1, are null. Files are read whole, one to a row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(_rows, RECORDS)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary(), pa.string()]
    for batch in batches:
        for k in range(batch.num_rows):
            path, data = batch.column(0)[k].as_py(), batch.column(1)[k].as_py() or b""
            rows: list[tuple] = []
            held = 0
            for x in salvage(data):
                rows.append(_row(path, x))
                held += len(x.block)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def _row(path: str, x: Record) -> tuple:
    get = x.headers.get
    kind = get("warc-type")
    if x.reason or kind != "revisit":
        payload = payload_of(x.block) if kind == "response" else x.block
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    else:
        payload, size, digest = None, _number(get("x-payload-length")), _hex(get("warc-payload-digest", ""))
    if x.reason:
        payload = size = digest = None
    return path, x.begin, x.end, get("warc-record-id"), kind, get("warc-target-uri"), get("warc-refers-to"), size, digest, payload, x.reason


def _hex(value: str) -> str | None:
    """The bare hex of a SHA-1 digest in hex or base 32; null for other algorithms and malformed digests."""
    kind, _, text = value.partition(":")
    if kind.lower() != "sha1":
        return None
    if re.fullmatch(r"[0-9A-Fa-f]{40}", text):
        return text.lower()
    return base64.b32decode(text.upper()).hex() if re.fullmatch(r"[A-Za-z2-7]{32}", text) else None


def page_of(record_id: Column) -> Column:
    """The page_id in a record's name."""
    return F.regexp_extract(record_id, r"<urn:x-page:(-?\d+)>", 1).try_cast("long")
