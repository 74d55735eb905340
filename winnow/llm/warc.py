"""WARC archives: a writer that deduplicates by payload digest, and a salvage reader.

Each record is a gzip member of its own. Tasks write archives of bounded size under names that no other
attempt uses, and only names of successful tasks enter the manifest, which is a table in the shared folder.

The reader checks version line, header, length, closing blank lines, block and payload digests and, by
gzip, the checksum. After a failed check it searches for the next gzip member that opens a record, or the
next version line, goes on there, and logs the bytes between as quarantined. In a member of several records
the search goes on in the decompressed stream, as far as it can be decompressed, and the gap is logged with
its decompressed offsets. A checksum that no such gap explains condemns the member (past 64 MB of records,
which are told before it is known, what follows them). It reads plain and gzipped archives; memory is bounded
by one record and 64 MB, and where a length is damaged inside a member, by that member.

Null html or url counts as empty; urls and payloads of any length are written and read whole. A page whose
id is null is a response under a random id and reads back with a null id; it is never revisited. Rows that
repeat an id are each written, with the role of their own payload. Empty tables give an empty manifest and
no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import materialize, modest_batches, shared_path, small_slices, text_of

_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
#: Not only at the start of a line: what was lost may have ended in the middle of one.
_ENTRY = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r?\n")
_FIELD = re.compile(r"[!-9;-~]+[ \t]*:|[ \t]")
_PAGE = "urn:x-page:"
_BLOCK = 1 << 20
#: So many bytes of a member's records wait for its checksum.
_HOLD = 64 << 20
#: A header may be longer (the writer puts whole urls there): from here on its lines are checked before its end is found.
_USUAL_HEADER = 1 << 16


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")

    def payload(self) -> bytes:
        """What follows the HTTP header, or the whole block where there is none."""
        return self.block.partition(b"\r\n\r\n")[2] if "application/http" in self.headers.get("content-type", "") else self.block

    def payload_length(self) -> int:
        """Of the full payload: a revisit has it in the HTTP header that it repeats."""
        if self.kind == "revisit" and (m := re.search(rb"(?im)^content-length:[ \t]*(\d+)", self.block.partition(b"\r\n\r\n")[0])):
            return int(m[1])
        return len(self.payload())


@dataclass
class Gap:
    """Bytes left out: offset to end of the file, or, inside the member at offset, begin to stop of what it decompresses to."""

    offset: int
    end: int
    reason: str
    begin: int | None = None
    stop: int | None = None


class Broken(Exception):
    pass


class Damaged(Broken):
    """A member that can't be decompressed beyond at but gave records, up to begin in decompressed bytes; None if its gaps are told."""

    def __init__(self, reason: str, at: int, begin: int | None):
        super().__init__(reason)
        self.at, self.begin = at, begin


def record_bytes(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    one_line = re.sub(r"[\r\n]+", " ", url).strip()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{f'{_PAGE}{page_id}' if page_id is not None else uuid.uuid4().urn}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {one_line}", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{_PAGE}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def member(record: bytes, level: int = 2) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def _digest() -> Column:
    return F.unhex(F.sha1(text_of("html").cast("binary")))


def roles(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that revisit another: with equal payloads, the largest id responds."""
    keyed = materialize(pages.where(F.col("page_id").isNotNull()).select("page_id", _digest().alias("digest")), "payloads")
    first = materialize(keyed.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"), "responses")
    return keyed.join(first, "digest").where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str | None = None, archive_bytes: int = 64 << 20) -> DataFrame:
    """Write page_id, url, html as records under path; the manifest: file, records, bytes."""
    path = path or shared_path(pages.sparkSession, "warc")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"/{path}")
        store.create_dir(root, recursive=True)
        own, made, out, count, size = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}", [], None, 0, 0
        for whole in batches:
            for b in small_slices(whole, 2, 8 << 20):
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if out is None:
                        name, count, size = f"{own}-{len(made):04d}.warc.gz", 0, 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    data = member(record_bytes(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to))
                    out.write(data)
                    count, size = count + 1, size + len(data)
                    if size >= archive_bytes:
                        out.close()
                        made.append((f"{path}/{name}", count, size))
                        out = None
        if out is not None:
            out.close()
            made.append((f"{path}/{name}", count, size))
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "records", "bytes"), m, strict=True)) for m in made], pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    rows = modest_batches(pages).select("page_id", text_of("url").alias("url"), text_of("html").alias("html"), _digest().alias("digest")).join(roles(pages), ["page_id", "digest"], "left")
    return materialize(rows.select("page_id", "url", "html", "refers_to").mapInArrow(each, "file string, records long, bytes long"), "manifest")


class _Window:
    """Random reads of a file through one block."""

    def __init__(self, file):
        self.file, self.at, self.data = file, 0, b""

    def get(self, offset: int, n: int) -> bytes:
        if not (self.at <= offset and offset + n <= self.at + len(self.data)):
            self.file.seek(offset)
            self.at, self.data = offset, self.file.read(max(n, _BLOCK))
        return self.data[offset - self.at : offset - self.at + n]


def _header(buf: bytes | bytearray, ended: bool) -> tuple[dict[str, str], int, int] | None:
    """(fields, where the block starts, its length) of the record at the start of buf; None if more bytes are needed."""
    head = buf.find(b"\r\n\r\n")
    if head < 0:
        if ended or not (_VERSION.match(buf) or len(buf) < 10):
            raise Broken("no record header")
        if len(buf) >= _USUAL_HEADER and not all(_FIELD.match(x.decode("latin-1")) for x in bytes(buf).split(b"\r\n")[1:-1]):
            raise Broken("damaged header")
        return None
    if not _VERSION.match(buf):
        raise Broken("no version line")
    lines = bytes(buf[:head]).decode("utf-8", "replace").split("\r\n")[1:]
    names = [x.partition(":")[0].strip().lower() for x in lines]
    if not all(map(_FIELD.match, lines)) or names.count("content-length") > 1 or names.count("warc-record-id") > 1:
        raise Broken("damaged header")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Broken("no content length")
    return headers, head + 4, int(length)


def _take(buf: bytes | bytearray, offset: int, ended: bool) -> tuple[Record, int] | None:
    """The record at the start of buf and its length; None if more bytes are needed."""
    if (got := _header(buf, ended)) is None:
        return None
    headers, start, length = got
    end = start + length
    if len(buf) < end + 4:
        if ended:
            raise Broken("record cut short")
        return None
    if buf[end : end + 4] != b"\r\n\r\n":
        raise Broken("no blank lines after the block")
    rec = Record(offset, headers, bytes(buf[start:end]))
    checks = [("warc-block-digest", rec.block)] + [("warc-payload-digest", rec.payload())] * (rec.kind != "revisit")
    for name, data in checks:
        algorithm, _, value = headers.get(name, "").partition(":")
        if algorithm.lower() == "sha1" and value.upper() != sha1_base32(data):
            raise Broken(f"{name} differs")
    return rec, end + 4


def _inflate(z, raw: bytes, buf: bytearray):
    """Decompress raw into buf, as much as can be: (the decompressor, bytes taken, why it failed or None)."""
    at, end, failed = 0, len(raw), None
    for size in (1 << 16, 256, 1):  # after a failure its piece is taken again in smaller ones
        while at < end and not z.eof:
            before = z.copy()
            try:
                buf += z.decompress(raw[at : min(at + size, end)])
            except zlib.error as e:
                z, end, failed = before, min(at + size, end), f"gzip: {e}"
                break
            at = min(at + size, end)
        else:
            return z, at - len(z.unused_data), None
    return z, at, failed


def _gunzip(window: _Window, offset: int) -> Iterator[Record | Gap | int]:
    """The records of the member at offset and the gaps between them, then the offset after it."""
    z, buf, at, failed = zlib.decompressobj(31), bytearray(), offset, None
    done, lost, why, skip = 0, None, "", 0  # done: how much came before buf; lost: where a gap began
    # what is found is told when the checksum is known, or beyond _HOLD bytes; a member without a good record is lost whole
    out, gaps, good, size, gapped, streamed = [], [], 0, 0, False, False
    while not z.eof and not failed:
        raw = window.get(at, _BLOCK)
        z, taken, failed = _inflate(z, raw, buf) if raw else (z, 0, "member cut short")
        at += taken
        ended = z.eof or failed is not None and "check" in failed  # a wrong checksum comes after all the data
        while buf:
            if lost is None:
                try:
                    got = _take(buf, offset, ended)
                except Broken as e:
                    lost, why, skip = done, str(e), 1
                    continue
                if got is None:
                    break
                gapped = gapped or bool(gaps)
                out += [*gaps, got[0]]
                n, good, gaps, size = got[1], good + 1, [], size + got[1]
                if size > _HOLD:
                    yield from out
                    out, size, streamed = [], 0, True
            else:
                found = _VERSION.search(buf, skip)
                n = found.start() if found else len(buf) if ended else max(0, len(buf) - 12)
                if found:
                    gaps.append(Gap(offset, offset, why, lost, done + n))
                    lost = None
            del buf[:n]
            done, skip = done + n, 0
            if lost is not None:
                break
    if not good:
        raise Broken(failed or why)
    if failed and not ended:
        yield from out + gaps
        raise Damaged(failed, at, done if lost is None else lost)
    if lost is not None:
        gaps.append(Gap(offset, offset, why, lost, done))
    if failed and not gaps and not gapped:  # any header may be the damaged one
        raise Damaged(failed, at, done) if streamed else Broken(failed)
    yield from out + gaps
    if failed:
        raise Damaged(failed, at, None)
    yield at


def _plain(window: _Window, offset: int) -> Iterator[Record | int]:
    n = _USUAL_HEADER
    while True:
        raw = window.get(offset, n)
        got = _take(raw, offset, len(raw) < n)
        if got:
            yield got[0]
            yield offset + got[1]
            return
        if (head := _header(raw, False)) is None:
            n *= 4
            continue
        n = head[1] + head[2] + 4
        if window.get(offset + n - 4, 4) != b"\r\n\r\n":  # looked up before the block is read, as its length may be damaged
            raise Broken("no blank lines after the block")


def _opens_record(window: _Window, offset: int) -> bool:
    raw = window.get(offset, 4096)
    if raw[:3] != b"\x1f\x8b\x08":
        return bool(_VERSION.match(raw))
    try:
        return bool(_VERSION.match(zlib.decompressobj(31).decompress(raw, 64)))
    except zlib.error:
        return False


def _next_entry(window: _Window, offset: int, lines_from: int = 0) -> int | None:
    """Where the next member that opens a record is from offset on, or the next version line from lines_from on."""
    at = offset
    while raw := window.get(max(0, at - 1), _BLOCK):
        base = max(0, at - 1)
        for m in _ENTRY.finditer(raw):
            if base + m.start() >= (offset if m[0][:1] == b"\x1f" else max(offset, lines_from)) and _opens_record(window, base + m.start()):
                return base + m.start()
        if len(raw) < _BLOCK:
            return None
        at = base + len(raw) - 16
    return None


def salvage(file) -> Iterator[Record | Gap]:
    """All records of a seekable file that pass the checks, and the gaps between them."""
    window, at = _Window(file), 0
    while raw := window.get(at, 16):
        if raw[:1] in b"\r\n" and raw.strip(b"\r\n") != raw:
            at += len(raw) - len(raw.lstrip(b"\r\n"))
            continue
        try:
            if raw[:3] == b"\x1f\x8b\x08":
                steps = _gunzip(window, at)
            elif raw[:5] == b"WARC/":
                steps = _plain(window, at)
            else:
                raise Broken("no record")
            for x in steps:
                if isinstance(x, int):
                    at = x
                else:
                    yield x
        except Broken as e:
            # what a broken stream took may hold the next member already, but lines of its own are no records
            end = _next_entry(window, e.at if "check" in str(e) and isinstance(e, Damaged) else at + 1, e.at if isinstance(e, Damaged) else 0)
            if end is None:
                window.file.seek(0, 2)
                end = window.file.tell()
            begin = e.begin if isinstance(e, Damaged) else None
            if begin is not None or not isinstance(e, Damaged):
                yield Gap(at, end, str(e), begin)
            at = end


_READ = "file string, offset long, status string, reason string, gap_bytes long, inner_start long, inner_end long, record_type string, record_id string, page_id long, refers_to long, url string, payload_bytes long, payload_digest string"


def read_archives(files: DataFrame, keep_payload: bool = True, strict: bool = False) -> DataFrame:
    """Per record and gap of the archives in column `file`: status is record or quarantined. Then offset, gap_bytes
    and reason tell which bytes are left out; inside a member (at offset) inner_start and inner_end do, in decompressed
    bytes, and where only inner_start is given, the member's records before it were read. If strict, `records` tells how
    many records a file has, and another number is an error."""
    names = [x.split()[0] for x in _READ.split(", ")] + ["payload"] * keep_payload
    types = [pa.int64() if x.endswith("long") else pa.string() for x in _READ.split(", ")] + [pa.binary()] * keep_payload
    named = re.compile(re.escape(_PAGE) + r"(-?[0-9]{1,18})")
    page_of = lambda v: int(m[1]) if v and (m := named.fullmatch(v.strip("<>"))) else None  # noqa: E731  other writers name records otherwise

    def rows_of(name: str, file) -> Iterator[tuple]:
        for x in salvage(file):
            if isinstance(x, Gap):
                size = x.stop - x.begin if x.stop is not None else x.end - x.offset
                yield (name, x.offset, "quarantined", x.reason, size, x.begin, x.stop, *[None] * (len(names) - 7))
                continue
            h, payload = x.headers, x.payload()
            digest = h.get("warc-payload-digest", "").partition(":")[2].upper() if x.kind == "revisit" else sha1_base32(payload)
            row = (name, x.offset, "record", None, None, None, None, x.kind, h.get("warc-record-id"), page_of(h.get("warc-record-id")), page_of(h.get("warc-refers-to")), h.get("warc-target-uri"), x.payload_length(), digest)
            yield (*row, payload) if keep_payload else row

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for b in batches:
            for name, expected in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, path = fs.FileSystem.from_uri(name)
                with store.open_input_file(path) as file:
                    rows, size, count = [], 0, 0
                    for row in rows_of(name, file):
                        rows.append(row)
                        count += row[2] == "record"
                        size += len(row[-1]) if keep_payload and row[-1] else 200
                        if size > 8 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                    if rows:
                        yield batch_of(rows)
                if expected is not None and count != expected:
                    raise RuntimeError(f"{name}: {count} records read of {expected} written")

    paths = files.select("file", (F.col("records") if strict else F.lit(None)).cast("long").alias("records")).where(F.col("file").isNotNull()).distinct()
    return paths.repartition(max(1, min(paths.count(), 100_000))).mapInArrow(each, _READ + ", payload binary" * keep_payload)


def round_trip(pages: DataFrame, path: str | None = None, keep_payload: bool = True) -> DataFrame:
    """Write the pages as archives and read those back; a record that does not come back is an error."""
    return read_archives(write_archives(pages, path), keep_payload, strict=True)
