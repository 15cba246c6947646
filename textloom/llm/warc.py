"""WARC: a reader that salvages damaged files, and a writer.

Files are read by byte ranges, so a file of any size is read by many tasks and
none holds more than a record and a buffer. A record belongs to the range in
which its first byte lies. A range's reader looks for the next member (gzip magic
whose inflated bytes begin with a version line) or, in files that aren't
compressed, the next version line. A record is good if all checks hold: gzip
checksum and length, version line, parsable header, Content-Length, the blank
lines that end it, and the block's SHA-1 if the header has one. After a failed
check the search goes on from the byte after the failed start, so later records
are recovered. Bytes that no good record covers are quarantined: each gap is
logged with file, offset, length and the check that failed at its start.

A record that lies within another good one (a WARC file stored as a page, met by
a range that began there) is dropped by its place. Within a file all this depends
only on the bytes, not on how ranges are cut.

A member may hold one record, as the standard asks; more in one member are all
read, at the member's offset. If one of them fails a check, or the member is
damaged or cut, the search goes on at the next version line among the bytes that
could be inflated, and the good ones are recovered with the member's offset and
length 0, as the member's own bytes are quarantined.

A header is read while its lines are lines of a header, and a block only if a
record's end is found where Content-Length says, so a damaged length or header
reads little. A task holds one record, or one member's records, whole.

Defined results: an empty file, a folder without files and an empty table have no
record and no gap; a file without any good record is one gap. A record without
WARC-Target-URI or type has null there. A body may be empty or of any bytes. Paths
that occur twice are read once. ``write_warc``: a null url has no WARC-Target-URI, a null
body is empty, repeated rows are records of their own, extra columns are ignored,
and an empty table makes a folder without files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm._common import only, shared_dir, written

RANGE = 32 << 20
#: Tasks that read ranges, at most; beyond it a task reads several.
TASKS = 20_000
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/\d+\.\d+\r?\n")
_BUFFER = 1 << 16


class Source:
    """Random access to a file's bytes with one buffer."""

    def __init__(self, path: str) -> None:
        fs, p = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        self.file = fs.open_input_file(p)
        self.size = self.file.size()
        self.at, self.buffer = 0, b""

    def read(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if not (self.at <= at and at + n <= self.at + len(self.buffer)):
            self.at, self.buffer = at, self.file.read_at(max(n, _BUFFER), at)
        return self.buffer[at - self.at : at - self.at + n]

    def find(self, what: bytes, at: int, end: int) -> int:
        """The first place from ``at`` and before ``end`` where ``what`` begins, or -1."""
        while at < end:
            part = self.read(at, min(_BUFFER, self.size - at))
            k = part.find(what)
            if k >= 0:
                return at + k if at + k < end else -1
            if at + len(part) >= self.size:
                return -1
            at += len(part) - len(what) + 1
        return -1


class Damaged(Exception):
    """A check failed; the message names it."""


def inflate(src: Source, at: int) -> tuple[bytes, int, str | None]:
    """The bytes of the member at ``at``, where it ends, and what is wrong with it. A start that doesn't inflate to a version line is given up at once."""
    d = zlib.decompressobj(31)
    out: list[bytes] = []
    began = False
    wrong = None
    while not wrong and not d.eof:
        part = src.read(at, _BUFFER)
        before = d.copy()
        try:
            out.append(d.decompress(part))
        except zlib.error as e:
            wrong = "member checksum" if "check" in str(e) else "member data"
            try:
                for k in range(0, len(part), 64):  # what there is before the damage
                    out.append(before.decompress(part[k : k + 64]))
            except zlib.error:
                pass
        if not part:
            wrong = "truncated member"
        if not began:
            head = b"".join(out)[:5]
            if len(head) == 5 and head != b"WARC/" or wrong and len(head) < 5:
                raise Damaged(wrong or "no version line in member")
            began = len(head) == 5
        at += len(part) - len(d.unused_data)
    return b"".join(out), at, wrong


def parse(data: Callable[[int, int], bytes], at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at ``at``, and where it ends."""
    size, checked = 4096, 0
    while True:
        head = data(at, size)
        if not _VERSION.match(head):
            raise Damaged("version line")
        m = re.search(rb"\r?\n\r?\n", head)
        lines = head[: m.start() if m else head.rfind(b"\n") + 1].split(b"\n")[1:]
        for line in lines[checked : None if m else -1]:
            if line.strip() and b":" not in line:
                raise Damaged("header line")
        if m:
            break
        if len(head) < size:
            raise Damaged("header end")
        checked, size = max(0, len(lines) - 1), size * 4
    headers: dict[str, str] = {}
    for line in head[: m.start()].decode("utf-8", "replace").splitlines()[1:]:
        key, colon, value = line.partition(":")
        if not colon:
            raise Damaged("header line")
        headers[key.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Damaged("content length")
    begin, n = at + m.end(), int(length)
    if n and not data(begin + n - 1, 1):
        raise Damaged("truncated block")
    end = data(begin + n, 4)
    if end[:4] == b"\r\n\r\n":
        tail = 4
    elif end[:2] == b"\n\n":
        tail = 2
    else:
        raise Damaged("record end")
    block = data(begin, n)
    digest = headers.get("warc-block-digest", "")
    if digest.lower().startswith("sha1:") and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest[5:].upper():
        raise Damaged("block digest")
    return headers, block, begin + n + tail


def _unpacked(raw: bytes) -> tuple[list[tuple[dict[str, str], bytes]], str | None]:
    """The good records among a member's bytes, and the first check that failed."""
    k, found, wrong = 0, [], None
    while k < len(raw):
        try:
            headers, block, k = parse(lambda a, n: raw[a : a + n], k)
            found.append((headers, block))
        except Damaged as e:
            wrong = wrong or str(e)
            m = _VERSION.search(raw, k + 1)
            k = m.start() if m else len(raw)
    return found, wrong


def salvage(src: Source, begin: int, end: int, packed: bool) -> Iterator[tuple[int, int, str | None, dict[str, str], bytes]]:
    """(offset, length, failed check or None, headers, block) of what begins in [begin, end)."""
    at = begin
    while at < end:
        found = src.find(_MAGIC if packed else b"WARC/", at, end)
        if found < 0:
            return
        at = found
        try:
            if packed:
                raw, after, broken = inflate(src, at)
                records, failed = _unpacked(raw)
                wrong = broken or failed
                if wrong:
                    yield at, 0, wrong, {}, b""
                for headers, block in records:
                    yield at, 0 if wrong else after - at, None, headers, block
                at = at + 1 if broken else after
            else:
                if not _VERSION.match(src.read(at, 16)):
                    raise Damaged("version line")
                headers, block, after = parse(src.read, at)
                yield at, after - at, None, headers, block
                at = after
        except Damaged as e:
            yield at, 0, str(e), {}, b""
            at += 1


_SCHEMA = pa.schema([("path", pa.string()), ("size", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("failed", pa.string()), ("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("block", pa.binary())])


def _read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            src = Source(r["path"])
            packed = src.read(0, 2) == _MAGIC[:2] if not r["path"].endswith((".gz", ".warc")) else r["path"].endswith(".gz")
            rows, held = [], 0
            for at, n, failed, h, block in salvage(src, r["begin"], r["end"], packed):
                rows.append({"path": r["path"], "size": src.size, "offset": at, "length": n, "failed": failed, "record_id": h.get("warc-record-id"), "type": h.get("warc-type"), "url": h.get("warc-target-uri"), "date": h.get("warc-date"), "block": block})
                held += len(block)
                if held > 8 << 20 or len(rows) >= 2000:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def read_warc(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """All that begins in the files at ``path`` (a folder, file or glob): good records, and starts that failed a check.

    Columns: path, size, offset, length, failed (null for a record), record_id,
    type, url, date, block.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").distinct()
    ranges = files.where("length > 0").select("path", F.col("length").alias("size"), F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(range_bytes))).alias("begin"))
    ranges = ranges.select("path", F.col("begin").cast("long").alias("begin"), F.least(F.col("begin") + range_bytes, F.col("size")).cast("long").alias("end"))
    # A number of partitions that is given isn't coalesced, as these rows are small and their work isn't.
    ranges = ranges.repartition(max(1, min(TASKS, ranges.count())), "path", "begin")
    return ranges.mapInArrow(_read_ranges, "path string, size long, offset long, length long, failed string, record_id string, type string, url string, date string, block binary")


def _outer(found: DataFrame) -> DataFrame:
    """Good records that lie in no other, and whether a failed start lies in one."""
    before = W.partitionBy("path").orderBy("offset", F.desc("length")).rowsBetween(W.unboundedPreceding, -1)
    end = F.max(F.when(F.col("failed").isNull(), F.col("offset") + F.col("length"))).over(before)
    return found.withColumn("covered", F.coalesce(end, F.lit(0)))


def records(found: DataFrame) -> DataFrame:
    """The recovered records of what ``read_warc`` found."""
    places = _outer(found.select("path", "offset", "length", "failed")).where("failed is null and (offset >= covered or offset + length > covered)").select("path", "offset").distinct()
    return found.where("failed is null").join(places, ["path", "offset"], "left_semi").drop("failed")


def gaps(found: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """path, offset, length, reason of the quarantined bytes; the reason is the first check that failed in the gap."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size")).distinct().where("size > 0")
    good = found.where("failed is null").select("path", "offset", F.col("length")).unionByName(files.select("path", F.col("size").alias("offset"), F.lit(0).cast("long").alias("length")))
    earlier = W.partitionBy("path").orderBy("offset", "length").rowsBetween(W.unboundedPreceding, -1)
    gap = good.withColumn("begin", F.coalesce(F.max(F.col("offset") + F.col("length")).over(earlier), F.lit(0))).where("offset > begin").select("path", "begin", F.col("offset").alias("end"))
    failed = found.where("failed is not null").select("path", F.col("offset").alias("at"), "failed")
    first = gap.join(failed, "path").where("at >= begin and at < end").groupBy("path", "begin").agg(F.min_by("failed", "at").alias("reason"))
    out = gap.join(first, ["path", "begin"], "left")
    return out.select("path", F.col("begin").alias("offset"), (F.col("end") - F.col("begin")).alias("length"), F.coalesce("reason", F.lit("no record start")).alias("reason"))


def record_bytes(uri: str | None, body: bytes, date: str, ident: str) -> bytes:
    """One WARC/1.0 resource record."""
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    head = [f"WARC-Type: resource\r\nWARC-Record-ID: <{ident}>\r\nWARC-Date: {date}\r\n"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {' '.join(uri.split())}\r\n")
    head.append(f"WARC-Block-Digest: sha1:{digest}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n")
    return b"WARC/1.0\r\n" + "".join(head).encode() + body + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_warc(pages: DataFrame, path: str, file_bytes: int = 64 << 20, packed: bool = True, damage: Callable[[int | None, bytes], bytes] | None = None) -> DataFrame:
    """Writes page_id, url, html as WARC files under ``path``; returns path, records, bytes of each file.

    A file's name has its partition and number, and it is put in place whole, so
    a task that runs again writes the same files. ``damage`` may change a record's
    stored bytes by its page_id; it serves tests of the reader.
    """

    fs, root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        part, number, held, size, n = TaskContext.get().partitionId(), 0, [], 0, 0
        done = []

        def flush() -> None:
            nonlocal number, held, size, n
            name = f"part-{part:05d}-{number:05d}.warc" + ".gz" * packed
            hidden = f"{root}/_{uuid.uuid4().hex}"
            with fs.open_output_stream(hidden) as f:
                f.write(b"".join(held))
            fs.move(hidden, f"{root}/{name}")
            done.append((f"{path}/{name}", n, size))
            number, held, size, n = number + 1, [], 0, 0

        for batch in batches:
            for page, uri, body in zip(*(batch.column(k).to_pylist() for k in range(3))):
                raw = record_bytes(uri, (body or "").encode("utf-8", "surrogatepass"), "2024-01-01T00:00:00Z", f"urn:page:{page}")
                data = member(raw) if packed else raw
                data = damage(page, data) if damage else data
                held.append(data)
                size, n = size + len(data), n + 1
                if size >= file_bytes:
                    flush()
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], type=t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return only(pages, "page_id", "url", "html").mapInArrow(run, "path string, records long, bytes long")


def damage(page: int | None, data: bytes) -> bytes:
    """The damage that the query's files have: by page_id a byte is changed, bytes are put in before, or the end is lost."""
    if page is None:
        return data
    if page % 11 == 3:
        k = len(data) // 2
        data = data[:k] + bytes([data[k] ^ 0x55]) + data[k + 1 :]
    if page % 13 == 5:
        data = b"\x1f\x8b\x08junk" * 9 + data
    if page % 17 == 7:
        data = data[: -len(data) // 3]
    return data


def op3_warc_salvage(spark, sf_dir: str) -> DataFrame:
    """All pages are stored as WARC, damaged, and read again: recovered pages and quarantined gaps."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path, damage=damage).agg(F.sum("records")).collect()
    found = written(read_warc(spark, path).withColumn("md5", F.md5("block")).drop("block"), "found")
    none = lambda t: F.lit(None).cast(t)
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    page = F.regexp_extract("record_id", "page:([0-9]+)", 1).cast("long").alias("page_id")
    good = records(found).select(F.lit("record").alias("kind"), name, "offset", "length", page, "url", "md5", none("string").alias("reason"))
    bad = gaps(found, spark, path).select(F.lit("gap").alias("kind"), name, "offset", "length", none("long").alias("page_id"), none("string").alias("url"), none("string").alias("md5"), "reason")
    return good.unionByName(bad)


QUERIES = {"op3_warc_salvage": op3_warc_salvage}
ORACLE: dict[str, str] = {}
