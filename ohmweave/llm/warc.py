"""WARC archives with a two-level capture index.

Writing: every page is a record in a compressed archive (a gzip member each) that its task writes to the shared
folder; of records with equal payloads one is the response and the others revisit it, decided beforehand from
digests alone and, for a payload that very many share, by a broadcast. Index: captures sorted by reversed-host
URL key are written as compressed blocks of lines, and a sparse directory keeps each block's first key and place.
Reading: captures asked for are sorted like the index, so that each task walks through few blocks: it binary-
searches the list of index files, then the file's directory, reads the block's byte range and binary-searches its lines.
The places found are sorted by archive, and each record is read by its byte range, neighbours in one read.

Files are named after the task attempt that wrote them, and only rows of successful attempts name files: a
task that runs again leaves an unnamed file behind and nothing else.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, bounded, join_split, shared_dir, stored

BLOCK_LINES = 1000
READ_AHEAD = 4 << 20  # bytes of neighbouring records in one read, at most
DATE = "2020-01-01T00:00:00Z"  # pages carry no capture time


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or plain path."""
    return fs.FileSystem.from_uri(path if "://" in path else re.sub(r"^file:/+", "file:///", path) if path.startswith("file:") else f"file://{path}")


def attempt_name(kind: str) -> str:
    task = TaskContext.get()
    return f"{kind}-{task.partitionId():06d}-{task.taskAttemptId()}"


def url_key(url: str | None) -> str:
    """Reversed-host key: com,example,www)/path?query, lower-cased host, no scheme, port 80/443, user or fragment."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)(:\d+)?([^#]*)", url or "", re.S)
    if not m:
        return (url or "").split("#")[0]
    host = ",".join(reversed(m[1].lower().rstrip(".").split(".")))
    return host + (m[2] if m[2] not in (None, ":80", ":443") else "") + ")" + (m[3] if m[3].startswith("/") else f"/{m[3]}")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32(hexadecimal: str) -> str:
    """A digest as records bear it, of its hexadecimal form, by which Spark groups."""
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def header(lines: list[tuple[str, str]]) -> bytes:
    # a line break in a value would end the header line
    return b"WARC/1.1\r\n" + "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in lines).encode() + b"\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record with its payload, or a revisit that names the response and has none."""
    name = "" if page_id is None else str(page_id)
    lines = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Target-URI", url or ""), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        payload = b""
    return header([*lines, ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]) + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, payload) of one record; raises if it isn't whole."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    n = int(fields["Content-Length"])
    if first != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
        raise ValueError("a broken record")
    return fields, rest[:n]


def urn(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(m[1]) if m else None


def decisions(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, digest, refers_to) of revisits: equal payloads of at least `least_bytes` refer to their largest page_id.

    Of rows that repeat a page_id and payload none refers to itself: they are all responses. A payload that very
    many pages share meets its largest page_id by broadcast (join_split).
    """
    ids = pages.select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("n")).where("page_id is not null")
    ids = stored(ids.where(F.col("n") >= least_bytes).select("page_id", "digest").distinct(), "digests")
    last = ids.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return join_split(ids, last, "digest").where("page_id <> refers_to")


CAPTURE = "key string, page_id long, file string, offset long, length long"


def write_archives(pages: DataFrame, at: str, least_bytes: int) -> DataFrame:
    """Write every page as a record below `at`; returns its captures (CAPTURE), stored."""
    say = decisions(pages, least_bytes)
    told = pages.withColumn("digest", F.sha1(F.col("html").cast("binary"))).join(say, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")

    def run(batches):
        name = attempt_name("archive") + ".warc.gz"
        system, folder = opened(at)
        system.create_dir(folder, recursive=True)
        out, pos = None, 0
        for b in bounded(batches, 2):
            out = out or system.open_output_stream(f"{folder}/{name}", compression=None)
            rows = []
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = gzip.compress(record(page_id, url, html.encode(), base32(digest), refers_to), 1, mtime=0)
                out.write(raw)
                rows.append((url_key(url), page_id, name, pos, len(raw)))
                pos += len(raw)
            yield batch(CAPTURE, rows)
        if out:
            out.close()

    return stored(told.mapInArrow(run, CAPTURE), "captures")


def batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


DIRECTORY = "file string, first_key string, first_id long, blocks long, bytes long, directory_offset long"


def line_of(key: str, page_id: int | None, file: str, offset: int, length: int) -> str:
    return "\t".join((key.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r"), "" if page_id is None else str(page_id), file, str(offset), str(length)))


def sort_key(key: str, page_id: int | None) -> tuple[bytes, int]:
    """Spark's order of (key, page_id): by UTF-8 bytes, a null id first."""
    return key.encode(), -(1 << 63) - 1 if page_id is None else page_id


def unline(line: str) -> tuple[str, int | None, str, int, int]:
    key, page_id, file, offset, length = line.split("\t")
    if "\\" in key:
        key = re.sub(r"\\(.)", lambda m: {"t": "\t", "n": "\n", "r": "\r"}.get(m[1], m[1]), key)
    return key, int(page_id) if page_id else None, file, int(offset), int(length)


def write_index(captures: DataFrame, at: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sort the captures by key and write them below `at`, an index file for each task; returns one row per file (DIRECTORY).

    A file is its compressed blocks, then its directory: a line for each block with first key, id, offset, length.
    """
    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")

    def run(batches):
        name = attempt_name("index") + ".gz"
        system, folder = opened(at)
        system.create_dir(folder, recursive=True)
        out, directory, lines, firsts, pos = None, [], [], None, 0

        def put():
            nonlocal pos
            raw = gzip.compress("\n".join(lines).encode(), 6, mtime=0)
            out.write(raw)
            directory.append(line_of(firsts[0], firsts[1], "", pos, len(raw)))
            pos += len(raw)
            lines.clear()

        start = None
        for b in batches:
            for key, page_id, file, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    out, start = system.open_output_stream(f"{folder}/{name}", compression=None), (key, page_id)
                if not lines:
                    firsts = (key, page_id)
                lines.append(line_of(key, page_id, file, offset, length))
                if len(lines) == block_lines:
                    put()
        if out:
            if lines:
                put()
            raw = gzip.compress("\n".join(directory).encode(), 6, mtime=0)
            out.write(raw)
            out.close()
            yield batch(DIRECTORY, [(name, *start, len(directory), pos + len(raw), pos)])

    return stored(ordered.mapInArrow(run, DIRECTORY), "index")


class Index:
    """Searches index files: list of files, directory of a file, block. Keeps what it read last."""

    def __init__(self, at: str, files: list[tuple]):
        self.system, self.folder = opened(at)
        self.files = files  # sorted by first key and id
        self.starts = [sort_key(f[1], f[2]) for f in files]
        self.directory = lru_cache(4)(self._directory)
        self.block = lru_cache(8)(self._block)

    def _read(self, file: int, offset: int, length: int) -> list[tuple]:
        with self.system.open_input_file(f"{self.folder}/{self.files[file][0]}") as f:
            return [unline(x) for x in gzip.decompress(f.read_at(length, offset)).decode().split("\n")]

    def _directory(self, file: int):
        _, _, _, _, size, offset = self.files[file]
        rows = self._read(file, offset, size - offset)
        return [sort_key(r[0], r[1]) for r in rows], rows

    def _block(self, file: int, offset: int, length: int):
        rows = self._read(file, offset, length)
        return [sort_key(r[0], r[1]) for r in rows], rows

    def find(self, low: tuple, high: tuple) -> Iterator[tuple]:
        """Captures with low <= (key, id) <= high, in order; starts at the last block that may hold one."""
        file = max(0, bisect_left(self.starts, low) - 1)
        while file < len(self.files) and self.starts[file] <= high:
            keys, rows = self.directory(file)
            k = max(0, bisect_left(keys, low) - 1)
            while k < len(rows) and keys[k] <= high:
                inner, lines = self.block(file, rows[k][3], rows[k][4])
                yield from lines[bisect_left(inner, low) : bisect_right(inner, high)]
                k += 1
            file += 1


def look_up(wanted: DataFrame, index_at: str, files: list[tuple], by_id: bool = True) -> DataFrame:
    """Captures (CAPTURE) of the wanted rows (key and, if by_id, page_id), each of which is found through the index.

    files: the rows of write_index, one per index file; they grow with the number of tasks, not of captures.
    """
    asked = wanted.distinct().repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    order = sorted((tuple(f) for f in files), key=lambda f: sort_key(f[1], f[2]))

    def run(batches):
        index = Index(index_at, order)
        for b in batches:
            rows = []
            for key, page_id in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                low = sort_key(key, page_id if by_id else None)
                rows += index.find(low, low if by_id else (key.encode(), 1 << 63))
            yield batch(CAPTURE, rows)

    return asked.mapInArrow(run, CAPTURE)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string"


def read_records(captures: DataFrame, archive_at: str, with_html: bool = False) -> DataFrame:
    """The records at the captures' places (READ), verified; captures are sorted so that neighbours are read at once."""
    placed = captures.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")

    def unpack(raw: bytes):
        fields, payload = parse(zlib.decompress(raw, wbits=31))
        digest, refers_to = fields["WARC-Payload-Digest"].removeprefix("sha1:"), urn(fields.get("WARC-Refers-To"))
        if fields["WARC-Type"] == "response" and (digest_of(payload) != digest or len(payload) != int(fields["X-Payload-Length"])):
            raise ValueError("a payload doesn't match its digest")
        return urn(fields["WARC-Record-ID"]), int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], refers_to, fields["WARC-Target-URI"], payload.decode() if with_html else None

    def run(batches):
        system, folder = opened(archive_at)
        held: tuple[str, object] | None = None
        for b in batches:
            spots = list(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True))
            rows, i, held_bytes = [], 0, 0
            while i < len(spots):
                if held_bytes > BATCH_BYTES:
                    yield batch(READ, rows)
                    rows, held_bytes = [], 0
                file, start, length = spots[i]
                j, end = i + 1, start + length
                while j < len(spots) and spots[j][0] == file and spots[j][1] == end and end - start < READ_AHEAD:
                    end += spots[j][2]
                    j += 1
                if held is None or held[0] != file:
                    if held:
                        held[1].close()
                    held = file, system.open_input_file(f"{folder}/{file}")
                raw = held[1].read_at(end - start, start)
                rows += [unpack(raw[o - start : o - start + n]) for _, o, n in spots[i:j]]
                held_bytes += sum(len(x[-1] or "") for x in rows[i - j :])
                i = j
            yield batch(READ, rows)
        if held:
            held[1].close()

    return placed.mapInArrow(run, READ)


class Archive:
    """Archives and index of a table of pages, in a folder of their own below the shared one."""

    def __init__(self, pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", at: str | None = None):
        self.spark: SparkSession = pages.sparkSession
        self.at = at or f"{shared_dir(self.spark)}/ohmweave-warc-{uuid.uuid4().hex}"
        rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
        self.captures = write_archives(rows, f"{self.at}/archives", least_bytes)
        self.index = write_index(self.captures.select("key", "page_id", "file", "offset", "length"), f"{self.at}/index")
        self.files = [tuple(r) for r in self.index.collect()]  # a row for each index file

    def find(self, wanted: DataFrame, by_id: bool = True, with_html: bool = False) -> DataFrame:
        """Records of the wanted rows: url and, if by_id, page_id. Without it all captures of each url."""
        key = F.udf(url_key, "string", useArrow=True)
        asked = wanted.select(key("url").alias("key"), (F.col("page_id").cast("long") if by_id else F.lit(None).cast("long")).alias("page_id"))
        return read_records(look_up(asked, f"{self.at}/index", self.files, by_id), f"{self.at}/archives", with_html)


def archive_and_read(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every page, look every capture up through the index and read it back: page_id, payload_bytes,
    payload_digest, record_type, refers_to; a row for each row of pages.

    Null html is an empty payload, a null url an empty target. Rows with a null page_id are responses. Repeated
    rows are each written and each read back. An empty table gives an empty result. Other columns are not looked at.
    """
    held = Archive(pages, least_bytes, id_col, url_col, html_col)
    asked = held.captures.select("key", "page_id")
    found = look_up(asked, f"{held.at}/index", held.files)
    return read_records(found, f"{held.at}/archives").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB has no base32: hex digits go by groups of 20 bits, four letters each.
ORACLE_SQL = """
with p as (select page_id, coalesce(html, '') html, sha1(coalesce(html, '')) h from pages),
d as (select page_id, strlen(html) n, array_to_string(list_transform(range(8), lambda k: array_to_string(list_transform([15, 10, 5, 0], lambda s:
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || h[5 * k + 1:5 * k + 5])::bigint >> s) & 31)]), '')), '') digest from p),
m as (select *, max(page_id) over (partition by digest) last from d)
select page_id, n::bigint payload_bytes, digest payload_digest, case when page_id is null or page_id = last then 'response' else 'revisit' end record_type, case when page_id <> last then last end refers_to from m"""
