"""Media columns as MPEG transport streams.

A text's bytes, padded to whole units of 192 8-bit samples (24 ms at 8 kHz), travel as private data in one
program's elementary stream: packetised with timestamps, cut into 188-byte transport packets, behind a program
association and a program map table. Reading parses those tables, checks continuity counters, reassembles the
elementary packets and lists their timestamps, those of random-access points marked. Both run in Spark tasks,
row by row over Arrow batches; the streams are a binary column of a stored table between them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, stored

UNIT = 192  # bytes, so samples
TICKS = 2160  # of the 90 kHz clock, for a unit
UNITS_PER_PACKET = 50  # of an elementary packet
POINT_EVERY = 4  # elementary packets from one random-access point to the next
PMT_PID, ES_PID, PROGRAM, PRIVATE_DATA = 0x1000, 0x101, 1, 0x06
PACKET, PAYLOAD = 188, 184
SYNC = 0x47


def crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


CRC = crc_table()


def section_crc(data: bytes) -> int:
    """CRC-32 as sections have it: most significant bit first, not inverted."""
    c = 0xFFFFFFFF
    for x in data:
        c = (c << 8 & 0xFFFFFFFF) ^ CRC[c >> 24 ^ x]
    return c


def section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def header(pid: int, start: bool, control: int, counter: int) -> bytes:
    return bytes([SYNC, 0x40 * start | pid >> 8, pid & 0xFF, control << 4 | counter])


def table_packet(pid: int, data: bytes, counter: int = 0) -> bytes:
    return (header(pid, True, 1, counter) + b"\0" + data).ljust(PACKET, b"\xff")


def tables() -> bytes:
    pat = section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_DATA]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0")
    return table_packet(0, pat) + table_packet(PMT_PID, pmt)


TABLES = tables()


def stamp(pts: int) -> bytes:
    """33 bits in five bytes with marker bits, as a presentation timestamp alone has them."""
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE])


def unstamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def padded(raw: bytes) -> bytes:
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" ")


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload of whole units."""
    out, counter, each = bytearray(TABLES), 0, UNIT * UNITS_PER_PACKET
    for k, at in enumerate(range(0, len(payload), each)):
        data = payload[at : at + each]
        pts = k * UNITS_PER_PACKET * TICKS & (1 << 33) - 1
        pes = b"\0\0\x01\xbd" + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + stamp(pts) + data
        field_ = b""
        if k % POINT_EVERY == 0:  # random access, with a clock reference
            field_ = b"\x50" + (pts << 15 | 0x7E00).to_bytes(6, "big")
        pos, start = 0, True
        while pos < len(pes):
            room = PAYLOAD - (len(field_) + 1 if field_ else 0)
            chunk = pes[pos : pos + room]
            pos += len(chunk)
            if len(chunk) < PAYLOAD:
                size = PAYLOAD - len(chunk) - 1
                extra = (field_ or (b"\0" if size else b"")).ljust(size, b"\xff")
                out += header(ES_PID, start, 3, counter) + bytes([size]) + extra + chunk
            else:
                out += header(ES_PID, start, 1, counter) + chunk
            counter, start, field_ = counter + 1 & 15, False, b""
    return bytes(out)


@dataclass
class Stream:
    """What reading a transport stream gives."""

    programs: dict[int, int] = field(default_factory=dict)  # program -> pid of its map
    streams: dict[int, int] = field(default_factory=dict)  # elementary pid -> kind
    packets: int = 0
    lost: int = 0  # continuity counters that don't follow
    repeated: int = 0  # packets sent twice, as the format allows
    broken: int = 0  # packets without sync or with impossible lengths, sections with a wrong CRC
    skipped: int = 0  # bytes outside packets
    torn: int = 0  # elementary packets that aren't whole
    payloads: dict[int, bytes] = field(default_factory=dict)  # elementary pid -> its packets' data end to end
    stamps: list[tuple[int, int, bool, int]] = field(default_factory=list)  # timestamp, byte offset in the stream, random access, pid

    @property
    def times(self) -> list[tuple[int, int, bool]]:
        return [x[:3] for x in self.stamps]

    @property
    def payload(self) -> bytes:
        """That of the elementary stream of least pid."""
        return self.payloads[min(self.payloads)] if self.payloads else b""


class Elementary:
    """The elementary stream of one pid: the packet that is being put together, and the data so far."""

    def __init__(self):
        self.data, self.open, self.at, self.point = bytearray(), None, 0, False

    def begin(self, at: int, point: bool) -> None:
        self.open, self.at, self.point = bytearray(), at, point

    def finish(self) -> tuple[tuple[int, int, bool] | None, bool]:
        """((timestamp, offset, random access) or None, whether the packet was whole); its data joins the rest."""
        if self.open is None:
            return None, True
        whole, self.open = self.open, None
        if len(whole) < 9 or whole[:3] != b"\0\0\1" or len(whole) < 9 + whole[8]:
            return None, False
        size = int.from_bytes(whole[4:6], "big")
        self.data += whole[9 + whole[8] : 6 + size if size else len(whole)]
        time = (unstamp(whole[9:14]), self.at, self.point) if whole[7] & 0x80 and whole[8] >= 5 else None
        return time, not size or len(whole) >= 6 + size


class Sections:
    """The table sections of one pid, over as many packets as they take."""

    def __init__(self):
        self.held: bytearray | None = None  # None until a section begins

    def feed(self, data: bytes, start: bool) -> Iterator[bytes]:
        if start:
            pointer = data[0] if data else 0
            yield from self.whole(data[1 : 1 + pointer])
            self.held = bytearray()
            yield from self.whole(data[1 + pointer :])
        else:
            yield from self.whole(data)

    def whole(self, data: bytes) -> Iterator[bytes]:
        if self.held is None:
            return
        self.held += data
        while len(self.held) >= 3 and self.held[0] != 0xFF:  # stuffing follows the last
            size = 3 + (int.from_bytes(self.held[1:3], "big") & 0xFFF)
            if len(self.held) < size:
                return
            yield bytes(self.held[:size])
            del self.held[:size]


def aligned(ts: bytes, s: Stream) -> Iterator[int]:
    """Where packets begin. A lone damaged sync byte keeps the beat; where the beat is lost, the next sync byte that repeats a packet later sets it."""
    at = 0
    while at < len(ts):
        if ts[at] == SYNC or at + PACKET >= len(ts) or ts[at + PACKET] == SYNC:
            yield at
            at += PACKET
            continue
        to = ts.find(SYNC, at + 1)
        while 0 <= to < len(ts) - PACKET and ts[to + PACKET] != SYNC:
            to = ts.find(SYNC, to + 1)
        if to < 0:
            yield at  # no beat any more: what is left is broken, a packet's worth at a time
            at += PACKET
        else:
            s.skipped += to - at
            at = to


def demux(ts: bytes) -> Stream:
    """Read a stream of any number of programs and elementary streams; faults are counted, never raised.

    Bytes that belong to no packet, at the start or in between, are skipped and counted (see aligned).
    """
    s = Stream()
    last: dict[int, tuple[int, bytes]] = {}  # pid -> counter and payload of its last packet
    sections: dict[int, Sections] = {}
    flows: dict[int, Elementary] = {}

    def finish(pid: int) -> None:
        time, good = flows[pid].finish()
        s.torn += not good
        if time:
            s.stamps.append((*time, pid))

    for at in aligned(ts, s):
        s.packets += 1
        if ts[at] != SYNC or at + PACKET > len(ts) or ts[at + 1] & 0x80:
            s.broken += 1
            continue
        control = ts[at + 3]
        pid, start = (ts[at + 1] & 0x1F) << 8 | ts[at + 2], bool(ts[at + 1] & 0x40)
        pos, flags = at + 4, 0
        if control & 0x20:
            size = ts[pos]
            if size > (182 if control & 0x10 else 183):
                s.broken += 1
                continue
            flags = ts[pos + 1] if size else 0
            pos += 1 + size
        if not control & 0x10 or pid == 0x1FFF:
            continue
        data, counter = ts[pos : at + PACKET], control & 15
        if pid in last and not flags & 0x80:  # a flagged discontinuity is none that was lost
            if last[pid] == (counter, data):
                s.repeated += 1
                continue
            s.lost += last[pid][0] + 1 & 15 != counter
        last[pid] = counter, data
        if pid in s.streams:
            flow = flows.setdefault(pid, Elementary())
            if start:
                finish(pid)
                flow.begin(at, bool(flags & 0x40))
            if flow.open is not None:
                flow.open += data
        elif pid == 0 or pid in s.programs.values():
            for section_ in sections.setdefault(pid, Sections()).feed(data, start):
                read_section(s, pid, section_)
    for pid in flows:
        finish(pid)
    s.payloads = {pid: bytes(f.data) for pid, f in flows.items()}
    s.stamps.sort(key=lambda x: x[1])
    return s


def read_section(s: Stream, pid: int, data: bytes) -> None:
    """Take the programs of an association table, or the streams of a program's map."""
    if len(data) < 12 or section_crc(data):
        s.broken += 1
    elif pid == 0 and data[0] == 0:
        for k in range(8, len(data) - 7, 4):
            if program := int.from_bytes(data[k : k + 2], "big"):  # 0 names the network
                s.programs[program] = int.from_bytes(data[k + 2 : k + 4], "big") & 0x1FFF
    elif data[0] == 2:
        k = 12 + (int.from_bytes(data[10:12], "big") & 0xFFF)
        while k + 5 <= len(data) - 4:
            s.streams[int.from_bytes(data[k + 1 : k + 3], "big") & 0x1FFF] = data[k]
            k += 5 + (int.from_bytes(data[k + 3 : k + 5], "big") & 0xFFF)


def describe(s: Stream) -> str:
    """Tables, packet counts, faults, span of timestamps, and the timestamps of the random-access points."""
    kinds = ",".join(f"{pid}:{kind}" for pid, kind in sorted(s.streams.items()))
    maps = ",".join(f"{p}:{pid}" for p, pid in sorted(s.programs.items()))
    points = ",".join(str(t) for t, _, p in s.times if p)
    span = f"{s.times[0][0]}-{s.times[-1][0]}" if s.times else ""
    return f"programs={maps};streams={kinds};packets={s.packets};pes={len(s.times)};lost={s.lost};repeated={s.repeated};broken={s.broken};torn={s.torn};pts={span};points={points}" + (f";skipped={s.skipped}" if s.skipped else "")


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the transport stream of every text. A null text counts as empty; an empty one is a unit of spaces."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        for b in bounded(batches, 1):
            raw = [t.encode() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, raw), pa.int64()), pa.array((mux(padded(r)) for r in raw), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return source.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def access_points(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, pid, seconds, byte_offset, random_access): a row for each elementary packet with a timestamp of each stream."""
    def run(batches):
        for b in bounded(batches, 1):
            rows = [(i, pid, t / 90_000, at, p) for i, ts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for t, at, p, pid in demux(ts or b"").stamps]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.bool_()), strict=True)], names=["doc_id", "pid", "seconds", "byte_offset", "random_access"])

    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, "doc_id long, pid int, seconds double, byte_offset long, random_access boolean")


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
TIMES = "timestamps array<struct<pts:bigint,byte_offset:bigint,random_access:boolean>>"


def read_media(media: DataFrame) -> DataFrame:
    """What the stored streams hold: payload read back, its digests, the features of the stream, and its timestamps (READ, TIMES)."""

    def run(batches):
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in READ.split(", ")]
        times = pa.list_(pa.struct([("pts", pa.int64()), ("byte_offset", pa.int64()), ("random_access", pa.bool_())]))
        for b in bounded(batches, 2):
            rows = []
            for i, n, ts in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                s = demux(ts)
                stamps = [{"pts": t, "byte_offset": at, "random_access": p} for t, at, p in s.times]
                rows.append((i, n, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-16:]), len(ts), hashlib.sha256(ts).hexdigest(), describe(s), stamps))
            cols = list(zip(*rows, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [*kinds, times], strict=True)], names=[*(x.split()[0] for x in READ.split(", ")), "timestamps"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"{READ}, {TIMES}")


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as a stream, read the stored table back and describe it: the columns of READ and TIMES.

    A row for each row of docs, repeated rows and null ids included; equal texts have equal values. An empty
    table gives an empty result. Other columns of docs are not looked at.
    """
    return read_media(stored(to_media(docs, id_col, text_col), "media"))
