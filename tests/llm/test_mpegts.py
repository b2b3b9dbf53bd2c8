"""Transport streams: exact round trips and the faults that reading reports."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ohmweave.llm import mpegts


def test_section_crc_of_the_check_string():
    assert mpegts.section_crc(b"123456789") == 0x0376E6E7


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_round_trip(raw):
    payload = mpegts.padded(raw)
    assert len(payload) % 192 == 0
    assert len(payload) > 0
    assert payload.rstrip(b" ") == raw.rstrip(b" ")
    s = mpegts.demux(mpegts.mux(payload))
    assert (s.payload, s.lost, s.broken) == (payload, 0, 0)
    assert s.programs == {1: mpegts.PMT_PID}
    assert s.streams == {mpegts.ES_PID: mpegts.PRIVATE_DATA}


def test_long_streams_wrap_counters_and_mark_points():
    payload = random.Random(1).randbytes(192 * 50 * 41)
    ts = mpegts.mux(payload)
    s = mpegts.demux(ts)
    assert s.payload == payload
    assert [t for t, _, _ in s.times] == [k * 108_000 for k in range(41)]
    assert [k for k, (_, _, p) in enumerate(s.times) if p] == list(range(0, 41, 4))
    for _, at, _ in s.times:
        assert ts[at] == 0x47
        assert ts[at + 1] & 0x40


def test_faults_are_seen():
    ts = mpegts.mux(mpegts.padded(b"x" * 5000))
    assert mpegts.demux(ts[: 188 * 5] + ts[188 * 6 :]).lost == 1
    assert mpegts.demux(ts[: 188 * 5] + b"\0" + ts[188 * 5 + 1 :]).broken == 1
    assert mpegts.demux(ts[:10] + b"\x55" + ts[11:]).broken == 1
    assert mpegts.demux(b"").packets == 0


def two_streams(a, b):
    """Both payloads interleaved packet by packet under one program, the second as pid 0x102; the map spans two packets."""
    first, second = (mpegts.mux(mpegts.padded(x)) for x in (a, b))
    cut = lambda ts: [ts[k : k + 188] for k in range(376, len(ts), 188)]
    moved = [bytes([0x47, p[1] & 0xE0 | 1, 2]) + p[3:] for p in cut(second)]
    entry = lambda pid: bytes([6]) + (0xE000 | pid).to_bytes(2, "big") + b"\xf0\0"
    pad = bytes([6]) + (0xE000 | 0x900).to_bytes(2, "big") + b"\xf0\xc8" + b"d" * 200
    pmt = mpegts.section(2, 1, b"\xe1\x01\xf0\0" + entry(0x101) + pad + entry(0x102))
    tables = first[:188] + mpegts.header(0x1000, True, 1, 0) + b"\0" + pmt[:183] + (mpegts.header(0x1000, False, 1, 1) + pmt[183:]).ljust(188, b"\xff")
    out = [tables]
    one, two = cut(first), moved
    for k in range(max(len(one), len(two))):
        out += one[k : k + 1] + two[k : k + 1]
    return b"".join(out)


def test_interleaved_streams_are_put_together_apart():
    rng = random.Random(5)
    a, b = rng.randbytes(20_160), rng.randbytes(20_160)
    s = mpegts.demux(two_streams(a, b))
    assert (s.payloads, s.lost, s.broken, s.torn) == ({0x101: a, 0x102: b}, 0, 0, 0)
    assert s.streams == {0x101: 6, 0x900: 6, 0x102: 6}
    assert {p for _, _, _, p in s.stamps} == {0x101, 0x102}


def test_repeats_and_flagged_discontinuities_are_no_losses():
    ts = mpegts.mux(mpegts.padded(b"x" * 5000))
    k = 188 * 5
    s = mpegts.demux(ts[: k + 188] + ts[k:])
    assert (s.repeated, s.lost, s.torn, s.payload) == (1, 0, 0, mpegts.padded(b"x" * 5000))
    flagged = mpegts.header(mpegts.ES_PID, False, 3, 9) + b"\x01\x80" + b"y" * 182
    assert mpegts.demux(ts[:k] + flagged).lost == 0
    assert mpegts.demux(ts[:k] + mpegts.header(mpegts.ES_PID, False, 1, 15) + b"y" * 184).lost == 1


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=6), st.integers(0, 188 * 30))
def test_damage_is_counted_not_raised(noise, at):
    ts = mpegts.mux(mpegts.padded(b"x" * 5000))
    s = mpegts.demux(ts[:at] + noise + ts[at + len(noise) :])
    assert s.packets
    short = mpegts.demux(ts[: at % len(ts)])
    assert short.payload in (b"", mpegts.padded(b"x" * 5000)[: len(short.payload)])


def test_impossible_lengths_are_broken():
    ts = mpegts.mux(mpegts.padded(b"x" * 5000))
    bad = bytes([0x47, 1, 1, 0x30, 250]) + b"\xff" * 183
    s = mpegts.demux(ts + bad)
    assert (s.broken, s.payload) == (1, mpegts.padded(b"x" * 5000))


@pytest.mark.parametrize("pts", [0, 1, 90_000, (1 << 33) - 1, 0x155555555])
def test_timestamps(pts):
    b = mpegts.stamp(pts)
    assert mpegts.unstamp(b) == pts
    assert b[0] & 1
    assert b[2] & 1
    assert b[4] & 1


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "é" * 96), (4, "x" * 193), (4, "x" * 193), (None, "long " * 60_000)]
    df = spark.createDataFrame([(i, t, b"m", 1) for i, t in rows], "doc_id long, text string, media binary, n_bytes int")
    got = mpegts.media_digest(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        raw = (t or "").encode()
        p = mpegts.padded(raw)
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(mpegts.mux(p)), hashlib.sha256(mpegts.mux(p)).hexdigest())
    assert by[1].feature == by[2].feature
    assert [(t.pts, t.random_access) for t in by[3].timestamps] == [(0, True)]
    assert mpegts.media_digest(df.limit(0)).count() == 0
    points = mpegts.access_points(mpegts.to_media(df)).where("doc_id is null").collect()
    assert len(points) == 32
    assert sum(r.random_access for r in points) == 8


def test_a_lost_beat_is_found_again():
    payload = bytes(range(256)) * 40
    ts = mpegts.mux(payload)
    whole = mpegts.demux(ts)
    for at in (0, 188 * 3, 188 * 20):
        for stray in (b"stray", b"\x00" * 100, b"G", b"GG" * 40):
            s = mpegts.demux(ts[:at] + stray + ts[at:])
            assert s.skipped + 188 * s.broken >= len(stray)
            assert s.broken <= 1 and s.lost <= 1
            if at == 0 and b"G" not in stray:
                assert (s.payload, s.skipped, s.broken) == (whole.payload, len(stray), 0)
    cut = mpegts.demux(ts[: 188 * 10 + 50] + ts[188 * 10 + 90 :])  # 40 bytes are missing
    assert cut.broken + cut.lost >= 1 and cut.packets >= whole.packets - 3
    noise = mpegts.demux(b"\x01" * 10_000)
    assert noise.packets == noise.broken and noise.payload == b""
