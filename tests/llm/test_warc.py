"""Archives and index: exact round trips, decisions against plain grouping, searches against filters."""

import base64
import gzip
import hashlib
from collections import Counter, defaultdict

import pytest

from ohmweave.llm import warc
from ohmweave.llm.common import table


def brute(rows):
    by = defaultdict(list)
    for i, html in rows:
        if i is not None:
            by[html or ""].append(i)
    out = Counter()
    for i, html in rows:
        raw = (html or "").encode()
        last = max(by[html or ""], default=None)
        to = last if i is not None and i != last else None
        out[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if to is None else "revisit", to] += 1
    return out


def found(df):
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


def test_given_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    twice = pages.unionByName(pages.where("page_id % 3 = 0").selectExpr("page_id + 100000 page_id", "url", "html"))
    assert found(warc.archive_and_read(twice.repartition(3))) == brute([(r.page_id, r.html) for r in twice.collect()])


def test_edge_rows(spark):
    big = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 20_000
    rows = [(1, "http://a/", None), (2, None, ""), (3, "http://b.c/x\ty\nz\\", "same"), (4, "", "same"), (4, "", "same"), (None, "u", "same"), (7, "http://b.c:80/", big), (8, "http://b.c/", big)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id long, url string, html string, length int, key string")
    assert found(warc.archive_and_read(df)) == brute([(i, h) for i, _, h in rows])
    assert warc.archive_and_read(df.limit(0)).count() == 0


def test_short_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.archive_and_read(df, least_bytes=3).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}


def test_lookups_search_blocks_by_key(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    rows = [(i, f"https://www.h{i % 5}.org/p{i // 3 % 40}", f"<p>{i}</p>") for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    held = warc.Archive(df.repartition(3))
    index = warc.write_index(held.captures, f"{held.at}/small", block_lines=7)
    files = [tuple(f) for f in index.collect()]
    assert sum(f[3] for f in files) >= 400 // 7
    asked = spark.createDataFrame([("https://www.h1.org/p2", 0), ("http://www.h2.org:80/p9#frag", 0), ("https://nowhere.org/", 0)], "url string, page_id long")
    keys = spark.createDataFrame([(warc.url_key(r.url), None) for r in asked.collect()], "key string, page_id long")
    got = sorted(r.page_id for r in warc.look_up(keys, f"{held.at}/small", files, by_id=False).collect())
    assert got == [i for i, u, _ in rows if u in ("https://www.h1.org/p2", "https://www.h2.org/p9")]
    one = held.find(spark.createDataFrame([(rows[33][1], 33), (rows[33][1], 34)], "url string, page_id long"), with_html=True).collect()
    assert [(r.page_id, r.html, r.url) for r in one] == [(33, "<p>33</p>", rows[33][1])]


@pytest.mark.parametrize(
    ("url", "key"),
    [("http://www.Example.com/A?b#c", "com,example,www)/A?b"), ("https://u:p@x.org:443", "org,x)/"), ("http://x.org:8080/", "org,x:8080)/"), (None, ""), ("odd thing", "odd thing"), ("//x.org?q", "org,x)/?q")],
)
def test_url_keys(url, key):
    assert warc.url_key(url) == key


def test_records_are_plain_warc():
    raw = warc.record(5, "http://x/\r\nInjected: 1", b"abc", warc.digest_of(b"abc"), None)
    fields, payload = warc.parse(gzip.decompress(gzip.compress(raw)))
    assert payload == b"abc"
    assert "Injected" not in fields
    with pytest.raises(ValueError, match="broken"):
        warc.parse(raw[:-5])
