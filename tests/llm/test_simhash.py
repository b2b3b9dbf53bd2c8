"""SimHash components against all pairs compared in plain Python."""

import random
from collections import Counter

import pytest
import xxhash

from ohmweave.llm import simhash
from ohmweave.llm.common import connected_components, table

SCHEMA = "doc_id long, text string, key int, fingerprint int, node string"


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    words = [w for w in words if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=3):
    fp = {i: f for i, f in rows}
    parent = {i: i for i in fp}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fp)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (fp[a] ^ fp[b]).bit_count() <= radius:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def test_matches_brute_force_on_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    want = brute_components(rows)
    assert got == {i: (f"{f:016x}", want[i]) for i, f in rows}


@pytest.mark.parametrize(("parts", "radius"), [(4, 3), (2, 5)])
def test_ball_links_lose_no_link(spark, parts, radius):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 7))) for b in base for _ in range(12)} | {0, 1, (1 << 64) - 1}
    nodes = [(simhash.signed(f), simhash.signed(f)) for f in fps]
    links = simhash.ball_links(spark.createDataFrame(nodes, "node long, fp long"), (radius,), parts)
    pairs = [(r.a & simhash.FULL, r.b & simhash.FULL) for r in links.collect()]
    assert all((a ^ b).bit_count() <= radius for a, b in pairs)
    got = connected_components(links).collect()
    comp = {r.node: r.component for r in got}
    ids = {simhash.signed(f): f for f in fps}
    want = brute_components(ids.items(), radius)
    groups = Counter(want.values())
    for i in ids:
        if groups[want[i]] > 1:
            assert comp[i] == min(j for j in ids if want[j] == want[i])
        else:
            assert i not in comp


def test_edge_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One Word"), (5, "one word"), (5, "one word"), (None, "one word"), (7, long), (8, long.upper())]
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id or 0, r.component_id, r.fingerprint) for r in simhash.near_duplicates(df).collect()))
    assert [x[:2] for x in got] == [(0, 4), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4), (7, 7), (8, 7)]
    assert got[1][2] == "0" * 16
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_stage_keeps_one_of_each_group(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    base = [[word() for _ in range(300)] for _ in range(6)]
    rows = []
    for g, ws in enumerate(base):
        rows.append((10 * g, " ".join(ws), g, None, "s"))
        for k in range(1, 4):
            near = list(ws)
            near[50 * k] = word()
            rows.append((10 * g + k, " ".join(near), g, None, "s"))
        rows.append((10 * g + 5, " ".join(ws), g, None, "s"))
    rows += [(0, " ".join(base[0]), 0, None, "s"), (None, " ".join(base[0]), 0, None, "s"), (90, None, 0, None, None), (91, "", 0, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = simhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in out.collect()) == [-1, 0, 10, 20, 30, 40, 50, 90]
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0
