"""The conversation trie against prefixes counted in plain Python."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest

from ohmweave.llm import turn_trie as tt

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).hexdigest(), text))
    own = {c: [(r, t) for *_, r, _, t in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, d == len(whole)))
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    first = {p: min(c for c, _ in m) for p, m in members.items()}
    ends = {p: hashlib.sha256(",".join(str(c) for c in sorted(c for c, last in m if last)).encode()).hexdigest() for p, m in members.items()}
    return sorted(((first[p], len(p), first[p[:-1]] if p else None, len(m), len(kids[p]), leaves[p], saved[p], ends[p]) for p, m in members.items()), key=key)


def key(row):
    return tuple((x is not None, x) for x in row)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


def random_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(1200), n):
        for t in range(rng.choice((0, 1, 1, 2, 3, 5, 9, 14))):
            rows.append((c, t, rng.choice(("user", "assistant")), rng.choice(("yes", "no", "é😀", "tell me", ""))))
    return rows


def test_matches_brute_force(spark):
    rows = random_rows(260, 3)
    assert plain(tt.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


@pytest.mark.parametrize("turns", [1, 4, 25, 10**6])
def test_any_number_of_trees_gives_the_same_nodes(spark, turns):
    rows = random_rows(200, 5)
    seqs = tt.sequences(tt.rebuilt(tt.encoded_turns(spark.createDataFrame(rows, SCHEMA))))
    assert plain(tt.trie(seqs, turns)) == brute(rows)


def test_edge_rows(spark):
    rows = [(0, 0, "user", "a"), (0, None, None, None), (0, 1, "user", "b"), (None, 0, "user", "lost"), (7, 2, "user", "x"), (7, 2, "user", "x"), (7, 2, "bot", "x"), (7, None, "bot", "")]
    rows += [(-205, 1, "user", "m"), (-200, 1, "user", "n"), (-205, 2, "user", "o"), (305, 0, None, "z" * 200_000), (306, 0, "a:", "b"), (307, 0, "a", ":b")]
    rows += [(c, t, "user", f"t{t}") for c in (400, 401) for t in range(400)]
    df = spark.createDataFrame([(*r, "other", 1) for r in rows], SCHEMA + ", id string, len int")
    assert plain(tt.conversation_trie(df)) == brute(rows)
    assert tt.conversation_trie(df.limit(0)).count() == 0
    assert plain(tt.conversation_trie(df.limit(0).unionByName(df.where("conv_id is null")))) == []


def test_many_equal_conversations_are_hashed_in_pieces(spark):
    rows = [(c, 0, "user", "hello") for c in range(3 * tt.PIECE // 2)]
    assert plain(tt.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_search_trees_are_balanced():
    tree = tt.Tree()
    for i in tt.middles_first(1023):
        tree.put([i], [1])
    deepest, stack = 0, [(tree.deeper[0], 1)]
    while stack:
        node, d = stack.pop()
        if node >= 0:
            deepest = max(deepest, d)
            stack += [(tree.low[node], d + 1), (tree.high[node], d + 1)]
    assert deepest == 10
    assert [tree.id[v] for v in tree.in_order()[1:]] == list(range(1023))


def test_a_shard_holds_a_bounded_number_of_turns():
    seqs = [([1, i], [1, 1], 1, i, "x") for i in range(100)]
    batch = tt.sequence_batch(seqs)
    rows = [b for b in tt.shard_rows(iter([batch]), 30)]
    assert len(rows) == 10
    assert sum(pa.Table.from_batches([b]).column("p_ids").null_count < b.num_rows for b in rows) == 10
