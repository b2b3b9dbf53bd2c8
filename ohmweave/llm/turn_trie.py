"""Prefix trie of conversations: which openings they share, and what computing each opening once would save.

Turns are named by integers from a dictionary of distinct (role, text). Conversations of equal turns become one row, these
are dealt out by ranges of their sequences, and each shard puts its own into a ternary search tree, middles of ranges
first, so that the search trees among the children of a node are balanced. One traversal with a stack of its own then adds
up members, leaves and savings. Only nodes on the way to a shard's first and last sequence can have members in other
shards: they are merged by a tree over two paths a shard; every other node is final where it is made.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, join_split, stored

#: Turns that a tree takes in before the shard's rest gets another one: bounds a task's memory, whatever its shard's size.
TREE_TURNS = 500_000
#: Conversation ids that travel as one piece of a sequence's list of ends.
PIECE = 8_192
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
SEQUENCE = "ids array<long>, lens array<long>, n long, first long, ends string"
PATH = "ids array<long>, lens array<long>, n array<long>, first array<long>, children array<long>, leaves array<long>, saved array<long>, ends array<string>"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its hundred."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(6)).cast("int")


def encoded_turns(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv_id, ids, lens): each conversation's turns in order, as numbers of a dictionary of (role, text), with their code points.

    Texts are hashed where they are read and move no further; SHA-256 stands for a turn's content.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    hashed = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.unhex(F.sha2(text, 256)).alias("tie"), key.alias("key"), F.length(text).cast("long").alias("len"))
    rows = stored(hashed.where("conv_id is not null"), "turns")
    words = stored(rows.groupBy("key").agg(F.max("len").alias("len")).select("key", "len", F.monotonically_increasing_id().alias("id")), "dictionary")
    coded = join_split(rows.drop("len"), words, "key").select("conv_id", F.struct("turn", "role", "tie", "id", "len").alias("t"))
    return coded.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.col("t.id").alias("ids"), F.col("t.len").alias("lens"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """(conv_id, ids, lens): the first h turns of the first conversation of each hundred, then a conversation's own turns after its first h."""
    base = F.col("conv_id") - F.col("conv_id") % 100
    firsts = convs.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), *(F.slice(c, 1, 5).alias(f"base_{c}") for c in ("ids", "lens")))
    met = convs.withColumn("base", base).withColumn("h", shared_turns(F.col("conv_id"))).join(firsts, "base", "left")
    mixed = lambda c: F.concat(F.coalesce(F.slice(f"base_{c}", F.lit(1), F.col("h")), F.expr("cast(array() as array<long>)")), F.slice(c, F.col("h") + 1, F.greatest(F.size(c) - F.col("h"), F.lit(0))))
    return met.select("conv_id", mixed("ids").alias("ids"), mixed("lens").alias("lens"))


def sequences(convs: DataFrame) -> DataFrame:
    """(ids, lens, n, first, ends): distinct sequences, how many conversations have each, the least of them, SHA-256 of all their ids.

    Ids travel in pieces made in tasks dealt out by (sequence, id), so that a sequence of very many conversations is no hot key.
    """
    keyed = convs.withColumn("key", F.unhex(F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256))).select("key", "conv_id", "ids", "lens")

    def pieces(batches) -> Iterator[pa.RecordBatch]:
        held, ids, out, size = None, [], [], 0

        def close():
            if ids:
                out.append((held[0], ids[0], len(ids), ",".join(map(str, ids)), held[1], held[2]))

        for b in batches:
            for key, conv, seq, lens in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held is None or key != held[0] or len(ids) == PIECE:
                    close()
                    size += len(seq) + len(ids)
                    held, ids = (key, seq, lens), []
                    if size > 1 << 17:
                        yield piece_batch(out)
                        out, size = [], 0
                ids.append(conv)
        close()
        if out:
            yield piece_batch(out)

    cut = stored(keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(pieces, "key binary, first long, n long, text string, ids array<long>, lens array<long>"), "pieces")

    def joined(batches) -> Iterator[pa.RecordBatch]:
        key, first, n, digest, seq, lens = None, 0, 0, None, [], []
        for b in batches:
            out = []
            for k, f, m, text, s, le in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k == key:
                    n += m
                    digest.update(f",{text}".encode())
                    continue
                if key is not None:
                    out.append((seq, lens, n, first, digest.hexdigest()))
                key, first, n, digest, seq, lens = k, f, m, hashlib.sha256(text.encode()), s, le
            yield sequence_batch(out)
        if key is not None:
            yield sequence_batch([(seq, lens, n, first, digest.hexdigest())])

    return cut.repartition("key").sortWithinPartitions("key", "first").mapInArrow(joined, SEQUENCE)


LONGS = pa.list_(pa.int64())
TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": LONGS, "array<string>": pa.list_(pa.string())}


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], TYPES[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def piece_batch(rows):
    return batch_of(rows, "key binary, first long, n long, text string, ids array<long>, lens array<long>")


def sequence_batch(rows):
    return batch_of(rows, SEQUENCE)


class Tree:
    """A ternary search tree over sequences of integers. A node is a prefix; node 0 is the empty one.

    low and high lead to smaller and larger last ids after the same prefix, deeper to what follows.
    """

    def __init__(self) -> None:
        self.id, self.len, self.parent, self.low, self.deeper, self.high = [None], [0], [-1], [-1], [-1], [-1]
        self.n, self.first, self.children, self.leaves, self.saved, self.ends = [0], [None], [0], [0], [0], [None]

    def put(self, ids: list[int], lens: list[int]) -> int:
        """The node of a sequence, made where it isn't there."""
        at = 0
        for x, size in zip(ids, lens, strict=True):
            back, node = (self.deeper, at), self.deeper[at]
            while node >= 0 and self.id[node] != x:
                side = self.low if x < self.id[node] else self.high
                back, node = (side, node), side[node]
            if node < 0:
                node = len(self.id)
                back[0][back[1]] = node
                for column, value in ((self.id, x), (self.len, size), (self.parent, at), (self.low, -1), (self.deeper, -1), (self.high, -1), (self.n, 0), (self.first, None), (self.children, 0), (self.leaves, 0), (self.saved, 0), (self.ends, None)):
                    column.append(value)
            at = node
        return at

    def in_order(self) -> list[int]:
        """All nodes, each before what is below it, siblings by id; with a stack instead of recursion."""
        out, stack = [0], [(self.deeper[0], False)]
        while stack:
            node, opened = stack.pop()
            if node < 0:
                continue
            if opened:
                out.append(node)
                stack += [(self.high[node], False), (self.deeper[node], False)]
            else:
                stack += [(node, True), (self.low[node], False)]
        return out

    def path(self, node: int) -> list[int]:
        out = []
        while node >= 0:
            out.append(node)
            node = self.parent[node]
        return out[::-1]

    def depths(self) -> list[int]:
        out = [0] * len(self.id)
        for node in range(1, len(out)):  # a node is made after the one above it
            out[node] = out[self.parent[node]] + 1
        return out

    def add_up(self, order: list[int], open_nodes: set[int]) -> None:
        """Counts of each node from those below it; nodes of open_nodes pass on members only, the rest of theirs isn't known yet."""
        for node in reversed(order):
            if node not in open_nodes:
                self.finish(node)
            up = self.parent[node]
            if up >= 0:
                self.n[up] += self.n[node]
                self.first[up] = least(self.first[up], self.first[node])
                if node not in open_nodes:
                    self.children[up] += 1
                    self.leaves[up] += self.leaves[node]
                    self.saved[up] += self.saved[node]

    def finish(self, node: int) -> None:
        self.leaves[node] = self.leaves[node] or 1
        self.saved[node] += (self.n[node] - 1) * self.len[node]


def least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def middles_first(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of each range before those of its halves."""
    ranges = deque([(0, n)])
    while ranges:
        lo, hi = ranges.popleft()
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            ranges += [(lo, mid), (mid + 1, hi)]


def name_of(above: bytes, x: int) -> bytes:
    """Names a prefix by the name of the one before it and its last turn."""
    return hashlib.blake2b(above + x.to_bytes(8, "little", signed=True), digest_size=20).digest()


def path_names(ids: list[int]) -> list[bytes]:
    out = [b""]
    for x in ids:
        out.append(name_of(out[-1], x))
    return out


SHARD_ROW = f"{NODE}, parent_name binary, {', '.join(f'p_{c}' for c in PATH.split(', '))}"


def shard_rows(batches, tree_turns: int) -> Iterator[pa.RecordBatch]:
    """Final nodes, and the paths to the first and last sequence of each tree; sequences come in order."""
    held, turns = [], 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            held.append(row)
            turns += len(row[0]) + 1
            if turns >= tree_turns:
                yield from tree_rows(held)
                held, turns = [], 0
    if held:
        yield from tree_rows(held)


def tree_rows(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    tree, end = Tree(), {}
    for i in middles_first(len(held)):
        ids, lens, n, first, ends = held[i]
        node = end[i] = tree.put(ids, lens)
        tree.n[node], tree.first[node], tree.ends[node] = n, first, ends
    paths = [(tree.path(end[i]), *held[i][:2]) for i in (0, len(held) - 1)]
    names = {node: name for path, ids, _ in paths for node, name in zip(path, path_names(ids), strict=True)}
    order, depths = tree.in_order(), tree.depths()
    tree.add_up(order, names.keys())
    rows, empty = [], (None,) * 8
    for node in order:
        if node in names:
            continue
        up = tree.parent[node]
        known = up not in names
        rows.append((tree.first[node], depths[node], tree.first[up] if known else None, tree.n[node], tree.children[node], tree.leaves[node], tree.saved[node], tree.ends[node] or NO_ENDS, None if known else names[up], *empty))
        if len(rows) == 1 << 14:
            yield batch_of(rows, SHARD_ROW)
            rows = []
    told: set[int] = set()
    for path, ids, lens in paths:
        fresh = [node not in told for node in path]
        column = lambda values, none: [values[v] if f else none for v, f in zip(path, fresh, strict=True)]  # noqa: B023, E731
        rows.append((*(None,) * 9, ids, lens, column(tree.n, 0), column(tree.first, None), column(tree.children, 0), column(tree.leaves, 0), column(tree.saved, 0), column(tree.ends, None)))
        told.update(path)
    yield batch_of(rows, SHARD_ROW)


MERGED = f"name binary, {NODE}"


def merged_rows(batches) -> Iterator[pa.RecordBatch]:
    """The nodes of all shards' outer paths, put together: members, children, leaves and savings of the shards add up."""
    tree, names, any_path = Tree(), {}, False
    for b in batches:
        for ids, lens, n, first, children, leaves, saved, ends in zip(*(c.to_pylist() for c in b.columns), strict=True):
            any_path = True
            path = tree.path(tree.put(ids, lens))
            for i, (node, name) in enumerate(zip(path, path_names(ids), strict=True)):
                names[node] = name
                tree.n[node] += n[i]
                tree.first[node] = least(tree.first[node], first[i])
                tree.children[node] += children[i]
                tree.leaves[node] += leaves[i]
                tree.saved[node] += saved[i]
                tree.ends[node] = tree.ends[node] or ends[i]
    if not any_path:
        return
    order, depths = tree.in_order(), tree.depths()
    for node in reversed(order):  # members are whole already
        tree.finish(node)
        up = tree.parent[node]
        if up >= 0:
            tree.children[up] += 1
            tree.leaves[up] += tree.leaves[node]
            tree.saved[up] += tree.saved[node]
    for k in range(0, len(order), 1 << 14):
        yield batch_of(
            [(names[v], tree.first[v], depths[v], tree.first[tree.parent[v]] if v else None, tree.n[v], tree.children[v], tree.leaves[v], tree.saved[v], tree.ends[v] or NO_ENDS) for v in order[k : k + (1 << 14)]],
            MERGED,
        )


def trie(seqs: DataFrame, tree_turns: int = TREE_TURNS) -> DataFrame:
    """NODE rows of the trie of sequences (ids, lens, n, first, ends), each sequence once."""
    made = stored(seqs.repartitionByRange("ids").sortWithinPartitions("ids").mapInArrow(partial(shard_rows, tree_turns=tree_turns), SHARD_ROW), "shards")
    columns = [f.split(" ")[0] for f in NODE.split(", ")]
    # two paths a shard, whatever the number of conversations
    paths = made.where("p_ids is not null").select(*(F.col(f"p_{f.split(' ')[0]}") for f in PATH.split(", ")))
    outer = stored(paths.repartition(1).mapInArrow(merged_rows, MERGED), "outer")
    inner = made.where("p_ids is null")
    above = broadcast_if_small(outer.select(F.col("name").alias("parent_name"), F.col("conv_id").alias("above")))
    met = inner.where("parent_name is not null").join(above, "parent_name").withColumn("parent_conv_id", F.col("above"))
    return outer.select(*columns).unionByName(inner.where("parent_name is null").select(*columns)).unionByName(met.select(*columns))


def conversation_trie(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """NODE rows: the prefix trie of rebuilt conversations (see rebuilt). turns: conv_id, turn, role, text.

    Turns go by `turn`, null first; rows of one turn by role, then SHA-256 of the text; repeated rows are turns of their
    own. A null role or text counts as empty. Rows without a conv_id belong to no conversation and are left out. A
    conversation whose rebuilt form has no turn is a member of the root alone. Negative ids: the remainder has the id's sign.
    A text may have any length: it is hashed where it is read. A conversation's turn numbers are one value, as a text is.
    An empty table has no root and gives no row. Extra columns are not looked at.
    """
    return trie(stored(sequences(rebuilt(stored(encoded_turns(turns, conv_col), "conversations"))), "sequences"))


#: CRC-32 of a decimal number's text, bit by bit.
CRC32_SQL = """xor(list_reduce(flatten(list_transform(range(1, length({0}) + 1), lambda i: [ascii(substr({0}, i, 1))::bigint, 0, 0, 0, 0, 0, 0, 0])),
 lambda a, b: list_transform([xor(a, b)], lambda x: xor(x >> 1, 3988292384 * (x & 1)))[1], 4294967295::bigint), 4294967295::bigint)"""

ORACLE_SQL = f"""with t as (select conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) s from conversations where conv_id is not null group by conv_id),
h as (select *, {CRC32_SQL.format("conv_id::varchar")} % 6 h, conv_id - conv_id % 100 base from t),
b as (select h.conv_id, list_concat(coalesce(t.s[1:h.h], []), h.s[h.h + 1:]) s from h left join t on t.conv_id = h.base),
p as (select conv_id, s[1:d] p, d = len(s) last from (select *, unnest(range(len(s) + 1)) d from b)),
n as (select len(p) depth, p, min(conv_id) conv_id, count(*) n, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (last), '')) ends from p group by p),
c as (select a.*, (select count(*) from n k where k.depth = a.depth + 1 and k.p[1:a.depth] = a.p) kids, u.conv_id up from n a left join n u on a.depth > 0 and u.p = a.p[1:a.depth - 1]),
x as (select p[1:d] p, sum((kids = 0)::int) leaves, sum(case when depth > 0 then (n - 1) * length(p[depth].t) else 0 end) saved from (select *, unnest(range(depth + 1)) d from c) group by p[1:d])
select conv_id, depth::bigint depth, up parent_conv_id, n n_convs, kids n_children, leaves::bigint n_leaves, saved::bigint saved_tokens, ends ends_sha256 from c join x using (p)"""
