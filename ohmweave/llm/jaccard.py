"""Exact near-copy links: every pair of texts whose five-word shingle sets have a Jaccard similarity of 0.8 or more.

Candidates come from a prefix filter, which loses none: put the shingles of all texts in one order; two sets of
similarity t share a shingle among the first n - ceil(t * n) + 1 of each. The order is by hash, with shingles that
are common in a bounded sample, or that crowd a bucket of that first order, last, so that a much repeated line makes no
large bucket however many texts there are; any order is lossless.

All links are decided by the true similarity. No bucket is compared all with all while its members are many:

1. Pairs that another search proposes (SimHash balls), and each member of a bucket with heads of it: members of least
   hash, one in a bucket of up to SMALL members, three in a larger one. The links found give components.
2. Members of large buckets that still hold several components are compared by bitmaps (see bits_of), whose bits differ no
   more than the sets do: all of a first head's members in blocks, first each member with the nearest of another
   component, then all pairs that are left. What the bitmaps allow is decided as before; a large bucket of one component is left out.
3. Small buckets compare what still lies in different components.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, connected_components, forget, freeing, give_back, join_split, made_of, stored, tidy

WIDTH = 5
SMALL = 32  # members of a bucket that are compared all with all
CROWD = 8  # members of a bucket whose shingle isn't put last
PARTNERS = 256  # of a head in one part of a task
BLOCK = 1024  # members of a head that are compared with as many others in one piece of work
MOST_BITS = 1 << 18  # of a set's bitmap
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word runs; of the whole sequence if there are fewer words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WIDTH:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype="<u8", count=len(words))
    n = len(h) - WIDTH + 1
    return np.unique(mixed(sum(h[i : i + n] * MULTIPLIERS[i] for i in range(WIDTH))))


def set_id(grams: np.ndarray) -> int:
    """A signed long that names the set; 0 for the empty one."""
    x = xxhash.xxh64_intdigest(grams.tobytes()) if len(grams) else 0
    return x - (1 << 64) if x >> 63 else x


def least_overlap(n, m, t: float):
    """Shared shingles that sets of n and m need at least for a similarity of t."""
    return np.ceil((n + m) * (t / (1 + t)) - 1e-9)


def prefix(grams: np.ndarray, common: np.ndarray, t: float) -> np.ndarray:
    """The first shingles in the global order: by hash, those of `common` (sorted) after all others."""
    n = len(grams)
    keep = n - int(np.ceil(t * n - 1e-9)) + 1
    late = np.isin(grams, common, assume_unique=True)
    return np.r_[grams[~late], grams[late]][:keep]


def set_rows(docs: DataFrame, id_col: str, text_col: str, fingerprint: Callable[[np.ndarray], int]) -> DataFrame:
    """(doc_id, text_hash, node, fp): the set's name and the fingerprint of its hashes for each row."""
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))

    def run(batches):
        for b in freeing(batches, 2):
            sets = [shingle_set(x) for x in b.column(2).to_pylist()]
            fps = np.array([fingerprint(x) for x in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(set_id, sets), pa.int64()), pa.array(fps)], names=["doc_id", "text_hash", "node", "fp"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text_hash long, node long, fp long")


def common_shingles(sample: DataFrame, most: int = 100_000, least: int = 3) -> np.ndarray:
    """Shingles in `least` or more of a bounded sample of texts (column text); they only bear on the order."""
    seen: Counter = Counter()
    for r in sample.where(F.length("text") < 20_000).select("text").toLocalIterator():
        seen.update(shingle_set(r.text).tolist())
    return np.sort(np.array([g for g, n in seen.most_common(most) if n >= least], dtype=np.uint64))


BUCKET = "key long, node long, n int"


def prefix_rows(texts: DataFrame, t: float, common) -> DataFrame:
    """BUCKET rows for each shingle of each text's prefix. texts: text; common: broadcast."""

    def run(batches):
        for b in freeing(batches, 0):
            yield bucket_rows([(set_id(g), len(g), prefix(g, common.value, t)) for g in map(shingle_set, b.column(0).to_pylist())])

    return texts.mapInArrow(run, BUCKET)


def buckets(texts: DataFrame, t: float, common) -> DataFrame:
    """prefix_rows of the keys that several rows have."""
    return several(prefix_rows(texts, t, common))


def crowded(texts: DataFrame, t: float, common, most: int = 100_000) -> np.ndarray:
    """`common` and the keys of the largest buckets that it leads to, sorted: a bounded sample misses what is common only in a large table."""
    counts = prefix_rows(texts, t, common).groupBy("key").count().where(F.col("count") > CROWD)
    keys = counts.orderBy(F.desc("count"), "key").limit(most).select("key").toArrow().column(0).to_numpy()
    return np.union1d(common.value, keys.astype(np.int64).view(np.uint64))


def unsettled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(key): the buckets whose members lie in several components."""
    rooted = rows.join(roots, "node", "left").select("key", F.coalesce("component", "node").alias("root"))
    return rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")


def bucket_rows(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    keys = [k for _, _, k in rows]
    sizes = [len(k) for k in keys]
    node = np.repeat(np.array([r[0] for r in rows], dtype=np.int64), sizes)
    n = np.repeat(np.array([r[1] for r in rows], dtype=np.int32), sizes)
    key = np.concatenate([np.empty(0, np.uint64), *keys]).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(n)], names=["key", "node", "n"])


def several(rows: DataFrame) -> DataFrame:
    """The BUCKET rows whose key is not alone, a batch and a row at a time whatever a key's number of rows."""

    def run(batches):
        held, before = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)], None
        for b in batches:
            cols = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, b.columns, strict=True)]
            if not len(cols[0]):
                continue
            alike = cols[0][:-1] == cols[0][1:]
            keep = alike | np.r_[before is not None and before == cols[0][0], alike][: len(alike)]
            before = cols[0][-2] if len(alike) else before
            held = [c[-1:] for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(c[:-1][keep]) for c in cols], names=["key", "node", "n"])
        if len(held[0]) and before is not None and before == held[0][0]:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["key", "node", "n"])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, BUCKET)


def runs(batches, width: int, rows: int = 1 << 17):
    """(columns, starts, sizes): whole runs of equal first columns, in blocks of about `rows` rows or one run."""
    parts, count = [], 0

    def block(cols):
        starts = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])
        return cols, starts, np.diff(np.r_[starts, len(cols[0])])

    for b in batches:
        if not b.num_rows:
            continue
        parts.append([c.to_numpy(zero_copy_only=False) for c in b.columns[:width]])
        count += b.num_rows
        if count < rows or parts[0][0][0] == parts[-1][0][-1]:
            continue
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
        cut = int(np.flatnonzero(cols[0] != cols[0][-1])[-1]) + 1  # the last run may go on
        yield block([c[:cut] for c in cols])
        parts = [[c[cut:] for c in cols]]
        count = len(parts[0][0])
    if count:
        yield block([np.concatenate(c) for c in zip(*parts, strict=True)])


def pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)], names=["a", "b"])


def sizes_fit(n: np.ndarray, m: np.ndarray, t: float) -> np.ndarray:
    return np.minimum(n, m) >= t * np.maximum(n, m) - 1e-9


def heads_of(rows: DataFrame) -> DataFrame:
    """(key, members, h0, h1, h2): for each bucket its size and three of its members (node, n), those of least hash.

    A node's hash is the same in all buckets, so that the buckets of one group of copies have few heads.
    """
    least = [F.min(F.struct(F.xxhash64("node", F.lit(seed)).alias("hash"), "node", "n")) for seed in range(3)]
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), *(x.alias(f"h{i}") for i, x in enumerate(least)))


def sizes_of(heads: DataFrame) -> DataFrame:
    return heads.select("key", F.col("members").alias("count"))


def head_pairs(rows: DataFrame, heads: DataFrame, t: float) -> DataFrame:
    """(a, b): each member of a bucket with its first head, or its three if it is large, whose size fits."""
    head = F.explode(F.when(F.col("members") > SMALL, F.array("h0", "h1", "h2")).otherwise(F.array("h0"))).alias("h")
    met = join_split(rows, heads, "key", counts=sizes_of(heads)).select("node", "n", head).where("node <> h.node")
    met = met.where(F.least("n", "h.n") >= F.lit(t) * F.greatest("n", "h.n") - 1e-9)
    return met.select(F.least("node", "h.node").alias("a"), F.greatest("node", "h.node").alias("b")).distinct()


def cross_pairs(shared: DataFrame, roots: DataFrame, t: float) -> DataFrame:
    """(a, b): members of a bucket that lie in different components."""
    rooted = shared.join(roots, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("root"))

    def run(batches):
        for (_, node, n, root), starts, sizes in runs(batches, 4):
            found, count = [], 0
            for s, k in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                if (root[s : s + k] == root[s]).all():
                    continue
                by = np.argsort(n[s : s + k], kind="stable") + s
                ends = s + np.searchsorted(n[by], n[by] / t + 1e-9, side="right")
                for i in range(k - 1):
                    other = by[i + 1 : ends[i] - s]
                    other = other[root[other] != root[by[i]]]
                    if len(other):
                        found.append((np.full(len(other), node[by[i]]), node[other]))
                        count += len(other)
                    if count > 1 << 18:
                        yield pair_batch(*(np.concatenate(x) for x in zip(*found, strict=True)))
                        found, count = [], 0
            if found:
                yield pair_batch(*(np.concatenate(x) for x in zip(*found, strict=True)))

    return rooted.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def known_sets(texts: DataFrame) -> DataFrame:
    """(node, grams): the whole sets, sorted. texts: node, text."""

    def sets(batches):
        for b in freeing(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(x).tobytes() for x in b.column(1).to_pylist()], pa.binary())], names=["node", "grams"])

    return stored(texts.mapInArrow(sets, "node long, grams binary"), "sets")


def bits_of(grams: np.ndarray) -> np.ndarray:
    """The set as a bitmap of a power of two of bits, four a shingle or more: a bit is on if an odd number of shingles fall on it.

    Two bitmaps of one size differ in no more bits than the sets differ in shingles, and a bitmap folds to half its size.
    """
    size = min(MOST_BITS, max(256, 1 << int(4 * len(grams) - 1).bit_length())) if len(grams) else 256
    hits = np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(hits.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def may_be_similar(n: np.ndarray, m: np.ndarray, differ: np.ndarray, t: float) -> np.ndarray:
    return differ <= n + m - 2 * least_overlap(n, m, t)


def plausible(pairs: DataFrame, bitmaps: DataFrame, t: float) -> DataFrame:
    """The pairs without those whose bitmaps alone differ in more shingles than a similarity of t allows; loses none."""
    sides = [bitmaps.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in ("a", "b")]

    def run(batches):
        for batch in batches:
            n, m = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 4))
            sets = [[np.frombuffer(x, dtype=np.uint64) for x in batch.column(i).to_pylist()] for i in (3, 5)]
            differ = np.array([np.bitwise_count(folded(x, len(y)) ^ folded(y, len(x))).sum() for x, y in zip(*sets, strict=True)], dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(may_be_similar(n, m, differ, t), pa.bool_()))

    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
    return both.mapInArrow(run, "a long, b long")


def beside_heads(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(a, part, b, grams) in order: a's set (b null) right before those of its partners b, of PARTNERS partners or so a part.

    Pairs are small beside sets: while they can be broadcast, sets move once, to where they are compared.
    """
    many = pairs.groupBy("a").count().where(F.col("count") > PARTNERS).select("a", F.ceil(F.col("count") / PARTNERS).alias("parts"))
    dealt = pairs.join(broadcast_if_small(many), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part"))
    heads = known.withColumnRenamed("node", "a").join(broadcast_if_small(dealt.select("a", "part").distinct()), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "grams")
    partners = known.withColumnRenamed("node", "b").join(broadcast_if_small(dealt), "b").select("a", "part", "b", "grams")
    return heads.unionByName(partners).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())


def partners_of(batches):
    """(list of (a, its set, b, its set)) for each batch of beside_heads."""
    head, mine = None, np.empty(0, np.uint64)
    for batch in freeing(batches, 3):
        out = []
        for i, (a, part, b) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
            grams = np.frombuffer(batch.column(3)[i].as_buffer(), dtype=np.uint64)
            if b is None:
                head, mine = (a, part), grams.copy()
            elif (a, part) != head:
                raise RuntimeError("a partner without its head")
            else:
                out.append((a, mine, b, grams))
        yield out


def verified(pairs: DataFrame, known: DataFrame, t: float) -> DataFrame:
    """The pairs whose sets have a similarity of t or more."""

    def run(batches):
        for met in partners_of(batches):
            out = [(a, b) for a, x, b, y in met if len(np.intersect1d(x, y, assume_unique=True)) >= least_overlap(len(x), len(y), t)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return beside_heads(pairs, known).mapInArrow(run, "a long, b long")


def near_in_block(node: np.ndarray, n: np.ndarray, root: np.ndarray, side: np.ndarray, bits: list[bytes], t: float, nearest: bool):
    """Arrays (a, b) of pairs of different roots (and sides, if there are two) that their bitmaps allow; of each node only the nearest if asked."""
    by = np.argsort(n, kind="stable")
    node, n, root, side, bits = node[by], n[by].astype(np.int64), root[by], side[by], [np.frombuffer(bits[i], dtype=np.uint64) for i in by.tolist()]
    ends, two = np.searchsorted(n, n / t + 1e-9, side="right"), side.min() < side.max()
    least, other = np.full(len(n), 1 << 62), np.zeros(len(n), np.int64)
    words = np.array([len(x) for x in bits])
    for w in np.unique(words).tolist():
        first, last = np.flatnonzero(words == w)[[0, -1]].tolist()  # words grow with n
        table = np.stack([folded(x, w) for x in bits[first : int(ends[last])]])
        for i in range(first, last + 1):
            to = np.arange(i + 1, int(ends[i]))
            to = to[(root[to] != root[i]) & ((side[to] != side[i]) | (not two))]
            if not len(to):
                continue
            differ = np.bitwise_count(table[to - first] ^ table[i - first]).sum(axis=1, dtype=np.int64)
            ok = may_be_similar(n[i], n[to], differ, t)
            to, differ = to[ok], differ[ok]
            if not nearest:
                yield np.full(len(to), node[i]), node[to]
            elif len(to):
                k = int(np.argmin(differ))
                if differ[k] < least[i]:
                    least[i], other[i] = differ[k], to[k]
                closer = to[differ < least[to]]
                least[closer], other[closer] = differ[differ < least[to]], i
    has = np.flatnonzero(least < 1 << 62)
    if len(has):
        yield node[has], node[other[has]]


def difference_buckets(members: DataFrame, bitmaps: DataFrame, roots: DataFrame) -> DataFrame:
    """(piece, a, i, j, own, node, root, n, bits): the pieces of work (a, i, j) in which a head's members are compared, of heads with several components.

    A head's members are dealt to blocks by hash, and every two blocks meet in a piece of their own: no task holds more than two.
    """
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component")
    sizes = rooted.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"), F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("a", "blocks")
    dealt = rooted.join(broadcast_if_small(sizes), "a").withColumn("own", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = dealt.select("a", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "node", "root")
    full = met.join(bitmaps, "node").select(F.xxhash64("a", "i", "j").alias("piece"), "a", "i", "j", "own", "node", "root", "n", "bits")
    return full.repartition("piece").sortWithinPartitions("piece", "a", "i", "j")


def near_members(members: DataFrame, bitmaps: DataFrame, roots: DataFrame, t: float, nearest: bool) -> DataFrame:
    """(a, b): members of one head, of different components, that may be similar by their bitmaps. members: a (the head), node."""

    def run(batches):
        held, now = [], None

        def pairs():
            node, root, own, n, bits = zip(*held, strict=True)
            root, own = np.array(root), np.array(own)
            if (root == root[0]).all() or now[1] != now[2] and own.min() == own.max():
                return
            found, count = [], 0
            for x in near_in_block(np.array(node), np.array(n), root, own, bits, t, nearest):
                found.append(x)
                count += len(x[0])
                if count > 1 << 18:
                    yield pair_batch(*(np.concatenate(c) for c in zip(*found, strict=True)))
                    found, count = [], 0
            if count:
                yield pair_batch(*(np.concatenate(c) for c in zip(*found, strict=True)))

        for b in batches:
            for *key, own, node, root, n, bits in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                if key != now:
                    if held:
                        yield from pairs()
                    held, now = [], key
                held.append((node, root, own, n, bits))
        if held:
            yield from pairs()
        give_back()

    return difference_buckets(members, bitmaps, roots).mapInArrow(run, "a long, b long").distinct()


def similar_links(texts: DataFrame, pick: Callable[[DataFrame], DataFrame], sample: DataFrame, proposed: DataFrame, t: float = 0.8) -> DataFrame:
    """(a, b): pairs of similarity t or more that connect all that such pairs connect.

    texts: text, a row for each distinct shingle set (see set_id); pick gives (node, text) of a table of nodes; sample:
    nodes, a bounded number; proposed: (a, b), pairs to try first.
    """
    spark = texts.sparkSession
    sampled = spark.sparkContext.broadcast(common_shingles(pick(sample)))
    common = spark.sparkContext.broadcast(crowded(texts, t, sampled))
    sampled.unpersist()
    rows = stored(buckets(texts, t, common), "buckets")
    heads = stored(heads_of(rows), "heads")
    large = stored(heads.where(F.col("members") > SMALL), "large")
    ends = proposed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    tried = stored(head_pairs(rows, heads, t).unionByName(ends).distinct(), "pairs")
    nodes = stored(rows.select("node").unionByName(ends.select(F.explode(F.array("a", "b")).alias("node"))).distinct(), "nodes")
    known = known_sets(pick(nodes))
    tidy(spark)

    def cut(batches):
        for b in freeing(batches, 1):
            sets = [np.frombuffer(x, dtype=np.uint64) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in sets], pa.int32()), pa.array([bits_of(x).tobytes() for x in sets], pa.binary())], names=["node", "n", "bits"])

    bitmaps = stored(known.mapInArrow(cut, "node long, n int, bits binary"), "bitmaps")

    def decided(pairs: DataFrame) -> DataFrame:
        may = stored(plausible(pairs, bitmaps, t), "pairs")
        out = stored(verified(may, known, t), "links")
        forget(may)
        tidy(spark)
        return out

    links, spent = decided(tried), [rows, heads, large, tried, nodes, known, bitmaps]
    roots = connected_components(links)
    big = broadcast_if_small(large.select("key"))
    small_rows = rows.join(big, "key", "left_anti")
    mixed_keys = stored(unsettled(rows.join(big, "key", "left_semi"), roots), "unsettled")
    spent.append(mixed_keys)
    if mixed_keys.limit(1).count():
        asked = broadcast_if_small(mixed_keys)
        held = large.join(asked, "key", "left_semi")
        members = join_split(rows.join(asked, "key", "left_semi"), held.select("key", "h0"), "key", counts=sizes_of(held)).select(F.col("h0.node").alias("a"), "node")
        members = stored(members.distinct(), "members")
        again = stored(near_members(members, bitmaps, roots, t, True).join(tried, ["a", "b"], "left_anti"), "pairs")
        more = decided(again)
        links = made_of(links.unionByName(more), links, more)
        forget(roots)
        roots = connected_components(links)
        left = cross_pairs(small_rows, roots, t).unionByName(near_members(members, bitmaps, roots, t, False)).distinct()
        left = left.join(again, ["a", "b"], "left_anti")
        spent += [members, again]
    else:
        left = cross_pairs(small_rows, roots, t)
    rest = stored(left.join(tried, ["a", "b"], "left_anti"), "pairs")
    last = decided(rest)
    forget(roots, rest, *spent)  # links alone are read from here on
    common.unpersist()
    return made_of(links.unionByName(last), links, last)
