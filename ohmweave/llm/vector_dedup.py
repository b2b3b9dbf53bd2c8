"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosines, distributed components.

Equal vectors of one label become one node. A node has `tables` keys of `bits` signs each and a sketch of 128 further
signs. A pair at cosine 0.93 differs in a sign with probability 0.12, so that 10 bits agree with 0.28 and the pair
misses all of 40 tables with 2e-6; closer pairs with less. The sketch of such a pair differs in 15 bits on average; a
pair that differs in over SKETCH_BITS (six deviations more) isn't looked at, and two unlike vectors differ in 64.

1. In each bucket of a table every node is tried with one head, the bucket's least node: a large group of near copies is
   mostly linked by that, with one pair a node.
2. Buckets that still hold several components are searched in full, in blocks of BLOCK by BLOCK, by sketches; what has a
   close sketch in another component then meets by exact cosine, and only links that join components leave the task.
3. All links of a vector lie inside its component, so they are counted there, block by block, without a row for each.

No pair below the least cosine links: every link is decided by the cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, forget, join_split, stored

LEAST, BITS, TABLES, SEED = 0.93, 10, 40, 42
SKETCH_BITS = 37
BLOCK = 2_048


@cache
def planes(length: int, signs: int, seed: int) -> np.ndarray:
    """Normals of random hyperplanes, alike in every task."""
    return np.random.default_rng([seed, length]).standard_normal((length, signs))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; no row is zero. Scaled by the largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rows_of(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def by_length(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, their vectors) for each length that occurs."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, rows_of(column.take(pa.array(at)))


def signs(batches, bits: int, tables: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(node, grp, keys, s0, s1) of (node, grp, vector)."""
    for b in batches:
        keys, sketch = np.zeros((b.num_rows, tables), dtype=np.int64), np.zeros((b.num_rows, 2), dtype=np.int64)
        for at, x in by_length(b.column(2)):
            up = unit(x) @ planes(x.shape[1], tables * bits + 128, seed) >= 0
            keys[at] = up[:, : tables * bits].reshape(len(at), tables, bits) @ (1 << np.arange(bits))
            sketch[at] = np.packbits(up[:, tables * bits :], axis=1, bitorder="little").view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(keys), pa.list_(pa.int64())), pa.array(sketch[:, 0].copy()), pa.array(sketch[:, 1].copy())], names=["node", "grp", "keys", "s0", "s1"])


def same(batches, least: float) -> Iterator[pa.RecordBatch]:
    """(a, b) of (a, b, vector_a, vector_b) at the least cosine or above."""
    for batch in batches:
        x, y = batch.column(2), batch.column(3)
        fits = (x.value_lengths().to_numpy(zero_copy_only=False)) == (y.value_lengths().to_numpy(zero_copy_only=False))
        keep = np.zeros(batch.num_rows, dtype=bool)
        for at, mine in by_length(x):
            at, mine = at[fits[at]], mine[fits[at]]
            if len(at):
                keep[at] = (unit(mine) * unit(rows_of(y.take(pa.array(at))))).sum(axis=1) >= least
        yield batch.select([0, 1]).filter(pa.array(keep))


def in_blocks(rows: DataFrame, sizes: DataFrame, key: str, node: str, block: int) -> DataFrame:
    """rows with (i, j, left): cells of a group (key) in which all its members meet; left tells block i from j.

    sizes: (key, count). A group of up to `block` members is one cell; larger ones are cut by hash of the node, and each
    block meets each other one in a cell of its own, so that no task holds more than two blocks of a group. With
    (main, others) in sizes, a root and the number of members of other roots, members of that root don't meet each
    other in a group that is cut: a large component isn't paired with itself.
    """
    cut = join_split(rows, sizes, key, counts=sizes.select(key, "count"))
    apart = (F.col("root") == F.col("main")) & (F.col("count") > block) if "main" in sizes.columns else F.lit(False)
    plain = F.col("others") if "main" in sizes.columns else F.col("count")
    cut = cut.withColumn("_m", apart).withColumn("_g", F.greatest(F.ceil(F.when(F.col("count") > block, plain).otherwise(F.col("count")) / block), F.lit(1)).cast("int"))
    mains = F.ceil((F.col("count") - plain) / block) if "main" in sizes.columns else F.lit(0)
    cut = cut.withColumn("_n", F.when(F.col("count") > block, mains).otherwise(0).cast("int"))
    hashed = F.xxhash64(node, F.lit(7))
    cut = cut.withColumn("_b", F.when(F.col("_m"), F.col("_g") + F.pmod(hashed, F.col("_n"))).otherwise(F.pmod(hashed, F.col("_g"))).cast("int"))
    with_plain = F.sequence(F.lit(0), F.col("_g") - 1)
    dealt = cut.withColumn("_o", F.explode(F.when(F.col("_m"), with_plain).otherwise(F.sequence(F.lit(0), F.col("_g") + F.col("_n") - 1))))
    return dealt.select(*rows.columns, F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j"), (F.col("_b") <= F.col("_o")).alias("left"))


def cells(batches) -> Iterator[pa.Table]:
    """Whole runs of equal (key, i, j), the first three columns, one or several at a time."""
    held: list[pa.RecordBatch] = []

    def runs(table: pa.Table, last: bool):
        ids = np.stack([table.column(i).to_numpy() for i in range(3)], axis=1)
        starts = np.r_[0, np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1, len(ids)]
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            if last or e < len(ids):
                yield table.slice(s, e - s)
            else:
                held[:] = table.slice(s).combine_chunks().to_batches()

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        first, end = ([held[k].column(i)[at].as_py() for i in range(3)] for k, at in ((0, 0), (-1, held[-1].num_rows - 1)))
        if first != end:
            table, held[:] = pa.Table.from_batches(held), []
            yield from runs(table, False)
    if held:
        yield from runs(pa.Table.from_batches(held), True)


def sides(cell: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Row numbers of the two blocks that meet in a cell (key, i, j, left, ...), and whether they are the same block."""
    left = cell.column(3).to_numpy(zero_copy_only=False).astype(bool)
    if cell.column(1)[0] == cell.column(2)[0]:
        return np.arange(len(left)), np.arange(len(left)), True
    return np.flatnonzero(left), np.flatnonzero(~left), False


def flagged(batches) -> Iterator[pa.RecordBatch]:
    """(bucket, i, j, left, node, root) of those with a close sketch in another component. Columns: and s0, s1."""
    for cell in cells(batches):
        a, b, _ = sides(cell)
        root, s0, s1 = (cell.column(c).to_numpy() for c in (5, 6, 7))
        hit = np.zeros(len(root), dtype=bool)
        for k in range(0, len(a), 512):
            mine = a[k : k + 512]
            near = (np.bitwise_count(s0[mine, None] ^ s0[None, b]).astype(np.int16) + np.bitwise_count(s1[mine, None] ^ s1[None, b]) <= SKETCH_BITS) & (root[mine, None] != root[None, b])
            hit[mine] |= near.any(axis=1)
            hit[b] |= near.any(axis=0)
        if hit.any():
            yield cell.select(range(6)).filter(pa.array(hit)).combine_chunks().to_batches()[0]


def joining(batches, least: float) -> Iterator[pa.RecordBatch]:
    """(a, b): links between components of one group, as many as join what they join. Columns: bucket, i, j, left, node, root, grp, vector."""
    for cell in cells(batches):
        a, b, _ = sides(cell)
        node, root, grp = (cell.column(c).to_numpy() for c in (4, 5, 6))
        x = cell.column(7).combine_chunks()
        sizes = x.value_lengths().to_numpy(zero_copy_only=False)
        up: dict[int, int] = {}

        def top(v: int, up=up) -> int:
            while up.get(v, v) != v:
                v = up[v]
            return v

        found = []
        for n in np.unique(sizes):
            ours, theirs = a[sizes[a] == n], b[sizes[b] == n]
            if not len(ours) or not len(theirs):
                continue
            y = unit(rows_of(x.take(pa.array(theirs))))
            for k in range(0, len(ours), 512):
                mine = ours[k : k + 512]
                near = (unit(rows_of(x.take(pa.array(mine)))) @ y.T >= least) & (root[mine, None] != root[None, theirs]) & (grp[mine, None] == grp[None, theirs])
                p, q = np.nonzero(near)
                for f, g in zip(mine[p].tolist(), theirs[q].tolist(), strict=True):
                    one, other = top(root[f]), top(root[g])
                    if one != other:
                        up[one] = other
                        found.append((node[f], node[g]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def counted(batches, least: float) -> Iterator[pa.RecordBatch]:
    """(node, links): weights of the linked nodes of a cell. Columns: component, i, j, left, node, weight, vector (all of one length)."""
    for cell in cells(batches):
        a, b, alone = sides(cell)
        node, weight = (cell.column(c).to_numpy() for c in (4, 5))
        x = unit(rows_of(cell.column(6).combine_chunks()))
        links = np.zeros(len(node), dtype=np.int64)
        for k in range(0, len(a), 512):
            mine = a[k : k + 512]
            near = x[mine] @ x[b].T >= least
            if alone:
                near[np.arange(len(mine)), k + np.arange(len(mine))] = False
            links[mine] += near @ weight[b]
            if not alone:
                links[b] += weight[mine] @ near
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links)], names=["node", "links"])


def in_cells(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return rows.select(key, "i", "j", "left", *columns).repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def usable(vector: Column, label: Column) -> Column:
    whole = ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(vector, lambda c: c != 0)
    return F.coalesce(label.isNotNull() & whole, F.lit(False))


def verified(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of one group at the least cosine or above."""
    pairs = stored(pairs, "pairs")
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("grp").alias(f"grp_{c}"), F.col("vector").alias(f"v_{c}"))
    first = stored(join_split(pairs, side("a"), "a"), "pairs")
    met = join_split(first, side("b"), "b").where("grp_a = grp_b").select("a", "b", "v_a", "v_b")
    out = stored(met.mapInArrow(partial(same, least=least), "a long, b long"), "links")
    forget(pairs, first)
    return out


def links_of(nodes: DataFrame, least: float, bits: int, tables: int, seed: int, block: int) -> DataFrame:
    """(a, b): links that connect what links connect. nodes: node, grp, vector; nodes of one grp alone are compared."""
    signed = stored(nodes.select("node", "grp", "vector").mapInArrow(partial(signs, bits=bits, tables=tables, seed=seed), "node long, grp long, keys array<long>, s0 long, s1 long"), "signs")
    in_buckets = lambda df, *more: df.select("node", "grp", *more, "s0", "s1", F.posexplode("keys").alias("t", "k")).select(F.xxhash64("grp", "t", "k").alias("bucket"), "node", *more, "s0", "s1")
    rows = stored(in_buckets(signed), "buckets")
    head = F.min(F.struct("node", "s0", "s1")).alias("h")
    heads = stored(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("count"), head).where("count > 1"), "heads")
    apart = F.bit_count(F.col("s0").bitwiseXOR(F.col("h.s0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("h.s1")))
    tried = join_split(rows, heads, "bucket", counts=heads.select("bucket", "count")).where((F.col("node") != F.col("h.node")) & (apart <= SKETCH_BITS))
    links = verified(tried.select(F.col("h.node").alias("a"), F.col("node").alias("b")).distinct(), nodes, least)
    forget(rows, heads)
    roots = connected_components(links)
    rooted = stored(signed.join(roots, "node", "left").withColumn("root", F.coalesce("component", "node")), "rooted")
    rows = stored(in_buckets(rooted, "root"), "buckets")
    by_root = rows.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = by_root.groupBy("bucket").agg(F.sum("n").alias("count"), F.max("n").alias("most"), F.max_by("root", "n").alias("main")).where("most < count")
    mixed = stored(mixed.select("bucket", "count", "main", (F.col("count") - F.col("most")).alias("others")), "mixed")
    close = stored(in_cells(in_blocks(rows, mixed, "bucket", "node", block), "bucket", ["node", "root", "s0", "s1"]).mapInArrow(flagged, "bucket long, i int, j int, left boolean, node long, root long"), "close")
    met = join_split(close, nodes.select("node", "grp", "vector"), "node")
    more = stored(in_cells(met, "bucket", ["node", "root", "grp", "vector"]).mapInArrow(partial(joining, least=least), "a long, b long").distinct(), "links")
    forget(signed, rooted, rows, mixed, close)
    return links.unionByName(more)


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST, bits: int = BITS, tables: int = TABLES, seed: int = SEED, block: int = BLOCK
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors.

    Rows of one label, null in none, link at cosine `least` or above. A vector that is null, empty, all zeros or holds a
    null or non-finite component links with nothing; neither do vectors of different lengths. Repeated rows are vectors
    of their own and link with each other. A row with a null vec_id links like any other, gives no component its id and
    isn't kept. An empty table gives an empty result. Extra columns are not looked at.
    """
    x, label = F.col(vector_col).cast("array<double>"), F.col(label_col).cast("string")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), x.alias("x")).withColumn("ok", usable(F.col("x"), F.col("label")))
    name = F.unhex(F.sha2(F.concat(F.length("label").cast("string"), F.lit(":"), F.col("label"), F.array_join(F.col("x").cast("array<string>"), ",")), 256))
    rows = stored(rows.select("vec_id", F.when(F.col("ok"), name).alias("key"), F.when(F.col("ok"), F.col("label")).alias("label"), F.when(F.col("ok"), F.col("x")).alias("vector")), "vectors")
    # of equal vectors one stays; its number is a hash of a running one, which no two share
    classes = rows.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first_id"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    nodes = stored(classes.select(F.xxhash64(F.monotonically_increasing_id()).alias("node"), F.xxhash64("label", F.size("vector")).alias("grp"), "key", "weight", "first_id", "vector"), "nodes")
    roots = stored(connected_components(links_of(nodes, least, bits, tables, seed, block)), "roots")
    members = stored(roots.join(nodes, "node"), "members")
    sizes = stored(members.groupBy("component").count(), "sizes")
    told = in_cells(in_blocks(members, sizes, "component", "node", block), "component", ["node", "weight", "vector"]).mapInArrow(partial(counted, least=least), "node long, links long")
    links = stored(told.groupBy("node").agg(F.sum("links").alias("links")), "counts")
    ids = members.groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = join_split(members.select("node", "key", "weight", "component"), ids, "component", counts=sizes).join(links, "node")
    alone = nodes.join(roots, "node", "left_anti").select("key", (F.col("weight") - 1).alias("n_links"), F.col("first_id").alias("component_id"))
    named = stored(linked.select("key", (F.col("weight") - 1 + F.col("links")).alias("n_links"), "component_id").unionByName(alone), "components")
    out = join_split(rows.select("vec_id", "key"), named, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


ORACLE_SQL = f"""with recursive v as (select vec_id, label, list_transform(embedding, lambda c: c::double) x from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0),
u as (select vec_id, label, x, sqrt(list_dot_product(x, x)) n from v),
e as materialized (select a.vec_id a, b.vec_id b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.x) = len(b.x) where list_dot_product(a.x, b.x) / (a.n * b.n) >= {LEAST}),
c(node, root) as (select vec_id, vec_id from embeddings union select e.b, c.root from c join e on e.a = c.node),
r as (select node, min(root) root from c group by node), k as (select a, count(*) n from e group by a)
select vec_id, coalesce(k.n, 0) n_links, r.root component_id, vec_id = r.root kept from embeddings join r on r.node = vec_id left join k on k.a = vec_id"""
