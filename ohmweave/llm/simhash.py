"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within the radius differ in few bits. The 64 bits are cut into equal parts; leaving one
part out (or all but one) leaves at most 2 differing bits in what is kept, and two values at distance 2
both reach a value half-way, at distance 1 from each. So every fingerprint emits, for each choice of kept
bits, the kept value and all its one-bit variants; equal variants meet in a shuffle, and colliding
fingerprints are verified by their true distance:

* radius 3: keep 48 of 64 bits, 4 choices, 4 * 49 = 196 variants (a ball of radius 2 in all 64 bits,
  which an odd radius needs otherwise, has 2,081);
* radius 4 or 5: keep 32 of 64 bits, 2 choices, 2 * 33 = 66 variants.

A bucket of many fingerprints isn't expanded into pairs: its task emits a spanning forest of the links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import bounded, broadcast_if_small, connected_components, forget, join_split, made_of, smaller_batches, stored, tidy

FULL = (1 << 64) - 1


def words_of(text: str | None) -> list[bytes]:
    """A-Z lowered, cut at the six ASCII white-space characters (bytes methods do exactly this)."""
    return (text or "").encode().lower().split()


def simhash(features: Iterator[bytes], seed: int = 42) -> int:
    """Bit i is 1 if set in over half the features' XXH64; 0 without features."""
    return majority(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), features), dtype="<u8"))


def majority(h: np.ndarray) -> int:
    """Bit i is 1 if set in over half of these 64-bit hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 15):
        bits = np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def shingles(words: list[bytes], width: int) -> Iterator[bytes]:
    """Every run of `width` words, repeats included; the whole sequence if there are fewer words."""
    if len(words) <= width:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))


def shingle_fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    return simhash(shingles(words_of(text), width), seed)


def fingerprints(docs: DataFrame, kinds: list[Callable[[str | None], int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp_0, fp_1, ...) as signed longs, one column for each function of `kinds`."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in bounded(batches, 1):
            texts = b.column(1).to_pylist()
            cols = [pa.array(np.array([f(t) for t in texts], dtype=np.uint64).view(np.int64)) for f in kinds]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", *(f"fp_{i}" for i in range(len(kinds)))])

    return source.mapInArrow(run, "doc_id long, " + ", ".join(f"fp_{i} long" for i in range(len(kinds))))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variant_masks(parts: int) -> list[tuple[int, int]]:
    """(bits kept, bits flipped) of each variant when one of `parts` parts is left out; its bits carry the part's number."""
    width, masks = 64 // parts, []
    for p in range(parts):
        left = ((1 << width) - 1) << (width * p)
        keep, tag = FULL & ~left, p << (width * p)
        masks += [(keep, tag)] + [(keep, tag | 1 << b) for b in range(64) if keep >> b & 1]
    return [(signed(k), signed(f)) for k, f in masks]


def near_to(x: np.ndarray, i: np.ndarray, j: np.ndarray, radii: tuple[int, ...]) -> np.ndarray:
    """Whether rows i and j of x (a column for each radius) are near in every column."""
    return np.logical_and.reduce([np.bitwise_count(x[i, c] ^ x[j, c]) <= r for c, r in enumerate(radii)])


def forest(x: np.ndarray, at: np.ndarray, radii: tuple[int, ...], group: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row pairs that span the components of rows `at` of x under near_to; rows of one group need no link.

    Works in blocks of bounded size.
    """
    found, left = [], at
    while len(left) > 1:
        mine = group[left] == group[left[0]]
        front, left = left[mine], left[~mine]
        while len(front) and len(left):
            parent = np.full(len(left), -1)
            for k in range(0, len(front), 128):
                hit = near_to(x, front[k : k + 128, None], left[None, :], radii)
                new = hit.any(axis=0) & (parent < 0)
                parent[new] = k + hit.argmax(axis=0)[new]
            got = np.flatnonzero(parent >= 0)
            if not len(got):
                break
            groups, first = np.unique(group[left[got]], return_index=True)  # a link for each group that is reached
            found.append((front[parent[got[first]]], left[got[first]]))
            mine = np.isin(group[left], groups)
            front, left = left[mine], left[~mine]
    return found


def bucket_links(keys: np.ndarray, x: np.ndarray, radii: tuple[int, ...], group: np.ndarray) -> np.ndarray:
    """Verified links (pairs of row numbers) inside the runs of equal keys."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    a = starts[sizes == 2]
    a = a[near_to(x, a, a + 1, radii) & (group[a] != group[a + 1])]
    found = [(a, a + 1)]
    for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
        found += forest(x, np.arange(s, s + n), radii, group)
    return np.stack([np.concatenate([f[i] for f in found]) for i in (0, 1)], axis=1)


def links_by_key(points: DataFrame, masks: list[tuple[int, int]], radii: tuple[int, ...]) -> DataFrame:
    """(a, b): links between near points that meet in a bucket of one of the masks.

    points: node, grp, fp and, with a second radius, check. Points of one grp are known to be connected.
    """
    values = ["fp", "check"][: len(radii)]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("keep"), F.lit(f).alias("flip")) for k, f in masks]))
    # dealt out before each row becomes one for each mask; by no key, since a join's partitions by node would be kept, few as they are
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = points.select("node", "grp", *values).where(F.col("fp").isNotNull()).repartition(tasks).select("node", "grp", *values, each.alias("m"))
    v = v.select(F.col("fp").bitwiseAND(F.col("m.keep")).bitwiseXOR(F.col("m.flip")).alias("key"), "node", "grp", *values)

    def run(batches):
        held = [np.empty(0, np.int64)] * (3 + len(values))

        def links(cols):
            x = np.stack(cols[3:], axis=1).view(np.uint64)
            pairs = cols[1][bucket_links(cols[0], x, radii, cols[2])]
            pairs = np.unique(np.sort(pairs, axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)], names=["a", "b"])

        for b in batches:
            held = [np.r_[h, c.to_numpy(zero_copy_only=False)] for h, c in zip(held, b.columns, strict=True)]
            if len(held[0]) < 1 << 17:
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last bucket may go on in the next batch
            if cut:
                yield links([h[:cut] for h in held])
                held = [h[cut:] for h in held]
        if len(held[0]):
            yield links(held)

    return v.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").where("a <> b").distinct()


def ball_links(points: DataFrame, radii: tuple[int, ...] = (3,), parts: int = 4) -> DataFrame:
    """(a, b): links between near points that connect all that is connected.

    points: node, fp and, with a second radius, check: nodes are linked if fp differs in radii[0] bits at
    most and check in radii[1] at most. fp (and check) should name a node: give one row for equal values.
    Points that agree in what is kept meet first, and their components are found; the variants then link only
    what that left apart, so that a large group of near copies isn't linked over again in every bucket.
    """
    if radii[0] > (3 if parts == 4 else 5):
        raise ValueError("what is kept must differ in 2 bits at most: radius 3 with 4 parts, 5 with 2")
    masks = variant_masks(parts)
    plain = masks[:: len(masks) // parts]  # no bit flipped
    first = stored(links_by_key(points.withColumn("grp", F.col("node")), plain, radii), "links")
    roots = connected_components(first)
    grouped = points.join(roots, "node", "left").withColumn("grp", F.coalesce("component", "node")).drop("component")
    rest = stored(links_by_key(grouped, masks, radii), "links")
    forget(roots)
    return made_of(rest.unionByName(first), rest, first)


def components_of(fps: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, component_id): least doc_id of the component of each fingerprint. fps: doc_id, fp."""
    roots = connected_components(links)
    per_fp = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    rooted = per_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root"))
    rooted = stored(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return join_split(rooted, least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs; links at 3 differing bits or fewer.

    A null or blank text has fingerprint zero and is linked like any other. Repeated rows get a row each.
    Rows with a null id keep their fingerprint; component_id is the least id that isn't null. An empty
    table gives an empty result. Other columns of docs are not looked at.
    """
    fps = stored(fingerprints(docs, [partial(shingle_fingerprint, width=width)], id_col, text_col).withColumnRenamed("fp_0", "fp"), "fingerprints")
    values = fps.select("fp").distinct()
    named = components_of(fps, ball_links(values.select(F.col("fp").alias("node"), "fp")))
    return join_split(fps, stored(named, "components"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """docs with one document left of each group of near copies: the row with the least id.

    Texts are linked if the Jaccard similarity of their five-word shingle sets is `similarity` or more, and by
    nothing else; groups are the components of these links. Ball hashing of the sets' fingerprints proposes pairs,
    a prefix filter adds every other pair that may be similar enough, whole sets decide (see jaccard).
    A document is an id and a text: rows of one id with different texts are judged each by its own text, and of rows
    alike in both one stays, the first by its JSON. In a group the least id stays, of two texts under it the one of
    lesser hash. Rows with a null id are kept: nothing names them. Null and blank texts are copies of each other.
    Extra columns are carried along. An empty table gives an empty result.
    """
    with smaller_batches(docs.sparkSession):  # all that runs in Python is stored before this returns
        return _left(docs, id_col, text_col, similarity)


def _left(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    named = docs.where(F.col(quoted(id_col)).isNotNull())
    rows = stored(jaccard.set_rows(named, quoted(id_col), quoted(text_col), majority), "rows")
    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    representatives = stored(rows.groupBy("node").agg(first, F.first("fp").alias("fp")), "representatives")
    heads = representatives.where("node <> 0")
    keyed = named.select(F.col(quoted(id_col)).alias("doc_id"), F.xxhash64(F.col(quoted(text_col)).cast("string")).alias("text_hash"), F.struct("*").alias("row"))
    each = keyed.select("doc_id", "text_hash", F.col(f"row.{quoted(text_col)}").cast("string").alias("text"))
    repeated = stored(rows.groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash"), "repeated")
    some = repeated.limit(1).count() > 0
    of_head = heads.select("node", "first.doc_id", "first.text_hash")
    # copies are few beside the rest: leaving them out moves no text
    spare = stored(rows.select("doc_id", "text_hash").distinct().join(of_head, ["doc_id", "text_hash"], "left_anti"), "spare")
    texts = each.join(broadcast_if_small(spare), ["doc_id", "text_hash"], "left_anti").select("text")

    def pick(nodes: DataFrame) -> DataFrame:
        found = each.join(broadcast_if_small(of_head.join(nodes, "node", "left_semi")), ["doc_id", "text_hash"]).select("node", "text")
        return found.dropDuplicates(["node"]) if some else found

    sample = heads.select("node").orderBy(F.xxhash64("node")).limit(2000)
    proposed = ball_links(heads.select("node", "fp"))
    tidy(docs.sparkSession)
    links = jaccard.similar_links(texts, pick, sample, proposed, similarity)
    roots = connected_components(links)
    rooted = stored(representatives.join(roots, "node", "left").select("node", "first", F.coalesce("component", "node").alias("root")), "rooted")
    stays = rooted.groupBy("root").agg(F.min("first").alias("stays"))
    of_node = stored(join_split(rooted, stays, "root").select("node", "stays"), "stays")
    gone = join_split(rows, of_node, "node").where("not (doc_id = stays.doc_id and text_hash = stays.text_hash)").select("doc_id", "text_hash").distinct()
    gone = stored(gone, "gone")
    forget(rows, representatives, spare, proposed, links, roots, rooted, of_node)  # what is returned reads gone and repeated
    left = keyed.join(broadcast_if_small(gone), ["doc_id", "text_hash"], "left_anti")
    if some:
        again = broadcast_if_small(repeated)
        firsts = left.join(again, ["doc_id", "text_hash"], "left_semi").groupBy("doc_id", "text_hash").agg(F.min_by("row", F.to_json("row")).alias("row"))
        left = left.join(again, ["doc_id", "text_hash"], "left_anti").unionByName(firsts)
    return left.select("row.*").unionByName(docs.where(F.col(quoted(id_col)).isNull()))


def quoted(name: str) -> str:
    """A column's name for expressions, dots and all."""
    return "`" + name.replace("`", "``") + "`"
