"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

An item is contained in a document if at least `threshold` of the item's distinct word shingles occur there.
Items are partitioned by size (powers of two of their shingle count). An item's sketch is its least shingles under
one order of all shingles: those that few items share first, by hash among equals (a min-wise sketch of what is rare).
It has k = 3 * floor((1 - threshold) * u) + 1 of them for the largest size u of its partition. A document that contains
the item lacks n - ceil(threshold * n) shingles at most, so it shares at least k less that number: the search demands
so many, at least two thirds of the sketch, and misses nothing; an opening that many items share makes no candidates.
(Signatures of a fixed length for whole documents, banded for the Jaccard similarity that a partition's sizes allow,
can't do this: a 30-shingle item inside 20,000 shingles has a similarity of 0.0015.) A document's side of the
search is every shingle hash, so its length doesn't matter; items that are too large for a document are not
searched. Candidates are verified by counting the shared shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, join_split, stored

WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def shingle_texts(w: Column, width: Column) -> Column:
    """The distinct shingles of an array of words; none if it has fewer words than a shingle."""
    grams = F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.concat_ws(" ", F.slice(w, i, width)))
    return F.when(F.size(w) >= width, F.array_distinct(grams)).otherwise(F.expr("cast(array() as array<string>)"))


def gram_hash(h: Column, at: Column, width: int) -> Column:
    """Hash of the `width` word hashes from index `at` (from 0) on."""
    return F.xxhash64(*[F.get(h, at + k) for k in range(width)])


def item_shingles(items: DataFrame, width: int, item_col: str, text_col: str) -> DataFrame:
    """(item_id, width, shingle, hash, n_item). An item of fewer words is one shingle of all its words; one without words has none.

    Rows of one item_id make one item.
    """
    w = items.select(F.col(item_col).cast("long").alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("width", F.least(F.size("w"), F.lit(width)))
    s = w.select("item_id", "width", F.explode(shingle_texts(F.col("w"), F.col("width"))).alias("shingle")).distinct()
    h = F.transform(F.split("shingle", " "), lambda x: F.xxhash64(x))
    by_width = F.coalesce(*[F.when(F.col("width") == k, gram_hash(F.col("h"), F.lit(0), k)) for k in range(1, width + 1)])
    s = s.withColumn("h", h).withColumn("hash", by_width).drop("h")
    return s.withColumn("n_item", F.count(F.lit(1)).over(Window.partitionBy("item_id")).cast("int"))


def sketches(grams: DataFrame, threshold: float) -> DataFrame:
    """(item_id, hash, width, need, hits): the sketch of each item, the shingles a document needs and those of the sketch among them."""
    need = F.ceil(F.col("n_item") * threshold - 1e-9).cast("int")
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n_item"))))
    k = F.least("n_item", (3 * F.floor(upper * (1 - threshold) + 1e-9) + 1).cast("int"))
    shared = grams.groupBy("hash").agg(F.countDistinct("item_id").alias("items"))
    order = Window.partitionBy("item_id").orderBy("items", "hash", "shingle")
    ranked = join_split(grams, shared, "hash").withColumn("k", k).withColumn("nth", F.row_number().over(order)).where("nth <= k")
    return ranked.select("item_id", "hash", "width", need.alias("need"), (F.col("k") - F.col("n_item") + need).alias("hits"))


def candidate_pairs(docs: DataFrame, grams: DataFrame, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id) of documents that hold as much of an item's sketch as any that contains it must."""
    sketch = broadcast_if_small(sketches(grams, threshold))
    widths = sorted(r[0] for r in grams.select("width").distinct().collect())  # as many as a shingle has words, at most
    hashed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.transform(words(F.col(text_col)), lambda x: F.xxhash64(x)).alias("h"))
    found = None
    for n in widths:
        at = hashed.withColumn("n", F.size("h") - n + 1).where("n >= 1").select("doc_id", "h", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
        keys = at.select("doc_id", F.size("h").alias("n"), gram_hash(F.col("h"), F.col("i"), n).alias("hash"))
        hits = keys.join(sketch.where(F.col("width") == n), "hash").where(F.col("n") * len(widths) >= F.col("need")).select("doc_id", "item_id", "hash", "hits")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long")
    return found.groupBy("doc_id", "item_id", "hits").agg(F.countDistinct("hash").alias("n")).where("n >= hits").select("doc_id", "item_id")


def contained_items(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) for every document that contains an item.

    Words are runs of letters and digits, lower-cased. A null or empty text contains nothing; an item without
    words is contained nowhere; one with fewer words than a shingle is looked for whole. Repeated rows give one
    result row for a pair of ids (the larger containment if one id has several texts); null ids are ids of
    their own. Empty tables give an empty result. Other columns are not looked at.
    """
    grams = stored(item_shingles(items, width, item_col, text_col), "item-shingles")
    candidates = stored(candidate_pairs(docs, grams, threshold, id_col, text_col), "candidates")
    ids = broadcast_if_small(candidates.select(F.col("doc_id").alias("__doc")).distinct())
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(ids, texts.doc_id.eqNullSafe(ids["__doc"]), "left_semi").distinct().select("doc_id", words(F.col("text")).alias("w"))
    whole = grams.groupBy("item_id", "width", "n_item").agg(F.collect_list("shingle").alias("shingles"))
    whole = broadcast_if_small(whole, 20_000, F.length(F.array_join("shingles", " ")))
    pairs = candidates.alias("c").join(whole.alias("i"), F.expr("c.item_id <=> i.item_id")).select("c.doc_id", "c.item_id", "width", "n_item", "shingles")
    both = texts.alias("t").join(pairs.alias("p"), F.expr("t.doc_id <=> p.doc_id")).select("p.*", "w")
    shared = F.size(F.array_intersect(shingle_texts(F.col("w"), F.col("width")), F.col("shingles")))
    # an item_id whose rows differ in width has a row for each width here
    out = both.select("doc_id", "item_id", "n_item", "width", shared.alias("n"))
    out = out.groupBy("doc_id", "item_id", "n_item", "width").agg(F.max("n").alias("n")).groupBy("doc_id", "item_id", "n_item").agg(F.sum("n").cast("int").alias("n_shared"))
    return out.where(F.col("n_shared") >= F.col("n_item") * threshold - 1e-9).withColumn("containment", F.round(F.col("n_shared") / F.col("n_item"), 6))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without those that contain an item; a row with a null id goes if any such row does."""
    bad = broadcast_if_small(stored(contained_items(docs, items, id_col=id_col).select(F.col("doc_id").alias("__bad")).distinct(), "contaminated"))
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__bad"]), "left_anti")


ORACLE_SQL = r"""
with d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') w from documents),
i as (select item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') w from benchmark),
iw as (select *, least(len(w), 5) width from i where len(w) > 0),
its as (select distinct item_id, width, array_to_string(w[k:k + width - 1], ' ') s from (select item_id, width, w, unnest(range(1, len(w) - width + 2)) k from iw)),
ds as (select distinct doc_id, width, array_to_string(w[k:k + width - 1], ' ') s from (select doc_id, width, w, unnest(range(1, len(w) - width + 2)) k from d, (select distinct width from its))),
q as (select item_id, count(*) n from its group by item_id),
m as (select doc_id, item_id, count(*) c from ds join its using (width, s) group by doc_id, item_id)
select doc_id, m.item_id, n::int n_item, c::int n_shared, round(c / n, 6) containment from m join q on m.item_id is not distinct from q.item_id where c >= 0.8 * n - 1e-9"""
