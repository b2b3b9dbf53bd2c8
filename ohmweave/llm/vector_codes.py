"""Vector code compression: product codes of integer vectors, the nearest entry found by a Walsh-Hadamard transform.

Parts and codebook entries are padded with zeros to a power of two W and transformed; the squared differences of the
transforms add up to W times the squared distance. Taken in sequency order, the first few coefficients hold most of a
smooth part, so that their sum alone puts most entries behind the best one so far: those are dropped before the rest
is looked at. Everything is integer arithmetic on 64 bits, so that codes are exact and the same everywhere.

Each round is one pass over the stored vectors: tasks assign their rows and add up parts by entry, Spark adds up the
tasks' sums, and the codebooks (ENTRIES entries of a vector's length, whatever the number of rows) go back to them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_split, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
ROWS = 512  # assigned at a time


def padded(width: int) -> int:
    """The power of two that a part's transform has."""
    return 1 << max(width - 1, 0).bit_length()


def largest(width: int) -> int:
    """Scaled components count as at most so large, either way: W times a part's squared distance then stays below 2^62."""
    return (1 << 30) // padded(width) - 1


@cache
def sequency_order(size: int) -> np.ndarray:
    """Rows of the Hadamard matrix of this size (a power of two) by their number of sign changes."""
    i = np.arange(size)
    ones = np.bitwise_count(i[:, None] & i[None, :]) & 1
    return np.argsort((ones[:, 1:] != ones[:, :-1]).sum(axis=1), kind="stable")


def transformed(parts: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, padded with zeros to a power of two, in sequency order; additions only."""
    size = padded(parts.shape[1])
    x = np.zeros((len(parts), size), dtype=np.int64)
    x[:, : parts.shape[1]] = parts
    step = 1
    while step < size:
        pairs = x.reshape(len(x), size // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), size)
        step *= 2
    return x[:, sequency_order(size)]


def nearest(parts: np.ndarray, book: np.ndarray, first: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of book for each row of parts; of several the least index.

    `first` coefficients are summed for all entries; what exceeds the whole sum of the best of them is dropped. While
    that leaves over an eighth of all, two more are summed for all; then the rest one by one for what is left, which is
    dropped as soon as it exceeds the bound.
    """
    x, e = transformed(parts), transformed(book)
    size, rows = x.shape[1], np.arange(len(x))
    sums, k = np.zeros((len(x), len(e)), dtype=np.int64), 0
    while k < size:
        for k in range(k, min(size, k + (2 if k else first))):
            d = np.subtract.outer(x[:, k], e[:, k])
            d *= d
            sums += d
        k += 1
        guess = sums.argmin(axis=1)
        rest = x[:, k:] - e[guess, k:]
        bound = sums[rows, guess] + (rest * rest).sum(axis=1)
        near = sums <= bound[:, None]
        if 8 * np.count_nonzero(near) <= near.size:
            break
    row, entry = np.nonzero(near)
    left = sums[row, entry]
    for k in range(k, size):
        d = x[row, k] - e[entry, k]
        left = left + d * d
        keep = left <= bound[row]
        row, entry, left = row[keep], entry[keep], left[keep]
    order = np.lexsort((entry, left, row))  # the best of each row comes first, and every row has one left
    at = order[np.searchsorted(row[order], rows)]
    return entry[at], left[at] // size


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, ints): floor(1024 x) of each vector that has components, all of them finite numbers."""
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    far = float(1 << 52)  # beyond what any width takes (see largest)
    ints = F.transform("x", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(far)), F.lit(-far))))
    whole = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), x.alias("x")).where((F.size("x") > 0) & ~bad)
    return whole.select("vec_id", "label", ints.alias("ints"))


def parts_of(x: np.ndarray, width: int) -> np.ndarray:
    """(row, part, position) of a matrix of rows, padded with zeros to PARTS times width."""
    most = largest(width)
    return np.pad(np.clip(x, -most, most), ((0, 0), (0, PARTS * width - x.shape[1]))).reshape(len(x), PARTS, width)


def rounds_up(length: int) -> int:
    return -(-length // PARTS)


def assigned(batches, books: np.ndarray, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their parts, indexes, squared distances), a block of rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            rows = batch.slice(at, ROWS)
            ints = rows.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            parts = parts_of(ints.reshape(rows.num_rows, -1), books.shape[2])
            found = [nearest(parts[:, p], books[p]) for p in range(PARTS)]
            yield rows, parts, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def part_sums(batches, books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(part, entry, n, sums): what a task's parts add up to, by the entry they are nearest to."""
    sums, counts = np.zeros(books.shape, dtype=np.int64), np.zeros(books.shape[:2], dtype=np.int64)
    for _, parts, index, _ in assigned(batches, books, 0):
        for p in range(len(books)):
            np.add.at(sums[p], index[:, p], parts[:, p])
            counts[p] += np.bincount(index[:, p], minlength=books.shape[1])
    part, entry = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])


def next_books(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: floor of the mean of each entry's parts; an entry without any stays."""
    told = kept.select("ints").mapInArrow(partial(part_sums, books=books), "part long, entry long, n long, sums array<long>")
    cells = told.select("part", "entry", "n", F.posexplode("sums").alias("at", "value"))
    whole = cells.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
    out = books.copy()
    for row in whole.collect():  # a codebook's components at most
        out[row.part, row.entry, row.at] = row.value // row.n
    return out


def digest_of(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector whose components are all finite numbers.

    A null or empty vector is left out, and so is one whose length isn't that of the first kept (least vec_id, then
    least components). Lengths that are no multiple of four are padded with zeros, which changes no distance. Components
    far from zero count as the last that 64 bits have room for (see largest; just under 65,536 in vectors of 64). Fewer than 256 vectors make codebooks of as many entries. Repeated rows
    are rows of their own, in the codebooks too. A null vec_id comes after all others and starts no codebook unless
    there are too few. Labels are compared as text, null equal to null. Extra columns are not looked at; an empty
    table, or one without such a vector, gives an empty result.
    """
    spark = vectors.sparkSession
    kept = stored(integer_vectors(vectors, id_col, vector_col, label_col), "vectors")
    order = [F.col("vec_id").asc_nulls_last(), "ints"]
    head = kept.orderBy(*order).limit(1).collect()
    schema = "vec_id long, code string, error long, label string"
    if not head:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    length = len(head[0].ints)
    kept = kept.where(F.size("ints") == length)
    width = rounds_up(length)
    starts = np.array([r.ints for r in kept.orderBy(*order).limit(ENTRIES).collect()], dtype=np.int64)
    books = np.ascontiguousarray(parts_of(starts, width).transpose(1, 0, 2))
    for _ in range(ROUNDS):
        books = next_books(kept, books)

    def coded(batches):
        for rows, _, index, distance in assigned(batches, books, 2):
            codes = ["".join(f"{i:02x}" for i in row) for row in index.tolist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(codes, pa.string()), pa.array(distance.sum(axis=1)), rows.column(1)], names=["vec_id", "code", "error", "label"])

    named = F.concat(F.when(F.col("label").isNull(), "n").otherwise("l"), F.coalesce("label", F.lit(""))).alias("label")
    codes = stored(kept.mapInArrow(coded, schema).select("vec_id", "code", "error", named), "codes")
    by_label = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    sha = unpadded(books, length)
    return join_split(codes, by_label, "label").select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def unpadded(books: np.ndarray, length: int) -> str:
    """The digest of the entries' own components, without those that padding added."""
    width = books.shape[2]
    if length == len(books) * width:
        return digest_of(books)
    own = [books[p, k, : max(0, min(width, length - p * width))].tolist() for p in range(len(books)) for k in range(books.shape[1])]
    return hashlib.sha256(",".join(str(x) for entry in own for x in entry).encode()).hexdigest()


def oracle_sql(rounds: int = ROUNDS) -> str:
    """DuckDB SQL of compress on `embeddings`: every distance in full, each round a step of the query."""
    near = """(select vec_id, part, arg_min(entry, {{'d': d, 'e': entry}}) entry, min(d) d from (select vec_id, v.part, entry, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) d
 from parts v join {book} b on b.part = v.part) group by vec_id, part)"""
    steps, book = [], "b0"
    for k in range(1, rounds + 1):
        steps.append(
            f"""a{k} as materialized {near.format(book=book)},
s{k} as (select part, entry, pos, sum(x)::bigint s, count(*) n from (select a.part, entry, unnest(range(len(x))) pos, unnest(x) x from a{k} a join parts p on p.vec_id = a.vec_id and p.part = a.part) group by all),
m{k} as (select part, entry, list(((s - ((s % n) + n) % n) // n)::bigint order by pos) x from s{k} group by all),
b{k} as materialized (select o.part, o.entry, coalesce(m.x, o.x) x from {book} o left join m{k} m on m.part = o.part and m.entry = o.entry)"""
        )
        book = f"b{k}"
    return f"""with kept as (select vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::double)::bigint) x from embeddings where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0 and len(embedding) > 0),
parts as materialized (select vec_id, p part, x[p * len(x) // 4 + 1:(p + 1) * len(x) // 4] x from (select *, unnest(range(4)) p from kept)),
seeds as (select vec_id, row_number() over (order by vec_id) - 1 entry from kept order by vec_id limit 256),
b0 as (select part, entry, x from parts join seeds using (vec_id)),
{", ".join(steps)},
f as materialized {near.format(book=book)},
c as (select vec_id, string_agg(printf('%02x', entry), '' order by part) code, sum(d)::bigint error from f group by vec_id),
h as (select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) codebooks_sha256 from {book})
select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, codebooks_sha256 from c join kept using (vec_id), h"""
