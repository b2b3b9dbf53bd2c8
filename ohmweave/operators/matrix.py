"""Sparse matrices as (row, col, value) tables; `by` names columns that tell several matrices apart."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import broadcast_if_small, forget, stored
from . import ranks

#: Entries of a row that one value holds.
BLOCK = 4_096
#: For products taken again and again: bits of a place in a part of a vector, entries of a matrix that one value holds, and entries that share a copy of such a part.
PLACE, CHUNK, STRIP = 18, 1 << 16, 1 << 20
Keys = Sequence[str]


def summed(entries: DataFrame, by: Keys = ()) -> DataFrame:
    """Repeated (row, col) add up."""
    return entries.groupBy(*by, "row", "col").agg(F.sum("value").alias("value"))


def checked(entries: DataFrame, rows: int, cols: int) -> DataFrame:
    """The entries; an index out of bounds fails the job."""
    inside = F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)
    return entries.withColumn("value", F.when(inside, F.col("value")).otherwise(F.raise_error(F.lit("matrix index out of bounds")).cast("double")))


def with_diagonal(entries: DataFrame, by: Keys = ()) -> DataFrame:
    """Every row has a diagonal entry, zero where there was none."""
    zeros = entries.select(*by, F.col("row"), F.col("row").alias("col"), F.lit(0.0).alias("value")).distinct()
    return summed(entries.select(*by, "row", "col", "value").unionByName(zeros), by)


def rows_of(entries: DataFrame, by: Keys = (), block: int = BLOCK, most: int = ranks.MOST) -> DataFrame:
    """(row, block, at, entries): rows as blocks of up to `block` (col, value), from 0; `at` is the place of a block's first entry.

    A row's diagonal comes first, the others by column. No value holds more than a block, however long the row; the places of
    a row of over `most` entries are found range by range.
    """
    cells = with_diagonal(entries, by).withColumn("_off", F.col("row") != F.col("col"))
    placed = ranks.ranked(cells, [*by, "row"], ["_off", "col"], "_place", most).withColumn("block", F.floor((F.col("_place") - 1) / block))
    packed = placed.groupBy(*by, "row", "block").agg(F.array_sort(F.collect_list(F.struct("_place", "col", "value"))).alias("cells"))
    return packed.select(*by, "row", "block", (F.col("block") * block).alias("at"), F.transform("cells", lambda c: F.struct(c["col"].alias("col"), c["value"].alias("value"))).alias("entries"))


def entries_of(blocks: DataFrame, by: Keys = ()) -> DataFrame:
    """(row, col, value) of rows_of's blocks."""
    return blocks.select(*by, "row", F.inline("entries"))


def times_blocks(blocks: DataFrame, x: DataFrame, by: Keys = ()) -> DataFrame:
    """Matrix times vector as in times, of a matrix in blocks: a hub's blocks are worked on by as many tasks, and their sums add up."""
    return times(entries_of(blocks, by), x, by)


def row_offsets(blocks: DataFrame, by: Keys = ()) -> DataFrame:
    """(row, at, n): the place of each row's first entry among all of the matrix, rows in order, and its number of entries."""
    sizes = blocks.groupBy(*by, "row").agg(F.sum(F.size("entries")).alias("n"))
    return ranks.running(sizes, by, ["row"], "n", "at")


def entry(entries: DataFrame, row: int, col: int) -> DataFrame:
    """One row with the value at (row, col); a missing entry fails the job."""
    found = entries.where((F.col("row") == row) & (F.col("col") == col)).agg(F.sum("value").alias("value"))
    return found.select(F.when(F.col("value").isNull(), F.raise_error(F.lit(f"no entry at ({row}, {col})")).cast("double")).otherwise(F.col("value")).alias("value"))


def entries_at(entries: DataFrame, wanted: DataFrame, by: Keys = ()) -> DataFrame:
    """wanted (by, row, col and whatever else) with its value; a missing entry fails the job."""
    got = wanted.join(summed(entries, by), [*by, "row", "col"], "left")
    missing = F.raise_error(F.format_string("no entry at (%s, %s)", F.col("row").cast("string"), F.col("col").cast("string"))).cast("double")
    return got.withColumn("value", F.when(F.col("value").isNull(), missing).otherwise(F.col("value")))


def off_diagonals(entries: DataFrame, by: Keys = ()) -> DataFrame:
    """The summed entries off the diagonal; rows stay whole, so a row's are one group of (by, row)."""
    return summed(entries, by).where("row <> col")


def diagonal(entries: DataFrame, by: Keys = ()) -> DataFrame:
    return entries.where("row = col").select(*by, "row", "value")


def row_sum_split(entries: DataFrame, by: Keys = ()) -> tuple[DataFrame, DataFrame]:
    """(D, L): D the row sums, L the matrix less D on its diagonal, so that L's rows add up to nothing."""
    d = entries.groupBy(*by, "row").agg(F.sum("value").alias("value"))
    shift = d.select(*by, "row", F.col("row").alias("col"), (-F.col("value")).alias("value"))
    return d, summed(entries.select(*by, "row", "col", "value").unionByName(shift), by)


def times(entries: DataFrame, x: DataFrame, by: Keys = ()) -> DataFrame:
    """Matrix times vector: x has (idx, value); the result (idx, value) for every row that meets x."""
    v = x.select(*by, F.col("idx").alias("col"), F.col("value").alias("x"))
    return entries.join(v, [*by, "col"]).groupBy(*by, F.col("row").alias("idx")).agg(F.sum(F.col("value") * F.col("x")).alias("value"))


def added(a: DataFrame, b: DataFrame, scale_a: float | Column = 1.0, scale_b: float | Column = 1.0, by: Keys = ()) -> DataFrame:
    scaled = [m.select(*by, "row", "col", (F.col("value") * s).alias("value")) for m, s in ((a, scale_a), (b, scale_b))]
    return summed(scaled[0].unionByName(scaled[1]), by)


def axpy(a: float | Column, x: DataFrame, y: DataFrame, by: Keys = ()) -> DataFrame:
    """a x + y over the indexes of either."""
    both = x.select(*by, "idx", (F.col("value") * a).alias("value")).unionByName(y.select(*by, "idx", "value"))
    return both.groupBy(*by, "idx").agg(F.sum("value").alias("value"))


def norm(x: DataFrame, by: Keys = ()) -> DataFrame:
    return x.groupBy(*by).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))


def residual(entries: DataFrame, x: DataFrame, b: DataFrame, by: Keys = ()) -> DataFrame:
    """|Gx - b| relative to |b|, or as it is where |b| is next to nothing."""
    gap = norm(axpy(-1.0, b, times(entries, x, by), by), by).withColumnRenamed("norm", "gap")
    size = norm(b, by)
    both = gap.join(size, list(by)) if by else gap.crossJoin(size)  # one row each
    return both.select(*by, F.when(F.col("norm") > 1e-15, F.col("gap") / F.col("norm")).otherwise(F.col("gap")).alias("residual"))


def packed_vectors(nodes: DataFrame, by: Keys, x0: DataFrame, b: DataFrame | None) -> DataFrame:
    """(part, term, state, b): x0 as term and state, and b, as doubles in the order of the places of each part; an empty b is zero. nodes: ranks.in_ranges."""
    one = lambda v, c: v.groupBy(*by, "idx").agg(F.sum(F.col("value").cast("double")).alias(c))
    full = ranks.met_by(nodes, one(x0, "x"), [*by, "idx"], "left")
    full = full.withColumn("b", F.lit(None).cast("double")) if b is None else ranks.met_by(full, one(b, "b"), [*by, "idx"], "left")
    cells = full.select(F.shiftright("_at", PLACE).alias("part"), "_at", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("b", F.lit(0.0)).alias("b"))

    def run(batches):
        now, held = None, []

        def row():
            x, y = (np.concatenate(c).tobytes() for c in zip(*held, strict=True))
            return pa.RecordBatch.from_pylist([{"part": now, "term": x, "state": x, "b": b"" if b_none else y}], schema=pa.schema([("part", pa.int64()), ("term", pa.binary()), ("state", pa.binary()), ("b", pa.binary())]))

        for batch in batches:
            part, _, x, y = (c.to_numpy() for c in batch.columns)
            cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
            for s, e in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(part)].tolist(), strict=True):
                if s == e:
                    continue
                if part[s] != now and held:
                    yield row()
                    held = []
                now = int(part[s])
                held.append((x[s:e], y[s:e]))
        if held:
            yield row()

    b_none = b is None
    return stored(cells.repartition("part").sortWithinPartitions("part", "_at").mapInArrow(run, "part long, term binary, state binary, b binary"), "vectors")


def packed_entries(placed: DataFrame) -> DataFrame:
    """(part, strip, of, rows, cols, values): entries (row, col, value) between places, packed by the column's part and the row's part (of).

    A part with more than STRIP entries is cut into strips by row, so that a hub's column is no single piece of work.
    """
    cells = placed.select(F.shiftright("col", PLACE).alias("part"), F.shiftright("row", PLACE).alias("of"), "row", "col", "value")
    counts = cells.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / STRIP).alias("strips"))
    cells = cells.join(broadcast_if_small(counts), "part").withColumn("strip", F.pmod(F.xxhash64("row"), F.col("strips")))
    low = (1 << PLACE) - 1
    kinds = pa.schema([("part", pa.int64()), ("strip", pa.int64()), ("of", pa.int64()), ("rows", pa.binary()), ("cols", pa.binary()), ("values", pa.binary())])

    def run(batches):
        now, held, count = None, [], 0

        def row():
            r, c, v = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_pylist([dict(zip(kinds.names, (*now, (r & low).astype(np.int32).tobytes(), (c & low).astype(np.int32).tobytes(), v.tobytes()), strict=True))], schema=kinds)

        for batch in batches:
            part, strip, of, r, c, v = (x.to_numpy() for x in batch.columns)
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (strip[1:] != strip[:-1]) | (of[1:] != of[:-1])) + 1
            for s, e in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(part)].tolist(), strict=True):
                if s == e:
                    continue
                key = int(part[s]), int(strip[s]), int(of[s])
                if held and (key != now or count > CHUNK):
                    yield row()
                    held, count = [], 0
                now = key
                held.append((r[s:e], c[s:e], v[s:e]))
                count += e - s
        if held:
            yield row()

    dealt = cells.select("part", "strip", "of", "row", "col", "value").repartition("part", "strip").sortWithinPartitions("part", "strip", "of", "row")
    return stored(dealt.mapInArrow(run, "part long, strip long, of long, rows binary, cols binary, values binary"), "packed")


def next_term(packed: DataFrame, strips: DataFrame, vectors: DataFrame, scale: float, first: bool) -> DataFrame:
    """vectors after a term of the series: term is scale times the matrix times the last term (state, plus b, at first), and is added to state.

    The matrix moves as it is packed, a part of the vector once a strip; what a strip sums up for a part of the rows is one value.
    """
    x = vectors.select("part", F.col("state" if first else "term").alias("values")).join(strips, "part")
    none = F.lit(None).cast("binary")
    both = x.select("part", "strip", F.lit(-1).cast("long").alias("of"), none.alias("rows"), none.alias("cols"), "values").unionByName(packed)

    def products(batches):
        x = np.empty(0)
        for batch in batches:
            out = []
            for i, of in enumerate(batch.column(2).to_pylist()):
                v = np.frombuffer(batch.column(5)[i].as_buffer(), np.float64)
                if of < 0:
                    x = v.copy()
                    continue
                r, c = (np.frombuffer(batch.column(k)[i].as_buffer(), np.int32) for k in (3, 4))
                start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])  # in order of rows
                out.append((of, r[start].tobytes(), np.add.reduceat(v * x[c], start).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["part", "rows", "sums"])

    sums = both.repartition("part", "strip").sortWithinPartitions("part", "strip", "of").mapInArrow(products, "part long, rows binary, sums binary")
    old = vectors.select("part", F.lit(0).alias("kind"), F.col("b").alias("rows"), F.col("state").alias("sums"))
    met = old.unionByName(sums.select("part", F.lit(1).alias("kind"), "rows", "sums"))
    kinds = pa.schema([("part", pa.int64()), ("term", pa.binary()), ("state", pa.binary()), ("b", pa.binary()), ("most_term", pa.float64()), ("most_state", pa.float64())])

    def gather(batches):
        now, y, state, b = None, None, None, b""

        def row():
            term = y * scale
            total = state + term
            return pa.RecordBatch.from_pylist([dict(zip(kinds.names, (now, term.tobytes(), total.tobytes(), b, float(np.abs(term).max()), float(np.abs(total).max())), strict=True))], schema=kinds)

        for batch in batches:
            for i, (part, kind) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                values = np.frombuffer(batch.column(3)[i].as_buffer(), np.float64)
                if kind == 0:
                    if now is not None:
                        yield row()
                    now, state, b = part, values.copy(), batch.column(2)[i].as_py()
                    y = np.frombuffer(b, np.float64).copy() if first and b else np.zeros(len(state))
                else:
                    y[np.frombuffer(batch.column(2)[i].as_buffer(), np.int32)] += values
        if now is not None:
            yield row()

    dealt = met.repartition("part").sortWithinPartitions("part", "kind")
    return stored(dealt.mapInArrow(gather, "part long, term binary, state binary, b binary, most_term double, most_state double"), "vectors")


def unpacked(vectors: DataFrame, nodes: DataFrame, by: Keys) -> DataFrame:
    """(by, idx, value) of the states."""

    def run(batches):
        for batch in batches:
            for i, part in enumerate(batch.column(0).to_pylist()):
                v = np.frombuffer(batch.column(1)[i].as_buffer(), np.float64)
                for s in range(0, len(v), CHUNK):
                    w = v[s : s + CHUNK]
                    yield pa.RecordBatch.from_arrays([pa.array((part << PLACE) + s + np.arange(len(w))), pa.array(w)], names=["_at", "value"])

    return nodes.join(vectors.select("part", "state").mapInArrow(run, "_at long, value double"), "_at").select(*by, "idx", "value")


def ode_solution(entries: DataFrame, x0: DataFrame, b: DataFrame | None = None, time: float = 1.0, by: Keys = (), most: float = 1e-12, max_terms: int = 60) -> DataFrame:
    """(idx, value): x(time) of x' = A x + b, which is exp(A time) x0 plus what b adds, for many systems at once.

    The exponential isn't formed, nor A inverted: time is cut into steps in which A's largest row sum is 1 at most, and a step is its
    Taylor series, a matrix-vector product a term, each term written before the next; a step ends when no component of a term
    exceeds `most` times the largest of the sum. x0 and b: (idx, value), an index that is missing is 0; every row of A and every index
    of x0 and b has its value. Indexes are numbered and entries packed between numbers once, so that a term joins no keys.
    """
    cells = entries.where(F.col("value").isNotNull()).select(*by, "row", "col", F.col("value").cast("double").alias("value"))
    own = [x0.select(*by, "idx"), cells.select(*by, F.col("row").alias("idx"))] + ([] if b is None else [b.select(*by, "idx")])
    nodes = own[0]
    for more in own[1:]:
        nodes = nodes.unionByName(more)
    nodes = ranks.in_ranges(nodes.distinct(), by, ["idx"])
    placed = ranks.met_by(cells, nodes.select(*by, F.col("idx").alias("row"), F.col("_at").alias("_row")), [*by, "row"])
    placed = placed.join(nodes.select(*by, F.col("idx").alias("col"), F.col("_at").alias("_col")), [*by, "col"])
    placed = stored(placed.select(F.col("_row").alias("row"), F.col("_col").alias("col"), "value"), "placed")
    norm = placed.groupBy("row").agg(F.sum(F.abs("value")).alias("s")).agg(F.max("s")).first()[0] or 0.0
    packed = packed_entries(placed)
    forget(placed)
    strips = broadcast_if_small(packed.select("part", "strip").distinct())
    steps = max(1, math.ceil(norm * abs(time) - 1e-9))
    h = time / steps
    x = packed_vectors(nodes, by, x0, b)
    for _ in range(steps):
        for k in range(1, max_terms + 1):
            last, x = x, next_term(packed, strips, x, h / k, k == 1)
            forget(last)
            sizes = x.agg(F.max("most_term"), F.max("most_state")).first()
            if (sizes[0] or 0.0) <= most * (sizes[1] or 0.0):
                break
        else:
            raise RuntimeError(f"the series did not end in {max_terms} terms")
    out = stored(unpacked(x, nodes, by), "state")
    forget(packed, x, nodes)
    return out


def exponential_action(entries: DataFrame, x: DataFrame, time: float = 1.0, by: Keys = ()) -> DataFrame:
    """(idx, value): exp(A time) x."""
    return ode_solution(entries, x, None, time, by)


def least_sums(axes: Sequence[DataFrame], by: Keys, m: int) -> DataFrame:
    """(by, place, value): the m least sums of one value of each axis (by, value), in order, without the product of the axes.

    Of sorted axes a sum of the i-th, j-th, ... values is among the m least only if i j ... <= m, so only these few are made: about
    m log(m) of two axes, whatever their length.
    """
    one = [ranks.ranked(a.select(*by, "value").where(F.col("value").isNotNull()), by, ["value"], "i").where(F.col("i") <= m) for a in axes]
    out = one[0].select(*by, F.col("i").alias("_used"), F.col("value").alias("_sum"))
    for axis in one[1:]:
        wanted = out.select(*by, "_used", "_sum", F.explode(F.sequence(F.lit(1).cast("long"), F.floor(F.lit(m) / F.col("_used")))).alias("i"))
        out = wanted.join(axis, [*by, "i"]).select(*by, (F.col("_used") * F.col("i")).alias("_used"), (F.col("_sum") + F.col("value")).alias("_sum"))
    return ranks.ranked(out.select(*by, F.col("_sum").alias("value")), by, ["value"], "place").where(F.col("place") <= m).select(*by, "place", "value")
