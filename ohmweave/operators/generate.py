"""Laplacians and their spectra, and synthetic netlists, for many grids at once.

A grid table has one row for each grid: its keys, and nx, ny, nz (1 where it lacks a dimension).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.uniform import uniform

ENDS = ("DD", "DN", "ND", "NN", "P")

# Components of a power grid and the pulse on its diagonal.
GRID_OHM, GRID_FARAD, GRID_VOLT, FEED_OHM = 0.25, 5.37096111111111e-11, 1.8, 0.025
GRID_PULSE = {"v1": 2.5099e-05, "v2": 0.0627475, "td": 1e-9, "tr": 1e-19, "tf": 1e-10, "pw": 1e-19, "per": 3e-09}


def points(grids: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, nx, ny, nz, i, j, k): the points of each grid, from 0."""
    out = grids.select(*by, "nx", "ny", "nz")
    for axis, n in (("i", "nx"), ("j", "ny"), ("k", "nz")):
        out = out.withColumn(axis, F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    return out


def number_of() -> Column:
    return (F.col("i") + F.col("nx") * (F.col("j") + F.col("ny") * F.col("k"))).cast("long")


def laplacian(grids: DataFrame, by: Sequence[str], ends: str | Sequence[str] = "DD") -> DataFrame:
    """(by, row, col, value) of the negative Laplacian's matrix on each grid: 2 on the diagonal for each dimension of
    more than one point, -1 to each neighbour. ends: D (fixed) or N (free) at either side, or P (periodic), for all axes or one for each of the three.
    """
    each = [ends] * 3 if isinstance(ends, str) else list(ends)
    if len(each) != 3 or not set(each) <= set(ENDS):
        raise ValueError(f"ends must be one of {ENDS}, or three of them")
    cells = []
    for ends, axis, n, stride in zip(each, ("i", "j", "k"), ("nx", "ny", "nz"), (F.lit(1), F.col("nx"), F.col("nx") * F.col("ny")), strict=True):
        x, last, live = F.col(axis), F.col(n) - 1, F.col(n) > 1
        if ends == "P":
            lo, hi, here = F.when(x > 0, -stride).otherwise(stride * last), F.when(x < last, stride).otherwise(-stride * last), F.lit(2.0)
        else:
            lo, hi = F.when(x > 0, -stride), F.when(x < last, stride)
            free = sum((F.when(edge, 1.0).otherwise(0.0) for edge, kind in ((x == 0, ends[0]), (x == last, ends[1])) if kind == "N"), F.lit(0.0))
            here = 2.0 - free
        cells += [F.struct(F.lit(0).alias("to"), F.when(live, here).alias("value"))] + [F.struct(step.cast("int").alias("to"), F.when(live & step.isNotNull(), F.lit(-1.0)).alias("value")) for step in (lo, hi)]
    at = points(grids, by).select(*by, number_of().alias("row"), F.explode(F.array(*cells)).alias("c"))
    return at.where("c.value is not null").select(*by, "row", (F.col("row") + F.col("c.to")).alias("col"), F.col("c.value").alias("value")).groupBy(*by, "row", "col").agg(F.sum("value").alias("value"))


def eigenvalue_1d(n: Column, m: Column, ends: str = "DD") -> Column:
    """The m-th (from 0) of n points: 4 sin^2 of half an angle that the ends set, such as pi (m + 1) / (n + 1) if both are fixed."""
    half = {"DD": (m + 1) / (2.0 * (n + 1)), "NN": m / (2.0 * n), "P": F.floor((m + 1) / 2) / n.cast("double")}.get(ends, (m + 0.5) / (2.0 * n + 1))
    return F.when(n > 1, 4 * F.pow(F.sin(F.lit(math.pi) * half), 2)).otherwise(0.0)


def eigenvalues(grids: DataFrame, by: Sequence[str], ends: str | Sequence[str] = "DD") -> DataFrame:
    """(by, i, j, k, value): all eigenvalues of each grid's Laplacian, ends as in laplacian; an array sort takes the least."""
    p, each = points(grids, by), [ends] * 3 if isinstance(ends, str) else ends
    axes = [eigenvalue_1d(F.col(n), F.col(m), e) for n, m, e in zip(("nx", "ny", "nz"), ("i", "j", "k"), each, strict=True)]
    return p.select(*by, "i", "j", "k", (axes[0] + axes[1] + axes[2]).alias("value"))


def eigenvector_1d(n: Column, m: Column, x: Column, ends: str = "DD") -> Column:
    """Component x of the m-th eigenvector, of length 1; both from 0, in eigenvalue_1d's order.

    A wave of half the angle there: a sine from a fixed first end, a cosine from a free one; of a circle's pairs the cosine first.
    """
    at = lambda angle: F.lit(math.pi) * angle
    if ends == "DD":
        return F.sqrt(2.0 / (n + 1)) * F.sin(at((m + 1) * (x + 1) / (n + 1)))
    if ends == "NN":
        return F.sqrt(F.when(m == 0, 1.0).otherwise(2.0) / n) * F.cos(at(m * (x + 0.5) / n))
    if ends == "P":
        k = F.floor((m + 1) / 2)
        angle = at(2 * k * x / n)
        return F.sqrt(F.when((m == 0) | (2 * k == n), 1.0).otherwise(2.0) / n) * F.when((m == 0) | (m % 2 == 1), F.cos(angle)).otherwise(F.sin(angle))
    wave = F.sin(at((m + 0.5) * (x + 1) / (n + 0.5))) if ends == "DN" else F.cos(at((m + 0.5) * (x + 0.5) / (n + 0.5)))
    return F.sqrt(2.0 / (n + 0.5)) * wave


def exponential_1d(sizes: DataFrame, by: Sequence[str], row: int = 0) -> DataFrame:
    """(by, col, value): row `row` of exp(-Laplacian) of each 1-D grid (column nx), by its spectrum."""
    n = F.col("nx")
    p = sizes.select(*by, "nx", F.explode(F.sequence(F.lit(0), n - 1)).alias("col")).withColumn("m", F.explode(F.sequence(F.lit(0), n - 1)))
    term = eigenvector_1d(n, F.col("m"), F.lit(row)) * eigenvector_1d(n, F.col("m"), F.col("col")) * F.exp(-4 * F.pow(F.sin(F.lit(math.pi) * (F.col("m") + 1) / (2.0 * (n + 1))), 2))
    return p.groupBy(*by, "col").agg(F.sum(term).alias("value"))


def line_netlist(lines: DataFrame) -> DataFrame:
    """Components of RC lines: a row (circuit, size, volt, r, c, every, v1, v2, td, tr, tf, pw, per) each.

    A source of volt through r feeds n1; r from node to node, c from each to ground, and a pulse at every `every`-th node.
    """
    p = lines.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("size"))))
    node = lambda i: F.concat(F.lit("n"), i.cast("string"))
    shape = F.struct("v1", "v2", "td", "tr", "tf", "pw", "per")
    none = F.lit(None).cast("struct<v1:double,v2:double,td:double,tr:double,tf:double,pw:double,per:double>")

    def part(when, kind, name, a, b, value, pulse=none):
        return F.when(when, F.struct(F.lit(kind).alias("kind"), name.alias("name"), a.alias("node1"), b.alias("node2"), value.cast("double").alias("value"), pulse.cast(none_type).alias("pulse")))

    none_type = "struct<v1:double,v2:double,td:double,tr:double,tf:double,pw:double,per:double>"
    i, ground = F.col("i"), F.lit("0")
    label = lambda k: F.concat(F.lit(k), i.cast("string"))
    found = F.array(
        part(i == 1, "v", F.lit("v1"), F.lit("src"), ground, F.col("volt")),
        part(F.lit(True), "r", label("r"), F.when(i == 1, F.lit("src")).otherwise(node(i - 1)), node(i), F.col("r")),
        part(F.lit(True), "c", label("c"), node(i), ground, F.col("c")),
        part((i % F.col("every")) == 0, "i", label("i"), node(i), ground, F.col("v1"), shape),
    )
    return p.select("circuit", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("p")).select("circuit", "p.*")


def power_grid(grids: DataFrame) -> DataFrame:
    """Components of layered power grids: a row (circuit, nx, ny, layers, share) each.

    Every layer has resistors of 0.25 between neighbours and a capacitor at each node; layer 1 is fed with 1.8 V through
    0.025 along y = 1 and pulsed on its diagonal from the second place on; vias are 0-volt sources to the next layer at
    about `share` of the places off the first row and column, drawn by a hash of circuit, layer and place.
    """
    kind = "struct<v1:double,v2:double,td:double,tr:double,tf:double,pw:double,per:double>"
    pulse = F.struct(*[F.lit(v).alias(k) for k, v in GRID_PULSE.items()]).cast(kind)
    p = grids
    for axis, n in (("l", "layers"), ("x", "nx"), ("y", "ny")):
        p = p.withColumn(axis, F.explode(F.sequence(F.lit(1), F.col(n))))
    at = lambda l, x, y: F.format_string("l%dp%d_%d", l, x, y)
    node = lambda l, x, y: F.concat(F.lit("n"), at(l, x, y))
    l, x, y, ground = F.col("l").cast("int"), F.col("x").cast("int"), F.col("y").cast("int"), F.lit("0")
    here, name = node(l, x, y), at(l, x, y)

    def part(when, letter, tag, a, b, value, shape=None):
        shape = F.lit(None).cast(kind) if shape is None else shape
        return F.when(when, F.struct(F.lit(letter).alias("kind"), F.concat(F.lit(tag), name).alias("name"), a.alias("node1"), b.alias("node2"), F.lit(value).alias("value"), shape.alias("pulse")))

    fed = (l == 1) & (y == 1)
    drawn = uniform(F.col("circuit"), l.cast("string"), x.cast("string"), y.cast("string")) < F.col("share")
    found = F.array(
        part(F.lit(True), "c", "c", here, ground, GRID_FARAD),
        part(y < F.col("ny"), "r", "ry", here, node(l, x, y + 1), GRID_OHM),
        part(x < F.col("nx"), "r", "rx", here, node(l, x + 1, y), GRID_OHM),
        part((l < F.col("layers")) & (x > 1) & (y > 1) & drawn, "v", "via", here, node(l + 1, x, y), 0.0),
        part(fed, "v", "vdd", F.concat(F.lit("s"), name), ground, GRID_VOLT),
        part(fed, "r", "rdd", F.concat(F.lit("s"), name), here, FEED_OHM),
        part((l == 1) & (x == y) & (x > 1), "i", "i", here, ground, GRID_PULSE["v1"], pulse),
    )
    return p.select("circuit", F.explode(F.filter(found, lambda c: c.isNotNull())).alias("p")).select("circuit", "p.*")
