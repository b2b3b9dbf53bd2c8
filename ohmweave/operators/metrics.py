"""Series errors, interpolation, time weights and curve fits, each one aggregate or window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import forget, stored
from . import ranks

TINY = 1e-10  # keeps relative errors of a zero finite


def interpolated(wanted: DataFrame, known: DataFrame, by: list[str], t: str = "t", v: str = "value", most: int = ranks.MOST) -> DataFrame:
    """known's values at wanted's times, on straight lines between neighbours, flat beyond the ends.

    One union along (by, t), each row with the known points on either side; of several known rows at a time the largest
    value counts. A key of over `most` rows is cut into ranges of time whose border values carry over.
    """
    k = known.groupBy(*by, t).agg(F.max(v).alias("kv"))
    both = wanted.select(*by, t, F.lit(None).cast("double").alias("kv"), F.lit(True).alias("asked")).unionByName(k.select(*by, t, F.col("kv").cast("double"), F.lit(False).alias("asked")))
    point = F.when(F.col("kv").isNotNull(), F.struct(F.col(t).alias("t"), F.col("kv").alias("v")))
    seen = ranks.carried(both, by, [t, "asked"], {"p": point}, {"n": point}, most)  # a known row comes before a wanted one of its time
    line = F.col("p.v") + (F.col("n.v") - F.col("p.v")) * (F.col(t) - F.col("p.t")) / (F.col("n.t") - F.col("p.t"))
    value = F.when(F.col("p").isNull(), F.col("n.v")).when(F.col("n").isNull() | (F.col("p.t") == F.col(t)), F.col("p.v")).otherwise(line)
    return seen.where("asked").select(*by, t, value.alias(v))


def time_weights(series: DataFrame, by: list[str], t: str = "t", most: int = ranks.MOST) -> DataFrame:
    """series with w: half the gaps to both neighbours over the whole span; a single point has 1."""
    cut = ranks.crowded(series, by, most)
    near = ranks.carried(series, by, [t], {"_b": F.col(t)}, {"_a": F.col(t)}, cut=cut)
    raw = near.withColumn("w", (F.coalesce("_a", t) - F.coalesce("_b", t)) / 2).drop("_a", "_b")
    whole = ranks.with_totals(raw, by, {"_total": F.sum("w"), "_n": F.count(F.lit(1))}, cut)
    return whole.withColumn("w", F.when(F.col("_total") > 0, F.col("w") / F.col("_total")).otherwise(1.0 / F.col("_n"))).drop("_total", "_n")


def with_previous(series: DataFrame, by: list[str], order: str, name: str = "want", value: str = "value", most: int = ranks.MOST) -> DataFrame:
    """series with the value of the row before, null for a key's first row."""
    return ranks.carried(series, by, [order], {name: F.struct(F.col(value).alias("v"))}, {}, most).withColumn(name, F.col(f"{name}.v"))


def error_metrics(pairs: DataFrame, by: list[str], got: str = "got", want: str = "want", weight: Column | None = None) -> DataFrame:
    """Largest, mean and root-mean-square errors, absolute and relative; weighted if a weight (adding up to 1) is given."""
    w = weight if weight is not None else F.lit(1.0)
    e = F.abs(F.col(got) - F.col(want))
    r = e / (F.abs(F.col(want)) + TINY)
    rows = pairs.select(*by, e.alias("e"), r.alias("r"), w.alias("w"))
    mean = lambda x: F.sum(F.col("w") * x) / F.sum("w")
    return rows.groupBy(*by).agg(
        F.max("e").alias("max_abs"),
        F.max("r").alias("max_rel"),
        mean(F.col("e")).alias("avg_abs"),
        mean(F.col("r")).alias("avg_rel"),
        F.sqrt(mean(F.col("e") * F.col("e"))).alias("rms_abs"),
        F.sqrt(mean(F.col("r") * F.col("r"))).alias("rms_rel"),
    )


def group_means(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """(by, n, mean) over the rows that have a value."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))


def largest(rows: DataFrame, by: list[str], value: str = "value", at: str = "t") -> DataFrame:
    """(by, value, at): the largest value and where it is; of several the largest place."""
    return rows.groupBy(*by).agg(F.max(value).alias(value), F.max_by(at, F.struct(value, at)).alias(at))


def speedups(rows: DataFrame, by: list[str], p: str = "p", t: str = "t") -> DataFrame:
    """rows with speedup: the time at the least p of the group over the row's own."""
    first = rows.groupBy(*by).agg(F.min_by(t, p).alias("_first"))
    return rows.join(first, by).withColumn("speedup", F.col("_first") / F.col(t)).drop("_first")


def linear_fit(x: Column, y: Column) -> list[Column]:
    return [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")]


def power_fit(x: Column, y: Column) -> list[Column]:
    """y = k x^alpha by least squares on logarithms; points that have none are left out."""
    ok = (x > 0) & (y > 0)
    lx, ly = F.when(ok, F.ln(x)), F.when(ok, F.ln(y))
    return [F.exp(F.regr_intercept(ly, lx)).alias("k"), F.regr_slope(ly, lx).alias("alpha"), F.regr_r2(ly, lx).alias("r2")]


def serial_parallel_fit(points: DataFrame, by: list[str], p: str = "p", t: str = "t") -> DataFrame:
    """t = serial + parallel / p with neither negative."""
    x = 1 / F.col(p)
    fit = points.groupBy(*by).agg(F.regr_slope(F.col(t), x).alias("s"), F.regr_intercept(F.col(t), x).alias("i"), F.avg(t).alias("mean"), (F.sum(F.col(t) * x) / F.sum(x * x)).alias("only"))
    flat, steep = F.col("s") < 0, F.col("i") < 0
    return fit.select(*by, F.when(flat, F.col("mean")).when(steep, 0.0).otherwise(F.col("i")).alias("serial"), F.when(flat, 0.0).when(steep, F.greatest("only", F.lit(0.0))).otherwise(F.col("s")).alias("parallel"))


def reciprocal_fit(points: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """y = a / x^2 + b / x from the two normal equations."""
    u, v = 1 / (F.col(x) * F.col(x)), 1 / F.col(x)
    s = points.groupBy(*by).agg(F.sum(u * u).alias("uu"), F.sum(u * v).alias("uv"), F.sum(v * v).alias("vv"), F.sum(u * F.col(y)).alias("uy"), F.sum(v * F.col(y)).alias("vy"))
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    ok = F.abs(det) > 1e-12 * F.col("uu") * F.col("vv")
    return s.select(*by, F.when(ok, (F.col("uy") * F.col("vv") - F.col("vy") * F.col("uv")) / det).alias("a"), F.when(ok, (F.col("vy") * F.col("uu") - F.col("uy") * F.col("uv")) / det).alias("b"))


def _refined(sums: DataFrame, by: list[str], bracket: DataFrame, slope: Callable[[DataFrame], DataFrame], points: int = 64, rounds: int = 5) -> DataFrame:
    """(by, _g): where a slope that is given at any g turns from negative to positive inside bracket (by, lo, hi).

    Each round takes the slope at points of every group's interval and keeps the part in which it turns; without a
    turn the end that it leads to. slope: of rows with _g and _i, gives (by, _i, d). An interval shrinks by `points` each round.
    """
    for _ in range(rounds):
        step = F.explode(F.sequence(F.lit(0), F.lit(points))).alias("_i")
        at = ranks.met_by(sums, bracket, by).select("*", step).withColumn("_g", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("_i") / points)
        # a point where the slope isn't defined is passed over
        found = slope(at).where("d is not null and not isnan(d)").groupBy(*by).agg(F.max(F.when(F.col("d") < 0, F.col("_i"))).alias("_down"), F.array_sort(F.collect_list("_i")).alias("_all"))
        above = F.coalesce(F.array_min(F.filter("_all", lambda i: i > F.col("_down"))), F.lit(points))
        part = found.select(*by, F.coalesce("_down", F.lit(0)).alias("_a"), F.when(F.col("_down").isNull(), 0).otherwise(above).alias("_b"))
        place = lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * F.col(i) / points
        last, bracket = bracket, stored(ranks.met_by(bracket, part, by, "left").select(*by, F.coalesce(place("_a"), "lo").alias("lo"), F.coalesce(place("_b"), "hi").alias("hi")), "brackets")
        forget(last)
    return bracket.select(*by, ((F.col("lo") + F.col("hi")) / 2).alias("_g"))


def _power_moments(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, u, uu, uy, y, yy, vy, vuu, vu) of sums with _g: over u = x^_g, and the same with ln x beside it; centred second moments."""
    n, u, v = F.col("n"), F.pow("x", "_g"), F.ln("x")
    terms = {"n": n, "u": n * u, "uu": n * u * u, "uy": u * F.col("sy"), "y": F.col("sy"), "yy": F.col("syy"), "vy": v * u * F.col("sy"), "vuu": n * v * u * u, "vu": n * v * u}
    return rows.groupBy(*by).agg(*(F.sum(c).alias(f"m_{k}") for k, c in terms.items()))


def _power_line(m: DataFrame) -> DataFrame:
    """moments with k, c of the least squares line y = k u + c and what it leaves; null where u hardly varies."""
    c = F.col
    uu, uy, yy = (c(f"m_{a}{b}") - c(f"m_{a}") * c(f"m_{b}") / c("m_n") for a, b in ("uu", "uy", "yy"))
    k = F.when(uu > 1e-14 * c("m_uu"), uy / uu)
    return m.withColumns({"k": k, "left": yy - k * uy}).withColumn("c", (c("m_y") - c("k") * c("m_u")) / c("m_n"))


def offset_power_fit(points: DataFrame, by: list[str], x: str = "x", y: str = "y", steps: int = 61) -> DataFrame:
    """(by, alpha, k, c, left): y = k x^alpha + c with alpha in [-3, 3], least squares; points without a positive x are left out.

    A grid of `steps` finds the deepest valley, then the slope of what is left, k and c being the best at each alpha, is
    followed to where it turns (to 1e-10). Points of one x are summed up first, and only these sums are read again.
    """
    sums = points.where(F.col(x) > 0).select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("y is not null")
    sums = stored(sums.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy")), "sums")
    grid = [round(-3 + 6 * i / (steps - 1), 10) for i in range(steps) if i != (steps - 1) // 2]
    coarse = _power_line(_power_moments(sums.withColumn("_g", F.explode(F.array(*map(F.lit, grid)))), [*by, "_g"])).where("k is not null")
    best = coarse.groupBy(*by).agg(F.min(F.struct("left", "_g")).alias("b")).select(*by, F.col("b._g").alias("_g"))
    width = 6 / (steps - 1)
    bracket = stored(best.select(*by, F.greatest(F.col("_g") - width, F.lit(-3.0)).alias("lo"), F.least(F.col("_g") + width, F.lit(3.0)).alias("hi")), "brackets")

    def slope(rows: DataFrame) -> DataFrame:
        line = _power_line(_power_moments(rows, [*by, "_i"]))
        return line.select(*by, "_i", (-F.col("k") * (F.col("m_vy") - F.col("k") * F.col("m_vuu") - F.col("c") * F.col("m_vu"))).alias("d"))

    at = _refined(sums, by, bracket, slope)
    out = stored(_power_line(_power_moments(ranks.met_by(sums, at, by), [*by, "_g"])).select(*by, F.col("_g").alias("alpha"), "k", "c", "left"), "fits")
    forget(sums)
    return out


def amdahl_fit(points: DataFrame, by: list[str], p: str = "p", speedup: str = "speedup", steps: int = 99) -> DataFrame:
    """(by, s, left): the serial share s in [0.001, 0.999] whose 1 / (s + (1 - s) / p) is nearest in squares.

    As in offset_power_fit a grid finds the valley and the slope its bottom.
    """
    sums = points.select(*by, F.col(p).cast("double").alias("p"), F.col(speedup).cast("double").alias("y")).where("p is not null and y is not null")
    sums = stored(sums.groupBy(*by, "p").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy")), "sums")
    f = 1 / (F.col("_g") + (1 - F.col("_g")) / F.col("p"))
    left = F.sum(F.col("syy") - 2 * f * F.col("sy") + F.col("n") * f * f).alias("left")
    grid = [0.001 + 0.998 * i / (steps - 1) for i in range(steps)]
    coarse = sums.withColumn("_g", F.explode(F.array(*map(F.lit, grid)))).groupBy(*by, "_g").agg(left)
    best, width = coarse.groupBy(*by).agg(F.min(F.struct("left", "_g")).alias("b")).select(*by, F.col("b._g").alias("_g")), 0.998 / (steps - 1)
    bracket = stored(best.select(*by, F.greatest(F.col("_g") - width, F.lit(0.001)).alias("lo"), F.least(F.col("_g") + width, F.lit(0.999)).alias("hi")), "brackets")
    slope = lambda rows: rows.groupBy(*by, "_i").agg(F.sum((1 / F.col("p") - 1) * f * f * (F.col("n") * f - F.col("sy"))).alias("d"))
    at = _refined(sums, by, bracket, slope)
    out = stored(ranks.met_by(sums, at, by).groupBy(*by, "_g").agg(left).withColumnRenamed("_g", "s"), "fits")
    forget(sums)
    return out
