"""Operating points and trapezoid transients.

Many circuits: one row of lists each (assemble.systems), solved by numpy in Arrow batches; a task solves its rows
one after the other. One circuit too large for that: conjugate gradients whose vectors and matrix stay tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.waveform import FIELDS
from ..sources.store import stored
from . import matrix

METHODS = ("lu", "cg")


class SingularMatrix(ValueError):
    """A system without a single solution."""


def pulse_value(p, t: float) -> float:
    """The same shape as waveform.pulse_at, for a number."""
    v1, v2, td, tr, tf, pw, per = (p[f] for f in FIELDS)
    if t < td or per == 0:
        return v1
    c = math.fmod(t - td, per)
    if c < tr:
        return v1 + (v2 - v1) * c / tr
    if c < tr + pw:
        return v2
    return v2 + (v1 - v2) * (c - tr - pw) / tf if c < tr + pw + tf else v1


class System:
    """C x' = b(t) - G x of one circuit, nodes in name order."""

    def __init__(self, row):
        self.nodes = sorted({e["row"] for e in row.g})
        self.at = {n: i for i, n in enumerate(self.nodes)}
        n = len(self.nodes)
        self.g, self.c = np.zeros((n, n)), np.zeros(n)
        for e in row.g:
            self.g[self.at[e["row"]], self.at[e["col"]]] += e["value"]
        for e in row.c if row.c is not None else ():
            self.c[self.at[e["node"]]] += e["value"]
        self.b = [(self.at[e["node"]], e["dc"], list(e["pulses"]) if e["pulses"] is not None else []) for e in (row.b if row.b is not None else ()) if e["node"] in self.at]

    def forcing(self, t: float) -> np.ndarray:
        out = np.zeros(len(self.nodes))
        for i, dc, pulses in self.b:
            out[i] += dc + sum(pulse_value(p, t) for p in pulses)
        return out


def solver(a: np.ndarray, method: str, tolerance: float = 1e-13, most: int = 5000):
    """A function of the right side and a first guess. lu: factored once, as an inverse; cg: Jacobi-preconditioned."""
    if method == "lu":
        if np.linalg.matrix_rank(a) < len(a):
            raise SingularMatrix("no single solution")
        inverse = np.linalg.inv(a)
        return lambda b, x0=None: inverse @ b
    if method != "cg":
        raise ValueError(f"method must be one of {METHODS}")
    d = np.diag(a).copy()
    if (d <= 0).any():
        raise SingularMatrix("a diagonal that isn't positive")

    def solve(b, x0=None):
        x = np.zeros_like(b) if x0 is None else x0.copy()
        r = b - a @ x
        z = r / d
        p, rz, stop = z, r @ z, tolerance * max(np.linalg.norm(b), 1e-300)
        for _ in range(most):
            if np.linalg.norm(r) <= stop:
                return x
            ap = a @ p
            k = rz / (p @ ap)
            x, r = x + k * p, r - k * ap
            z = r / d
            rz, before = r @ z, rz
            p = z + rz / before * p
        raise SingularMatrix("conjugate gradients did not settle")

    return solve


def operating_point(s: System, method: str = "lu") -> np.ndarray:
    return solver(s.g, method)(s.forcing(0.0))


def trapezoid(s: System, node: str, time: float, steps: int, method: str = "lu", x0: np.ndarray | None = None) -> np.ndarray:
    """steps + 1 values of a node: (C + dt/2 G) x+ = (C - dt/2 G) x + dt/2 (b + b+), from the operating point unless x0 is given."""
    dt, x = time / steps, operating_point(s, method) if x0 is None else x0
    solve = solver(np.diag(s.c) + dt / 2 * s.g, method)
    right = np.diag(s.c) - dt / 2 * s.g
    out, b = np.empty(steps + 1), s.forcing(0.0)
    out[0] = x[s.at[node]]
    for k in range(1, steps + 1):
        b, before = s.forcing(k * dt), b
        x = solve(right @ x + dt / 2 * (before + b), x)
        out[k] = x[s.at[node]]
    return out


def spread(systems: DataFrame) -> DataFrame:
    """Systems dealt evenly: rows are small and the work on them isn't, so their bytes say little about partitions."""
    return systems.repartition(int(systems.sparkSession.conf.get("spark.sql.shuffle.partitions")), "circuit")


def dc_points(systems: DataFrame, method: str = "lu") -> DataFrame:
    """(circuit, node, value): the operating point of every circuit."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for row in part.itertuples(index=False):
                s = System(row)
                rows += zip([row.circuit] * len(s.nodes), s.nodes, operating_point(s, method), strict=True)
            yield pd.DataFrame(rows, columns=["circuit", "node", "value"])

    return spread(systems).mapInPandas(run, "circuit string, node string, value double")


def transients(asked: DataFrame, method: str = "lu") -> DataFrame:
    """(circuit, step, time, value) for systems with the columns node, tstop and steps beside them.

    A column x0, (node, value) pairs, gives initial values; without it a circuit starts from its operating point.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            names, series, ends = [], [], []
            for row in part.itertuples(index=False):
                s = System(row)
                if row.node not in s.at:
                    raise ValueError(f"no such node left in the circuit: {row.node}")
                given = getattr(row, "x0", None)
                x0 = None if given is None else np.array([{e["node"]: e["value"] for e in given}.get(n, 0.0) for n in s.nodes])
                y = trapezoid(s, row.node, row.tstop, int(row.steps), method, x0)
                names.append(row.circuit)
                series.append(y)
                ends.append(row.tstop)
            if names:
                sizes = [len(y) for y in series]
                k = np.concatenate([np.arange(n) for n in sizes])
                time = k * np.repeat(np.array(ends) / (np.array(sizes) - 1), sizes)
                yield pd.DataFrame({"circuit": np.repeat(np.array(names, dtype=object), sizes), "step": k, "time": time, "value": np.concatenate(series)})

    return spread(asked).mapInPandas(run, "circuit string, step long, time double, value double")


def conjugate_gradients(entries: DataFrame, b: DataFrame, tolerance: float = 1e-10, most: int = 500) -> DataFrame:
    """x with entries x = b for one symmetric positive definite matrix of any size; entries (row, col, value), b (idx, value).

    Jacobi-preconditioned. Each round is one join on col and one on idx; the driver sees two sums a round. The vectors are
    written to the shared folder every round, so a lost executor costs one round.
    """
    d = matrix.diagonal(entries).select(F.col("row").alias("idx"), F.col("value").alias("d"))
    state = d.join(b.select("idx", F.col("value").alias("r")), "idx", "left").select("idx", "d", F.lit(0.0).alias("x"), F.coalesce("r", F.lit(0.0)).alias("r"))
    state = stored(state.withColumn("p", F.col("r") / F.col("d")), "cg")
    rz, size = state.agg(F.sum(F.col("r") * F.col("r") / F.col("d")), F.sqrt(F.sum(F.col("r") * F.col("r")))).first()
    if not size:
        return state.select("idx", F.col("x").alias("value"))
    for _ in range(most):
        ap = matrix.times(entries, state.select("idx", F.col("p").alias("value"))).withColumnRenamed("value", "ap")
        both = stored(state.join(ap, "idx", "left").fillna({"ap": 0.0}), "cg")
        (pap,) = both.agg(F.sum(F.col("p") * F.col("ap"))).first()
        k = rz / pap
        moved = both.select("idx", "d", (F.col("x") + k * F.col("p")).alias("x"), (F.col("r") - k * F.col("ap")).alias("r"), "p")
        new, left = moved.agg(F.sum(F.col("r") * F.col("r") / F.col("d")), F.sqrt(F.sum(F.col("r") * F.col("r")))).first()
        if left <= tolerance * size:
            return moved.select("idx", F.col("x").alias("value"))
        state, rz = moved.withColumn("p", F.col("r") / F.col("d") + (new / rz) * F.col("p")), new
    raise SingularMatrix("conjugate gradients did not settle")
