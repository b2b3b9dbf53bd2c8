"""Monte Carlo solves of x' = A x + b by random walks.

A = D + L: L's rows add up to nothing and its off-diagonals are the rates of a jump process, D (the row sums)
weighs each path. Samples are rows of a table; each is a walk of its own, driven by numbers hashed from (seed,
sample, draw), so results don't depend on partitioning. Tasks walk all their samples together in numpy and return
partial sums; the final sum is an ordinary aggregate. The matrix is shipped to the tasks behind a check of its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ENTRIES = 5_000_000  # about 120 MB in a task


@dataclass
class Chain:
    """Jump rates, targets and weights of a matrix, rows laid end to end."""

    rate: np.ndarray
    weight: np.ndarray  # D
    first: np.ndarray
    target: np.ndarray
    upto: np.ndarray  # row + cumulative share of the targets, rising over all rows

    @classmethod
    def of(cls, entries: DataFrame, n: int) -> Chain:
        """From (row, col, value), 0 <= row < n. Refuses negative off-diagonals and too many entries."""
        rows = entries.groupBy("row", "col").agg(F.sum("value").alias("value")).orderBy("row", "col").limit(MOST_ENTRIES + 1).toPandas()
        if len(rows) > MOST_ENTRIES:
            raise ValueError(f"over {MOST_ENTRIES} entries: too many to send to every task")
        r, c, v = rows.row.to_numpy(), rows.col.to_numpy(), rows.value.to_numpy()
        weight = np.bincount(r, v, n)
        off = r != c
        r, c, v = r[off], c[off], v[off]
        if (v < 0).any():
            raise ValueError("rates must not be negative")
        rate = np.bincount(r, v, n)
        first = np.searchsorted(r, np.arange(n))
        run = np.cumsum(v)
        before = np.r_[0.0, run][first]
        return cls(rate, weight, first, c, r + (run - before[r]) / np.where(rate[r] > 0, rate[r], 1))

    def jump(self, state: np.ndarray, u: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.upto, state + u, side="right")
        last = np.r_[self.first[1:], len(self.target)][state] - 1
        return self.target[np.minimum(at, last)]


def hashed(seed: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Numbers in [0, 1) from (sample, draw) by a 64-bit finaliser, the same wherever they are drawn."""

    def draw(sample: np.ndarray, k: np.ndarray) -> np.ndarray:
        x = sample.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + k.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed % (1 << 64))
        for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(mul)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)

    return draw


def digested(seed: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The same from MD5, as functions.uniform has it: slower, but any SQL engine can replay it."""

    def draw(sample: np.ndarray, k: np.ndarray) -> np.ndarray:
        return np.array([int(hashlib.md5(f"{seed}:{s}:{i}".encode()).hexdigest()[:13], 16) for s, i in zip(sample.tolist(), k.tolist(), strict=True)], dtype=np.float64) / (1 << 52)

    return draw


def walk(chain: Chain, sample: np.ndarray, start: np.ndarray, time: float, steps: int, draw, holding: str = "next") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(step, state, path weight) after each of `steps` equal steps, all samples together.

    Each step weighs half before and half after its jumps. A state is held for a time at its own rate; with
    holding="previous" at the rate of the state before it, which is biased where rates differ.
    """
    dt, state, weight = time / steps, start.copy(), np.ones(len(sample))
    k = np.zeros(len(sample), dtype=np.int64)

    def wait(who: np.ndarray, rate: np.ndarray) -> np.ndarray:
        u = draw(sample[who], k[who])
        k[who] += 1
        with np.errstate(divide="ignore"):
            return np.where(rate > 0, -np.log1p(-u) / np.where(rate > 0, rate, 1), np.inf)

    everyone = np.arange(len(sample))
    for n in range(1, steps + 1):
        weight *= np.exp(chain.weight[state] * dt / 2)
        left = dt - wait(everyone, chain.rate[state])
        who = np.flatnonzero(left > 0)
        while len(who):
            old = chain.rate[state[who]]
            u = draw(sample[who], k[who])
            k[who] += 1
            state[who] = chain.jump(state[who], u)
            left[who] -= wait(who, old if holding == "previous" else chain.rate[state[who]])
            who = who[left[who] > 0]
        weight *= np.exp(chain.weight[state] * dt / 2)
        yield n, state, weight


def point(samples: DataFrame, chain: Chain, x0: np.ndarray, b: Callable[[np.ndarray, float], np.ndarray] | None, time: float, steps: int, seed: int = 1, uniform=hashed, holding: str = "next") -> DataFrame:
    """Estimates of x_start(time): samples has (start, sample); the result a row for each start: n, mean, error (of the mean).

    The forcing's integral is Simpson's, so steps must be even.
    """
    if steps % 2:
        raise ValueError("steps must be even")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            start, sample = part.start.to_numpy(), part["sample"].to_numpy()
            total = b(start, time) * 1.0 if b else 0.0
            state, weight = start, np.ones(len(start))
            for n, state, weight in walk(chain, sample, start, time, steps, uniform(seed), holding):  # noqa: B007
                if b:
                    total = total + (1.0 if n == steps else 4.0 if n % 2 else 2.0) * weight * b(state, time - n * time / steps)
            y = weight * x0[state] + (total * time / steps / 3 if b else 0.0)
            yield pd.DataFrame({"start": start, "y": y}).groupby("start").y.agg(n="count", s="sum", q=lambda v: float((v * v).sum())).reset_index()

    sums = samples.select("start", "sample").mapInPandas(run, "start long, n long, s double, q double")
    g = sums.groupBy("start").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    return g.select("start", "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)) / F.greatest(F.col("n") - 1, F.lit(1))).alias("error"))


def visits(samples: DataFrame, chain: Chain, time: float, steps: int, outputs: int = 0, seed: int = 1, uniform=hashed, holding: str = "next") -> DataFrame:
    """(start, k, state, w): mean path weight by state at each of `outputs` times, k from 0.

    outputs = 0 takes every step; it must divide steps.
    """
    outputs = outputs or steps
    if steps < outputs or steps % outputs:
        raise ValueError("the number of outputs must divide the number of steps")
    every = steps // outputs

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            start, sample = part.start.to_numpy(), part["sample"].to_numpy()
            frames = [pd.DataFrame({"start": start, "k": 0, "state": start, "w": 1.0})]
            for n, state, weight in walk(chain, sample, start, time, steps, uniform(seed), holding):
                if n % every == 0:
                    frames.append(pd.DataFrame({"start": start, "k": n // every, "state": state.copy(), "w": weight.copy()}))
            yield pd.concat(frames).groupby(["start", "k", "state"], as_index=False).w.sum()

    sums = samples.select("start", "sample").mapInPandas(run, "start long, k int, state long, w double")
    counts = samples.groupBy("start").agg(F.count(F.lit(1)).alias("n"))
    return sums.groupBy("start", "k", "state").agg(F.sum("w").alias("w")).join(counts, "start").select("start", "k", "state", (F.col("w") / F.col("n")).alias("w"))


def sequence(seen: DataFrame, x0: DataFrame, forcing: DataFrame, delta: float, outputs: int) -> DataFrame:
    """(start, j, value): the solution at every output time from the visits.

    Path weights are summed by state before the forcing meets them: x_j = sum_s w[j, s] x0[s] + delta * sum over k <= j and s of
    c w[k, s] b_s((j - k) delta), with half weight at k = 0 and k = j. x0: (state, value). forcing: (state, lag, value), lag 0..outputs.
    """
    x = seen.join(x0.withColumnRenamed("value", "x"), "state").groupBy("start", F.col("k").alias("j")).agg(F.sum(F.col("w") * F.col("x")).alias("value"))
    f = seen.join(forcing.withColumnRenamed("value", "f"), "state").withColumn("j", F.col("k") + F.col("lag")).where((F.col("j") <= outputs) & (F.col("j") > 0))
    half = F.when((F.col("k") == 0) | (F.col("lag") == 0), 0.5).otherwise(1.0)
    y = f.groupBy("start", F.col("j").cast("int").alias("j")).agg(F.sum(half * F.col("w") * F.col("f") * delta).alias("value"))
    return x.unionByName(y).groupBy("start", "j").agg(F.sum("value").alias("value"))
