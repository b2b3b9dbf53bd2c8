"""The commands: exponential of a matrix, solution at a time, solution over time, transient of netlists."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.waveform import wave_at
from ..operators import assemble, netlist, stepper, walk
from ..sources import netlist_text
from ..sources.store import stored

COMMANDS = ("exp", "solve", "solve-sequence", "tran")


def exp_entry(samples: DataFrame, matrix: DataFrame, n: int, col: int, steps: int = 64, seed: int = 1, expected: float | None = None) -> DataFrame:
    """exp(A)[start, col] for every start among the samples (start, sample): n, mean, error, and error_percent if a value is expected."""
    x0 = np.zeros(n)
    x0[col] = 1.0
    out = walk.point(samples, walk.Chain.of(matrix, n), x0, None, 1.0, steps, seed)
    return out if expected is None else out.withColumn("error_percent", F.abs(F.col("mean") - expected) / abs(expected) * 100)


def solve(samples: DataFrame, matrix: DataFrame, n: int, time: float = 1.0, steps: int = 64, x0: np.ndarray | None = None, b: Callable | None = None, seed: int = 1) -> DataFrame:
    """x_start(time) of x' = A x + b; x0 and b are zero where not given."""
    return walk.point(samples, walk.Chain.of(matrix, n), np.zeros(n) if x0 is None else x0, b, time, steps, seed)


def solve_sequence(samples: DataFrame, matrix: DataFrame, n: int, x0: DataFrame, forcing: DataFrame, time: float, steps: int, outputs: int = 0, seed: int = 1) -> DataFrame:
    """(start, j, value) at outputs + 1 times, by visits summed before the forcing joins them."""
    outputs = outputs or steps
    seen = walk.visits(samples, walk.Chain.of(matrix, n), time, steps, outputs, seed)
    return walk.sequence(seen, x0, forcing, time / outputs, outputs)


def reduced_and_asked(lines: DataFrame, time: float = 0.0, steps: int = 0, fill: bool = True) -> tuple[DataFrame, DataFrame]:
    """Reduced components of netlist lines, and (circuit, node, tstop, steps): the first node printed, .tran's times unless given."""
    parts, setting = stored(netlist_text.components(lines), "components"), netlist_text.settings(lines)
    asked = setting.select(
        "circuit",
        F.when(F.size("print") > 0, F.col("print")[0]).otherwise(F.raise_error(F.lit("nothing to print")).cast("string")).alias("node"),
        (F.lit(time) if time else F.col("tstop")).alias("tstop"),
        (F.lit(steps) if steps else F.round((F.lit(time) if time else F.col("tstop")) / F.col("tstep"))).cast("long").alias("steps"),
    )
    asked = asked.join(netlist.short_circuit_map(parts), ["circuit", "node"], "left").withColumn("node", F.coalesce("rep", "node")).drop("rep")
    asked = asked.withColumn("node", netlist.fail(F.col("node").isin("0", "gnd"), F.lit("ground can't be printed"), F.col("node")))
    return netlist.reduced(parts, fill), asked


def prepared(lines: DataFrame, time: float = 0.0, steps: int = 0, fill: bool = True) -> DataFrame:
    """Systems of netlist lines with node, tstop and steps beside them."""
    parts, asked = reduced_and_asked(lines, time, steps, fill)
    return assemble.systems(parts).join(asked, "circuit")


def transient(lines: DataFrame, time: float = 0.0, steps: int = 0, method: str = "lu", fill: bool = True) -> DataFrame:
    """(circuit, step, time, value): waveforms of the first printed node of every netlist in lines (circuit, line_no, line)."""
    return stepper.transients(prepared(lines, time, steps, fill), method)


def transient_by_walks(lines: DataFrame, samples: int = 1000, time: float = 0.0, steps: int = 0, outputs: int = 0, seed: int = 1, fill: bool = True) -> DataFrame:
    """(circuit, step, time, value) of one netlist by random walks from its printed node: for circuits too large to factor.

    outputs is the number of output intervals (0: every step) and must divide steps. The operating point is the initial state.
    """
    parts, asked = reduced_and_asked(lines, time, steps, fill)
    wanted = asked.limit(2).collect()
    if len(wanted) != 1:
        raise ValueError("walks are for one circuit at a time")
    circuit, node, tstop, steps = (wanted[0][k] for k in ("circuit", "node", "tstop", "steps"))
    outputs = outputs or steps
    numbers = stored(netlist.node_numbers(parts).where("idx > 0").select("node", (F.col("idx") - 1).alias("state")), "states")
    c = assemble.capacitances(parts.where("kind = 'c'"))
    a = assemble.ode_matrix(assemble.conductances(parts.where("kind = 'r'")), c)
    row, col = numbers.select(F.col("node").alias("row"), F.col("state").alias("r")), numbers.select(F.col("node").alias("col"), F.col("state").alias("c"))
    cells = a.join(row, "row").join(col, "col").select(F.col("r").alias("row"), F.col("c").alias("col"), "value")
    chain = walk.Chain.of(cells, numbers.count())
    start = numbers.where(F.col("node") == node).select("state").first()
    if start is None:
        raise ValueError(f"no such node left in the circuit: {node}")
    delta = tstop / outputs
    b = assemble.injections(parts.where("kind = 'i'")).join(c.select("node", F.col("value").alias("cap")), "node").join(numbers, "node")
    lag = b.select("state", "dc", "pulses", "cap", F.explode(F.sequence(F.lit(0), F.lit(outputs))).alias("lag"))
    forcing = lag.select("state", "lag", (wave_at(F.col("dc"), F.col("pulses"), F.col("lag") * delta) / F.col("cap")).alias("value"))
    x0 = stepper.dc_points(assemble.systems(parts)).join(numbers, "node").select("state", "value")
    walks = lines.sparkSession.range(samples).select(F.lit(start.state).cast("long").alias("start"), F.col("id").alias("sample"))
    seen = stored(walk.visits(walks, chain, tstop, steps, outputs, seed), "visits")
    out = walk.sequence(seen, x0, forcing, delta, outputs)
    return out.select(F.lit(circuit).alias("circuit"), F.col("j").cast("long").alias("step"), (F.col("j") * delta).alias("time"), "value")


def run(command: str, **arguments) -> DataFrame:
    """One command by name."""
    if command not in COMMANDS:
        raise ValueError(f"exactly one of {COMMANDS} is needed")
    return {"exp": exp_entry, "solve": solve, "solve-sequence": solve_sequence, "tran": transient_by_walks if arguments.pop("solver", "trapezoidal") == "monte-carlo" else transient}[command](**arguments)
