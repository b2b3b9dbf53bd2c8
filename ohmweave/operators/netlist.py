"""Netlist rewrites on component tables (circuit, kind, name, node1, node2, value, pulse).

Nodes are names, ground is `0`. Every step is a join or an aggregate keyed by circuit and node, so that any
number of circuits of any size is rewritten at once.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.store import broadcast_if_small, forget, stored
from . import ranks
from .graph import connected_components, potentials

GROUND = "0"
MOST_BROADCAST = 200_000  # sources: a circuit's, two nodes' and a source's name and two doubles each
FIELDS = ["circuit", "kind", "name", "node1", "node2", "value", "pulse"]


def fail(when: Column, message: Column, otherwise: Column) -> Column:
    return F.when(when, F.raise_error(message).cast("string")).otherwise(otherwise)


def columns(parts: DataFrame) -> list[str]:
    """FIELDS, and line_no where parts have it: the place of a component in its netlist."""
    return FIELDS + [c for c in ("line_no",) if c in parts.columns]


def merge_parallel(parts: DataFrame, kind: str) -> DataFrame:
    """Resistors (1 / sum of 1/R) or capacitors (sum of C) between one pair of nodes become one; single ones stay as they are.

    The merged one is named after the two names of a pair, or after the least and largest and their number, so that
    no name grows with the data; merged_names lists them all. It stands on the first line of its parts. A resistor of 0
    ohms fails the job by name. Values, numbers and directions add up in a hash aggregate unless names are asked for.
    """
    mine = parts.where(F.col("kind") == kind)
    ohms = F.when(F.col("value") == 0, F.raise_error(F.concat(F.lit("a resistor of 0 ohms: "), F.col("name"))).cast("double")).otherwise(F.col("value"))
    value = 1 / F.sum(1 / ohms) if kind == "r" else F.sum("value")
    lo, hi = F.least("node1", "node2").alias("lo"), F.greatest("node1", "node2").alias("hi")
    lines = [F.min("line_no").alias("line_no")] if "line_no" in parts.columns else []
    g = mine.groupBy("circuit", lo, hi).agg(value.alias("v"), F.count(F.lit(1)).alias("n"), F.min("name").alias("first"), F.max("name").alias("last"), F.max(F.col("node1") > F.col("node2")).alias("down"), *lines)
    one = F.col("n") == 1
    merged = g.select(
        "circuit",
        F.lit(kind).alias("kind"),
        F.when(one, F.col("first")).when(F.col("n") == 2, F.concat_ws("_", F.lit(f"{kind}_merged"), "first", "last")).otherwise(F.concat_ws("_", F.lit(f"{kind}_merged"), "first", F.lit("to"), "last", F.lit("of"), "n")).alias("name"),
        F.when(one & F.col("down"), F.col("hi")).otherwise(F.col("lo")).alias("node1"),
        F.when(one & F.col("down"), F.col("lo")).otherwise(F.col("hi")).alias("node2"),
        F.col("v").alias("value"),
        F.lit(None).cast(parts.schema["pulse"].dataType).alias("pulse"),
        *(["line_no"] if lines else []),
    )
    return parts.where(F.col("kind") != kind).select(*columns(parts)).unionByName(merged)


def merged_names(parts: DataFrame, kind: str) -> DataFrame:
    """(circuit, node1, node2, name): what merge_parallel puts together, a row for each component."""
    return parts.where(F.col("kind") == kind).select("circuit", F.least("node1", "node2").alias("node1"), F.greatest("node1", "node2").alias("node2"), "name")


def short_circuit_map(parts: DataFrame) -> DataFrame:
    """(circuit, node, rep) of nodes that sources of exactly 0 volts tie together; ground represents its own group."""
    key = lambda n: F.concat("circuit", F.lit("\x01"), F.when(F.col(n) == GROUND, "").otherwise(F.col(n)))
    edges = parts.where("kind = 'v' and value = 0").select(key("node1").alias("a"), key("node2").alias("b"))
    name = lambda c: F.when(F.element_at(F.split(c, "\x01"), -1) == "", GROUND).otherwise(F.element_at(F.split(c, "\x01"), -1))
    return connected_components(edges).select(F.split("node", "\x01")[0].alias("circuit"), name("node").alias("node"), name("component").alias("rep"))


def renamed(parts: DataFrame, names: DataFrame) -> DataFrame:
    """parts with both nodes replaced by names' (circuit, node, rep) where it has them."""
    kept = columns(parts)
    for end in ("node1", "node2"):
        parts = parts.join(names.select("circuit", F.col("node").alias(end), "rep"), ["circuit", end], "left").withColumn(end, F.coalesce("rep", end)).drop("rep")
    return parts.select(*kept)


def collapse_shorts(parts: DataFrame) -> DataFrame:
    """Nodes tied by 0-volt sources become one; those sources go."""
    return renamed(parts.where("not (kind = 'v' and value = 0)"), short_circuit_map(parts))


def ends(parts: DataFrame) -> DataFrame:
    """(circuit, node, other, name, value): each component seen from either end."""
    pair = F.array(F.struct(F.col("node1").alias("node"), F.col("node2").alias("other")), F.struct(F.col("node2").alias("node"), F.col("node1").alias("other")))
    return parts.select("circuit", "name", "value", F.explode(pair).alias("e")).select("circuit", "e.node", "e.other", "name", "value")


def grounded_ends(caps: DataFrame, ok: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """caps with at: the end where each changes places with its resistors, or "" where it has none and stays.

    caps: circuit, node1, node2, ord, one row for each pair of nodes; ok: circuit, node, ok, whether all resistors of a node
    have ground at their other end. Capacitors go by ord: each takes its first end if that is ok and no earlier one has taken
    it, else its second, as if they came one after the other. Each round all ask at once; a node keeps the earliest that has
    asked and the others go on to their next end, so that an earlier one that comes late still gets its turn.
    """
    side = lambda k: ok.select("circuit", F.col("node").alias(f"node{k}"), F.col("ok").alias(f"ok{k}"))
    met = caps.join(side(1), ["circuit", "node1"], "left").join(side(2), ["circuit", "node2"], "left")
    # no resistor at all counts as ok, and takes nothing
    end = lambda k: F.when(F.col(f"ok{k}").isNull(), F.array(F.lit(""))).when(F.col(f"ok{k}"), F.array(f"node{k}")).otherwise(F.expr("cast(array() as array<string>)"))
    state = met.select("circuit", "node1", "node2", "ord", F.concat(end(1), end(2)).alias("ends"), F.lit(0).alias("k"))
    state = stored(state.withColumn("at", F.get("ends", "k")), "capacitor-ends")
    for _ in range(max_rounds):
        first = state.where("at <> ''").groupBy("circuit", "at").agg(F.min("ord").alias("first"))
        met = state.join(first, ["circuit", "at"], "left").withColumn("late", F.col("ord") > F.coalesce("first", "ord"))
        met = met.withColumn("k", F.col("k") + F.col("late").cast("int"))
        last, state = state, stored(met.select("circuit", "node1", "node2", "ord", "ends", "k", "late", F.get("ends", "k").alias("at")), "capacitor-ends")
        forget(last)
        if not state.where("late").limit(1).count():
            return state
    raise RuntimeError(f"capacitors did not settle in {max_rounds} rounds")


def ground_capacitors(parts: DataFrame) -> DataFrame:
    """A capacitor in series with resistors to ground changes places with them, so that it is grounded.

    It does so at its first end, else its second, if all resistors there have ground at their other end; they then lead to
    its other end. Capacitors go by line (by name, where parts have no line_no): what an earlier one has moved no longer leads to
    ground for a later one. One without such an end fails the job; one with an end without any resistor stays, and the
    assembly refuses it. Capacitors between one pair of nodes go together.
    """
    kept = columns(parts)
    floating = F.coalesce((F.col("kind") == "c") & (F.col("node1") != GROUND) & (F.col("node2") != GROUND), F.lit(False))
    r = ends(parts.where("kind = 'r'"))
    ok = r.groupBy("circuit", "node").agg(F.min((F.col("other") == GROUND).cast("int")).cast("boolean").alias("ok"))
    caps = parts.where(floating).select(*kept)
    pair = [F.least("node1", "node2").alias("lo"), F.greatest("node1", "node2").alias("hi")]
    by = [c for c in ("line_no", "name", "node1", "node2") if c in kept]
    pairs = caps.groupBy("circuit", *pair).agg(F.min(F.struct(*by)).alias("ord")).select("circuit", "ord.node1", "ord.node2", "ord")
    settled = grounded_ends(pairs, ok)
    failing = F.raise_error(F.concat(F.lit("no grounded end for capacitor "), F.col("ord.name"))).cast("string")
    at = F.when(F.col("at").isNull(), failing).otherwise(F.col("at"))
    settled = settled.select("circuit", *pair, at.alias("at"), F.when(F.col("at") == F.col("node1"), F.col("node2")).otherwise(F.col("node1")).alias("to"))
    moved = caps.withColumns({"lo": pair[0], "hi": pair[1]}).join(settled, ["circuit", "lo", "hi"])
    there = F.col("at") != ""
    moved = moved.withColumn("node1", F.when(there, F.col("at")).otherwise(F.col("node1"))).withColumn("node2", F.when(there, GROUND).otherwise(F.col("node2")))
    by_node = settled.where(there).select("circuit", F.col("at").alias("hot"), "to")
    hot = F.when(F.col("node1") == GROUND, F.col("node2")).when(F.col("node2") == GROUND, F.col("node1"))
    res = parts.where("kind = 'r'").withColumn("hot", hot).join(by_node, ["circuit", "hot"], "left")
    for end in ("node1", "node2"):
        res = res.withColumn(end, F.when(F.col("to").isNotNull() & (F.col(end) == GROUND), F.col("to")).otherwise(F.col(end)))
    rest = parts.where(~floating & (F.col("kind") != "r")).select(*kept)
    return rest.unionByName(moved.select(*kept)).unionByName(res.select(*kept))


def terminals(parts: DataFrame) -> DataFrame:
    """(circuit, gone, base, lift, v): terminals of sources that vanish, what stands for each, the voltage over it, a source's name.

    A source gives up its first end, unless that is ground or has no resistor, then the second. Sources that share terminals
    other than ground or form chains are one group, whose base is ground, or the least node that none of them would give up.
    A group without a resistor at any end but ground fails the job, and so do voltages that contradict each other.
    """
    v = parts.where("kind = 'v' and value <> 0").select("circuit", F.col("name").alias("v"), "node1", "node2", F.col("value").alias("volt"))
    each = v.select("circuit", F.explode(F.array("node1", "node2")).alias("node")).where(F.col("node") != GROUND)
    many = each.groupBy("circuit", "node").count()
    r = ends(parts.where("kind = 'r'")).select("circuit", "node")
    has = r.join(broadcast_if_small(many.select("circuit", "node"), MOST_BROADCAST), ["circuit", "node"], "left_semi").distinct().withColumn("has", F.lit(True))
    seen = many.join(has, ["circuit", "node"], "left")
    for k in (1, 2):
        v = v.join(seen.select("circuit", F.col("node").alias(f"node{k}"), F.col("count").alias(f"count{k}"), F.coalesce("has", F.lit(False)).alias(f"has{k}")), ["circuit", f"node{k}"], "left")
    v = v.withColumn("up", F.when(F.col("has1"), F.col("node1")).when(F.col("has2"), F.col("node2")))
    v = stored(v.withColumn("chained", (F.coalesce("count1", F.lit(1)) > 1) | (F.coalesce("count2", F.lit(1)) > 1)), "sources")
    first = F.col("up") == F.col("node1")
    alone = v.where("not chained").withColumn("gone", F.when(F.col("up").isNull(), unusable("v")).otherwise(F.col("up")))
    out = alone.select("circuit", "gone", F.when(first, F.col("node2")).otherwise(F.col("node1")).alias("base"), F.when(first, F.col("volt")).otherwise(-F.col("volt")).alias("lift"), "v")
    return out.unionByName(chained_terminals(v.where("chained"))) if v.where("chained").limit(1).count() else out


def unusable(name: str) -> Column:
    return F.raise_error(F.concat(F.lit("no usable terminal for source "), F.col(name))).cast("string")


def chained_terminals(v: DataFrame) -> DataFrame:
    """What terminals gives, of groups of sources: circuit, v, node1, node2, volt, has1, has2 (resistors at an end), up (the end given up)."""
    key = lambda n: F.concat("circuit", F.lit("\x01"), F.when(F.col(n) == GROUND, "").otherwise(F.col(n)))
    lifts = potentials(v.select(key("node1").alias("a"), key("node2").alias("b"), F.col("volt").alias("lift")))
    end = lambda k: F.struct(key(f"node{k}").alias("node"), (F.col(f"node{k}") == F.col("up")).alias("up"), F.coalesce(f"has{k}", F.lit(False)).alias("has"))
    told = v.select("v", F.explode(F.array(end(1), end(2))).alias("e"))
    nodes = told.groupBy(F.col("e.node").alias("node")).agg(F.min("v").alias("v"), F.coalesce(F.max("e.up"), F.lit(False)).alias("up"), F.max("e.has").alias("has"))
    nodes = stored(nodes.join(lifts, "node"), "terminals")
    part = lambda c, k: F.split(c, "\x01")[k]
    order = F.struct((part("node", 1) != "").alias("a"), F.col("up").alias("b"), F.col("node").alias("c"))
    roots = nodes.groupBy("component").agg(F.min_by(F.struct("node", "lift"), order).alias("root"), F.max("has").alias("any"), F.min("v").alias("one"))
    base = F.when(F.col("any"), F.col("root.node")).otherwise(unusable("one"))
    met = nodes.join(roots.select("component", base.alias("base"), F.col("root.lift").alias("below")), "component").where("node <> base")
    name = lambda c: F.when(part(c, 1) == "", GROUND).otherwise(part(c, 1))
    return stored(met.select(part("node", 0).alias("circuit"), name("node").alias("gone"), name("base").alias("base"), (F.col("lift") - F.col("below")).alias("lift"), "v"), "lifted")


def norton(parts: DataFrame) -> DataFrame:
    """Sources of a voltage other than 0 and the resistors at their terminals become current sources and rewired resistors.

    Terminals vanish (see terminals), chained and shared ones too: a resistor at one leads to its base instead, and a current
    of lift over resistance runs beside it. Only the constant voltage counts, a pulse on it doesn't. A resistor between two
    such terminals is rewired at both ends; one whose ends come together carries a current through sources alone and goes.
    What else hangs on a vanished terminal fails the job. Few terminals are broadcast to the resistors, so that a busy one is
    no hot key; many shuffle.
    """
    kept = columns(parts)
    t = terminals(parts)
    few = broadcast_if_small(t, MOST_BROADCAST)
    r = parts.where("kind = 'r'")
    for k in (1, 2):
        r = r.join(few.select("circuit", F.col("gone").alias(f"node{k}"), F.col("base").alias(f"base{k}"), F.col("lift").alias(f"lift{k}"), F.col("v").alias(f"v{k}")), ["circuit", f"node{k}"], "left")
    r = r.withColumn("new1", F.coalesce("base1", "node1")).withColumn("new2", F.coalesce("base2", "node2")).where("new1 <> new2 or node1 = node2")
    none = F.lit(None).cast(parts.schema["pulse"].dataType).alias("pulse")

    def row(kind, name, node1, node2, value):
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), node1.alias("node1"), node2.alias("node2"), value.alias("value"))

    def flow(k, other):
        up = F.col(f"lift{k}") >= 0  # the current runs from the base up to the other end, or the other way about
        name = F.concat(F.lit("i_"), F.col(f"v{k}"), F.lit("_"), F.col("name"))
        return F.when(F.col(f"base{k}").isNotNull(), row("i", name, F.when(up, F.col(f"base{k}")).otherwise(F.col(other)), F.when(up, F.col(other)).otherwise(F.col(f"base{k}")), F.abs(f"lift{k}") / F.col("value")))

    made = F.filter(F.array(row("r", F.col("name"), F.col("new1"), F.col("new2"), F.col("value")), flow(1, "new2"), flow(2, "new1")), lambda x: x.isNotNull())
    rewired = r.select("circuit", F.explode(made).alias("p"), *(["line_no"] if "line_no" in kept else [])).select("circuit", "p.*", none, *(["line_no"] if "line_no" in kept else []))
    rest = parts.where("kind not in ('r', 'v')").select(*kept)
    for k in (1, 2):
        rest = rest.join(few.select("circuit", F.col("gone").alias(f"node{k}"), F.lit(True).alias("lost")), ["circuit", f"node{k}"], "left")
        rest = rest.withColumn(f"node{k}", fail(F.col("lost").isNotNull(), F.concat(F.lit("a source's terminal is gone: "), F.col("name")), F.col(f"node{k}"))).drop("lost")
    return rest.select(*kept).unionByName(rewired.select(*kept))


def fill_capacitors(parts: DataFrame) -> DataFrame:
    """Every node but ground without a capacitor gets one to ground of the circuit's mean; none where there are none at all."""
    nodes = ends(parts).where(F.col("node") != GROUND).select("circuit", "node").distinct()
    caps = parts.where("kind = 'c'")
    bare = nodes.join(ends(caps).select("circuit", "node").distinct(), ["circuit", "node"], "left_anti")
    mean = caps.groupBy("circuit").agg(F.avg("value").alias("value"))
    new = bare.join(mean, "circuit").select("circuit", F.lit("c").alias("kind"), F.concat(F.lit("c_filled_"), F.col("node")).alias("name"), F.col("node").alias("node1"), F.lit(GROUND).alias("node2"), "value", F.lit(None).cast(parts.schema["pulse"].dataType).alias("pulse"))
    lines = [F.lit(None).cast(parts.schema["line_no"].dataType).alias("line_no")] if "line_no" in parts.columns else []
    return parts.select(*columns(parts)).unionByName(new.select("*", *lines))


def first_seen(parts: DataFrame, shorts: DataFrame | None = None) -> DataFrame:
    """(circuit, node, at): the place of each node's first occurrence, its line first, then the end of the component.

    shorts: (circuit, node, rep) of nodes that become one (see short_circuit_map), which is seen where the first of them is.
    """
    at = [F.struct(F.col(f"node{k}").alias("node"), (F.col("line_no").cast("long") * 2 + k - 1).alias("at")) for k in (1, 2)]
    seen = parts.select("circuit", F.explode(F.array(*at)).alias("e")).groupBy("circuit", "e.node").agg(F.min("e.at").alias("at"))
    if shorts is None:
        return seen
    named = seen.join(shorts, ["circuit", "node"], "left").withColumn("node", F.coalesce("rep", "node"))
    return named.groupBy("circuit", "node").agg(F.min("at").alias("at"))


def node_numbers(parts: DataFrame, seen: DataFrame | None = None, most: int = ranks.MOST) -> DataFrame:
    """(circuit, node, idx): ground 0, the others from 1 on, first seen first; a component with equal ends fails the job.

    seen: of first_seen over the netlist as it was read, if parts are what rewrites left of it; else parts' own lines count, and
    names where they have none. A circuit of over `most` nodes is numbered range by range.
    """
    same = fail(F.col("node1") == F.col("node2"), F.concat(F.lit("both ends alike: "), F.col("name")), F.col("node1"))
    parts = parts.withColumn("node1", same)
    nodes = ends(parts).where(F.col("node") != GROUND).select("circuit", "node").distinct()
    if seen is None and "line_no" in parts.columns:
        nodes = first_seen(parts).where(F.col("node") != GROUND)
    elif seen is not None:
        nodes = nodes.join(seen, ["circuit", "node"], "left")
    order = [c for c in ("at", "node") if c in nodes.columns]
    numbered = ranks.ranked(nodes, ["circuit"], order, "idx", most).select("circuit", "node", "idx")
    return numbered.unionByName(parts.select("circuit").distinct().select("circuit", F.lit(GROUND).alias("node"), F.lit(0).cast("long").alias("idx")))


def node_indices(names: DataFrame, numbers: DataFrame, node_col: str = "node") -> DataFrame:
    """names (circuit, node and whatever else) with idx, its row in a matrix: -1 for ground, whichever way it is spelled.

    numbers: of node_numbers. An unknown name fails the job.
    """
    alias = F.when(F.lower(F.col(node_col)).isin("0", "gnd"), GROUND).otherwise(F.col(node_col))
    found = names.withColumn("_node", alias).join(numbers.select("circuit", F.col("node").alias("_node"), "idx"), ["circuit", "_node"], "left")
    unknown = F.raise_error(F.concat(F.lit("unknown node: "), F.col("_node"))).cast("long")
    return found.withColumn("idx", F.when(F.col("idx").isNull(), unknown).otherwise(F.col("idx") - 1)).drop("_node")


def reduced(parts: DataFrame, fill: bool = True, phases: list[dict] | None = None) -> DataFrame:
    """All rewrites in their order: parallel parts, shorts, series capacitors, sources, missing capacitors.

    Each stage reads its input several times, so each is written to the shared folder: the plans don't multiply.
    phases, if given, gets a row for each stage: its seconds, and how many components of each kind it left, counted as
    they were written.
    """
    out = parts.select(*columns(parts))
    for stage in (merged_parallels, collapse_shorts, ground_capacitors, norton, *([fill_capacitors] if fill else [])):
        seen, began = Observation(), time.perf_counter()
        counts = [F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in "rciv"]
        last, out = out, stored(stage(out).observe(seen, *counts), stage.__name__)
        if phases is not None:
            phases.append({"phase": stage.__name__, "seconds": time.perf_counter() - began, **seen.get})
        if stage is not merged_parallels:
            forget(last)
    return out


def merged_parallels(parts: DataFrame) -> DataFrame:
    return merge_parallel(merge_parallel(parts, "r"), "c")
