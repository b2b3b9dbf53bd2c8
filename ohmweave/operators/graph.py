"""Connected components by star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import forget, join_split, made_of, stored


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given as columns (a, b) of one ordered type.

    Returns (node, component) for every node of an edge; component is the least node reachable.
    Alternates large-star and small-star rounds: each is a partial aggregate and an equi-join, whose
    frequent nodes (hubs) are joined by broadcast, so that neither a neighbourhood nor a component is
    gathered in one task. Every round is written to the shared folder, the one before it deleted. Self loops, repeated and reversed edges are allowed; null ends are ignored.
    The result reads one stored table, which forget(result) deletes.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    e = stored(e, "edges")

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = state(e)
    for _ in range(max_rounds if before[0] else 0):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.col("n"), F.min("b")).alias("m"))
        large = join_split(both.withColumnRenamed("a", "n"), least, "n", total=2 * before[0]).where("b > n").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        # a node's smaller neighbours are few after the large star, so this join has no hub
        joined = large.join(least, large.a == least.n)
        ends = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        last, e = e, stored(joined.select(ends.alias("e")).select("e.a", "e.b").where("a > b").distinct(), "edges")
        forget(last)
        after = state(e)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return made_of(e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), e)


def merged_components(known: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) after more edges (a, b): known is what connected_components gave for the edges before, which aren't read.

    The new edges are contracted to the components of their ends; the components of that smaller graph say which of the old ones
    fall together, and only what changes is renamed. Nodes that are new come in with their edges.
    """
    e = stored(edges.where("a is not null and b is not null").select("a", "b").distinct(), "new-edges")
    ends = stored(e.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "new-ends")
    roots = ends.join(known, "node", "left").select("node", F.coalesce("component", "node").alias("root"))
    roots = stored(roots, "new-roots")
    side = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    between = join_split(join_split(e, side("a"), "a"), side("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()
    merged = connected_components(between).select(F.col("node").alias("component"), F.col("component").alias("merged"))
    new = ends.join(known.select("node"), "node", "left_anti").withColumn("component", F.col("node"))
    renamed = join_split(known.select("node", "component").unionByName(new), merged.where("component <> merged"), "component", "left")
    return renamed.select("node", F.coalesce("merged", "component").alias("component"))


def potentials(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component, lift) of nodes whose differences are given: edges (a, b, lift) say value(a) - value(b) = lift.

    component is the least node of each connected group, lift the node's value over that one's. Each round hooks every root
    that has an edge to a smaller one onto the least of these, then halves all pointers until they are flat, adding lifts
    on the way. A difference that contradicts others fails the job; rounding is borne.
    """
    e = stored(edges.select("a", "b", F.col("lift").cast("double").alias("lift")), "differences")
    at = stored(e.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component"), F.lit(0.0).alias("lift")), "potentials")

    def seen(at: DataFrame) -> DataFrame:
        side = lambda c: at.select(F.col("node").alias(c), F.col("component").alias(f"root_{c}"), F.col("lift").alias(f"lift_{c}"))
        return e.join(side("a"), "a").join(side("b"), "b")

    for _ in range(max_rounds):
        apart = seen(at).where("root_a <> root_b").withColumn("d", F.col("lift") - F.col("lift_a") + F.col("lift_b"))
        lower = F.col("root_b") < F.col("root_a")
        hook = F.struct(F.least("root_a", "root_b").alias("to"), F.when(lower, F.col("d")).otherwise(-F.col("d")).alias("by"))
        hooks = stored(apart.groupBy(F.greatest("root_a", "root_b").alias("root")).agg(F.min(hook).alias("h")).select("root", "h.to", "h.by"), "hooks")
        if not hooks.limit(1).count():
            forget(hooks)
            break
        while True:
            onward = hooks.select(F.col("root").alias("to"), F.col("to").alias("next"), F.col("by").alias("more"))
            if not hooks.join(onward, "to", "left_semi").limit(1).count():
                break
            jumped = hooks.join(onward, "to", "left").select("root", F.coalesce("next", "to").alias("to"), (F.col("by") + F.coalesce("more", F.lit(0.0))).alias("by"))
            last, hooks = hooks, stored(jumped, "hooks")
            forget(last)
        moved = join_split(at, hooks.withColumnRenamed("root", "component"), "component", "left")
        last, at = at, stored(moved.select("node", F.coalesce("to", "component").alias("component"), (F.col("lift") + F.coalesce("by", F.lit(0.0))).alias("lift")), "potentials")
        forget(last, hooks)
    else:
        raise RuntimeError(f"potentials did not settle in {max_rounds} rounds")
    gap = F.abs(F.col("lift_a") - F.col("lift_b") - F.col("lift"))
    wrong = seen(at).where(gap > 1e-9 * (1 + F.abs("lift") + F.abs("lift_a") + F.abs("lift_b"))).select("a", "b").limit(1).collect()
    if wrong:
        raise ValueError(f"contradicting differences between {wrong[0].a!r} and {wrong[0].b!r}")
    forget(e)
    return at
