"""The driver's queries: each applies operators to whole given tables, beside the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import uniform as rnd
from ..functions import waveform as wf
from ..operators import assemble, generate, graph, matrix, metrics, netlist, ranks, stepper, walk
from ..sources import matrix_text, netlist_text, results
from ..sources.store import forget, shared_dir, stored, table
from . import commands, sweeps

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def r(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def text(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def no_pulse() -> Column:
    return F.lit(None).cast(wf.PULSE)


def line_parts(spark, sf_dir, kind: str, circuit: Column, value: Column, *more: Column) -> DataFrame:
    """Every line item as a component between its part and its supplier."""
    li = table(spark, sf_dir, "lineitem")
    name = F.concat(F.lit(kind), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"))
    return li.select(circuit.alias("circuit"), F.lit(kind).alias("kind"), name.alias("name"), text("p", "l_partkey").alias("node1"), text("s", "l_suppkey").alias("node2"), value.cast("double").alias("value"), no_pulse().alias("pulse"), *more)


def seconds(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


@registered("select 'p' || l_partkey node1, 's' || l_suppkey node2, round(1 / sum(1 / l_quantity), 6) as value from lineitem group by all")
def q01_parallel_resistors(spark, sf_dir):
    return netlist.merge_parallel(line_parts(spark, sf_dir, "r", F.lit("all"), F.col("l_quantity")), "r").select("node1", "node2", r("value").alias("value"))


@registered("select 'p' || l_partkey node1, 's' || l_suppkey node2, round(sum(l_quantity), 6) as value, count(*) = 1 single from lineitem group by all")
def q02_parallel_capacitors(spark, sf_dir):
    return netlist.merge_parallel(line_parts(spark, sf_dir, "c", F.lit("all"), F.col("l_quantity")), "c").select("node1", "node2", r("value").alias("value"), (~F.col("name").startswith("c_merged_")).alias("single"))


STAMPS = """g as (select l_returnflag c, 'p' || l_partkey a, 's' || l_suppkey b, 1 / l_quantity g from lineitem),
e as (select c circuit, a as row, a col, g v from g union all select c, b, b, g from g union all select c, a, b, -g from g union all select c, b, a, -g from g),
m as (select circuit, row, col, sum(v) v from e group by all)"""


def conductance_of_lines(spark, sf_dir):
    return assemble.conductances(line_parts(spark, sf_dir, "r", F.col("l_returnflag"), F.col("l_quantity")))


@registered(f"with {STAMPS} select circuit, row, col, round(v, 6) as value from m")
def q03_conductance_stamps(spark, sf_dir):
    return conductance_of_lines(spark, sf_dir).select("circuit", "row", "col", r("value").alias("value"))


@registered("""with m as (select l_returnflag circuit, l_partkey as row, l_suppkey col, sum(l_quantity) v from lineitem group by all),
d as (select circuit, row, sum(v) d from m group by all),
l as (select circuit, row, col, v from m union all select circuit, row, row, -d from d),
s as (select circuit, row, col, sum(v) v from l group by all)
select circuit, row, round(any_value(d), 6) row_sum, round(sum(v) filter (row = col), 6) diagonal, abs(round(sum(v), 6)) rest from s join d using (circuit, row) group by circuit, row""")
def q04_row_sum_split(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("circuit"), F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col"), F.col("l_quantity").alias("value"))
    d, rest = matrix.row_sum_split(e, ["circuit"])
    g = rest.groupBy("circuit", "row").agg(F.sum(F.when(F.col("row") == F.col("col"), F.col("value"))).alias("diagonal"), F.sum("value").alias("rest"))
    return d.join(g, ["circuit", "row"]).select("circuit", "row", r("value").alias("row_sum"), r("diagonal").alias("diagonal"), F.abs(r("rest")).alias("rest"))


def embedding_cells(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.posexplode("embedding").alias("pos", "x")).select("vec_id", "label", F.col("pos").cast("long").alias("pos"), F.col("x").cast("double").alias("value"))


CELLS = "c as (select vec_id, label, unnest(range(len(embedding))) pos, unnest(embedding)::double x from embeddings)"


@registered(f"with {CELLS} select vec_id idx, round(sum(x / (pos + 1)), 6) as value from c group by vec_id")
def q05_matrix_vector(spark, sf_dir):
    cells = embedding_cells(spark, sf_dir)
    x = cells.select(F.col("pos").alias("idx"), (1.0 / (F.col("pos") + 1)).alias("value")).distinct()
    return matrix.times(cells.select(F.col("vec_id").alias("row"), F.col("pos").alias("col"), "value"), x).select("idx", r("value").alias("value"))


@registered("""with e as (select l_suppkey as row, l_partkey col, sum(l_quantity) v from lineitem group by all),
z as (select row, col, v from e union all select distinct row, row, 0 from e),
s as (select row, col, sum(v) v from z group by all), p as (select *, (row_number() over (partition by row order by col <> row, col) - 1) // 64 block from s),
o as (select row, sum(count(*)) over (order by row) - count(*) first from s group by row)
select row, block::bigint block, count(*) nnz, any_value(first)::bigint first, round(sum(v) filter (row = col), 6) diagonal, string_agg(col, ',' order by col <> row, col) cols from p join o using (row) group by row, block""")
def q06_compressed_rows(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("value"))
    blocks = stored(matrix.rows_of(e, block=64), "blocks")
    head = F.when(F.col("block") == 0, F.get("entries", F.lit(0))["value"])
    out = blocks.join(matrix.row_offsets(blocks).select("row", F.col("at").alias("first")), "row")
    return out.select("row", "block", F.size("entries").cast("long").alias("nnz"), "first", r(head).alias("diagonal"), F.array_join(F.transform("entries", lambda c: c["col"].cast("string")), ",").alias("cols"))


@registered(f"""with {CELLS}, y as (select vec_id, (pos + 1) % 64 pos, x from c),
z as (select vec_id, pos, sum(v) v from (select vec_id, pos, -0.5 * x v from c union all select vec_id, pos, x from y) group by all)
select vec_id, round(sqrt(sum(z.v * z.v)), 6) as norm, round(sqrt(sum(z.v * z.v)) / sqrt(sum(y.x * y.x)), 6) residual from z join y using (vec_id, pos) group by vec_id""")
def q07_axpy_norm_residual(spark, sf_dir):
    cells = embedding_cells(spark, sf_dir)
    x = cells.select("vec_id", F.col("pos").alias("idx"), "value")
    y = x.select("vec_id", ((F.col("idx") + 1) % 64).alias("idx"), "value")
    half = x.select("vec_id", F.col("idx").alias("row"), F.col("idx").alias("col"), F.lit(0.5).alias("value"))
    gap = matrix.residual(half, x, y, ["vec_id"])
    return matrix.norm(matrix.axpy(-0.5, x, y, ["vec_id"]), ["vec_id"]).join(gap, "vec_id").select("vec_id", r("norm").alias("norm"), r("residual").alias("residual"))


@registered(f"""with {CELLS}, m as (select label, pos // 8 as row, pos % 8 col, sum(x) v from c group by all),
i as (select distinct label, unnest(range(8)) k from m)
select label, row, col, round(sum(v), 6) as value from (select label, row, col, -0.25 * v v from m union all select label, k, k, 1.0 from i) group by all""")
def q08_scale_and_add(spark, sf_dir):
    cells = embedding_cells(spark, sf_dir).select("label", F.floor(F.col("pos") / 8).alias("row"), (F.col("pos") % 8).alias("col"), "value")
    m = matrix.summed(cells, ["label"])
    eye = m.select("label", F.col("row"), F.col("row").alias("col"), F.lit(1.0).alias("value")).distinct()
    return matrix.added(eye, m, 1.0, -0.25, ["label"]).select("label", "row", "col", r("value").alias("value"))


@registered("""with recursive e as (select 'p' || l_partkey a, 's' || l_suppkey b from lineitem where l_quantity = 1 and l_discount = 0),
b as (select a, b from e union select b, a from e),
c(node, rep) as (select a, a from b union select b.b, c.rep from c join b on b.a = c.node)
select node, min(rep) rep from c group by node""")
def q09_short_circuits(spark, sf_dir):
    volts = (F.col("l_quantity") - 1) + F.col("l_discount")
    return netlist.short_circuit_map(line_parts(spark, sf_dir, "v", F.lit("all"), volts)).select("node", "rep")


@registered("""select 'i_v' || s_suppkey || '_r' || l_orderkey || '_' || l_linenumber as name, case when s_acctbal > 0 then '0' else 'p' || l_partkey end node1, case when s_acctbal > 0 then 'p' || l_partkey else '0' end node2,
round(abs(s_acctbal) / l_quantity, 9) as value from lineitem join supplier on s_suppkey = l_suppkey where s_acctbal <> 0""")
def q10_norton(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    v = s.select(F.lit("all").alias("circuit"), F.lit("v").alias("kind"), text("v", "s_suppkey").alias("name"), text("s", "s_suppkey").alias("node1"), F.lit("0").alias("node2"), F.col("s_acctbal").alias("value"), no_pulse().alias("pulse"))
    out = netlist.norton(line_parts(spark, sf_dir, "r", F.lit("all"), F.col("l_quantity")).unionByName(v))
    return out.where("kind = 'i'").select("name", "node1", "node2", r("value", 9).alias("value"))


@registered("""with o as (select l_orderkey k, bool_and(l_returnflag = 'N') free, l_orderkey % 2 = 0 e from lineitem group by 1),
n as (select k, e, case when free and not e then 1 when free then 2 when not e then 3 else 4 end w from o)
select 'r' || k || '_' || l_linenumber as name, 'a' node1, case when l_returnflag <> 'N' then 'x' when w = 1 then 'b' when w = 2 then 'z' else '0' end node2 from lineitem join n on k = l_orderkey
union all select 'b' || k, 'b', case w when 1 then 'g' else 'a' end from n
union all select 'e' || k, 'd', 'a' from n
union all select 'h' || k, 'g', case w when 1 then '0' else 'b' end from n
union all select 'y' || k, 'z', case w when 4 then 'a' else '0' end from n where e
union all select 'a' || k, case w when 2 then 'a' else 'z' end, '0' from n where e
union all select 'c' || k, case w when 1 then 'a' else 'b' end, '0' from n
union all select 'd' || k, 'd', '0' from n
union all select 'f' || k, case w when 1 then 'b' else 'g' end, '0' from n""")
def q11_series_capacitors(spark, sf_dir):
    """Every order is a circuit whose capacitors a, c, d and f want the nodes a, b, d, g and z, some of them the same, in this order."""
    li = table(spark, sf_dir, "lineitem")
    circuit = F.col("l_orderkey").cast("string").alias("circuit")
    part = lambda kind, name, a, b: F.struct(F.lit(kind).alias("kind"), name.alias("name"), F.lit(a).alias("node1"), b.alias("node2"))
    fixed = [part("r", text(k, "l_orderkey"), a, F.lit("0")) for k, a in (("b", "b"), ("e", "d"), ("h", "g"))] + [part("c", text(k, "l_orderkey"), a, F.lit(b)) for k, a, b in (("c", "a", "b"), ("d", "a", "d"), ("f", "b", "g"))]
    even = [part("r", text("y", "l_orderkey"), "z", F.lit("0")), part("c", text("a", "l_orderkey"), "a", F.lit("z"))]
    item = part("r", F.concat(text("r", "l_orderkey"), F.lit("_"), F.col("l_linenumber").cast("string")), "a", F.when(F.col("l_returnflag") == "N", "0").otherwise("x"))
    orders = li.select("l_orderkey").distinct().select(circuit, F.explode(F.when(F.col("l_orderkey") % 2 == 0, F.array(*fixed, *even)).otherwise(F.array(*fixed))).alias("p"))
    made = li.select(circuit, item.alias("p")).unionByName(orders).select("circuit", "p.*", F.lit(1.0).alias("value"), no_pulse().alias("pulse"))
    parts = stored(made, "parts")
    return netlist.ground_capacitors(parts).select("name", "node1", "node2")


@registered("""with u as (select c_nationkey n, c_custkey, o_totalprice v from customer join orders on o_custkey = c_custkey where o_orderpriority = '1-URGENT'), m as (select n, avg(v) a from u group by n)
select c_nationkey::varchar circuit, 'c' || c_custkey node, round(a, 3) as value from customer join m on n = c_nationkey where not exists (select 1 from u where u.c_custkey = customer.c_custkey)""")
def q12_missing_capacitors(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    make = lambda df, kind, name, value: df.select(F.col("c_nationkey").cast("string").alias("circuit"), F.lit(kind).alias("kind"), name.alias("name"), text("c", "c_custkey").alias("node1"), F.lit("0").alias("node2"), value.alias("value"), no_pulse().alias("pulse"))
    caps = make(o.where("o_orderpriority = '1-URGENT'").join(c, o.o_custkey == c.c_custkey), "c", text("c", "o_orderkey"), F.col("o_totalprice"))
    parts = make(c, "r", text("r", "c_custkey"), F.lit(1.0)).unionByName(caps)
    return netlist.fill_capacitors(parts).where("name like 'c_filled_%'").select("circuit", F.col("node1").alias("node"), r("value", 3).alias("value"))


PULSE_SQL = """case when t < td or per = 0 then v1 when fmod(t - td, per) < tr then v1 + (v2 - v1) * fmod(t - td, per) / tr when fmod(t - td, per) < tr + pw then v2
when fmod(t - td, per) < tr + pw + tf then v2 + (v1 - v2) * (fmod(t - td, per) - tr - pw) / tf else v1 end"""


@registered(f"""select event_id, round({PULSE_SQL}, 6) as value from (select event_id, epoch_us(ts) % 86400000000 / 1e6 t, 0.5 v1, value v2, 3600.0 td, 600.0 tr, 1200.0 tf, 1800.0 pw, case when user_id % 10 = 0 then 0.0 else 7200.0 end per from events)""")
def q13_pulse(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp")) % 86400000000 / 1e6
    p = wf.pulse(v1=0.5, v2=F.col("value"), td=3600, tr=600, tf=1200, pw=1800, per=F.when(F.col("user_id") % 10 == 0, 0.0).otherwise(7200.0))
    return e.select("event_id", r(wf.pulse_at(p, t)).alias("value"))


@registered(f"""with p as (select user_id, 100.0 * length(event_type) td, 10.0 tr, 20.0 tf, 300.0 pw, 1000.0 per, sum(value) v1, sum(2 * value) v2 from events group by all),
a as (select user_id, v1 + 1 v1, v2 + 1 v2, td, tr, tf, pw, per, 5155.0 t from p)
select user_id, count(*) n_pulses, round(2.5 + sum({PULSE_SQL}), 4) as level from a group by user_id""")
def q14_sum_of_pulses(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    p = wf.pulse(v1=F.col("value"), v2=2 * F.col("value"), td=100 * F.length("event_type"), tr=10, tf=20, pw=300, per=1000)
    fused = wf.fused(e.select("user_id", p.alias("pulse")), ["user_id"])
    arrays = fused.groupBy("user_id").agg(F.collect_list(wf.shifted(F.struct(*wf.FIELDS).cast(wf.PULSE), 1.0)).alias("p"))
    return arrays.select("user_id", F.size("p").cast("long").alias("n_pulses"), r(wf.wave_at(F.lit(2.5), F.col("p"), F.lit(5155.0)), 4).alias("level"))


@registered("""select node, round(sum(v), 2) dc, round(sum(q), 2) capacitance from (select 'p' || l_partkey node, -l_extendedprice v, l_quantity q from lineitem union all select 's' || l_suppkey, l_extendedprice, 0 from lineitem) group by node""")
def q15_source_and_capacitor_stamps(spark, sf_dir):
    i = assemble.injections(line_parts(spark, sf_dir, "i", F.lit("all"), F.col("l_extendedprice")))
    caps = line_parts(spark, sf_dir, "c", F.lit("all"), F.col("l_quantity")).withColumn("node2", F.lit("0"))
    c = assemble.capacitances(caps).select("node", F.col("value").alias("c"))
    return i.join(c, "node", "left").select("node", r("dc", 2).alias("dc"), r(F.coalesce("c", F.lit(0.0)), 2).alias("capacitance"))


@registered(f"""with {STAMPS}, c as (select l_returnflag circuit, 'p' || l_partkey as row, sum(l_quantity) c from lineitem group by all union all select l_returnflag, 's' || l_suppkey, sum(l_quantity) from lineitem group by all)
select circuit, row, col, round(-v / c, 8) as value from m join c using (circuit, row)""")
def q16_ode_matrix(spark, sf_dir):
    parts = line_parts(spark, sf_dir, "c", F.col("l_returnflag"), F.col("l_quantity"))
    grounded = parts.withColumn("node2", F.lit("0")).unionByName(parts.withColumn("node1", F.lit("0")))
    return assemble.ode_matrix(conductance_of_lines(spark, sf_dir), assemble.capacitances(grounded)).select("circuit", "row", "col", r("value", 8).alias("value"))


@registered("""with k as (select user_id, epoch_us(ts) / 1e6 t, max(value) v from events group by all),
b as (select user_id, floor(min(t) / 86400)::bigint lo, floor(max(t) / 86400)::bigint + 1 hi from k group by user_id),
g as (select user_id, unnest(range(lo, hi + 1)) * 86400.0 t from b),
p as (select g.user_id, g.t, k.t pt, k.v pv from g asof left join k on g.user_id = k.user_id and g.t >= k.t),
n as (select p.*, k.t nt, k.v nv from p asof left join k on p.user_id = k.user_id and p.t <= k.t)
select user_id, t, round(case when pv is null then nv when nv is null or nt = pt then pv else pv + (nv - pv) * (t - pt) / (nt - pt) end, 6) as value from n""")
def q17_interpolation(spark, sf_dir):
    k = table(spark, sf_dir, "events").select("user_id", seconds().alias("t"), "value")
    span = k.groupBy("user_id").agg(F.floor(F.min("t") / 86400).alias("lo"), (F.floor(F.max("t") / 86400) + 1).alias("hi"))
    grid = span.select("user_id", (F.explode(F.sequence("lo", "hi"))).alias("d")).select("user_id", (F.col("d") * 86400.0).alias("t"))
    return metrics.interpolated(grid, k, ["user_id"]).select("user_id", "t", r("value").alias("value"))


WEIGHTS = """k as (select user_id, event_id, epoch_us(ts) / 1e6 t, value v from events),
h as (select *, (coalesce(lead(t) over o, t) - coalesce(lag(t) over o, t)) / 2 g from k window o as (partition by user_id order by t)),
w as (select *, case when sum(g) over u > 0 then g / sum(g) over u else 1.0 / count(*) over u end w from h window u as (partition by user_id))"""


@registered(f"with {WEIGHTS} select user_id, round(sum(w), 6) total, round(sum(w * v), 6) mean, round(sqrt(sum(w * v * v)), 6) rms from w group by user_id")
def q18_time_weights(spark, sf_dir):
    k = table(spark, sf_dir, "events").select("user_id", seconds().alias("t"), "value")
    w = metrics.time_weights(k, ["user_id"])
    return w.groupBy("user_id").agg(r(F.sum("w")).alias("total"), r(F.sum(F.col("w") * F.col("value"))).alias("mean"), r(F.sqrt(F.sum(F.col("w") * F.col("value") * F.col("value")))).alias("rms"))


@registered(f"""with {WEIGHTS}, l as (select *, lag(v) over (partition by user_id order by t) b from w),
e as (select user_id, w, abs(v - b) e, abs(v - b) / (abs(b) + 1e-10) r from l where b is not null)
select user_id, round(max(e), 6) max_abs, round(max(r), 6) max_rel, round(sum(w * e) / sum(w), 6) avg_abs, round(sum(w * r) / sum(w), 6) avg_rel, round(sqrt(sum(w * e * e) / sum(w)), 6) rms_abs, round(sqrt(sum(w * r * r) / sum(w)), 6) rms_rel from e group by user_id""")
def q19_error_metrics(spark, sf_dir):
    k = table(spark, sf_dir, "events").select("user_id", seconds().alias("t"), "value")
    pairs = metrics.with_previous(metrics.time_weights(k, ["user_id"]), ["user_id"], "t").where("want is not null")
    out = metrics.error_metrics(pairs, ["user_id"], "value", "want", F.col("w"))
    return out.select("user_id", *(r(c).alias(c) for c in out.columns[1:]))


@registered("""with l as (select event_type, value v, lag(value) over (partition by event_type order by event_id) b from events), e as (select event_type, abs(v - b) e from l where b is not null)
select event_type, round(avg(e), 6) mae, round(avg(e * e), 4) mse, round(sqrt(avg(e * e)), 6) rmse from e group by event_type""")
def q20_plain_errors(spark, sf_dir):
    k = metrics.with_previous(table(spark, sf_dir, "events"), ["event_type"], "event_id").where("want is not null")
    m = metrics.error_metrics(k, ["event_type"], "value", "want")
    return m.select("event_type", r("avg_abs").alias("mae"), r(F.col("rms_abs") * F.col("rms_abs"), 4).alias("mse"), r("rms_abs").alias("rmse"))


@registered("select user_id, max(value) as value, arg_max(event_id, {'v': value, 'e': event_id}) event_id from events group by user_id")
def q21_largest(spark, sf_dir):
    return metrics.largest(table(spark, sf_dir, "events"), ["user_id"], at="event_id")


@registered("select event_type, user_id, count(*) n, round(avg(value), 6) mean from events where value <> 0 and event_type <> 'view' group by all order by mean, user_id")
def q22_group_means(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value <> 0 and event_type <> 'view'")
    return metrics.group_means(e, ["event_type", "user_id"]).withColumn("mean", r("mean")).orderBy("mean", "user_id")


@registered("select user_id, round(exp(regr_intercept(ln(value), ln(event_id))), 4) k, round(regr_slope(ln(value), ln(event_id)), 6) alpha, round(regr_r2(ln(value), ln(event_id)), 6) r2 from events where value > 0 and event_id > 0 group by user_id")
def q23_power_fit(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(*metrics.power_fit(F.col("event_id").cast("double"), F.col("value")))
    return g.select("user_id", r("k", 4).alias("k"), r("alpha").alias("alpha"), r("r2").alias("r2"))


FIT = "f as (select event_type g, 1.0 + user_id % 8 p, value t from events)"


@registered(f"""with {FIT}, a as (select g, regr_slope(t, p) slope, regr_intercept(t, p) icept, regr_r2(t, p) r2, regr_slope(t, 1 / p) s, regr_intercept(t, 1 / p) i, avg(t) m, sum(t / p) / sum(1 / p / p) o,
sum(1 / p ** 4) uu, sum(1 / p ** 3) uv, sum(1 / p ** 2) vv, sum(t / p ** 2) uy, sum(t / p) vy from f group by g)
select g, round(slope, 6) slope, round(icept, 6) intercept, round(r2, 6) r2, round(case when s < 0 then m when i < 0 then 0 else i end, 6) serial, round(case when s < 0 then 0 when i < 0 then greatest(o, 0) else s end, 6) parallel,
round((uy * vv - vy * uv) / (uu * vv - uv * uv), 4) a, round((vy * uu - uy * uv) / (uu * vv - uv * uv), 4) b from a""")
def q24_fits(spark, sf_dir):
    f = table(spark, sf_dir, "events").select(F.col("event_type").alias("g"), (1.0 + F.col("user_id") % 8).alias("p"), F.col("value").alias("t"))
    line = f.groupBy("g").agg(*metrics.linear_fit(F.col("p"), F.col("t")))
    out = line.join(metrics.serial_parallel_fit(f, ["g"]), "g").join(metrics.reciprocal_fit(f, ["g"], "p", "t"), "g")
    return out.select("g", *(r(c).alias(c) for c in ("slope", "intercept", "r2", "serial", "parallel")), r("a", 4).alias("a"), r("b", 4).alias("b"))


@registered("""with recursive f as (select event_type g, 1.0 + user_id % 8 p, 1 + value / 100 y from events), t as (select g, p::double p, count(*) n, sum(y) sy, sum(y * y) syy from f group by all),
s as (select 0.001 + 0.998 * i / 98 s from (select unnest(range(99)) i)), l as (select g, s, sum(syy - 2 * sy / (s + (1 - s) / p) + n / (s + (1 - s) / p) ** 2) e from t, s group by all), b as (select g, arg_min(s, e) s from l group by g),
r(g, lo, hi, k) as (select g, greatest(s - 0.998 / 98, 0.001), least(s + 0.998 / 98, 0.999), 0 from b union all
 select g, case when d < 0 then mid else lo end, case when d < 0 then hi else mid end, k + 1 from (select r.g, lo, hi, k, any_value((lo + hi) / 2) mid, sum((1 / p - 1) * (n / ((lo + hi) / 2 + (1 - (lo + hi) / 2) / p) - sy) / ((lo + hi) / 2 + (1 - (lo + hi) / 2) / p) ** 2) d from r join t on t.g = r.g where k < 45 group by r.g, lo, hi, k)),
z as (select g, (lo + hi) / 2 s from r where k = 45)
select g, round(any_value(s), 6) s, round(sum(syy - 2 * sy / (s + (1 - s) / p) + n / (s + (1 - s) / p) ** 2), 5) left_over from t join z using (g) group by g""")
def q25_amdahl(spark, sf_dir):
    f = table(spark, sf_dir, "events").select(F.col("event_type").alias("g"), (1.0 + F.col("user_id") % 8).alias("p"), (1 + F.col("value") / 100).alias("speedup"))
    return metrics.amdahl_fit(f, ["g"]).select("g", r("s").alias("s"), r("left", 5).alias("left_over"))


OFFSET_MOMENTS = "sum(n) n, sum(n * x ** a) u, sum(n * x ** (2 * a)) uu, sum(x ** a * sy) uy, sum(sy) y, sum(ln(x) * x ** a * sy) vy, sum(n * ln(x) * x ** (2 * a)) vuu, sum(n * ln(x) * x ** a) vu"


@registered(f"""with recursive t as (select event_type g, 1.0::double + user_id % 8 x, count(*) n, sum(value) sy from events group by all), a as (select unnest(range(-30, 31)) / 10.0::double a),
m as (select g, a, {OFFSET_MOMENTS} from t, a where a <> 0 group by g, a), l as (select g, a, 0 - (uy - u * y / n) ** 2 / (uu - u * u / n) e from m), b as (select g, arg_min(a, e) a from l group by g),
q(g, lo, hi, i) as (select g, greatest(a - 0.1, -3), least(a + 0.1, 3), 0 from b union all
 select g, case when d < 0 then mid else lo end, case when d < 0 then hi else mid end, i + 1 from (select *, -k * (vy - k * vuu - (y - k * u) / n * vu) d from (select *, (uy - u * y / n) / (uu - u * u / n) k from
  (select g, lo, hi, i, a mid, {OFFSET_MOMENTS} from (select q.g, lo, hi, i, (lo + hi) / 2 + 1e-13 a, x, n, sy from q join t on t.g = q.g where i < 45) group by g, lo, hi, i, a)))),
z as (select g, (lo + hi) / 2 a from q where i = 45), w as (select g, a, {OFFSET_MOMENTS} from t join z using (g) group by g, a)
select g, round(a, 6) alpha, round((uy - u * y / n) / (uu - u * u / n), 4) k, round((y - (uy - u * y / n) / (uu - u * u / n) * u) / n, 4) c from w""")
def q26_offset_power_fit(spark, sf_dir):
    f = table(spark, sf_dir, "events").select(F.col("event_type").alias("g"), (1.0 + F.col("user_id") % 8).alias("x"), F.col("value").alias("y"))
    return metrics.offset_power_fit(f, ["g"]).select("g", r("alpha").alias("alpha"), r("k", 4).alias("k"), r("c", 4).alias("c"))


@registered("""with d as (select ts::date as day, count(*) n from events group by 1) select strftime(day, '%Y-%m-%d') as day, n, round(first(n) over (order by day) / n, 6) speedup from d""")
def q27_speedup(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    first = d.agg(F.min_by("n", "day").alias("first"))  # one row
    return d.crossJoin(F.broadcast(first)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", r(F.col("first") / F.col("n")).alias("speedup"))


def customer_grids(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", (2 + F.col("c_custkey") % 4).cast("int").alias("nx"), (1 + F.col("c_nationkey") % 3).cast("int").alias("ny"), (1 + F.col("c_custkey") % 2).cast("int").alias("nz"))


GRIDS = "g as (select c_custkey, 2 + c_custkey % 4 nx, 1 + c_nationkey % 3 ny, 1 + c_custkey % 2 nz from customer)"


@registered(f"""with {GRIDS}, e as (select c_custkey, nx * ny * nz n, (nx - 1) * ny * nz + nx * (ny - 1) * nz + nx * ny * (nz - 1) e, 2 * ((nx > 1)::int + (ny > 1)::int + (nz > 1)::int) d from g)
select c_custkey, (n + 2 * e)::bigint nnz, (n * d)::double trace, (n * d * d + 2 * e)::double squares, (n * d - 2 * e)::double total from e""")
def q28_laplacians(spark, sf_dir):
    m = generate.laplacian(customer_grids(spark, sf_dir), ["c_custkey"])
    v = F.col("value")
    return m.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("nnz"), F.sum(F.when(F.col("row") == F.col("col"), v)).alias("trace"), F.sum(v * v).alias("squares"), F.sum(v).alias("total"))


LAMBDA = "case when {n} > 1 then 4 * sin(pi() * ({m} + 1) / (2.0 * ({n} + 1))) ** 2 else 0 end"


@registered(f"""with {GRIDS}, i as (select *, unnest(range(nx)) i from g), j as (select *, unnest(range(ny)) j from i), k as (select *, unnest(range(nz)) k from j),
l as (select c_custkey, {LAMBDA.format(n="nx", m="i")} + {LAMBDA.format(n="ny", m="j")} + {LAMBDA.format(n="nz", m="k")} v from k), s as (select c_custkey, list_sort(list(v)) v from l group by 1)
select c_custkey, round(v[1], 8) least, round(list_sum(v[1:3]), 8) three_least, round(v[-1], 8) largest from s""")
def q29_eigenvalues(spark, sf_dir):
    s = generate.eigenvalues(customer_grids(spark, sf_dir), ["c_custkey"]).groupBy("c_custkey").agg(F.sort_array(F.collect_list("value")).alias("v"))
    three = F.aggregate(F.slice("v", 1, 3), F.lit(0.0), lambda a, x: a + x)
    return s.select("c_custkey", r(F.element_at("v", 1), 8).alias("least"), r(three, 8).alias("three_least"), r(F.element_at("v", -1), 8).alias("largest"))


@registered(f"""with {CELLS}, n as (select *, lead(x) over w nxt, label % 5 e from c window w as (partition by vec_id order by pos))
select vec_id, any_value(e)::int ends, round(sum(x * x), 6) length, round(sum(coalesce((nxt - x) ** 2, 0)) + case when any_value(e) in (0, 1) then sum(x * x) filter (pos = 0) else 0 end
 + case when any_value(e) in (0, 2) then sum(x * x) filter (pos = 63) else 0 end + case when any_value(e) = 4 then (sum(x) filter (pos = 0) - sum(x) filter (pos = 63)) ** 2 else 0 end, 5) energy from n group by vec_id""")
def q30_eigenvectors(spark, sf_dir):
    """Every embedding in the basis of a chain's eigenvectors, one kind of ends for each label: its length, and the sum of its squared
    steps, which the eigenvalues must give back."""
    n, m, x = F.lit(64), F.col("m"), F.col("pos")
    grid = spark.range(64).select(F.col("id").alias("m")).withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))))
    basis = grid.select("m", "pos", F.explode(F.array(*(F.struct(F.lit(k).alias("ends"), generate.eigenvector_1d(n, m, x, e).alias("v"), generate.eigenvalue_1d(n, m, e).alias("l")) for k, e in enumerate(generate.ENDS)))).alias("b"))
    basis = basis.select("m", "pos", "b.*")  # 5 times 64 times 64 rows
    cells = embedding_cells(spark, sf_dir).withColumn("ends", (F.col("label") % 5).cast("int"))
    wave = cells.join(F.broadcast(basis), ["ends", "pos"]).groupBy("vec_id", "ends", "m").agg(F.sum(F.col("value") * F.col("v")).alias("c"), F.first("l").alias("l"))
    return wave.groupBy("vec_id", "ends").agg(r(F.sum(F.col("c") * F.col("c"))).alias("length"), r(F.sum(F.col("l") * F.col("c") * F.col("c")), 5).alias("energy"))


@registered("""with g as (select c_custkey, 2 + c_custkey % 12 n from customer), c as (select *, unnest(range(n)) col from g), m as (select *, unnest(range(n)) m from c)
select c_custkey, col, round(sum(2.0 / (n + 1) * sin(pi() * (m + 1) / (n + 1)) * sin(pi() * (m + 1) * (col + 1) / (n + 1)) * exp(-4 * sin(pi() * (m + 1) / (2.0 * (n + 1))) ** 2)), 8) as value from m group by all""")
def q31_exponential_rows(spark, sf_dir):
    g = table(spark, sf_dir, "customer").select("c_custkey", (2 + F.col("c_custkey") % 12).alias("nx"))
    return generate.exponential_1d(g.withColumn("nx", F.col("nx").cast("long")), ["c_custkey"]).select("c_custkey", "col", r("value", 8).alias("value"))


def chains(spark, sf_dir) -> DataFrame:
    """A chain of 2 to 7 nodes for each customer as a solver's row; nodes n0, n1, ..., fixed at both ends."""
    g = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", (2 + F.col("c_custkey") % 6).cast("int").alias("nx"), F.lit(1).alias("ny"), F.lit(1).alias("nz"))
    m = generate.laplacian(g, ["c_custkey"])
    name = lambda k: text("n", k)
    rows = m.groupBy("c_custkey").agg(F.collect_list(F.struct(name("row").alias("row"), name("col").alias("col"), "value")).alias("g"))
    c = F.transform(F.sequence(F.lit(0), F.col("nx") - 1), lambda i: F.struct(F.concat(F.lit("n"), i.cast("string")).alias("node"), F.lit(1.0).alias("value")))
    return rows.join(g, "c_custkey").select(F.col("c_custkey").cast("string").alias("circuit"), "g", c.alias("c"), "c_acctbal")


def no_forcing() -> Column:
    return F.lit(None).cast(f"array<struct<node:string,dc:double,pulses:array<{wf.PULSE}>>>").alias("b")


@registered("""with g as (select c_custkey, c_acctbal b, 2 + c_custkey % 6 n from customer), i as (select *, unnest(range(n)) i from g)
select c_custkey::varchar circuit, 'n' || i node, round(b * (n - i) / (n + 1), 6) as value from i""")
def q32_operating_points(spark, sf_dir):
    b = F.array(F.struct(F.lit("n0").alias("node"), F.col("c_acctbal").alias("dc"), F.lit(None).cast(f"array<{wf.PULSE}>").alias("pulses"))).alias("b")
    return stepper.dc_points(chains(spark, sf_dir).select("circuit", "g", "c", b)).select("circuit", "node", r("value").alias("value"))


@registered("""with g as (select c_custkey, 2 + c_custkey % 6 n from customer), m as (select *, unnest(range(n)) m from g), i as (select *, unnest(range(n)) i from m),
v as (select c_custkey, n, m, 2.0 / (n + 1) * sin(pi() * (m + 1) / (n + 1)) * sum(sin(pi() * (m + 1) * (i + 1) / (n + 1))) w, 4 * sin(pi() * (m + 1) / (2.0 * (n + 1))) ** 2 l from i group by c_custkey, n, m),
s as (select *, unnest(range(9)) step from v)
select c_custkey::varchar circuit, step, step / 8.0::double as time, round(sum(w * ((1 - l / 16) / (1 + l / 16)) ** step), 8) as value from s group by all""")
def q33_trapezoid(spark, sf_dir):
    x0 = F.transform("c", lambda e: e).alias("x0")
    asked = chains(spark, sf_dir).select("circuit", "g", "c", no_forcing(), x0, F.lit("n0").alias("node"), F.lit(1.0).alias("tstop"), F.lit(8).alias("steps"))
    return stepper.transients(asked, "cg").select("circuit", "step", "time", r("value", 8).alias("value"))


UNIFORM = "('0x' || substr(md5({}), 1, 13))::bigint / 4503599627370496.0::double"


@registered(f"with u as (select event_id, 1.0 + user_id % 5 rate, {UNIFORM.format("'7:' || event_id")} u from events) select event_id, round(u, 9) u, round(-ln(1 - u) / rate, 8) as wait from u")
def q34_waiting_times(spark, sf_dir):
    u = rnd.uniform(F.lit("7"), F.col("event_id").cast("string"))
    e = table(spark, sf_dir, "events").select("event_id", u.alias("u"), (1.0 + F.col("user_id") % 5).alias("rate"))
    return e.select("event_id", r("u", 9).alias("u"), r(rnd.exponential(F.col("u"), F.col("rate")), 8).alias("wait"))


@registered(f"""with w as (select l_orderkey, l_linenumber, sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity rows unbounded preceding) hi, l_quantity q, sum(l_quantity) over (partition by l_orderkey) total from lineitem)
select l_orderkey, l_linenumber from w where {UNIFORM.format("'3:' || l_orderkey")} * total < hi and {UNIFORM.format("'3:' || l_orderkey")} * total >= hi - q""")
def q35_weighted_choice(spark, sf_dir):
    whole = Window.partitionBy("l_orderkey")
    u = rnd.uniform(F.lit("3"), F.col("l_orderkey").cast("string"))
    w = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.sum("l_quantity").over(whole.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, 0)).alias("hi"), F.col("l_quantity").alias("q"), (F.sum("l_quantity").over(whole) * u).alias("at"))
    return w.where("at < hi and at >= hi - q").select("l_orderkey", "l_linenumber")


def nation_chain(spark, sf_dir) -> tuple[DataFrame, int]:
    """The nations by key as a chain: A is minus the Laplacian."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("row"))
    cells = n.select("row", F.explode(F.array(*[F.struct((F.col("row") + d).alias("col"), F.lit(v).alias("value")) for d, v in ((-1, 1.0), (0, -2.0), (1, 1.0))])).alias("c")).select("row", "c.*")
    return cells.join(n.select(F.col("row").alias("col")), "col").select("row", "col", "value"), n.count()


#: Replays the walk draw by draw: a row is a customer's walk before its next draw.
WALK = f"""with recursive n as (select count(*) n from nation), w(start, sample, k, step, s, held, e, i) as (
 select c_nationkey, c_custkey, 0, 1, c_nationkey, null::double, exp((case when c_nationkey in (0, (select n - 1 from n)) then -1 else 0 end) / 8.0::double), 0.1 * c_nationkey::double from customer
 union all
 select start, sample,
  case when held is null then k + 1 when held < 0.25 then k + 2 else k end,
  case when held >= 0.25 then step + 1 else step end,
  case when held < 0.25 then nxt else s end,
  case when held is null then -ln(1 - u1) / (case when s in (0, n - 1) then 1 else 2 end) when held < 0.25 then held - ln(1 - u2) / (case when nxt in (0, n - 1) then 1 else 2 end) else null end,
  case when held >= 0.25 then e * h * (case when step < 4 then h else 1 end) else e end,
  case when held >= 0.25 then i + (case when step = 4 then 1 when step % 2 = 1 then 4 else 2 end) * e * h * 0.1 * s else i end
 from (select *, case when s = 0 then 1 when s = n - 1 then n - 2 when u1 < 0.5 then s - 1 else s + 1 end nxt from
  (select w.*, n.n, {UNIFORM.format("'5:' || sample || ':' || k")} u1, {UNIFORM.format("'5:' || sample || ':' || (k + 1)")} u2, exp((case when s in (0, n.n - 1) then -1 else 0 end) / 8.0::double) h from w, n where step <= 4)))"""


@registered(f"{WALK} select start::bigint start, count(*) n, round(avg(e * (s + 1) + i * 0.25 / 3), 6) mean from w where step = 5 group by start")
def q36_walk_point(spark, sf_dir):
    m, n = nation_chain(spark, sf_dir)
    samples = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("start"), F.col("c_custkey").alias("sample"))
    out = walk.point(samples, walk.Chain.of(m, n), np.arange(n) + 1.0, lambda s, t: 0.1 * s, 1.0, 4, 5, walk.digested)
    return out.select("start", "n", r("mean").alias("mean"))


@registered(f"""{WALK}, v as (select start, sample, 0 k, start s, 1.0::double e from w where k = 0 and step = 1 and held is null
 union all select start, sample, step - 1, s, e / (case when step <= 4 then exp((case when s in (0, (select n - 1 from n)) then -1 else 0 end) / 8.0::double) else 1 end) from w where held is null and step > 1),
x as (select start, sample, k j, e * (s + 1) y from v union all
 select v.start, v.sample, j.j, (case when v.k = 0 or v.k = j.j then 0.5 else 1 end) * e * 0.1 * s * 0.25 from v join (select unnest(range(1, 5)) j) j on v.k <= j.j)
select start::bigint start, j::int j, round(sum(y) / count(distinct sample), 6) as value from x group by all""")
def q37_walk_sequence(spark, sf_dir):
    m, n = nation_chain(spark, sf_dir)
    samples = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("start"), F.col("c_custkey").alias("sample"))
    seen = walk.visits(samples, walk.Chain.of(m, n), 1.0, 4, 4, 5, walk.digested)
    states = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("state"))
    x0 = states.select("state", (F.col("state") + 1.0).alias("value"))
    forcing = states.select("state", (0.1 * F.col("state")).alias("value"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("lag"))
    return walk.sequence(seen, x0, forcing, 0.25, 4).select("start", "j", r("value").alias("value"))


@registered("""with n as (select count(*)::double n from nation), g as (select l_linenumber::bigint start, count(*) samples from lineitem group by 1), m as (select *, unnest(range(n::bigint)) m from g, n)
select start, samples, round(sum(2 / (n + 1) * sin(pi() * (m + 1) * (start + 1) / (n + 1)) * sin(pi() * (m + 1) * 3 / (n + 1)) * exp(-4 * sin(pi() * (m + 1) / (2 * (n + 1))) ** 2)), 6) exact, true near from m group by all""")
def q38_walk_estimates(spark, sf_dir):
    m, n = nation_chain(spark, sf_dir)
    samples = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("start"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("sample"))
    out = commands.exp_entry(samples, m, n, 2, steps=32)
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    term = generate.eigenvector_1d(F.lit(n), F.col("m"), F.col("start")) * generate.eigenvector_1d(F.lit(n), F.col("m"), F.lit(2)) * F.exp(-generate.eigenvalue_1d(F.lit(n), F.col("m")))
    exact = out.select("start", k.alias("m")).groupBy("start").agg(F.sum(term).alias("exact"))
    near = F.abs(F.col("mean") - F.col("exact")) <= 5 * F.col("error") + 0.002
    return out.join(exact, "start").select("start", F.col("n").alias("samples"), r("exact").alias("exact"), near.alias("near"))


def order_lines(spark, sf_dir) -> DataFrame:
    """Each order as a netlist: a resistor line for each item, in the spelling that readers must bear."""
    li = table(spark, sf_dir, "lineitem")
    number = F.col("l_linenumber").cast("int")
    line = F.concat(F.lit("R"), number.cast("string"), F.lit(" N"), F.col("l_partkey").cast("string"), F.lit(",\t("), F.when(number == 1, "0").otherwise(text("S", "l_suppkey")), F.lit(")  "), F.col("l_quantity").cast("string"))
    circuit = F.col("l_orderkey").cast("string").alias("circuit")
    title = li.select(circuit, F.lit(0).alias("line_no"), F.lit("R0 title").alias("line")).distinct()
    return title.unionByName(li.select(circuit, number.alias("line_no"), line.alias("line")))


@registered("select l_orderkey::varchar circuit, 'r' || l_linenumber as name, 'n' || l_partkey node1, case when l_linenumber = 1 then '0' else 's' || l_suppkey end node2, l_quantity as value from lineitem")
def q39_netlist_round_trip(spark, sf_dir):
    parts = netlist_text.components(order_lines(spark, sf_dir))
    again = netlist_text.component_lines(parts).select("circuit", (F.row_number().over(Window.partitionBy("circuit").orderBy("at", "name"))).alias("line_no"), "line")
    return netlist_text.components(again).select("circuit", "name", "node1", "node2", "value")


@registered(f"""with recursive c as (select c_custkey k, 1.0 + c_custkey % 5 volt, 0.5 v1, 2.0 + c_nationkey v2, 0.1 td, 0.05 tr, 0.05 tf, 0.2 pw, 0.5 per, 1 / 0.25 + 1 / 2.0 g, 0.3 c, 1 / 16.0::double dt from customer),
s as (select *, unnest(range(17)) n from c), p as (select *, n * dt t from s), b as (select k, n, g, c, dt, volt / 0.25 - ({PULSE_SQL}) b from p),
x(k, n, y) as (select k, n, b / g from b where n = 0 union all select b.k, b.n, ((b.c - b.dt / 2 * b.g) * y + b.dt / 2 * (b.b + a.b)) / (b.c + b.dt / 2 * b.g) from x join b on b.k = x.k and b.n = x.n + 1 join b a on a.k = x.k and a.n = x.n)
select k::varchar circuit, n step, n / 16.0::double as time, round(y, 6) as value from x""")
def q40_transient(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    lines = F.array(
        F.lit("a node behind a source, loaded and pulled"),
        F.concat(F.lit("Vs src 0 "), (1.0 + F.col("c_custkey") % 5).cast("string")),
        F.lit("Rs src mid 0.25"),
        F.lit("Lshort mid out 1"),
        F.lit("Rload out 0 2.0"),
        F.lit("Cload out 0 0.3"),
        F.concat(F.lit("Ipull out 0 9 pulse(0.5, "), (2.0 + F.col("c_nationkey")).cast("string"), F.lit(", 0.1, 0.05, 0.05, 0.2, 0.5)")),
        F.lit(".tran 0.0625 1"),
        F.lit(".print tran v(out)"),
        F.lit(".end"),
    )
    rows = c.select(F.col("c_custkey").cast("string").alias("circuit"), F.posexplode(lines).alias("line_no", "line"))
    return commands.transient(rows).select("circuit", "step", "time", r("value").alias("value"))


@registered("""with g as (select c_custkey, 1.0 + c_custkey % 7 g from customer), s as (select *, unnest([2, 4, 8, 16]) steps from g)
select c_custkey::varchar circuit, steps::bigint steps, round(((1 - g / (2 * steps)) / (1 + g / (2 * steps))) ** steps, 8) final, round(abs(((1 - g / (2 * steps)) / (1 + g / (2 * steps))) ** steps - exp(-g)), 8) error from s""")
def q41_step_sweep(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (1.0 + F.col("c_custkey") % 7).alias("rate"), F.explode(F.array(*map(F.lit, (2, 4, 8, 16)))).alias("steps"))
    one = lambda v: F.array(F.struct(F.lit("n").alias("node"), v.alias("value")))
    name = F.concat_ws("/", F.col("c_custkey").cast("string"), F.col("steps").cast("string"))
    g = F.array(F.struct(F.lit("n").alias("row"), F.lit("n").alias("col"), F.col("rate").alias("value"))).alias("g")
    asked = c.select(name.alias("circuit"), g, one(F.lit(1.0)).alias("c"), no_forcing(), one(F.lit(1.0)).alias("x0"), F.lit("n").alias("node"), F.lit(1.0).alias("tstop"), "steps")
    last = stepper.transients(asked).groupBy("circuit").agg(F.max_by("value", "step").alias("final"))
    part = F.split("circuit", "/")
    exact = F.exp(-(1.0 + part[0].cast("long") % 7))
    return last.select(part[0].alias("circuit"), part[1].cast("long").alias("steps"), r("final", 8).alias("final"), r(F.abs(F.col("final") - exact), 8).alias("error"))


@registered("select user_id, round(value, 2) as time, event_id::double as value, 'scan' kind from events union all select user_id, null, round(value, 2), 'timing' from events")
def q42_printed_results(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    two = lambda c: F.format_string("%.2f", c)
    kinds = F.array(F.concat(F.lit("  "), two(F.col("value")), F.lit(" "), F.col("event_id").cast("string")), F.concat(F.lit("ODE solver time: "), two(F.col("value")), F.lit(" s")), F.lit("Index   time  v(out)"), F.lit("not 1 a row"))
    lines = e.select("user_id", F.explode(kinds).alias("line"))
    scan = results.waveform_rows(lines, ["user_id"]).withColumn("kind", F.lit("scan"))
    timing = results.timing_rows(lines, ["user_id"]).select("user_id", F.lit(None).cast("double").alias("time"), F.col("seconds").alias("value"), F.lit("timing").alias("kind"))
    return scan.select("user_id", "time", "value", "kind").unionByName(timing)


@registered("""with p as (select row_number() over (order by c_custkey) i, c_acctbal b, count(*) over () n from customer), l as (select (3 - sqrt(5)) / 2 l)
select a.i idx, round(sum(c.b * (l ** abs(a.i - c.i) - l ** (a.i + c.i) - l ** (2 * (a.n + 1) - a.i - c.i)) / sqrt(5)), 4) as value from p a, p c, l where abs(a.i - c.i) <= 60 group by all""")
def q43_large_system(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row"), F.col("c_acctbal").alias("b"))
    cells = c.select("row", F.explode(F.array(*[F.struct((F.col("row") + d).alias("col"), F.lit(v).alias("value")) for d, v in ((-1, -1.0), (0, 3.0), (1, -1.0))])).alias("c")).select("row", "c.*")
    m = cells.join(c.select(F.col("row").alias("col")), "col").select("row", "col", "value")
    x = stepper.conjugate_gradients(m, c.select(F.col("row").alias("idx"), F.col("b").alias("value")), 1e-11)
    first = c.agg(F.min("row").alias("first"))  # one row: keys are consecutive, wherever they begin
    return x.crossJoin(F.broadcast(first)).select((F.col("idx") - F.col("first") + 1).alias("idx"), r("value", 4).alias("value"))


ITEMS = "e as (select l_suppkey as row, l_partkey col, sum(l_quantity) v from lineitem group by all)"


def supplier_matrix(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("value"))


@registered(f"with {ITEMS} select l_orderkey, l_linenumber, round(v, 6) as value from lineitem join e on l_suppkey = row and l_partkey = col")
def q44_entries(spark, sf_dir):
    wanted = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col"))
    return matrix.entries_at(supplier_matrix(spark, sf_dir), wanted).select("l_orderkey", "l_linenumber", r("value").alias("value"))


@registered(f"with {ITEMS} select row, round(sum(v) filter (row = col), 6) diagonal, count(*) filter (row <> col) others, round(coalesce(sum(v) filter (row <> col), 0), 6) rest from e group by row")
def q45_diagonal_and_rest(spark, sf_dir):
    e = matrix.summed(supplier_matrix(spark, sf_dir))
    rest = matrix.off_diagonals(e).groupBy("row").agg(F.count(F.lit(1)).alias("others"), F.sum("value").alias("rest"))
    both = e.select("row").distinct().join(matrix.diagonal(e), "row", "left").join(rest, "row", "left")
    return both.select("row", r("value").alias("diagonal"), F.coalesce("others", F.lit(0).cast("long")).alias("others"), r(F.coalesce("rest", F.lit(0.0))).alias("rest"))


@registered("select 'r' kind, l_returnflag circuit, count(*) n, round(sum(l_quantity), 2) total from lineitem group by all union all select 'i', l_returnflag, count(*), round(sum(l_extendedprice), 2) from lineitem group by all")
def q46_no_sources_left(spark, sf_dir):
    flag = F.col("l_returnflag")
    parts = line_parts(spark, sf_dir, "r", flag, F.col("l_quantity")).unionByName(line_parts(spark, sf_dir, "i", flag, F.col("l_extendedprice")))
    return assemble.refuse_sources(parts).groupBy("kind", "circuit").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), 2).alias("total"))


@registered("""with n as (select l_returnflag c, 'p' || l_partkey node, (l_orderkey * 8 + l_linenumber) * 2 "at" from lineitem union all select l_returnflag, 's' || l_suppkey, (l_orderkey * 8 + l_linenumber) * 2 + 1 from lineitem),
f as (select c, node, min("at") "at" from n group by all), i as (select c, node, row_number() over (partition by c order by "at", node) - 1 idx from f)
select l_orderkey, l_linenumber, case when l_linenumber <= 3 then -1 else idx end idx from lineitem join i on c = l_returnflag and node = 'p' || l_partkey""")
def q47_node_indices(spark, sf_dir):
    """Each return flag's lines are one netlist, in the order of their keys."""
    k = F.col("l_linenumber")
    parts = line_parts(spark, sf_dir, "r", F.col("l_returnflag"), F.col("l_quantity"), (F.col("l_orderkey") * 8 + k).alias("line_no"))
    spelled = F.when(k == 1, "0").when(k == 2, "gnd").when(k == 3, "GND").otherwise(text("p", "l_partkey"))
    names = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("circuit"), spelled.alias("node"), "l_orderkey", "l_linenumber")
    return netlist.node_indices(names, netlist.node_numbers(parts)).select("l_orderkey", "l_linenumber", "idx")


@registered("select event_id, 'pulse(' || concat_ws(', ', user_id::double, (user_id + 2)::double, 0.5::double, 10.0::double, 20.0::double, length(event_type)::double, 1000.0::double) || ')' as text from events")
def q48_pulse_text(spark, sf_dir):
    p = wf.pulse(v1=F.col("user_id"), v2=F.col("user_id") + 2, td=0.5, tr=10, tf=20, pw=F.length("event_type"), per=1000)
    return table(spark, sf_dir, "events").select("event_id", wf.pulse_text(p).alias("text"))


@registered("""with n as (select user_id, value, row_number() over (partition by user_id order by event_id) - 1 n, count(*) over (partition by user_id) c from events), e as (select *, c - 1 - (c - 1) % 2 l from n)
select user_id, round(sum(value * case when n in (0, l) then 1 when n % 2 = 1 then 4 else 2 end) / 3, 4) area from e where n <= l group by user_id""")
def q49_simpson(spark, sf_dir):
    user = Window.partitionBy("user_id")
    n = table(spark, sf_dir, "events").select("user_id", "value", (F.row_number().over(user.orderBy("event_id")) - 1).alias("n"), F.count(F.lit(1)).over(user).alias("c"))
    e = n.withColumn("last", F.col("c") - 1 - (F.col("c") - 1) % 2).where("n <= last")
    return e.groupBy("user_id").agg(r(F.sum(F.col("value") * wf.simpson_weight(F.col("n"), F.col("last"))) / 3, 4).alias("area"))


@registered("""with l as (select user_id, value v, lag(value) over (partition by user_id order by event_id) b from events), e as (select user_id, abs(v - b) / (abs(b) + 1e-10) r from l where b is not null)
select user_id, round(max(r), 5) max_rel, round(avg(r), 5) avg_rel, round(sqrt(avg(r * r)), 5) rms_rel from e group by user_id""")
def q50_relative_errors(spark, sf_dir):
    k = metrics.with_previous(table(spark, sf_dir, "events"), ["user_id"], "event_id").where("want is not null")
    return metrics.error_metrics(k, ["user_id"], "value", "want").select("user_id", *(r(c, 5).alias(c) for c in ("max_rel", "avg_rel", "rms_rel")))


@registered("""with x as (select c_custkey, c_acctbal b, floor(log10(abs(c_acctbal))) e from customer), m as (select *, round(b / 10 ** e, 1) m from x)
select c_custkey, case when b = 0 then '0' when abs(m) >= 10 then printf('%.1f', m / 10) || '×10^' || (e + 1)::bigint else printf('%.1f', m) || '×10^' || e::bigint end as text from m""")
def q51_scientific(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", rnd.scientific(F.col("c_acctbal")).alias("text"))


@registered("""with e as (select user_id, avg(value) exact, avg(value) filter (event_type <> 'view') m from events group by 1)
select user_id, round(abs(m - exact) / abs(exact) * 100, 5) error_percent from e where m is not null and exact <> 0""")
def q52_sample_errors(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    exact = e.groupBy("user_id").agg(F.avg("value").alias("exact")).where("exact <> 0")
    some = e.where("event_type <> 'view'").groupBy("user_id").agg(F.avg("value").alias("mean"))
    return sweeps.sample_errors(some, exact, ["user_id"]).select("user_id", r("error_percent", 5).alias("error_percent"))


@registered(f"with {ITEMS}, n as (select max(row) + 1 rows, max(col) + 1 cols from e) select rows, cols, row, col, v as value from e, n")
def q53_coo_files(spark, sf_dir):
    e = stored(matrix.summed(supplier_matrix(spark, sf_dir)), "entries")
    size = e.agg(F.max("row"), F.max("col"), F.count(F.lit(1))).first()
    path = f"{shared_dir(spark)}/ohmweave-coo-{uuid.uuid4().hex}"
    matrix_text.write_coo(e, (size[0] or 0) + 1, (size[1] or 0) + 1, path, size[2])
    forget(e)
    return matrix_text.read_coo(spark, path).select("rows", "cols", "row", "col", "value")


@registered(f"""with {CELLS}, o as (select vec_id, row_number() over (partition by label order by vec_id) - 1 k from embeddings),
m as (select a.label, a.pos as row, b.pos col, sum(a.x * b.x) v from c a join c b on a.vec_id = b.vec_id where abs(a.pos - b.pos) <= 3 group by all)
select 'vector' kind, label, null::bigint as row, k * 64 + pos idx, round(x, 6) as value from c join o using (vec_id) union all select 'dense', label, row, col, round(v, 5) from m""")
def q54_dense_and_vector_files(spark, sf_dir):
    """A vector file for each label, all its embeddings one after the other, and a dense one, the sums of products of near components."""
    cells = embedding_cells(spark, sf_dir)
    order = ranks.ranked(table(spark, sf_dir, "embeddings").select("vec_id", "label"), ["label"], ["vec_id"], "k")
    values = cells.join(order.select("vec_id", "k"), "vec_id").select(F.col("label").alias("name"), ((F.col("k") - 1) * 64 + F.col("pos")).alias("idx"), "value")
    path = f"{shared_dir(spark)}/ohmweave-text-{uuid.uuid4().hex}"
    matrix_text.write_vectors(values, f"{path}/vector")
    near = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.transform(F.sequence(F.greatest(i - 3, F.lit(0)), F.least(i + 3, F.lit(63))), lambda j: F.struct(i.alias("row"), j.alias("col"), (F.get("e", i) * F.get("e", j)).alias("value"))))))
    products = table(spark, sf_dir, "embeddings").select(F.col("label").alias("name"), F.col("embedding").cast("array<double>").alias("e")).select("name", near.alias("p")).groupBy("name", "p.row", "p.col").agg(F.sum("p.value").alias("value"))
    matrix_text.write_dense(stored(products, "products"), 64, f"{path}/dense")
    label = F.regexp_extract("file", "name=([^/]*)", 1).cast("int").alias("label")
    vector = matrix_text.read_vector(spark, f"{path}/vector/*").select(F.lit("vector").alias("kind"), label, F.lit(None).cast("long").alias("row"), "idx", r("value").alias("value"))
    dense = matrix_text.read_dense(spark, f"{path}/dense/*").select(F.lit("dense").alias("kind"), label, "row", F.col("col").alias("idx"), r("value", 5).alias("value"))
    return vector.unionByName(dense)


@registered("select user_id, event_id::double as time, round(value, 2) as value from events")
def q55_indexed_printout(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kinds = F.array(F.format_string("%d\t%d  %.2f", F.col("user_id"), F.col("event_id"), F.col("value")), F.lit("Index   time  v(out)"), F.format_string("%d 1", F.col("event_id")))
    return results.indexed_rows(e.select("user_id", F.explode(kinds).alias("line")), ["user_id"])


@registered("select user_id, count(*) n, round(avg(value), 6) mean from events group by 1")
def q56_result_files(spark, sf_dir):
    path = f"{shared_dir(spark)}/ohmweave-csv-{uuid.uuid4().hex}"
    results.write_csv(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), path)
    got = results.read_csv(spark, path, "user_id long, value double")
    return metrics.group_means(got, ["user_id"]).select("user_id", "n", r("mean").alias("mean"))


@registered("select event_type, count(*) n, 1::bigint made from events group by 1")
def q57_cached_results(spark, sf_dir):
    made, folder, events = [], f"{shared_dir(spark)}/ohmweave-cache-{uuid.uuid4().hex}", table(spark, sf_dir, "events")

    def make():
        made.append(1)
        return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))

    for _ in range(2):
        out = results.cached(spark, folder, {"table": "events", "seed": 7}, make, [events])
    return out.withColumn("made", F.lit(len(made)).cast("long"))


@registered(f"""with {GRIDS}, a as (select *, (nx > 1)::int x, (ny > 1)::int y, (nz > 1)::int z from g)
select c_custkey, (2 * nx * ny * nz * (x + y + z) - y * nx * nz - 2 * z * nx * ny)::double trace, (y * nx * nz)::double total from a""")
def q58_ends_by_axis(spark, sf_dir):
    m = generate.laplacian(customer_grids(spark, sf_dir), ["c_custkey"], ("P", "DN", "NN"))
    return m.groupBy("c_custkey").agg(F.sum(F.when(F.col("row") == F.col("col"), F.col("value")).otherwise(0.0)).alias("trace"), F.sum("value").alias("total"))


@registered("""with b as (select n_name circuit, 2 + n_nationkey % 3 nx, 2 + n_nationkey % 4 ny, 2 layers from nation)
select circuit, 'c' kind, layers * nx * ny n from b union all select circuit, 'r', layers * (nx * (ny - 1) + (nx - 1) * ny) + nx from b union all select circuit, 'v', (nx - 1) * (ny - 1) + nx from b union all select circuit, 'i', least(nx, ny) - 1 from b""")
def q59_power_grids(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    g = n.select(F.col("n_name").alias("circuit"), (2 + F.col("n_nationkey") % 3).alias("nx"), (2 + F.col("n_nationkey") % 4).alias("ny"), F.lit(2).alias("layers"), F.lit(1.0).alias("share"))
    return generate.power_grid(g).groupBy("circuit", "kind").agg(F.count(F.lit(1)).alias("n"))


@registered("""with t as (select user_id, event_type, count(*)::double t, length(event_type) p from events group by all), f as (select user_id, min_by(t, {'p': p, 'e': event_type}) t1 from t group by 1)
select user_id, event_type, round(t1 / t, 6) speedup from t join f using (user_id)""")
def q60_speedup_by_group(spark, sf_dir):
    t = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("t"))
    t = t.withColumn("p", F.struct(F.length("event_type").alias("n"), "event_type"))
    return metrics.speedups(t, ["user_id"]).select("user_id", "event_type", r("speedup").alias("speedup"))


@registered("""with recursive s as (select s_nationkey n, s_suppkey k, s_acctbal v, row_number() over (partition by s_nationkey order by s_suppkey) i from supplier),
l(n, k, i, lift) as (select n, k, i, v from s where i = 1 union all select s.n, s.k, s.i, l.lift + s.v from l join s on s.n = l.n and s.i = l.i + 1),
t as (select n, 's' || k node, lift from l union all select n, 't' || k, lift + 10 + k % 7 from l),
r as (select l_orderkey o, l_linenumber j, 'p' || l_partkey p, l_suppkey k, l_quantity q from lineitem),
e as (select 'r' || o || '_' || j as name, p, 's' || k node, q from r union all select 'u' || o || '_' || j, p, 't' || k, q from r where j = 1)
select n::varchar circuit, 'i_' || name as name, case when lift >= 0 then '0' else p end node1, case when lift >= 0 then p else '0' end node2, round(abs(lift) / q, 8) as value from e join t using (node)
union all select n::varchar, name, p, '0', round(q, 8) from e join t using (node)""")
def q61_source_chains(spark, sf_dir):
    """A nation's suppliers stand on each other's shoulders, the first on ground, and each carries a second source on its terminal."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal", F.lag("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("below"))
    circuit = F.col("s_nationkey").cast("string").alias("circuit")
    v = s.select(circuit, F.lit("v").alias("kind"), text("v", "s_suppkey").alias("name"), text("s", "s_suppkey").alias("node1"), F.coalesce(text("s", "below"), F.lit("0")).alias("node2"), F.col("s_acctbal").alias("value"), no_pulse().alias("pulse"))
    w = s.select(circuit, F.lit("v").alias("kind"), text("w", "s_suppkey").alias("name"), text("t", "s_suppkey").alias("node1"), text("s", "s_suppkey").alias("node2"), (10.0 + F.col("s_suppkey") % 7).alias("value"), no_pulse().alias("pulse"))
    nation = s.select(F.col("s_suppkey").alias("l_suppkey"), circuit)
    li = table(spark, sf_dir, "lineitem").join(nation, "l_suppkey")
    item = F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    r = lambda df, kind, end: df.select("circuit", F.lit("r").alias("kind"), F.concat(F.lit(kind), item).alias("name"), text("p", "l_partkey").alias("node1"), text(end, "l_suppkey").alias("node2"), F.col("l_quantity").alias("value"), no_pulse().alias("pulse"))
    parts = stored(r(li, "r", "s").unionByName(r(li.where("l_linenumber = 1"), "u", "t")).unionByName(v).unionByName(w), "parts")
    return netlist.norton(parts).select("circuit", F.regexp_replace("name", "^i_[vw][0-9]+_", "i_").alias("name"), "node1", "node2", F.round("value", 8).alias("value"))


@registered("""with e as (select l_suppkey as row, l_partkey col, sum(l_quantity) v from lineitem group by all) select row idx, round(sum(v / (1 + col % 97)), 5) as value from e group by row""")
def q62_block_product(spark, sf_dir):
    blocks = matrix.rows_of(supplier_matrix(spark, sf_dir), block=64)
    x = table(spark, sf_dir, "lineitem").select("l_partkey").union(table(spark, sf_dir, "lineitem").select("l_suppkey")).distinct().select(F.col("l_partkey").alias("idx"), (1.0 / (1 + F.col("l_partkey") % 97)).alias("value"))
    return matrix.times_blocks(blocks, x).select("idx", r("value", 5).alias("value"))


WALK_MATRIX = """e as (select l_returnflag f, 'p' || l_partkey a, 's' || l_suppkey b, l_quantity q from lineitem union all select l_returnflag, 's' || l_suppkey, 'p' || l_partkey, l_quantity from lineitem),
d as (select f, a, sum(q) d from e group by all), m as (select e.f, e.a as row, e.b col, sum(q) / any_value(d) v from e join d on d.f = e.f and d.a = e.a group by all)"""


def spread_matrix(spark, sf_dir) -> DataFrame:
    """For each return flag the graph of parts and suppliers as a walk: rows of weights that sum to 1, less the identity."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("f"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("q"))
    pairs = stored(li.groupBy("f", "p", "s").agg(F.sum("q").alias("q")), "pairs")  # both directions weigh the same
    out = []
    for own, other in (("p", "s"), ("s", "p")):
        d = pairs.groupBy("f", own).agg(F.sum("q").alias("d"))
        out.append(pairs.join(d, ["f", own]).select("f", text(own, own).alias("row"), text(other, other).alias("col"), (F.col("q") / F.col("d")).alias("value")))
        out.append(d.select("f", text(own, own).alias("row"), text(own, own).alias("col"), F.lit(-1.0).alias("value")))
    spread = stored(reduce(DataFrame.unionByName, out), "spread")
    forget(pairs)
    return spread


def series_sql(terms: int) -> str:
    """CTEs x1, x2, ...: terms of the Taylor series of x(1/2) for x' = (m - 1) x + b, from x0 and b (f, i, v)."""
    first = "select f, i, 0.5 * sum(v) v from (select m.f, m.row i, m.v * x0.v v from m join x0 on x0.f = m.f and x0.i = m.col union all select f, i, -v from x0 union all select f, i, v from b) group by all"
    return f"x1 as materialized ({first})," + ",".join(
        f"x{k} as materialized (select f, i, {0.5 / k!r} * sum(v) v from (select m.f, m.row i, m.v * t.v v from m join x{k - 1} t on t.f = m.f and t.i = m.col union all select f, i, -v from x{k - 1}) group by all)" for k in range(2, terms + 1)
    )


@registered(f"""with {WALK_MATRIX}, x0 as (select f, a i, case when a[1] = 's' then 1.0::double else 0 end v from d), b as (select f, a i, case when a[1] = 'p' then 0.1::double else 0 end v from d),
{series_sql(16)}, z as (select * from x0 union all {" union all ".join(f"select * from x{k}" for k in range(1, 17))})
select f, i node, round(sum(v), 8) as value from z group by all""")
def q63_ode_answers(spark, sf_dir):
    """Heat that suppliers hold and parts are given, spread over every return flag's graph for half a unit of time."""
    m = spread_matrix(spark, sf_dir)
    nodes = m.where("row = col").select("f", F.col("row").alias("idx"))
    is_s = F.col("idx").startswith("s")
    x0 = nodes.withColumn("value", F.when(is_s, 1.0).otherwise(0.0))
    b = nodes.withColumn("value", F.when(is_s, 0.0).otherwise(0.1))
    return matrix.ode_solution(m, x0, b, 0.5, ["f"]).select("f", F.col("idx").alias("node"), r("value", 8).alias("value"))


@registered("""with recursive e as (select 'p' || l_partkey a, 's' || l_suppkey b from lineitem where l_quantity <= 2 and l_discount = 0),
b as (select a, b from e union select b, a from e),
c(node, rep) as (select a, a from b union select b.b, c.rep from c join b on b.a = c.node)
select node, min(rep) component from c group by node""")
def q64_components_kept_up_to_date(spark, sf_dir):
    """Components of the lines shipped before 1995, then the later ones merged in; the first are not read again."""
    li = table(spark, sf_dir, "lineitem").where("l_quantity <= 2 and l_discount = 0")
    e = li.select(text("p", "l_partkey").alias("a"), text("s", "l_suppkey").alias("b"), (F.col("l_shipdate") < "1995-01-01").alias("old"))
    known = stored(graph.connected_components(e.where("old").select("a", "b")), "known")
    return graph.merged_components(known, e.where("not old").select("a", "b"))


@registered("""with p as (select c_nationkey n, c_acctbal v from customer), q as (select s_nationkey n, s_acctbal v from supplier),
s as (select p.n, p.v + q.v v, row_number() over (partition by p.n order by p.v + q.v) place from p join q using (n)) select n nation, place, round(v, 2) as value from s where place <= 40""")
def q65_least_sums(spark, sf_dir):
    """The 40 least sums of a customer's and a supplier's balance in every nation."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("value"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("value"))
    return matrix.least_sums([c, s], ["nation"], 40).select("nation", "place", r("value", 2).alias("value"))


@registered("""with n as (select s_nationkey k, s_suppkey s from supplier where s_acctbal <> 0), r as (select distinct k, l_partkey p, l_suppkey s from lineitem join n on s = l_suppkey),
c as (select count(*) lines, count(*) filter (l_returnflag = 'R') shorts from lineitem join n on s = l_suppkey),
x as (select (select count(*) from r) r, (select count(*) from n) v, (select count(distinct (k, p)) from r) parts)
select 'merged_parallels' phase, r, parts c, 0::bigint i, v from x union all select 'collapse_shorts', r, parts, 0, v from x union all select 'ground_capacitors', r, parts, 0, v from x
union all select 'norton', r, parts, r, 0 from x union all select 'fill_capacitors', r, parts, r, 0 from x""")
def q66_phase_counts(spark, sf_dir):
    """Each nation's suppliers as sources that feed the parts they sell through resistors, a capacitor a line at each part; what every stage leaves."""
    s = table(spark, sf_dir, "supplier").where("s_acctbal <> 0").select(F.col("s_nationkey").cast("string").alias("circuit"), "s_suppkey", "s_acctbal")
    li = table(spark, sf_dir, "lineitem").join(s.select("circuit", F.col("s_suppkey").alias("l_suppkey")), "l_suppkey")
    part = lambda df, kind, name, a, b, v: df.select("circuit", F.lit(kind).alias("kind"), name.alias("name"), a.alias("node1"), b.alias("node2"), v.alias("value"), no_pulse().alias("pulse"))
    item = F.concat_ws("_", F.lit(""), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    made = part(li, "r", F.concat(F.lit("r"), item), text("s", "l_suppkey"), text("p", "l_partkey"), F.col("l_quantity"))
    made = made.unionByName(part(li, "c", F.concat(F.lit("c"), item), text("p", "l_partkey"), F.lit("0"), F.col("l_quantity")))
    made = made.unionByName(part(s, "v", text("v", "s_suppkey"), text("s", "s_suppkey"), F.lit("0"), F.col("s_acctbal")))
    phases: list[dict] = []
    forget(netlist.reduced(stored(made, "parts"), phases=phases))
    return spark.createDataFrame([(p["phase"], *(p[k] for k in "rciv")) for p in phases], "phase string, r long, c long, i long, v long")  # a row a stage


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
