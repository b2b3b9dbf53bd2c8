import itertools
import math
import random

import pytest

from ohmweave.operators import assemble, generate, graph, netlist, stepper
from ohmweave.plans import commands, sweeps
from ohmweave.sources import netlist_text


def parts_of(spark, *lines):
    df = spark.createDataFrame([("x", i, t) for i, t in enumerate(("title", *lines))], "circuit string, line_no int, line string")
    return netlist_text.components(df)


def rows(df):
    return {r.name: (r.node1, r.node2, round(r.value, 9)) for r in df.collect()}


def test_parallel_parts_in_either_direction(spark):
    p = parts_of(spark, "r1 a b 2", "r2 b a 2", "r3 b c 5", "c1 a 0 1", "c2 0 a 2")
    got = rows(netlist.merge_parallel(netlist.merge_parallel(p, "r"), "c"))
    assert got == {"r_merged_r1_r2": ("a", "b", 1.0), "r3": ("b", "c", 5.0), "c_merged_c1_c2": ("0", "a", 3.0)}


def test_chain_of_shorts_to_ground(spark):
    p = parts_of(spark, "v1 a b 0", "l1 b c 9", "v2 c 0 0", "v3 d e 0", "r1 a d 1", "r2 e f 1")
    assert rows(netlist.collapse_shorts(p)) == {"r1": ("0", "d", 1.0), "r2": ("d", "f", 1.0)}


def test_series_capacitor_changes_places(spark):
    p = parts_of(spark, "r1 0 a 3", "c1 a b 2", "r2 b d 1", "c2 d 0 1")
    got = rows(netlist.ground_capacitors(p))
    assert got["c1"] == ("a", "0", 2.0)
    assert got["r1"] == ("b", "a", 3.0)
    assert got["r2"] == ("b", "d", 1.0)
    with pytest.raises(Exception, match="no grounded end"):
        netlist.ground_capacitors(parts_of(spark, "r1 z a 3", "c1 a b 2", "r2 b d 1")).collect()


def test_sources_become_currents(spark):
    p = parts_of(spark, "v1 s 0 6", "r1 s a 2", "r2 b s 3", "v2 0 t 4", "r3 t a 2")
    got = rows(netlist.norton(p))
    assert got == {"r1": ("0", "a", 2.0), "r2": ("b", "0", 3.0), "r3": ("0", "a", 2.0), "i_v1_r1": ("0", "a", 3.0), "i_v1_r2": ("0", "b", 2.0), "i_v2_r3": ("a", "0", 2.0)}
    with pytest.raises(Exception, match="no usable terminal"):
        netlist.norton(parts_of(spark, "v1 s 0 6", "r1 a b 1")).collect()
    with pytest.raises(Exception, match="terminal is gone"):
        netlist.norton(parts_of(spark, "v1 s 0 6", "r1 s b 1", "c1 s 0 1")).collect()


def test_long_merges_keep_short_names(spark):
    p = parts_of(spark, *(f"r{i} a b 4" for i in range(1, 9)))
    assert rows(netlist.merge_parallel(p, "r")) == {"r_merged_r1_to_r8_of_8": ("a", "b", 0.5)}
    assert {(r.node1, r.node2, r.name) for r in netlist.merged_names(p, "r").collect()} == {("a", "b", f"r{i}") for i in range(1, 9)}


def test_capacitors_of_one_pair_go_together(spark):
    p = parts_of(spark, "r1 0 a 3", "c1 a b 2", "c1 b a 5", "c1 e 0 7", "r2 b d 1", "c2 d 0 1")
    got = sorted((r.name, r.node1, r.node2, r.value) for r in netlist.ground_capacitors(p).where("kind = 'c'").collect())
    assert got == [("c1", "a", "0", 2.0), ("c1", "a", "0", 5.0), ("c1", "e", "0", 7.0), ("c2", "d", "0", 1.0)]


def one_after_the_other(lines):
    """Capacitors in the order of their lines, in plain Python; None where one finds no end."""
    parts = [x.split() for x in lines]
    res = {p[0]: p[1:3] for p in parts if p[0][0] == "r"}
    caps = [p for p in parts if p[0][0] == "c"]
    at = {}
    for name, ends in res.items():
        for end in ends:
            at.setdefault(end, set()).add(name)
    out = {}
    for name, a, b, _ in caps:
        out[name] = (a, b)
        if "0" in (a, b):
            continue
        for hot, other in ((a, b), (b, a)):
            mine = at.get(hot, set())
            if all("0" in res[r] for r in mine):
                for r in mine:
                    res[r] = [other if x == "0" else x for x in res[r]]
                    out[name] = (hot, "0")
                break
        else:
            return None
    return out | {k: tuple(v) for k, v in res.items()}


def test_capacitors_that_compete_for_nodes(spark):
    p = parts_of(spark, "r1 a 0 1", "c1 a b 1", "c2 a d 1", "r3 d e 1", "r4 b 0 1")
    with pytest.raises(Exception, match="no grounded end for capacitor c2"):
        netlist.ground_capacitors(p).collect()
    rng, seen = random.Random(5), 0
    for k in range(120):
        nodes = "abcdefgh"[: rng.randint(3, 8)]
        lines = [f"r{i} {n} 0 1" for i, n in enumerate(nodes) if rng.random() < 0.85]
        lines += [f"r{10 + i} {rng.choice(nodes)} z{rng.choice('0123')} 1" for i in range(rng.randint(0, 1))]
        pairs = [p for p in itertools.combinations(nodes, 2) if rng.random() < 2 / len(nodes)]
        rng.shuffle(pairs)
        lines += [f"c{i} {a} {b} 1" if rng.random() < 0.5 else f"c{i} {b} {a} 1" for i, (a, b) in enumerate(pairs)]
        want = one_after_the_other(lines)
        if want is None or seen >= 12 or k < 100 and len(pairs) < 4:
            continue
        seen += 1
        assert {n: v[:2] for n, v in rows(netlist.ground_capacitors(parts_of(spark, *lines))).items()} == want
    assert seen >= 8


def test_a_late_but_earlier_capacitor_gets_its_turn(spark):
    lines = ["r1 a 0 1", "r2 b 0 1", "r3 g 0 1", "r4 z 0 1", "c1 a z 1", "c2 a b 1", "c3 b g 1"]
    got = {n: v[:2] for n, v in rows(netlist.ground_capacitors(parts_of(spark, *lines))).items()}
    assert got == one_after_the_other(lines)
    assert got["c1"] == ("a", "0") and got["c2"] == ("b", "0") and got["c3"] == ("g", "0")


def test_sources_that_share_terminals_and_form_chains(spark):
    got = rows(netlist.norton(parts_of(spark, "v1 s 0 6", "v2 s t 4", "v3 u t 1", "r1 s a 2", "r2 t a 2", "r3 u a 1", "r4 s t 5")))
    assert got == {"r1": ("0", "a", 2.0), "r2": ("0", "a", 2.0), "r3": ("0", "a", 1.0), "i_v1_r1": ("0", "a", 3.0), "i_v2_r2": ("0", "a", 1.0), "i_v3_r3": ("0", "a", 3.0)} or got == {
        "r1": ("a", "0", 2.0),
        "r2": ("a", "0", 2.0),
        "r3": ("a", "0", 1.0),
        "i_v1_r1": ("0", "a", 3.0),
        "i_v2_r2": ("0", "a", 1.0),
        "i_v3_r3": ("0", "a", 3.0),
    }
    floating = rows(netlist.norton(parts_of(spark, "v1 a b 6", "v2 b d 4", "r1 a x 2", "r2 b x 2", "r3 d x 1")))
    assert floating == {"r1": ("d", "x", 2.0), "r2": ("d", "x", 2.0), "r3": ("d", "x", 1.0), "i_v1_r1": ("d", "x", 5.0), "i_v1_r2": ("d", "x", 2.0)}
    with pytest.raises(Exception, match="contradicting"):
        netlist.norton(parts_of(spark, "v1 s 0 6", "v2 s 0 4", "r1 s a 2")).collect()
    with pytest.raises(Exception, match="contradicting"):
        netlist.norton(parts_of(spark, "v1 a b 1", "v2 b d 1", "v3 d a 1", "r1 a x 2")).collect()
    agreeing = rows(netlist.norton(parts_of(spark, "v1 s 0 6", "v2 0 s -6", "r1 s a 2")))
    assert agreeing == {"r1": ("0", "a", 2.0), "i_v1_r1": ("0", "a", 3.0)}
    with pytest.raises(Exception, match="no usable terminal"):
        netlist.norton(parts_of(spark, "v1 s t 6", "v2 t 0 4", "r1 a b 1")).collect()


def test_potentials_of_a_long_chain(spark):
    edges = [(f"n{k + 1:03d}", f"n{k:03d}", float(k)) for k in range(120)]
    random.Random(3).shuffle(edges)
    got = {r.node: (r.component, r.lift) for r in graph.potentials(spark.createDataFrame(edges, "a string, b string, lift double")).collect()}
    assert got == {f"n{k:03d}": ("n000", float(k * (k - 1) // 2)) for k in range(121)}


def test_first_seen_numbers(spark):
    p = parts_of(spark, "r1 zed 0 1", "v1 zed mid 0", "r2 amp mid 1", "c1 0 bee 1", "r3 bee amp 1")
    shorts = netlist.short_circuit_map(p)
    numbers = netlist.node_numbers(netlist.collapse_shorts(p), netlist.first_seen(p, shorts))
    assert {r.node: r.idx for r in numbers.collect()} == {"0": 0, "mid": 1, "amp": 2, "bee": 3}
    plain = {r.node: r.idx for r in netlist.node_numbers(p.where("kind <> 'v'")).collect()}
    assert plain == {"0": 0, "zed": 1, "amp": 2, "mid": 3, "bee": 4}
    long = parts_of(spark, *(f"r{k} n{(k * 37) % 500} n{(k * 37 + 1) % 500} 1" for k in range(400)))
    assert {tuple(r) for r in netlist.node_numbers(long, most=50).collect()} == {tuple(r) for r in netlist.node_numbers(long).collect()}


def test_a_resistor_of_no_ohms_is_named(spark):
    with pytest.raises(Exception, match="a resistor of 0 ohms: r2"):
        netlist.merge_parallel(parts_of(spark, "r1 a b 1", "r2 a b 0"), "r").select("value").collect()


def test_missing_capacitors_get_the_mean(spark):
    got = rows(netlist.fill_capacitors(parts_of(spark, "r1 a b 1", "r2 b 0 1", "c1 a 0 2", "c2 a 0 4")))
    assert got["c_filled_b"] == ("b", "0", 3.0)
    assert "c_filled_a" not in got
    assert set(rows(netlist.fill_capacitors(parts_of(spark, "r1 a b 1")))) == {"r1"}


def test_refusals(spark):
    with pytest.raises(Exception, match="floating"):
        assemble.capacitances(parts_of(spark, "c1 a b 1")).collect()
    with pytest.raises(Exception, match="both ends alike"):
        netlist.node_numbers(parts_of(spark, "r1 a a 1")).collect()
    with pytest.raises(Exception, match="voltage source is left"):
        assemble.refuse_sources(parts_of(spark, "v1 a b 1")).collect()


def test_conductances_are_symmetric_and_ground_rows_drop(spark):
    g = {(r.row, r.col): r.value for r in assemble.conductances(parts_of(spark, "r1 a b 2", "r2 b 0 4")).collect()}
    assert g == {("a", "a"): 0.5, ("b", "b"): 0.75, ("a", "b"): -0.5, ("b", "a"): -0.5}


NETLIST = ["rc", "V1 s 0 2", "R1 s out 4", "C1 out 0 0.5", ".tran 0.05 1", ".print tran v(out)"]


@pytest.mark.parametrize("method", stepper.METHODS)
def test_pulse_response_of_one_node(spark, method):
    lines = [*NETLIST, "I1 out 0 0 pulse(0 1 0 0 0 100 1000)"]
    df = spark.createDataFrame([("x", i, t) for i, t in enumerate(lines)], "circuit string, line_no int, line string")
    got = commands.transient(df, steps=200, method=method).orderBy("step").collect()
    assert len(got) == 201
    # from the operating point with the pulse on, 2 - 4 * 1 = -2, nothing changes
    assert max(abs(r.value + 2) for r in got) < 1e-9


def test_printed_node_must_be_left(spark):
    make = lambda lines: spark.createDataFrame([("x", i, t) for i, t in enumerate(lines)], "circuit string, line_no int, line string")
    with pytest.raises(Exception, match="no such node"):
        commands.transient(make([*NETLIST[:-1], ".print tran v(s)"])).collect()
    with pytest.raises(Exception, match="nothing to print"):
        commands.transient(make(NETLIST[:-1])).collect()
    with pytest.raises(ValueError, match="exactly one"):
        commands.run("plot")


def test_line_netlist_settles_at_its_source(spark):
    shape = ", ".join(f"{v}D {k}" for k, v in {"volt": 1.8, "r": 0.03, "c": 5.37e-11, "v1": 0.0, "v2": 0.0, "td": 0.0, "tr": 1e-10, "tf": 1e-10, "pw": 1e-11, "per": 2e-9}.items())
    p = generate.line_netlist(spark.sql(f"select 'x' circuit, 12 size, 4 every, {shape}"))
    dc = stepper.dc_points(assemble.systems(netlist.reduced(p))).collect()
    assert len(dc) == 12
    assert all(math.isclose(r.value, 1.8, rel_tol=1e-9) for r in dc)


def test_singular_systems_are_refused(spark):
    p = parts_of(spark, "r1 a b 1", "c1 a 0 1", "c2 b 0 1")
    with pytest.raises(Exception, match="no single solution"):
        stepper.dc_points(assemble.systems(p)).collect()


LADDER = ["ladder", "V1 s 0 1", "R1 s a 1", "R2 a b 1", "R3 b out 2", "C1 a 0 0.5", "C2 b 0 1", "C3 out 0 0.25", "I1 out 0 0 pulse(0 0.3 0.2 0.1 0.1 0.3 5)", ".tran 0.02 1", ".print tran v(out)"]


def test_walks_and_trapezoid_agree(spark):
    df = spark.createDataFrame([("x", i, t) for i, t in enumerate(LADDER)], "circuit string, line_no int, line string")
    exact = {r.step: r.value for r in commands.run("tran", lines=df, steps=320).collect()}
    got = {r.step: r.value for r in commands.run("tran", lines=df, solver="monte-carlo", steps=320, outputs=40, samples=4000).collect()}
    assert sorted(got) == list(range(41))
    assert max(abs(got[k] - exact[8 * k]) for k in got) < 0.03
    assert abs(got[0] - 1.0) < 1e-9


def test_errors_fall_with_the_step(spark):
    df = spark.createDataFrame([("x", i, t) for i, t in enumerate(LADDER)], "circuit string, line_no int, line string")
    e = {r.steps: r.max_abs for r in sweeps.step_errors(commands.prepared(df), [20, 80], 1280).collect()}
    assert 0 < e[80] < e[20] < 0.05
