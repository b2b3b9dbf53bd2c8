import pytest

from ohmweave.sources import matrix_text, netlist_text, results, store

LINES = ["A Title V1", "* comment", "", "Vdd a 0 1.8", "R1 a,b (2.5)", "i1 b 0 1e-3 pulse(1,2,3,4,5,6,7)", "C1 b 0 1e-9", "L1 b c 3", "? what", ".tran 1e-2 1", ".print tran V(b) v( c )", ".print ac v(z)", ".end"]


@pytest.fixture
def lines(spark):
    return spark.createDataFrame([("x", i, t) for i, t in enumerate(LINES)], "circuit string, line_no int, line string")


def test_coo_round_trip(spark, tmp_path):
    cells = [(0, 0, -2.0), (0, 1, 1.0), (1, 0, 1.5), (2, 2, 1e-7)]
    df = spark.createDataFrame(cells, "row long, col long, value double")
    matrix_text.write_coo(df, 3, 3, f"{tmp_path}/m")
    got = matrix_text.read_coo(spark, f"{tmp_path}/m")
    assert sorted((r.row, r.col, r.value) for r in got.collect()) == cells
    assert {(r.rows, r.cols) for r in got.collect()} == {(3, 3)}


@pytest.mark.parametrize("text", ["2,2,2\n1,1,1\n", "2,2,1\n3,1,1\n", "2,2,1\n1,x,1\n", "2,2\n1,1,1\n"])
def test_coo_errors(spark, tmp_path, text):
    (tmp_path / "m.csv").write_text(text)
    with pytest.raises(Exception, match="header|bounds|bad"):
        matrix_text.read_coo(spark, str(tmp_path / "m.csv")).collect()


def test_dense_and_vector(spark, tmp_path):
    (tmp_path / "d").write_text("2\n0,1\n0,3\n")
    (tmp_path / "v").write_text("3\n1,2.5,-1e-3\n")
    (tmp_path / "w").write_text("2\n1\n")
    assert sorted((r.row, r.col, r.value) for r in matrix_text.read_dense(spark, str(tmp_path / "d")).collect()) == [(0, 0, 0.0), (0, 1, 1.0), (1, 1, 3.0)]
    assert [(r.idx, r.value) for r in matrix_text.read_vector(spark, str(tmp_path / "v")).orderBy("idx").collect()] == [(0, 1.0), (1, 2.5), (2, -0.001)]
    with pytest.raises(Exception, match="length"):
        matrix_text.read_vector(spark, str(tmp_path / "w")).collect()


def test_netlist_lines(lines):
    parts = {r.name: r for r in netlist_text.components(lines).collect()}
    assert set(parts) == {"vdd", "r1", "i1", "c1", "v_l1"}
    assert (parts["v_l1"].kind, parts["v_l1"].value) == ("v", 0.0)
    assert tuple(parts["i1"].pulse) == (1, 2, 3, 4, 5, 6, 7)
    assert (parts["r1"].node1, parts["r1"].node2, parts["r1"].value) == ("a", "b", 2.5)
    s = netlist_text.settings(lines).first()
    assert (s.title, s.tstep, s.tstop, s.print) == ("A Title V1", 0.01, 1.0, ["b", "c"])
    assert [r.line for r in netlist_text.unknown_lines(lines).collect()] == ["? what"]


def test_netlist_written_and_read_again(spark, lines, tmp_path):
    parts, setting = netlist_text.components(lines), netlist_text.settings(lines)
    netlist_text.write_netlist(parts, setting, f"{tmp_path}/n")
    again = netlist_text.read_lines(spark, f"{tmp_path}/n/*/*.txt")
    cut = lambda df: sorted((r.kind, r.name, r.node1, r.node2, r.value, r.pulse) for r in df.collect())
    assert cut(netlist_text.components(again)) == cut(parts)
    s = netlist_text.settings(again).first()
    assert (s.title, s.tstep, s.tstop, s.print) == ("A Title V1", 0.01, 1.0, ["b", "c"])


def test_suffixes_are_refused(spark):
    bad = spark.createDataFrame([("x", 1, "R1 a b 1k")], "circuit string, line_no int, line string")
    with pytest.raises(Exception, match="not a number"):
        netlist_text.components(bad).collect()


def test_printed_results_and_cache(spark, tmp_path):
    df = spark.createDataFrame([("1e-3 0.5",), (" 2  -1.5E-2 ",), ("ODE time: 3.5 s",), ("4 5 6",), ("x",)], "line string")
    assert [(r.time, r.value) for r in results.waveform_rows(df, []).collect()] == [(0.001, 0.5), (2.0, -0.015)]
    assert [(r.phase, r.seconds) for r in results.timing_rows(df, []).collect()] == [("ODE", 3.5)]
    assert [(r.time, r.value) for r in results.indexed_rows(df, []).collect()] == [(5.0, 6.0)]
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for seed in (1, 1, -1, -1):
        assert results.cached(spark, str(tmp_path / "c"), {"n": 4, "seed": seed}, make).count() == 3
    assert len(made) == 3


def test_a_cached_result_goes_with_its_inputs(spark, tmp_path):
    made = []

    def of():
        df = spark.read.text(str(tmp_path / "in"))
        return results.cached(spark, str(tmp_path / "c"), {"k": 1}, lambda: made.append(1) or df, [df]).count()

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\n")
    assert (of(), of(), len(made)) == (1, 1, 1)
    (tmp_path / "in" / "b.txt").write_text("two\n")
    assert (of(), of(), len(made)) == (2, 2, 2)
    (tmp_path / "in" / "b.txt").write_text("two\nthree\n")
    assert (of(), len(made)) == (3, 3)
    assert len(list((tmp_path / "c").iterdir())) == 3


@pytest.fixture
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "2000b")
    yield
    spark.conf.set(key, before)


def test_large_files_are_read_by_many_tasks(spark, tmp_path, small_splits):
    (tmp_path / "a.sp").write_text("\r\n".join(f"line {i} of a" for i in range(900)))
    (tmp_path / "b.sp").write_text("title\n\n" + "\n".join(f"r{i} a{i} b 1" for i in range(700)) + "\n")
    lines = netlist_text.read_lines(spark, str(tmp_path / "*.sp"))
    assert spark.read.text(str(tmp_path / "*.sp")).rdd.getNumPartitions() > 5
    got = {(r.circuit[-4:], r.line_no): r.line for r in lines.collect()}
    assert got == {("a.sp", i): f"line {i} of a" for i in range(900)} | {("b.sp", 0): "title", ("b.sp", 1): ""} | {("b.sp", i + 2): f"r{i} a{i} b 1" for i in range(700)}
    n = 60
    (tmp_path / "d").write_text(f"{n}\n\n" + "\n".join(",".join(str((i * j) % 7) for j in range(n)) for i in range(n)) + "\n")
    dense = {(r.row, r.col): r.value for r in matrix_text.read_dense(spark, str(tmp_path / "d")).collect()}
    assert dense == {(i, j): float((i * j) % 7) for i in range(n) for j in range(n) if (i * j) % 7 or i == j}
    (tmp_path / "v").write_text("3000\n" + ",".join(f"{i}.5" for i in range(3000)) + "\n")
    assert {r.idx: r.value for r in matrix_text.read_vector(spark, str(tmp_path / "v")).collect()} == {i: i + 0.5 for i in range(3000)}


def test_written_vectors_and_dense_matrices(spark, tmp_path):
    values = spark.createDataFrame([("a", i, i / 7) for i in range(100)] + [("b", 0, -1.5)], "name string, idx long, value double")
    matrix_text.write_vectors(values, f"{tmp_path}/v")
    got = {(r.file.split("name=")[1][0], r.idx): r.value for r in matrix_text.read_vector(spark, f"{tmp_path}/v/*").collect()}
    assert got == {(r.name, r.idx): r.value for r in values.collect()}
    cells = spark.createDataFrame([("a", 0, 1, 2.5), ("a", 2, 2, 1.0), ("b", 1, 0, 3.0)], "name string, row int, col int, value double")
    matrix_text.write_dense(cells, 3, f"{tmp_path}/d")
    got = {(r.file.split("name=")[1][0], r.row, r.col): r.value for r in matrix_text.read_dense(spark, f"{tmp_path}/d/*").collect()}
    want = {("a", i, i): 0.0 for i in range(3)} | {("b", i, i): 0.0 for i in range(3)} | {(r.name, r.row, r.col): r.value for r in cells.collect()}
    assert got == want


def test_an_empty_vector(spark, tmp_path):
    (tmp_path / "v").write_text("0\n\n")
    assert matrix_text.read_vector(spark, str(tmp_path / "v")).count() == 0


def test_hot_keys_of_a_join_need_no_python_workers(spark):
    rows = [(b"hub", k) for k in range(300)] + [(bytes([k]), k) for k in range(20)] + [(None, 0)]
    left = spark.createDataFrame(rows, "key binary, n int")
    right = spark.createDataFrame([(b"hub", "x"), (bytes([3]), "y")], "key binary, name string")
    left, right = store.stored(left, "left"), store.stored(right, "right")
    out = store.join_split(left, right, "key", "left")
    assert sorted((r.n, r.name or "") for r in out.collect()) == sorted((n, "x" if k == b"hub" else "y" if k == bytes([3]) else "") for k, n in rows)
    assert "ExistingRDD" not in out._jdf.queryExecution().toString()
