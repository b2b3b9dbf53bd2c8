import pytest
from pyspark.sql import functions as F

from ohmweave.functions import uniform, waveform
from ohmweave.operators import metrics, stepper
from ohmweave.streaming import series


@pytest.mark.parametrize(
    ("t", "want"), [(0.0, 1.0), (1.0, 1.0), (1.5, 2.0), (2.0, 3.0), (3.9, 3.0), (5.0, 2.0), (6.5, 1.0), (11.5, 2.0)],
)
def test_pulse_shape(spark, t, want):
    shape = {"v1": 1, "v2": 3, "td": 1, "tr": 1, "tf": 2, "pw": 2, "per": 10}
    assert spark.range(1).select(waveform.pulse_at(waveform.pulse(**shape), F.lit(t))).first()[0] == want
    assert stepper.pulse_value(shape, t) == want


def test_ramps_of_no_length_and_no_period(spark):
    shape = {"v1": 0, "v2": 5, "td": 0, "tr": 0, "tf": 0, "pw": 1, "per": 2}
    at = lambda s, t: (spark.range(1).select(waveform.pulse_at(waveform.pulse(**s), F.lit(t))).first()[0], stepper.pulse_value(s, t))
    assert at(shape, 0.0) == (5, 5)
    assert at(shape, 1.0) == (0, 0)
    assert at(shape | {"per": 0}, 0.5) == (0, 0)


def test_simpson_and_text(spark):
    n = spark.range(5).select(waveform.simpson_weight(F.col("id"), 4).alias("w")).collect()
    assert [r.w for r in n] == [1, 4, 2, 4, 1]
    got = spark.createDataFrame([(12345.0,), (0.00999,), (-0.5,), (0.0,), (9.99,)], "x double").select(uniform.scientific(F.col("x")).alias("s")).collect()
    assert [r.s for r in got] == ["1.2×10^4", "1.0×10^-2", "-5.0×10^-1", "0", "1.0×10^1"]


def test_interpolation_clamps_at_the_ends(spark):
    known = spark.createDataFrame([("a", 0.0, 1.0), ("a", 2.0, 3.0)], "k string, t double, value double")
    asked = spark.createDataFrame([("a", -1.0), ("a", 0.0), ("a", 0.5), ("a", 9.0)], "k string, t double")
    assert [r.value for r in metrics.interpolated(asked, known, ["k"]).orderBy("t").collect()] == [1.0, 1.0, 1.5, 3.0]


def test_a_single_point_has_all_the_weight(spark):
    s = spark.createDataFrame([("a", 5.0), ("b", 0.0), ("b", 1.0), ("b", 4.0)], "k string, t double")
    got = sorted((r.k, r.t, r.w) for r in metrics.time_weights(s, ["k"]).collect())
    assert got == [("a", 5.0, 1.0), ("b", 0.0, 0.125), ("b", 1.0, 0.5), ("b", 4.0, 0.375)]


def test_fits_recover_their_parameters(spark):
    p = spark.createDataFrame([("a", float(x), 0.5 * x**-2.0 + 3.0, 1 / (0.2 + 0.8 / x)) for x in range(1, 9)], "g string, x double, y double, s double")
    f = metrics.offset_power_fit(p, ["g"]).first()
    assert (round(f.alpha, 7), round(f.k, 6), round(f.c, 6)) == (-2.0, 0.5, 3.0)
    assert round(metrics.amdahl_fit(p, ["g"], "x", "s").first().s, 8) == 0.2
    odd = spark.createDataFrame([(g, float(x), 2.0 * x**a - 1.0, 1 / (q + (1 - q) / x)) for g, a, q in ((None, 0.4567891, 0.1234567), ("b", -1.2345678, 0.9876543), ("c", 3.0, 0.0005)) for x in range(1, 30)], "g string, x double, y double, s double")
    assert {r.g: round(r.alpha, 6) for r in metrics.offset_power_fit(odd, ["g"]).collect()} == {None: 0.456789, "b": -1.234568, "c": 3.0}
    assert {r.g: round(r.s, 7) for r in metrics.amdahl_fit(odd, ["g"], "x", "s").collect()} == {None: 0.1234567, "b": 0.9876543, "c": 0.001}


def test_stream_gives_the_batch_result(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = series.windowed_metrics(stream, ["event_type"], width="1 day", late="60 days").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    cut = lambda df: sorted((r.event_type, r.start, r.n, round(r.mean, 6), round(r.rms, 6), r.largest) for r in df.collect())
    assert cut(spark.table("windows")) == cut(series.windowed_metrics(events, ["event_type"], width="1 day"))


def test_windowed_injections(spark):
    rows = [("2024-01-01 00:10:00", "a", "b", 2.0), ("2024-01-01 00:50:00", "b", "0", 0.5), ("2024-01-01 01:10:00", "a", "b", 1.0)]
    df = spark.createDataFrame(rows, "ts string, node1 string, node2 string, value double")
    got = sorted((r.start.hour, r.node, r.dc) for r in series.stamped_injections(df).collect())
    assert got == [(0, "a", -2.0), (0, "b", 1.5), (1, "a", -1.0), (1, "b", 1.0)]
