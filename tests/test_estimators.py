import pytest
from pyspark.sql import functions as F

from sparkgap.functions import estimators as est
from sparkgap.functions.layers import layer_role

FACTORS = [(0, 1.0), (2000, 1.0), (2500, 1.07), (5500, 1.59), (9000, 2.575), (20000, 2.9), (-5, 1.0)]
EFFECTIVE = [(0.0, 2, 0.0), (0.15, 2, 7.5), (1.0, 2, 61.538462), (8.0, 2, 500.0), (20.0, 2, 1228.571429), (60.0, 2, 1500.0), (1.0, 1, 107.232704), (1.0, 3, 36.447811), (-1.0, 2, None), (None, 2, None), (float("nan"), 2, None)]
IPC = [(0.03, 9, 4.5, 4.5), (0.05, 30, 7.5, 7.5), (0.1, 100, 30, 30), (0.25, 500, 30, 30), (0.6, 640, 150, 50), (1.5, 1000, 300, 100), (3.0, 1600, 600, 100), (20.0, 5000, 4000, 800), (None, None, None, None), (-0.1, None, None, None)]


def test_altitude(spark):
    df = spark.createDataFrame([(float(a), f) for a, f in FACTORS], "a double, want double")
    assert all(r.got == pytest.approx(r.want) for r in df.withColumn("got", est.altitude_factor(F.col("a"))).collect())


def test_effective_voltage(spark):
    df = spark.createDataFrame(EFFECTIVE, "d double, p int, want double")
    for r in df.withColumn("got", est.effective_voltage(F.col("d"), 175, F.col("p"), 5500)).collect():
        assert r.got is None if r.want is None else r.got == pytest.approx(r.want, abs=1e-6), r


def test_ipc_voltage(spark):
    df = spark.createDataFrame([(d, *[None if v is None else float(v) for v in vs]) for d, *vs in IPC], "d double, b1 double, b2 double, b3 double")
    got = df.select("*", est.ipc_voltage(F.col("d"), F.lit(" Inner ")).alias("g1"), est.ipc_voltage(F.col("d"), F.lit("external"), 3050.0).alias("g2"), est.ipc_voltage(F.col("d"), F.lit(None).cast("string"), 3051).alias("g3"))
    for r in got.collect():
        for want, have in ((r.b1, r.g1), (r.b2, r.g2), (r.b3, r.g3)):
            assert have is None if want is None else have == pytest.approx(want, abs=1e-6), r


def test_groups_pollution_and_particles(spark):
    row = spark.range(1).select(
        *[est.material_group(c).alias(f"g{k}") for k, c in enumerate((600, 599, 400, 175, 100, 99))],
        est.layer_pollution(F.lit("internal"), F.lit(True), 3).alias("p1"), est.layer_pollution(F.lit("external"), F.lit(True), 3).alias("p2"), est.layer_pollution(F.lit("external"), F.lit(False), 9).alias("p3"),
        est.without_particle(F.lit(0.3), F.lit("external"), 0.5).alias("d1"), est.without_particle(F.lit(0.3), F.lit("internal"), 0.5).alias("d2"),
    ).first()
    assert list(row) == ["I", "II", "II", "IIIa", "IIIb", "below IIIb", 1, 2, 4, 0.0, 0.3]


def test_layer_roles(spark):
    cases = [("F.CU", 0, 4, "external"), ("in1", 1, 4, "internal"), ("Inner_2", 3, 4, "internal"), ("midplane", 0, 4, "external"), ("GND_PLANE", 1, 4, "internal"), ("L2", 1, 4, "internal"), ("L4", 3, 4, "external"), ("x", 0, 2, "external"), ("x", 1, 3, "internal"), ("top_sig", 2, 4, "external")]
    df = spark.createDataFrame(cases, "n string, i int, t int, want string").withColumn("got", layer_role(F.col("n"), F.col("i"), F.col("t")))
    assert [r.n for r in df.filter("got <> want").collect()] == []
