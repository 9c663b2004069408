import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgap.operators.unit_values import fit_mixture, symbol_widths, with_common_unit, wrong_widths

SYMBOLS = "symbol_id bigint, job_id string, layer string, raw_name string, width_mm double, loaded_at timestamp"
CASES = {
    "r300.0": ("um", 300_000), " RECT1280.0x1800.0": ("um", 1_280_000), "oval7x5.0 I": ("mil", 177_800), "r590 M": ("um", 590_000), "rect15,0milsx26,0mils": ("mil", 381_000),
    "r[inch]0.035": ("inch", 889_000), 'r["]0.02': ("inch", 508_000), "r150 μm": ("um", 150_000), "r150µm": ("um", 150_000), "rect0.3x0.470xr0.07mm": ("mm", 300_000),
    "rect0.0292x0.0394xr0.0073inch": ("inch", 741_680), "r45 th": ("mil", 1_143_000), 'r0.0182"': ("inch", 462_280), "rect1 mmx20 mil": ("mm", 1_000_000), "r0.67 MM": ("mm", 670_000),
}


@pytest.mark.parametrize("units, factor", [("Metric", 1_000), (" Inch", 25_400)])
def test_bare_numbers_follow_the_job(spark, units, factor):
    symbols = spark.createDataFrame([(1, "j", "l", "r12.5", 0.1, None), (2, "j", "l", "star_a", 0.1, None), (3, "j", "l", None, None, None)], SYMBOLS)
    jobs = spark.createDataFrame([("j", units)], "job_id string, units string")
    out = {r.symbol_id: r for r in symbol_widths(symbols, jobs).collect()}
    assert out[1].width_nm == 12.5 * factor and out[1].unit_source == "job"
    assert out[2].width_nm is None and out[3].width_nm is None


def test_written_units_win(spark):
    symbols = spark.createDataFrame([(k, "j", "l", name, None, None) for k, name in enumerate(CASES)], SYMBOLS)
    jobs = spark.createDataFrame([("j", "MM")], "job_id string, units string")
    out = {r.raw_name: (r.unit, r.width_nm) for r in symbol_widths(symbols, jobs).collect()}
    assert out == CASES


def test_wrong_widths_and_redelivery(spark):
    rows = [
        (1, "j", "l", "r300", 0.3, None), (2, "j", "l", "r300", 0.300001, None), (3, "j", "l", "r300", 0.3000011, None), (4, "j", "l", "r300", float("nan"), None),
        (5, "j", "l", "r300", None, None), (6, "j", "l", "x", 5.0, None), (1, "j", "l", "r300", 0.3, None), (None, "j", "l", "r300", 300.0, None),
    ]
    jobs = spark.createDataFrame([("j", "mm")], "job_id string, units string")
    out = wrong_widths(symbol_widths(spark.createDataFrame(rows, SYMBOLS), jobs))
    assert sorted((r.symbol_id or 0, r.width_nm) for r in out.collect()) == [(0, 300_000), (3, 300_000), (4, 300_000), (5, 300_000)]


def test_mixture_assigns_units_of_groups_and_flags_doubt(spark):
    rnd = random.Random(5)
    rows = []
    for g in range(60):
        unit, factor = (("um", 0.001), ("mil", 0.0254))[g % 2]
        for _ in range(30):
            mm = math.exp(rnd.gauss(math.log(0.5), 0.6))
            rows.append((f"g{g}", round(mm / factor, 3), unit if g < 20 else None, unit))
    rows.append((None, 100.0, None, None))
    df = spark.createDataFrame(rows, "group string, number double, unit string, truth string").withColumn("number", F.col("number").cast("decimal(24,10)"))
    out = with_common_unit(df).collect()
    guessed = [r for r in out if r.unit_source == "mixture" and r.truth]
    assert len(guessed) == 40 * 30
    assert np.mean([r.unit == r.truth for r in guessed]) > 0.99
    lone = next(r for r in out if r.group is None)
    assert lone.unit in ("um", "mil") and lone.unit_uncertain


def test_fit_recovers_the_weights():
    grid = np.arange(-1000, 1001) * 0.01
    rnd = np.random.default_rng(1)
    logs = np.concatenate([rnd.normal(math.log(500), 0.3, 3000), rnd.normal(math.log(500 / 25.4), 0.3, 1000)])
    counts = np.bincount(np.round(logs / 0.01).astype(int) + 1000, minlength=2001)
    model = fit_mixture(grid, np.zeros(2001), counts, ("um", "mil"))
    assert abs(model.weights["um"] - 0.75) < 0.03 and abs(model.mean - math.log(0.5)) < 0.05


def test_empty(spark):
    jobs = spark.createDataFrame([], "job_id string, units string")
    assert symbol_widths(spark.createDataFrame([], SYMBOLS), jobs).collect() == []


def test_hidden_units_are_found_again(spark):
    from sparkgap.operators.unit_values import held_out_units, unit_calibration

    rnd = random.Random(8)
    symbols, jobs = [], []
    for j in range(40):
        unit, factor = (("mm", 0.001), ("inch", 0.0254))[j % 2]
        jobs.append((f"j{j}", unit))
        for k in range(25):
            mm = math.exp(rnd.gauss(math.log(0.5), 0.6))
            symbols.append((j * 100 + k, f"j{j}", "l", f"r{mm / factor:.2f}", None, None))
    jobs.append(("none", None))
    symbols += [(9001, "none", "l", "r3 mil", None, None), (9002, "j0", "l", "r0.5mm", None, None), (9003, None, "l", "r5", None, None)]
    out = held_out_units(spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(jobs, "job_id string, units string"))
    got = {r.job_id: r for r in out.collect()}
    assert len(got) == 40 and {r.n_symbols for r in got.values()} == {25}
    assert sum(r.agrees for r in got.values()) >= 39 and {r.given_unit for r in got.values()} == {"um", "mil"}
    assert sum(r.n_jobs for r in unit_calibration(out).collect()) == 40
    assert held_out_units(spark.createDataFrame([], SYMBOLS), spark.createDataFrame([], "job_id string, units string")).collect() == []


@pytest.mark.parametrize("most", [10, 0])
def test_join_with_few_rows_spreads_a_hot_key(spark, most):
    from sparkgap.tables import join_few

    rows = spark.createDataFrame([("hot" if k % 2 else f"k{k % 6}" if k % 7 else None, k) for k in range(200)], "key string, v int")
    few = spark.createDataFrame([("hot", 1), ("k0", 2), (None, 3)], "name string, w int")
    expected = sorted((k, v, {"hot": 1, "k0": 2}.get(k)) for k, v in map(tuple, rows.filter("key is not null").collect()))
    got = join_few(rows, few, {"key": "name"}, most=most)
    assert got.columns == ["key", "v", "w"]
    assert sorted(map(tuple, got.filter("key is not null").collect())) == sorted(expected, key=lambda r: (r[0], r[1]))
    assert {r.w for r in got.filter("key is null").collect()} == {None}
    assert {r.w for r in join_few(rows, few, {"key": "name"}, null_safe=True, most=most).filter("key is null").collect()} == {3}
