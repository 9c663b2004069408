import random

import pytest

from sparkgap.llm import top_items as ti

SCHEMA = "k string, j int, score double, tie string, id bigint, pos_in int"


def brute(rows, n):
    groups = {}
    for r in rows:
        if r[2] is not None and r[2] == r[2]:
            groups.setdefault((r[0], r[1]), []).append(r)
    out = []
    for key, members in groups.items():
        members.sort(key=lambda r: (r[2], r[3] is None, r[3] or "", r[4] is None, r[4] or 0))
        out += [(*key, r[4], p) for p, r in enumerate(members[:n], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_agrees_with_sorting_every_group(spark, monkeypatch, broadcast):
    monkeypatch.setattr(ti, "BROADCAST_GROUPS", broadcast)
    rnd = random.Random(4)
    rows = []
    for i in range(6000):
        key = rnd.choice(["hot"] * 6 + ["a", "b", None, ""])
        score = rnd.choice([None, float("nan"), 0.0, -1.0, -0.0, float("inf"), 1e-300, rnd.random(), round(rnd.random(), 1), round(rnd.random(), 1)])
        rows.append((key, rnd.choice([1, 2, None]), score, rnd.choice(["x", "y", None]), i, 7))
    out = ti.top_items(spark.createDataFrame(rows, SCHEMA), ["k", "j"], "score", ["tie", "id"], 3, small=50)
    got = sorted(((r.k, r.j, r.id, r.pos) for r in out.collect()), key=repr)
    assert got == brute(rows, 3)


def test_bins_never_fall_as_scores_rise(spark):
    scores = sorted([0.0, -3.0, 1e-320, 1e-30, 0.1, 0.1000001, 0.5, 1.0, 7.0, 1e300, float("inf")])
    bins = [r.b for r in spark.createDataFrame([(s,) for s in scores], "s double").select("s", ti.score_bin(ti.F.col("s")).alias("b")).orderBy("s").collect()]
    assert bins == sorted(bins)


def test_last_delivery_counts(spark):
    import datetime as dt

    t = lambda h: dt.datetime(2030, 1, 1, h)
    rows = [
        (1, "j", " f.cu", "A", "B", 0.1, t(1), "x"), (1, "j", "F.CU ", "A", "B", 0.9, t(2), "x"), (2, "j", "F.CU", "A", "C", 0.2, t(1), "x"), (3, "j", "F.CU", "A", "B", 0.2, t(1), "x"),
        (4, "j", "F.CU", "A", "D", -1.0, t(1), "x"), (5, "j", "F.CU", "A", "D", None, t(3), "x"), (5, "j", "F.CU", "A", "D", 0.01, t(1), "x"), (None, "j", "F.CU", "A", "E", 0.5, t(1), "x"),
        (6, "j", "F.CU", "A", "Z", 0.2, t(1), "x"),
    ]
    df = spark.createDataFrame(rows, "measurement_id bigint, job_id string, layer string, net_a string, net_b string, clearance_mm double, loaded_at timestamp, pos string")
    out = ti.closest_measurements(df, 4)
    assert sorted((r.pos, r.measurement_id) for r in out.collect()) == [(1, 3), (2, 2), (3, 6), (4, None)]
    assert ti.closest_measurements(df.limit(0)).collect() == []


@pytest.mark.parametrize("largest", [False, True])
def test_crowded_bins_negative_scores_and_either_end(spark, monkeypatch, largest):
    monkeypatch.setattr(ti, "CROWDED", 2)
    rnd = random.Random(9)
    rows = [(rnd.choice(["hot", "hot", "a", None]), 1, rnd.choice([-5.0 - rnd.random() / 100, -5.0, 4.0 + rnd.random() / 1000, 0.0]), "x", i, 7) for i in range(3000)]
    out = ti.top_items(spark.createDataFrame(rows, SCHEMA), ["k", "j"], "score", ["id"], 4, largest=largest)
    turned = [(k, j, -s if largest else s, None, i, p) for k, j, s, _, i, p in rows]
    assert sorted(((r.k, r.j, r.id, r.pos) for r in out.collect()), key=repr) == brute(turned, 4)


def test_thresholds_leave_little_more_than_n(spark):
    rnd = random.Random(11)
    rows = [("hot", -1000.0 + rnd.random() * 10, i) for i in range(20000)] + [("cold", float(i), i) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, score double, id bigint").withColumn("__place", ti.score_place(ti.F.col("score")))
    limits, n_large = ti.group_thresholds(df, ["k"], 3, 24, ["score", "id"])
    (limit,) = limits.collect()
    kept = df.filter((ti.F.col("k") == "hot") & (ti.F.col("__place") <= limit["__limit"])).count()
    assert n_large == 1 and limit.k == "hot" and 3 <= kept < 400
