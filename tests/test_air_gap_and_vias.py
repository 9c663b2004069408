import csv
import os
import random
import zipfile

import numpy as np
from pyspark.sql import functions as F
from test_compositing import SCHEMA, box
from test_spacing_and_archive import FILES

from sparkgap import cli
from sparkgap.geometry.air_gap import covered_stretches, effective_gaps
from sparkgap.geometry.compositing import Polygon, composited_pairs, is_copper, net_polygons
from sparkgap.geometry.shapes import with_shapes
from sparkgap.operators.vias import via_pads

SCOPE = ["job_id", "layer"]


def gaps(spark, rows):
    df = with_shapes(spark.createDataFrame(rows, SCHEMA))
    return {(r.net_a, r.net_b): r for r in effective_gaps(composited_pairs(df, None, SCOPE), net_polygons(df, SCOPE), SCOPE).collect()}


def test_copper_between_two_nets_is_subtracted(spark):
    out = gaps(spark, [box(0, "A", 0, 0, 1, 1), box(1, "B", 4, 0, 5, 1), box(2, "MID", 2, -9, 3, 9), box(3, None, 2, 20, 3, 21), box(4, "FAR", 4, 21, 5, 22)])
    ab = out["A", "B"]
    assert (round(ab.direct_clearance_mm, 6), round(ab.effective_air_gap_mm, 6), round(ab.copper_blocked_length_mm, 6), ab.copper_on_path, ab.blocker_nets) == (3.0, 2.0, 1.0, True, "MID")
    am = out["A", "MID"]
    assert (am.effective_air_gap_mm, am.copper_on_path, am.blocker_nets) == (1.0, False, "")
    assert len(out) == 6


def test_touching_nets_keep_their_clearance_and_cuts_count(spark):
    out = gaps(spark, [box(0, "A", 0, 0, 1, 1), box(1, "B", 1, 0, 2, 1), box(2, "C", 6, 0, 7, 1), box(3, "BAR", 3, -5, 5, 5), box(4, None, 3.5, -6, 4.5, 6, "N")])
    assert out["A", "B"].effective_air_gap_mm == 0 and not out["A", "B"].copper_on_path
    assert round(out["B", "C"].effective_air_gap_mm, 6) == 3.0 and out["B", "C"].blocker_nets == "BAR"
    assert effective_gaps(composited_pairs(with_shapes(spark.createDataFrame([], SCHEMA)), 1.0, SCOPE), net_polygons(with_shapes(spark.createDataFrame([], SCHEMA)), SCOPE), SCOPE).collect() == []


def test_stretches_against_dense_points():
    rnd = random.Random(6)
    for _ in range(25):
        polygons = []
        for k in range(6):
            x, y = rnd.uniform(-4, 8), rnd.uniform(-4, 8)
            polygons.append(Polygon(k, rnd.random() < 0.7, [(False, [x, x + 3, x + 4, x + 1], [y, y + 0.5, y + 3, y + 2])]))
        lines = np.array([[rnd.uniform(-5, 10) for _ in range(4)] for _ in range(5)])
        which, start, end = covered_stretches(lines, polygons, (0.0, 0.0, 5.0, 5.0))
        t = (np.arange(4000) + 0.5) / 4000
        for k, line in enumerate(lines):
            points = line[:2] + t[:, None] * (line[2:] - line[:2])
            within = ((points >= 0) & (points < 5)).all(axis=1)
            dense = (is_copper(points, polygons) & within).mean() * np.hypot(*(line[2:] - line[:2]))
            assert abs((end - start)[which == k].sum() - dense) < 0.05


def test_vias_reach_the_layers_of_their_drill(spark):
    layers = [("j", "F.Cu", 0, None, None), ("j", "In1.Cu", 1, None, None), ("j", "B.Cu", 2, None, None), ("j", "drill_plated", None, "f.cu", "in1.cu"), ("j", "all_plated", None, None, "x")]
    features = [
        ("j", "drill_plated", 0, "P", "P", "r300", "A", 1.0, 2.0, None, None, 0.0, None, "", {"1": "VIA_ROUNDD700000"}),
        ("j", "ALL_PLATED", 1, "P", "P", "rect400x200", "B", 5.0, 2.0, None, None, 0.0, None, "ROUND5000", None),
        ("j", "all_plated", 2, "P", "P", "star", "C", 7.0, 2.0, None, None, 0.0, None, None, None),
        ("j", "all_plated", 3, "P", "N", "r300", "D", 7.0, 2.0, None, None, 0.0, None, None, None),
    ]
    schema = SCHEMA + ", raw_attributes string, attributes map<string,string>"
    out = via_pads(with_shapes(spark.createDataFrame(features, schema)), spark.createDataFrame(layers, "job_id string, layer string, ordinal int, start_layer string, end_layer string"))
    got = sorted((r.net_name, r.layer, round(r.shape.r, 6), r.feature_index > 1 << 29) for r in out.collect())
    assert got == [("A", "F.CU", 0.35, True), ("A", "IN1.CU", 0.35, True)] + [(n, layer, r, True) for n, r in (("B", 2.5), ("C", 0.0005)) for layer in ("B.CU", "F.CU", "IN1.CU")]


def test_the_command_line_reports_vias_points_and_gaps(spark, tmp_path, capsys):
    (tmp_path / "boards").mkdir()
    eda = "LYR f.cu b.cu drill_plated\n#NET 0\nNET GND\nFID C 0 0\n#NET 1\nNET SIG\nFID C 0 1\nFID H 2 0\n#NET 2\nNET MID\nFID C 0 2\nFID C 1 0\n"
    board = FILES | {
        "board/steps/pcb/eda/data": eda,
        "board/steps/pcb/layers/f.cu/features": "$0 rect1000x1000\n#Layer features\nP 0 0 0 P 0 0\nP 6 0 0 P 0 0\nP 3 0 0 P 0 0\n",
        "board/steps/pcb/layers/b.cu/features": "$0 rect1000x1000\n#Layer features\nP 3 0 0 P 0 0\n",
        "board/steps/pcb/layers/drill_plated/features": "$0 r400\n#Layer features\nP 6 0 0 P 0 0\n",
    }
    with zipfile.ZipFile(tmp_path / "boards" / "one.zip", "w") as z:
        for name, text in board.items():
            z.writestr(name, text)
    assert cli.main([str(tmp_path / "boards"), "--output", str(tmp_path / "out"), "--effective-gap"], spark) == 0
    folder = capsys.readouterr().out.strip()
    read = lambda name: list(csv.DictReader(open(os.path.join(folder, name), encoding="utf-8-sig")))  # noqa: E731, SIM115
    full = {(r["layer"], r["net_a"], r["net_b"]): r for r in read("net_to_net_measurements_full.csv")}
    assert {k: round(float(r["clearance_mm"]), 3) for k, r in full.items()} == {("F.CU", "GND", "MID"): 2.0, ("F.CU", "MID", "SIG"): 2.0, ("F.CU", "GND", "SIG"): 5.0, ("B.CU", "MID", "SIG"): 2.3}
    at = full["F.CU", "GND", "MID"]
    assert (float(at["x_a_mm"]), float(at["x_b_mm"])) == (0.5, 2.5)
    gap = {(r["layer"], r["net_a"], r["net_b"]): r for r in read("net_to_net_effective_air_gap_matrix.csv")}
    assert round(float(gap["F.CU", "GND", "SIG"]["effective_air_gap_mm"]), 3) == 4.0 and gap["F.CU", "GND", "SIG"]["blocker_nets"] == "MID"
    assert {r["x_mm"] for r in read("net_to_net_per_net_minimum.csv")} != {""} and F is not None
