import csv
import os
import random
import zipfile

import numpy as np
from test_compositing import SCHEMA, box
from test_spacing_and_archive import FILES

from sparkgap import cli
from sparkgap.geometry import compositing
from sparkgap.geometry.compositing import all_edge_pairs, composited_pairs, edge_gap, net_edges, net_polygons
from sparkgap.geometry.shapes import with_shapes
from sparkgap.operators.spacing import all_net_pairs
from sparkgap.settings import Settings, write_profile


def test_gap_of_edges_against_points_on_them():
    rng = np.random.default_rng(5)
    for n, m, off in ((1, 1, 3.0), (90, 130, 2.0), (300, 200, 0.5), (200, 200, 40.0)):
        a = rng.uniform(0, 1, (n, 2)) @ np.array([[1, 0, 1, 0], [0, 1, 0, 1]]) + np.hstack([np.zeros((n, 2)), rng.uniform(-0.02, 0.02, (n, 2))])
        b = rng.uniform(0, 1, (m, 2)) @ np.array([[1, 0, 1, 0], [0, 1, 0, 1]]) + np.hstack([np.zeros((m, 2)), rng.uniform(-0.02, 0.02, (m, 2))]) + [off, 0, off, 0]
        t = np.linspace(0, 1, 41)[:, None, None]
        on = lambda e: (e[None, :, :2] * (1 - t) + e[None, :, 2:] * t).reshape(-1, 2)
        p, q = on(a), on(b)
        near = min(np.hypot(*(q - x).T).min() for x in p)
        assert near - 0.002 <= edge_gap(a, b) <= near + 1e-12
    assert edge_gap(np.array([[0, 0, 2, 2.0]]), np.array([[0, 2, 2, 0.0]])) == 0.0


def test_every_pair_is_measured_without_a_radius(spark, monkeypatch):
    monkeypatch.setattr(compositing, "BLOCK_NETS", 4)
    rng = random.Random(3)
    rows = [box(k, f"N{k % 15:02d}", x, y, x + 1, y + 2) for k in range(40) for x, y in [(rng.uniform(0, 120), rng.uniform(0, 120))]]
    rows += [box(40, "POUR", 200, 0, 210, 10), box(41, "IN", 204, 4, 205, 5), box(42, None, 0, 200, 1, 201)]
    df = with_shapes(spark.createDataFrame(rows, SCHEMA))
    scope = ["job_id", "layer"]
    pairs = lambda d: {(r.net_a, r.net_b): round(r.clearance_mm, 6) for r in d.collect()}
    edges = net_edges(net_polygons(df, scope), scope)
    got, brute = pairs(all_edge_pairs(edges, scope)), pairs(all_net_pairs(edges, scope))
    assert got == brute and len(got) == 17 * 16 // 2 and max(got.values()) > 100
    assert all_edge_pairs(edges, scope).count() == len(got)
    whole = pairs(composited_pairs(df, None, scope, include_no_net=True))
    assert len(whole) == 18 * 17 // 2 and whole["IN", "POUR"] == 0.0 and {k: v for k, v in whole.items() if "$NONE$" not in k and k != ("IN", "POUR")} == {k: v for k, v in got.items() if k != ("IN", "POUR")}


def test_command_line_measures_far_pairs_and_copper_without_a_net(spark, tmp_path, capsys):
    (tmp_path / "boards").mkdir()
    eda = "LYR f.cu b.cu\n#NET 0\nNET GND\nFID C 0 0\n#NET 1\nNET SIG\nFID C 0 1\n"
    pads = "$0 r300.0\n#Layer features\nP 1 2 0 P 0 0\nP 31 2 0 P 0 0\nP 61 2 0 P 0 0\n"
    with zipfile.ZipFile(tmp_path / "boards" / "one.zip", "w") as z:
        for name, text in (FILES | {"board/steps/pcb/eda/data": eda, "board/steps/pcb/layers/f.cu/features": pads}).items():
            z.writestr(name, text)

    def run(*options):
        assert cli.main([str(tmp_path / "boards"), "--output", str(tmp_path / "out"), *options], spark) == 0
        with open(os.path.join(capsys.readouterr().out.strip(), "net_to_net_measurements_full.csv"), encoding="utf-8-sig") as f:
            return {(r["net_a"], r["net_b"]): round(float(r["clearance_mm"]), 3) for r in csv.DictReader(f)}

    write_profile(Settings(include_none_net=True), str(tmp_path / "p.json"))
    assert run("--within-mm", "5") == {}
    assert run("--profile", str(tmp_path / "p.json")) == {("GND", "SIG"): 29.7, ("$NONE$", "GND"): 59.7, ("$NONE$", "SIG"): 29.7}
