import io
import math
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkgap.geometry.arcs import arc_points
from sparkgap.geometry.shapes import distance, orientation_degrees, parsed_symbol, with_shapes
from sparkgap.operators import measurements as mea
from sparkgap.operators import spacing as spc
from sparkgap.sources import board_archive as arc

FEATURE = "job_id string, layer string, feature_id int, kind string, polarity string, symbol_name string, net_name string, x double, y double, x2 double, y2 double, rotation_deg double"


def pad(k, net, sym, x, y, rot=0.0, kind="P", x2=None, y2=None, pol="P"):
    return ("j", "L", k, kind, pol, sym, net, x, y, x2, y2, rot)


def outline(row, n=48):
    """Points of a feature's edge by brute force."""
    w, h, r = row
    return w, h, r, n


def test_symbols_and_orientation(spark):
    names = {"r300.0": ("round", 0.3, 0.3, None), "rect800.0x950.0xr200.0": ("rect", 0.8, 0.95, 0.2), " OVAL1700.0x2000.0": ("oval", 1.7, 2.0, None), "star": ("unknown", 0.001, 0.001, None), None: ("unknown", 0.001, 0.001, None)}
    out = spark.createDataFrame([(n,) for n in names], "n string").select("n", parsed_symbol(F.col("n")).alias("s")).collect()
    for r in out:
        assert r.s.kind == names[r.n][0] and r.s.width_mm == pytest.approx(names[r.n][1]) and r.s.height_mm == pytest.approx(names[r.n][2])
    tokens = spark.createDataFrame([("0",), ("1",), ("2",), ("3",), ("270.0",), ("5",), (None,), ("x",)], "t string")
    assert [r[0] for r in tokens.select(orientation_degrees(F.col("t"))).collect()] == [0, 90, 180, 270, 270, 90, 0, 0]


def test_distances_against_sampling(spark):
    rnd = random.Random(9)
    rows = []
    for k in range(120):
        sym = rnd.choice(["r400", "rect800x300", "rect900x500xr200", "oval1200x400", "oval300x900"])
        if k % 3:
            rows.append(pad(k, f"N{k}", sym, rnd.uniform(0, 6), rnd.uniform(0, 6), rnd.choice([0.0, 30.0, 45.0, 90.0, None])))
        else:
            x, y = rnd.uniform(0, 6), rnd.uniform(0, 6)
            rows.append(pad(k, f"N{k}", sym, x, y, None, "L", x + rnd.uniform(-2, 2), y + rnd.uniform(-2, 2)))
    shapes = with_shapes(spark.createDataFrame(rows, FEATURE)).select("feature_id", "shape").collect()
    got = {}
    df = spark.createDataFrame(shapes)
    pairs = df.alias("a").crossJoin(df.alias("b")).filter("a.feature_id < b.feature_id").select(F.col("a.feature_id").alias("i"), F.col("b.feature_id").alias("j"), distance(F.col("a.shape"), F.col("b.shape")).alias("d"))
    for r in pairs.collect():
        got[r.i, r.j] = r.d

    def edge(s, n=60):
        pts = []
        for k in range(n):
            for u, v in ((-1 + 2 * k / n, -1), (-1 + 2 * k / n, 1), (-1, -1 + 2 * k / n), (1, -1 + 2 * k / n), (1, 1)):
                px, py = u * s.hx, v * s.hy
                pts.append((s.cx + px * s.c - py * s.s, s.cy + px * s.s + py * s.c))
        return list(set(pts))

    def inside(p, s):
        dx, dy = p[0] - s.cx, p[1] - s.cy
        return abs(dx * s.c + dy * s.s) <= s.hx + 1e-12 and abs(dy * s.c - dx * s.s) <= s.hy + 1e-12

    edges = {r.feature_id: edge(r.shape) for r in shapes}
    by_id = {r.feature_id: r.shape for r in shapes}
    for (i, j), d in rnd.sample(sorted(got.items()), 250):
        a, b = by_id[i], by_id[j]
        near = min(math.dist(p, q) for p in edges[i] for q in edges[j])
        if any(inside(p, b) for p in edges[i]) or any(inside(q, a) for q in edges[j]):
            assert d == 0
            continue
        sampled = max(0.0, near - a.r - b.r)
        assert d <= sampled + 1e-9 and d >= sampled - 0.06


def test_known_gaps(spark):
    rows = [
        pad(1, "A", "rect700x1400", 0.0, 0.0, 270.0), pad(2, "B", "rect700x1400", 0.0, 1.27, 270.0), pad(3, "C", "r300", 5.0, 5.0), pad(4, "$NONE$", "r300", 5.4, 5.0), pad(5, "D", "r300", 5.4, 5.0, pol="N"),
        pad(6, "E", "r300", None, 5.0), pad(7, None, "r300", 5.0, 5.0), pad(8, "F", "r300", 5.5, 5.0, pol="p"),
    ]
    shapes = spc.copper(with_shapes(spark.createDataFrame(rows, FEATURE)))
    near = {(r.net_a, r.net_b): round(r.clearance_mm, 6) for r in spc.close_net_pairs(shapes, 1.0, ["job_id", "layer"]).collect()}
    assert near == {("A", "B"): 0.57, ("C", "F"): 0.2}
    every = {(r.net_a, r.net_b): r.clearance_mm for r in spc.all_net_pairs(shapes, ["job_id", "layer"]).collect()}
    assert len(every) == 6 and {k: round(v, 6) for k, v in every.items() if v < 1.0} == near
    at = spark.createDataFrame([("j", "L", 1, 5.2, 5.0), ("j", "L", 2, 50.0, 50.0)], "job_id string, layer string, point_id int, x double, y double")
    assert [(r.point_id, r.net) for r in spc.nearest_nets(shapes, at, 0.5, ["job_id", "layer"]).collect()] == [(1, "C")]
    assert spc.close_net_pairs(shapes.limit(0), 1.0, ["job_id", "layer"]).collect() == []


def test_minima_isolation_and_intervals(spark):
    schema = "layer string, net_a string, net_b string, clearance_mm double, effective_max_voltage_v double, ipc2221a_max_voltage_v double, x_a_mm double, y_a_mm double, x_b_mm double, y_b_mm double"
    nan = float("nan")
    rows = [("L", "A", "B", 0.5, 1.0, 2.0, 1.0, 1.0, 2.0, 2.0), ("K", "A", "C", 0.5, 3.0, 4.0, None, None, None, None), ("L", "B", "C", nan, None, None, None, None, None, None), ("L", "C", "D", None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = {r.net: (r.min_clearance_mm, r.layer, r.other_net, r.x_mm) for r in mea.per_net_minimum(df).collect()}
    assert got == {"A": (0.5, "K", "C", None), "B": (0.5, "L", "A", 2.0), "C": (0.5, "K", "A", None)}
    iso = mea.isolation_check(df, spark.createDataFrame([("A",), ("A",)], "net string"), clearance_mm=0.5, creepage_mm=0.2).collect()
    assert {(r.other_net, r.result) for r in iso} == {("B", "PASS"), ("C", "PASS")}
    spans = spark.createDataFrame([("k", 0.0, 2.0), ("k", 1.0, 3.0), ("k", 5.0, 6.0), ("k", 5.2, 5.4), ("k", 7.0, 7.0), ("k", None, 1.0)], "k string, start double, end double")
    assert mea.blocked_length(spans, ["k"]).first().covered == pytest.approx(4.0)
    assert mea.net_list_tokens("A B;iso_sig, A") == ["A", "B", "iso_sig"]


def test_arcs():
    points = arc_points((1, 0), (0, 1), (0, 0), clockwise=False)
    assert points[-1] == (0, 1) and max(x + y for x, y in points) > 1.3
    assert len(arc_points((1, 0), (1, 0), (0, 0), clockwise=False)) == 64
    assert min(x + y for x, y in arc_points((1, 0), (0, 1), (0, 0), clockwise=True)) < -1.3


FILES = {
    "board/matrix/matrix": "STEP {\n NAME=PCB\n}\nLAYER {\n NAME=F.CU\n TYPE=SIGNAL\n}\nLAYER {\n NAME=B.CU\n TYPE=POWER_GROUND\n}\nLAYER {\n NAME=DRILL_PLATED\n TYPE=DRILL\n CONTEXT=BOARD\n START_NAME=F.CU\n END_NAME=B.CU\n}\nLAYER {\n NAME=PASTE\n TYPE=SOLDER_PASTE\n}\n",
    "board/steps/pcb/eda/data": "LYR f.cu b.cu\n#NET 0\nNET GND ; 0=0,3=0.3,\nFID C 0 0\nFID C 0 9\n#NET 1\nNET SIG\nFID C 0 1\nFID H 0 2\nFID C 7 1\nFID C x y\n",
    "board/steps/pcb/layers/f.cu/features": "$0 r300.0\n$1 rect800x950\n@0 .string\n@3 .clearance\n&5 C21\n#Layer features\nP 1 2 0 P 0 3 ;0=5,3=0.3\nL 0 0 3 4 0 P 0 ;7=12,0,0\nS P 0\nOB 0 0 I\nOS 1 0\nOC 0 1 0 0 N\nOE\nSE\nA 1 2 3\nP x 2 0 P 0 0\nP 1 2 9 N 0 0\n",
    "board/steps/pcb/layers/b.cu/features": "#Layer features\n",
}


def test_archives_become_tables(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        for name, text in FILES.items():
            z.writestr(name, text)
    with tarfile.open(tmp_path / "two.tar.gz", "w:gz") as t:
        for name, text in FILES.items():
            info = tarfile.TarInfo(name.removeprefix("board/"))
            info.size = len(text.encode())
            t.addfile(info, io.BytesIO(text.encode()))
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    features = arc.read_boards(spark, str(tmp_path)).collect()
    one = {r.feature_index: r for r in features if r.job_id == "one"}
    assert len(one) == 6 and len([r for r in features if r.job_id == "two"]) == 6
    assert (one[0].net_name, one[0].rotation_deg, one[0].attributes) == ("GND", 270.0, {".string": "C21", ".clearance": "0.3"})
    assert one[1].net_name == "SIG" and one[1].attributes == {"@7": "12", ".string": "true", ".string#2": "true"} and (one[1].x2, one[1].y2) == (3.0, 4.0)
    assert one[2].net_name == "SIG" and one[2].rings[0].marker == "I" and (one[2].rings[0].pts[-1].x, one[2].rings[0].pts[-1].y) == (0.0, 1.0)
    assert [one[k].problem for k in (3, 4, 5)] == ["unsupported kind A", "malformed coordinates", "missing symbol"]
    assert [r.problem is not None for r in features if r.job_id == "bad"] == [True]
    layers = arc.read_boards(spark, str(tmp_path), "layers")
    assert [(r.layer, r.ordinal) for r in arc.signal_layers(layers).filter("job_id = 'two'").orderBy("ordinal").collect()] == [("F.CU", 0), ("B.CU", 1)]
    drills = layers.filter("type = 'DRILL'").select("job_id", F.col("layer").alias("drill"), "start_layer", "end_layer")
    assert spc.drill_span(drills, arc.signal_layers(layers), ["job_id"]).count() == 4


@pytest.mark.parametrize("name", ["../x", "/etc/x", "a/../../x", "C:\\x"])
def test_members_outside_are_refused(name):
    with pytest.raises(arc.ArchiveError):
        arc.safe_name(name)
