import os
import random

import pytest

from sparkgap.geometry.air_gap import effective_gaps
from sparkgap.geometry.compositing import composited_pairs, net_polygons
from sparkgap.geometry.near_gaps import near_gaps
from sparkgap.geometry.shapes import with_shapes
from sparkgap.plans import boards

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "job_id string, layer string, feature_index int, kind string, symbol_name string, polarity string, net_name string, x double, y double, x2 double, y2 double, rotation_deg double"
SCOPE = ["job_id", "layer"]


def _size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_tiles_give_what_stored_outlines_give(spark):
    """Pads, tracks and cuts over several tiles, one net within another, one pair with copper between."""
    rnd, rows = random.Random(5), []
    for k in range(120):
        x, y = rnd.uniform(-25, 25), rnd.uniform(-8, 8)
        kind, symbol = rnd.choice([("P", "r1500"), ("P", "rect900x1300"), ("L", "r250"), ("P", "oval700x1900")])
        end = (x + rnd.uniform(-6, 6), y + rnd.uniform(-6, 6)) if kind == "L" else (None, None)
        rows.append(("j", "L", k, kind, symbol, rnd.choice("PPPPN"), rnd.choice("ABCDEFGH"), x, y, *end, rnd.uniform(0, 90)))
    rows += [("k", "L", 0, "P", "r9000", "P", "OUT", 0.0, 0.0, None, None, 0.0), ("k", "L", 1, "P", "r300", "P", "IN", 1.0, 0.5, None, None, 0.0)]
    rows += [("m", "L", k, "P", "r400", "P", n, x, 19.9, None, None, 0.0) for k, (n, x) in enumerate((("A", 19.5), ("B", 20.4)))] + [("m", "L", 2, "P", "r100", "P", "C", 19.95, 19.9, None, None, 0.0)]
    shapes = with_shapes(spark.createDataFrame(rows, SCHEMA))
    key = lambda r: (r.job_id, r.net_a, r.net_b)
    got = {key(r): r for r in near_gaps(shapes, 1.0, SCOPE).collect()}
    expected = {key(r): r for r in effective_gaps(composited_pairs(shapes, 1.0, SCOPE), net_polygons(shapes, SCOPE), SCOPE).collect()}
    assert got.keys() == expected.keys() and got["k", "IN", "OUT"].direct_clearance_mm == 0 and got["m", "A", "B"].blocker_nets == "C"
    for k, e in expected.items():
        g = got[k]
        assert g.direct_clearance_mm == pytest.approx(e.direct_clearance_mm, abs=1e-9)
        if (g.x_a_mm, g.y_a_mm) == pytest.approx((e.x_a_mm, e.y_a_mm), abs=1e-6):  # of several equally near points any may come out
            assert (g.copper_on_path, g.blocker_nets) == (e.copper_on_path, e.blocker_nets) and g.effective_air_gap_mm == pytest.approx(e.effective_air_gap_mm, abs=1e-6)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_no_outlines_are_stored(spark):
    boards.composited_copper_pairs(spark, FOLDER).collect()  # sets the folder
    at = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = _size(at)
    boards.effective_air_gaps(spark, FOLDER).collect()
    assert _size(at) - before < 4 * os.path.getsize(f"{FOLDER}/features.parquet")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_only_repeated_features_move(spark):
    text = lambda df: sorted(map(str, df.collect()))
    assert text(boards._unmoved_board_shapes(spark, FOLDER)) == text(boards._board_shapes(spark, FOLDER))
