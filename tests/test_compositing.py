import random

import numpy as np
from pyspark.sql import functions as F

from sparkgap.geometry.compositing import Polygon, composited_pairs, is_copper, rounded_box_ring, surviving_edges
from sparkgap.geometry.shapes import with_shapes
from sparkgap.operators.spacing import close_net_pairs, copper

RING = "array<struct<marker:string,pts:array<struct<x:double,y:double>>>>"
SCHEMA = f"job_id string, layer string, feature_index int, kind string, polarity string, symbol_name string, net_name string, x double, y double, x2 double, y2 double, rotation_deg double, rings {RING}"


def box(k, net, x0, y0, x1, y1, polarity="P", hole=None):
    rings = [{"marker": "I", "pts": [{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]}]
    if hole:
        a, b, c, d = hole
        rings.append({"marker": "H", "pts": [{"x": float(x), "y": float(y)} for x, y in ((a, b), (c, b), (c, d), (a, d))]})
    return ("j", "L", k, "S", polarity, None, net, None, None, None, None, None, rings)


def found(spark, rows, threshold=2.0):
    df = with_shapes(spark.createDataFrame(rows, SCHEMA))
    return {(r.net_a, r.net_b): round(r.clearance_mm, 6) for r in composited_pairs(df, threshold, ["job_id", "layer"]).collect()}


def test_cutouts_count_in_order(spark):
    pour, cut, pad = box(0, "GND", 0, 0, 10, 10), box(1, None, 3.9, 3.9, 5.1, 5.1, "N"), box(2, "SIG", 4, 4, 5, 5)
    assert found(spark, [pour, cut, pad]) == {("GND", "SIG"): 0.1}
    assert found(spark, [pour, pad]) == {("GND", "SIG"): 0.0}
    assert found(spark, [box(0, None, 3.9, 3.9, 5.1, 5.1, "x"), box(1, "GND", 0, 0, 10, 10), pad]) == {("GND", "SIG"): 0.0}
    assert found(spark, [box(0, "GND", 0, 0, 10, 10, hole=(3.8, 3.8, 5.2, 5.2)), pad]) == {("GND", "SIG"): 0.2}
    assert found(spark, [box(0, "GND", 0, 0, 1, 1), box(1, None, 0, 0, 1, 1, "N"), box(2, "SIG", 1.5, 0, 2, 1), box(3, "$NONE$", 2.1, 0, 3, 1)]) == {}
    assert found(spark, []) == {}


def test_point_rule_against_painting():
    rnd = random.Random(11)
    for _ in range(20):
        polygons, painted = [], np.zeros((60, 60), bool)
        xs, ys = np.meshgrid(np.arange(60) + 0.5, np.arange(60) + 0.5, indexing="ij")
        for k in range(7):
            x0, y0 = rnd.randint(0, 40), rnd.randint(0, 40)
            x1, y1, positive = x0 + rnd.randint(3, 20), y0 + rnd.randint(3, 20), rnd.random() < 0.6
            polygons.append(Polygon(k, positive, [(False, [x0, x1, x1, x0], [y0, y0, y1, y1])]))
            painted[(xs > x0) & (xs < x1) & (ys > y0) & (ys < y1)] = positive
        points = np.column_stack([xs.ravel(), ys.ravel()])
        assert (is_copper(points, polygons) == painted.ravel()).all()
        edges = surviving_edges(polygons)
        unit = int((painted[1:] != painted[:-1]).sum() + (painted[:, 1:] != painted[:, :-1]).sum() + painted[0].sum() + painted[-1].sum() + painted[:, 0].sum() + painted[:, -1].sum())
        assert abs(np.hypot(edges[:, 2] - edges[:, 0], edges[:, 3] - edges[:, 1]).sum() - unit) < 1e-6


def test_without_cuts_it_agrees_with_the_exact_distances(spark):
    rnd = random.Random(12)
    rows = []
    for k in range(60):
        sym = rnd.choice(["r400", "rect800x300", "rect900x500xr200", "oval1200x400"])
        rows.append(("j", "L", k, "P", "P", sym, f"N{k % 25}", rnd.uniform(0, 15), rnd.uniform(0, 15), None, None, rnd.choice([0.0, 30.0, 90.0]), None))
    df = with_shapes(spark.createDataFrame(rows, SCHEMA))
    exact = {(r.net_a, r.net_b): r.clearance_mm for r in close_net_pairs(copper(df), 1.0, ["job_id", "layer"]).collect()}
    drawn = {(r.net_a, r.net_b): r.clearance_mm for r in composited_pairs(df, 1.1, ["job_id", "layer"]).collect()}
    assert exact and all(pair in drawn and d - 1e-9 <= drawn[pair] <= d + 0.003 for pair, d in exact.items())


def test_rounded_box_ring():
    xs, ys = rounded_box_ring(0, 0, 0.4, 0.4, 1, 0, 0.4)
    square = Polygon(0, True, [(False, xs, ys)])
    assert square.covers(np.array([[0.79, 0.0], [0.8, 0.8], [0.6, 0.6]])).tolist() == [True, False, True]
    assert F is not None


def test_enclosed_islands_are_found_beside_others(spark):
    """A short within the host's copper counts, though another pad of the guest lies free in the same cell."""
    host, inner, outer = box(0, "HOST", 0, 0, 0.8, 0.8), box(1, "GUEST", 0.3, 0.3, 0.5, 0.5), box(2, "GUEST", 0.95, 0, 1.1, 0.8)
    assert found(spark, [host, outer]) == {("GUEST", "HOST"): 0.15}
    assert found(spark, [host, inner, outer]) == {("GUEST", "HOST"): 0.0}


def test_cells_don_t_change_the_edges():
    rnd = random.Random(4)
    polygons = []
    for k in range(25):
        x0, y0 = rnd.uniform(-12, 12), rnd.uniform(-12, 12)
        if k % 3:
            xs, ys = rounded_box_ring(x0, y0, rnd.uniform(0, 4), rnd.uniform(0, 2), np.cos(k), np.sin(k), rnd.uniform(0.1, 1))
        else:
            xs, ys = [x0, x0 + 5, x0 + 5, x0], [y0, y0, y0 + 5, y0 + 5]
        polygons.append(Polygon(k, rnd.random() < 0.7, [(False, xs, ys)]))
    length = lambda e: np.hypot(e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]).sum()
    whole = length(surviving_edges(polygons))
    for size in (2.5, 5.0, 40.0):
        cells = [surviving_edges(polygons, (x, y, x + size, y + size)) for x in np.arange(-40, 40, size) for y in np.arange(-40, 40, size)]
        assert abs(sum(map(length, cells)) - whole) < 1e-6


def test_nearest_points_are_as_far_apart_as_the_nets(spark):
    rnd = random.Random(13)
    rows = [("j", "L", k, "P", "P", rnd.choice(["r400", "rect800x300", "oval1200x400"]), f"N{k % 12}", rnd.uniform(0, 9), rnd.uniform(0, 9), None, None, rnd.choice([0.0, 30.0]), None) for k in range(30)]
    rows += [box(30, "BIG", 20, 0, 26, 6), box(31, "IN", 21, 1, 22, 2), box(32, "LEFT", 18.5, 1, 19.5, 2)]
    df = with_shapes(spark.createDataFrame(rows, SCHEMA))
    some = composited_pairs(df, 1.5, ["job_id", "layer"]).collect()
    every = {(r.net_a, r.net_b): r for r in composited_pairs(df, None, ["job_id", "layer"]).collect()}
    assert len(every) == 15 * 14 // 2 and some
    for r in [*some, *every.values()]:
        assert abs(np.hypot(r.x_a_mm - r.x_b_mm, r.y_a_mm - r.y_b_mm) - r.clearance_mm) < 1e-6
    assert all(abs(every[r.net_a, r.net_b].clearance_mm - r.clearance_mm) < 1e-9 for r in some)
    assert every["BIG", "IN"].clearance_mm == 0 and (every["BIG", "LEFT"].x_a_mm, every["BIG", "LEFT"].x_b_mm) == (20.0, 19.5)
    shapes = close_net_pairs(copper(df), 1.5, ["job_id", "layer"], points=True).collect()
    assert shapes and all(abs(np.hypot(r.x_a_mm - r.x_b_mm, r.y_a_mm - r.y_b_mm) - r.clearance_mm) < 1e-6 for r in shapes)
