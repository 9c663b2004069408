"""Pads and tracks as rounded boxes, and exact distances between them, in column arithmetic.

A rounded box is a box (centre, half extents, rotation) widened by a radius: a
disc has no extents, an oval or track one, a rounded rectangle two. The distance
of two such shapes is that of their boxes less both radii, and at least 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import settle

UM = 0.001
SMALLEST_MM = 0.001  # of a symbol whose name says nothing
NUMBER = r"([0-9]*\.?[0-9]+)"


def parsed_symbol(raw_name: Column) -> Column:
    """Struct (kind, width_mm, height_mm, radius_mm) of a symbol name in micrometres: r, rect, rect with xr, oval; else unknown."""
    text = F.lower(F.trim(raw_name))
    number = lambda pattern, k: F.regexp_extract(text, pattern, k).try_cast("double") * UM
    box = rf"^(rect|oval){NUMBER}x{NUMBER}(?:xr{NUMBER})?$"
    disc = rf"^r{NUMBER}$"
    is_box, is_disc = text.rlike(box), text.rlike(disc)
    kind = F.when(is_disc, "round").when(is_box, F.regexp_extract(text, box, 1)).otherwise("unknown")
    width = F.when(is_disc, number(disc, 1)).when(is_box, number(box, 2)).otherwise(SMALLEST_MM)
    height = F.when(is_disc, number(disc, 1)).when(is_box, number(box, 3)).otherwise(SMALLEST_MM)
    return F.struct(kind.alias("kind"), width.alias("width_mm"), height.alias("height_mm"), F.when(is_box, number(box, 4)).alias("radius_mm"))


def orientation_degrees(token: Column) -> Column:
    """Degrees of a pad's orientation: codes 0 to 7 are quarter turns, other numbers degrees, anything else 0."""
    code = F.when(F.trim(token).rlike("^[0-7]$"), F.trim(token).try_cast("int"))
    return F.when(code.isNotNull(), (code % 4) * 90.0).otherwise(F.coalesce(F.trim(token).try_cast("double"), F.lit(0.0)))


def with_shapes(features: DataFrame) -> DataFrame:
    """Pads (P) and tracks (L) with a `shape`: cx, cy, hx, hy (extents of the box), c, s (its direction), r.

    Needs kind, symbol_name, x, y, x2, y2 and rotation_deg. Rows without usable
    coordinates and other kinds get a null shape. A track is as wide as the
    smaller side of its symbol and has round ends.
    """
    df = settle(features, __sym=parsed_symbol(F.col("symbol_name")))
    w, h = F.col("__sym.width_mm"), F.col("__sym.height_mm")
    r = F.least(F.coalesce(F.col("__sym.radius_mm"), F.lit(0.0)), w / 2, h / 2)
    kind = F.col("__sym.kind")
    rounding = F.when(kind == "rect", r).otherwise(F.least(w, h) / 2)
    turn = F.radians(F.coalesce("rotation_deg", F.lit(0.0)))
    pad = F.struct(
        F.col("x").alias("cx"), F.col("y").alias("cy"), (w / 2 - rounding).alias("hx"), (h / 2 - rounding).alias("hy"), F.cos(turn).alias("c"), F.sin(turn).alias("s"), rounding.alias("r")
    )
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    length = F.sqrt(dx * dx + dy * dy)
    track = F.struct(
        ((F.col("x") + F.col("x2")) / 2).alias("cx"), ((F.col("y") + F.col("y2")) / 2).alias("cy"), (length / 2).alias("hx"), F.lit(0.0).alias("hy"),
        F.when(length > 0, dx / length).otherwise(1.0).alias("c"), F.when(length > 0, dy / length).otherwise(0.0).alias("s"), (F.least(w, h) / 2).alias("r"),
    )
    upper = F.upper(F.trim("kind"))
    placed = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    ended = F.col("x2").isNotNull() & F.col("y2").isNotNull() & ~F.isnan("x2") & ~F.isnan("y2")
    return settle(df, shape=F.when((upper == "P") & placed, pad).when((upper == "L") & placed & ended, track)).drop("__sym")


def bounds(shape: Column) -> tuple[Column, Column, Column, Column]:
    """min x, min y, max x, max y of a shape."""
    ex = F.abs(shape["hx"] * shape["c"]) + F.abs(shape["hy"] * shape["s"]) + shape["r"]
    ey = F.abs(shape["hx"] * shape["s"]) + F.abs(shape["hy"] * shape["c"]) + shape["r"]
    return shape["cx"] - ex, shape["cy"] - ey, shape["cx"] + ex, shape["cy"] + ey


def _corners(a: Column) -> list[tuple[Column, Column]]:
    out = []
    for u in (-1, 1):
        for v in (-1, 1):
            px, py = a["hx"] * u, a["hy"] * v
            out.append((a["cx"] + px * a["c"] - py * a["s"], a["cy"] + px * a["s"] + py * a["c"]))
    return out


def _to_box(x: Column, y: Column, b: Column) -> Column:
    dx, dy = x - b["cx"], y - b["cy"]
    u, v = F.abs(dx * b["c"] + dy * b["s"]) - b["hx"], F.abs(dy * b["c"] - dx * b["s"]) - b["hy"]
    zero = F.lit(0.0)
    return F.sqrt(F.pow(F.greatest(u, zero), 2) + F.pow(F.greatest(v, zero), 2))


def boxes_meet(a: Column, b: Column) -> Column:
    """Whether two boxes touch: no axis of either separates them."""
    dx, dy = b["cx"] - a["cx"], b["cy"] - a["cy"]
    c = F.abs(a["c"] * b["c"] + a["s"] * b["s"])
    s = F.abs(a["c"] * b["s"] - a["s"] * b["c"])
    reach_a_u, reach_a_v = a["hx"] + b["hx"] * c + b["hy"] * s, a["hy"] + b["hx"] * s + b["hy"] * c
    reach_b_u, reach_b_v = b["hx"] + a["hx"] * c + a["hy"] * s, b["hy"] + a["hx"] * s + a["hy"] * c
    along = lambda o: (F.abs(dx * o["c"] + dy * o["s"]), F.abs(dy * o["c"] - dx * o["s"]))
    (au, av), (bu, bv) = along(a), along(b)
    return (au <= reach_a_u) & (av <= reach_a_v) & (bu <= reach_b_u) & (bv <= reach_b_v)


def distance(a: Column, b: Column) -> Column:
    """Distance in mm of two rounded boxes; 0 where they touch."""
    points = [_to_box(x, y, b) for x, y in _corners(a)] + [_to_box(x, y, a) for x, y in _corners(b)]
    apart = F.least(*points) - a["r"] - b["r"]
    return F.when(boxes_meet(a, b), 0.0).otherwise(F.greatest(F.lit(0.0), apart))


def _onto_box(x: Column, y: Column, b: Column) -> tuple[Column, Column]:
    """The point of a box that is nearest to a point."""
    dx, dy = x - b["cx"], y - b["cy"]
    u = F.greatest(-b["hx"], F.least(b["hx"], dx * b["c"] + dy * b["s"]))
    v = F.greatest(-b["hy"], F.least(b["hy"], dy * b["c"] - dx * b["s"]))
    return b["cx"] + u * b["c"] - v * b["s"], b["cy"] + u * b["s"] + v * b["c"]


POINTS = ("x_a_mm", "y_a_mm", "x_b_mm", "y_b_mm")


def with_nearest_points(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """`pairs` with x_a_mm, y_a_mm, x_b_mm, y_b_mm: where the rounded boxes in columns `a` and `b` are nearest to each other.

    Where the boxes within them touch, a corner of one that lies in the other, or
    else the point where their long axes cross, stands for both.
    """
    place = lambda *xy: F.struct(*[c.alias(n) for c, n in zip(xy, POINTS)])
    corners = lambda shape: F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in _corners(shape)])
    df = settle(pairs, __ca=corners(F.col(a)), __cb=corners(F.col(b)))

    def onto(corner: Column, shape: Column, own: bool) -> Column:
        px, py = _onto_box(corner["x"], corner["y"], shape)
        return F.struct(px.alias("px"), py.alias("py"), corner["x"].alias("x"), corner["y"].alias("y"), F.lit(own).alias("own"))

    near = [onto(F.col(c)[k], F.col(shape), own) for c, shape, own in (("__ca", b, True), ("__cb", a, False)) for k in range(4)]
    df = settle(df, __near=F.array(*near))
    ranked = F.transform("__near", lambda n: F.struct((F.pow(n["px"] - n["x"], 2) + F.pow(n["py"] - n["y"], 2)).alias("d"), n.alias("n")))
    df = settle(df, __best=F.array_min(ranked), __meet=boxes_meet(F.col(a), F.col(b)))
    n = F.col("__best.n")
    of_a = lambda own, other: F.when(n["own"], own).otherwise(other)
    df = settle(df, __gap=F.sqrt("__best.d"), __p=place(of_a(n["x"], n["px"]), of_a(n["y"], n["py"]), of_a(n["px"], n["x"]), of_a(n["py"], n["y"])))
    p, q, gap = F.col(a), F.col(b), F.col("__gap")
    turn = p["c"] * q["s"] - p["s"] * q["c"]
    along = ((q["cx"] - p["cx"]) * q["s"] - (q["cy"] - p["cy"]) * q["c"]) / F.nullif(turn, F.lit(0.0))
    some = F.nullif(gap, F.lit(0.0))
    # the rounding brings the points nearer to each other, at most until they meet
    part = F.when(gap > 0, F.least(F.lit(1.0), F.coalesce(gap / F.nullif(p["r"] + q["r"], F.lit(0.0)), F.lit(1.0)))).otherwise(0.0)
    zero = F.lit(0.0)
    df = settle(df, __along=along, __part=part, __ux=F.coalesce((F.col("__p.x_b_mm") - F.col("__p.x_a_mm")) / some, zero), __uy=F.coalesce((F.col("__p.y_b_mm") - F.col("__p.y_a_mm")) / some, zero))
    crosses = F.col("__meet") & (gap > 0) & F.col("__along").isNotNull()
    cx, cy = p["cx"] + F.col("__along") * p["c"], p["cy"] + F.col("__along") * p["s"]
    step = lambda r, axis: F.col(axis) * r * F.col("__part")
    moved = place(
        F.col("__p.x_a_mm") + step(p["r"], "__ux"), F.col("__p.y_a_mm") + step(p["r"], "__uy"), F.col("__p.x_b_mm") - step(q["r"], "__ux"), F.col("__p.y_b_mm") - step(q["r"], "__uy")
    )
    df = settle(df, __at=F.when(crosses, place(cx, cy, cx, cy)).otherwise(moved))
    return df.select(*pairs.columns, "__at.*")
