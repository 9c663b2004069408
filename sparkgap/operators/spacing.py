"""Net-to-net spacing on a layer: all pairs, or those below a threshold by a grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..geometry.shapes import bounds, distance, with_nearest_points
from ..tables import settle
from ..vocabulary import NO_NET

CELL_MM = 5.0


def copper(features: DataFrame, *, include_no_net: bool = False) -> DataFrame:
    """Features that are copper: polarity P in any case, with a shape, on a net.

    Any other polarity cuts; nets that are null count as none.
    """
    on_net = F.coalesce("net_name", F.lit(NO_NET))
    rows = features.filter((F.upper(F.trim("polarity")) == "P") & F.col("shape").isNotNull()).withColumn("net_name", on_net)
    return rows if include_no_net else rows.filter(F.col("net_name") != NO_NET)


def close_net_pairs(shapes: DataFrame, threshold_mm: float, scope: Sequence[str], *, cell_mm: float = CELL_MM, points: bool = False) -> DataFrame:
    """(scope, net_a, net_b, clearance_mm) of all net pairs nearer than the threshold; net_a < net_b.

    With `points` also x_a_mm, y_a_mm, x_b_mm, y_b_mm, where the nets are nearest.

    Every shape is entered in the grid cells that its bounds, widened by half the
    threshold, touch; only shapes of one cell meet, and a pair that shares several
    cells is kept in the one that holds the lower left corner of the overlap of
    their bounds. Exact: the bounds' gap never exceeds the distance. The join is
    on (scope, cell), so a board or layer with most of the rows spreads over its
    cells. Minima are combined before the only other shuffle.
    """
    half = threshold_mm / 2
    x0, y0, x1, y1 = bounds(F.col("shape"))
    boxed = settle(shapes.select(*scope, F.col("net_name").alias("net"), "shape"), x0=x0 - half, y0=y0 - half, x1=x1 + half, y1=y1 + half)
    cell = lambda v: F.floor(F.col(v) / cell_mm).cast("int")
    entered = boxed.withColumn("gx", F.explode(F.sequence(cell("x0"), cell("x1")))).withColumn("gy", F.explode(F.sequence(cell("y0"), cell("y1"))))
    a = entered.select(*scope, "gx", "gy", *[F.col(c).alias(f"a_{c}") for c in ("net", "shape", "x0", "y0", "x1", "y1")])
    b = entered.select(*scope, "gx", "gy", *[F.col(c).alias(f"b_{c}") for c in ("net", "shape", "x0", "y0", "x1", "y1")])
    met = a.join(b, [*scope, "gx", "gy"]).filter("a_net < b_net and a_x0 <= b_x1 and b_x0 <= a_x1 and a_y0 <= b_y1 and b_y0 <= a_y1")
    corner = (F.floor(F.greatest("a_x0", "b_x0") / cell_mm) == F.col("gx")) & (F.floor(F.greatest("a_y0", "b_y0") / cell_mm) == F.col("gy"))
    apart = settle(met.filter(corner), clearance_mm=distance(F.col("a_shape"), F.col("b_shape"))).filter(F.col("clearance_mm") < threshold_mm)
    pairs = apart.groupBy(*scope, F.col("a_net").alias("net_a"), F.col("b_net").alias("net_b"))
    if not points:
        return pairs.agg(F.min("clearance_mm").alias("clearance_mm"))
    least = pairs.agg(F.min(F.struct("clearance_mm", "a_shape", "b_shape")).alias("m")).select(*scope, "net_a", "net_b", "m.*")
    return with_nearest_points(least, "a_shape", "b_shape").drop("a_shape", "b_shape")


def all_net_pairs(shapes: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(scope, net_a, net_b, clearance_mm) of every pair of nets that share a layer.

    The result holds every pair by definition; use `close_net_pairs` where a
    threshold will do. Joined on the scope, partial minima before the shuffle.
    """
    one = shapes.select(*scope, F.col("net_name").alias("net"), "shape")
    a, b = (one.select(*scope, F.col("net").alias(f"net_{n}"), F.col("shape").alias(f"shape_{n}")) for n in ("a", "b"))
    met = a.join(b, list(scope)).filter("net_a < net_b")
    return settle(met, clearance_mm=distance(F.col("shape_a"), F.col("shape_b"))).groupBy(*scope, "net_a", "net_b").agg(F.min("clearance_mm").alias("clearance_mm"))


def drill_span(drills: DataFrame, layers: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Each drill with every layer from its start to its end layer, in either order.

    `drills`: scope, drill, start_layer, end_layer; `layers`: scope, layer,
    ordinal. Drills whose start or end is no layer of the scope reach all layers.
    """
    at = lambda n: layers.select(*scope, F.col("layer").alias(f"{n}_layer"), F.col("ordinal").alias(f"__{n}"))
    placed = drills.join(at("start"), [*scope, "start_layer"], "left").join(at("end"), [*scope, "end_layer"], "left")
    low, high = F.least("__start", "__end"), F.greatest("__start", "__end")
    known = F.col("__start").isNotNull() & F.col("__end").isNotNull()
    return placed.join(layers.select(*scope, "layer", "ordinal"), list(scope)).filter(~known | F.col("ordinal").between(low, high)).select(*scope, "drill", "layer", "ordinal")


def nearest_nets(shapes: DataFrame, points: DataFrame, tolerance_mm: float, scope: Sequence[str], *, cell_mm: float = CELL_MM) -> DataFrame:
    """For each point (point_id, x, y and the scope) the net nearest within the tolerance, if any.

    Order: distance rounded to 9 places, area of the bounds, net name. Points meet
    shapes by grid cell.
    """
    x0, y0, x1, y1 = bounds(F.col("shape"))
    boxed = settle(shapes.select(*scope, F.col("net_name").alias("net"), "shape"), x0=x0 - tolerance_mm, y0=y0 - tolerance_mm, x1=x1 + tolerance_mm, y1=y1 + tolerance_mm)
    cell = lambda v: F.floor(F.col(v) / cell_mm).cast("int")
    entered = boxed.withColumn("gx", F.explode(F.sequence(cell("x0"), cell("x1")))).withColumn("gy", F.explode(F.sequence(cell("y0"), cell("y1"))))
    dot = F.struct(F.col("px").alias("cx"), F.col("py").alias("cy"), F.lit(0.0).alias("hx"), F.lit(0.0).alias("hy"), F.lit(1.0).alias("c"), F.lit(0.0).alias("s"), F.lit(0.0).alias("r"))
    asked = points.select(*scope, "point_id", F.col("x").alias("px"), F.col("y").alias("py")).withColumn("gx", cell("px")).withColumn("gy", cell("py"))
    met = asked.join(entered, [*scope, "gx", "gy"]).withColumn("dot", dot)
    near = settle(met, d=F.round(distance(F.col("dot"), F.col("shape")), 9)).filter(F.col("d") <= tolerance_mm)
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    order = Window.partitionBy(*scope, "point_id").orderBy("d", area, "net")
    return near.withColumn("__n", F.row_number().over(order)).filter("__n = 1").select(*scope, "point_id", "net", F.col("d").alias("distance_mm"))


def board_bounds(shapes: DataFrame, scope: Sequence[str]) -> DataFrame:
    """The bounding box of all shapes of each scope."""
    x0, y0, x1, y1 = bounds(F.col("shape"))
    return shapes.filter("shape is not null").groupBy(*scope).agg(F.min(x0).alias("min_x"), F.min(y0).alias("min_y"), F.max(x1).alias("max_x"), F.max(y1).alias("max_y"))
