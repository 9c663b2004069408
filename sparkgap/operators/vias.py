"""Copper of plated vias on the layers that they join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.layers import layer_key
from ..geometry.shapes import bounds
from .spacing import drill_span
from .views import via_pad_diameter

AFTER_ALL = 1 << 30  # vias are drawn after every feature of their layer, so that no cut reaches them


def via_pads(drilled: DataFrame, layers: DataFrame, scope: Sequence[str] = ("job_id",)) -> DataFrame:
    """The features of drill layers as discs on every copper layer that their drill joins.

    `drilled` are features with a shape (and attributes, if it has that column)
    whose layer is a drill of `layers`; `layers` is the table of an archive's
    layers. A disc has its feature's centre and the diameter that the attributes,
    then the raw attributes, then the symbol state; else that of the feature's
    bounds. Features with another polarity than P or without a shape give none. The
    result has the columns of `drilled`.
    """
    s = list(scope)
    copper = layers.filter(F.col("ordinal").isNotNull()).select(*s, layer_key(F.col("layer")).alias("layer"), "ordinal")
    drills = layers.filter(F.col("ordinal").isNull()).select(*s, layer_key(F.col("layer")).alias("drill"), layer_key(F.col("start_layer")).alias("start_layer"), layer_key(F.col("end_layer")).alias("end_layer"))
    span = drill_span(drills.distinct(), copper, s).select(*s, F.col("drill").alias("__drill"), F.col("layer").alias("__layer"))
    told = F.transform(F.map_values("attributes"), lambda v: via_pad_diameter(v)) if "attributes" in drilled.columns else F.array().cast("array<double>")
    stated = F.coalesce(F.get(F.array_compact(told), F.lit(0)), via_pad_diameter(F.col("raw_attributes"), F.col("symbol_name")))
    x0, y0, x1, y1 = bounds(F.col("shape"))
    diameter = F.coalesce(F.when(stated > 0, stated), F.greatest(x1 - x0, y1 - y0))
    disc = F.struct(
        F.col("shape.cx").alias("cx"), F.col("shape.cy").alias("cy"), F.lit(0.0).alias("hx"), F.lit(0.0).alias("hy"), F.lit(1.0).alias("c"), F.lit(0.0).alias("s"), (diameter / 2).alias("r")
    )
    usable = drilled.filter(F.col("shape").isNotNull() & (F.upper(F.trim("polarity")) == "P")).withColumn("__key", layer_key(F.col("layer")))
    met = usable.join(span.withColumnsRenamed({c: f"__{c}" for c in s}), [*[F.col(c) == F.col(f"__{c}") for c in s], F.col("__key") == F.col("__drill")])
    put = {"layer": F.col("__layer"), "shape": disc, "kind": F.lit("P"), "feature_index": F.lit(AFTER_ALL).cast("int") + F.col("feature_index")}
    return met.select(*[put[c].alias(c) if c in put else F.col(c) for c in drilled.columns])
