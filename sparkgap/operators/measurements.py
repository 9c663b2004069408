"""Relational operators on measured pairs: critical pairs, minima per net, isolation, recomputed voltages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.estimators import effective_voltage, ipc_voltage, layer_pollution, without_particle
from ..functions.layers import layer_key, layer_role, stack_place
from ..tables import join_few, settle


def critical_pairs(measurements: DataFrame, threshold_mm: float) -> DataFrame:
    """Pairs strictly below the threshold; null and NaN clearances are none."""
    return measurements.filter((F.col("clearance_mm") < threshold_mm) & ~F.isnan("clearance_mm"))


def per_net_minimum(measurements: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Each net's smallest clearance in either role, with the other net and its own coordinates first.

    Ties go to the first by layer, net_a, net_b. Null and NaN clearances don't
    count. One shuffle: partial minima are combined before it.
    """
    usable = measurements.filter(F.col("clearance_mm").isNotNull() & ~F.isnan("clearance_mm"))
    own = ("x_a_mm", "y_a_mm", "x_b_mm", "y_b_mm")
    turned = ("x_b_mm", "y_b_mm", "x_a_mm", "y_a_mm")
    both = F.explode(
        F.array(
            *[
                F.struct(F.col(net).alias("net"), F.col(other).alias("other_net"), *[F.col(c).alias(n) for c, n in zip(columns, ("x_mm", "y_mm", "x_other_mm", "y_other_mm"))])
                for net, other, columns in (("net_a", "net_b", own), ("net_b", "net_a", turned))
            ]
        )
    )
    rows = usable.select(*scope, "layer", "net_a", "net_b", "clearance_mm", "effective_max_voltage_v", "ipc2221a_max_voltage_v", both.alias("s"))
    rank = F.struct("clearance_mm", "layer", "net_a", "net_b", F.col("s.other_net"), F.col("s.x_mm"), F.col("s.y_mm"), F.col("s.x_other_mm"), F.col("s.y_other_mm"), "effective_max_voltage_v", "ipc2221a_max_voltage_v")
    least = rows.groupBy(*scope, F.col("s.net").alias("net")).agg(F.min(rank).alias("m"))
    return least.select(
        *scope, "net", F.col("m.clearance_mm").alias("min_clearance_mm"), F.col("m.layer").alias("layer"), F.col("m.other_net").alias("other_net"),
        F.col("m.x_mm").alias("x_mm"), F.col("m.y_mm").alias("y_mm"), F.col("m.x_other_mm").alias("x_other_mm"), F.col("m.y_other_mm").alias("y_other_mm"),
        F.col("m.effective_max_voltage_v").alias("effective_max_voltage_v"), F.col("m.ipc2221a_max_voltage_v").alias("ipc2221a_max_voltage_v"),
    )


def layer_roles(layers: DataFrame, scope: str, layer: str, ordinal: str | Column) -> DataFrame:
    """Adds layer_role to a table of layers, guessed from the name and the place within `scope`."""
    order = Window.partitionBy(scope).orderBy(ordinal)
    placed = layers.withColumn("__i", F.row_number().over(order) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(scope)))
    return placed.withColumn("layer_role", layer_role(F.col(layer), F.col("__i"), F.col("__n"))).drop("__i", "__n")


def measured_layer_roles(measurements: DataFrame) -> DataFrame:
    """(job_id, layer, layer_role) of every measured layer, ordered by `stack_place` as no stack-up is at hand."""
    layers = measurements.select("job_id", layer_key(F.col("layer")).alias("layer")).distinct()
    return layer_roles(layers, "job_id", "layer", stack_place(F.col("layer")))


def recomputed_voltages(measurements: DataFrame, *, roles: DataFrame | str, cti: float = 175.0, pollution: int = 2, altitude_m: float = 5500.0, particle_mm: float = 0.0, coated: bool = False) -> DataFrame:
    """`measurements` with both voltages computed anew under other settings; distances are reused.

    `roles` holds job_id, layer (as layer_key spells it) and layer_role, each
    layer once; layers not in it count as external. A role's name instead of a
    table rates every layer by that role, as the user may override it.
    """
    if isinstance(roles, str):
        placed = settle(measurements, layer_role=F.lit(roles))
    else:
        known = roles.select("job_id", F.col("layer").alias("__layer"), F.col("layer_role").alias("__role"))
        spread = [c for c in ("measurement_id", "net_a", "net_b") if c in measurements.columns]
        joined = join_few(measurements.withColumn("__key", layer_key(F.col("layer"))), known, {"job_id": "job_id", "__key": "__layer"}, spread=spread)
        placed = settle(joined, layer_role=F.coalesce("__role", F.lit("external"))).drop("__key", "__role")
    role = F.col("layer_role")
    reduced = F.when(F.col("clearance_mm") >= 0, without_particle(F.col("clearance_mm"), role, particle_mm))
    ready = settle(placed, __degree=layer_pollution(role, F.lit(coated), pollution), __reduced=reduced)
    volts = effective_voltage(F.col("__reduced"), cti, F.col("__degree"), altitude_m)
    done = settle(ready.drop("effective_max_voltage_v", "ipc2221a_max_voltage_v"), effective_max_voltage_v=volts)
    return settle(done, ipc2221a_max_voltage_v=ipc_voltage(F.col("clearance_mm"), role, altitude_m)).drop("__degree", "__reduced")


def isolation_check(measurements: DataFrame, isolated: DataFrame, *, clearance_mm: float, creepage_mm: float, factor: float = 1.0, scope: Sequence[str] = ()) -> DataFrame:
    """Pairs of an isolated net with one that isn't, against the required spacing.

    `isolated` holds `net` (and the scope). The larger of clearance and creepage,
    times the factor, is required; PASS if the margin is not negative. A net that
    most pairs share makes no hot task: the isolated nets are broadcast if few,
    else joined with salts.
    """
    required = max(0.0, clearance_mm, creepage_mm) * max(0.0, factor)
    marked = isolated.select(*scope, "net").distinct()
    rows = measurements.filter(F.col("clearance_mm").isNotNull() & ~F.isnan("clearance_mm"))
    for side, net, other in (("__a", "net_a", "net_b"), ("__b", "net_b", "net_a")):
        rows = join_few(rows, marked.withColumn(side, F.col("net")), {**{c: c for c in scope}, net: "net"}, spread=[other, "layer"])
    crossing = rows.filter(F.col("__a").isNull() != F.col("__b").isNull())
    margin = F.col("clearance_mm") - required
    return crossing.select(
        *scope,
        "layer",
        F.coalesce("__a", "__b").alias("isolated_net"),
        F.when(F.col("__a").isNull(), F.col("net_a")).otherwise(F.col("net_b")).alias("other_net"),
        F.col("clearance_mm").alias("measured_mm"),
        F.lit(float(required)).alias("required_mm"),
        margin.alias("margin_mm"),
        F.when(margin >= 0, "PASS").otherwise("FAIL").alias("result"),
    )


def net_list_tokens(text: str) -> list[str]:
    """Net names typed into one field, separated by commas, semicolons or blanks; each once, in order."""
    return list(dict.fromkeys(t for t in text.replace(",", " ").replace(";", " ").split() if t))


def matches_all_tokens(name: Column, text: str) -> Column:
    """Whether a name holds every token of a search text, in any case."""
    out = F.lit(True)
    for token in net_list_tokens(text.lower()):
        out = out & F.contains(F.lower(name), F.lit(token))
    return out


def all_nets(*tables: tuple[DataFrame, str]) -> DataFrame:
    """The distinct real net names of several (table, column): not blank, not the mark for no net."""
    union = None
    for df, column in tables:
        one = df.select(F.col(column).alias("net_name"))
        union = one if union is None else union.unionByName(one)
    return union.filter((F.trim("net_name") != "") & (F.upper(F.trim("net_name")) != "$NONE$")).distinct()


def blocked_length(spans: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Total length covered by possibly overlapping intervals of each key, as `covered`.

    Intervals with a null bound or without length don't count. A running maximum
    of the ends marks where islands begin; the islands' lengths add up.
    """
    real = spans.filter(F.col(end) > F.col(start))
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    own = F.greatest(F.lit(0.0), F.col(end) - F.greatest(F.col(start), F.coalesce(before, F.col(start))))
    return real.withColumn("__own", own).groupBy(*keys).agg(F.sum("__own").alias("covered"))
