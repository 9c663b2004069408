"""The voltage a pair of nets requires, and whether its spacing supports it."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.zones import ZONE_COUNT, zone_label, zone_number
from ..tables import join_few
from ..vocabulary import GROUND_NAMES

DEFAULT_ZONE_V = 1000.0
# Warnings that callers compare.
INCOMPLETE = "Zone assignment incomplete; result uses local net voltage only."
UNKNOWN_VOLTAGE = "Local net voltage unknown; review assignments."
LABELS = tuple(f"Zone {k}" for k in range(1, ZONE_COUNT + 1))


def finite(value: Column) -> Column:
    """Null where a number is NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def ground_like(net: Column) -> Column:
    """Names that stand for 0 V where a net has no assigned voltage."""
    return F.coalesce(F.regexp_replace(F.upper(F.trim(net)), "-", "_").isin(*GROUND_NAMES), F.lit(False))


# ---------------------------------------------------------------- zones


def _positive(value: object, default: float) -> float:
    try:
        number = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default
    return number if math.isfinite(number) and number > 0 else default


def _zone(text: object) -> int | None:
    compact = str(text or "").lower().translate(str.maketrans("", "", " _-"))
    for prefix in ("galvaniczone", "zone", "z", ""):
        rest = compact.removeprefix(prefix)
        if compact.startswith(prefix) and rest.isdigit() and rest == str(int(rest)) and 1 <= int(rest) <= ZONE_COUNT:
            return int(rest)
    return None


def zone_voltages(stored: Mapping[object, object] | Sequence[Sequence[object]] | None, default: object = DEFAULT_ZONE_V) -> dict[tuple[int, int], float]:
    """Volts between any two zones, from a stored matrix in any of its forms.

    A map of maps (the entry read last counts for both directions), a flat map with
    keys such as `Zone 1->Zone 2`, or a list of lists (above the diagonal counts).
    Other entries and values that are no positive number fall back to `default`.
    """
    base = _positive(default, DEFAULT_ZONE_V)
    out = {(a, b): 0.0 if a == b else base for a in range(1, ZONE_COUNT + 1) for b in range(1, ZONE_COUNT + 1)}

    def put(a: int | None, b: int | None, volts: object) -> None:
        if a and b and a != b:
            out[a, b] = out[b, a] = _positive(volts, base)

    if isinstance(stored, Mapping):
        for key, value in stored.items():
            if isinstance(value, Mapping):
                for other, volts in value.items():
                    put(_zone(key), _zone(other), volts)
            else:
                for mark in ("->", "↔", "|", ",", ";"):
                    if mark in str(key):
                        a, b = str(key).split(mark, 1)
                        put(_zone(a), _zone(b), value)
                        break
    elif stored is not None:
        for i, row in enumerate(stored):
            for j, volts in enumerate(row):
                if i < j < ZONE_COUNT:
                    put(i + 1, j + 1, volts)
    return out


def zone_matrix(spark: SparkSession, voltages: Mapping[tuple[int, int], float]) -> DataFrame:
    """The matrix as 100 rows (zone_a, zone_b, zone_v)."""
    return spark.createDataFrame([(a, b, float(v)) for (a, b), v in sorted(voltages.items())], "zone_a int, zone_b int, zone_v double")


def _matrix_lookup(voltages: Mapping[tuple[int, int], float], a: Column, b: Column) -> Column:
    flat = F.array(*[F.lit(voltages[i, j]) for i in range(1, ZONE_COUNT + 1) for j in range(1, ZONE_COUNT + 1)])
    return F.get(flat, (a - 1) * ZONE_COUNT + b - 1)


# ---------------------------------------------------------------- pairs


def pair_requirements(pairs: DataFrame, assignments: DataFrame, voltages: Mapping[tuple[int, int], float], *, scope: Sequence[str] = (), zones_enabled: bool | None = None) -> DataFrame:
    """`pairs` with what each requires.

    `assignments` has net_name (unique within `scope`), final_voltage_v,
    galvanic_zone and source; both tables have the `scope` columns. Two left joins
    on the net, broadcast or salted by the number of assignments, so a net that
    most pairs share makes no hot task. Adds zone_a,
    zone_b, net_a_voltage_v, net_b_voltage_v, local_voltage_v, zone_voltage_v,
    required_voltage_v, requirement_source and warning.

    Different zones: the matrix decides. Else the difference of the two voltages,
    0 V for ground-like names without one, null if one is unknown. Zones count if
    `zones_enabled`, or, where that is None, if any assignment has one (one look
    at the assignments).
    """
    if zones_enabled is None:
        zones_enabled = bool(assignments.filter(zone_number(F.col("galvanic_zone")).isNotNull()).limit(1).count())
    joined = pairs
    for side, other in (("a", "b"), ("b", "a")):
        right = assignments.select(
            *scope,
            "net_name",
            F.col("net_name").alias(f"__{side}_net"),
            finite(F.col("final_voltage_v")).alias(f"__{side}_v"),
            zone_number(F.col("galvanic_zone")).alias(f"__{side}_zone"),
            F.coalesce("source", F.lit("")).alias(f"__{side}_source"),
        )
        joined = join_few(joined, right, {**{c: c for c in scope}, f"net_{side}": "net_name"}, spread=[f"net_{other}"])
    volts = {s: F.coalesce(F.col(f"__{s}_v"), F.when(ground_like(F.col(f"net_{s}")), 0.0)) for s in ("a", "b")}
    local = F.abs(volts["a"] - volts["b"])
    present = F.col("__a_net").isNotNull() | F.col("__b_net").isNotNull()
    any_is = lambda word: (F.col("__a_source") == word) | (F.col("__b_source") == word)
    source = (
        F.when(local.isNull(), "unknown")
        .when(any_is("manual"), "manual_override")
        .when(any_is("rule"), "rule_guess")
        .when(present, "net_class")
        .when(ground_like(F.col("net_a")) | ground_like(F.col("net_b")), "rule_guess")
        .otherwise("unknown")
    )
    za, zb = F.col("__a_zone"), F.col("__b_zone")
    across = F.lit(zones_enabled) & za.isNotNull() & zb.isNotNull() & (za != zb)
    across = F.coalesce(across, F.lit(False))
    zone_v = F.when(across, _matrix_lookup(voltages, za, zb))
    incomplete = F.lit(zones_enabled) & (za.isNull() | zb.isNull())
    warning = F.when(across, "").otherwise(F.concat_ws(" ", F.when(incomplete, INCOMPLETE), F.when(local.isNull(), UNKNOWN_VOLTAGE)))
    return joined.select(
        *[F.col(c) for c in pairs.columns],
        zone_label(za.cast("string")).alias("zone_a"),
        zone_label(zb.cast("string")).alias("zone_b"),
        volts["a"].alias("net_a_voltage_v"),
        volts["b"].alias("net_b_voltage_v"),
        local.alias("local_voltage_v"),
        zone_v.alias("zone_voltage_v"),
        F.coalesce(zone_v, local).alias("required_voltage_v"),
        F.when(across, "galvanic_zone").otherwise(source).alias("requirement_source"),
        warning.alias("warning"),
    )


def with_compliance(pairs: DataFrame, *, required: str = "required_voltage_v", supported: str = "effective_max_voltage_v") -> DataFrame:
    """Adds standard_voltage_status (OK, NOK or UNKNOWN) and voltage_margin_v (supported less required)."""
    margin = finite(F.col(supported)) - finite(F.col(required))
    return pairs.withColumn("voltage_margin_v", margin).withColumn("standard_voltage_status", F.when(margin >= 0, "OK").when(margin < 0, "NOK").otherwise("UNKNOWN"))


def requirement_summary(pairs: DataFrame) -> DataFrame:
    """One row of counts over pairs with compliance: across zones passed, failed and unknown; local, incomplete and unknown pairs."""
    across = F.col("requirement_source") == "galvanic_zone"
    status = F.col("standard_voltage_status")
    return pairs.agg(
        F.count_if(across).alias("cross_zone_pairs"),
        F.count_if(across & (status == "OK")).alias("cross_zone_pass"),
        F.count_if(across & (status == "NOK")).alias("cross_zone_fail"),
        F.count_if(across & (status == "UNKNOWN")).alias("cross_zone_unknown"),
        F.count_if(~across).alias("local_voltage_pairs"),
        F.count_if(~across & F.contains("warning", F.lit("incomplete"))).alias("incomplete_zone_pairs"),
        F.count_if(~across & F.contains(F.lower("warning"), F.lit("unknown"))).alias("unknown_voltage_pairs"),
    )


def zone_spacing(pairs: DataFrame) -> DataFrame:
    """Pairs across zones with pass: unknown counts as failed."""
    across = pairs.filter(F.col("requirement_source") == "galvanic_zone")
    return across.withColumn("passed", F.col("standard_voltage_status") == "OK")


def zone_counts(assignments: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Distinct nets per zone, Unassigned included, with 0 where a zone has none."""
    spark = assignments.sparkSession
    labels = spark.createDataFrame([(z,) for z in (*LABELS, "Unassigned")], "zone string")
    label = F.nullif(zone_label(F.col("galvanic_zone")), F.lit(""))
    counted = assignments.groupBy(*scope, F.coalesce(label, F.lit("Unassigned")).alias("zone")).agg(F.count_distinct("net_name").alias("n_nets"))
    if scope:
        groups = assignments.select(*scope).distinct().withColumn("zone", F.explode(F.array(*[F.lit(z) for z in (*LABELS, "Unassigned")])))
        return groups.join(counted, [*scope, "zone"], "left").fillna(0, ["n_nets"])
    return labels.join(counted, "zone", "left").fillna(0, ["n_nets"])
