"""Working voltages that a copper spacing supports, as column expressions.

Screening curves only. Every function builds an expression from columns or
numbers, so that settings may differ from row to row and all stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Required clearance in mm at sea level, and the voltage it supports.
CLEARANCE_POINTS = (
    (0.05, 10.0), (0.10, 20.0), (0.20, 30.0), (0.40, 60.0), (0.60, 100.0), (0.80, 150.0), (1.50, 250.0), (3.00, 400.0), (5.50, 600.0),
    (8.00, 1000.0),
)
# Required creepage in mm for pollution degree 2 and material group IIIa.
CREEPAGE_POINTS = (
    (0.20, 10.0), (0.40, 25.0), (0.85, 50.0), (1.50, 100.0), (2.00, 150.0), (3.20, 250.0), (6.30, 400.0), (8.00, 500.0), (10.00, 630.0),
    (12.50, 800.0), (16.00, 1000.0),
)
# Least CTI of a material group and its creepage scale; creepage scale by pollution degree.
MATERIAL_GROUPS = ((600.0, "I", 0.70), (400.0, "II", 0.85), (175.0, "IIIa", 1.00), (100.0, "IIIb", 1.12))
LOWEST_GROUP = ("below IIIb", 1.35)
POLLUTION_SCALE = {1: 0.55, 2: 1.00, 3: 1.65, 4: 2.40}
# Altitude in m and the clearance factor.
ALTITUDE_POINTS = (
    (0.0, 1.00), (2000.0, 1.00), (3000.0, 1.14), (4000.0, 1.29), (5000.0, 1.48), (6000.0, 1.70), (7000.0, 1.95), (8000.0, 2.25),
    (10000.0, 2.90),
)
# Upper voltage of a range and the conductor spacing in mm for internal, external and high external conductors.
IPC_RANGES = (
    (15.0, 0.05, 0.10, 0.10), (30.0, 0.05, 0.10, 0.10), (50.0, 0.10, 0.60, 0.60), (100.0, 0.10, 0.60, 1.50), (150.0, 0.20, 0.60, 3.20),
    (170.0, 0.20, 1.25, 3.20), (250.0, 0.20, 1.25, 6.40), (300.0, 0.20, 1.25, 12.50), (500.0, 0.25, 2.50, 12.50),
)
IPC_SLOPES = (0.0025, 0.005, 0.025)
IPC_CLASSES = ("internal", "external", "external_high_altitude")
HIGH_ALTITUDE_M, MOST_EFFECTIVE_V, MOST_IPC_V = 3050.0, 1500.0, 5000.0
DEFAULT_CTI, DEFAULT_ALTITUDE_M, DEFAULT_POLLUTION = 175.0, 5500.0, 2

Number = Column | float | int


def _column(value: Number) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def material_group(cti: Number) -> Column:
    """The material group of a comparative tracking index; a null index is the default's."""
    value, out = F.coalesce(_column(cti), F.lit(DEFAULT_CTI)), F.lit(LOWEST_GROUP[0])
    for least, name, _ in reversed(MATERIAL_GROUPS):
        out = F.when(value >= least, name).otherwise(out)
    return out


def material_scale(cti: Number) -> Column:
    value, out = F.coalesce(_column(cti), F.lit(DEFAULT_CTI)), F.lit(LOWEST_GROUP[1])
    for least, _, scale in reversed(MATERIAL_GROUPS):
        out = F.when(value >= least, scale).otherwise(out)
    return out


def pollution_scale(degree: Number) -> Column:
    """Creepage scale; degrees are cut to whole numbers within 1 to 4, null is 2."""
    value = F.coalesce(_column(degree).cast("int"), F.lit(DEFAULT_POLLUTION))
    return F.when(value <= 1, POLLUTION_SCALE[1]).when(value == 2, POLLUTION_SCALE[2]).when(value == 3, POLLUTION_SCALE[3]).otherwise(POLLUTION_SCALE[4])


def _between(x: Column, low: tuple[float, float], high: tuple[float, float]) -> Column:
    return F.lit(low[1]) + (x - low[0]) / (high[0] - low[0]) * (high[1] - low[1])


def altitude_factor(altitude_m: Number) -> Column:
    """Clearance factor of an altitude, linear between points, constant beyond them; null is 5500 m."""
    x = F.greatest(F.lit(0.0), F.coalesce(_column(altitude_m), F.lit(DEFAULT_ALTITUDE_M)))
    out = F.lit(ALTITUDE_POINTS[-1][1])
    for low, high in reversed(list(zip(ALTITUDE_POINTS, ALTITUDE_POINTS[1:]))):
        out = F.when(x <= high[0], _between(x, low, high)).otherwise(out)
    return out


def supported_by(distance: Column, points: Sequence[tuple[float, float]]) -> Column:
    """A required-distance curve read backwards: proportional below its first point,
    linear between points, on along the last slope beyond, up to 1500 V."""
    first, last = points[0], points[-1]
    out = F.least(F.lit(MOST_EFFECTIVE_V), _between(distance, points[-2], last))
    for low, high in reversed(list(zip(points, points[1:]))):
        out = F.when(distance <= high[0], _between(distance, low, high)).otherwise(out)
    return F.when(distance <= 0, 0.0).when(distance <= first[0], distance * (first[1] / first[0])).otherwise(out)


def clearance_voltage(distance_mm: Column, altitude_m: Number = DEFAULT_ALTITUDE_M) -> Column:
    return supported_by(distance_mm / altitude_factor(altitude_m), CLEARANCE_POINTS)


def creepage_voltage(distance_mm: Column, cti: Number = DEFAULT_CTI, pollution: Number = DEFAULT_POLLUTION) -> Column:
    """Scaling every point of the curve is the same as scaling the distance back."""
    return supported_by(distance_mm / (material_scale(cti) * pollution_scale(pollution)), CREEPAGE_POINTS)


def usable_distance(distance_mm: Column) -> Column:
    """Null where a distance is null, NaN or negative."""
    return F.when(~F.isnan(distance_mm) & (distance_mm >= 0), distance_mm)


def effective_voltage(distance_mm: Column, cti: Number = DEFAULT_CTI, pollution: Number = DEFAULT_POLLUTION, altitude_m: Number = DEFAULT_ALTITUDE_M) -> Column:
    """The lower of the clearance and the creepage voltage; null without a usable distance."""
    d = usable_distance(distance_mm)
    return F.when(d.isNotNull(), F.greatest(F.lit(0.0), F.least(clearance_voltage(d, altitude_m), creepage_voltage(d, cti, pollution))))


def spacing_class(role: Column, altitude_m: Number = 0.0) -> Column:
    """internal, external, or external_high_altitude above 3050 m; unknown roles are external."""
    inner = F.lower(F.trim(role)).isin("internal", "inner", "int")
    return F.when(inner, IPC_CLASSES[0]).when(F.coalesce(_column(altitude_m), F.lit(0.0)) > HIGH_ALTITUDE_M, IPC_CLASSES[2]).otherwise(IPC_CLASSES[1])


def ipc_voltage(distance_mm: Column, role: Column, altitude_m: Number = 0.0) -> Column:
    """The largest range whose spacing is met: proportional below the first, sloped above the last, at most 5000 V."""
    d, kind = usable_distance(distance_mm), spacing_class(role, altitude_m)
    by_class = []
    for k, slope in enumerate(IPC_SLOPES, start=1):
        first, full = IPC_RANGES[0][k], IPC_RANGES[-1][k]
        met = F.lit(0.0)
        for row in IPC_RANGES:  # spacings never fall, so the last one met is the largest
            met = F.when(d + 1e-12 >= row[k], row[0]).otherwise(met)
        above = F.greatest(met, F.lit(500.0) + (d - full) / slope)
        by_class.append(F.when(d < first, d * 15.0 / first).when(d > full, above).otherwise(met))
    volts = F.when(kind == IPC_CLASSES[0], by_class[0]).when(kind == IPC_CLASSES[1], by_class[1]).otherwise(by_class[2])
    return F.when(d.isNotNull(), F.least(F.lit(MOST_IPC_V), F.greatest(F.lit(0.0), volts)))


def layer_pollution(role: Column, coated: Column, base: Number = DEFAULT_POLLUTION) -> Column:
    """Pollution degree of a layer: internal 1, coated 2, else the board's, within 1 to 4."""
    return F.when(role == "internal", 1).when(coated, 2).otherwise(F.greatest(F.lit(1), F.least(F.lit(4), _column(base).cast("int"))))


def without_particle(distance_mm: Column, role: Column, particle_mm: Number) -> Column:
    """The distance less a metallic particle that may lie between conductors of an external layer."""
    return F.when(role == "internal", distance_mm).otherwise(F.greatest(F.lit(0.0), distance_mm - _column(particle_mm)))
