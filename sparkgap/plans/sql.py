"""SQL fragments for the comparison queries; the curves stand here once more, so that a wrong point of the engine's shows."""

from __future__ import annotations

from collections.abc import Sequence

# Mm and volts of the clearance and creepage curves, metres and factor, volts and mm of the spacing ranges.
CLEARANCE_POINTS = ((0.05, 10.0), (0.10, 20.0), (0.20, 30.0), (0.40, 60.0), (0.60, 100.0), (0.80, 150.0), (1.50, 250.0), (3.00, 400.0), (5.50, 600.0), (8.00, 1000.0))
CREEPAGE_POINTS = (
    (0.20, 10.0), (0.40, 25.0), (0.85, 50.0), (1.50, 100.0), (2.00, 150.0), (3.20, 250.0), (6.30, 400.0), (8.00, 500.0), (10.00, 630.0), (12.50, 800.0), (16.00, 1000.0),
)
ALTITUDE_POINTS = ((0.0, 1.00), (2000.0, 1.00), (3000.0, 1.14), (4000.0, 1.29), (5000.0, 1.48), (6000.0, 1.70), (7000.0, 1.95), (8000.0, 2.25), (10000.0, 2.90))
IPC_RANGES = (
    (15.0, 0.05, 0.10, 0.10), (30.0, 0.05, 0.10, 0.10), (50.0, 0.10, 0.60, 0.60), (100.0, 0.10, 0.60, 1.50), (150.0, 0.20, 0.60, 3.20), (170.0, 0.20, 1.25, 3.20),
    (250.0, 0.20, 1.25, 6.40), (300.0, 0.20, 1.25, 12.50), (500.0, 0.25, 2.50, 12.50),
)
IPC_SLOPES = (0.0025, 0.005, 0.025)


def _values(points: Sequence[Sequence[object]]) -> str:
    return ", ".join("(" + ", ".join(repr(v) for v in p) + ")" for p in points)


def inverted(distance: str, points: Sequence[tuple[float, float]]) -> str:
    """Piecewise-linear reading of a curve at `distance`, with the rules for both ends."""
    (d0, v0), (dn, vn), (dm, vm) = points[0], points[-1], points[-2]
    whens = "".join(f" WHEN {distance} <= {b[0]} THEN {a[1]} + ({distance} - {a[0]}) / ({b[0]} - {a[0]}) * ({b[1]} - {a[1]})" for a, b in zip(points, points[1:]))
    last = f"least(1500.0, {vn} + ({distance} - {dn}) * (({vn} - {vm}) / ({dn} - {dm})))"
    return f"CASE WHEN {distance} <= 0 THEN 0.0 WHEN {distance} <= {d0} THEN {v0} * {distance} / {d0}{whens} ELSE {last} END"


def altitude(x: str) -> str:
    whens = "".join(f" WHEN {x} <= {b[0]} THEN {a[1]} + ({x} - {a[0]}) / ({b[0]} - {a[0]}) * ({b[1]} - {a[1]})" for a, b in zip(ALTITUDE_POINTS, ALTITUDE_POINTS[1:]))
    return f"CASE{whens} ELSE {ALTITUDE_POINTS[-1][1]} END"


def effective(distance: str, scale: str, factor: str) -> str:
    return f"least({inverted(f'({distance} / ({factor}))', CLEARANCE_POINTS)}, {inverted(f'({distance} / ({scale}))', CREEPAGE_POINTS)})"


def ipc(distance: str, column: int) -> str:
    """Column 1 is internal, 2 external, 3 external at high altitude."""
    first, full, slope = IPC_RANGES[0][column], IPC_RANGES[-1][column], IPC_SLOPES[column - 1]
    steps = "".join(f" WHEN {distance} + 1e-12 >= {r[column]} THEN {r[0]}" for r in reversed(IPC_RANGES))
    return (
        f"least(5000.0, CASE WHEN {distance} < {first} THEN 15.0 * {distance} / {first}"
        f" WHEN {distance} > {full} THEN greatest(500.0, 500.0 + ({distance} - {full}) / {slope}){steps} ELSE 0.0 END)"
    )


NORMAL = "trim(regexp_replace(translate(upper({0}), '-+. /', '_____'), '_+', '_', 'g'), '_')"

#: Latest revision of each project, each net once.
LATEST = """latest AS (
  SELECT * FROM assignment_snapshots QUALIFY rev_no = max(rev_no) OVER (PARTITION BY project_id)
), assigned AS (
  SELECT * FROM latest QUALIFY row_number() OVER (PARTITION BY project_id, net_name ORDER BY loaded_at DESC NULLS LAST, row_id DESC NULLS LAST) = 1
)"""
