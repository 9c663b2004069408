"""Arcs as chains of chords."""

from __future__ import annotations

import math

Point = tuple[float, float]


def arc_points(start: Point, end: Point, centre: Point, *, clockwise: bool | None, resolution: int = 16) -> list[Point]:
    """Points after `start` along an arc, `end` exactly last.

    Steps are at most 90/resolution degrees, but at least one degree. Without a
    direction the shorter way is taken. Equal start and end make a full circle.
    """
    a0 = math.atan2(start[1] - centre[1], start[0] - centre[0])
    a1 = math.atan2(end[1] - centre[1], end[0] - centre[0])
    r0, r1 = math.dist(start, centre), math.dist(end, centre)
    ahead = (a1 - a0) % (2 * math.pi)
    if math.dist(start, end) < 1e-12:
        ahead = 0.0
    if clockwise is None:
        sweep = ahead if ahead <= math.pi else ahead - 2 * math.pi
    elif clockwise:
        sweep = ahead - 2 * math.pi
    else:
        sweep = ahead or 2 * math.pi
    step = math.radians(max(1.0, 90 / max(1, resolution)))
    n = max(1, math.ceil(abs(sweep) / step - 1e-9))
    inner = []
    for k in range(1, n):
        t = k / n
        r = r0 + (r1 - r0) * t
        inner.append((centre[0] + r * math.cos(a0 + sweep * t), centre[1] + r * math.sin(a0 + sweep * t)))
    return [*inner, end]
