"""How much of the straight line between two nets is free of other copper.

Lines are entered in the grid cells that they pass, where they meet the nets whose
copper reaches into the cell; a task finds on which stretches of a portion of
lines one net's copper lies within one cell. Stretches are put together per line
by the union of intervals. No task holds a whole net, layer or all lines of a cell.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.measurements import blocked_length
from ..tables import settle
from .compositing import GRID_MM, Polygon, _clipped, _read, is_copper
from .shapes import POINTS

PORTIONS = 64  # into which the lines of a cell are dealt by hash
SHOWN_BLOCKERS = 12
SHORTEST_MM = 1e-9


def covered_stretches(lines: np.ndarray, polygons: Sequence[Polygon], window: tuple[float, float, float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, from, to) in mm along each line (x1, y1, x2, y2) where it runs through copper within a window."""
    parts, own = _clipped(lines, window)
    edges = np.vstack([p.edges for p in polygons]) if polygons else np.empty((0, 4))
    edges, _ = _clipped(edges, (window[0] - 1e-6, window[1] - 1e-6, window[2] + 1e-6, window[3] + 1e-6))
    d, e = parts[:, 2:] - parts[:, :2], edges[:, 2:] - edges[:, :2]
    cuts: list[np.ndarray] = []
    for k in range(len(parts)):
        cross = d[k, 0] * e[:, 1] - d[k, 1] * e[:, 0]
        off = edges[:, :2] - parts[k, :2]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (off[:, 0] * e[:, 1] - off[:, 1] * e[:, 0]) / cross
            u = (off[:, 0] * d[k, 1] - off[:, 1] * d[k, 0]) / cross
        met = (np.abs(cross) > 1e-15) & (t > 0) & (t < 1) & (u >= -1e-12) & (u <= 1 + 1e-12)
        flat = np.abs(cross) <= 1e-15  # an edge along the line ends a stretch where it ends
        along = [((edges[flat][:, c : c + 2] - parts[k, :2]) @ d[k]) / max(d[k] @ d[k], 1e-300) for c in (0, 2)]
        places = np.concatenate([t[met], *along])
        cuts.append(np.unique(np.concatenate([[0.0, 1.0], places[(places > 0) & (places < 1)]])))
    if not cuts:
        return np.empty(0, np.int64), np.empty(0), np.empty(0)
    of = np.repeat(np.arange(len(parts)), [len(c) - 1 for c in cuts])
    low, high = np.concatenate([c[:-1] for c in cuts]), np.concatenate([c[1:] for c in cuts])
    middle = parts[of, :2] + ((low + high) / 2)[:, None] * d[of]
    hit = is_copper(middle, polygons)
    of, low, high = of[hit], low[hit], high[hit]
    length = np.hypot(d[:, 0], d[:, 1])
    start = np.hypot(parts[:, 0] - lines[own, 0], parts[:, 1] - lines[own, 1])
    return own[of], start[of] + low * length[of], start[of] + high * length[of]


def effective_gaps(pairs: DataFrame, nets: DataFrame, scope: Sequence[str], *, cell_mm: float = GRID_MM) -> DataFrame:
    """Per pair the direct and the effective air gap along the line between its nearest points.

    `pairs` has the scope, net_a, net_b, clearance_mm and the nearest points (each
    pair once), `nets` is what `net_polygons` gives for the same `cell_mm`. Adds
    direct_clearance_mm, effective_air_gap_mm, copper_blocked_length_mm,
    copper_on_path and blocker_nets (the first 12 by name, then an ellipsis).
    Copper of the two nets themselves doesn't block. Pairs without points, or whose
    points coincide, keep their clearance.
    """
    s = list(scope)
    pair = [*s, "net_a", "net_b"]
    x1, y1, x2, y2 = (F.col(c) for c in POINTS)
    long = F.sqrt(F.pow(x2 - x1, 2) + F.pow(y2 - y1, 2))
    base = settle(pairs.select(*pair, "clearance_mm", *POINTS), line_mm=long)
    cell = lambda v: F.floor(v / cell_mm).cast("int")
    columns = base.filter(F.col("line_mm") > SHORTEST_MM).withColumn("gx", F.explode(F.sequence(cell(F.least(x1, x2)), cell(F.greatest(x1, x2)))))
    slope = (y2 - y1) / F.nullif(x2 - x1, F.lit(0.0))
    at = lambda x: F.coalesce(y1 + (F.greatest(F.least(x, F.greatest(x1, x2)), F.least(x1, x2)) - x1) * slope, F.lit(None).cast("double"))
    columns = settle(columns, __l=F.coalesce(at(F.col("gx") * cell_mm), y1), __r=F.coalesce(at((F.col("gx") + 1) * cell_mm), y2))
    passed = columns.withColumn("gy", F.explode(F.sequence(cell(F.least("__l", "__r") - 1e-9), cell(F.greatest("__l", "__r") + 1e-9))))
    near = passed.join(nets.select(*s, "gx", "gy", "net", "x0", "y0", "x1", "y1"), [*s, "gx", "gy"])
    near = near.filter((F.least(x1, x2) <= F.col("x1")) & (F.greatest(x1, x2) >= F.col("x0")) & (F.least(y1, y2) <= F.col("y1")) & (F.greatest(y1, y2) >= F.col("y0")))
    portion = F.pmod(F.xxhash64("net_a", "net_b"), F.lit(PORTIONS)).alias("portion")
    lists = near.groupBy(*s, "gx", "gy", "net", portion).agg(F.collect_list(F.struct("net_a", "net_b", *POINTS)).alias("lines"))
    work = lists.join(nets.select(*s, "gx", "gy", "net", "polygons"), [*s, "gx", "gy", "net"])
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*s).schema)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*s, "net_a", "net_b", "net", "start", "end"]
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                lines = np.array([[q[c] for c in POINTS] for q in row["lines"]], float)
                x, y = row["gx"] * cell_mm, row["gy"] * cell_mm
                which, start, end = covered_stretches(lines, _read(row["polygons"]), (x, y, x + cell_mm, y + cell_mm))
                out += [(*[row[c] for c in s], row["lines"][k]["net_a"], row["lines"][k]["net_b"], row["net"], a, b) for k, a, b in zip(which, start, end)]
            yield pd.DataFrame(out, columns=names, dtype=object).astype({"start": float, "end": float})

    from ..session import cut_lineage

    spans = cut_lineage(work.mapInPandas(found, f"{types}, net_a string, net_b string, net string, start double, end double"))
    own = (F.col("net") == F.col("net_a")) | (F.col("net") == F.col("net_b"))
    all_copper = blocked_length(spans, pair).withColumnRenamed("covered", "__all")
    pair_copper = blocked_length(spans.filter(own), pair).withColumnRenamed("covered", "__own")
    others = spans.filter(~own & (F.col("end") - F.col("start") > SHORTEST_MM)).groupBy(*pair).agg(F.array_sort(F.collect_set("net")).alias("__nets"))
    joined = base.join(all_copper, pair, "left").join(pair_copper, pair, "left").join(others, pair, "left")
    blocked = F.greatest(F.lit(0.0), F.least("line_mm", F.coalesce("__all", F.lit(0.0)) - F.coalesce("__own", F.lit(0.0))))
    joined = settle(joined, copper_blocked_length_mm=F.when(F.col("line_mm") > SHORTEST_MM, blocked).otherwise(0.0))
    return described(joined, pair)


def described(gaps: DataFrame, pair: Sequence[str]) -> DataFrame:
    """The columns of `effective_gaps` from line_mm, copper_blocked_length_mm, `__nets` and the pairs' own."""
    on_path = F.col("copper_blocked_length_mm") > F.greatest(F.lit(1e-6), F.col("line_mm") * 1e-6)
    shown = F.concat(F.array_join(F.slice("__nets", 1, SHOWN_BLOCKERS), ", "), F.when(F.size("__nets") > SHOWN_BLOCKERS, " ...").otherwise(""))
    gap = F.when(F.col("line_mm") > SHORTEST_MM, F.greatest(F.lit(0.0), F.col("line_mm") - F.col("copper_blocked_length_mm"))).otherwise(F.col("clearance_mm"))
    return gaps.select(
        *pair, F.col("clearance_mm").alias("direct_clearance_mm"), gap.alias("effective_air_gap_mm"), "copper_blocked_length_mm", F.coalesce(on_path, F.lit(False)).alias("copper_on_path"),
        F.when(on_path, F.coalesce(shown, F.lit(""))).otherwise("").alias("blocker_nets"), *POINTS,
    )
