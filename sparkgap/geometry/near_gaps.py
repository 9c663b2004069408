"""Air gaps of near nets in one pass over tiles, without storing any outline.

A tile is handed the boxes and cuts that reach into it or within the threshold of
it, as seven numbers each; outlines, traced edges, nearest points and what blocks
the line between them exist only while a tile is worked at. A line is shorter than
the threshold, so the tile that holds one of its ends sees all there is around it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .air_gap import SHORTEST_MM, covered_stretches, described
from .compositing import NOWHERE, RESOLUTION, SIDE_MM, Polygon, _edges_box, _turns, is_copper, nearest_edges, traced_edges
from .shapes import POINTS, bounds

TILE_MM = 20.0
FEW_ITEMS = 64  # up to so many in a tile every pair of bounds is compared beforehand
SHAPE = ("cx", "cy", "hx", "hy", "c", "s", "r")
GAPS = "net_a string, net_b string, clearance_mm double, x_a_mm double, y_a_mm double, x_b_mm double, y_b_mm double, blocked double, blockers array<string>"


def _covered(spans: Sequence[tuple[float, float]]) -> float:
    """Length of the union of intervals."""
    total, upto = 0.0, -np.inf
    for a, b in sorted(spans):
        total += max(0.0, b - max(a, upto))
        upto = max(upto, b)
    return total


def _polygons(shapes: np.ndarray, idx: np.ndarray, positive: np.ndarray) -> list[Polygon]:
    """Rounded boxes (cx, cy, hx, hy, c, s, r) as polygons."""
    out: list[Polygon] = []
    turns = {n: np.array(_turns(n)).T for n in (0, RESOLUTION)}
    for (cx, cy, hx, hy, c, s, r), k, p in zip(shapes, idx, positive):
        u, v, a, b = turns[RESOLUTION if r > 0 else 0]
        px, py = u * hx + r * a, v * hy + r * b
        out.append(Polygon(int(k), bool(p), [(False, cx + px * c - py * s, cy + px * s + py * c)]))
    return out


def _boxes(shapes: np.ndarray) -> np.ndarray:
    cx, cy, hx, hy, c, s, r = shapes.T
    ex, ey = np.abs(hx * c) + np.abs(hy * s) + r, np.abs(hx * s) + np.abs(hy * c) + r
    return np.column_stack([cx - ex, cy - ey, cx + ex, cy + ey])


def tile_gaps(nets: np.ndarray, idx: np.ndarray, positive: np.ndarray, shapes: np.ndarray, threshold_mm: float, window: tuple[float, float, float, float]) -> list[tuple]:
    """(net_a, net_b, clearance, nearest points, blocked length, blocking nets) of pairs nearer than the threshold by what lies in the window."""
    drawn = _polygons(shapes, idx, positive)
    cuts = [p for p in drawn if not p.positive]
    copper: dict[str, list[Polygon]] = {}
    for net, p in zip(nets, drawn):
        if p.positive:
            copper.setdefault(net, []).append(p)
    names = sorted(copper)
    reach = {n: (min(p.box[0] for p in copper[n]), min(p.box[1] for p in copper[n]), max(p.box[2] for p in copper[n]), max(p.box[3] for p in copper[n])) for n in names}
    apart = lambda p, q: max(p[0] - q[2], q[0] - p[2], p[1] - q[3], q[1] - p[3], 0.0)
    near = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :] if apart(reach[a], reach[b]) < threshold_mm]
    traced = {n: traced_edges(copper[n] + cuts, window) for n in sorted({n for pair in near for n in pair})}
    best: dict[tuple[str, str], tuple] = {}
    for a, b in near:
        (ea, la), (eb, lb) = traced[a], traced[b]
        gap = NOWHERE
        if len(ea) and len(eb):
            gap = nearest_edges(ea, eb, (threshold_mm, *NOWHERE[1:]))
        for host, e, lead in ((a, eb, lb), (b, ea, la)):
            if gap[0] > 0 and lead.any():
                spots = (e[lead, :2] + e[lead, 2:]) / 2
                inside = is_copper(spots, copper[host] + cuts)
                if inside.any():
                    x, y = min(map(tuple, spots[inside].tolist()))
                    gap = (0.0, x, y, x, y)
        if gap[0] < threshold_mm:
            best[a, b] = gap
    wide = (window[0] - 1.0, window[1] - 1.0, window[2] + 1.0, window[3] + 1.0)
    pairs = list(best)
    lines = np.array([best[p][1:] for p in pairs], float).reshape(-1, 4)
    length = np.hypot(lines[:, 2] - lines[:, 0], lines[:, 3] - lines[:, 1])
    spans: list[list[tuple[str, float, float]]] = [[] for _ in pairs]
    low, high = np.minimum(lines[:, :2], lines[:, 2:]), np.maximum(lines[:, :2], lines[:, 2:])
    for net in names:
        x0, y0, x1, y1 = reach[net]
        met = np.flatnonzero((length > SHORTEST_MM) & (low[:, 0] <= x1) & (high[:, 0] >= x0) & (low[:, 1] <= y1) & (high[:, 1] >= y0))
        for k in met.tolist():
            lx, ly, hx, hy = *low[k], *high[k]
            beside = [p for p in (*copper[net], *cuts) if p.box[0] <= hx and p.box[2] >= lx and p.box[1] <= hy and p.box[3] >= ly]
            if any(p.positive for p in beside):
                _, start, end = covered_stretches(lines[k : k + 1], beside, wide)
                spans[k] += [(net, a, b) for a, b in zip(start.tolist(), end.tolist())]
    out = []
    for k, pair in enumerate(pairs):
        own = [(a, b) for net, a, b in spans[k] if net in pair]
        blocked = max(0.0, min(float(length[k]), _covered([x[1:] for x in spans[k]]) - _covered(own)))
        blockers = sorted({net for net, a, b in spans[k] if net not in pair and b - a > SHORTEST_MM})
        out.append((*pair, *map(float, best[pair]), blocked, blockers))
    return out


def _worth(size: np.ndarray, first: np.ndarray, code: np.ndarray, positive: np.ndarray, boxes: np.ndarray, threshold_mm: float) -> np.ndarray:
    """Whether a tile holds boxes of different nets nearer than the threshold; tiles of many items count as such."""
    worth = size > FEW_ITEMS
    few = np.flatnonzero(~worth)
    n = size[few]
    tile = np.repeat(few, n * n)
    at = np.arange(len(tile)) - np.repeat(np.cumsum(n * n) - n * n, n * n)
    i, j = first[tile] + at // size[tile], first[tile] + at % size[tile]
    real = (i < j) & (code[i] != code[j]) & positive[i] & positive[j]
    tile, p, q = tile[real], boxes[i[real]], boxes[j[real]]
    gap = np.maximum(np.maximum(p[:, 0] - q[:, 2], q[:, 0] - p[:, 2]), np.maximum(p[:, 1] - q[:, 3], q[:, 1] - p[:, 3]))
    worth[tile[gap < threshold_mm]] = True
    return worth


def near_gaps(features: DataFrame, threshold_mm: float, scope: Sequence[str], *, tile_mm: float = TILE_MM) -> DataFrame:
    """(scope, net_a, net_b, clearance, nearest points, effective gap) of pairs below the threshold, as `effective_gaps` of `composited_pairs` gives it.

    Features need a `shape` (rings are not looked at), feature_index, polarity and
    net_name. One shuffle of shapes, entered in each tile that their bounds,
    widened by the threshold, touch.
    """
    s = list(scope)
    positive = F.coalesce(F.upper(F.trim("polarity")) == "P", F.lit(False))
    on_net = F.coalesce("net_name", F.lit("$NONE$"))
    drawn = features.filter("shape is not null").select(*s, on_net.alias("net"), F.col("feature_index").alias("idx"), positive.alias("positive"), "shape").filter("net <> '$NONE$' or not positive")
    drawn = drawn.withColumn("net", F.when(F.col("positive"), F.col("net")).otherwise(""))
    x0, y0, x1, y1 = bounds(F.col("shape"))
    edge = threshold_mm + SIDE_MM
    tiles = lambda low, high: F.explode(F.sequence(F.floor((low - edge) / tile_mm).cast("int"), F.floor((high + edge) / tile_mm).cast("int")))
    entered = drawn.filter((x0 + x1 + y0 + y1).isNotNull()).withColumn("tx", tiles(x0, x1)).withColumn("ty", tiles(y0, y1))
    item = F.struct("net", "idx", "positive", *[F.col("shape")[c].alias(c) for c in SHAPE])
    own = F.when(F.col("positive"), F.col("net"))
    lists = entered.groupBy(*s, "tx", "ty").agg(F.collect_list(item).alias("items"), F.min(own).alias("__low"), F.max(own).alias("__high")).filter("__low < __high").drop("__low", "__high")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lists.select(*s).schema)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.string())
        names = [f.split()[0] for f in GAPS.split(", ")]
        for batch in batches:
            column = batch.column("items")
            ends = column.offsets.to_numpy()
            items = column.values
            of = lambda c: items.field(c)
            nets, plus = of("net").to_numpy(zero_copy_only=False), of("positive").to_numpy(zero_copy_only=False)
            idx = of("idx").to_numpy(zero_copy_only=False)
            shapes = np.column_stack([of(c).to_numpy(zero_copy_only=False) for c in SHAPE])
            code = of("net").dictionary_encode().indices.to_numpy(zero_copy_only=False)
            worth = _worth(np.diff(ends), ends[:-1], code, plus, _boxes(shapes), threshold_mm)
            tx, ty = batch.column("tx").to_numpy(), batch.column("ty").to_numpy()
            rows, at = [], []
            for k in np.flatnonzero(worth).tolist():
                part = slice(ends[k], ends[k + 1])
                window = (tx[k] * tile_mm - threshold_mm, ty[k] * tile_mm - threshold_mm, (tx[k] + 1) * tile_mm + threshold_mm, (ty[k] + 1) * tile_mm + threshold_mm)
                found = tile_gaps(nets[part], idx[part], plus[part], shapes[part], threshold_mm, window)
                rows += found
                at += [k] * len(found)
            where = pa.array(at, pa.int64())
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            kinds = [pa.string(), pa.string(), *[pa.float64()] * 6, kind]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(where) for c in s], *[pa.array(list(v), t) for v, t in zip(columns, kinds)]], names=[*s, *names])

    near = lists.mapInArrow(measured, f"{types}, {GAPS}")
    least = near.groupBy(*s, "net_a", "net_b").agg(F.min(F.struct("clearance_mm", *POINTS, "blocked", "blockers")).alias("m")).select(*s, "net_a", "net_b", "m.*")
    line = F.sqrt(F.pow(F.col("x_b_mm") - F.col("x_a_mm"), 2) + F.pow(F.col("y_b_mm") - F.col("y_a_mm"), 2))
    return described(least.withColumn("line_mm", line).withColumnsRenamed({"blocked": "copper_blocked_length_mm", "blockers": "__nets"}), [*s, "net_a", "net_b"])
