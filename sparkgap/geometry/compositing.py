"""Copper of nets under ordered drawing, without polygon booleans.

Features are drawn in order; positive ones add copper of their net, all others
cut whatever is there. So a point is copper of a net exactly if the last positive
of the net that covers it comes after the last cut that covers it. A net's edge
is made of those pieces of its positives' and the cuts' edges whose two sides
differ; pieces end where edges cross. Distances between nets are those between
such pieces, or 0 where one net lies within another.

Everything is cut up by a grid: a task traces one net within one cell, from the
polygons that reach into the cell, so a net that holds most of a layer spreads
over the layer's cells.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import join_few, settle
from .shapes import POINTS

RESOLUTION = 16
SIDE_MM = 1e-6  # how far off an edge its sides are looked at
GRID_MM = 5.0  # cells in which nets are traced
PART_MM = 20.0  # cells into which the edges of a net are parted where every pair of nets is measured
BLOCK_EDGES, BLOCK_NETS = 20_000, 300  # of a layer, that meet another such block in one task
LEAF_PAIRS = 4096
MOST_PIECES = 500_000  # handed on at once
AT_ONCE = 2_000_000  # pairs of points and edges held at a time
POLYGON = "struct<idx:int,positive:boolean,rings:array<struct<hole:boolean,xs:array<double>,ys:array<double>>>>"


class Polygon:
    """Islands less holes; `edges` holds x1, y1, x2, y2 of all rings."""

    def __init__(self, idx: int, positive: bool, rings: Sequence[tuple[bool, Sequence[float], Sequence[float]]]) -> None:
        self.idx, self.positive = idx, positive
        self.rings = []
        for hole, xs, ys in rings:
            points = np.column_stack([np.asarray(xs, float), np.asarray(ys, float)])
            if len(points) > 1 and np.array_equal(points[0], points[-1]):
                points = points[:-1]
            if len(points) >= 3:
                self.rings.append((hole, np.hstack([points, np.roll(points, -1, axis=0)])))
        self.edges = np.vstack([e for _, e in self.rings]) if self.rings else np.empty((0, 4))
        xs, ys = self.edges[:, 0::2], self.edges[:, 1::2]
        self.box = (xs.min(), ys.min(), xs.max(), ys.max()) if len(self.edges) else (np.inf, np.inf, -np.inf, -np.inf)

    def covers(self, points: np.ndarray) -> np.ndarray:
        """Whether points lie within any island and in no hole."""
        out = np.zeros(len(points), bool)
        near = (points[:, 0] >= self.box[0]) & (points[:, 0] <= self.box[2]) & (points[:, 1] >= self.box[1]) & (points[:, 1] <= self.box[3])
        if not near.any():
            return out
        p = points[near]
        island, hole = np.zeros(len(p), bool), np.zeros(len(p), bool)
        low, high = p[:, 1].min(), p[:, 1].max()
        for is_hole, e in self.rings:
            e = e[(np.minimum(e[:, 1], e[:, 3]) <= high) & (np.maximum(e[:, 1], e[:, 3]) >= low)]
            step = max(1, AT_ONCE // max(len(e), 1))
            for k in range(0, len(p), step):
                q = p[k : k + step]
                above = (e[None, :, 1] > q[:, 1:]) != (e[None, :, 3] > q[:, 1:])
                with np.errstate(divide="ignore", invalid="ignore"):
                    x = e[:, 0] + (q[:, 1:] - e[:, 1]) / (e[:, 3] - e[:, 1]) * (e[:, 2] - e[:, 0])
                odd = (above & (q[:, :1] < x)).sum(axis=1) % 2 == 1
                (hole if is_hole else island)[k : k + step] |= odd
        out[near] = island & ~hole
        return out


def _turns(resolution: int) -> list[tuple[int, int, float, float]]:
    """Corner (u, v) and direction (cosine, sine) of each point around a rounded box; one a corner for resolution 0."""
    corners = enumerate(((1, 1), (-1, 1), (-1, -1), (1, -1)))
    steps = [j * np.pi / 2 / resolution for j in range(resolution + 1)] if resolution else [0.0]
    return [(u, v, float(np.cos(k * np.pi / 2 + t)), float(np.sin(k * np.pi / 2 + t))) for k, (u, v) in corners for t in steps]


def rounded_box_ring(cx: float, cy: float, hx: float, hy: float, c: float, s: float, r: float, resolution: int = RESOLUTION) -> tuple[list[float], list[float]]:
    """The edge of a rounded box, corners as chains of chords."""
    xs, ys = [], []
    for u, v, a, b in _turns(resolution if r > 0 else 0):
        px, py = u * hx + r * a, v * hy + r * b
        xs.append(cx + px * c - py * s)
        ys.append(cy + px * s + py * c)
    return xs, ys


def is_copper(points: np.ndarray, polygons: Sequence[Polygon]) -> np.ndarray:
    """Whether points are copper after all polygons were drawn in order."""
    last_positive, last_cut = np.full(len(points), -1), np.full(len(points), -1)
    for p in polygons:
        target = last_positive if p.positive else last_cut
        covered = p.covers(points)
        target[covered] = np.maximum(target[covered], p.idx)
    return last_positive > last_cut


Window = tuple[float, float, float, float]  # x0, y0, x1, y1; without the upper borders


def _clipped(edges: np.ndarray, window: Window | None) -> tuple[np.ndarray, np.ndarray]:
    """The parts of edges within a window, and which edges they are of."""
    own = np.arange(len(edges))
    if window is None or not len(edges):
        return edges, own
    start, d = edges[:, :2], edges[:, 2:] - edges[:, :2]
    low, high = np.zeros(len(edges)), np.ones(len(edges))
    with np.errstate(divide="ignore", invalid="ignore"):
        for axis in (0, 1):
            t = np.sort(np.column_stack([(window[axis] - start[:, axis]) / d[:, axis], (window[axis + 2] - start[:, axis]) / d[:, axis]]), axis=1)
            flat = d[:, axis] == 0
            inside = (start[:, axis] >= window[axis]) & (start[:, axis] <= window[axis + 2])
            low = np.maximum(low, np.where(flat, np.where(inside, 0.0, 2.0), t[:, 0]))
            high = np.minimum(high, np.where(flat, 1.0, t[:, 1]))
    kept = low < high
    out = np.hstack([start[kept] + low[kept, None] * d[kept], start[kept] + high[kept, None] * d[kept]])
    whole = (low[kept] == 0.0) & (high[kept] == 1.0)
    out[whole] = edges[kept][whole]
    middle = (out[:, :2] + out[:, 2:]) / 2
    within = (middle[:, 0] >= window[0]) & (middle[:, 0] < window[2]) & (middle[:, 1] >= window[1]) & (middle[:, 1] < window[3])
    return out[within], own[kept][within]


def _near_pairs(edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of edges whose bounds meet, i before j in x, in portions."""
    lo, hi = np.minimum(edges[:, :2], edges[:, 2:]), np.maximum(edges[:, :2], edges[:, 2:])
    order = np.argsort(lo[:, 0], kind="stable")
    ends = np.searchsorted(lo[order, 0], hi[order, 0], side="right")
    counts = ends - np.arange(len(order)) - 1
    starts = np.concatenate([[0], np.cumsum(counts)])
    at = 0
    while at < len(order):
        upto = max(at + 1, int(np.searchsorted(starts, starts[at] + AT_ONCE, side="right")) - 1)
        n = counts[at:upto]
        i = np.repeat(np.arange(at, upto), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(starts[at:upto] - starts[at], n)
        i, j = order[i], order[j]
        meet = (lo[i, 1] <= hi[j, 1]) & (lo[j, 1] <= hi[i, 1])
        yield i[meet], j[meet]
        at = upto


def _stops(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edge, place from 0 to 1) of every point where another edge crosses or touches it."""
    owners, places = [np.empty(0, np.int64)], [np.empty(0)]
    d = edges[:, 2:] - edges[:, :2]
    for i, j in _near_pairs(edges):
        cross = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
        off = edges[j, :2] - edges[i, :2]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (off[:, 0] * d[j, 1] - off[:, 1] * d[j, 0]) / cross
            u = (off[:, 0] * d[i, 1] - off[:, 1] * d[i, 0]) / cross
        met = (np.abs(cross) > 1e-15) & (t >= -1e-12) & (t <= 1 + 1e-12) & (u >= -1e-12) & (u <= 1 + 1e-12)
        owners += [i[met], j[met]]
        places += [t[met], u[met]]
        flat = np.abs(cross) <= 1e-15
        for a, b in ((i[flat], j[flat]), (j[flat], i[flat])):  # parallel edges: their ends may lie on this one
            square = (d[a] ** 2).sum(axis=1)
            for ends in (edges[b, :2], edges[b, 2:]):
                rel = ends - edges[a, :2]
                on = np.abs(rel[:, 0] * d[a, 1] - rel[:, 1] * d[a, 0]) <= 1e-12 * np.maximum(square, 1e-12)
                owners.append(a[on])
                places.append((rel[on] * d[a][on]).sum(axis=1) / np.maximum(square[on], 1e-300))
    owner, place = np.concatenate(owners), np.concatenate(places)
    inner = (place > 1e-12) & (place < 1 - 1e-12)
    return owner[inner], place[inner]


def _split(edges: np.ndarray) -> np.ndarray:
    """The pieces of edges between the points where they meet."""
    owner, place = _stops(edges)
    n = len(edges)
    owner = np.concatenate([np.arange(n), np.arange(n), owner])
    place = np.concatenate([np.zeros(n), np.ones(n), place])
    order = np.lexsort((place, owner))
    owner, place = owner[order], place[order]
    real = (owner[1:] == owner[:-1]) & (place[1:] > place[:-1])
    k, d = owner[:-1][real], edges[:, 2:] - edges[:, :2]
    return np.hstack([edges[k, :2] + place[:-1][real, None] * d[k], edges[k, :2] + place[1:][real, None] * d[k]])


def _chain_leads(pieces: np.ndarray) -> np.ndarray:
    """One piece of each set of pieces that hang together by their ends."""
    ends = np.round(pieces.reshape(-1, 2), 9)
    _, at = np.unique(ends, axis=0, return_inverse=True)
    at = at.reshape(-1)
    root = np.arange(int(at.max()) + 1 if len(at) else 0)

    def of(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in zip(at[0::2].tolist(), at[1::2].tolist()):
        root[of(a)] = of(b)
    heads = np.array([of(a) for a in at[0::2].tolist()], np.int64)
    lead = np.zeros(len(pieces), bool)
    lead[np.unique(heads, return_index=True)[1]] = True
    return lead


def traced_edges(polygons: Sequence[Polygon], window: Window | None = None) -> tuple[np.ndarray, np.ndarray]:
    """x1, y1, x2, y2 of the pieces within a window that separate copper from none, and of each chain of them one marked.

    A polygon whose bounds meet no other's keeps its edges if it is positive and
    its rings don't meet either; only the others are taken apart.
    """
    kept = [p for p in polygons if len(p.edges)]
    if not kept:
        return np.empty((0, 4)), np.empty(0, bool)
    boxes = np.array([p.box for p in kept])
    single = np.array([len(p.rings) == 1 for p in kept])
    alone = single.copy()
    for a, b in _near_pairs(boxes):  # a box is as good as an edge from corner to corner
        alone[a] = alone[b] = False
    whole, leads = [], []
    for k in np.flatnonzero(alone):
        if kept[k].positive:
            parts, _ = _clipped(kept[k].edges, window)
            whole.append(parts)
            leads.append(np.arange(len(parts)) == 0)
    entangled = [kept[k] for k in np.flatnonzero(~alone)]
    if entangled:
        edges, _ = _clipped(np.vstack([p.edges for p in entangled]), window)
        edges = edges[(edges[:, 0] != edges[:, 2]) | (edges[:, 1] != edges[:, 3])]
        cut = _split(edges)
        turned = (cut[:, 0] > cut[:, 2]) | ((cut[:, 0] == cut[:, 2]) & (cut[:, 1] > cut[:, 3]))
        cut[turned] = cut[turned][:, [2, 3, 0, 1]]  # one direction, so that shared pieces count once
        cut = cut[np.unique(np.round(cut, 12), axis=0, return_index=True)[1]]
        d = cut[:, 2:] - cut[:, :2]
        length = np.hypot(d[:, 0], d[:, 1])
        cut, d, length = cut[length > 1e-12], d[length > 1e-12], length[length > 1e-12]
        middle = (cut[:, :2] + cut[:, 2:]) / 2
        normal = np.column_stack([-d[:, 1], d[:, 0]]) / length[:, None] * SIDE_MM
        cut = cut[is_copper(middle + normal, entangled) != is_copper(middle - normal, entangled)]
        whole.append(cut)
        leads.append(_chain_leads(cut))
    if not whole:
        return np.empty((0, 4)), np.empty(0, bool)
    edges, lead = np.vstack(whole), np.concatenate(leads)
    real = (edges[:, 0] != edges[:, 2]) | (edges[:, 1] != edges[:, 3])
    return edges[real], lead[real]


def surviving_edges(polygons: Sequence[Polygon], window: Window | None = None) -> np.ndarray:
    """x1, y1, x2, y2 of the pieces (within a window) that separate copper from none."""
    return traced_edges(polygons, window)[0]


Gap = tuple[float, float, float, float, float]  # the distance, and the nearest points of both sides


def _point_gaps(x: np.ndarray, y: np.ndarray, e: np.ndarray) -> Gap:
    """Least distance of points from edges, the point and the place on the edge."""
    dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
    px, py = x[:, None] - e[:, 0], y[:, None] - e[:, 1]
    square = dx * dx + dy * dy
    t = np.clip((px * dx + py * dy) / np.where(square > 0, square, 1.0), 0.0, 1.0)
    far = (px - t * dx) ** 2 + (py - t * dy) ** 2
    i, j = np.unravel_index(int(far.argmin()), far.shape)
    return float(np.sqrt(far[i, j])), float(x[i]), float(y[i]), float(e[j, 0] + t[i, j] * dx[j]), float(e[j, 1] + t[i, j] * dy[j])


def _crossing(a: np.ndarray, b: np.ndarray) -> tuple[float, float] | None:
    """A point where an edge of one crosses an edge of the other."""
    side = lambda e, x, y: (e[:, 2] - e[:, 0])[:, None] * (y - e[:, 1][:, None]) - (e[:, 3] - e[:, 1])[:, None] * (x - e[:, 0][:, None])
    first, last = side(a, b[:, 0], b[:, 1]), side(a, b[:, 2], b[:, 3])
    apart = first * last < 0
    if not apart.any():
        return None
    apart &= (side(b, a[:, 0], a[:, 1]) * side(b, a[:, 2], a[:, 3]) < 0).T
    if not apart.any():
        return None
    i, j = np.argwhere(apart)[0]
    t = first[i, j] / (first[i, j] - last[i, j])
    return float(b[j, 0] + t * (b[j, 2] - b[j, 0])), float(b[j, 1] + t * (b[j, 3] - b[j, 1]))


def _edges_box(e: np.ndarray) -> tuple[float, float, float, float]:
    return e[:, 0::2].min(), e[:, 1::2].min(), e[:, 0::2].max(), e[:, 1::2].max()


NOWHERE: Gap = (np.inf, np.nan, np.nan, np.nan, np.nan)


def nearest_edges(a: np.ndarray, b: np.ndarray, best: Gap = NOWHERE) -> Gap:
    """Least distance of two sets of edges (x1, y1, x2, y2) with the points, 0 where they cross, or `best` if that is less.

    Halves the larger set until few are left, the nearer half first; what lies
    further apart by its bounds than the best so far is left out.
    """
    p, q = _edges_box(a), _edges_box(b)
    if np.hypot(max(p[0] - q[2], q[0] - p[2], 0.0), max(p[1] - q[3], q[1] - p[3], 0.0)) >= best[0]:
        return best
    if len(a) * len(b) <= LEAF_PAIRS:
        at = _crossing(a, b)
        if at is not None:
            return (0.0, *at, *at)
        found = [best]
        for k in (0, 2):
            found.append(_point_gaps(a[:, k], a[:, k + 1], b))
            gap, bx, by, ax, ay = _point_gaps(b[:, k], b[:, k + 1], a)
            found.append((gap, ax, ay, bx, by))
        return min(found, key=lambda f: f[0])
    if len(a) < len(b):
        gap, bx, by, ax, ay = nearest_edges(b, a, (best[0], *best[3:], *best[1:3]))
        return gap, ax, ay, bx, by
    axis = 0 if p[2] - p[0] >= p[3] - p[1] else 1
    order = np.argsort(a[:, axis] + a[:, axis + 2], kind="stable")
    halves = [a[order[: len(a) // 2]], a[order[len(a) // 2 :]]]
    if q[axis] + q[axis + 2] > p[axis] + p[axis + 2]:
        halves.reverse()
    for half in halves:
        best = nearest_edges(half, b, best)
    return best


def edge_gap(a: np.ndarray, b: np.ndarray, best: float = np.inf) -> float:
    """Least distance of two sets of edges, or `best` if that is less."""
    return nearest_edges(a, b, (best, *NOWHERE[1:]))[0]


# ---------------------------------------------------------------- DataFrames


def with_polygons(features: DataFrame, resolution: int = RESOLUTION) -> DataFrame:
    """Features with `shape` or `rings`, feature_index and polarity get `polygon` and its bounds; others a null one."""
    has_rings = "rings" in features.columns
    given = features if has_rings else features.withColumn("rings", F.lit(None).cast("array<struct<marker:string,pts:array<struct<x:double,y:double>>>>"))
    marked = F.exists("rings", lambda r: r["marker"] == "I")
    hole = lambda r, k: (r["marker"] == "H") | (~r["marker"].isin("I", "H") & (k > 0) & ~marked)
    islands = F.transform("rings", lambda r, k: F.struct(F.coalesce(hole(r, k), F.lit(False)).alias("hole"), F.transform(r["pts"], lambda p: p["x"]).alias("xs"), F.transform(r["pts"], lambda p: p["y"]).alias("ys")))
    corners = {n: F.array(*[F.struct(*[F.lit(float(v)).alias(c) for v, c in zip(turn, "uvab")]) for turn in _turns(n)]) for n in (0, resolution)}
    box = F.col("shape")

    def edge(axis: int) -> Column:
        def place(t: Column) -> Column:
            px, py = t["u"] * box["hx"] + box["r"] * t["a"], t["v"] * box["hy"] + box["r"] * t["b"]
            return box["cx"] + px * box["c"] - py * box["s"] if axis == 0 else box["cy"] + px * box["s"] + py * box["c"]

        return F.when(box["r"] > 0, F.transform(corners[resolution], place)).otherwise(F.transform(corners[0], place))

    ring = F.array(F.struct(F.lit(False).alias("hole"), edge(0).alias("xs"), edge(1).alias("ys")))
    rings = F.when(F.size("rings") > 0, islands).when(box.isNotNull(), ring)
    positive = F.coalesce(F.upper(F.trim("polarity")) == "P", F.lit(False))
    whole = F.struct(F.col("feature_index").alias("idx"), positive.alias("positive"), F.col("__rings").alias("rings"))
    done = settle(settle(given, __rings=rings), polygon=F.when(F.col("__rings").isNotNull(), whole)).drop("__rings")
    return done if has_rings else done.drop("rings")


def _extent(polygon: Column) -> list[Column]:
    xs = F.flatten(F.transform(polygon["rings"], lambda r: r["xs"]))
    ys = F.flatten(F.transform(polygon["rings"], lambda r: r["ys"]))
    return [F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")]


def net_polygons(features: DataFrame, scope: Sequence[str], *, include_no_net: bool = False, cell_mm: float = GRID_MM) -> DataFrame:
    """(scope, net, gx, gy, polygons, x0, y0, x1, y1): in each cell of a grid each net's positives and all cuts there, and the positives' bounds.

    Positives without a net are left out unless wanted. A row holds what reaches
    into one cell, so a net that holds most of a layer is in as many rows as it
    touches cells.
    """
    drawn = with_polygons(features).filter("polygon is not null")
    drawn = drawn.select(*scope, F.coalesce("net_name", F.lit("$NONE$")).alias("net"), "polygon").select("*", *_extent(F.col("polygon"))).filter("x0 is not null")
    if not include_no_net:
        drawn = drawn.filter("net <> '$NONE$' or not polygon.positive")
    cell = lambda low, high: F.explode(F.sequence(F.floor((F.col(low) - SIDE_MM) / cell_mm).cast("int"), F.floor((F.col(high) + SIDE_MM) / cell_mm).cast("int")))
    drawn = drawn.withColumn("gx", cell("x0", "x1")).withColumn("gy", cell("y0", "y1"))
    at = [*scope, "gx", "gy"]
    nets = drawn.filter("polygon.positive").groupBy(*at, "net").agg(F.collect_list("polygon").alias("own"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    cuts = drawn.filter("not polygon.positive").groupBy(*at).agg(F.collect_list("polygon").alias("cuts"))
    whole = nets.join(cuts, at, "left")
    return whole.select(*at, "net", F.concat("own", F.coalesce("cuts", F.array().cast(f"array<{POLYGON}>"))).alias("polygons"), "x0", "y0", "x1", "y1", F.lit(float(cell_mm)).alias("cell_mm"))


def _read(items) -> list[Polygon]:
    return [Polygon(p["idx"], p["positive"], [(r["hole"], r["xs"], r["ys"]) for r in p["rings"]]) for p in items]


def net_traces(nets: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(scope, net, gx, gy, ends, leads, x0, y0, x1, y1): the pieces of each net's edges in each cell.

    `ends` holds x1, y1, x2, y2 of piece after piece, `leads` the place of one
    piece of each chain, the rest the bounds of the pieces.
    """
    at = [*scope, "net", "gx", "gy"]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nets.select(*at).schema)

    def traced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept, out, n = [], [], 0
            for k, (polygons, w, x, y) in enumerate(zip(batch["polygons"], batch["cell_mm"], batch["gx"], batch["gy"])):
                e, lead = traced_edges(_read(polygons), (x * w, y * w, (x + 1) * w, (y + 1) * w))
                if len(e):
                    kept.append(k)
                    out.append((e.ravel(), np.flatnonzero(lead).astype(np.int32), *_edges_box(e)))
                    n += len(e)
                if out and (n > MOST_PIECES or k == len(batch) - 1):
                    found = pd.DataFrame(out, columns=["ends", "leads", "x0", "y0", "x1", "y1"])
                    yield pd.concat([batch[at].iloc[kept].reset_index(drop=True), found], axis=1)
                    kept, out, n = [], [], 0

    return nets.mapInPandas(traced, f"{types}, ends array<double>, leads array<int>, x0 double, y0 double, x1 double, y1 double")


def _piece(place: Column) -> list[Column]:
    return [F.get("ends", place * 4 + k) for k in range(4)]


def traced_pieces(traces: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(scope, net_name, gx, gy, shape) of every piece of `net_traces`, as boxes without width."""
    places = F.explode(F.sequence(F.lit(0), (F.size("ends") / 4).cast("int") - 1))
    numbered = traces.filter(F.size("ends") > 0).select(*scope, F.col("net").alias("net_name"), "gx", "gy", "ends", places.alias("k"))
    pieces = settle(numbered, **{c: v for c, v in zip(("ax", "ay", "bx", "by"), _piece(F.col("k")))}).drop("ends", "k")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    length = F.sqrt(dx * dx + dy * dy)
    shape = F.struct(
        ((F.col("ax") + F.col("bx")) / 2).alias("cx"), ((F.col("ay") + F.col("by")) / 2).alias("cy"), (length / 2).alias("hx"), F.lit(0.0).alias("hy"), (dx / length).alias("c"), (dy / length).alias("s"), F.lit(0.0).alias("r")
    )
    return pieces.select(*scope, "net_name", "gx", "gy", shape.alias("shape"))


def net_edges(nets: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(scope, net_name, gx, gy, shape) of every piece of the nets' edges."""
    return traced_pieces(net_traces(nets, scope), scope)


def close_traces(traces: DataFrame, threshold_mm: float, scope: Sequence[str], *, cell_mm: float = GRID_MM) -> DataFrame:
    """(scope, net_a, net_b, clearance_mm, nearest points) of traces of different nets nearer than the threshold.

    Traces meet by grid cell if their bounds, widened by half the threshold, do; a
    pair that shares several cells is kept in the one that holds the lower left
    corner of the overlap of their bounds. Each pair is measured at once.
    """
    s, half = list(scope), threshold_mm / 2
    cell_mm = max(cell_mm, threshold_mm)
    boxed = traces.select(*s, "net", "ends", (F.col("x0") - half).alias("x0"), (F.col("y0") - half).alias("y0"), (F.col("x1") + half).alias("x1"), (F.col("y1") + half).alias("y1"))
    cell = lambda v: F.floor(F.col(v) / cell_mm).cast("int")
    entered = boxed.withColumn("cx", F.explode(F.sequence(cell("x0"), cell("x1")))).withColumn("cy", F.explode(F.sequence(cell("y0"), cell("y1"))))
    a, b = (entered.select(*s, "cx", "cy", *[F.col(c).alias(f"{n}_{c}") for c in ("net", "ends", "x0", "y0", "x1", "y1")]) for n in "ab")
    met = a.join(b, [*s, "cx", "cy"]).filter("a_net < b_net and a_x0 <= b_x1 and b_x0 <= a_x1 and a_y0 <= b_y1 and b_y0 <= a_y1")
    corner = (F.floor(F.greatest("a_x0", "b_x0") / cell_mm) == F.col("cx")) & (F.floor(F.greatest("a_y0", "b_y0") / cell_mm) == F.col("cy"))
    work = met.filter(corner).select(*s, F.col("a_net").alias("net_a"), F.col("b_net").alias("net_b"), "a_ends", "b_ends")
    keys = [*s, "net_a", "net_b"]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in work.select(*keys).schema)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            gaps = [nearest_edges(np.reshape(p, (-1, 4)), np.reshape(q, (-1, 4)), (threshold_mm, *NOWHERE[1:])) for p, q in zip(batch["a_ends"], batch["b_ends"])]
            found = pd.DataFrame(gaps, columns=["clearance_mm", *POINTS], index=batch.index, dtype=float)
            out = pd.concat([batch[keys], found], axis=1)
            yield out[out["clearance_mm"] < threshold_mm]

    near = work.mapInPandas(measured, f"{types}, clearance_mm double, " + ", ".join(f"{p} double" for p in POINTS))
    return least_gaps(near, s)


def enclosed_nets(nets: DataFrame, traces: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(scope, net_a, net_b, x, y) of nets of which one has an edge within the copper of the other, and where.

    One point of each chain of edges in a cell is asked for, against the nets
    whose copper reaches into the same cell; copper that only touches is found by
    the distance of edges.
    """
    s = list(scope)
    at = [*s, "gx", "gy"]
    ax, ay, bx, by = _piece(F.col("lead"))
    leads = traces.select(*at, F.col("net").alias("guest"), "ends", F.explode("leads").alias("lead"))
    points = leads.select(*at, "guest", F.struct(((ax + bx) / 2).alias("x"), ((ay + by) / 2).alias("y")).alias("p"))
    hosts = nets.select(*at, F.col("net").alias("host"), "x0", "y0", "x1", "y1")
    asked = points.join(hosts, at).filter("guest <> host and p.x between x0 and x1 and p.y between y0 and y1")
    lists = asked.groupBy(*at, "host").agg(F.collect_list(F.struct("guest", "p")).alias("guests"))
    work = nets.select(*at, F.col("net").alias("host"), "polygons").join(lists, [*at, "host"])
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nets.select(*s).schema)

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                spots = np.array([(g["p"]["x"], g["p"]["y"]) for g in row["guests"]])
                inside = is_copper(spots, _read(row["polygons"]))
                first = {g["guest"]: (x, y) for g, hit, (x, y) in zip(reversed(row["guests"]), inside[::-1], spots[::-1].tolist()) if hit}
                out += [(*[row[c] for c in s], *sorted((row["host"], g)), x, y) for g, (x, y) in first.items()]
            yield pd.DataFrame(out, columns=[*s, "net_a", "net_b", "x", "y"], dtype=object).astype({"x": float, "y": float})

    found = work.mapInPandas(judged, f"{types}, net_a string, net_b string, x double, y double")
    return found.groupBy(*s, "net_a", "net_b").agg(F.min(F.struct("x", "y")).alias("p")).select(*s, "net_a", "net_b", "p.x", "p.y")


def all_edge_pairs(edges: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(scope, net_a, net_b, clearance_mm, nearest points) of every pair of nets of a scope, by the distance of their edges.

    A net's edges are parted by cells of `PART_MM`; the parts of a scope are dealt
    into blocks, and each pair of blocks is a group, so a task holds two blocks'
    edges. Parts whose bounds lie further apart than the nearest edges found for
    their nets are not looked at.
    """
    s = list(scope)
    e = F.col("shape")
    ends = F.array(e["cx"] - e["hx"] * e["c"], e["cy"] - e["hx"] * e["s"], e["cx"] + e["hx"] * e["c"], e["cy"] + e["hx"] * e["s"])
    part = [F.floor(e[c] / PART_MM).alias(f"p{c}") for c in ("cx", "cy")]
    parts = edges.select(*s, F.col("net_name").alias("net"), *part, ends.alias("ends")).groupBy(*s, "net", "pcx", "pcy").agg(F.flatten(F.collect_list("ends")).alias("ends"))
    sizes = parts.groupBy(*s).agg(F.ceil(F.greatest(F.sum(F.size("ends")) / (4 * BLOCK_EDGES), F.count("*") / BLOCK_NETS)).cast("int").alias("blocks"))
    dealt = join_few(parts, sizes, s, "inner", spread=["net"]).withColumn("own", F.pmod(F.xxhash64("net", "pcx", "pcy"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(*s, "net", "ends", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in edges.select(*s).schema)

    def measured(block: pd.DataFrame) -> pd.DataFrame:
        same = block["low"].iloc[0] == block["high"].iloc[0]
        parts = [np.asarray(x, float).reshape(-1, 4) for x in block["ends"]]
        boxes = np.array([_edges_box(x) for x in parts])
        nets, own = block["net"].to_numpy(), block["own"].to_numpy()
        i, j = np.triu_indices(len(parts), 1)
        wanted = (nets[i] != nets[j]) & (same | (own[i] != own[j]))
        i, j = i[wanted], j[wanted]
        apart = np.hypot(np.maximum(np.maximum(boxes[i, 0] - boxes[j, 2], boxes[j, 0] - boxes[i, 2]), 0), np.maximum(np.maximum(boxes[i, 1] - boxes[j, 3], boxes[j, 1] - boxes[i, 3]), 0))
        best: dict[tuple[str, str], Gap] = {}
        for k in np.argsort(apart, kind="stable"):
            a, b = (i[k], j[k]) if nets[i[k]] < nets[j[k]] else (j[k], i[k])
            pair = nets[a], nets[b]
            best[pair] = nearest_edges(parts[a], parts[b], best.get(pair, NOWHERE))
        frame = pd.DataFrame([(*pair, *gap) for pair, gap in best.items()], columns=["net_a", "net_b", "clearance_mm", *POINTS])
        for k, c in enumerate(s):
            frame.insert(k, c, block[c].iloc[0])
        return frame

    every = met.groupBy(*s, "low", "high").applyInPandas(measured, f"{types}, net_a string, net_b string, clearance_mm double, " + ", ".join(f"{p} double" for p in POINTS))
    return least_gaps(every, s)


def least_gaps(pairs: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Of each pair of nets the row of least clearance, ties by the points."""
    least = pairs.groupBy(*scope, "net_a", "net_b").agg(F.min(F.struct("clearance_mm", *POINTS)).alias("m"))
    return least.select(*scope, "net_a", "net_b", "m.*")


def composited_pairs(features: DataFrame, threshold_mm: float | None, scope: Sequence[str], *, include_no_net: bool = False) -> DataFrame:
    """(scope, net_a, net_b, clearance_mm, x_a_mm, y_a_mm, x_b_mm, y_b_mm) below the threshold between nets as drawn in order, cuts included.

    Without a threshold every pair of nets of a scope. Features need a `shape` (or
    rings), feature_index, polarity and net_name. Curves are chains of chords, so
    distances may exceed the exact ones by up to 0.0012 of the radii. The points
    are the nearest ones; of several equally near any.
    """
    from ..session import cut_lineage

    nets = cut_lineage(net_polygons(features, scope, include_no_net=include_no_net))
    traces = cut_lineage(net_traces(nets, scope))
    near = all_edge_pairs(traced_pieces(traces, scope), scope) if threshold_mm is None else close_traces(traces, threshold_mm, scope)
    inside = enclosed_nets(nets, traces, scope).select(*scope, "net_a", "net_b", F.lit(0.0).alias("clearance_mm"), *[F.col(c).alias(p) for c, p in zip("xyxy", POINTS)])
    return least_gaps(near.unionByName(inside), scope)
