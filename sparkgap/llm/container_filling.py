"""Filling containers of fixed capacity with items of varying length.

A linear grouping scheme: large items are sorted and cut into groups of equal
cardinality, each rounded up to its largest length, so that few sizes remain; for
those, the cheapest combination of configurations (how many of each size share a
container) is found by a linear program whose columns are generated by a
knapsack, and rounded down; what that leaves takes the best single
configurations. The slots are then given to actual items, which leaves extra
space where they are shorter than their group; small items go by best fit into
the space that is left.

The scheme runs in cells of bounded size: an item's cell is a hash of its id, and
the number of cells follows from the number of items. A cell wastes at most a
container or two at its end, which is little against the thousands it fills.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

CELL_ITEMS = 50_000
GROUPS = 40
LARGE_SHARE = 1 / 8


def best_configuration(sizes: Sequence[int], left: Sequence[int], capacity: int) -> list[int]:
    """How many of each size (at most `left`) fill a container best; ties prefer large sizes."""
    reach = np.full(capacity + 1, -1, dtype=np.int64)  # reach[c]: the size index that last led to the sum c
    reach[0] = len(sizes)
    steps: list[tuple[int, np.ndarray]] = []
    for k, size in enumerate(sizes):
        for _ in range(min(int(left[k]), capacity // size)):
            new = np.zeros(capacity + 1, bool)
            new[size:] = (reach[:-size] >= 0) & (reach[size:] < 0)
            if not new.any():
                break
            reach[new] = k
            steps.append((k, new))
    at = int(np.flatnonzero(reach >= 0)[-1])
    counts = [0] * len(sizes)
    for k, new in reversed(steps):
        if at and new[at]:
            counts[k] += 1
            at -= sizes[k]
    return counts


def _most_valuable(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of highest total value, repetition allowed."""
    layers = [np.zeros(capacity + 1)]
    picks: list[np.ndarray] = []
    for _ in range(capacity // int(sizes.min())):
        options = np.full((len(sizes) + 1, capacity + 1), -np.inf)
        options[0] = layers[-1]
        for k, size in enumerate(sizes):
            if values[k] > 0:
                options[k + 1, size:] = layers[-1][: capacity + 1 - size] + values[k]
        pick = options.argmax(axis=0)
        if not pick.any():
            break
        layers.append(options[pick, np.arange(capacity + 1)])
        picks.append(pick)
    counts, at = np.zeros(len(sizes)), capacity
    for pick in reversed(picks):
        k = pick[at]
        if k:
            counts[k - 1] += 1
            at -= int(sizes[k - 1])
    return float(layers[-1][capacity]), counts


def configuration_program(sizes: Sequence[int], demand: Sequence[int], capacity: int, *, most_rounds: int = 2_000) -> tuple[float, list[tuple[np.ndarray, float]]]:
    """The least number of containers (fractional) for `demand` items of each size, and how often each configuration is used.

    A linear program over all configurations, solved by the simplex method with
    generated columns: a column enters while the knapsack at the current prices
    finds a configuration worth more than the container it costs.
    """
    s, d = np.asarray(sizes, np.int64), np.asarray(demand, float)
    columns = np.diag((capacity // s).astype(float))
    inverse = np.diag(1.0 / (capacity // s))
    for _ in range(most_rounds):
        prices = inverse.sum(axis=0)
        value, entering = _most_valuable(s, prices, capacity)
        if value <= 1 + 1e-9:
            break
        use, direction = inverse @ d, inverse @ entering
        ratios = np.where(direction > 1e-12, use / np.where(direction > 1e-12, direction, 1.0), np.inf)
        leaving = int(ratios.argmin())
        columns[:, leaving] = entering
        pivot = inverse[leaving] / direction[leaving]
        inverse -= np.outer(direction, pivot)
        inverse[leaving] = pivot
    use = np.maximum(inverse @ d, 0.0)
    return float(use.sum()), [(columns[:, k].astype(int), float(use[k])) for k in range(len(s)) if use[k] > 1e-9]


def fill_containers(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The container (0, 1, ...) of each item; every length is within 1 and the capacity."""
    where = np.full(len(lengths), -1, dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    n_large = int((lengths > capacity * LARGE_SHARE).sum())
    large, small = order[:n_large], order[n_large:]
    space: list[int] = []
    if n_large:
        chunks = [c for c in np.array_split(large, min(GROUPS, n_large)) if len(c)]
        merged: dict[int, list[int]] = {}
        for chunk in chunks:  # equal cardinality; each rounded up to its first, the largest
            merged.setdefault(int(lengths[chunk[0]]), []).extend(chunk.tolist())
        sizes = sorted(merged, reverse=True)
        queues = [merged[s][::-1] for s in sizes]
        plan = [(counts.tolist(), int(times + 1e-9)) for counts, times in configuration_program(sizes, [len(q) for q in queues], capacity)[1]]
        while any(queues):
            left = [len(q) for q in queues]
            counts, times = plan.pop() if plan else (best_configuration(sizes, left, capacity), 1 << 60)
            times = min([times, *[left[k] // c for k, c in enumerate(counts) if c]])
            for _ in range(times):
                free = capacity
                for k, c in enumerate(counts):
                    for _ in range(c):
                        item = queues[k].pop()
                        where[item] = len(space)
                        free -= int(lengths[item])
                space.append(free)
    gaps = sorted((free, k) for k, free in enumerate(space) if free > 0)
    for item in small:
        need = int(lengths[item])
        at = bisect.bisect_left(gaps, (need, -1))
        if at < len(gaps):
            free, k = gaps.pop(at)
        else:
            free, k = capacity, len(space)
            space.append(capacity)
        where[item] = k
        if free > need:
            bisect.insort(gaps, (free - need, k))
    return where


def pack_documents(sizes: DataFrame, capacity: int = 2048, *, cell_items: int = CELL_ITEMS) -> DataFrame:
    """Where each document goes: (doc_id, part, n_parts, n_tokens, container_id, start).

    `sizes` has doc_id and n_tokens. Only documents longer than the capacity are
    split, into full parts and a rest. Documents without tokens need no space:
    their container_id is null. Every row of `sizes` is placed, also repeated
    ones; null ids share a cell by hash of their size. Container ids are unique.
    The table of sizes is written once to the checkpoint folder (16 bytes a row).
    """
    kept = cut_lineage(sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n")))
    n_parts = F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)).cast("int")
    pieces = kept.select("doc_id", "n", n_parts.alias("n_parts"), F.explode(F.sequence(F.lit(1), n_parts)).alias("part"))
    pieces = pieces.withColumn("n_tokens", F.least(F.lit(capacity), F.col("n") - (F.col("part") - 1) * capacity).cast("int")).drop("n")
    whole = pieces.filter((F.col("n_tokens") == capacity) | (F.col("n_tokens") <= 0))
    rest = pieces.filter((F.col("n_tokens") < capacity) & (F.col("n_tokens") > 0))
    n_cells = max(1, -(-rest.count() // cell_items))
    rest = rest.withColumn("cell", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("n_tokens"))), F.lit(n_cells)))

    def fill(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["n_tokens", "doc_id", "part"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        lengths = cell["n_tokens"].to_numpy(dtype=np.int64)
        cell["k"] = fill_containers(lengths, capacity)
        cell["start"] = cell.groupby("k")["n_tokens"].cumsum() - cell["n_tokens"]
        cell["container_id"] = cell["cell"].iloc[0] * (1 << 32) + cell["k"]
        return cell[["doc_id", "part", "n_parts", "n_tokens", "container_id", "start"]]

    schema = "doc_id bigint, part int, n_parts int, n_tokens int, container_id bigint, start int"
    packed = rest.groupBy("cell").applyInPandas(fill, schema)
    # a full container holds one piece; its id is negative, so it meets no cell's
    own = F.when(F.col("n_tokens") > 0, -1 - F.monotonically_increasing_id())
    return packed.unionByName(whole.select("doc_id", "part", "n_parts", "n_tokens", own.alias("container_id"), F.lit(0).alias("start")))


def packing_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: pieces, tokens, containers, the share of space that is filled, the fewest containers that could hold the tokens, and how many more are used."""
    used = packed.filter("container_id is not null")
    totals = used.agg(F.count("*").alias("n_pieces"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"), F.count_distinct("container_id").alias("n_containers"))
    totals = totals.withColumn("filled", F.col("n_tokens") / F.greatest(F.col("n_containers") * capacity, F.lit(1)))
    return totals.withColumn("fewest", F.ceil(F.col("n_tokens") / capacity)).withColumn("beyond_fewest", F.col("n_containers") - F.col("fewest"))
