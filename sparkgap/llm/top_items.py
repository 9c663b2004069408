"""The N best items of each of very many groups, by a threshold from score histograms.

A histogram per group (logarithmic bins, counted with map-side combine) gives the
bin up to which at least N items lie; where that bin alone holds many rows, its
own rows are counted once more into finer bins. Rows beyond the threshold cannot
be among the N best and are dropped before the exact ranking, so a group of any
size sends little more than N rows to its ranking task. Groups too small to lose
rows that way (`WORTHWHILE` times N) are ranked whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..tables import join_few

BROADCAST_GROUPS = 50_000  # a row of keys and a bin each: a few MB
WORTHWHILE = 8  # a group of fewer than so many times N rows has no histogram
CROWDED = 64  # a bin at the threshold with more than so many times N rows is refined
BINS, FINER = 3, 10  # bits: 8 bins a doubling, 1,024 finer ones in each
LOWEST, HIGHEST = -1075 << (BINS + FINER), 1025 << (BINS + FINER)


def score_place(score: Column) -> Column:
    """A whole number that never falls as the score rises, over all doubles but NaN.

    Beyond the sign it is the logarithm in finer bins; 0 and -0 are the same.
    """
    log = F.floor(F.greatest(F.lit(float(LOWEST)), F.least(F.lit(float(HIGHEST)), F.log2(F.abs(score)) * (1 << (BINS + FINER)))))
    size = (log - LOWEST + 1).cast("bigint")
    return F.when(score == 0, F.lit(0).cast("bigint")).when(score > 0, size).otherwise(-size)


def score_bin(score: Column) -> Column:
    """The bin of a score: its place without the finer bits."""
    return F.shiftright(score_place(score), FINER)


def _joined(rows: DataFrame, few: DataFrame, keys: list[str], how: str, spread: list[str]) -> DataFrame:
    """`rows` with a row per group: broadcast up to `BROADCAST_GROUPS` groups, else salted, so that no group ends in one task."""
    return join_few(rows, few, keys, how, spread=spread, null_safe=True, most=BROADCAST_GROUPS)


def _running(counts: DataFrame, keys: list[str], bin_: str) -> DataFrame:
    """`counts` with __upto: how many rows of the group lie in this bin or before."""
    return counts.withColumn("__upto", F.sum("__c").over(Window.partitionBy(*keys).orderBy(bin_).rowsBetween(Window.unboundedPreceding, 0)))


def group_thresholds(placed: DataFrame, keys: list[str], n: int, small: int, spread: list[str]) -> tuple[DataFrame, int]:
    """(keys, __limit) and its number of rows: the place up to which a group of more than `small` rows has at least `n`.

    One row per such group, written to the checkpoint folder.
    """
    large = cut_lineage(placed.groupBy(*keys).agg(F.count("*").alias("__all")).filter(F.col("__all") > small).select(*keys))
    n_large = large.count()
    bin_ = F.shiftright("__place", FINER)
    counts = _joined(placed, large, keys, "inner", spread).groupBy(*keys, bin_.alias("__bin")).agg(F.count("*").alias("__c"))
    reached = _running(counts, keys, "__bin").filter(F.col("__upto") >= n)
    edge = cut_lineage(reached.groupBy(*keys).agg(F.min_by(F.struct("__bin", "__c", (F.col("__upto") - F.col("__c")).alias("before")), "__bin").alias("e")).select(*keys, "e.*"))
    crowded = edge.filter(F.col("__c") > CROWDED * n)
    whole = edge.filter(F.col("__c") <= CROWDED * n).select(*keys, (F.shiftleft(F.col("__bin") + 1, FINER) - 1).alias("__limit"))
    at_edge = _joined(placed, crowded.select(*keys, "__bin", "before"), keys, "inner", spread).filter(bin_ == F.col("__bin"))
    finer = at_edge.groupBy(*keys, "__place").agg(F.count("*").alias("__c"), F.min("before").alias("before"))
    refined = _running(finer, keys, "__place").filter(F.col("before") + F.col("__upto") >= n).groupBy(*keys).agg(F.min("__place").alias("__limit"))
    return cut_lineage(whole.unionByName(refined)), n_large


def top_items(rows: DataFrame, keys: list[str], score: str, ties: list[str], n: int, *, largest: bool = False, small: int | None = None) -> DataFrame:
    """The `n` rows of lowest (or `largest`) `score` in each group, with `pos` from 1; ties in the order of `ties`.

    Null and NaN scores don't count. Null keys form groups of their own. Nulls in
    tie columns come last; rows equal in everything named are taken in any order,
    as they are alike. Repeated rows count as often as they occur. `rows` is read
    several times, so it should be kept. Groups of up to `small` rows (by default
    `WORTHWHILE` times `n`) are ranked whole. A column named like an inner one
    (`__place`, `__limit`) or `pos` is replaced.
    """
    small = WORTHWHILE * n if small is None else max(small, n)
    place = score_place(F.col(score))
    placed = rows.filter(F.col(score).isNotNull() & ~F.isnan(score)).withColumn("__place", -place if largest else place)
    limits, _ = group_thresholds(placed, keys, n, small, [score, *ties])
    survivors = _joined(placed, limits, keys, "left", [score, *ties]).filter(F.col("__limit").isNull() | (F.col("__place") <= F.col("__limit")))
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc() if largest else F.col(score).asc(), *[F.col(t).asc_nulls_last() for t in ties])
    return survivors.drop("__place", "__limit").withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= n)


def latest_deliveries(rows: DataFrame, row_id: str, loaded_at: str, ties: list[str]) -> DataFrame:
    """Of each id the row delivered last; rows without an id stay, each by itself.

    Equal delivery times are settled by `ties`, ascending, so the answer is fixed.
    """
    order = Window.partitionBy(row_id).orderBy(F.col(loaded_at).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties])
    known = rows.filter(F.col(row_id).isNotNull()).withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")
    return known.unionByName(rows.filter(F.col(row_id).isNull()))


def closest_measurements(measurements: DataFrame, n: int = 3) -> DataFrame:
    """The `n` smallest clearances of each job, layer (trimmed, upper case) and net_a.

    Only the last delivery of a measurement counts, and only if its clearance is
    a number of at least 0; ties by net_b, then measurement_id.
    """
    used = measurements.select("measurement_id", "job_id", F.upper(F.trim("layer")).alias("layer"), "net_a", "net_b", "clearance_mm", "loaded_at")
    last = latest_deliveries(used, "measurement_id", "loaded_at", ["clearance_mm", "net_b", "job_id", "layer", "net_a"]).drop("loaded_at")
    valid = last.filter(F.col("clearance_mm").isNotNull() & ~F.isnan("clearance_mm") & (F.col("clearance_mm") >= 0))
    return top_items(cut_lineage(valid), ["job_id", "layer", "net_a"], "clearance_mm", ["net_b", "measurement_id"], n)
