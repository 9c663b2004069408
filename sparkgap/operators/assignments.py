"""Stored assignments: merges, reviews, differences and a change log, as plain relational steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..vocabulary import CONFIDENCES, NET_CLASSES, REVIEW_STATES, SEVERITIES

# Sources that detection must not overwrite; states and severities that call for a review.
KEPT_SOURCES = ("manual", "imported_exact", "imported_case_insensitive", "imported_normalized", "imported_manual_mapping")
OPEN_STATES = ("Needs review", "Conflict", "Auto-guessed")
CLOSED_STATES = ("Approved", "Reviewed", "Accepted unknown", "Waived")
SEVERE = ("Warning", "Critical")


def needs_review(state: Column, severity: Column, waived: Column | None = None) -> Column:
    """Open states always; else severe ones that are neither waived nor closed."""
    waived = F.coalesce(waived, F.lit(False)) if waived is not None else F.lit(False)
    severe = F.coalesce(severity.isin(*SEVERE), F.lit(False)) & ~F.coalesce(state.isin(*CLOSED_STATES), F.lit(False))
    return F.coalesce(state.isin(*OPEN_STATES), F.lit(False)) | (~waived & severe)


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "Critical", 0).when(severity == "Warning", 1).when(severity == "Review", 2).when(severity == "Info", 3).otherwise(4)


def review_counts(assignments: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Counts for a gate: open, open critical, open warning, conflicts, waived."""
    open_ = needs_review(F.col("review_state"), F.col("severity"))
    counts = [
        F.count_if(open_).alias("needs_review"),
        F.count_if(open_ & (F.col("severity") == "Critical")).alias("unreviewed_critical"),
        F.count_if(open_ & (F.col("severity") == "Warning")).alias("unreviewed_warning"),
        F.count_if(F.col("review_state") == "Conflict").alias("conflicts"),
        F.count_if(F.col("review_state") == "Waived").alias("waived"),
    ]
    return assignments.groupBy(*scope).agg(*counts) if scope else assignments.agg(*counts)


def last_of_each(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of each key the first row in `order`."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def merge_detected(stored: DataFrame, detected: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Stored rows with detected ones laid over them; kept sources stay; `changed` marks what differs.

    Both have `keys`, `values` and source, unique by key. Stored rows that
    weren't detected stay. One full outer join.
    """
    a, b = stored.alias("a"), detected.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    has_a, has_b = F.col("a.__here").isNotNull(), F.col("b.__here").isNotNull()
    joined = stored.withColumn("__here", F.lit(1)).alias("a").join(detected.withColumn("__here", F.lit(1)).alias("b"), on, "full_outer")
    take_new = has_b & ~(has_a & F.coalesce(F.col("a.source").isin(*KEPT_SOURCES), F.lit(False)))
    same = F.lit(True)
    for v in (*values, "source"):
        same = same & F.col(f"a.{v}").eqNullSafe(F.col(f"b.{v}"))
    columns = [F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys]
    columns += [F.when(take_new, F.col(f"b.{v}")).otherwise(F.col(f"a.{v}")).alias(v) for v in (*values, "source")]
    del a, b
    return joined.select(*columns, (take_new & ~(has_a & same)).alias("changed"))


def assignment_difference(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """added, deleted, voltage_changed, class_changed, review_state_changed or unchanged, by key.

    Both are unique by key. Voltages differ if exactly one is null or NaN, or if
    they are unequal.
    """
    fields = ("final_class", "final_voltage_v", "review_state")
    left = old.select(*keys, *[F.col(f).alias(f"old_{f}") for f in fields], F.lit(1).alias("__old"))
    right = new.select(*keys, *[F.col(f).alias(f"new_{f}") for f in fields], F.lit(1).alias("__new"))
    both = left.join(right, list(keys), "full_outer")
    real = lambda c: F.when(~F.isnan(c), F.col(c))
    kind = (
        F.when(F.col("__old").isNull(), "added")
        .when(F.col("__new").isNull(), "deleted")
        .when(~real("old_final_voltage_v").eqNullSafe(real("new_final_voltage_v")), "voltage_changed")
        .when(~F.col("old_final_class").eqNullSafe(F.col("new_final_class")), "class_changed")
        .when(~F.col("old_review_state").eqNullSafe(F.col("new_review_state")), "review_state_changed")
        .otherwise("unchanged")
    )
    return both.withColumn("category", kind).drop("__old", "__new")


def batch_preview(assignments: DataFrame, operation: str, *, final_class: str | None = None, final_voltage_v: float | None = None) -> DataFrame:
    """What a batch operation would do to each row, and whether it is blocked; nothing is changed.

    approve (blocked for severe rows), accept_unknown, set_class_voltage or waive;
    anything else blocks every row.
    """
    state, same_class, same_volts = F.col("review_state"), F.col("final_class"), F.col("final_voltage_v")
    blocked, new_class, new_volts, new_state = F.lit(False), same_class, same_volts, state
    if operation == "approve":
        blocked = F.coalesce(F.col("severity").isin(*SEVERE), F.lit(False))
        new_state = F.when(blocked, state).otherwise("Approved")
    elif operation == "accept_unknown":
        new_class, new_volts, new_state = F.lit("UNKNOWN"), F.lit(None).cast("double"), F.lit("Accepted unknown")
    elif operation == "set_class_voltage":
        new_class = F.lit(final_class) if final_class else same_class
        new_volts, new_state = F.lit(final_voltage_v).cast("double"), F.lit("Reviewed")
    elif operation == "waive":
        new_state = F.lit("Waived")
    else:
        blocked = F.lit(True)
    return assignments.withColumns({"new_class": new_class, "new_voltage_v": new_volts, "new_review_state": new_state, "blocked": blocked})


def validity_problem(row: str = "") -> Column:
    """The first column of an imported assignment whose value is not allowed; null if all are."""
    at = lambda c: F.coalesce(F.col(f"{row}{c}"), F.lit(""))
    return (
        F.when(~at("final_class").isin(*NET_CLASSES), "final_class")
        .when(~at("confidence").isin(*CONFIDENCES), "confidence")
        .when(~at("severity").isin(*SEVERITIES), "severity")
        .when(~at("review_state").isin(*REVIEW_STATES), "review_state")
    )


def replay(base: DataFrame, log: DataFrame, keys: Sequence[str], values: Sequence[str], *, upto: int | None = None) -> DataFrame:
    """A store's state: the base with a change log (seq, keys, values, deleted) laid over it.

    Of each key the entry with the highest seq (not beyond `upto`) counts, which
    also makes undoing the last operations a matter of `upto`.
    """
    used = log if upto is None else log.filter(F.col("seq") <= upto)
    entries = base.select(*keys, *values, F.lit(-1).cast("long").alias("seq"), F.lit(False).alias("deleted")).unionByName(
        used.select(*keys, *values, F.col("seq").cast("long"), F.coalesce("deleted", F.lit(False)).alias("deleted"))
    )
    newest = entries.groupBy(*keys).agg(F.max(F.struct("seq", "deleted", *values)).alias("e"))
    return newest.filter("not e.deleted").select(*keys, *[F.col(f"e.{v}").alias(v) for v in values])
