"""What changed between consecutive full snapshots of a table.

Every row is the left side of one comparison (its revision with the next one
present) and the right side of another. The sides are range-partitioned and
sorted by (scope, revision, key), so that a merge with one cursor on each side
runs through every range once and holds one key at a time. Rows repeated within
a snapshot are dropped before, already on the map side, so that a name that most
rows repeat is no long stretch of one range; that exchange also spares the
sampling for the ranges from computing the keys again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.net_names import normal_name
from ..tables import join_few, settle

CHANGE_SCHEMA = (
    "project_id string, from_rev int, to_rev int, old_net string, new_net string, match_status string,"
    " changed_fields array<string>, old_row_id bigint, new_row_id bigint"
)
TOLERANCE = 1e-6


def zone_key(zone: Column) -> Column:
    """Zones count by number; null and blank are empty; other text by itself."""
    number = F.regexp_extract(zone, r"(\d+)", 1).try_cast("int").cast("string")
    return F.coalesce(number, F.lower(F.trim(zone)), F.lit(""))


def revision_sides(snapshots: DataFrame) -> DataFrame:
    """Each snapshot row once per comparison it takes part in, with its key and compared values."""
    revisions = snapshots.filter("rev_no is not null").select("project_id", "rev_no").distinct()
    order = Window.partitionBy("project_id").orderBy("rev_no")
    revisions = revisions.select(
        F.col("project_id").alias("__p"), F.col("rev_no").alias("__r"), F.lag("rev_no").over(order).alias("__before"), F.lead("rev_no").over(order).alias("__after")
    )
    key = F.coalesce(normal_name(F.col("net_name")), F.lit(""))
    compared = ["project_id", "rev_no", "net_name", "final_class", "final_voltage_v", "review_state", "galvanic_zone", "row_id", "loaded_at"]
    keyed = settle(snapshots.filter("rev_no is not null").select(*compared), key=key)
    newest = Window.partitionBy("project_id", "rev_no", "key").orderBy(F.col("loaded_at").desc_nulls_last(), F.col("row_id").desc_nulls_last())
    once = keyed.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n")
    rows = join_few(once, revisions, {"project_id": "__p", "rev_no": "__r"}, "inner", spread=["key"], null_safe=True)
    left = F.struct(F.col("rev_no").alias("a"), F.col("__after").alias("b"), F.lit(0).alias("side"))
    right = F.struct(F.col("__before").alias("a"), F.col("rev_no").alias("b"), F.lit(1).alias("side"))
    sides = F.filter(F.array(left, right), lambda s: s["a"].isNotNull() & s["b"].isNotNull())
    volts = F.when(~F.isnan("final_voltage_v"), F.col("final_voltage_v"))
    return rows.select(
        "project_id",
        F.explode(sides).alias("s"),
        "key",
        F.coalesce("net_name", F.lit("")).alias("net"),
        F.coalesce("final_class", F.lit("")).alias("final_class"),
        volts.alias("final_voltage_v"),
        F.coalesce("review_state", F.lit("")).alias("review_state"),
        zone_key(F.col("galvanic_zone")).alias("galvanic_zone"),
        F.col("row_id"),
        F.col("loaded_at"),
    ).select("project_id", F.col("s.a").alias("from_rev"), F.col("s.b").alias("to_rev"), F.col("s.side").alias("side"), "key", "net", "final_class", "final_voltage_v", "review_state", "galvanic_zone", "row_id", "loaded_at")


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """Changes of the whole keys in `rows`, which are sorted by scope, key and side."""
    starts = _starts(rows)
    key = np.cumsum(starts) - 1
    side = rows["side"].to_numpy()
    first = np.ones(len(rows), bool)
    first[1:] = starts[1:] | (side[1:] != side[:-1])
    n = int(key[-1]) + 1
    left, right = np.full(n, -1), np.full(n, -1)
    at = np.flatnonzero(first)
    left[key[at[side[at] == 0]]] = at[side[at] == 0]
    right[key[at[side[at] == 1]]] = at[side[at] == 1]
    both = (left >= 0) & (right >= 0)
    differs = {}
    for name in ("final_class", "review_state", "galvanic_zone", "net"):
        values = rows[name].to_numpy()
        differs[name] = both & (values[left] != values[right])
    volts = rows["final_voltage_v"].to_numpy(dtype=float, na_value=np.nan)
    old, new = volts[left], volts[right]
    with np.errstate(invalid="ignore"):
        same = (np.isnan(old) & np.isnan(new)) | (old == new) | (np.abs(old - new) <= TOLERANCE)
    differs["final_voltage_v"] = both & ~same
    compared = ("final_class", "final_voltage_v", "review_state", "galvanic_zone")
    changed = np.logical_or.reduce([differs[c] for c in compared])
    status = np.select([left < 0, right < 0, changed, differs["net"]], ["new", "missing", "changed", "respelled"], "").astype(object)
    kept = np.flatnonzero(status != "")
    l, r = left[kept], right[kept]  # noqa: E741
    some = np.where(l >= 0, l, r)
    names, ids = rows["net"].to_numpy(), rows["row_id"].to_numpy()
    return pd.DataFrame(
        {
            "project_id": rows["project_id"].to_numpy()[some],
            "from_rev": rows["from_rev"].to_numpy()[some],
            "to_rev": rows["to_rev"].to_numpy()[some],
            "old_net": np.where(l >= 0, names[l], ""),
            "new_net": np.where(r >= 0, names[r], ""),
            "match_status": status[kept],
            "changed_fields": pd.Series([[c for c in compared if differs[c][k]] for k in kept], dtype=object),
            "old_row_id": pd.Series([ids[x] if x >= 0 else None for x in l], dtype="Int64"),
            "new_row_id": pd.Series([ids[x] if x >= 0 else None for x in r], dtype="Int64"),
        }
    )


def _starts(rows: pd.DataFrame) -> np.ndarray:
    """Where another (scope, revision, key) begins."""
    out = np.ones(len(rows), bool)
    out[1:] = False
    for name in ("project_id", "from_rev", "key"):
        values = rows[name].to_numpy()
        out[1:] |= values[1:] != values[:-1]
    return out


def merge_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merge the sorted rows of one range; of the last key, what later batches may need is carried on."""
    carried: pd.DataFrame | None = None
    for batch in batches:
        if carried is not None:
            batch = pd.concat([carried, batch], ignore_index=True)
        if not len(batch):
            continue
        cut = int(np.flatnonzero(_starts(batch))[-1])
        if cut:
            yield _merged(batch.iloc[:cut].reset_index(drop=True))
        carried = batch.iloc[cut:].drop_duplicates("side")  # repeated rows: the first of each side counts
    if carried is not None and len(carried):
        yield _merged(carried.reset_index(drop=True))


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """Typed changes between each revision of a project and the next one present.

    `new`, `missing`, `changed` (with `changed_fields`) or `respelled`; unchanged
    keys give no row. Names are the same net if their normal names are equal; a
    null name is an empty one. Rows repeated within a snapshot count once: the
    latest by loaded_at, then row_id. Voltages within 1e-6 are equal, null is NaN;
    null classes, states and zones are empty. Rows without rev_no belong to no
    snapshot. Other columns are ignored; an empty table gives an empty result.
    """
    sides = revision_sides(snapshots)
    ranged = sides.repartitionByRange(F.col("project_id"), F.col("from_rev"), F.col("key")).sortWithinPartitions(
        "project_id", "from_rev", "key", "side", F.col("loaded_at").desc_nulls_last(), F.col("row_id").desc_nulls_last()
    )
    return ranged.drop("loaded_at").mapInPandas(merge_ranges, CHANGE_SCHEMA)
