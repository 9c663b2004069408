"""What tables, overviews and pickers ask of boards and assignments, as column expressions and DataFrame operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.net_names import name_tokens
from ..functions.zones import zone_number
from ..tables import settle
from ..vocabulary import NO_NET
from .measurements import critical_pairs

# Names of outer layers, letters and digits only; letters that begin a part's designator.
TOP_NAMES = ("top", "fcu", "front", "frontcu", "topcu", "signal1", "sig1", "l1", "layer1")
BOTTOM_NAMES = ("bottom", "bot", "bcu", "back", "backcu", "bottomcu")
PART_LETTERS = "R|RN|C|U|Q|D|J|P|H|L|TP|SW|S|Y|F|K|RV|RZ|FB|X"
FIRST_NUMBER = r"[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
BLANKS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
LONGEST_LINE, MOST_SIMILAR = 500, 12


def layer_side(name: Column, first: Column, last: Column) -> Column:
    """top, bottom or null: by a layer's name, else by whether it is the first or last of the stack-up."""
    compact = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "")
    return F.when(compact.isin(*TOP_NAMES), "top").when(compact.isin(*BOTTOM_NAMES), "bottom").when(first, "top").when(last, "bottom")


def via_pad_diameter(*texts: Column) -> Column:
    """A via pad's diameter in mm that the first telling text states: ROUND or ROUNDD and a number, or r and a number as a whole.

    Numbers from 10,000 behind ROUND are millionths of a millimetre, others thousandths.
    """
    found = []
    for text in texts:
        number = F.regexp_extract(text, r"(?i)ROUNDD?([0-9]{4,})", 1).try_cast("double")
        disc = F.regexp_extract(F.trim(text), r"(?i)^r([0-9]*\.?[0-9]+)$", 1).try_cast("double")
        found += [F.when(number >= 10_000, number / 1e6).otherwise(number * 0.001), disc * 0.001]
    return F.coalesce(*found)


def one_line(text: Column, limit: int = LONGEST_LINE) -> Column:
    """A text on one line with single blanks, cut to `limit` characters with an ellipsis."""
    compact = F.trim(F.regexp_replace(text, BLANKS, " "))
    return F.when(F.length(compact) > limit, F.concat(F.substring(compact, 1, limit - 3), F.lit("..."))).otherwise(compact)


def gradient_bucket(clearance: Column, threshold_mm: float) -> Column:
    """0 to 10 by how much of the threshold a clearance reaches, halves to even; null for null and NaN."""
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), clearance / max(threshold_mm, 1e-12)))
    return F.when(clearance.isNotNull() & ~F.isnan(clearance), F.bround(part * 10, 0).cast("int"))


def sort_key(text: Column) -> Column:
    """Orders a column's texts: numbers by the first number in them, then words, then blanks."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    plain = F.translate(bare, ",", "")
    number = F.coalesce(F.when(plain.rlike(f"^{FIRST_NUMBER}$"), plain.try_cast("double")), F.regexp_extract(bare, FIRST_NUMBER, 0).try_cast("double"))
    kind = F.when(bare == "", 2).when(number.isNotNull(), 0).otherwise(1)
    return F.struct(kind.alias("kind"), F.coalesce(F.when(bare != "", number), F.lit(0.0)).alias("number"), F.lower(bare).alias("text"))


def part_designator(label: Column) -> Column:
    """A label as a part's designator such as R12, or null if it is none; double underscores count once."""
    text = F.regexp_replace(F.regexp_replace(F.trim(label), "__", "_"), "^_+|_+$", "")
    return F.when(text.rlike(rf"(?i)^(?:{PART_LETTERS})[0-9]+[A-Z0-9_\\-]*$"), text)


def drawable_pads(shapes: DataFrame) -> DataFrame:
    """Positive pads that have a shape."""
    upper = lambda c: F.upper(F.trim(c))
    return shapes.filter((upper("kind") == "P") & (upper("polarity") == "P") & F.col("shape").isNotNull())


def layer_counts(shapes: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Per layer: features, those without a shape, cuts, copper without a net, nets with copper."""
    placed = F.col("shape").isNotNull()
    positive = F.upper(F.trim("polarity")) == "P"
    net = F.coalesce("net_name", F.lit(NO_NET))
    copper = placed & F.coalesce(positive, F.lit(False))
    return shapes.groupBy(*scope).agg(
        F.count("*").alias("n_features"),
        F.count_if(~placed).alias("n_without_shape"),
        F.count_if(placed & ~F.coalesce(positive, F.lit(False))).alias("n_cuts"),
        F.count_if(copper & (net == NO_NET)).alias("n_without_net"),
        F.count_distinct(F.when(copper & (net != NO_NET), net)).alias("n_nets"),
    )


def missing_on_layers(selected: DataFrame, present: DataFrame, layers: DataFrame, scope: str) -> DataFrame:
    """(scope, layer, net) of each selected net that a layer of its scope lacks.

    `selected`: scope, net; `present`: scope, layer, net; `layers`: scope, layer.
    """
    wanted = selected.select(scope, "net").distinct().join(layers.select(scope, "layer").distinct(), scope)
    return wanted.join(present.select(scope, "layer", "net").distinct(), [scope, "layer", "net"], "left_anti").select(scope, "layer", "net")


def debug_pairs(measurements: DataFrame, threshold_mm: float, limit: int) -> DataFrame:
    """The first `limit` critical pairs in the order of reports (a top-k)."""
    return critical_pairs(measurements, threshold_mm).orderBy("clearance_mm", "layer", "net_a", "net_b", "measurement_id").limit(limit)


def with_default_zone(assignments: DataFrame) -> DataFrame:
    """Nets without a zone get zone 1; `defaulted` marks them."""
    none = zone_number(F.col("galvanic_zone")).isNull()
    return assignments.withColumn("defaulted", none).withColumn("galvanic_zone", F.when(none, "Zone 1").otherwise(F.col("galvanic_zone")))


def overview_counts(assignments: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Assigned nets, and of them unknown ones, manual ones and those of zones 1 and 2."""
    zone = zone_number(F.col("galvanic_zone"))
    return assignments.groupBy(*scope).agg(
        F.count("*").alias("n_assigned"), F.count_if(F.col("final_class") == "UNKNOWN").alias("n_unknown"), F.count_if(F.col("source") == "manual").alias("n_manual"), F.count_if(zone == 1).alias("n_zone_1"), F.count_if(zone == 2).alias("n_zone_2")
    )


def mixed_values(rows: DataFrame, scope: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Whether a selection holds more than one value of each column, null being one."""
    return rows.groupBy(*scope).agg(*[((F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))) > 1).alias(f"{c}_mixed") for c in columns])


def similar_nets(nets: DataFrame, edited: DataFrame, scope: Sequence[str], *, most: int = MOST_SIMILAR) -> DataFrame:
    """(scope, net, other_net, reason): for each edited net the first `most` others by name that share a word or whose normal name begins with the other.

    Both tables hold the scope, net and its normal name `normal`. Words meet by
    an equi-join; the second kind always shares its first word, so that it never
    stands alone and needs no join of its own.
    """
    words = lambda df, n: settle(df.select(*scope, F.col("net").alias(n), "normal"), __words=F.array_distinct(name_tokens(F.col("normal")))).select(*scope, n, F.explode("__words").alias("word"))
    met = words(edited, "net").join(words(nets, "other_net"), [*scope, "word"]).filter("net <> other_net")
    shared = met.groupBy(*scope, "net", "other_net").agg(F.array_sort(F.collect_set("word")).alias("words"))
    order = Window.partitionBy(*scope, "net").orderBy("other_net")
    first = shared.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= most)
    return first.select(*scope, "net", "other_net", F.concat(F.lit("shares "), F.array_join("words", ", ")).alias("reason"))
