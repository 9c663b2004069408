"""Splitting a field that packs several values into one row per value.

All in JVM expressions: spans that must stay together (quoted text, escaped
marks, and the placeholder characters themselves) are replaced by indexed
placeholders, the rest is split at any delimiter, the spans are put back by array
lookup, and the items are exploded with their positions. A text that already
holds placeholder characters cannot collide, as those are spans, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELIMITERS = r"[,;|\t\r\n]"
OPEN, CLOSE = "\ue000", "\ue001"
# A quotation mark opens a span only where a value may begin, so that 5" or don't open none.
SPAN = (
    r'(?<![\p{L}\p{N}"])"[^"\\]*+(?:(?:""|\\.)[^"\\]*+)*+"'
    r"|(?<![\p{L}\p{N}'])'[^'\\]*+(?:(?:''|\\.)[^'\\]*+)*+'"
    r"|\\."
    rf"|[{OPEN}{CLOSE}]"
)
SLOT = rf"{OPEN}(\d+){CLOSE}"


def _unquoted(span: Column) -> Column:
    """A quoted span without its marks, doubled marks and escapes."""
    mark = F.substring(span, 1, 1)
    inner = F.substring(span, F.lit(2), F.length(span) - 2)
    single = F.when(mark == '"', F.regexp_replace(inner, '""', '"')).otherwise(F.regexp_replace(inner, "''", "'"))
    return F.regexp_replace(single, r"\\([\\\"',;|\[\]])", "$1")


def packed_items(field: Column) -> Column:
    """The items of a packed field, an array of text; empty for null or blank fields.

    Items are separated by `,` `;` `|`, tabs or line breaks, in any mixture.
    Delimiters within quotation marks or after a backslash belong to the item. An
    item has no outer blanks, no quotation marks around it or around its value
    (after `=`), no escaping backslash; brackets around the whole list go;
    doubled marks inside quotation marks count once. Empty items do not count.
    """
    text = F.trim(F.coalesce(field, F.lit("")))
    text = F.when(text.rlike(r"(?s)^\[.*\]$"), F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)
    spans = F.regexp_extract_all(text, F.lit(f"(?s){SPAN}"), F.lit(0))
    between = F.split(text, f"(?s){SPAN}", -1)
    slots = F.transform(between, lambda part, k: F.when(k == 0, part).otherwise(F.concat(F.lit(OPEN), (k - 1).cast("string"), F.lit(CLOSE), part)))
    items = F.transform(F.split(F.array_join(slots, ""), DELIMITERS, -1), lambda item: F.regexp_replace(item, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.filter(F.transform(items, lambda item: _restored(item, spans)), lambda item: item != "")


def _restored(item: Column, spans: Column) -> Column:
    index = F.regexp_extract_all(item, F.lit(SLOT), F.lit(1))
    whole = item.rlike(rf"^(?:[^{OPEN}{CLOSE}=]*=[\s\p{{Z}}]*)?{SLOT}$")
    texts = F.split(item, SLOT, -1)

    def looked_up(position: Column) -> Column:
        span = F.get(spans, position.cast("int"))
        first = F.substring(span, 1, 1)
        return F.when(first == "\\", F.substring(span, F.lit(2), F.lit(1))).when(first.isin('"', "'") & whole, _unquoted(span)).otherwise(span)

    restored = F.array_join(
        F.transform(texts, lambda part, k: F.when(k == 0, part).otherwise(F.concat(F.coalesce(looked_up(F.get(index, k - 1)), F.lit("")), part))), ""
    )
    cleaned = F.regexp_replace(restored, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return F.when(F.size(index) == 0, item).otherwise(cleaned)


def explode_packed(rows: DataFrame, row_id: str, field: str, source: str) -> DataFrame:
    """(src, row_id, pos, item) of every item of `field`; positions start at 1 in each field.

    Redelivered rows are dropped before the split; equal items at different
    positions stay. Null ids stay. One shuffle, by row id (null ids by their field).
    """
    once = rows.select(F.col(row_id).cast("long").alias("row_id"), F.col(field).alias("__field")).filter(F.trim(F.col("__field")) != "")
    once = once.withColumn("__spread", F.when(F.col("row_id").isNull(), F.xxhash64("__field")))
    once = once.repartition("row_id", "__spread").dropDuplicates(["row_id", "__spread", "__field"])
    items = once.select(F.lit(source).alias("src"), "row_id", "__spread", F.posexplode(packed_items(F.col("__field"))).alias("pos", "item"))
    once = items.select("src", "row_id", (F.col("pos") + 1).alias("pos"), "item", "__spread").dropDuplicates(["row_id", "pos", "item", "src", "__spread"])
    return once.drop("__spread")
