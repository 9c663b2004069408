"""Galvanic zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zones are numbered 1 to 10 and may be written 1, z1, zone1, galvanic zone 1.
ZONE_TEXT = r"^(?:galvaniczone|zone|z)?(10|[1-9])$"
ZONE_COUNT = 10


def zone_number(zone: Column) -> Column:
    """The number of a zone however it is written; null if there is none."""
    return F.regexp_extract(F.regexp_replace(F.lower(zone), r"[\s_\-]+", ""), ZONE_TEXT, 1).try_cast("int")


def zone_label(zone: Column) -> Column:
    """`Zone n`, or an empty text if there is none."""
    return F.coalesce(F.concat(F.lit("Zone "), zone_number(zone).cast("string")), F.lit(""))
