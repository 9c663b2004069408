"""Importing assignments: snapshots and stores as JSON, tables as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.assignments import validity_problem

SCHEMA_VERSION = 1
ENTRY = (
    "struct<net_name:string,final_class:string,final_voltage_v:string,reference_net:string,voltage_type:string,confidence:string,severity:string,"
    "review_state:string,source:string,galvanic_zone:string,notes:string,reviewed_by:string,reviewed_at_utc:string,review_reason:string,"
    "source_revision:string,last_seen_revision:string,evidence:map<string,string>,waiver:map<string,string>>"
)
ENVELOPE = f"schema_version int, file_kind string, project_revision string, assignments map<string,{ENTRY}>"
# The columns in which a table may hold the voltage, the first one present counts; columns it must have.
VOLTAGE_COLUMNS = ("final_voltage_v", "assigned_voltage_v", "guessed_voltage_v", "voltage_v")
REQUIRED_COLUMNS = ("net_name", "final_class", "confidence", "severity", "review_state")


class ImportRejected(ValueError):
    """A file that is refused as a whole."""


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Assignments of snapshot or store files, one row each with `source_file`, `problem` where it must be skipped.

    A file that is no object, holds no assignments or has a newer schema gives one
    row whose problem says so, and nothing else.
    """
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("source_file"))
    read = files.select("source_file", F.from_json("value", ENVELOPE).alias("e"))
    refused = F.when(F.col("e").isNull() | F.col("e.assignments").isNull(), "no assignments").when(F.col("e.schema_version") > SCHEMA_VERSION, "newer schema_version")
    rows = read.select("source_file", F.col("e.project_revision").alias("project_revision"), refused.alias("refused"), F.explode_outer(F.when(refused.isNull(), F.col("e.assignments"))).alias("key", "a"))
    flat = rows.select("source_file", "project_revision", "refused", F.coalesce("a.net_name", "key").alias("net_name"), *[F.col(f"a.{f}").alias(f) for f in _fields() if f != "net_name"])
    return _checked(flat)


def _fields() -> list[str]:
    return [part.split(":")[0] for part in ENTRY[7:].replace("map<string,string>", "map").rstrip(">").split(",")]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Assignments of a table. Refused as a whole if columns are missing or a net comes twice."""
    table = spark.read.csv(path, header=True, multiLine=True, escape='"')
    missing = [c for c in REQUIRED_COLUMNS if c not in table.columns]
    volts = next((c for c in VOLTAGE_COLUMNS if c in table.columns), None)
    if missing or volts is None:
        raise ImportRejected("missing columns: " + ", ".join(missing or ["final_voltage_v"]))
    if table.filter(F.trim("net_name") != "").groupBy(F.trim("net_name")).count().filter("count > 1").limit(1).count():
        raise ImportRejected("a net comes more than once")
    return _checked(table.withColumn("final_voltage_v", F.col(volts)).withColumn("refused", F.lit(None).cast("string")))


def _checked(rows: DataFrame) -> DataFrame:
    text = F.trim("final_voltage_v")
    number = text.try_cast("double")
    fits = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    bad_number = F.coalesce(text, F.lit("")) != ""
    problem = (
        F.when(F.col("refused").isNotNull(), F.col("refused"))
        .when(F.coalesce(F.trim("net_name"), F.lit("")) == "", "net_name")
        .when(bad_number & ~F.coalesce(fits, F.lit(False)), "final_voltage_v")
        .otherwise(validity_problem())
    )
    return rows.withColumn("problem", problem).withColumn("final_voltage_v", F.when(fits, number)).drop("refused")
