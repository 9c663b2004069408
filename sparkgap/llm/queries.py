"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from . import canonical_values, container_filling, source_mixing, stuffed_pages, token_sizes, top_items

CAPACITY = 2048


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_items.closest_measurements(table(spark, sf_dir, "measurements")).select("measurement_id", "pos")


def p2_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_items.closest_measurements(table(spark, sf_dir, "measurements"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = (table(spark, sf_dir, name) for name in ("net_rules", "manual_entries", "canonical_names"))
    # a row_id with several values counts by the first of them
    return canonical_values.mapped_fields(*tables).groupBy("src", "row_id").agg(F.min_by("ref_id", "value").alias("ref_id"))


def p7_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = (table(spark, sf_dir, name) for name in ("net_rules", "manual_entries", "canonical_names"))
    unmatched = canonical_values.mapped_fields(*tables).filter("ref_id = 0")
    return unmatched.groupBy("kind", "value", "nearest_ref_id", "score").agg(F.count("*").alias("n_rows"))


def _sizes(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return token_sizes.token_sizes(table(spark, sf_dir, "documents"), keep=keep)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container_filling.pack_documents(_sizes(spark, sf_dir), CAPACITY)


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container_filling.packing_report(p8_containers(spark, sf_dir), CAPACITY)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix_sources(_sizes(spark, sf_dir, "source"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix_sources(_sizes(spark, sf_dir, "source"), table(spark, sf_dir, "mix_targets"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffed_pages.stuffed_pages(table(spark, sf_dir, "documents")).filter("is_stuffed").select("doc_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_rows, p7_found, p7_unmatched, p8_containers, p8_report, p9_mix, p9_shares, p10_found)}

_P2 = """
WITH latest AS (
  SELECT measurement_id, job_id, upper(trim(layer)) AS layer, net_a, net_b, clearance_mm,
         row_number() OVER (PARTITION BY measurement_id ORDER BY loaded_at DESC, clearance_mm) AS n
  FROM measurements
), ranked AS (
  SELECT measurement_id, job_id, layer, net_a, net_b, clearance_mm,
         CAST(row_number() OVER (PARTITION BY job_id, layer, net_a ORDER BY clearance_mm, net_b, measurement_id) AS INTEGER) AS pos
  FROM latest WHERE n = 1 AND clearance_mm >= 0 AND NOT isnan(clearance_mm)
)
SELECT {columns} FROM ranked WHERE pos <= 3
"""

ORACLES = {
    "p2_found": _P2.format(columns="measurement_id, pos"),
    "p2_rows": _P2.format(columns="measurement_id, job_id, layer, net_a, net_b, clearance_mm, pos"),
}
