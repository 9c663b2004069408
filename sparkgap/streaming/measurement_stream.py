"""Measurements as a stream: each delivery once, windows of critical pairs, and a store that knows the last delivery of each.

The first two hold bounded state and so miss what comes later than their delay;
the store misses nothing: every micro-batch is kept, however late its rows, and
what counts is settled when it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def deduplicated(stream: DataFrame, *, delay: str = "1 day") -> DataFrame:
    """Each delivery of a measurement once, as long as repeats arrive within the delay; state is bounded by it."""
    return stream.withWatermark("loaded_at", delay).dropDuplicatesWithinWatermark(["measurement_id", "clearance_mm"])


def critical_counts(stream: DataFrame, *, threshold_mm: float = 0.2, window: str = "1 hour", delay: str = "2 days") -> DataFrame:
    """Per window of measured_at and job: pairs, critical pairs and the least clearance; late rows count within the delay."""
    usable = stream.filter(F.col("clearance_mm").isNotNull() & ~F.isnan("clearance_mm")).withWatermark("measured_at", delay)
    grouped = usable.groupBy(F.window("measured_at", window), "job_id")
    found = grouped.agg(F.count("*").alias("n_pairs"), F.count_if(F.col("clearance_mm") < threshold_mm).alias("n_critical"), F.min("clearance_mm").alias("least_mm"))
    return found.select(F.col("window.start").alias("window_start"), "job_id", "n_pairs", "n_critical", "least_mm")


def kept_deliveries(stream: DataFrame, folder: str) -> DataStreamWriter:
    """A writer that keeps every micro-batch in its own part of `folder`; a batch that is repeated replaces itself.

    Of a measurement only the last delivery within the batch is written; rows
    without an id all are.
    """

    def write(batch: DataFrame, number: int) -> None:
        _last(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write)


def _last(rows: DataFrame) -> DataFrame:
    own = F.when(F.col("measurement_id").isNull(), F.monotonically_increasing_id())
    order = Window.partitionBy("measurement_id", "__own").orderBy(F.col("loaded_at").desc_nulls_last(), F.col("clearance_mm").asc_nulls_last())
    return rows.withColumn("__own", own).withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__own", "__n")


def last_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """The last delivery of every measurement that `kept_deliveries` has written, late corrections included."""
    return _last(spark.read.parquet(folder)).drop("batch")
