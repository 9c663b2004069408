"""Session defaults and the helpers that depend on the session's settings."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sparkgap", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared checkpoint folder and go on from there.

    The folder is the one the cluster names in `spark.checkpoint.dir`. Without
    one only a local session (a test) gets a temporary folder; on a cluster that
    would lie on the driver alone, so it is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
            folder = tempfile.mkdtemp(prefix="sparkgap-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def spread_out(df: DataFrame) -> DataFrame:
    """`df`, dealt out anew only if its scan has fewer partitions than the cluster has cores.

    For costly work per row on few, small files; large inputs are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
