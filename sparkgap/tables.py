"""Reading the engine's parquet tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` under `sf_dir`, a file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with `columns` added such that each is computed once.

    A plain projection is merged into the ones after it, and an expression used
    several times there is copied as often; behind a generator it is not.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


BROADCAST_ROWS = 50_000  # of keys and a few values each: some MB
SALTS = 32


def join_few(rows: DataFrame, few: DataFrame, keys: Mapping[str, str] | Sequence[str], how: str = "left", *, spread: Sequence[str] = (), null_safe: bool = False, most: int | None = None) -> DataFrame:
    """`rows` joined with `few`, a table of at most one row per key, without a task for a hot key.

    `keys` maps columns of `rows` to those of `few` (or lists common ones); the
    latter don't come out. `few` is counted: up to `most` (`BROADCAST_ROWS`) rows
    it is broadcast, beyond that each of its rows is repeated for `SALTS` salts and
    every key of `rows` spreads over as many tasks by the values of `spread` (all
    columns by default). There the join is a sort-merge join by a hint: Spark
    estimates `few` by the compressed size of its files, which says nothing about
    its rows times `SALTS`, and would broadcast those. Keys that are null match
    nothing unless `null_safe`.
    """
    pairs = dict(keys) if isinstance(keys, Mapping) else {k: k for k in keys}
    inner = {b: f"__few_{k}" for k, b in enumerate(pairs.values())}
    few = few.select(*[F.col(b).alias(i) for b, i in inner.items()], *[c for c in few.columns if c not in inner])
    match = [F.col(a).eqNullSafe(F.col(inner[b])) if null_safe else F.col(a) == F.col(inner[b]) for a, b in pairs.items()]
    most = BROADCAST_ROWS if most is None else most
    if few.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(few), match, how).drop(*inner.values())
    salt = F.pmod(F.xxhash64(*(spread or rows.columns)), F.lit(SALTS))
    few = few.withColumn("__few_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return rows.withColumn("__salt", salt).join(few.hint("merge"), [*match, F.col("__salt") == F.col("__few_salt")], how).drop(*inner.values(), "__salt", "__few_salt")
