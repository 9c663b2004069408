"""One quantity recorded in several units: the unit of every value, and the value in one unit.

Evidence for a unit, in this order: the text of the value itself, the setting of
the group it belongs to (a job), and, where both are missing, a mixture fitted on
a logarithmic scale. Its components share one normal distribution of the true
size and are offset by the known conversion factors, so only the distribution
and the units' weights are fitted. The fit runs over a histogram of log values
(bins of `BIN`, so its size is fixed by the range of doubles that make sense and
not by the number of rows); a group's rows are pooled before a unit is assigned.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..tables import join_few

# Nanometres in a unit, and how units are written (lower case).
UNIT_NM = {"mm": 1_000_000, "cm": 10_000_000, "um": 1_000, "nm": 1, "mil": 25_400, "inch": 25_400_000}
UNIT_WORDS = {
    "mm": ("mm", "millimeter", "millimeters", "millimetre", "millimetres"),
    "cm": ("cm", "centimeter", "centimeters", "centimetre", "centimetres"),
    "um": ("um", "\u00b5m", "\u03bcm", "micron", "microns", "micrometer", "micrometers", "micrometre", "micrometres"),
    "nm": ("nm", "nanometer", "nanometers", "nanometre", "nanometres"),
    "mil": ("mil", "mils", "thou", "thous", "th"),
    "inch": ("in", "inch", "inches", '"', "\u2033", "\u201d"),
}
ANY_UNIT = "|".join(sorted((w for words in UNIT_WORDS.values() for w in words), key=len, reverse=True))
SHAPE = r"^\s*(?:round|rect|oval|r)\s*"
NUMBER = r"[0-9]*[.,]?[0-9]+"
MAX_LOG, BIN = 30.0, 0.01


def _unit(text: Column) -> Column:
    pairs = [F.lit(x) for unit, words in UNIT_WORDS.items() for word in words for x in (word, unit)]
    return F.try_element_at(F.create_map(*pairs), text)


def size_number(raw_name: Column) -> Column:
    """The first number of a shape name, as an exact decimal; null if it has no size."""
    text = F.regexp_extract(F.lower(raw_name), SHAPE + r"(?:\[[^\]]*\])?\s*(" + NUMBER + r")(?![0-9.,])", 1)
    return F.translate(text, ",", ".").try_cast("decimal(24,10)")


def written_unit(raw_name: Column) -> Column:
    """The unit that a shape name states for its first number; null if it states none.

    The unit right after the number comes first, then one in brackets before it,
    then the last one of the name, then a lone `I` (thousandths of an inch) or
    `M` (micrometres) at the end.
    """
    name = F.trim(F.regexp_replace(F.lower(raw_name), r"[\s\p{Z}]+", " "))
    after = F.regexp_extract(name, SHAPE + r"(?:\[[^\]]*\])?\s*" + NUMBER + rf" ?({ANY_UNIT})(?=[x\s]|$)", 1)
    bracket = F.regexp_extract(name, SHAPE + rf"\[\s*({ANY_UNIT})\s*\]", 1)
    last = F.regexp_extract(name, rf"[0-9] ?({ANY_UNIT})$", 1)
    mark = F.regexp_extract(name, r"[0-9] ?([im])$", 1)
    found = F.coalesce(*[F.nullif(text, F.lit("")) for text in (after, bracket, last)], F.when(mark == "i", "mil").when(mark == "m", "um"))
    return _unit(found)


def job_unit(units: Column) -> Column:
    """What a bare number means in a job with these `units`; null if they say nothing."""
    text = F.lower(F.trim(units))
    return F.when(text.rlike(r"^(?:inch(?:es)?|in|imperial|mils?)$"), "mil").when(text.rlike(r"^(?:mm|millimet(?:er|re)s?|metric)$"), "um")


@dataclass(frozen=True)
class UnitMixture:
    """Normal distribution of ln(size in mm), and each unit's weight."""

    mean: float
    sd: float
    weights: dict[str, float]

    def log_density(self, log_value: Column, unit: str) -> Column:
        z = (log_value + F.lit(math.log(UNIT_NM[unit] / 1e6)) - self.mean) / self.sd
        return -0.5 * z * z


def fit_mixture(bins: np.ndarray, known: np.ndarray, open_: dict[str, None] | np.ndarray, units: tuple[str, ...], rounds: int = 60) -> UnitMixture:
    """EM over a histogram. `bins`: log values; `known`: counts per bin of ln(mm) of
    values whose unit is known (on the same grid); `open_`: counts of those without."""
    offsets = np.array([math.log(UNIT_NM[u] / 1e6) for u in units])
    if known.sum():
        mean = float((known * bins).sum() / known.sum())
        sd = float(math.sqrt(max((known * (bins - mean) ** 2).sum() / known.sum(), 0.05**2)))
    else:
        centre = float((open_ * bins).sum() / max(open_.sum(), 1))
        mean, sd = centre + float(offsets.mean()), 1.0
    weights = np.full(len(units), 1 / len(units))
    if open_.sum():
        for _ in range(rounds):
            logs = np.log(weights)[:, None] - 0.5 * ((bins[None] + offsets[:, None] - mean) / sd) ** 2
            post = np.exp(logs - logs.max(axis=0))
            post /= post.sum(axis=0)
            mass = post * open_[None]
            weights = np.maximum(mass.sum(axis=1) / mass.sum(), 1e-6)
            total = known.sum() + mass.sum()
            at = bins[None] + offsets[:, None]
            mean = float(((known * bins).sum() + (mass * at).sum()) / total)
            sd = float(math.sqrt(max(((known * (bins - mean) ** 2).sum() + (mass * (at - mean) ** 2).sum()) / total, 0.05**2)))
    return UnitMixture(mean, sd, dict(zip(units, map(float, weights))))


def with_common_unit(rows: DataFrame, *, number: str = "number", unit: str = "unit", group: str = "group", candidates: tuple[str, ...] = ("um", "mil"), sure: float = 0.95) -> DataFrame:
    """`rows` with `unit` completed, `unit_source`, `unit_probability`, `unit_uncertain` and `value_nm` added.

    `number` is a decimal, `unit` one of `UNIT_NM` or null, `group` what its rows
    share one unknown unit within (null: the row stands alone). Rows without a
    number keep nulls. Zero has no logarithm: its unit stays null, its value is 0.
    Rows are never dropped or repeated, repeated rows each get the same answer.
    `rows` is read twice, so it should be kept. Groups with unknown units are
    joined by `join_few`. To the driver: one histogram of at most 2 x 6,000 bins.
    """
    value = F.col(number).cast("double")
    nm = F.coalesce(*[F.when(F.col(unit) == u, F.lit(f)) for u, f in UNIT_NM.items()])
    log_value = F.when(value > 0, F.ln(value))
    log_mm = F.when(nm.isNotNull(), F.ln(value * nm / 1e6)).otherwise(log_value)
    place = F.round(F.greatest(F.lit(-MAX_LOG), F.least(F.lit(MAX_LOG), log_mm)) / BIN).cast("int")
    counted = rows.filter(log_value.isNotNull()).groupBy(place.alias("b"), nm.isNotNull().alias("known")).count().collect()
    size = 2 * int(MAX_LOG / BIN) + 1
    grid = (np.arange(size) - size // 2) * BIN
    counts = {True: np.zeros(size), False: np.zeros(size)}
    for row in counted:
        counts[row["known"]][row["b"] + size // 2] += row["count"]
    given = rows.withColumn("unit_source", F.when(F.col(unit).isNotNull(), "given"))
    if not counts[False].sum():
        done = given.withColumn("unit_probability", F.when(F.col(unit).isNotNull(), F.lit(1.0)))
    else:
        model = fit_mixture(grid, counts[True], counts[False], candidates)
        open_rows = given.filter(F.col(unit).isNull() & log_value.isNotNull())
        own = {u: model.log_density(log_value, u) for u in candidates}
        pooled = open_rows.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("__g")).agg(*[F.sum(d).alias(f"__{u}") for u, d in own.items()])
        joined = join_few(given, cut_lineage(pooled), {group: "__g"})
        score = {u: F.coalesce(F.col(f"__{u}"), own[u]) + math.log(model.weights[u]) for u in candidates}
        best = F.greatest(*score.values())
        total = sum((F.exp(s - best) for s in score.values()), F.lit(0.0))
        guess = F.coalesce(*[F.when(s == best, F.lit(u)) for u, s in score.items()])
        openly = F.col(unit).isNull() & log_value.isNotNull()
        done = (
            joined.withColumn("unit_probability", F.when(F.col(unit).isNotNull(), 1.0).when(openly, 1.0 / total))
            .withColumn("unit_source", F.when(openly, "mixture").otherwise(F.col("unit_source")))
            .withColumn(unit, F.when(openly, guess).otherwise(F.col(unit)))
            .drop(*[f"__{u}" for u in candidates])
        )
    exact = F.coalesce(*[F.when(F.col(unit) == u, F.round(F.col(number) * F.lit(f).cast("decimal(12,0)"), 0)) for u, f in UNIT_NM.items()])
    return done.withColumn("unit_uncertain", F.col("unit_probability") < sure).withColumn("value_nm", F.coalesce(exact, F.when(value == 0, F.lit(0))).cast("long"))


def read_sizes(symbols: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each symbol's last delivery with its number, the unit its name states and the one its job implies.

    One row per symbol_id, ties by raw_name and width_mm; null symbol_ids stay
    rows of their own. Written once to the checkpoint folder.
    """
    latest = Window.partitionBy("symbol_id").orderBy(F.col("loaded_at").desc_nulls_last(), F.col("raw_name").asc_nulls_last(), F.col("width_mm").asc_nulls_last())
    columns = ["symbol_id", "job_id", "layer", "raw_name", "width_mm", "loaded_at"]
    read = symbols.select(*columns, size_number(F.col("raw_name")).alias("number"), written_unit(F.col("raw_name")).alias("written_unit"))
    one = read.filter("symbol_id is not null").withColumn("__n", F.row_number().over(latest)).filter("__n = 1").drop("__n", "loaded_at")
    rest = read.filter("symbol_id is null").drop("loaded_at")
    per_job = jobs.filter("job_id is not null").groupBy("job_id").agg(F.max(job_unit(F.col("units"))).alias("job_unit"))
    return cut_lineage(join_few(one.unionByName(rest), per_job, ["job_id"], spread=["symbol_id", "raw_name"]))


def symbol_widths(symbols: DataFrame, jobs: DataFrame) -> DataFrame:
    """The width in whole nanometres of each symbol, from its name, its job or the mixture.

    One row per symbol_id: its latest delivery counts, ties by raw_name and
    width_mm. Symbols whose name holds no size have a null width_nm. Null
    symbol_ids stay rows of their own.
    """
    rows = read_sizes(symbols, jobs).withColumn("unit", F.when(F.col("number").isNotNull(), F.coalesce("written_unit", "job_unit")))
    done = with_common_unit(rows, group="job_id")
    source = F.when(F.col("unit_source") == "given", F.when(F.col("written_unit").isNotNull(), "name").otherwise("job")).otherwise(F.col("unit_source"))
    return done.withColumn("unit_source", source).withColumnRenamed("value_nm", "width_nm").drop("written_unit", "job_unit", "number")


FOLDS = 2


def held_out_units(symbols: DataFrame, jobs: DataFrame, *, sure: float = 0.95) -> DataFrame:
    """What the mixture says of every job whose unit is known, with that unit hidden.

    (job_id, n_symbols, given_unit, guessed_unit, unit_probability, unit_uncertain,
    agrees): each job's bare numbers lose their unit once, in the fold of its hash,
    while the other folds' jobs and the units written in names keep theirs.
    Covers every symbol with a bare number and a job that states a unit; jobs
    whose bare numbers are all 0 don't come out.
    """
    rows = read_sizes(symbols, jobs).filter("number is not null").select("symbol_id", "job_id", "number", "written_unit", "job_unit")
    fold = F.pmod(F.xxhash64("job_id"), F.lit(FOLDS))
    judged = None
    for k in range(FOLDS):
        hidden = F.col("written_unit").isNull() & F.col("job_unit").isNotNull() & (fold == k)
        asked = rows.withColumn("__hidden", hidden).withColumn("unit", F.when(~hidden, F.coalesce("written_unit", "job_unit")))
        part = with_common_unit(asked, group="job_id", sure=sure).filter("__hidden and unit_source = 'mixture'")
        judged = part if judged is None else judged.unionByName(part)
    per_job = judged.groupBy("job_id").agg(
        F.count("*").alias("n_symbols"), F.max("job_unit").alias("given_unit"), F.max("unit").alias("guessed_unit"), F.max("unit_probability").alias("unit_probability"), F.max("unit_uncertain").alias("unit_uncertain")
    )
    return per_job.withColumn("agrees", F.col("given_unit") == F.col("guessed_unit"))


def unit_calibration(held_out: DataFrame) -> DataFrame:
    """How often the mixture is right where it claims a probability: a row per tenth of it."""
    tenth = F.least(F.floor(F.col("unit_probability") * 10), F.lit(9)).cast("int")
    return held_out.groupBy(tenth.alias("tenth")).agg(
        F.count("*").alias("n_jobs"), F.sum("n_symbols").alias("n_symbols"), F.avg("unit_probability").alias("mean_probability"), F.avg(F.col("agrees").cast("double")).alias("share_right")
    )


def wrong_widths(widths: DataFrame, tolerance_nm: float = 1.0) -> DataFrame:
    """Symbols with a size whose recorded width_mm is missing or further off than `tolerance_nm`."""
    off = F.abs(F.round(F.col("width_mm") * 1e6, 3) - F.col("width_nm"))
    missing = F.col("width_mm").isNull() | F.isnan("width_mm")
    return widths.filter(F.col("width_nm").isNotNull() & (missing | (off > tolerance_nm)))
