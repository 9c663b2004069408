"""Mixing sources to target shares of the total size, with a cap on repeats.

Every document has a fixed hash. A source's budget is met by taking all of its
documents a number of times, and for the rest those whose hash lies below a
threshold. The threshold comes from histograms of tokens over hash buckets: the
bucket in which the budget ends is refined by the next bits of the hash until a
single document is left; what remains of the budget goes to later documents that
still fit, in the same way. Nothing is sorted; each refinement reads only the
boundary buckets' rows; the driver sees sources x `BUCKETS` sums at most.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BITS, LEVELS = 12, 5
BUCKETS = 1 << BITS
MAX_SOURCES = 1_000
ROUNDS, CLOSE_ENOUGH = 4, 1e-3


def source_name(source: Column) -> Column:
    """One spelling of a source: trimmed, lower case, words joined by `_`."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s\-]+", "_")


def document_hash(doc_id: Column, tokens: Column | None = None) -> Column:
    """60 bits of a hash of the id (of the size for documents without one), as a number of at least 0."""
    own = F.xxhash64(doc_id) if tokens is None else F.xxhash64(doc_id, F.when(doc_id.isNull(), tokens))
    return F.shiftrightunsigned(own, 64 - BITS * LEVELS)


@dataclass
class Quota:
    """A source's part: `copies` of every document, one more of those in a band.

    A band (low, high, most) holds the documents with low <= hash < high and at
    most `most` tokens. The first ends where the next document exceeds what is
    left of the budget; the following ones hold later, smaller documents.
    """

    budget: float
    copies: int
    rest: float
    bands: list[tuple[int, int, int]] = field(default_factory=list)

    def extra(self, hashed: Column, tokens: Column) -> Column:
        out = F.lit(False)
        for low, high, most in self.bands:
            out = out | ((hashed >= low) & (hashed < high) & (tokens <= most))
        return out.cast("int")


def find_quotas(totals: dict[str, int], targets: dict[str, tuple[float, int]], total_tokens: int | None = None) -> dict[str, Quota]:
    """The largest mix (of at most `total_tokens`) with the target shares that repeats no source more than allowed."""
    usable = {s: (share, repeats) for s, (share, repeats) in targets.items() if share > 0 and repeats > 0 and totals.get(s, 0) > 0}
    if not usable:
        return {}
    size = min(repeats * totals[s] / share for s, (share, repeats) in usable.items())
    if total_tokens is not None:
        size = min(size, total_tokens / sum(share for share, _ in usable.values()))
    out = {}
    for s, (share, repeats) in usable.items():
        budget = share * size
        copies = min(repeats, math.floor(budget / totals[s] + 1e-9))
        rest = 0.0 if copies == repeats else max(0.0, budget - copies * totals[s])
        out[s] = Quota(budget, copies, rest)
    return out


def find_thresholds(sizes: DataFrame, quotas: dict[str, Quota]) -> None:
    """Give each quota its bands, until less than `CLOSE_ENOUGH` of its budget is left or `ROUNDS` have run."""
    low = {s: 0 for s in quotas}
    for _ in range(ROUNDS):
        left = {s: int(q.rest) for s, q in quotas.items() if q.rest >= 1 and q.rest > CLOSE_ENOUGH * q.budget and low[s] < 1 << (BITS * LEVELS)}
        if not left:
            return
        high = {s: 0 for s in left}
        open_ = set(left)
        for level in range(LEVELS):
            shift = BITS * (LEVELS - 1 - level)
            boundary = F.lit(False)
            for s in open_:
                at_edge = F.shiftright("h", shift + BITS) == high[s]
                boundary = boundary | ((F.col("source") == s) & at_edge & (F.col("h") >= low[s]) & (F.col("n_tokens") <= left[s]))
            bucket = F.shiftright("h", shift).bitwiseAND(F.lit(BUCKETS - 1))
            sums: dict[str, dict[int, int]] = {}
            for r in sizes.filter(boundary).groupBy("source", bucket.alias("b")).agg(F.sum("n_tokens").alias("t")).collect():
                sums.setdefault(r["source"], {})[int(r["b"])] = r["t"]
            for s in list(open_):
                quota, end = quotas[s], BUCKETS
                for b in sorted(sums.get(s, {})):
                    if sums[s][b] > quota.rest:
                        end = b
                        break
                    quota.rest -= sums[s][b]
                if end == BUCKETS:  # all of the bucket fits: the edge is its end
                    high[s] = ((high[s] + 1) << BITS) << shift
                    open_.discard(s)
                else:
                    high[s] = (high[s] << BITS) + end
            if not open_:
                break
        for s in left:
            quotas[s].bands.append((low[s], high[s], left[s]))
            low[s] = high[s] + 1 if s in open_ else high[s]


def mix_sources(documents: DataFrame, targets: DataFrame, *, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, copy_no, n_tokens) and the report per target source.

    `documents` has doc_id, source and n_tokens; `targets` source, target_share and
    max_repeats (few rows, checked). The mix is as large as the repeats allow, or
    `total_tokens` if that is less. The report has target_share, actual_share,
    n_tokens, n_documents, copies of the most repeated document, the source's
    budget and what of it no document filled (`unfilled_tokens`). Documents of
    other or no source, or without tokens, are not used. A target source without
    tokens gets nothing and the others keep their proportions. Repeated targets
    add up; null shares and repeats are 0.
    """
    name = source_name(F.col("source"))
    wanted = targets.groupBy(name.alias("source")).agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("repeats"))
    listed = wanted.filter("source is not null").limit(MAX_SOURCES + 1).collect()
    if len(listed) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    goal = {r["source"]: (r["share"], r["repeats"]) for r in listed}
    sizes = documents.select("doc_id", name.alias("source"), "n_tokens", document_hash(F.col("doc_id"), F.col("n_tokens")).alias("h")).filter("n_tokens > 0")
    sizes = cut_lineage(sizes.filter(F.col("source").isin(*goal)) if goal else sizes.filter("false"))
    totals = {r["source"]: r["t"] for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    quotas = find_quotas(totals, goal, total_tokens)
    find_thresholds(sizes, quotas)
    copies = F.lit(0)
    for s, q in quotas.items():
        copies = F.when(F.col("source") == s, F.lit(q.copies) + q.extra(F.col("h"), F.col("n_tokens"))).otherwise(copies)
    chosen = sizes.withColumn("copies", copies).filter("copies > 0")
    mix = chosen.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "n_tokens")
    spark = documents.sparkSession
    budgets = [(s, float(a), int(b), int(quotas[s].budget) if s in quotas else 0) for s, (a, b) in goal.items()]
    goals = spark.createDataFrame(budgets, "source string, target_share double, max_repeats int, budget_tokens bigint")
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"), F.count("*").alias("n_documents"), F.max("copies").alias("most_copies"))
    got = goals.join(got, "source", "left").fillna(0, ["n_tokens", "n_documents", "most_copies"])
    everything = F.sum("n_tokens").over(Window.partitionBy(F.lit(1)))  # a row per target source
    report = got.withColumn("actual_share", F.coalesce(F.col("n_tokens") / F.nullif(everything, F.lit(0)), F.lit(0.0)))
    return mix, report.withColumn("unfilled_tokens", F.col("budget_tokens") - F.col("n_tokens"))
