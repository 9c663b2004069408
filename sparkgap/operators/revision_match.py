"""Matching the nets of a new revision with the assignments of an old one.

Exact names meet by a join. What is left is matched by case, then by normal
name, within one small list per normal name, in the order of names, an old net
being used once. Old and new nets that remain are scored as renames; candidates
come from equi-joins only and never more than needed to know the best 20:

* words that few old nets hold are joined as they are;
* common words are joined by the old net's set of common words, and for each set,
  class and voltage only the first 20 old names are kept. Nets of such a list
  rank by name alone unless they also share a rare word, so no other one of it
  can be among a new net's best 20.
"""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from ..functions.net_names import name_tokens, name_voltage, normal_name
from ..session import cut_lineage
from ..tables import settle
from .rules import RulePack, classify_names

# Weights of likeness, words, voltage, class and parts; the least score; candidates scored and suggested.
W_LIKENESS, W_WORDS, W_VOLTAGE, W_CLASS, W_PARTS = 0.40, 0.20, 0.15, 0.15, 0.10
LEAST_SCORE, SCORED, SUGGESTED = 60, 20, 3
COMMON_WORD = 500  # old nets of a scope that hold it

# Details of the result table, which callers compare.
BY_CASE, BY_NORMAL = "case-insensitively", "after normalization"
SEVERAL, AWAITING = "Multiple imported nets match {}: ", "Conflict candidate awaiting resolution"
FRESH, SUGGESTED_TEXT, GONE = "No imported match; rule-based guess will apply.", "Suggested as likely rename", "Net not present in current revision"

RESULT = "old_net string, new_net string, match_status string, match_score int, action_required string, detail string"


def match_one_name(old: Sequence[str], new: Sequence[str]) -> list[tuple[str | None, str, str, str]]:
    """Matches among the old and new spellings of one normal name: (old, new, status, detail).

    Exact ones are included, as they use up their old net; a new net without any
    candidate is `unmatched`.
    """
    used: set[str] = set()
    known, out = set(old), []
    for name in sorted(set(new)):
        if name in known:
            used.add(name)
            out.append((name, name, "exact", ""))
            continue
        for status, words, alike in (("case_insensitive", BY_CASE, lambda o: o.casefold() == name.casefold()), ("normalized", BY_NORMAL, lambda o: True)):
            found = sorted(o for o in known if o not in used and alike(o))
            if found:
                break
        if not found:
            out.append((None, name, "unmatched", ""))
        elif len(found) == 1:
            used.add(found[0])
            out.append((found[0], name, status, ""))
        else:
            out.append((None, name, "conflict", SEVERAL.format(words) + ", ".join(found)))
    return out


def _likeness(a: Column, b: Column) -> Column:
    @F.pandas_udf(DoubleType())
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)], dtype="float64")

    return ratio(a, b)


def match_score(likeness: Column, old_words: Column, new_words: Column, old_v: Column, new_v: Column, same_class: Column, parts: Column | None = None) -> Column:
    """0 to 100, rounded half to even."""
    shared = F.size(F.array_intersect(old_words, new_words)) / F.greatest(F.size(F.array_distinct(old_words)), F.lit(1))
    volts = F.when(old_v.isNotNull() & new_v.isNotNull(), (F.abs(old_v - new_v) < 1e-9).cast("double")).when(old_v.isNull() & new_v.isNull(), 0.5).otherwise(0.0)
    total = likeness * W_LIKENESS + shared * W_WORDS + volts * W_VOLTAGE + same_class.cast("double") * W_CLASS + (parts if parts is not None else F.lit(0.0)) * W_PARTS
    return F.bround(total * 100, 0).cast(IntegerType())


def _first_names(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("net")
    return df.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= SCORED).drop("__n")


def _features(nets: DataFrame, pack: RulePack) -> DataFrame:
    named = classify_names(nets.withColumnRenamed("net", "net_name"), pack).select(*[c for c in nets.columns if c != "net"], F.col("net_name").alias("net"), F.col("final_class").alias("net_class"))
    named = settle(named, normal=normal_name(F.col("net")))
    return settle(named, words=F.array_distinct(name_tokens(F.col("normal"))), volts=name_voltage(F.col("net")))


def rename_candidates(old: DataFrame, new: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(scope, new net, old net, shared): for each new net its best 20 old ones by shared words, then name."""
    s = list(scope)
    old_words = old.select(*s, "net", F.explode("words").alias("word"))
    counts = old_words.groupBy(*s, "word").agg(F.count("*").alias("__df"))
    common = counts.filter(F.col("__df") > COMMON_WORD).select(*s, "word")
    new_words = new.select(*s, F.col("net").alias("new_net"), F.explode("words").alias("word"))
    rare_old = old_words.join(common, [*s, "word"], "left_anti")
    by_word = new_words.join(rare_old, [*s, "word"]).select(*s, "new_net", F.col("net").alias("old_net"))

    sets = old_words.join(common, [*s, "word"]).groupBy(*s, "net").agg(F.array_sort(F.collect_set("word")).alias("set"))
    firsts = _first_names(sets, [*s, "set"])
    by_set = new_words.join(firsts.select(*s, "net", F.explode("set").alias("word")), [*s, "word"]).select(*s, "new_net", F.col("net").alias("old_net"))

    by_class = new.select(*s, F.col("net").alias("new_net"), "net_class").join(_first_names(old.select(*s, "net", "net_class"), [*s, "net_class"]), [*s, "net_class"])
    with_v = old.filter("volts is not null").select(*s, "net", "volts")
    by_volts = new.filter("volts is not null").select(*s, F.col("net").alias("new_net"), "volts").join(_first_names(with_v, [*s, "volts"]), [*s, "volts"])
    pick = lambda df: df.select(*s, "new_net", F.col("net").alias("old_net"))
    met = by_word.unionByName(by_set).unionByName(pick(by_class)).unionByName(pick(by_volts)).distinct()
    words = lambda df, n: df.select(*s, F.col("net").alias(f"{n}_net"), F.col("words").alias(f"{n}_words"), F.col("volts").alias(f"{n}_v"), F.col("net_class").alias(f"{n}_class"), F.col("normal").alias(f"{n}_normal"))
    full = met.join(words(old, "old"), [*s, "old_net"]).join(words(new, "new"), [*s, "new_net"])
    full = full.withColumn("shared", F.size(F.array_intersect("old_words", "new_words")))
    best = Window.partitionBy(*s, "new_net").orderBy(F.col("shared").desc(), "old_net")
    return full.withColumn("__n", F.row_number().over(best)).filter(F.col("__n") <= SCORED).drop("__n")


def match_revisions(old: DataFrame, new: DataFrame, pack: RulePack, *, scope: Sequence[str] = (), least_score: int = LEAST_SCORE) -> DataFrame:
    """All matches of `new` nets with `old` ones, per scope: RESULT's columns after the scope's.

    Both have net_name; repeated and null names count once and not at all.
    Statuses: exact, case_insensitive, normalized, conflict, likely_renamed (up to
    3 per new net), new, and missing for each old net that nothing used. What the
    exact stages leave over is written to the checkpoint folder, as it is used
    several times.
    """
    s = list(scope)
    one = lambda df: df.filter("net_name is not null").select(*s, F.col("net_name").alias("net")).distinct()
    olds, news = one(old), one(new)
    keyed = lambda df, n: settle(df, key=normal_name(F.col("net"))).groupBy(*s, "key").agg(F.collect_list("net").alias(n))
    lists = keyed(olds, "olds").join(keyed(news, "news"), [*s, "key"], "full_outer").select(*s, "olds", "news")
    scope_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lists.select(*s).schema)

    def matched(batches):
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                have = lambda c: list(row[c]) if row[c] is not None else []  # noqa: B023, E731
                results = match_one_name(have("olds"), have("news"))
                used = {r[0] for r in results if r[0] is not None}
                conflicting = {o for r in results if r[2] == "conflict" for o in have("olds") if o not in used}
                head = [row[c] for c in s]
                out += [(*head, *r) for r in results]
                out += [(*head, o, None, "left", AWAITING if o in conflicting else "") for o in have("olds") if o not in used]
            yield pd.DataFrame(out, columns=[*s, "old_net", "new_net", "status", "detail"], dtype=object)

    first = lists.mapInPandas(matched, f"{scope_types}{', ' if s else ''}old_net string, new_net string, status string, detail string")
    first = cut_lineage(first)
    left = first.filter("status in ('left', 'unmatched')").select(*s, F.coalesce("old_net", "new_net").alias("net"), (F.col("status") == "left").alias("was"))
    left = cut_lineage(_features(left, pack))  # both sides in one pass
    candidates = rename_candidates(left.filter("was").drop("was"), left.filter("not was").drop("was"), s)
    # names can't be more alike than their lengths allow; the rest of the score is cheap
    longest = 2 * F.least(F.length("old_normal"), F.length("new_normal")) / F.greatest(F.length("old_normal") + F.length("new_normal"), F.lit(1))
    at_most = match_score(longest, F.col("old_words"), F.col("new_words"), F.col("old_v"), F.col("new_v"), F.col("old_class") == F.col("new_class"))
    candidates = candidates.filter(at_most >= least_score)
    score = match_score(_likeness(F.col("old_normal"), F.col("new_normal")), F.col("old_words"), F.col("new_words"), F.col("old_v"), F.col("new_v"), F.col("old_class") == F.col("new_class"))
    rank = Window.partitionBy(*s, "new_net").orderBy(F.col("match_score").desc(), "old_net")
    renamed = candidates.withColumn("match_score", score).filter(F.col("match_score") >= least_score).withColumn("__n", F.row_number().over(rank)).filter(F.col("__n") <= SUGGESTED)
    renamed = cut_lineage(renamed.select(*s, "old_net", "new_net", "match_score"))

    shape = lambda df, status, action, detail, points=F.lit(None).cast("int"): df.select(
        *s, "old_net", "new_net", status.alias("match_status"), points.alias("match_score"), action.alias("action_required"), detail.alias("detail")
    )
    none = F.lit("")
    safe = first.filter("status in ('exact', 'case_insensitive', 'normalized', 'conflict')")
    part1 = shape(safe, F.col("status"), F.when(F.col("status") == "conflict", "resolve_conflict").otherwise(""), F.col("detail"))
    part2 = shape(renamed, F.lit("likely_renamed"), F.lit("review_suggestion"), none, F.col("match_score"))
    fresh = first.filter("status = 'unmatched'").join(renamed.select(*s, "new_net").distinct(), [*s, "new_net"], "left_anti")
    part3 = shape(fresh, F.lit("new"), none, F.lit(FRESH))
    suggested = renamed.select(*s, "old_net", F.lit(True).alias("__s")).distinct()
    gone = first.filter("status = 'left'").join(suggested, [*s, "old_net"], "left")
    why = F.when(F.col("detail") != "", F.col("detail")).when(F.col("__s"), SUGGESTED_TEXT).otherwise(GONE)
    part4 = shape(gone, F.lit("missing"), none, why)
    return part1.unionByName(part2).unionByName(part3).unionByName(part4)
