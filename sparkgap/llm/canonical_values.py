"""Freely typed values mapped to the entries of a reference list.

Token-level repair: the distinct tokens of all values meet the vocabulary of the
list through the texts that remain when up to two characters are deleted (an
equi-join; no pair of distant tokens is ever formed), and pairs within the edit
distance allowed for their length stay. Complete entries are then ranked by soft
TF-IDF: the cosine of the weighted tokens, a repaired one counting less by each
edit, against a threshold. Entries are looked up by a value's heaviest tokens
only, as many as no match can do without (a prefix filter), so a common word
doesn't bring every value together with every entry that holds it. Run-together
or split words are repaired as a whole in the same way: the squashed value
against the squashed names. Words around a value that name no entry are learned
from the values themselves. Everything works on distinct values; rows are joined
back at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.net_names import compatible_text
from ..session import cut_lineage
from ..tables import join_few

MAX_EDITS = 3
EDIT_COST, THRESHOLD = 0.06, 0.87
LOOK_ALIKES = ("0158", "oisb")  # digits that stand for letters within words, at no cost
OUTER = 2  # words that may stand before or behind a name
ANNOTATION_SHARE = 0.001  # of the distinct values that must hold such a word beside a literal name


def allowed_edits(length: Column) -> Column:
    """Edits by which a typed text may differ from a word of this length."""
    return F.when(length <= 2, 0).when(length <= 5, 1).otherwise(2)


def typed_tokens(value: Column) -> Column:
    """Lower-case words of a value: without what stands in brackets, look-alike digits within words as letters."""
    text = F.lower(F.regexp_replace(compatible_text(value), r"\([^)]*\)", " "))
    words = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return F.transform(words, lambda t: F.when(t.rlike(r"\p{L}"), F.translate(t, *LOOK_ALIKES)).otherwise(t))


def learned_annotations(typed: DataFrame, forms: DataFrame, repaired: DataFrame) -> list[str]:
    """Words that stand at the ends of values beside a literal name, are close to no word of the list, and do so often enough.

    At most 2 x `OUTER` / `ANNOTATION_SHARE` of them come to the driver.
    """
    n = typed.count()
    names = forms.select("kind", F.array_join("tokens", " ").alias("name")).distinct()
    cuts = [(i, j) for i in range(OUTER + 1) for j in range(OUTER + 1) if i + j]
    inner = lambda i, j: F.slice("tokens", i + 1, F.size("tokens") - i - j)
    part = lambda i, j: F.when(F.size("tokens") > i + j, F.struct(F.array_join(inner(i, j), " ").alias("name"), F.array_except(F.col("tokens"), inner(i, j)).alias("outer")))
    parts = typed.select("kind", "value", F.explode(F.array_compact(F.array(*[part(i, j) for i, j in cuts]))).alias("p")).select("kind", "value", "p.name", "p.outer")
    beside = join_few(parts, cut_lineage(names), ["kind", "name"], "inner", spread=["value"]).select("kind", "value", F.explode("outer").alias("typed")).distinct()
    unknown = beside.join(repaired.select("kind", "typed").distinct(), ["kind", "typed"], "left_anti")
    often = unknown.groupBy("typed").agg(F.count("*").alias("n")).filter(F.col("n") >= max(1, n * ANNOTATION_SHARE))
    return sorted(r["typed"] for r in often.collect())


def without_annotations(tokens: Column, annotations: list[str]) -> Column:
    """Tokens from the first to the last that is no annotation (or all, if all are)."""
    plain = F.transform(tokens, lambda t: ~t.isin(*annotations) if annotations else F.lit(True))
    first = F.array_position(plain, F.lit(True))
    last = F.size(tokens) + 1 - F.array_position(F.reverse(plain), F.lit(True))
    return F.when(first > 0, F.slice(tokens, first.cast("int"), (last - first + 1).cast("int"))).otherwise(tokens)


def _deleted_once(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda k: F.concat(F.substring(text, F.lit(1), k - 1), F.substring(text, k + 1, F.length(text))))


def deletions(text: Column, twice_from: int) -> Column:
    """The text and all that is left of it without one character, and from a length on without two."""
    none = F.array().cast("array<string>")
    once = F.when(F.length(text) > 2, _deleted_once(text)).otherwise(none)
    twice = F.when(F.length(text) >= twice_from, F.flatten(F.transform(once, _deleted_once))).otherwise(none)
    return F.array_distinct(F.concat(F.array(text), once, twice))


def _swapped(text: Column) -> Column:
    """The text with each pair of neighbours changed places."""
    places = F.when(F.length(text) > 1, F.sequence(F.lit(1), F.length(text) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        places, lambda k: F.concat(F.substring(text, F.lit(1), k - 1), F.substring(text, k + 1, F.lit(1)), F.substring(text, k, F.lit(1)), F.substring(text, k + 2, F.length(text)))
    )


def edits(a: Column, b: Column) -> Column:
    """Edit distance in which neighbours that changed places count once; exact up to 2, never too low beyond.

    A swap costs two plain edits, so plain distances up to 1 are final, 2 only
    differs for equal letters, and only 3 and 4 at nearly equal length need a try
    of every swap.
    """
    plain = F.levenshtein(a, b)
    letters = F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, ""))
    swaps = _swapped(a)
    after_one = F.array_min(F.transform(swaps, lambda s: F.levenshtein(s, b))) + 1
    swapped = F.least(plain, F.coalesce(after_one, plain))
    twice = F.when((swapped > 2) & F.arrays_overlap(swaps, _swapped(b)), 2).otherwise(swapped)
    near = F.abs(F.length(a) - F.length(b)) <= 1
    return F.when(plain <= 1, plain).when(plain == 2, F.when(letters, swapped).otherwise(2)).when((plain <= 4) & near, twice).otherwise(plain)


def close_texts(typed: DataFrame, words: DataFrame) -> DataFrame:
    """(kind, typed, word, edits) of distinct texts within the distance allowed for the word."""
    tasks = 2 * typed.sparkSession.sparkContext.defaultParallelism  # few bytes, but much work for each
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    few = typed.select("kind", "typed").filter(F.length("typed") <= longest + 2).repartition(tasks, "kind", "typed").distinct()
    left = few.select("kind", "typed", F.explode(deletions(F.col("typed"), 4)).alias("__part"))
    right = words.select("kind", "word").distinct().select("kind", "word", F.explode(deletions(F.col("word"), 6)).alias("__part"))
    met = left.join(right, ["kind", "__part"]).select("kind", "typed", "word").repartition(tasks, "kind", "typed", "word").distinct()
    return met.withColumn("edits", edits(F.col("typed"), F.col("word"))).filter(F.col("edits") <= allowed_edits(F.length("word")))


def reference_forms(reference: DataFrame) -> DataFrame:
    """Each accepted name of each entry with its tokens: (kind, ref_id, form, tokens)."""
    names = F.array_compact(F.concat(F.array("entry"), F.coalesce("aliases", F.array().cast("array<string>"))))
    forms = reference.select("kind", "ref_id", F.posexplode(names).alias("form", "name"))
    return forms.select("kind", "ref_id", "form", typed_tokens(F.col("name")).alias("tokens")).filter(F.size("tokens") > 0)


def weighted_forms(forms: DataFrame) -> DataFrame:
    """(kind, ref_id, form, form_pos, word, w, norm, rare): the tokens of every name with their weights, the rarer in the list the higher.

    `rare` is the weight of a word that no name has.
    """
    n_forms = forms.groupBy("kind").agg(F.count("*").alias("n_forms"))
    words = forms.select("kind", "ref_id", "form", F.posexplode("tokens").alias("form_pos", "word"))
    held = words.groupBy("kind", "word").agg(F.count("*").alias("held"))
    weighed = words.join(held, ["kind", "word"]).join(n_forms, "kind").withColumn("w", F.log1p(F.col("n_forms") / F.col("held")))
    norms = weighed.groupBy("kind", "ref_id", "form").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norms, ["kind", "ref_id", "form"]).select("kind", "ref_id", "form", "form_pos", "word", "w", "norm", F.log1p(F.col("n_forms")).alias("rare"))


def scored_names(typed: DataFrame, repaired: DataFrame, form_words: DataFrame) -> DataFrame:
    """(kind, value, ref_id, edits, score) of the names whose tokens are like those of a value, by soft TF-IDF.

    Every pair with a score of at least `THRESHOLD` comes out, and others that share
    a heavy token. Each token of a name takes its nearest token of the value, each
    token of a value goes to one token.
    """
    weights = form_words.groupBy("kind", "word").agg(F.first("w").alias("w"))
    repairs = join_few(repaired, cut_lineage(weights), ["kind", "word"], "inner", spread=["typed"])
    per_token = repairs.groupBy("kind", "typed").agg(F.collect_list(F.struct("word", "edits")).alias("repairs"), F.max("w").alias("w"))
    rare = form_words.groupBy("kind").agg(F.max("rare").alias("rare"))
    tokens = typed.select("kind", "value", F.posexplode("tokens").alias("pos", "typed")).join(per_token, ["kind", "typed"], "left")
    tokens = join_few(tokens, cut_lineage(rare), ["kind"], "inner", spread=["value"]).withColumn("w", F.coalesce("w", "rare"))
    tokens = tokens.repartition("kind", "value")
    whole = Window.partitionBy("kind", "value")
    heaviest = whole.orderBy(F.col("w").desc(), "pos")
    square = F.col("w") * F.col("w")
    ahead = F.coalesce(F.sum(square).over(heaviest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    all_ = F.sum(square).over(whole)
    # what lies behind this token could still reach the threshold by itself, or it is the first that can't
    tokens = tokens.withColumn("value_norm", F.sqrt(all_)).withColumn("leads", all_ - ahead >= all_ * THRESHOLD * THRESHOLD).filter("repairs is not null")
    tokens = cut_lineage(tokens.select("kind", "value", "pos", "typed", "repairs", F.col("w").alias("value_w"), "value_norm", "leads"))
    each = tokens.select("*", F.explode("repairs").alias("r")).select("kind", "value", "pos", "typed", "value_w", "value_norm", "leads", "r.word", "r.edits")
    asked = each.filter("leads").select("kind", "value", "word").distinct()
    heads = cut_lineage(form_words.select("kind", "word", "ref_id", "form").distinct())
    pairs = join_few(asked, heads, ["kind", "word"], "inner", spread=["value"]).select("kind", "value", "ref_id", "form").distinct()
    met = pairs.join(each, ["kind", "value"])
    matched = join_few(met, form_words.select("kind", "ref_id", "form", "word", "form_pos", "w", "norm"), ["kind", "ref_id", "form", "word"], "inner", spread=["value"])
    like = F.col("value_w") * F.col("w") * (1 - EDIT_COST * F.col("edits"))
    by_form = matched.groupBy("kind", "value", "ref_id", "form", "form_pos").agg(F.min(F.struct("edits", "pos", like.alias("part"), (F.col("value_norm") * F.col("norm")).alias("norms"))).alias("m"))
    by_token = by_form.groupBy("kind", "value", "ref_id", "form", F.col("m.pos").alias("pos")).agg(F.max(F.struct("m.part", (-F.col("m.edits")).alias("e"), "m.norms")).alias("m"))
    scores = by_token.groupBy("kind", "value", "ref_id", "form").agg(F.sum("m.part").alias("dot"), F.max("m.norms").alias("norms"), (-F.sum("m.e")).alias("edits"))
    return scores.select("kind", "value", "ref_id", "edits", (F.col("dot") / F.col("norms")).alias("score"))


def map_values(values: DataFrame, reference: DataFrame) -> DataFrame:
    """(kind, value, ref_id, edits, score, nearest_ref_id) of each distinct non-blank value; ref_id is 0 if no entry is meant.

    `values` has kind and value, `reference` kind, ref_id, entry and aliases. A
    value means the entry whose name has the highest soft TF-IDF score with its
    repaired tokens, if that is at least `THRESHOLD` and takes at most `MAX_EDITS`
    edits; a value that is a name run together or split wrongly, within so many
    edits, scores a little less than one of the same edits by tokens. If two
    entries are equally best, none is meant. `nearest_ref_id` is the best one even
    where it isn't good enough (null if nothing comes near). Null and blank values
    are left out; values longer than any name can't match. An empty list maps
    everything to 0.
    """
    forms = cut_lineage(reference_forms(reference))
    form_words = cut_lineage(weighted_forms(forms))
    word_list = form_words.select("kind", "word").distinct()
    distinct = values.filter(F.trim("value") != "").select("kind", "value").distinct()
    typed = cut_lineage(distinct.withColumn("tokens", typed_tokens(F.col("value"))))
    repaired = cut_lineage(close_texts(typed.select("kind", F.explode("tokens").alias("typed")), word_list))
    typed = typed.withColumn("tokens", without_annotations(F.col("tokens"), learned_annotations(typed, forms, repaired)))

    scored = cut_lineage(scored_names(typed, repaired, form_words))
    # a value that is a name as it stands can't do better run together
    settled = scored.filter(F.col("score") >= 1 - 1e-9).select("kind", "value").distinct()
    squashed = typed.join(settled, ["kind", "value"], "left_anti").select("kind", "value", F.array_join("tokens", "").alias("typed"))
    orders = forms.select("kind", "ref_id", F.explode(F.array_distinct(F.array(F.array_join("tokens", ""), F.array_join(F.reverse("tokens"), "")))).alias("word"))
    orders = cut_lineage(orders.distinct())
    whole = join_few(squashed.join(close_texts(squashed, orders), ["kind", "typed"]), orders, ["kind", "word"], "inner", spread=["value"])
    by_whole = whole.select("kind", "value", "ref_id", "edits", (0.999 * (1 - EDIT_COST * F.col("edits"))).alias("score"))

    every = scored.unionByName(by_whole)
    best = every.groupBy("kind", "value", "ref_id").agg(F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("edits")).alias("e"))).alias("r"))
    order = Window.partitionBy("kind", "value").orderBy(F.col("r").desc(), "ref_id")
    ranked = best.withColumn("__n", F.row_number().over(order)).withColumn("__next", F.lead("r").over(order)).filter("__n = 1")
    meant = (F.col("r.score") >= THRESHOLD) & (-F.col("r.e") <= MAX_EDITS) & (F.col("__next").isNull() | (F.col("__next") < F.col("r")))
    chosen = ranked.select("kind", "value", F.when(meant, F.col("ref_id")).otherwise(0).alias("ref_id"), (-F.col("r.e")).alias("edits"), F.col("r.score").alias("score"), F.col("ref_id").alias("nearest_ref_id"))
    return distinct.join(chosen, ["kind", "value"], "left").withColumn("ref_id", F.coalesce("ref_id", F.lit(0)).cast("bigint"))


def typed_fields(rules: DataFrame, manual: DataFrame) -> DataFrame:
    """(src, row_id, kind, value) of the freely typed fields, each distinct row once."""
    parts = [
        rules.filter("match_type = 'exact'").select(F.lit("net_rules.pattern").alias("src"), F.col("rule_no").alias("row_id"), F.lit("net_name").alias("kind"), F.col("pattern").alias("value")),
        rules.select(F.lit("net_rules.net_class").alias("src"), F.col("rule_no").alias("row_id"), F.lit("net_class").alias("kind"), F.col("net_class").alias("value")),
        manual.select(F.lit("manual_entries.net_name").alias("src"), F.col("entry_id").alias("row_id"), F.lit("net_name").alias("kind"), F.col("net_name").alias("value")),
    ]
    fields = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return fields.filter(F.trim("value") != "").dropDuplicates()


def mapped_fields(rules: DataFrame, manual: DataFrame, reference: DataFrame) -> DataFrame:
    """(src, row_id, kind, value, ref_id, nearest_ref_id, score) of all typed fields whose value is not literally an entry."""
    entries = reference.select("kind", F.col("entry").alias("value"), F.lit(True).alias("__literal")).distinct()
    fields = join_few(typed_fields(rules, manual), entries, ["kind", "value"], spread=["src", "row_id"]).filter("__literal is null").drop("__literal")
    mapped = map_values(fields, reference).select("kind", "value", "ref_id", "nearest_ref_id", "score")
    return fields.join(mapped, ["kind", "value"]).select("src", "row_id", "kind", "value", "ref_id", "nearest_ref_id", "score")
