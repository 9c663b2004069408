"""Classifying nets by rules on their names.

A rule pack is small and known when the plan is built, so it is compiled into
one projection: exact and token rules are looked up in a literal map, prefix,
suffix and regular-expression rules are tested one by one. The winner is the
least rank of the rules that match; ranks are given out once, on the driver. No
join of nets with rules, no shuffle, no Python for ASCII names.
"""

from __future__ import annotations

import csv
import functools
import json
import math
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.net_names import name_tokens, name_voltage, normal_name, rejected_name
from ..tables import settle

# Which layer of rules and which kind of match goes first.
LAYER_RANK = {"built-in": 0, "user-global": 1, "project-local": 2, "manual": 3}
KIND_RANK = {"regex": 0, "suffix": 1, "prefix": 1, "token": 2, "exact": 3}
# Volts that a class has if nothing else is known, and volts per battery cell.
CLASS_VOLTS = {"IO_DIGITAL": 3.3, "IO_ANALOG": 3.3, "POWER_VARIABLE": 20.0, "POWER_HIGHER_LOW_VOLTAGE": 57.0, "MAINS": 230.0}
CELL_VOLTS = 4.3
UNKNOWN_SEVERITY = "Review"
NO_RULE = ("No rule fits this name.", "Set its voltage by hand.")
REJECTED = ("The name can't be read as a net's.", "It holds control or format characters.")
BUILTIN = Path(__file__).with_name("builtin_pack")
HOW = {"exact": "the name is {}", "token": "a word of the name is {}", "prefix": "the name begins with {}", "suffix": "the name ends with {}", "regex": "the name fits {}"}
ASKED = {
    "BATTERY": "State the battery's highest voltage.", "HIGH_VOLTAGE": "State the highest voltage of this part of the board.", "MAINS": "State the mains voltage.",
    "ISOLATION_DOMAIN_HINT": "State the voltage of this side of the barrier.", "REFERENCE": "State the reference's voltage.",
}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    priority: int
    match_type: str
    match_on: str
    pattern: str
    net_class: str
    voltage_v: float | None = None
    reference_net: str = ""
    voltage_type: str = "UNKNOWN"
    confidence: str = "Unknown"
    severity: str = "Review"
    reason: str = ""
    warning: str = ""
    tags: tuple[str, ...] = ()
    enabled: bool = True
    cell_count_from_pattern: bool = False
    volts_per_cell: float | None = None
    source_layer: str = "built-in"
    source_file: str = ""
    issues: tuple[str, ...] = ()


@dataclass(frozen=True)
class RulePack:
    rules: tuple[Rule, ...]
    name: str = "builtin_default"
    class_volts: Mapping[str, float] = field(default_factory=lambda: dict(CLASS_VOLTS))
    cell_volts: float = CELL_VOLTS
    missing_files: tuple[str, ...] = ()
    unlisted_files: tuple[str, ...] = ()


@functools.cache
def builtin_pack() -> RulePack:
    """The rules that come with the engine, in their order, with words for what they found and ask."""
    pack = read_pack(str(BUILTIN))
    return replace(pack, rules=tuple(_with_words(r) for r in pack.rules), unlisted_files=())


def _with_words(rule: Rule) -> Rule:
    """A rule without a reason or warning gets plain ones from its kind, class and severity."""
    warning = "" if rule.severity == "Info" else ASKED.get(rule.net_class, "Check the voltage against the circuit.")
    return replace(rule, reason=rule.reason or f"{rule.net_class}: {HOW[rule.match_type].format(rule.pattern)}", warning=rule.warning or warning)


# ---------------------------------------------------------------- reading packs


def _number(text: object, issues: list[str], name: str) -> float | None:
    if text is None or str(text).strip() == "":
        return None
    try:
        return float(str(text).strip())
    except ValueError:
        issues.append(f"{name}: {text!r} is no number")
        return None


def _truth(text: object, default: bool) -> bool:
    if text is None or text == "":
        return default
    return str(text).strip().lower() not in ("0", "false", "no", "off", "")


def rule_from_fields(row: Mapping[str, object], *, layer: str, file: str) -> Rule:
    """A rule from a CSV or JSON record; values that don't fit are noted in `issues` and left at their default."""
    issues: list[str] = []
    text = lambda key, default="": str(row.get(key) if row.get(key) is not None else default).strip() or default
    priority = _number(row.get("priority"), issues, "priority")
    tags = row.get("tags") or ""
    tags = tags if isinstance(tags, list) else re.split(r"[;,]", str(tags))
    return Rule(
        rule_id=text("rule_id"), priority=int(priority or 0), match_type=text("match_type", "exact"), match_on=text("match_on", "normalized"),
        pattern=text("pattern"), net_class=text("net_class", "UNKNOWN"), voltage_v=_number(row.get("voltage_v"), issues, "voltage_v"),
        reference_net=text("reference_net"), voltage_type=text("voltage_type", "UNKNOWN"), confidence=text("confidence", "Unknown"),
        severity=text("severity", "Review"), reason=text("reason"), warning=text("warning"), tags=tuple(t.strip() for t in tags if t.strip()),
        enabled=_truth(row.get("enabled"), True), cell_count_from_pattern=_truth(row.get("cell_count_from_pattern"), False),
        volts_per_cell=_number(row.get("volts_per_cell"), issues, "volts_per_cell"), source_layer=layer, source_file=file, issues=tuple(issues),
    )


def _file_rules(path: Path, layer: str) -> list[Rule]:
    if path.suffix == ".csv":
        with path.open(encoding="utf-8-sig", newline="") as f:
            return [rule_from_fields(row, layer=layer, file=path.name) for row in csv.DictReader(f)]
    content = json.loads(path.read_text(encoding="utf-8-sig"))
    rows = content.get("rules", []) if isinstance(content, dict) else content
    return [rule_from_fields(row, layer=layer, file=path.name) for row in rows if isinstance(row, dict)]


def read_pack(folder: str, *, layer: str = "built-in") -> RulePack:
    """A folder with manifest.json, defaults.json and the rule files the manifest lists, in its order."""
    root = Path(folder)
    manifest = json.loads((root / "manifest.json").read_text(encoding="utf-8-sig"))
    listed = [str(f) for f in manifest.get("files", [])]
    defaults = json.loads((root / "defaults.json").read_text(encoding="utf-8-sig")) if (root / "defaults.json").exists() else {}
    rules = [r for f in listed if (root / f).exists() for r in _file_rules(root / f, layer)]
    others = {"manifest.json", "defaults.json", str(manifest.get("test_file", ""))}
    unlisted = sorted(p.name for p in root.iterdir() if p.suffix in (".csv", ".json") and p.name not in others and p.name not in listed)
    keys = {"IO_DIGITAL": "logic_io_v", "IO_ANALOG": "analog_io_v", "POWER_VARIABLE": "usb_pd_max_v", "POWER_HIGHER_LOW_VOLTAGE": "poe_voltage_v", "MAINS": "mains_rms_v"}
    volts = {c: float(defaults.get(k, CLASS_VOLTS[c])) for c, k in keys.items()}
    return RulePack(
        tuple(rules), str(manifest.get("pack_name", "")), volts, float(defaults.get("battery_volts_per_cell_max", CELL_VOLTS)), tuple(f for f in listed if not (root / f).exists()), tuple(unlisted)
    )


def with_local_rules(pack: RulePack, folder: str) -> RulePack:
    """The pack and a project's own rule files after it: all CSV files in order of name, then all JSON files."""
    root = Path(folder)
    files = [*sorted(root.glob("*.csv")), *sorted(root.glob("*.json"))] if root.is_dir() else []
    local = [r for f in files for r in _file_rules(f, "project-local")]
    return replace(pack, rules=(*pack.rules, *local))


# ---------------------------------------------------------------- compiling


def java_pattern(pattern: str) -> str | None:
    """A rule's pattern as the JVM reads it; None if it is no valid pattern (it then matches nothing)."""
    try:
        re.compile(pattern)
    except re.error:
        return None
    return re.sub(r"\(\?P<([A-Za-z][A-Za-z0-9]*)>", r"(?<\1>", re.sub(r"\(\?P=([A-Za-z][A-Za-z0-9]*)\)", r"\\k<\1>", pattern))


def python_normal_name(name: str) -> str:
    """The normal form of a pattern, on the driver."""
    import unicodedata

    text = unicodedata.normalize("NFKC", name).upper()
    return re.sub("_+", "_", text.translate(str.maketrans("-+. /", "_____"))).strip("_")


def ranked(pack: RulePack) -> list[Rule]:
    """Enabled rules, the one that wins first: layer, priority, kind, length of the pattern, then rule_id."""
    return sorted((r for r in pack.rules if r.enabled), key=lambda r: (-LAYER_RANK.get(r.source_layer, 0), -r.priority, -KIND_RANK.get(r.match_type, 0), -len(r.pattern), r.rule_id))


def _same_rank(a: Rule, b: Rule) -> bool:
    key = lambda r: (LAYER_RANK.get(r.source_layer, 0), r.priority, KIND_RANK.get(r.match_type, 0), len(r.pattern))
    return key(a) == key(b)


def _literal(value: object) -> str:
    """A value as SQL; tables of hundreds of values are parsed at once instead of being built one by one."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(map(_literal, value))})"
    if isinstance(value, float):
        return f"{value!r}D" if math.isfinite(value) else f"double('{value}')"
    return str(value)


def _table(values: Sequence[object], kind: str) -> Column:
    return F.expr(f"cast({_literal(list(values))} AS array<{kind}>)")


def _lookup(groups: Mapping[str, list[int]], key: Column) -> Column:
    none = F.array().cast("array<int>")
    if not groups:
        return none
    pairs = ", ".join(_literal(x) for text, ranks in groups.items() for x in (text, ranks))
    return F.coalesce(F.try_element_at(F.expr(f"map({pairs})"), key), none)


def matching_ranks(raw: Column, normal: Column, rules: list[Rule]) -> Column:
    """Ranks (from 0) of all rules that match a name, ascending."""
    exact: dict[str, dict[str, list[int]]] = {"raw": {}, "normalized": {}}
    token: dict[str, dict[str, list[int]]] = {"raw": {}, "normalized": {}}
    single = []
    for rank, rule in enumerate(rules):
        on = "raw" if rule.match_on == "raw" else "normalized"
        target = raw if on == "raw" else normal
        pattern = rule.pattern if on == "raw" else python_normal_name(rule.pattern)
        if rule.match_type == "exact":
            exact[on].setdefault(pattern, []).append(rank)
        elif rule.match_type == "token":
            token[on].setdefault(pattern, []).append(rank)
        elif rule.match_type in ("prefix", "suffix"):
            single.append(F.when(target.startswith(pattern) if rule.match_type == "prefix" else target.endswith(pattern), rank))
        elif rule.match_type == "regex" and (found := java_pattern(rule.pattern)) is not None:
            single.append(F.when(target.rlike(found if on == "raw" else f"(?i){found}"), rank))
    parts = [_lookup(exact["normalized"], normal), _lookup(exact["raw"], raw)]
    if token["normalized"]:
        parts.append(F.flatten(F.transform(name_tokens(normal), lambda t: _lookup(token["normalized"], t))))
    if token["raw"]:
        parts.append(F.flatten(F.transform(F.filter(F.split(raw, "_"), lambda t: t != ""), lambda t: _lookup(token["raw"], t))))
    if single:
        parts.append(F.array_compact(F.array(*single)))
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def rules_frame(spark: SparkSession, pack: RulePack) -> DataFrame:
    """The pack as a small table with `rank` and `order` (its place in the pack)."""
    order = {id(r): k for k, r in enumerate(pack.rules)}
    best = ranked(pack)
    rows = [
        (k, order[id(r)], r.rule_id, r.net_class, r.voltage_v, r.reference_net, r.voltage_type, r.confidence, r.severity, r.reason, r.warning, r.pattern, r.source_file)
        for k, r in enumerate(best)
    ]
    schema = (
        "rank int, rule_order int, rule_id string, net_class string, rule_voltage_v double, reference_net string, voltage_type string, confidence string,"
        " severity string, reason string, rule_warning string, pattern string, source_file string"
    )
    return spark.createDataFrame(rows, schema)


def _winner_volts(winner: Column, raw: Column, normal: Column, rules: list[Rule], pack: RulePack) -> Column:
    """Volts of the winning rule: cells, then the rule's own, then its pattern's, then its class's, then the name's."""
    numbers = lambda values: F.get(_table([None if v is None else float(v) for v in values], "double"), winner)
    by_cells, by_group = F.lit(None).cast("double"), F.lit(None).cast("string")
    for rank, rule in enumerate(rules):
        pattern = java_pattern(rule.pattern) if rule.match_type == "regex" else None
        if pattern is None:
            continue
        target, pattern = (raw, pattern) if rule.match_on == "raw" else (normal, f"(?i){pattern}")
        compiled = re.compile(rule.pattern)
        if rule.cell_count_from_pattern and compiled.groups:
            cells = F.regexp_extract(target, pattern, compiled.groupindex.get("cells", 1)).try_cast("int")
            by_cells = F.when(winner == rank, F.when(cells > 0, cells * float(rule.volts_per_cell or pack.cell_volts))).otherwise(by_cells)
        elif rule.voltage_v is None and "voltage" in compiled.groupindex:
            by_group = F.when(winner == rank, F.regexp_extract(target, pattern, compiled.groupindex["voltage"])).otherwise(by_group)
    own = numbers([r.voltage_v for r in rules])
    of_class = numbers([pack.class_volts.get(r.net_class) for r in rules])
    volts = F.coalesce(own, name_voltage(by_group), of_class, name_voltage(raw))
    negative = F.get(_table([r.net_class == "POWER_NEGATIVE" for r in rules], "boolean"), winner)
    counts_cells = F.get(_table([r.cell_count_from_pattern for r in rules], "boolean"), winner)
    return F.when(counts_cells, by_cells).when(negative, -F.abs(volts)).otherwise(volts)


def classify_names(names: DataFrame, pack: RulePack, *, net: str = "net_name") -> DataFrame:
    """Each row of `names` with the outcome of the rules.

    Adds final_class, final_voltage_v, reference_net, voltage_type, confidence,
    severity, review_state, source, matched_rule_id, all_matched_rule_ids (in the
    pack's order), reason and warning. Names that hold control or format
    characters match nothing and are left to review; a null name counts as an
    empty one. Rows stay as they are, so pass distinct names where names repeat.
    """
    rules = ranked(pack)
    raw = F.coalesce(F.col(net), F.lit(""))
    rejected = rejected_name(raw)
    step = settle(names, __normal=normal_name(raw), __bad=rejected)
    matched = F.when(~F.col("__bad"), matching_ranks(raw, F.col("__normal"), rules)).otherwise(F.array().cast("array<int>"))
    step = settle(step, __ranks=matched)
    frame = F.broadcast(rules_frame(names.sparkSession, pack))
    winner = F.try_element_at(F.col("__ranks"), F.lit(1))
    ties = [k for k, (a, b) in enumerate(zip(rules, rules[1:])) if _same_rank(a, b)]
    second = F.try_element_at(F.col("__ranks"), F.lit(2))
    level = _table(list(_levels(rules).values()), "int")
    tied = (F.get(level, winner) == F.get(level, second)) if ties else F.lit(False)
    ids = _table([r.rule_id for r in rules], "string")
    order = {id(r): k for k, r in enumerate(pack.rules)}
    places = _table([order[id(r)] for r in rules], "int")
    joined = step.join(frame, F.col("rank") == winner, "left")
    if rules:
        joined = settle(joined, __volts=_winner_volts(F.col("rank"), raw, F.col("__normal"), rules, pack))
    volts = F.col("__volts") if rules else F.lit(None).cast("double")
    final_class = F.when(F.col("rank").isNull(), "UNKNOWN").when((F.col("net_class") == "POWER") & (volts < 0), "POWER_NEGATIVE").otherwise(F.col("net_class"))
    conflict = F.concat(
        F.lit(" Rules "), F.get(ids, winner), F.lit(" and "), F.get(ids, second), F.lit(" rank alike; the first by name counts.")
    )
    in_order = F.transform(
        F.array_sort(F.transform(F.col("__ranks"), lambda r: F.struct(F.get(places, r).alias("o"), F.get(ids, r).alias("i")))), lambda s: s["i"]
    )
    unknown = F.col("rank").isNull()
    state = F.when(~unknown & (F.col("confidence") == "High") & F.col("severity").isin("Info", "Review") & (final_class != "UNKNOWN"), "Approved").otherwise("Needs review")
    kept = [F.col(c) for c in names.columns]
    return joined.select(
        *kept,
        final_class.alias("final_class"),
        volts.alias("final_voltage_v"),
        F.coalesce("reference_net", F.lit("")).alias("reference_net"),
        F.coalesce("voltage_type", F.lit("UNKNOWN")).alias("voltage_type"),
        F.coalesce("confidence", F.lit("Unknown")).alias("confidence"),
        F.coalesce("severity", F.lit(UNKNOWN_SEVERITY)).alias("severity"),
        state.alias("review_state"),
        F.when(unknown, "unknown").otherwise("rule").alias("source"),
        F.col("rule_id").alias("matched_rule_id"),
        in_order.alias("all_matched_rule_ids"),
        F.when(F.col("__bad"), REJECTED[0]).when(unknown, NO_RULE[0]).otherwise(F.col("reason")).alias("reason"),
        F.when(F.col("__bad"), REJECTED[1])
        .when(unknown, NO_RULE[1])
        .otherwise(F.trim(F.concat(F.col("rule_warning"), F.when(tied, conflict).otherwise(F.lit("")))))
        .alias("warning"),
    )


def _levels(rules: list[Rule]) -> dict[int, int]:
    """Rank to level: rules of one level differ only in their rule_id."""
    out, level = {}, 0
    for k, rule in enumerate(rules):
        if k and not _same_rank(rules[k - 1], rule):
            level += 1
        out[k] = level
    return out


def self_test(spark: SparkSession, pack: RulePack | None = None) -> DataFrame:
    """The pack's self-test: one row per case with what was wanted, what came out, and `passed`."""
    with (BUILTIN / "self_test.csv").open(encoding="utf-8", newline="") as lines:
        cases = [[text or None for text in case.values()] for case in csv.DictReader(lines)]
    rows = [(n, c, float(v) if v else None, f, s, r) for n, c, v, f, s, r in cases]
    table = spark.createDataFrame(rows, "net_name string, want_class string, want_v double, want_confidence string, want_severity string, want_state string")
    got = classify_names(table, pack or builtin_pack())
    agree = lambda want, have: F.col(want).isNull() | F.col(want).eqNullSafe(F.col(have))
    volts = F.col("want_v").isNull() | (F.abs(F.col("want_v") - F.col("final_voltage_v")) < 1e-9)
    passed = agree("want_class", "final_class") & volts & agree("want_confidence", "confidence") & agree("want_severity", "severity") & agree("want_state", "review_state")
    return got.withColumn("passed", F.coalesce(passed, F.lit(False)))


def pack_problems(pack: RulePack, classes: Iterable[str], kinds: Iterable[str]) -> list[str]:
    """What is wrong with a pack: words outside the vocabulary, double ids, invalid patterns, files."""
    out, seen = [], set()
    for r in pack.rules:
        if r.rule_id in seen:
            out.append(f"{r.rule_id}: used twice")
        seen.add(r.rule_id)
        if r.net_class not in set(classes):
            out.append(f"{r.rule_id}: class {r.net_class!r}")
        if r.match_type not in set(kinds):
            out.append(f"{r.rule_id}: match_type {r.match_type!r}")
        if not r.pattern:
            out.append(f"{r.rule_id}: no pattern")
        if r.match_type == "regex" and java_pattern(r.pattern) is None:
            out.append(f"{r.rule_id}: invalid pattern")
        out += [f"{r.rule_id}: {i}" for i in r.issues]
    return out + [f"missing file {f}" for f in pack.missing_files] + [f"unlisted file {f}" for f in pack.unlisted_files]
