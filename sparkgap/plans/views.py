"""Queries of the operators behind tables, overviews and pickers, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.layers import layer_key
from ..functions.net_names import normal_name
from ..operators import rules as rul
from ..operators import views
from ..operators.measurements import all_nets
from ..tables import table
from . import boards, found, sql
from .boards import _assigned, _board_shapes, _zone_sql, query

THRESHOLD_MM, DEBUG_LIMIT = 0.5, 200
_LAYERS = "layers AS (SELECT DISTINCT job_id, upper(trim(layer)) AS layer FROM measurements)"
_BLANKS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "measurements").select("job_id", layer_key(F.col("layer")).alias("layer")).distinct()


@query(f"""WITH {_LAYERS}, c AS (SELECT *, regexp_replace(lower(layer), '[^a-z0-9]+', '', 'g') AS c, row_number() OVER w AS i, count(*) OVER (PARTITION BY job_id) AS n FROM layers WINDOW w AS (PARTITION BY job_id ORDER BY layer))
SELECT job_id, layer, CASE WHEN c IN ('top','fcu','front','frontcu','topcu','signal1','sig1','l1','layer1') THEN 'top' WHEN c IN ('bottom','bot','bcu','back','backcu','bottomcu') THEN 'bottom' WHEN i = 1 THEN 'top' WHEN i = n THEN 'bottom' END AS side FROM c""")
def layer_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = Window.partitionBy("job_id")
    placed = _layers(spark, sf_dir).withColumn("i", F.row_number().over(whole.orderBy("layer"))).withColumn("n", F.count("*").over(whole))
    return placed.select("job_id", "layer", views.layer_side(F.col("layer"), F.col("i") == 1, F.col("i") == F.col("n")).alias("side"))


@query(r"""WITH t AS (SELECT DISTINCT symbol_id, raw_name, 'VIA_ROUNDD' || (symbol_id * 37 % 90000 + 1000) AS label FROM symbols),
n AS (SELECT symbol_id, raw_name, label, TRY_CAST(nullif(regexp_extract(raw_name, '(?i)ROUNDD?([0-9]{4,})', 1), '') AS DOUBLE) AS a, TRY_CAST(nullif(regexp_extract(trim(raw_name), '(?i)^r([0-9]*\.?[0-9]+)$', 1), '') AS DOUBLE) AS b, CAST(symbol_id * 37 % 90000 + 1000 AS DOUBLE) AS c FROM t)
SELECT symbol_id, raw_name, round(coalesce(CASE WHEN a >= 10000 THEN a / 1e6 ELSE a * 0.001 END, b * 0.001, CASE WHEN c >= 10000 THEN c / 1e6 ELSE c * 0.001 END), 9) AS diameter_mm FROM n""")
def via_pad_diameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.lit("VIA_ROUNDD"), (F.col("symbol_id") * 37 % 90000 + 1000).cast("string"))
    symbols = table(spark, sf_dir, "symbols").select("symbol_id", "raw_name").distinct()
    return symbols.select("symbol_id", "raw_name", F.round(views.via_pad_diameter(F.col("raw_name"), label), 9).alias("diameter_mm"))


@query(rf"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '{_BLANKS}', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 500 THEN t[1:497] || '...' ELSE t END AS line FROM t""")
def one_line_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", views.one_line(F.col("text")).alias("line"))


@query(f"SELECT measurement_id, CAST(CASE WHEN NOT isnan(clearance_mm) THEN round_even(greatest(0.0, least(1.0, clearance_mm / {THRESHOLD_MM})) * 10, 0) END AS INTEGER) AS bucket FROM measurements")
def gradient_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "measurements").select("measurement_id", views.gradient_bucket(F.col("clearance_mm"), THRESHOLD_MM).alias("bucket"))


_FIRST = r"[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"


@query(rf"""WITH t AS (SELECT DISTINCT symbol_id, trim(coalesce(raw_name, '')) AS t FROM symbols),
n AS (SELECT *, coalesce(CASE WHEN regexp_full_match(replace(t, ',', ''), '{_FIRST}') THEN TRY_CAST(replace(t, ',', '') AS DOUBLE) END, TRY_CAST(nullif(regexp_extract(t, '{_FIRST}'), '') AS DOUBLE)) AS v FROM t)
SELECT symbol_id, CASE WHEN t = '' THEN 2 WHEN v IS NOT NULL THEN 0 ELSE 1 END AS kind, CASE WHEN t <> '' AND v IS NOT NULL THEN v ELSE 0.0 END AS number, lower(t) AS text FROM n""")
def column_sort_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "symbols").select("symbol_id", F.trim(F.coalesce("raw_name", F.lit(""))).alias("raw_name")).distinct()
    return names.select("symbol_id", views.sort_key(F.col("raw_name")).alias("k")).select("symbol_id", "k.*")


@query(r"""WITH n AS (SELECT DISTINCT net_name, regexp_replace(regexp_replace(trim(net_name), '__', '_', 'g'), '^_+|_+$', '', 'g') AS t FROM features)
SELECT net_name, t AS designator FROM n WHERE regexp_full_match(t, '(?i)(?:R|RN|C|U|Q|D|J|P|H|L|TP|SW|S|Y|F|K|RV|RZ|FB|X)[0-9]+[A-Z0-9_\\-]*')""")
def part_designators(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "features").select("net_name").distinct()
    return names.select("net_name", views.part_designator(F.col("net_name")).alias("designator")).filter("designator is not null")


_DRAWN = """f AS (SELECT *, upper(trim(kind)) AS k, coalesce(upper(trim(polarity)) = 'P', false) AS positive FROM features
  QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY loaded_at DESC NULLS LAST, polarity NULLS LAST, net_name NULLS LAST, x NULLS LAST, y NULLS LAST, symbol_name NULLS LAST) = 1),
s AS (SELECT *, coalesce(isfinite(x) AND isfinite(y) AND (k = 'P' OR k = 'L' AND isfinite(x2) AND isfinite(y2)), false) AS placed FROM f)"""


@query(f"WITH {_DRAWN} SELECT feature_id, job_id, upper(trim(layer)) AS layer FROM s WHERE placed AND positive AND k = 'P'")
def drawable_pads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.drawable_pads(_board_shapes(spark, sf_dir)).select("feature_id", "job_id", "layer")


@query(f"""WITH {_DRAWN} SELECT job_id, upper(trim(layer)) AS layer, count(*) AS n_features, count(*) FILTER (WHERE NOT placed) AS n_without_shape, count(*) FILTER (WHERE placed AND NOT positive) AS n_cuts,
  count(*) FILTER (WHERE placed AND positive AND coalesce(net_name, '$NONE$') = '$NONE$') AS n_without_net, count(DISTINCT net_name) FILTER (WHERE placed AND positive AND net_name <> '$NONE$') AS n_nets FROM s GROUP BY ALL""")
def layer_feature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.layer_counts(_board_shapes(spark, sf_dir), ["job_id", "layer"])


@query(f"""WITH {_LAYERS}, present AS (SELECT job_id, upper(trim(layer)) AS layer, net_a AS net FROM measurements UNION SELECT job_id, upper(trim(layer)), net_b FROM measurements),
wanted AS (SELECT DISTINCT p.job_id, l.layer, p.net FROM present p JOIN layers l ON p.job_id = l.job_id WHERE starts_with(p.net, 'OPTO'))
SELECT w.job_id, w.layer, w.net FROM wanted w LEFT JOIN present p ON w.job_id = p.job_id AND w.layer = p.layer AND w.net = p.net WHERE p.net IS NULL""")
def missing_on_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "measurements")
    present = m.select("job_id", layer_key(F.col("layer")).alias("layer"), F.explode(F.array("net_a", "net_b")).alias("net")).distinct()
    return views.missing_on_layers(present.filter(F.startswith("net", F.lit("OPTO"))), present, _layers(spark, sf_dir), "job_id")


@query(f"SELECT measurement_id, job_id, layer, net_a, net_b, clearance_mm FROM measurements WHERE clearance_mm < {THRESHOLD_MM} AND NOT isnan(clearance_mm) ORDER BY clearance_mm, layer, net_a, net_b, measurement_id LIMIT {DEBUG_LIMIT}")
def debug_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.debug_pairs(table(spark, sf_dir, "measurements"), THRESHOLD_MM, DEBUG_LIMIT).select("measurement_id", "job_id", "layer", "net_a", "net_b", "clearance_mm")


@query(f"WITH {sql.LATEST} SELECT project_id, net_name, {_zone_sql('galvanic_zone')} IS NULL AS defaulted, CASE WHEN {_zone_sql('galvanic_zone')} IS NULL THEN 'Zone 1' ELSE galvanic_zone END AS galvanic_zone FROM assigned")
def default_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.with_default_zone(_assigned(spark, sf_dir)).select("project_id", "net_name", "defaulted", "galvanic_zone")


@query(f"""WITH {sql.LATEST} SELECT project_id, count(*) AS n_assigned, count(*) FILTER (WHERE final_class = 'UNKNOWN') AS n_unknown, count(*) FILTER (WHERE source = 'manual') AS n_manual,
  count(*) FILTER (WHERE {_zone_sql('galvanic_zone')} = 1) AS n_zone_1, count(*) FILTER (WHERE {_zone_sql('galvanic_zone')} = 2) AS n_zone_2 FROM assigned GROUP BY project_id""")
def overview_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.overview_counts(_assigned(spark, sf_dir), ["project_id"])


@query(f"""WITH {sql.LATEST} SELECT project_id, count(DISTINCT coalesce(final_class, '~')) > 1 AS final_class_mixed, count(DISTINCT coalesce(reference_net, '~')) > 1 AS reference_net_mixed, count(DISTINCT coalesce(source, '~')) > 1 AS source_mixed FROM assigned GROUP BY project_id""")
def mixed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.mixed_values(_assigned(spark, sf_dir), ["project_id"], ["final_class", "reference_net", "source"])


_FULL_WIDTH = "list_aggregate(list_transform(string_split(regexp_replace(net_name, '[\\p{Cc}\\p{Cf}]', '', 'g'), ''), lambda c: CASE WHEN c <> '' AND unicode(c) BETWEEN 65281 AND 65374 THEN chr(unicode(c) - 65248) ELSE c END), 'string_agg', '')"


@query(f"""WITH n AS (SELECT DISTINCT project_id, net_name AS net, {sql.NORMAL.format(_FULL_WIDTH)} AS normal FROM assignment_snapshots WHERE trim(net_name) <> ''),
w AS (SELECT DISTINCT project_id, net, unnest(list_distinct(list_filter(string_split(normal, '_'), lambda t: t <> ''))) AS word FROM n), e AS (SELECT project_id, min(net) AS net FROM n GROUP BY 1),
m AS (SELECT e.project_id, e.net, b.net AS other_net, list_sort(list(a.word)) AS words FROM e JOIN w a ON a.project_id = e.project_id AND a.net = e.net JOIN w b ON b.project_id = e.project_id AND b.word = a.word AND b.net <> e.net GROUP BY ALL)
SELECT project_id, net, other_net, 'shares ' || array_to_string(words, ', ') AS reason FROM m QUALIFY row_number() OVER (PARTITION BY project_id, net ORDER BY other_net) <= 12""")
def similar_nets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "assignment_snapshots").filter(F.trim("net_name") != "").select("project_id", F.col("net_name").alias("net")).distinct()
    nets = rows.withColumn("normal", normal_name(F.col("net")))
    edited = nets.groupBy("project_id").agg(F.min(F.struct("net", "normal")).alias("e")).select("project_id", "e.*")
    return views.similar_nets(nets, edited, ["project_id"])


@query(f"SELECT project_id, match_status, count(*) AS n_nets FROM ({found.ORACLES['p5_found']}) GROUP BY ALL")
def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found.p5_found(spark, sf_dir).groupBy("project_id", "match_status").agg(F.count("*").alias("n_nets"))


@query("SELECT project_id, count(DISTINCT net_name) AS n_nets FROM assignment_snapshots WHERE trim(net_name) <> '' AND upper(trim(net_name)) <> '$NONE$' GROUP BY project_id")
def project_net_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = table(spark, sf_dir, "assignment_snapshots")
    named = all_nets((snapshots, "net_name"))
    return snapshots.join(named, "net_name", "left_semi").groupBy("project_id").agg(F.count_distinct("net_name").alias("n_nets"))


# ---------------------------------------------------------------- rules over every name

_WIDE = "list_aggregate(list_transform(string_split({0}, ''), lambda c: CASE WHEN c <> '' AND unicode(c) BETWEEN 65281 AND 65374 THEN chr(unicode(c) - 65248) ELSE c END), 'string_agg', '')"
_BARE = "regexp_replace(net_name, '[\\p{Cc}\\p{Cf}]', '', 'g')"
_EVERY = f"""every AS (SELECT net_name, {_WIDE.format('net_name')} AS plain, {sql.NORMAL.format(_WIDE.format(_BARE))} AS normal FROM ({boards.ORACLES['distinct_net_union']}))"""
_WON = f"""{_EVERY}, n AS (SELECT * FROM every WHERE NOT regexp_matches(net_name, '[\\p{{Cc}}\\p{{Cf}}]')),
r(rule_order, rule_id, priority, kind_rank, len, match_type, match_on, pattern, net_class, confidence, severity) AS (VALUES {boards._rule_values()}),
hits AS (SELECT n.net_name, n.plain, n.normal, r.* FROM n JOIN r ON CASE r.match_type WHEN 'exact' THEN n.normal = r.pattern WHEN 'token' THEN list_contains(string_split(n.normal, '_'), r.pattern)
  WHEN 'prefix' THEN starts_with(n.normal, r.pattern) WHEN 'suffix' THEN suffix(n.normal, r.pattern) ELSE {boards._regex_case()} END),
won AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY net_name ORDER BY priority DESC, kind_rank DESC, len DESC, rule_id) = 1)"""


def _own_volts() -> str:
    return "CASE rule_id " + " ".join(f"WHEN '{r.rule_id}' THEN {r.voltage_v!r}" for r in rul.builtin_pack().rules if r.voltage_v is not None) + " END"


def _group(name: str) -> str:
    """What a rule's pattern takes out of the name under a group's name, for the rules that have it."""
    whens = []
    for r in rul.builtin_pack().rules:
        groups = re.compile(r.pattern).groupindex if r.match_type == "regex" else {}
        if name in groups:
            target, flags = ("net_name", "") if r.match_on == "raw" else ("normal", "(?i)")
            whens.append(f"WHEN '{r.rule_id}' THEN regexp_extract({target}, '{flags}{r.pattern}', {groups[name]})")
    return f"CASE rule_id {' '.join(whens)} END"


_OUTCOME = f"""{_WON}, parts AS (SELECT *, {_own_volts()} AS own, coalesce({_group("voltage")}, '') AS said, {_group("cells")} AS cells FROM won),
volts AS (SELECT *, coalesce(own, {boards._sql_volts("said")}, CASE net_class WHEN 'IO_DIGITAL' THEN 3.3 WHEN 'IO_ANALOG' THEN 3.3 WHEN 'POWER_VARIABLE' THEN 20.0 WHEN 'POWER_HIGHER_LOW_VOLTAGE' THEN 57.0 WHEN 'MAINS' THEN 230.0 END,
  {boards._sql_volts("plain")}) AS v FROM parts),
signed AS (SELECT *, CASE WHEN cells IS NOT NULL THEN CASE WHEN TRY_CAST(cells AS INTEGER) > 0 THEN TRY_CAST(cells AS INTEGER) * 4.3 END WHEN net_class = 'POWER_NEGATIVE' THEN -abs(v) ELSE v END AS final_v FROM volts)"""


@query(f"""WITH {_OUTCOME} SELECT e.net_name, s.rule_id AS matched_rule_id, CASE WHEN s.rule_id IS NULL THEN 'UNKNOWN' WHEN s.net_class = 'POWER' AND s.final_v < 0 THEN 'POWER_NEGATIVE' ELSE s.net_class END AS final_class,
  CAST(round(s.final_v, 9) AS DOUBLE) AS final_voltage_v, coalesce(s.severity, 'Review') AS severity, CASE WHEN s.confidence = 'High' AND s.severity IN ('Info', 'Review') AND s.net_class <> 'UNKNOWN' THEN 'Approved' ELSE 'Needs review' END AS review_state
FROM every e LEFT JOIN signed s ON e.net_name = s.net_name""")
def rule_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rul.classify_names(boards.distinct_net_union(spark, sf_dir), rul.builtin_pack())
    return got.select("net_name", "matched_rule_id", "final_class", F.round("final_voltage_v", 9).alias("final_voltage_v"), "severity", "review_state")


boards.ORACLES["net_normalize_all"] = f"WITH {_EVERY} SELECT net_name, normal, len(list_filter(string_split(normal, '_'), lambda t: t <> '')) AS n_tokens FROM every"
boards.ORACLES["voltage_token_all"] = f"WITH {_EVERY} SELECT net_name, {boards._sql_volts('plain')} AS volts FROM every"
boards.ORACLES["rule_classify_all"] = f"""WITH {_WON} SELECT e.net_name, w.rule_id AS matched_rule_id, coalesce(w.confidence, 'Unknown') AS confidence, coalesce(w.severity, 'Review') AS severity
FROM every e LEFT JOIN won w ON e.net_name = w.net_name"""
boards.ORACLES["rule_all_matches_all"] = f"WITH {_WON} SELECT net_name, string_agg(rule_id, ';' ORDER BY rule_order) AS rule_ids, count(*) AS n_rules FROM hits GROUP BY net_name"


# ---------------------------------------------------------------- close copper by brute force

_NUM = "([0-9]*[.]?[0-9]+)"
_BOXED = f"^(rect|oval){_NUM}x{_NUM}(xr{_NUM})?$"
_COPPER = f"""{_DRAWN}, sym AS (SELECT *, lower(trim(symbol_name)) AS sy FROM s WHERE placed AND positive AND net_name <> '$NONE$'),
dims AS (SELECT *, nullif(regexp_extract(sy, '{_BOXED}', 1), '') AS form, TRY_CAST(regexp_extract(sy, '{_BOXED}', 5) AS DOUBLE) / 1000 AS corner,
  coalesce(TRY_CAST(regexp_extract(sy, '^r{_NUM}$', 1) AS DOUBLE), TRY_CAST(regexp_extract(sy, '{_BOXED}', 2) AS DOUBLE), 1.0) / 1000 AS w,
  coalesce(TRY_CAST(regexp_extract(sy, '^r{_NUM}$', 1) AS DOUBLE), TRY_CAST(regexp_extract(sy, '{_BOXED}', 3) AS DOUBLE), 1.0) / 1000 AS h FROM sym),
turned AS (SELECT *, CASE WHEN form = 'rect' THEN least(coalesce(corner, 0.0), w / 2, h / 2) ELSE least(w, h) / 2 END AS pr, radians(coalesce(rotation_deg, 0.0)) AS t, sqrt(power(x2 - x, 2) + power(y2 - y, 2)) AS len FROM dims),
boxes AS (SELECT job_id, upper(trim(layer)) AS layer, net_name AS net, CASE WHEN k = 'P' THEN x ELSE (x + x2) / 2 END AS cx, CASE WHEN k = 'P' THEN y ELSE (y + y2) / 2 END AS cy,
  CASE WHEN k = 'P' THEN w / 2 - pr ELSE len / 2 END AS hx, CASE WHEN k = 'P' THEN h / 2 - pr ELSE 0.0 END AS hy, CASE WHEN k = 'P' THEN cos(t) WHEN len > 0 THEN (x2 - x) / len ELSE 1.0 END AS c,
  CASE WHEN k = 'P' THEN sin(t) WHEN len > 0 THEN (y2 - y) / len ELSE 0.0 END AS s, CASE WHEN k = 'P' THEN pr ELSE least(w, h) / 2 END AS r FROM turned),
sized AS (SELECT *, abs(hx * c) + abs(hy * s) + r AS ex, abs(hx * s) + abs(hy * c) + r AS ey FROM boxes)"""


def _far(a: str, b: str) -> list[str]:
    """How far each corner of box `a` lies from box `b`."""
    out = []
    for u in (-1, 1):
        for v in (-1, 1):
            dx, dy = (f"({a}.c{axis} + {u} * {a}.hx * {along} {sign} {v} * {a}.hy * {across} - {b}.c{axis})" for axis, along, sign, across in (("x", f"{a}.c", "-", f"{a}.s"), ("y", f"{a}.s", "+", f"{a}.c")))
            out.append(f"sqrt(power(greatest(abs({dx} * {b}.c + {dy} * {b}.s) - {b}.hx, 0), 2) + power(greatest(abs({dy} * {b}.c - {dx} * {b}.s) - {b}.hy, 0), 2))")
    return out


def _apart(o: str, a: str, b: str) -> str:
    """Whether an axis of box `o` separates two boxes."""
    c, s = f"abs({a}.c * {b}.c + {a}.s * {b}.s)", f"abs({a}.c * {b}.s - {a}.s * {b}.c)"
    other = b if o == a else a
    dx, dy = f"({b}.cx - {a}.cx)", f"({b}.cy - {a}.cy)"
    u, v = f"abs({dx} * {o}.c + {dy} * {o}.s)", f"abs({dy} * {o}.c - {dx} * {o}.s)"
    return f"{u} > {o}.hx + {other}.hx * {c} + {other}.hy * {s} OR {v} > {o}.hy + {other}.hx * {s} + {other}.hy * {c}"


boards.ORACLES["close_copper_pairs"] = f"""WITH {_COPPER}, met AS (SELECT p.job_id, p.layer, p.net AS net_a, q.net AS net_b,
  CASE WHEN NOT ({_apart('p', 'p', 'q')} OR {_apart('q', 'p', 'q')}) THEN 0.0 ELSE greatest(0.0, least({', '.join(_far('p', 'q') + _far('q', 'p'))}) - p.r - q.r) END AS d
  FROM sized p JOIN sized q ON p.job_id = q.job_id AND p.layer = q.layer AND p.net < q.net AND abs(p.cx - q.cx) <= p.ex + q.ex + {boards.CLOSE_MM} AND abs(p.cy - q.cy) <= p.ey + q.ey + {boards.CLOSE_MM})
SELECT job_id, layer, net_a, net_b, round(min(d), 6) AS clearance_mm FROM met WHERE d < {boards.CLOSE_MM} GROUP BY ALL"""
