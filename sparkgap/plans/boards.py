"""Queries of the spacing, voltage, rule and assignment operators over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import estimators as est
from ..functions.layers import layer_key
from ..functions.net_names import name_tokens, name_voltage, normal_name
from ..geometry.compositing import composited_pairs
from ..geometry.near_gaps import near_gaps
from ..geometry.shapes import with_shapes
from ..operators import assignments as asg
from ..operators import measurements as mea
from ..operators import requirements as req
from ..operators import rules as rul
from ..operators import spacing as spc
from ..operators.reject_rows import load_delimited
from ..operators.revision_match import match_revisions
from ..session import cut_lineage
from ..tables import join_few, settle, table
from ..vocabulary import CONFIDENCES, NET_CLASSES, REVIEW_STATES, SEVERITIES
from . import sql
from .found import ASSIGNMENT_RULES, JUDGED_LINES

THRESHOLD_MM = 0.2
CLOSE_MM = 1.0
ZONES = req.zone_voltages({"Zone 1": {"Zone 3": 750.0}, "Zone 2": {"Zone 4": 1500.0}})
LOW_ZONES = req.zone_voltages([[0, 24.0, 750.0], [24.0, 0, 1000.0, 1500.0]])
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql_text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql_text:
            ORACLES[f.__name__] = sql_text
        return f

    return add


def _measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "measurements")


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each project's last revision, each net once."""
    snapshots = table(spark, sf_dir, "assignment_snapshots")
    newest = Window.partitionBy("project_id")
    last = snapshots.withColumn("__last", F.max("rev_no").over(newest)).filter(F.col("rev_no") == F.col("__last")).drop("__last")
    return asg.last_of_each(last, ["project_id", "net_name"], [F.col("loaded_at").desc_nulls_last(), F.col("row_id").desc_nulls_last()])


# ---------------------------------------------------------------- estimators



@query(f"""SELECT measurement_id, CASE WHEN clearance_mm >= 0 AND NOT isnan(clearance_mm) THEN round({sql.effective("clearance_mm", "1.0", sql.altitude("5500.0"))}, 6) END AS volts FROM measurements""")
def effective_voltage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measurements(spark, sf_dir).select("measurement_id", F.round(est.effective_voltage(F.col("clearance_mm")), 6).alias("volts"))


@query(f"""SELECT measurement_id, CASE WHEN clearance_mm >= 0 AND NOT isnan(clearance_mm) THEN round({sql.ipc("clearance_mm", 1)}, 6) END AS internal_v,
  CASE WHEN clearance_mm >= 0 AND NOT isnan(clearance_mm) THEN round({sql.ipc("clearance_mm", 2)}, 6) END AS external_v,
  CASE WHEN clearance_mm >= 0 AND NOT isnan(clearance_mm) THEN round({sql.ipc("clearance_mm", 3)}, 6) END AS high_v FROM measurements""")
def ipc_voltage(spark: SparkSession, sf_dir: str) -> DataFrame:
    volts = lambda role, h, name: F.round(est.ipc_voltage(F.col("clearance_mm"), F.lit(role), h), 6).alias(name)
    return _measurements(spark, sf_dir).select("measurement_id", volts("internal", 0.0, "internal_v"), volts("external", 0.0, "external_v"), volts("external", 5500.0, "high_v"))


@query(f"SELECT p_partkey, round({sql.altitude('(p_retailprice * 5)')}, 6) AS factor FROM part")
def altitude_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(est.altitude_factor(F.col("p_retailprice").cast("double") * 5), 6).alias("factor"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN cti >= 600 THEN 'I' WHEN cti >= 400 THEN 'II' WHEN cti >= 175 THEN 'IIIa' WHEN cti >= 100 THEN 'IIIb' ELSE 'below IIIb' END AS material
FROM (SELECT l_orderkey, l_linenumber, CAST(l_tax AS DOUBLE) * 10000 AS cti FROM lineitem)""")
def material_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", est.material_group(F.col("l_tax").cast("double") * 10000).alias("material"))


@query("""WITH layers AS (SELECT DISTINCT job_id, upper(trim(layer)) AS layer FROM measurements),
placed AS (SELECT job_id, layer, row_number() OVER (PARTITION BY job_id ORDER BY layer) - 1 AS i, count(*) OVER (PARTITION BY job_id) AS n FROM layers)
SELECT job_id, layer, CASE WHEN layer IN ('F.CU', 'B.CU') THEN 'external' WHEN n <= 2 OR i = 0 OR i = n - 1 THEN 'external' ELSE 'internal' END AS layer_role FROM placed""")
def layer_role_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = _measurements(spark, sf_dir).select("job_id", layer_key(F.col("layer")).alias("layer")).distinct()
    return mea.layer_roles(layers, "job_id", "layer", "layer")


@query(f"""WITH m AS (SELECT measurement_id, clearance_mm, greatest(0.0, clearance_mm - 0.05) AS d FROM measurements)
SELECT measurement_id, CASE WHEN clearance_mm >= 0 AND NOT isnan(clearance_mm) THEN round({sql.effective("d", "0.7 * 1.65", sql.altitude("1000.0"))}, 6) END AS effective_v,
  CASE WHEN clearance_mm >= 0 AND NOT isnan(clearance_mm) THEN round({sql.ipc("clearance_mm", 2)}, 6) END AS ipc_v FROM m""")
def voltage_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every layer rated by the role `external`, as an override; `voltage_recompute_by_role` rates each by its own."""
    new = mea.recomputed_voltages(_measurements(spark, sf_dir), roles="external", cti=600, pollution=3, altitude_m=1000.0, particle_mm=0.05)
    return new.select("measurement_id", F.round("effective_max_voltage_v", 6).alias("effective_v"), F.round("ipc2221a_max_voltage_v", 6).alias("ipc_v"))


def _by_role(internal: str, external: str) -> str:
    usable = "clearance_mm >= 0 AND NOT isnan(clearance_mm)"
    return f"CASE WHEN {usable} AND layer_role = 'internal' THEN round({internal}, 6) WHEN {usable} THEN round({external}, 6) END"


@query(f"""WITH layers AS (SELECT DISTINCT job_id, upper(trim(layer)) AS layer FROM measurements),
placed AS (SELECT job_id, layer, row_number() OVER (PARTITION BY job_id ORDER BY CASE layer WHEN 'F.CU' THEN 0 WHEN 'B.CU' THEN 2 ELSE 1 END, TRY_CAST(regexp_extract(layer, '[0-9]+') AS INTEGER), layer) - 1 AS i,
  count(*) OVER (PARTITION BY job_id) AS n FROM layers),
roles AS (SELECT job_id, layer, CASE WHEN layer IN ('F.CU', 'B.CU') OR n <= 2 OR i = 0 OR i = n - 1 THEN 'external' ELSE 'internal' END AS layer_role FROM placed),
m AS (SELECT measurement_id, clearance_mm, greatest(0.0, clearance_mm - 0.05) AS d, layer_role FROM measurements JOIN roles ON measurements.job_id = roles.job_id AND upper(trim(measurements.layer)) = roles.layer)
SELECT measurement_id, layer_role, {_by_role(sql.effective("clearance_mm", "0.7 * 0.55", sql.altitude("1000.0")), sql.effective("d", "0.7 * 1.65", sql.altitude("1000.0")))} AS effective_v,
  {_by_role(sql.ipc("clearance_mm", 1), sql.ipc("clearance_mm", 2))} AS ipc_v FROM m""")
def voltage_recompute_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _measurements(spark, sf_dir)
    new = mea.recomputed_voltages(m, roles=mea.measured_layer_roles(m), cti=600, pollution=3, altitude_m=1000.0, particle_mm=0.05)
    return new.select("measurement_id", "layer_role", F.round("effective_max_voltage_v", 6).alias("effective_v"), F.round("ipc2221a_max_voltage_v", 6).alias("ipc_v"))


# ---------------------------------------------------------------- measurements


@query(f"SELECT measurement_id, job_id, layer, net_a, net_b, clearance_mm FROM measurements WHERE clearance_mm < {THRESHOLD_MM} AND NOT isnan(clearance_mm)")
def critical_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mea.critical_pairs(_measurements(spark, sf_dir), THRESHOLD_MM).select("measurement_id", "job_id", "layer", "net_a", "net_b", "clearance_mm")


@query("""WITH roles AS (
  SELECT job_id, net_a AS net, net_b AS other_net, clearance_mm, layer, net_a, net_b FROM measurements WHERE clearance_mm IS NOT NULL AND NOT isnan(clearance_mm)
  UNION ALL SELECT job_id, net_b, net_a, clearance_mm, layer, net_a, net_b FROM measurements WHERE clearance_mm IS NOT NULL AND NOT isnan(clearance_mm))
SELECT job_id, net, clearance_mm AS min_clearance_mm, layer, other_net FROM roles
QUALIFY row_number() OVER (PARTITION BY job_id, net ORDER BY clearance_mm, layer, net_a, net_b) = 1""")
def per_net_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mea.per_net_minimum(_measurements(spark, sf_dir), ["job_id"]).select("job_id", "net", "min_clearance_mm", "layer", "other_net")


@query("""WITH iso AS (SELECT DISTINCT job_id, net FROM (SELECT job_id, net_a AS net FROM measurements UNION ALL SELECT job_id, net_b FROM measurements) WHERE starts_with(net, 'OPTO')),
m AS (SELECT m.*, a.net IS NOT NULL AS in_a, b.net IS NOT NULL AS in_b FROM measurements m
  LEFT JOIN iso a ON m.job_id = a.job_id AND m.net_a = a.net LEFT JOIN iso b ON m.job_id = b.job_id AND m.net_b = b.net WHERE clearance_mm IS NOT NULL AND NOT isnan(clearance_mm))
SELECT job_id, layer, CASE WHEN in_a THEN net_a ELSE net_b END AS isolated_net, CASE WHEN in_a THEN net_b ELSE net_a END AS other_net, clearance_mm AS measured_mm,
  round(clearance_mm - 0.6, 6) AS margin_mm, CASE WHEN clearance_mm - 0.6 >= 0 THEN 'PASS' ELSE 'FAIL' END AS result FROM m WHERE in_a <> in_b""")
def isolation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _measurements(spark, sf_dir)
    nets = m.select("job_id", F.explode(F.array("net_a", "net_b")).alias("net")).filter(F.startswith("net", F.lit("OPTO")))
    checked = mea.isolation_check(m, nets, clearance_mm=0.3, creepage_mm=0.5, factor=1.2, scope=["job_id"])
    return checked.select("job_id", "layer", "isolated_net", "other_net", "measured_mm", F.round("margin_mm", 6).alias("margin_mm"), "result")


@query("""SELECT job_id, upper(trim(layer)) AS layer, count(*) AS n_pairs, count(DISTINCT net_a) AS n_nets_a, min(clearance_mm) FILTER (WHERE NOT isnan(clearance_mm)) AS least_mm,
  count(*) FILTER (WHERE clearance_mm < 0.2 AND NOT isnan(clearance_mm)) AS n_critical FROM measurements GROUP BY ALL""")
def layer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.when(~F.isnan("clearance_mm"), F.col("clearance_mm"))
    return (
        _measurements(spark, sf_dir)
        .groupBy("job_id", layer_key(F.col("layer")).alias("layer"))
        .agg(F.count("*").alias("n_pairs"), F.count_distinct("net_a").alias("n_nets_a"), F.min(c).alias("least_mm"), F.count_if(c < THRESHOLD_MM).alias("n_critical"))
    )


@query("""SELECT DISTINCT net AS net_name FROM (SELECT net_a AS net FROM measurements UNION ALL SELECT net_b FROM measurements UNION ALL SELECT net_name FROM features UNION ALL
  SELECT net_name FROM manual_entries UNION ALL SELECT net_name FROM assignment_snapshots) WHERE trim(net) <> '' AND upper(trim(net)) <> '$NONE$'""")
def distinct_net_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _measurements(spark, sf_dir)
    others = [(table(spark, sf_dir, t), "net_name") for t in ("features", "manual_entries", "assignment_snapshots")]
    return mea.all_nets((m, "net_a"), (m, "net_b"), *others)


@query("SELECT measurement_id, net_a, net_b FROM measurements WHERE contains(lower(net_a), 'gn') AND contains(lower(net_a), 'd')")
def token_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measurements(spark, sf_dir).filter(mea.matches_all_tokens(F.col("net_a"), "GN; d")).select("measurement_id", "net_a", "net_b")


@query("""WITH s AS (SELECT l_orderkey, CAST(l_quantity AS DOUBLE) AS a, CAST(l_quantity AS DOUBLE) + CAST(l_discount AS DOUBLE) * 100 AS b FROM lineitem),
o AS (SELECT *, max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s WHERE b > a)
SELECT l_orderkey, round(sum(greatest(0, b - greatest(a, coalesce(before, a)))), 6) AS covered FROM o GROUP BY l_orderkey""")
def interval_union_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("double")
    spans = table(spark, sf_dir, "lineitem").select("l_orderkey", q.alias("start"), (q + F.col("l_discount").cast("double") * 100).alias("end"))
    return mea.blocked_length(spans, ["l_orderkey"]).select("l_orderkey", F.round("covered", 6).alias("covered"))


# ---------------------------------------------------------------- geometry


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_regionkey", "n_nationkey", "n_name")


def _box(cx, cy, hx, hy, r=0.0):
    return F.struct(
        cx.cast("double").alias("cx"), cy.cast("double").alias("cy"), F.lit(hx).cast("double").alias("hx"), F.lit(hy).cast("double").alias("hy"), F.lit(1.0).alias("c"), F.lit(0.0).alias("s"), F.lit(r).alias("r")
    )


_AT = "(s_suppkey * 37 % 1009) AS x, (s_suppkey * 91 % 997) AS y"


@query(f"""WITH b AS (SELECT n_regionkey, s_name AS net, {_AT} FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT p.n_regionkey, p.net AS net_a, q.net AS net_b, round(sqrt(power(greatest(0, abs(p.x - q.x) - 8.0), 2) + power(greatest(0, abs(p.y - q.y) - 4.0), 2)), 6) AS clearance_mm
FROM b p JOIN b q ON p.n_regionkey = q.n_regionkey AND p.net < q.net""")
def pair_clearance_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _suppliers(spark, sf_dir)
    shapes = s.select("n_regionkey", F.col("s_name").alias("net_name"), _box(F.col("s_suppkey") * 37 % 1009, F.col("s_suppkey") * 91 % 997, 4.0, 2.0).alias("shape"))
    return spc.all_net_pairs(shapes, ["n_regionkey"]).withColumn("clearance_mm", F.round("clearance_mm", 6))


@query(f"""WITH b AS (SELECT n_regionkey, s_name AS net, {_AT} FROM supplier JOIN nation ON s_nationkey = n_nationkey),
d AS (SELECT p.n_regionkey, p.net AS net_a, q.net AS net_b, greatest(0, sqrt(power(p.x - q.x, 2) + power(p.y - q.y, 2)) - 6.0) AS d FROM b p JOIN b q ON p.n_regionkey = q.n_regionkey AND p.net < q.net)
SELECT n_regionkey, net_a, net_b, round(d, 6) AS clearance_mm FROM d WHERE d < 60.0""")
def pair_clearance_discs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _suppliers(spark, sf_dir)
    shapes = s.select("n_regionkey", F.col("s_name").alias("net_name"), _box(F.col("s_suppkey") * 37 % 1009, F.col("s_suppkey") * 91 % 997, 0.0, 0.0, 3.0).alias("shape"))
    return spc.close_net_pairs(shapes, 60.0, ["n_regionkey"], cell_mm=70.0).withColumn("clearance_mm", F.round("clearance_mm", 6))


def _deliveries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    """The features, and the order in which the first of several deliveries of one counts."""
    features = table(spark, sf_dir, "features").withColumn("layer", layer_key(F.col("layer")))
    newest = [F.col("loaded_at").desc_nulls_last()] if "loaded_at" in features.columns else []
    return features, [*newest, *[F.col(c).asc_nulls_last() for c in ("polarity", "net_name", "x", "y", "symbol_name")]]


def _board_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    features, order = _deliveries(spark, sf_dir)
    return with_shapes(asg.last_of_each(features, ["feature_id"], order))


REPEATED_IDS = 250_000  # broadcast: one number each


def _unmoved_board_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of `_board_shapes`; only features delivered several times are shuffled."""
    features, order = _deliveries(spark, sf_dir)
    ids = cut_lineage(features.groupBy("feature_id").count().filter("count > 1").select("feature_id", F.lit(True).alias("__again")))
    marked = join_few(features, ids, ["feature_id"], null_safe=True, most=REPEATED_IDS)
    again = asg.last_of_each(marked.filter("__again"), ["feature_id"], order)
    return with_shapes(marked.filter("__again is null").unionByName(again).drop("__again"))


@query()
def close_copper_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spc.close_net_pairs(spc.copper(_board_shapes(spark, sf_dir)), CLOSE_MM, ["job_id", "layer"]).withColumn("clearance_mm", F.round("clearance_mm", 6))


@query()
def composited_copper_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composited_pairs(_board_shapes(spark, sf_dir), CLOSE_MM, ["job_id", "layer"]).withColumn("clearance_mm", F.round("clearance_mm", 6))


@query()
def effective_air_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = ["job_id", "layer"]
    gaps = near_gaps(_unmoved_board_shapes(spark, sf_dir), CLOSE_MM, scope)
    return gaps.select(*scope, "net_a", "net_b", *[F.round(c, 6).alias(c) for c in ("direct_clearance_mm", "effective_air_gap_mm", "copper_blocked_length_mm")], "copper_on_path", "blocker_nets")


@query("""WITH f AS (SELECT DISTINCT ON (feature_id) * FROM features), s AS (SELECT job_id, upper(trim(layer)) AS layer, x, y, CAST(regexp_extract(symbol_name, '^r([0-9.]+)$', 1) AS DOUBLE) / 2000 AS r
  FROM f WHERE upper(trim(kind)) = 'P' AND regexp_full_match(symbol_name, 'r[0-9.]+') AND x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y))
SELECT job_id, layer, round(min(x - r), 6) AS min_x, round(min(y - r), 6) AS min_y, round(max(x + r), 6) AS max_x, round(max(y + r), 6) AS max_y FROM s GROUP BY job_id, layer""")
def round_pad_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    pads = _board_shapes(spark, sf_dir).filter((F.upper(F.trim("kind")) == "P") & F.col("symbol_name").rlike(r"^r[0-9.]+$"))
    boxes = spc.board_bounds(pads, ["job_id", "layer"])
    return boxes.select("job_id", "layer", *[F.round(c, 6).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])


_NUMBER = "([0-9]*[.]?[0-9]+)"


@query(f"""WITH f AS (SELECT DISTINCT ON (feature_id) *, lower(trim(symbol_name)) AS sym, upper(trim(kind)) AS k FROM features),
n AS (SELECT *, TRY_CAST(regexp_extract(sym, '^r{_NUMBER}$', 1) AS DOUBLE) / 1000 AS disc, nullif(regexp_extract(sym, '^(rect|oval){_NUMBER}x{_NUMBER}(xr{_NUMBER})?$', 1), '') AS box,
  TRY_CAST(regexp_extract(sym, '^(rect|oval){_NUMBER}x{_NUMBER}(xr{_NUMBER})?$', 2) AS DOUBLE) / 1000 AS bw, TRY_CAST(regexp_extract(sym, '^(rect|oval){_NUMBER}x{_NUMBER}(xr{_NUMBER})?$', 3) AS DOUBLE) / 1000 AS bh,
  TRY_CAST(regexp_extract(sym, '^(rect|oval){_NUMBER}x{_NUMBER}(xr{_NUMBER})?$', 5) AS DOUBLE) / 1000 AS corner FROM f WHERE isfinite(x) AND isfinite(y)),
w AS (SELECT *, coalesce(disc, bw, 0.001) AS w, coalesce(disc, bh, 0.001) AS h FROM n),
r AS (SELECT *, CASE WHEN box = 'rect' THEN least(coalesce(corner, 0.0), w / 2, h / 2) ELSE least(w, h) / 2 END AS r, radians(coalesce(rotation_deg, 0.0)) AS t FROM w),
e AS (SELECT job_id, layer, x, y, abs((w / 2 - r) * cos(t)) + abs((h / 2 - r) * sin(t)) + r AS ex, abs((w / 2 - r) * sin(t)) + abs((h / 2 - r) * cos(t)) + r AS ey FROM r WHERE k = 'P'
  UNION ALL SELECT job_id, layer, (x + x2) / 2, (y + y2) / 2, abs(x2 - x) / 2 + least(w, h) / 2, abs(y2 - y) / 2 + least(w, h) / 2 FROM r WHERE k = 'L' AND isfinite(x2) AND isfinite(y2))
SELECT job_id, upper(trim(layer)) AS layer, round(min(x - ex), 6) AS min_x, round(min(y - ey), 6) AS min_y, round(max(x + ex), 6) AS max_x, round(max(y + ey), 6) AS max_y FROM e GROUP BY ALL""")
def board_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = spc.board_bounds(_board_shapes(spark, sf_dir), ["job_id", "layer"])
    return boxes.select("job_id", "layer", *[F.round(c, 6).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])


@query("""WITH firsts AS (SELECT n_regionkey, min(n_nationkey) AS k FROM nation GROUP BY 1),
drills AS (SELECT s_suppkey AS drill, n.n_regionkey, n.n_nationkey AS own, f.k AS first FROM supplier JOIN nation n ON s_nationkey = n.n_nationkey JOIN firsts f ON f.n_regionkey = n.n_regionkey)
SELECT d.n_regionkey, d.drill, n.n_name AS layer, n.n_nationkey AS ordinal FROM drills d JOIN nation n ON n.n_regionkey = d.n_regionkey AND n.n_nationkey BETWEEN least(d.own, d.first) AND greatest(d.own, d.first)""")
def drill_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_name").alias("layer"), F.col("n_nationkey").alias("ordinal"))
    first = nations.groupBy("n_regionkey").agg(F.min_by("layer", "ordinal").alias("end_layer"))
    drills = _suppliers(spark, sf_dir).select("n_regionkey", F.col("s_suppkey").alias("drill"), F.col("n_name").alias("start_layer")).join(first, "n_regionkey")
    return spc.drill_span(drills, nations, ["n_regionkey"])


# ---------------------------------------------------------------- names and rules


def _ascii_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_net_union(spark, sf_dir).filter(F.col("net_name").rlike(r"^[\x20-\x7E]*$"))


_ASCII = f"ascii_names AS (SELECT net_name FROM ({ORACLES['distinct_net_union']}) WHERE regexp_full_match(net_name, '[ -~]*'))"


@query(f"WITH {_ASCII} SELECT net_name, {sql.NORMAL.format('net_name')} AS normal, len(list_filter(string_split({sql.NORMAL.format('net_name')}, '_'), lambda t: t <> '')) AS n_tokens FROM ascii_names")
def net_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal = normal_name(F.col("net_name"), any_script=False)
    return _ascii_names(spark, sf_dir).select("net_name", normal.alias("normal"), F.size(name_tokens(normal)).cast("long").alias("n_tokens"))


_VOLT = r"(?:^|[^A-Z0-9])([-+PMN]?)(\d+)V(\d*)(?:$|[^A-Z0-9])"


def _sql_volts(name: str) -> str:
    """The lookbehind of the engine's pattern is written as a group, which means the same as only the first match is read."""
    text = f"translate(upper({name}), '. /', '___')"
    get = lambda k: f"regexp_extract({text}, '{_VOLT}', {k})"
    value = f"CAST({get(2)} || '.' || CASE WHEN {get(3)} = '' THEN '0' ELSE {get(3)} END AS DOUBLE)"
    hv = f"regexp_extract({text}, '(?:^|[^A-Z0-9])HV(\\d{{2,4}})(?:$|[^A-Z0-9])', 1)"
    return f"CASE WHEN {get(2)} <> '' THEN CASE WHEN {get(1)} IN ('-', 'M', 'N') THEN -{value} ELSE {value} END WHEN {hv} <> '' THEN CAST({hv} AS DOUBLE) END"


@query(f"WITH {_ASCII} SELECT net_name, {_sql_volts('net_name')} AS volts FROM ascii_names")
def voltage_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ascii_names(spark, sf_dir).select("net_name", name_voltage(F.col("net_name")).alias("volts"))


def _rule_values() -> str:
    quote = lambda v: "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
    rows = []
    for k, r in enumerate(rul.builtin_pack().rules):
        pattern = r.pattern if r.match_type == "regex" or r.match_on == "raw" else rul.python_normal_name(r.pattern)
        rows.append(f"({k}, {quote(r.rule_id)}, {r.priority}, {rul.KIND_RANK[r.match_type]}, {len(r.pattern)}, '{r.match_type}', '{r.match_on}', {quote(pattern)}, '{r.net_class}', '{r.confidence}', '{r.severity}')")
    return ", ".join(rows)


def _regex_case() -> str:
    whens = []
    for r in rul.builtin_pack().rules:
        if r.match_type == "regex":
            target, flags = ("n.net_name", "") if r.match_on == "raw" else ("n.normal", "(?i)")
            whens.append(f"WHEN r.rule_id = '{r.rule_id}' THEN regexp_matches({target}, '{flags}{r.pattern}')")
    return "CASE " + " ".join(whens) + " ELSE false END"


_RULED = f"""{_ASCII}, n AS (SELECT net_name, {sql.NORMAL.format("net_name")} AS normal FROM ascii_names),
r(rule_order, rule_id, priority, kind_rank, len, match_type, match_on, pattern, net_class, confidence, severity) AS (VALUES {_rule_values()}),
hits AS (SELECT n.net_name, r.* FROM n JOIN r ON CASE r.match_type WHEN 'exact' THEN n.normal = r.pattern WHEN 'token' THEN list_contains(string_split(n.normal, '_'), r.pattern)
  WHEN 'prefix' THEN starts_with(n.normal, r.pattern) WHEN 'suffix' THEN suffix(n.normal, r.pattern) ELSE {_regex_case()} END),
won AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY net_name ORDER BY priority DESC, kind_rank DESC, len DESC, rule_id) = 1)"""


@query(f"""WITH {_RULED} SELECT n.net_name, w.rule_id AS matched_rule_id, coalesce(w.confidence, 'Unknown') AS confidence, coalesce(w.severity, 'Review') AS severity
FROM n LEFT JOIN won w ON n.net_name = w.net_name""")
def rule_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rul.classify_names(_ascii_names(spark, sf_dir), rul.builtin_pack()).select("net_name", "matched_rule_id", "confidence", "severity")


@query(f"WITH {_RULED} SELECT net_name, string_agg(rule_id, ';' ORDER BY rule_order) AS rule_ids, count(*) AS n_rules FROM hits GROUP BY net_name")
def rule_all_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rul.classify_names(_ascii_names(spark, sf_dir), rul.builtin_pack()).filter(F.size("all_matched_rule_ids") > 0)
    return got.select("net_name", F.array_join("all_matched_rule_ids", ";").alias("rule_ids"), F.size("all_matched_rule_ids").cast("long").alias("n_rules"))


@query()
def net_voltages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rul.classify_names(distinct_net_union(spark, sf_dir), rul.builtin_pack()).drop("all_matched_rule_ids")


@query("SELECT true AS passed, 28 AS n_cases")
def rule_selftest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rul.self_test(spark).groupBy("passed").agg(F.count("*").cast("int").alias("n_cases"))


def _every_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_net_union(spark, sf_dir)


@query()
def net_normalize_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal = normal_name(F.col("net_name"))
    return settle(_every_name(spark, sf_dir), normal=normal).select("net_name", "normal", F.size(name_tokens(F.col("normal"))).cast("long").alias("n_tokens"))


@query()
def voltage_token_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _every_name(spark, sf_dir).select("net_name", name_voltage(F.col("net_name")).alias("volts"))


@query()
def rule_classify_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rul.classify_names(_every_name(spark, sf_dir), rul.builtin_pack()).select("net_name", "matched_rule_id", "confidence", "severity")


@query()
def rule_all_matches_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rul.classify_names(_every_name(spark, sf_dir), rul.builtin_pack()).filter(F.size("all_matched_rule_ids") > 0)
    return got.select("net_name", F.array_join("all_matched_rule_ids", ";").alias("rule_ids"), F.size("all_matched_rule_ids").cast("long").alias("n_rules"))


# ---------------------------------------------------------------- requirements


def _required(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "jobs").select("job_id", "project_id")
    pairs = _measurements(spark, sf_dir).join(jobs, "job_id").select("measurement_id", "project_id", "net_a", "net_b", "effective_max_voltage_v")
    scoped = _assigned(spark, sf_dir).select("project_id", "net_name", "final_voltage_v", "galvanic_zone", "source")
    return req.with_compliance(req.pair_requirements(pairs, scoped, ZONES, scope=["project_id"], zones_enabled=True))


def _zone_sql(column: str) -> str:
    return f"TRY_CAST(regexp_extract(regexp_replace(lower({column}), '[\\s_\\-]+', '', 'g'), '^(?:galvaniczone|zone|z)?(10|[1-9])$', 1) AS INTEGER)"


def _ground_sql(column: str) -> str:
    return f"replace(upper(trim({column})), '-', '_') IN ('0', '0V', 'GND', 'GROUND', 'AGND', 'DGND', 'PGND', 'SGND')"


_REQUIRED = f"""{sql.LATEST}, s AS (SELECT project_id, net_name, CASE WHEN isfinite(final_voltage_v) THEN final_voltage_v END AS v, {_zone_sql("galvanic_zone")} AS z, coalesce(source, '') AS src FROM assigned),
p AS (SELECT m.measurement_id, m.net_a, m.net_b, m.effective_max_voltage_v AS eff, coalesce(a.v, CASE WHEN {_ground_sql("net_a")} THEN 0.0 END) AS va, coalesce(b.v, CASE WHEN {_ground_sql("net_b")} THEN 0.0 END) AS vb,
  a.z AS za, b.z AS zb, a.src AS sa, b.src AS sb, a.net_name IS NOT NULL OR b.net_name IS NOT NULL AS present, {_ground_sql("net_a")} OR {_ground_sql("net_b")} AS ground
  FROM measurements m JOIN jobs j ON m.job_id = j.job_id
  LEFT JOIN s a ON a.project_id = j.project_id AND a.net_name = m.net_a LEFT JOIN s b ON b.project_id = j.project_id AND b.net_name = m.net_b),
q AS (SELECT *, za <> zb AS crossing, abs(va - vb) AS local_v, CASE WHEN za <> zb THEN CASE WHEN least(za, zb) = 1 AND greatest(za, zb) = 3 THEN 750.0 WHEN least(za, zb) = 2 AND greatest(za, zb) = 4 THEN 1500.0 ELSE 1000.0 END END AS zone_v FROM p),
r AS (SELECT *, coalesce(zone_v, local_v) AS required_voltage_v, CASE WHEN zone_v IS NOT NULL THEN 'galvanic_zone' WHEN local_v IS NULL THEN 'unknown' WHEN sa = 'manual' OR sb = 'manual' THEN 'manual_override'
  WHEN sa = 'rule' OR sb = 'rule' THEN 'rule_guess' WHEN present THEN 'net_class' WHEN ground THEN 'rule_guess' ELSE 'unknown' END AS requirement_source,
  CASE WHEN isfinite(eff) THEN eff END - coalesce(zone_v, local_v) AS margin FROM q)"""


@query(f"""WITH {_REQUIRED} SELECT measurement_id, required_voltage_v, requirement_source, margin AS voltage_margin_v,
  CASE WHEN margin >= 0 THEN 'OK' WHEN margin < 0 THEN 'NOK' ELSE 'UNKNOWN' END AS standard_voltage_status FROM r""")
def pair_requirement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _required(spark, sf_dir).select("measurement_id", "required_voltage_v", "requirement_source", "voltage_margin_v", "standard_voltage_status")


@query(f"""WITH {_REQUIRED} SELECT count(*) FILTER (WHERE zone_v IS NOT NULL) AS cross_zone_pairs, count(*) FILTER (WHERE zone_v IS NOT NULL AND margin >= 0) AS cross_zone_pass,
  count(*) FILTER (WHERE zone_v IS NOT NULL AND margin < 0) AS cross_zone_fail, count(*) FILTER (WHERE zone_v IS NOT NULL AND margin IS NULL) AS cross_zone_unknown,
  count(*) FILTER (WHERE zone_v IS NULL) AS local_voltage_pairs, count(*) FILTER (WHERE za IS NULL OR zb IS NULL) AS incomplete_zone_pairs,
  count(*) FILTER (WHERE zone_v IS NULL AND local_v IS NULL) AS unknown_voltage_pairs FROM r""")
def hierarchy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return req.requirement_summary(_required(spark, sf_dir))


@query(f"WITH {_REQUIRED} SELECT measurement_id, net_a, net_b, zone_v AS required_voltage_v, coalesce(margin >= 0, false) AS passed FROM r WHERE zone_v IS NOT NULL")
def zone_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return req.zone_spacing(_required(spark, sf_dir)).select("measurement_id", "net_a", "net_b", "required_voltage_v", "passed")


@query(f"""WITH {sql.LATEST}, zones AS (SELECT DISTINCT project_id, unnest([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 0]) AS z FROM assigned),
n AS (SELECT project_id, coalesce({_zone_sql("galvanic_zone")}, 0) AS z, count(DISTINCT net_name) AS c FROM assigned GROUP BY 1, 2)
SELECT zones.project_id, CASE WHEN zones.z = 0 THEN 'Unassigned' ELSE 'Zone ' || zones.z END AS zone, coalesce(n.c, 0) AS n_nets FROM zones LEFT JOIN n ON zones.project_id = n.project_id AND zones.z = n.z""")
def zone_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return req.zone_counts(_assigned(spark, sf_dir), ["project_id"])


_ABSENT = "NO SUCH NET"


def _assigned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assigned net with the next and the seventh next of its project, with a ground net and with one that has no assignment.

    What a pair's spacing supports is that of the measurement with the row's number.
    """
    assigned = _assigned(spark, sf_dir).select("project_id", "net_name", "final_voltage_v", "galvanic_zone", "source", "row_id")
    beside = Window.partitionBy("project_id").orderBy("net_name")
    others = F.array_compact(F.array(F.lead("net_name", 1).over(beside), F.lead("net_name", 7).over(beside), F.lit("GND"), F.lit(_ABSENT)))
    supported = _measurements(spark, sf_dir).groupBy(F.col("measurement_id").alias("row_id")).agg(F.max_by("effective_max_voltage_v", "loaded_at").alias("effective_max_voltage_v"))
    pairs = assigned.filter("net_name is not null").select("project_id", "row_id", F.col("net_name").alias("net_a"), others.alias("o")).join(supported, "row_id", "left")
    pairs = pairs.select("project_id", "net_a", F.explode("o").alias("net_b"), "effective_max_voltage_v")
    return req.with_compliance(req.pair_requirements(pairs, assigned.drop("row_id"), LOW_ZONES, scope=["project_id"], zones_enabled=True))


_PAIRED = f"""{sql.LATEST}, s AS (SELECT project_id, net_name, row_id, CASE WHEN isfinite(final_voltage_v) THEN final_voltage_v END AS v, {_zone_sql("galvanic_zone")} AS z, coalesce(source, '') AS src FROM assigned),
near AS (SELECT *, lead(net_name, 1) OVER w AS n1, lead(net_name, 7) OVER w AS n7 FROM s WINDOW w AS (PARTITION BY project_id ORDER BY net_name)),
two AS (SELECT project_id, row_id, net_name AS net_a, unnest([n1, n7, 'GND', '{_ABSENT}']) AS net_b FROM near),
m AS (SELECT measurement_id, arg_max_null(effective_max_voltage_v, loaded_at) AS eff FROM measurements GROUP BY 1),
p AS (SELECT t.project_id, t.net_a, t.net_b, m.eff, coalesce(a.v, CASE WHEN {_ground_sql("t.net_a")} THEN 0.0 END) AS va, coalesce(b.v, CASE WHEN {_ground_sql("t.net_b")} THEN 0.0 END) AS vb,
  a.z AS za, b.z AS zb, a.src AS sa, b.src AS sb FROM two t JOIN s a ON a.project_id = t.project_id AND a.net_name = t.net_a
  LEFT JOIN s b ON b.project_id = t.project_id AND b.net_name = t.net_b LEFT JOIN m ON m.measurement_id = t.row_id WHERE t.net_b IS NOT NULL),
q AS (SELECT *, abs(va - vb) AS local_v, CASE WHEN za <> zb THEN CASE WHEN (least(za, zb), greatest(za, zb)) = (1, 2) THEN 24.0 WHEN (least(za, zb), greatest(za, zb)) = (1, 3) THEN 750.0 WHEN (least(za, zb), greatest(za, zb)) = (2, 4) THEN 1500.0 ELSE 1000.0 END END AS zone_v FROM p),
r AS (SELECT *, coalesce(zone_v, local_v) AS req, CASE WHEN isfinite(eff) THEN eff END - coalesce(zone_v, local_v) AS margin,
  CASE WHEN zone_v IS NOT NULL THEN 'galvanic_zone' WHEN local_v IS NULL THEN 'unknown' WHEN 'manual' IN (sa, coalesce(sb, '')) THEN 'manual_override' WHEN 'rule' IN (sa, coalesce(sb, '')) THEN 'rule_guess' ELSE 'net_class' END AS src,
  CASE WHEN zone_v IS NOT NULL THEN '' ELSE concat_ws(' ', CASE WHEN za IS NULL OR zb IS NULL THEN 'Zone assignment incomplete; result uses local net voltage only.' END,
    CASE WHEN local_v IS NULL THEN 'Local net voltage unknown; review assignments.' END) END AS warning FROM q)"""


@query(f"""WITH {_PAIRED} SELECT project_id, net_a, net_b, coalesce('Zone ' || za, '') AS zone_a, coalesce('Zone ' || zb, '') AS zone_b, va AS net_a_voltage_v, vb AS net_b_voltage_v, local_v AS local_voltage_v,
  CAST(zone_v AS DOUBLE) AS zone_voltage_v, req AS required_voltage_v, src AS requirement_source, warning, margin AS voltage_margin_v, CASE WHEN margin >= 0 THEN 'OK' WHEN margin < 0 THEN 'NOK' ELSE 'UNKNOWN' END AS standard_voltage_status FROM r""")
def assigned_pair_requirement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned_pairs(spark, sf_dir).drop("effective_max_voltage_v")


@query(f"""WITH {_PAIRED} SELECT count(zone_v) AS cross_zone_pairs, count(*) FILTER (WHERE zone_v IS NOT NULL AND margin >= 0) AS cross_zone_pass, count(*) FILTER (WHERE zone_v IS NOT NULL AND margin < 0) AS cross_zone_fail,
  count(*) FILTER (WHERE zone_v IS NOT NULL AND margin IS NULL) AS cross_zone_unknown, count(*) FILTER (WHERE zone_v IS NULL) AS local_voltage_pairs, count(*) FILTER (WHERE za IS NULL OR zb IS NULL) AS incomplete_zone_pairs,
  count(*) FILTER (WHERE zone_v IS NULL AND local_v IS NULL) AS unknown_voltage_pairs FROM r""")
def assigned_hierarchy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return req.requirement_summary(_assigned_pairs(spark, sf_dir))


@query(f"WITH {_PAIRED} SELECT project_id, net_a, net_b, CAST(zone_v AS DOUBLE) AS required_voltage_v, coalesce(margin >= 0, false) AS passed FROM r WHERE zone_v IS NOT NULL")
def assigned_zone_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return req.zone_spacing(_assigned_pairs(spark, sf_dir)).select("project_id", "net_a", "net_b", "required_voltage_v", "passed")


# ---------------------------------------------------------------- assignments

_OPEN = "(review_state IN ('Needs review', 'Conflict', 'Auto-guessed') OR (severity IN ('Warning', 'Critical') AND coalesce(review_state, '') NOT IN ('Approved', 'Reviewed', 'Accepted unknown', 'Waived')))"


@query(f"WITH {sql.LATEST} SELECT project_id, net_name, severity, review_state, CASE severity WHEN 'Critical' THEN 0 WHEN 'Warning' THEN 1 WHEN 'Review' THEN 2 WHEN 'Info' THEN 3 ELSE 4 END AS severity_rank FROM assigned WHERE {_OPEN}")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = _assigned(spark, sf_dir).filter(asg.needs_review(F.col("review_state"), F.col("severity")))
    return open_.select("project_id", "net_name", "severity", "review_state", asg.severity_rank(F.col("severity")).alias("severity_rank"))


@query(f"""WITH {sql.LATEST} SELECT project_id, count(*) FILTER (WHERE {_OPEN}) AS needs_review, count(*) FILTER (WHERE {_OPEN} AND severity = 'Critical') AS unreviewed_critical,
  count(*) FILTER (WHERE {_OPEN} AND severity = 'Warning') AS unreviewed_warning, count(*) FILTER (WHERE review_state = 'Conflict') AS conflicts, count(*) FILTER (WHERE review_state = 'Waived') AS waived FROM assigned GROUP BY project_id""")
def gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asg.review_counts(_assigned(spark, sf_dir), ["project_id"])


@query(f"""WITH {sql.LATEST} SELECT project_id, net_name, coalesce(severity IN ('Warning', 'Critical'), false) AS blocked,
  CASE WHEN severity IN ('Warning', 'Critical') THEN review_state ELSE 'Approved' END AS new_review_state FROM assigned""")
def batch_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asg.batch_preview(_assigned(spark, sf_dir), "approve").select("project_id", "net_name", "blocked", "new_review_state")


def _edge_revisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    snapshots = table(spark, sf_dir, "assignment_snapshots")
    whole = Window.partitionBy("project_id")
    marked = snapshots.withColumn("__first", F.min("rev_no").over(whole)).withColumn("__last", F.max("rev_no").over(whole))
    order = [F.col("loaded_at").desc_nulls_last(), F.col("row_id").desc_nulls_last()]
    pick = lambda at: asg.last_of_each(marked.filter(F.col("rev_no") == F.col(at)), ["project_id", "net_name"], order)
    return pick("__first"), pick("__last")


_EDGES = """e AS (SELECT *, min(rev_no) OVER (PARTITION BY project_id) AS f, max(rev_no) OVER (PARTITION BY project_id) AS l FROM assignment_snapshots),
one AS (SELECT * FROM e WHERE rev_no = f QUALIFY row_number() OVER (PARTITION BY project_id, net_name ORDER BY loaded_at DESC NULLS LAST, row_id DESC NULLS LAST) = 1),
two AS (SELECT * FROM e WHERE rev_no = l QUALIFY row_number() OVER (PARTITION BY project_id, net_name ORDER BY loaded_at DESC NULLS LAST, row_id DESC NULLS LAST) = 1)"""


@query(f"""WITH {_EDGES}, j AS (SELECT coalesce(a.project_id, b.project_id) AS project_id, coalesce(a.net_name, b.net_name) AS net_name, a.row_id IS NULL AS fresh, b.row_id IS NULL AS gone,
  CASE WHEN NOT isnan(a.final_voltage_v) THEN a.final_voltage_v END AS v1, CASE WHEN NOT isnan(b.final_voltage_v) THEN b.final_voltage_v END AS v2, a.final_class AS c1, b.final_class AS c2, a.review_state AS r1, b.review_state AS r2
  FROM one a FULL JOIN two b ON a.project_id = b.project_id AND a.net_name = b.net_name)
SELECT project_id, net_name, CASE WHEN fresh THEN 'added' WHEN gone THEN 'deleted' WHEN v1 IS DISTINCT FROM v2 THEN 'voltage_changed' WHEN c1 IS DISTINCT FROM c2 THEN 'class_changed'
  WHEN r1 IS DISTINCT FROM r2 THEN 'review_state_changed' ELSE 'unchanged' END AS category FROM j""")
def assignment_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asg.assignment_difference(*_edge_revisions(spark, sf_dir), ["project_id", "net_name"]).select("project_id", "net_name", "category")


@query(f"""WITH {_EDGES} SELECT coalesce(a.project_id, b.project_id) AS project_id, coalesce(a.net_name, b.net_name) AS net_name,
  CASE WHEN b.row_id IS NULL OR (a.row_id IS NOT NULL AND a.source IN ('manual', 'imported_exact', 'imported_case_insensitive', 'imported_normalized', 'imported_manual_mapping')) THEN a.final_class ELSE b.final_class END AS final_class,
  CASE WHEN b.row_id IS NULL OR (a.row_id IS NOT NULL AND a.source IN ('manual', 'imported_exact', 'imported_case_insensitive', 'imported_normalized', 'imported_manual_mapping')) THEN a.source ELSE b.source END AS source
  FROM one a FULL JOIN two b ON a.project_id = b.project_id AND a.net_name = b.net_name""")
def auto_detect_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = asg.merge_detected(*_edge_revisions(spark, sf_dir), ["project_id", "net_name"], ["final_class", "final_voltage_v"])
    return merged.select("project_id", "net_name", "final_class", "source")


@query()
def revision_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = _edge_revisions(spark, sf_dir)
    return match_revisions(first, last, rul.builtin_pack(), scope=["project_id"])


_words = lambda words: ", ".join(f"'{w}'" for w in words)


@query(f"""{JUDGED_LINES} SELECT line_id, CASE WHEN f[2] NOT IN ({_words(NET_CLASSES)}) THEN 'final_class' WHEN f[6] NOT IN ({_words(CONFIDENCES)}) THEN 'confidence'
  WHEN f[7] NOT IN ({_words(SEVERITIES)}) THEN 'severity' WHEN f[8] NOT IN ({_words(REVIEW_STATES)}) THEN 'review_state' END AS problem FROM judged WHERE reason IS NULL""")
def import_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = load_delimited(table(spark, sf_dir, "assignment_lines"), ASSIGNMENT_RULES).filter("reason is null")
    return valid.select("line_id", asg.validity_problem().alias("problem"))
