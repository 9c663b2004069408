"""Queries of the core data-preparation operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packed_fields import explode_packed
from ..operators.reject_rows import RowRules, load_delimited
from ..operators.schema_drift import consistent_table, schema_changes, top_level_changes
from ..operators.snapshot_changes import snapshot_changes
from ..operators.unit_values import held_out_units, symbol_widths, unit_calibration, wrong_widths
from ..tables import table
from ..vocabulary import ASSIGNMENT_COLUMNS, REVIEW_STATES
from . import found_sql

ASSIGNMENT_RULES = RowRules(
    columns=ASSIGNMENT_COLUMNS,
    checks=(("net_name", "name"), ("final_voltage_v", "number"), ("review_state", "choice")),
    choices=frozenset(REVIEW_STATES),
    numbers=frozenset({"final_voltage_v"}),
)


def _judged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_delimited(table(spark, sf_dir, "assignment_lines"), ASSIGNMENT_RULES)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged_lines(spark, sf_dir).filter("reason is not null").select("line_id", "reason")


def p1_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged_lines(spark, sf_dir).filter("reason is null").select("line_id", "file_name", "line_no", *ASSIGNMENT_COLUMNS)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    widths = symbol_widths(table(spark, sf_dir, "symbols"), table(spark, sf_dir, "jobs"))
    return wrong_widths(widths).select("symbol_id", "width_nm")


def p3_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    widths = symbol_widths(table(spark, sf_dir, "symbols"), table(spark, sf_dir, "jobs"))
    return widths.select("symbol_id", "job_id", "raw_name", "unit", "unit_source", "unit_probability", "unit_uncertain", "width_nm")


def p3_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_units(table(spark, sf_dir, "symbols"), table(spark, sf_dir, "jobs"))


def p3_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_calibration(p3_held_out(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    attributes = explode_packed(table(spark, sf_dir, "features"), "feature_id", "raw_attributes", "features")
    tags = explode_packed(table(spark, sf_dir, "net_rules"), "rule_no", "tags", "net_rules")
    return attributes.unionByName(tags)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = snapshot_changes(table(spark, sf_dir, "assignment_snapshots"))
    return changes.select("project_id", "from_rev", "to_rev", "old_net", "new_net", "match_status")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_level_changes(schema_changes(table(spark, sf_dir, "store_rows")))


def p6_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "store_rows")
    return consistent_table(rows, schema_changes(rows))


QUERIES = {f.__name__: f for f in (p1_found, p1_assignments, p3_found, p3_widths, p3_held_out, p3_calibration, p4_found, p5_found, p6_found, p6_table)}

_STATES = ", ".join(f"'{s}'" for s in REVIEW_STATES)
_FIELD = '(?:"[^"]*(?:""[^"]*)*"|[^",]*)'

# a record is well quoted if it is a list of quoted or bare fields; the fields are cut out by one regular expression
JUDGED_LINES = f"""WITH lines AS (
  SELECT line_id, file_name, line_no, coalesce(raw_line, '') AS raw FROM assignment_lines WHERE line_no IS NULL OR line_no <> 1
), cut AS (
  SELECT line_id, file_name, line_no, regexp_full_match(raw, '(?s){_FIELD}(?:,{_FIELD})*') AS quoted,
         list_transform(regexp_extract_all(',' || raw, '(?s),({_FIELD})', 1),
           lambda f: CASE WHEN f LIKE '"%' THEN replace(f[2:-2], '""', '"') ELSE f END) AS f
  FROM lines
), judged AS (
  SELECT line_id, file_name, line_no, f, CASE
    WHEN NOT quoted THEN 'quoting'
    WHEN len(f) <> 11 THEN 'column_count'
    WHEN regexp_full_match(f[1], '(?s)[\\s\\p{{Z}}]*') OR regexp_matches(f[1], '[\\p{{Cc}}\\p{{Cf}}]') THEN 'net_name'
    WHEN NOT regexp_full_match(f[3], '[\\s\\p{{Z}}]*')
      AND NOT (regexp_full_match(f[3], '[\\s\\p{{Z}}]*[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?[\\s\\p{{Z}}]*')
               AND coalesce(isfinite(TRY_CAST(regexp_replace(f[3], '[\\s\\p{{Z}}]', '', 'g') AS DOUBLE)), false)) THEN 'final_voltage_v'
    WHEN regexp_replace(f[8], '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') NOT IN ({_STATES}) THEN 'review_state' END AS reason
  FROM cut
)"""
_VALUES = ", ".join(
    f"TRY_CAST(regexp_replace(f[{k}], '[\\s\\p{{Z}}]', '', 'g') AS DOUBLE) AS {c}" if c == "final_voltage_v" else f"nullif(f[{k}], '') AS {c}" for k, c in enumerate(ASSIGNMENT_COLUMNS, 1)
)

ORACLES = {
    "p3_found": found_sql.P3_FOUND,
    "p3_widths": found_sql.P3_WIDTHS,
    "p4_found": found_sql.P4_FOUND,
    "p6_found": found_sql.P6_FOUND,
    "p1_found": f"{JUDGED_LINES} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p1_assignments": f"{JUDGED_LINES} SELECT line_id, file_name, line_no, {_VALUES} FROM judged WHERE reason IS NULL",
    # names of printable ASCII and full-width ASCII have the same normal form under this mapping
    "p5_found": """
WITH rows AS (
  SELECT project_id, rev_no, row_id, loaded_at, coalesce(net_name, '') AS net,
    trim(regexp_replace(translate(upper(list_aggregate(list_transform(string_split(regexp_replace(coalesce(net_name, ''), '[\\p{Cc}\\p{Cf}]', '', 'g'), ''),
      lambda c: CASE WHEN c <> '' AND unicode(c) BETWEEN 65281 AND 65374 THEN chr(unicode(c) - 65248) ELSE c END), 'string_agg', '')),
      '-+. /', '_____'), '_+', '_', 'g'), '_') AS key,
    coalesce(final_class, '') AS final_class, CASE WHEN isnan(final_voltage_v) THEN NULL ELSE final_voltage_v END AS volts,
    coalesce(review_state, '') AS review_state,
    coalesce(CAST(TRY_CAST(regexp_extract(galvanic_zone, '(\\d+)', 1) AS INTEGER) AS VARCHAR), lower(trim(galvanic_zone)), '') AS zone
  FROM assignment_snapshots WHERE rev_no IS NOT NULL
), once AS (
  SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY project_id, rev_no, key ORDER BY loaded_at DESC NULLS LAST, row_id DESC) = 1
), revs AS (
  SELECT project_id, rev_no AS a, lead(rev_no) OVER (PARTITION BY project_id ORDER BY rev_no) AS b
  FROM (SELECT DISTINCT project_id, rev_no FROM rows)
), lefts AS (SELECT o.*, r.a, r.b FROM once o JOIN revs r ON o.project_id = r.project_id AND o.rev_no = r.a WHERE r.b IS NOT NULL),
rights AS (SELECT o.*, r.a, r.b FROM once o JOIN revs r ON o.project_id = r.project_id AND o.rev_no = r.b),
paired AS (
  SELECT coalesce(l.project_id, r.project_id) AS project_id, coalesce(l.a, r.a) AS from_rev, coalesce(l.b, r.b) AS to_rev,
    coalesce(l.net, '') AS old_net, coalesce(r.net, '') AS new_net,
    CASE WHEN l.key IS NULL THEN 'new' WHEN r.key IS NULL THEN 'missing'
      WHEN l.final_class <> r.final_class OR l.review_state <> r.review_state OR l.zone <> r.zone
        OR (l.volts IS NULL) <> (r.volts IS NULL) OR coalesce(abs(l.volts - r.volts) > 1e-6 AND l.volts <> r.volts, false) THEN 'changed'
      WHEN l.net <> r.net THEN 'respelled' END AS match_status
  FROM lefts l FULL JOIN rights r ON l.project_id = r.project_id AND l.a = r.a AND l.key = r.key
)
SELECT * FROM paired WHERE match_status IS NOT NULL
""",
}
