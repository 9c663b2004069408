"""SQL for the queries on units and packed fields, written apart from the operators."""

from __future__ import annotations

# ---------------------------------------------------------------- sizes of symbols

_UNIT_NAMES = {
    "mm": (1e6, "mm millimeter millimeters millimetre millimetres"),
    "cm": (1e7, "cm centimeter centimeters centimetre centimetres"),
    "um": (1e3, "um µm μm micron microns micrometer micrometers micrometre micrometres"),
    "nm": (1.0, "nm nanometer nanometers nanometre nanometres"),
    "mil": (25_400.0, "mil mils thou thous th"),
    "inch": (25_400_000.0, 'in inch inches " ″ ”'),
}
_UNITS = ", ".join(f"('{w}', '{u}', {f})" for u, (f, words) in _UNIT_NAMES.items() for w in words.split())
_ANY_UNIT = "|".join(sorted((w for _, words in _UNIT_NAMES.values() for w in words.split()), key=len, reverse=True))
_KIND, _BRACKET, _DIGITS = "^ ?(?:round|rect|oval|r) ?", r"(?:\[[^\]]*\])? ?", "[0-9]*[.,]?[0-9]+"

# a size stands right behind the shape's name; its unit behind it, in brackets before it, at the end, or as a lone letter there
WIDTHS = rf"""
WITH last AS (
  SELECT *, regexp_replace(lower(raw_name), '[\s\p{{Z}}]+', ' ', 'g') AS t FROM symbols
  QUALIFY symbol_id IS NULL OR row_number() OVER (PARTITION BY symbol_id ORDER BY loaded_at DESC NULLS LAST, raw_name NULLS LAST, width_mm NULLS LAST) = 1
), units(word, unit, nm) AS (VALUES {_UNITS}),
per_job AS (
  SELECT job_id, max(CASE WHEN regexp_full_match(lower(trim(units)), 'inch(es)?|in|imperial|mils?') THEN 'mil' WHEN regexp_full_match(lower(trim(units)), 'mm|millimet(er|re)s?|metric') THEN 'um' END) AS unit
  FROM jobs GROUP BY job_id
), cut AS (
  SELECT symbol_id, l.job_id, raw_name, width_mm, j.unit AS job_unit, regexp_extract(t, '{_KIND}{_BRACKET}({_DIGITS})([^0-9.,]|$)', 1) AS num,
    coalesce(nullif(regexp_extract(trim(t), '{_KIND}{_BRACKET}{_DIGITS} ?({_ANY_UNIT})([x ]|$)', 1), ''), nullif(regexp_extract(trim(t), '{_KIND}\[ ?({_ANY_UNIT}) ?\]', 1), ''),
      nullif(regexp_extract(trim(t), '[0-9] ?({_ANY_UNIT})$', 1), '')) AS word, regexp_extract(trim(t), '[0-9] ?([im])$', 1) AS mark
  FROM last l LEFT JOIN per_job j ON l.job_id = j.job_id
), sized AS (
  SELECT symbol_id, c.job_id, raw_name, width_mm, CASE WHEN num <> '' THEN coalesce(u.unit, CASE mark WHEN 'i' THEN 'mil' WHEN 'm' THEN 'um' END, job_unit) END AS unit,
    CASE WHEN u.unit IS NOT NULL OR mark <> '' THEN 'name' ELSE 'job' END AS said, TRY_CAST(replace(num, ',', '.') AS DECIMAL(24, 10)) AS n
  FROM cut c LEFT JOIN units u ON c.word = u.word
), done AS (
  SELECT s.symbol_id, s.job_id, s.raw_name, s.width_mm, s.unit, CASE WHEN s.unit IS NOT NULL THEN said END AS unit_source, CAST(round(CAST(n AS DOUBLE) * u.nm) AS BIGINT) AS width_nm
  FROM sized s LEFT JOIN (SELECT DISTINCT unit, nm FROM units) u ON s.unit = u.unit
)
"""
P3_FOUND = f"{WIDTHS} SELECT symbol_id, width_nm FROM done WHERE width_nm IS NOT NULL AND (width_mm IS NULL OR isnan(width_mm) OR abs(round(width_mm * 1e6, 3) - width_nm) > 1)"
# where every unit is stated no probability is left to the mixture
P3_WIDTHS = f"""{WIDTHS} SELECT symbol_id, job_id, raw_name, unit, unit_source, CASE WHEN unit IS NOT NULL THEN CAST(1 AS DOUBLE) END AS unit_probability,
  CASE WHEN unit IS NOT NULL THEN false END AS unit_uncertain, width_nm FROM done"""

# ---------------------------------------------------------------- packed fields

# an item is a run of letters (with the marks right behind them), quoted spans, escaped marks and anything but a delimiter
_DOUBLE, _SINGLE = r'"((?:[^"\\]|""|\\.)*)"', r"''((?:[^''\\]|''''|\\.)*)''"
_RUN = rf"""(?s)(?:[\p{{L}}\p{{N}}]["'']*|{_DOUBLE.replace("((", "(?:(").replace(")*)", ")*)")}|{_SINGLE.replace("((", "(?:(")}|\\.|[^,;|\t\r\n])+"""
_BEFORE = r"""(?s)((?:[^="'']*=[\s\p{Z}]*)?)"""


def _trimmed(text: str) -> str:
    return rf"regexp_replace({text}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def _bare_item(item: str) -> str:
    """An item without the quotation marks around it or its value, doubled marks and escapes."""
    plain = lambda text: rf"""regexp_replace({text}, '\\([\\"'',;|\[\]])', '\1', 'g')"""
    part = lambda pattern, k: f"regexp_extract({item}, '^{_BEFORE}{pattern}$', {k})"
    doubled, single = f"""replace({part(_DOUBLE, 2)}, '""', '"')""", f"replace({part(_SINGLE, 2)}, '''''', '''')"
    return (
        f"CASE WHEN regexp_full_match({item}, '{_BEFORE}{_DOUBLE}') THEN {part(_DOUBLE, 1)} || {plain(doubled)}"
        f" WHEN regexp_full_match({item}, '{_BEFORE}{_SINGLE}') THEN {part(_SINGLE, 1)} || {plain(single)}"
        rf" ELSE regexp_replace({item}, '(?s)\\(.)', '\1', 'g') END"
    )


P4_FOUND = rf"""
WITH fields AS (
  SELECT DISTINCT 'features' AS src, feature_id AS row_id, raw_attributes AS field FROM features UNION ALL SELECT DISTINCT 'net_rules', rule_no, tags FROM net_rules
), bare AS (
  SELECT src, row_id, CASE WHEN regexp_full_match(trim(field), '(?s)\[.*\]') THEN trim(field)[2:-2] ELSE trim(field) END AS field FROM fields WHERE trim(field) <> ''
), runs AS (
  SELECT src, row_id, list_filter(list_transform(regexp_extract_all(field, '{_RUN}'), lambda r: {_trimmed("r")}), lambda r: r <> '') AS items FROM bare
), restored AS (
  SELECT src, row_id, list_filter(list_transform(items, lambda i: {_trimmed("(" + _bare_item("i") + ")")}), lambda i: i <> '') AS items FROM runs
)
SELECT DISTINCT src, row_id, CAST(unnest(generate_series(1, len(items))) AS INTEGER) AS pos, unnest(items) AS item FROM restored WHERE len(items) > 0
"""


# ---------------------------------------------------------------- drift of fields

# contents are compared under several spellings; a rename is where two fields are each other's best partner and agree for most nets
P6_FOUND = r"""
WITH once AS (
  SELECT DISTINCT project_id, file_no, payload FROM store_rows WHERE project_id IS NOT NULL AND file_no IS NOT NULL AND json_valid(payload) AND json_type(payload) = 'OBJECT'
), entries AS (
  SELECT o.project_id, o.file_no, trim(regexp_replace(translate(upper(json_extract_string(payload, '$.net_name')), '-+. /', '_____'), '_+', '_', 'g'), '_') AS net,
    e.key AS field, CASE e.type WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS kind,
    CASE WHEN e.type = 'VARCHAR' THEN e.value ->> '$' ELSE CAST(e.value AS VARCHAR) END AS raw
  FROM once o, json_each(o.payload) e
), kinds AS (
  SELECT project_id, file_no, field, kind, count(*) AS n FROM entries GROUP BY ALL
), fields AS (
  SELECT project_id, file_no, field, arg_max(kind, (CASE WHEN kind IS NULL THEN 0 ELSE 1 END, n, kind)) AS kind FROM kinds GROUP BY ALL
), pairs AS (
  SELECT * FROM (SELECT project_id, file_no AS a, lead(file_no) OVER (PARTITION BY project_id ORDER BY file_no) AS b FROM (SELECT DISTINCT project_id, file_no FROM store_rows WHERE project_id IS NOT NULL AND file_no IS NOT NULL))
  WHERE b IS NOT NULL
), gone AS (
  SELECT p.project_id, p.a, p.b, f.field, f.kind FROM pairs p JOIN fields f ON f.project_id = p.project_id AND f.file_no = p.a
  WHERE NOT EXISTS (SELECT 1 FROM fields g WHERE g.project_id = p.project_id AND g.file_no = p.b AND g.field = f.field)
), come AS (
  SELECT p.project_id, p.a, p.b, f.field, f.kind FROM pairs p JOIN fields f ON f.project_id = p.project_id AND f.file_no = p.b
  WHERE NOT EXISTS (SELECT 1 FROM fields g WHERE g.project_id = p.project_id AND g.file_no = p.a AND g.field = f.field)
), spelled AS (
  SELECT project_id, file_no, net, field, list_distinct([
    CASE WHEN TRY_CAST(trim(raw) AS DOUBLE) IS NOT NULL THEN CAST(TRY_CAST(trim(raw) AS DOUBLE) AS VARCHAR) WHEN lower(trim(raw)) IN ('true', 'yes') THEN 'true' WHEN lower(trim(raw)) IN ('false', 'no') THEN 'false'
      WHEN starts_with(trim(raw), '{') AND json_valid(raw) THEN list_aggregate(list_sort(list_transform(json_keys(raw), lambda k: k || '=' || json_extract_string(raw, '$."' || k || '"'))), 'string_agg', '&')
      ELSE regexp_replace(regexp_replace(trim(raw), '^\[|\]$|"', '', 'g'), '\s*[;,|]\s*', ';', 'g') END,
    CAST(TRY_CAST(nullif(regexp_extract(lower(trim(raw)), '^(?:galvanic[ _-]*)?zone[ _-]*(\d+)$', 1), '') AS DOUBLE) AS VARCHAR)]) AS contents
  FROM entries WHERE raw IS NOT NULL AND kind IS NOT NULL AND net IS NOT NULL
), agree AS (
  SELECT g.project_id, g.a, g.b, g.field AS old_field, c.field AS new_field, x.net, max(CAST(list_has_any(list_filter(x.contents, lambda v: v IS NOT NULL), y.contents) AS INTEGER)) AS same
  FROM gone g JOIN come c ON g.project_id = c.project_id AND g.a = c.a
  JOIN spelled x ON x.project_id = g.project_id AND x.file_no = g.a AND x.field = g.field JOIN spelled y ON y.project_id = c.project_id AND y.file_no = c.b AND y.field = c.field AND y.net = x.net
  GROUP BY ALL
), shares AS (
  SELECT project_id, a, b, old_field, new_field, avg(same) AS share FROM agree GROUP BY ALL HAVING avg(same) >= 0.6
), renamed AS (
  SELECT * FROM shares QUALIFY row_number() OVER (PARTITION BY project_id, a, old_field ORDER BY share DESC, new_field) = 1 AND row_number() OVER (PARTITION BY project_id, a, new_field ORDER BY share DESC, old_field) = 1
)
SELECT project_id, a AS from_file, b AS to_file, 'renamed' AS change_kind, old_field, new_field FROM renamed
UNION ALL SELECT g.project_id, g.a, g.b, 'removed', g.field, '' FROM gone g LEFT JOIN renamed r ON r.project_id = g.project_id AND r.a = g.a AND r.old_field = g.field WHERE r.a IS NULL
UNION ALL SELECT c.project_id, c.a, c.b, 'added', '', c.field FROM come c LEFT JOIN renamed r ON r.project_id = c.project_id AND r.a = c.a AND r.new_field = c.field WHERE r.a IS NULL
UNION ALL SELECT p.project_id, p.a, p.b, 'retyped', f.field, g.field FROM pairs p JOIN fields f ON f.project_id = p.project_id AND f.file_no = p.a JOIN fields g ON g.project_id = p.project_id AND g.file_no = p.b
  LEFT JOIN renamed r ON r.project_id = p.project_id AND r.a = p.a AND r.old_field = f.field AND r.new_field = g.field WHERE (f.field = g.field OR r.a IS NOT NULL) AND f.kind <> g.kind
"""
