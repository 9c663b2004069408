"""Writing results: ordered CSV files, a workbook, a Markdown summary and an archive of them.

Spark writes the parts in order; the single files that people expect are put
together on the driver by streaming rows, never by collecting a table.
"""

from __future__ import annotations

import csv
import json
import os
import re
import zipfile
from collections.abc import Iterable, Iterator, Mapping, Sequence
from datetime import datetime, timezone
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The order of rows in each report, its file, and how many rows the summary shows.
ORDERS = {
    "measurements": ("clearance_mm", "layer", "net_a", "net_b"),
    "per_net_minimum": ("min_clearance_mm", "net"),
    "effective_gaps": ("effective_air_gap_mm", "layer", "net_a", "net_b"),
    "assignments": ("net_name",),
    "zone_spacing": ("clearance_mm", "layer", "net_a", "net_b"),
    "feature_attributes": ("layer", "feature_index"),
}
FILES = {
    "measurements": "net_to_net_measurements_full.csv",
    "per_net_minimum": "net_to_net_per_net_minimum.csv",
    "effective_gaps": "net_to_net_effective_air_gap_matrix.csv",
    "assignments": "net_voltage_assignments.csv",
    "zone_spacing": "galvanic_zone_spacing.csv",
    "feature_attributes": "odb_feature_attributes.csv",
}
PREVIEW = 50


def critical_file(threshold_mm: float) -> str:
    """The file of critical pairs: the threshold with `p` for its point."""
    return f"net_to_net_critical_under_{f'{threshold_mm:g}'.replace('.', 'p')}mm.csv"


def short_number(value: float | None) -> str:
    """Six significant digits without trailing zeros; empty for null."""
    return "" if value is None else f"{value:g}"


def in_order(df: DataFrame, report: str) -> DataFrame:
    """The rows of a report in its order; all its keys, so that ties are settled too."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in ORDERS[report] if c in df.columns])


def write_parts(df: DataFrame, folder: str) -> None:
    """A folder of CSV parts, for results too large for one file; nulls are empty."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(folder)


def _text(value: object) -> object:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    return value


def write_csv(df: DataFrame, path: str) -> int:
    """One CSV file with a header; rows are streamed partition by partition. Returns the number of rows."""
    n = 0
    with atomic(path) as out:
        writer = csv.writer(out)
        writer.writerow(df.columns)
        for row in df.toLocalIterator(prefetchPartitions=True):
            writer.writerow([_text(v) for v in row])
            n += 1
    return n


class atomic:  # noqa: N801
    """A text file that appears under its name only when complete."""

    def __init__(self, path: str) -> None:
        self.path, self.part = path, f"{path}.part-{os.getpid()}"

    def __enter__(self):
        Path(self.path).parent.mkdir(parents=True, exist_ok=True)
        self.file = open(self.part, "w", newline="", encoding="utf-8")  # noqa: SIM115
        return self.file

    def __exit__(self, kind, *_):
        self.file.flush()
        os.fsync(self.file.fileno())
        self.file.close()
        os.unlink(self.part) if kind else os.replace(self.part, self.path)


def write_json(content: Mapping[str, object], path: str) -> None:
    with atomic(path) as out:
        json.dump(content, out, indent=2, sort_keys=True, ensure_ascii=False)


# ---------------------------------------------------------------- workbook


def _column(k: int) -> str:
    name = ""
    while k >= 0:
        name, k = chr(65 + k % 26) + name, k // 26 - 1
    return name


def _cells(row: Sequence[object], n: int) -> str:
    out = []
    for k, value in enumerate(row):
        at = f'r="{_column(k)}{n}"'
        if value is None or value == "":
            continue
        if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value or value in (float("inf"), float("-inf")):
            clean = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(_text(value)))
            out.append(f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>')
        else:
            out.append(f"<c {at}><v>{value!r}</v></c>")
    return f'<row r="{n}">{"".join(out)}</row>'


def write_workbook(sheets: Mapping[str, tuple[Sequence[str], Iterable[Sequence[object]]]], path: str) -> None:
    """A workbook of (header, rows) per sheet, written row by row."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    part = f"{path}.part-{os.getpid()}"
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(sheets)
        overrides = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in range(1, len(names) + 1))
        z.writestr(
            "[Content_Types].xml",
            f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{overrides}</Types>',
        )
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n[:31], {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Type="{office}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">{links}</Relationships>')
        for k, name in enumerate(names, 1):
            header, rows = sheets[name]
            with z.open(f"xl/worksheets/sheet{k}.xml", "w", force_zip64=True) as out:
                out.write(f'{head}<worksheet xmlns="{main}"><sheetData>{_cells(header, 1)}'.encode())
                for n, row in enumerate(rows, 2):
                    out.write(_cells(row, n).encode())
                out.write(b"</sheetData></worksheet>")
    os.replace(part, path)


def sheet(df: DataFrame) -> tuple[list[str], Iterator[Sequence[object]]]:
    """A table as a sheet; rows are streamed."""
    return df.columns, (tuple(r) for r in df.toLocalIterator())


# ---------------------------------------------------------------- summary, archive, folders


def markdown_table(df: DataFrame, limit: int = PREVIEW) -> str:
    """The first rows of an ordered table, as Markdown."""
    rows = df.limit(limit).collect()
    cell = lambda v: short_number(v) if isinstance(v, float) else str(_text(v)).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows])


def write_markdown(title: str, facts: Mapping[str, object], sections: Mapping[str, DataFrame], path: str, *, limit: int = PREVIEW) -> None:
    with atomic(path) as out:
        out.write(f"# {title}\n\n")
        for name, value in facts.items():
            out.write(f"- {name}: {value}\n")
        for name, df in sections.items():
            out.write(f"\n## {name}\n\n{markdown_table(df, limit)}\n")


def write_archive(paths: Sequence[str], path: str) -> None:
    part = f"{path}.part-{os.getpid()}"
    with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
        for p in paths:
            z.write(p, os.path.basename(p))
    os.replace(part, path)


def run_folder(root: str, now: datetime | None = None) -> str:
    """A new folder run_YYYYMMDD_HHMMSS under `root`, with _001 and so on if it exists."""
    base = Path(root) / f"run_{(now or datetime.now(timezone.utc)):%Y%m%d_%H%M%S}"
    for k in range(1000):
        path = base if not k else base.with_name(f"{base.name}_{k:03d}")
        try:
            path.mkdir(parents=True)
            return str(path)
        except FileExistsError:
            continue
    raise FileExistsError(base)


def revision_file(revision: str) -> str:
    """The file of a revision's snapshot."""
    return f"net_voltage_assignments_{re.sub(r'[^A-Za-z0-9._-]+', '_', revision).strip('_') or 'revision'}.json"


def write_reports(tables: Mapping[str, DataFrame], folder: str, *, threshold_mm: float = 0.2, facts: Mapping[str, object] | None = None) -> list[str]:
    """All report files for the tables given; empty tables of effective gaps write none. Returns the paths."""
    paths, sections, sheets = [], {}, {}
    for name, df in tables.items():
        ordered = in_order(df, name) if name in ORDERS else df
        if name == "effective_gaps" and not df.limit(1).count():
            continue
        path = os.path.join(folder, FILES.get(name, f"{name}.csv"))
        write_csv(ordered, path)
        paths.append(path)
        sections[name.replace("_", " ").capitalize()] = ordered
        sheets[name.replace("_", " ").capitalize()] = sheet(ordered)
        if name == "measurements":
            critical = in_order(df.filter(F.col("clearance_mm") < threshold_mm), name)
            path = os.path.join(folder, critical_file(threshold_mm))
            write_csv(critical, path)
            paths.append(path)
            sections["Critical"] = critical
            sheets["Critical"] = sheet(critical)
    report = os.path.join(folder, "report.md")
    write_markdown("Spacing report", facts or {}, sections, report)
    book = os.path.join(folder, "report.xlsx")
    write_workbook(sheets, book)
    paths += [report, book]
    write_archive(paths, os.path.join(folder, "report.zip"))
    return [*paths, os.path.join(folder, "report.zip")]
