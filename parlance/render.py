"""Results as text, CSV, JSON and spreadsheets. For results small enough for the driver: reports, not tables."""

from __future__ import annotations

import csv
import io
import json
from html import escape

from pyspark.sql import DataFrame

#: Rows that a report may have.
MOST_ROWS = 1_000_000


def _rows(df: DataFrame) -> tuple[list[str], list[tuple]]:
    rows = [tuple(r) for r in df.limit(MOST_ROWS + 1).collect()]
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows: write the DataFrame as a table instead")
    return df.columns, rows


def _cell(value: object) -> str:
    return "" if value is None else f"{value:.3f}" if isinstance(value, float) else str(value)


def as_text(df: DataFrame, title: str = "") -> str:
    """Columns side by side, numbers to the right."""
    columns, rows = _rows(df)
    shown = [[_cell(v) for v in r] for r in rows]
    width = [max(map(len, [c, *(r[k] for r in shown)])) for k, c in enumerate(columns)]
    right = [all(isinstance(r[k], (int, float)) or r[k] is None for r in rows) and bool(rows) for k in range(len(columns))]
    line = lambda cells: "  ".join(c.rjust(w) if n else c.ljust(w) for c, w, n in zip(cells, width, right, strict=True)).rstrip()
    return "\n".join([*([title] if title else []), line(columns), *map(line, shown)]) + "\n"


def as_csv(df: DataFrame) -> str:
    columns, rows = _rows(df)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(columns)
    writer.writerows([["" if v is None else v for v in r] for r in rows])
    return out.getvalue()


def as_json(df: DataFrame) -> str:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows: write the DataFrame as a table instead")
    return json.dumps([r.asDict(recursive=True) for r in rows], ensure_ascii=False, default=str)


def banner(command: str, when: str, version: str, scope: str, source: str) -> str:
    """Six lines before a command's output."""
    return f"{command}\n{when}\n{version}\n{scope}\n****************************************\nFrom {source}\n"


def spreadsheet(sheets: dict[str, tuple[list[str], list[tuple]]]) -> str:
    """A SpreadsheetML 2003 workbook: counts without, ratios with three decimals, a point for what is missing."""
    out = ['<?xml version="1.0"?>', '<Workbook xmlns="urn:schemas-microsoft-com:office:spreadsheet" xmlns:ss="urn:schemas-microsoft-com:office:spreadsheet">']

    def cell(v: object) -> str:
        if v is None:
            return '<Cell><Data ss:Type="String">.</Data></Cell>'
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<Cell><Data ss:Type="Number">{v:.3f}</Data></Cell>' if isinstance(v, float) else f'<Cell><Data ss:Type="Number">{v:.0f}</Data></Cell>'
        return f'<Cell><Data ss:Type="String">{escape(str(v))}</Data></Cell>'

    for name, (columns, rows) in sheets.items():
        out.append(f'<Worksheet ss:Name="{escape(name[:30])}"><Table>')
        out += ["<Row>" + "".join(map(cell, r)) + "</Row>" for r in [tuple(columns), *rows]]
        out.append("</Table></Worksheet>")
    return "\n".join([*out, "</Workbook>"]) + "\n"


def as_spreadsheet(df: DataFrame, sheet: str = "Sheet1") -> str:
    return spreadsheet({sheet: _rows(df)})


#: Names of the spreadsheets of word frequencies: with words, without, and one row for each word.
SHEET_NAMES = {"wide": "stat.frq.xls", "summary": "stat.frq0.xls", "flat": "words.frq.xls"}


def render(df: DataFrame, form: str = "text") -> str:
    """text, clan (as text), csv, json or xls."""
    forms = {"text": as_text, "clan": as_text, "csv": as_csv, "json": as_json, "xls": as_spreadsheet}
    if form not in forms:
        raise ValueError(f"no form {form!r}")
    return forms[form](df)
