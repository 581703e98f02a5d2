"""Results for people and programs: text tables, JSON, JSON lines, CSV, SARIF.

For results that are shown, so of bounded size: every function takes the most rows
it may hold and refuses more, rather than cutting them off.
"""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame

from ..plans.sqlfront import bounded

MOST = 100_000


def _rows(df: DataFrame, most: int) -> list[dict]:
    return [r.asDict(recursive=True) for r in bounded(df, most).collect()]


def as_json(df: DataFrame, most: int = MOST) -> str:
    return json.dumps(_rows(df, most), default=str, ensure_ascii=False)


def as_lines(df: DataFrame, most: int = MOST) -> str:
    return "".join(json.dumps(r, default=str, ensure_ascii=False) + "\n" for r in _rows(df, most))


def as_csv(df: DataFrame, most: int = MOST) -> str:
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(df.columns)
    for r in _rows(df, most):
        w.writerow(["" if v is None else json.dumps(v, default=str) if isinstance(v, (list, dict, bool)) else v for v in r.values()])
    return out.getvalue()


def as_table(df: DataFrame, most: int = MOST) -> str:
    shown = [["" if v is None else str(v) for v in r.values()] for r in _rows(df, most)]
    widths = [max([len(c), *(len(r[i]) for r in shown)]) for i, c in enumerate(df.columns)]
    line = lambda cells: " | ".join(c.ljust(w) for c, w in zip(cells, widths)).rstrip()
    n = len(shown)
    return "\n".join([line(df.columns), "-+-".join("-" * w for w in widths), *map(line, shown), f"({n} row{'s' * (n != 1)})"]) + "\n"


def as_sarif(findings: DataFrame, tool: str = "covenant", most: int = MOST) -> str:
    """Findings in the static-analysis interchange format."""
    rows = _rows(findings, most)
    rules = sorted({r["code"] for r in rows})
    results = [
        {
            "ruleId": r["code"], "level": r["severity"], "message": {"text": r["message"]},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["path"]}}, "logicalLocations": [{"fullyQualifiedName": r["pointer"] or "/"}]}],
        }
        for r in rows
    ]
    run = {"tool": {"driver": {"name": tool, "rules": [{"id": c} for c in rules]}}, "results": results}
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [run]})
