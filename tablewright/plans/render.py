"""Results as JSON and as a text table."""

from __future__ import annotations

import json
import re
import unicodedata

from tablewright.plans.engine import Result

UNSAFE = re.compile("\x1b\\[[0-9;?]*[ -/]*[@-~]|[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def to_json(result: Result) -> str:
    """The envelope; null cells are null, numbers stay numbers, anything else is text."""
    plain = lambda v: v if v is None or isinstance(v, (bool, int, float, str)) else str(v)
    body = {"columns": [{"name": n, "type": t} for n, t in zip(result.columns, result.types, strict=True)], "rows": [[plain(v) for v in r] for r in result.rows], "row_count": result.row_count, "truncated": result.truncated, "execution_time": round(result.seconds, 6)}
    return json.dumps(body | ({"stripped_columns": result.stripped} if result.stripped else {}), ensure_ascii=False)


def cell(value: object) -> str:
    """A cell without what would steer a terminal."""
    return "NULL" if value is None else UNSAFE.sub("", str(value)).replace("\n", "\\n").replace("\t", " ")


def width(text: str) -> int:
    """Columns that a text takes; wide characters take two."""
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def to_table(result: Result, widest: int = 60) -> str:
    rows = [[cell(v) for v in r] for r in result.rows]
    rows = [[v if len(v) <= widest else v[: widest - 1] + "…" for v in r] for r in rows]
    widths = [max([width(n), *(width(r[k]) for r in rows)]) for k, n in enumerate(result.columns)]
    line = lambda cells: " | ".join(v + " " * (w - width(v)) for v, w in zip(cells, widths, strict=True)).rstrip()
    out = [line(result.columns), "-+-".join("-" * w for w in widths), *map(line, rows), f"({result.row_count} rows{', cut' if result.truncated else ''})"]
    return "\n".join(out)
