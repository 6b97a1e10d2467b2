"""Replays the statements of FIXTURES.md section 2 through the engine, with exact values."""

import os
import re

import pytest

from tablewright.plans.engine import Engine

HERE = os.path.dirname(os.path.abspath(__file__))
KINDS = {"VARCHAR": "string", "BIGINT": "long", "DOUBLE": "double"}


def cases():
    text = open(os.path.join(HERE, "..", "..", "FIXTURES.md"), encoding="utf-8").read()
    text = text.split("## 2. ")[1].split("\n## 3. ")[0]
    for block in text.split("\n#### ")[1:]:
        head, *lines = block.split("\n")
        tables = [re.match(r"(\w+)\((.*)\)", x.strip()).groups() for x in head.strip("`").split(";")]
        for line in lines:
            parts = [x.strip() for x in re.split(r"(?<!\\)\|", line)[1:-1]]
            if len(parts) == 4 and parts[2].startswith("`"):
                yield pytest.param(tables, parts[1], parts[2].strip("`").replace("\\|", "|"), parts[3], id=parts[0].split(" ")[0])


def rows_of(text, kinds=None):
    if text in ("(none)", "(no rows)"):
        return []
    out = []
    for row in text.split("; "):
        cells = [None if c == "∅" else c for c in row.split(",")]
        out.append(tuple(c if c is None or k == "string" else float(c) if k == "double" else int(c) for c, k in zip(cells, kinds, strict=True)) if kinds else cells)
    return out


def same(cell, value):
    if cell is None or value is None:
        return cell is value
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return abs(float(cell) - value) <= 1e-3 * max(1.0, abs(value))
    return cell == str(value)


@pytest.mark.parametrize(("tables", "given", "sql", "expected"), list(cases()))
def test_statement(spark, tables, given, sql, expected):
    engine = Engine(spark)
    for (name, columns), rows in zip(tables, given.split(" ⟂ "), strict=False):
        fields = [c.split() for c in columns.split(", ")]
        kinds = [KINDS[k] for _, k in fields]
        engine.register("main", {name: spark.createDataFrame(rows_of(rows, kinds), ", ".join(f"{n} {k}" for (n, _), k in zip(fields, kinds, strict=True)))})
    got = [tuple(r) for r in engine.query(sql).collect()]
    want = rows_of(expected)
    if "ORDER BY" not in re.sub(r"\([^)]*\)", "", sql):
        key = lambda r: [("" if c is None else f"{c:.6g}" if isinstance(c, float) else str(c)) for c in r]
        got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    left = list(want)
    for row in got:  # rows without an order may come in any
        hit = next((w for w in left if len(w) == len(row) and all(same(c, v) for c, v in zip(w, row, strict=True))), None)
        assert hit is not None, (row, want)
        left.remove(hit)
