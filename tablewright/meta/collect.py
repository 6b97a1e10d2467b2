"""Schema collection over many sources at once, with what each of them took, and those figures as Prometheus text."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import SparkSession

from tablewright.meta.catalog import Catalog, from_rows

Rows = dict[str, list[tuple]]


@dataclass(frozen=True)
class Report:
    label: str
    ok: bool
    seconds: float
    tables: int
    columns: int
    error: str = ""


def collect(spark: SparkSession, sources: dict[str, Callable[[], Rows]], at_once: int = 10) -> tuple[Catalog, list[Report]]:
    """One catalog of all sources; one that fails is reported and leaves the others alone."""

    def one(item: tuple[str, Callable[[], Rows]]) -> tuple[Rows, Report]:
        label, load = item
        began = time.monotonic()
        try:
            rows = load()
            return rows, Report(label, True, time.monotonic() - began, len(rows.get("tables", [])), len(rows.get("columns", [])))
        except Exception as e:  # any driver's error
            return {}, Report(label, False, time.monotonic() - began, 0, 0, f"{type(e).__name__}: {e}")

    with ThreadPoolExecutor(at_once) as pool:
        done = list(pool.map(one, sources.items()))
    merged: Rows = {k: [r for rows, _ in done for r in rows.get(k, [])] for k in ("tables", "columns", "indexes", "fks")}
    return from_rows(spark, merged), [report for _, report in done]


def metrics_text(reports: list[Report]) -> str:
    """The reports in Prometheus' text format."""
    lines = []
    for name, kind, what in (("collect_success", "gauge", lambda r: int(r.ok)), ("collect_duration_seconds", "gauge", lambda r: round(r.seconds, 6)), ("collect_tables", "gauge", lambda r: r.tables), ("collect_columns", "gauge", lambda r: r.columns)):
        lines.append(f"# TYPE tablewright_{name} {kind}")
        for r in reports:
            label = r.label.replace("\\", "\\\\").replace('"', '\\"')
            lines.append(f'tablewright_{name}{{label="{label}"}} {what(r)}')
    return "\n".join(lines) + "\n"
