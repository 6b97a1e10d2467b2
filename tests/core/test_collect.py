"""Snapshots, collection reports, rendering and connectivity."""

import datetime
import json

from tablewright.meta import analysis, collect, snapshots
from tablewright.meta.catalog import from_frames
from tablewright.plans import render
from tablewright.plans.engine import Engine, Result
from tablewright.sources import services


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "versions")
    a = from_frames(spark, {"t": spark.createDataFrame([], "id int"), "gone": spark.createDataFrame([], "x int")})
    b = from_frames(spark, {"t": spark.createDataFrame([], "id long"), "new": spark.createDataFrame([], "y int")})
    assert snapshots.versions(spark, path) == []
    snapshots.save(a, path, "v1", datetime.datetime(2024, 1, 1))
    snapshots.save(b, path, "v2", datetime.datetime(2024, 2, 1))
    assert snapshots.versions(spark, path) == ["v1", "v2"]
    want = {("gone", "removed"), ("new", "added"), ("t", "changed")}
    assert {(r.table, r.change) for r in snapshots.changes(spark, path, "v1").collect()} == want
    assert {(r.table, r.change) for r in snapshots.since(spark, path, datetime.datetime(2024, 1, 15), b).collect()} == want
    assert snapshots.changes(spark, path, "v2", current=b).count() == 0
    assert {r.change for r in snapshots.since(spark, path, datetime.datetime(2020, 1, 1), b).collect()} == {"added"}


def test_reports(spark):
    rows = {"tables": [("a", "m", "t", 1)], "columns": [("a", "m", "t", 0, "id", "int", False, None, True)]}

    def broken():
        raise OSError("no route")

    catalog, reports = collect.collect(spark, {"a": lambda: rows, "b": broken})
    assert [(r.label, r.ok, r.tables) for r in reports] == [("a", True, 1), ("b", False, 0)]
    assert "no route" in reports[1].error
    assert catalog.columns.count() == 1
    assert 'tablewright_collect_success{label="b"} 0' in collect.metrics_text(reports)


def test_rendering():
    r = Result(["a", "城市"], ["int", "string"], [(1, "x\x1b[31m\x07y"), (None, "上海")], False, 0.5, ["z"])
    assert render.to_table(r).split("\n") == ["a    | 城市", "-----+-----", "1    | xy", "NULL | 上海", "(2 rows)"]
    body = json.loads(render.to_json(r))
    assert (body["rows"][1], body["stripped_columns"], body["columns"][0]) == ([None, "上海"], ["z"], {"name": "a", "type": "int"})


def test_connectivity(spark):
    def broken():
        raise ConnectionError("refused")

    e = Engine(spark).register("good", {"t": spark.range(1)}).register("bad", {"t": broken})
    assert e.check() == {"good": "", "bad": "ConnectionError: refused"}


def test_mapping_fields():
    found = services.elastic_columns({"logs": {"mappings": {"properties": {"at": {"type": "date"}, "user": {"properties": {"id": {"type": "keyword"}}}}}}})
    assert [(c[4], c[5]) for c in found["columns"]] == [("at", "date"), ("user", "object"), ("user.id", "keyword")]


def test_graph_queries(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "node string")
    links = spark.createDataFrame([("a", "b"), ("c", "b")], "a string, b string")
    assert {tuple(r) for r in analysis.degrees(nodes, links).collect()} == {("a", 1), ("b", 2), ("c", 1), ("d", 0)}
    assert analysis.has_edge(links, "b", "c")
    assert not analysis.has_edge(links, "a", "c")
    assert [r.node for r in analysis.isolated(nodes, links).collect()] == ["d"]
    assert {tuple(r) for r in analysis.components(nodes, links).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")}
