"""Readers on files made here, connectors against small local servers."""

import json
import sqlite3
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from socketserver import StreamRequestHandler, TCPServer

import pytest
from pyspark.sql import functions as F

from tablewright.functions import scalars
from tablewright.meta import analysis, context, servers
from tablewright.meta.catalog import from_frames, from_rows
from tablewright.plans.engine import Engine
from tablewright.plans.policy import Policy, PolicyError
from tablewright.sources import dsn, files, jdbc, services, sqlite, xlsx
from tablewright.sources.remote import Remote


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,name,when,x\n1,\"say \"\"hi\"\"\",2024-01-02,1.5\n2,\"two\nlines\",2024-02-03\n3,,2024-03-04,2,extra\n".encode())
    df = files.read_delimited(spark, str(tmp_path / "a.csv"))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "string", "timestamp_ntz", "double"]
    got = rows(df.orderBy("id"))
    assert [r[1] for r in got] == ['say "hi"', "two\nlines", None]
    assert [r[3] for r in got] == [1.5, None, 2.0]


@pytest.mark.parametrize(("name", "sep"), [("tab", "\t"), ("pipe", "|"), ("semicolon", ";")])
def test_delimiters(spark, tmp_path, name, sep):
    (tmp_path / "t.txt").write_text(f"a{sep}b\n1{sep}x\n")
    assert rows(files.read_delimited(spark, str(tmp_path / "t.txt"), delimiter=name)) == [(1, "x")]


def test_gbk_and_folder(spark, tmp_path):
    (tmp_path / "g.csv").write_bytes("编号,城市\n1,上海\n".encode("gbk"))
    df = files.read_delimited(spark, str(tmp_path / "g.csv"), encoding="gbk")
    assert (df.columns, rows(df)) == (["编号", "城市"], [(1, "上海")])
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "1.csv").write_text("a,b\n1,x\n")
    (folder / "2.csv").write_text("other,names\n2,y\n")
    assert sorted(rows(files.read_delimited(spark, str(folder)))) == [(1, "x"), (2, "y")]


@pytest.mark.parametrize(("samples", "kind"), [(["1", "2", "3"], "INTEGER"), (["1", "2.5"], "FLOAT"), (["2024-01-01", "2024-02-15"], "DATE"), (["2024-01-01 12:00:00"], "DATE"), (["hello"], "TEXT"), ([], "TEXT"), (["", "NULL", "1"], "INTEGER"), (["hello", "42", "2024-01-01"], "TEXT"), (["", None], "INTEGER"), (["1d"], "TEXT")])
def test_inferred_types(spark, samples, kind):
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    assert df.agg(scalars.inferred_type(F.col("s"))).first()[0] == kind


def test_scalars(spark):
    df = spark.createDataFrame([("1", "2"), ("a", "1"), ("off", "x")], "a string, b string")
    assert [r[0] for r in df.select(scalars.plus(F.col("a"), F.col("b"))).collect()] == ["3.0", "a1", "offx"]
    assert [r[0] for r in df.select(scalars.truthy(F.col("a"))).collect()] == [True, True, False]
    key = spark.createDataFrame([("s:123e4567-e89b-12d3-a456-426614174000:77:deadbeef01",)], "k string")
    assert key.select(scalars.key_family(F.col("k"))).first()[0] == "s:{uuid}:{id}:{hex}"


def test_inferred_comments(spark):
    """One name for each row of the table, and the order where two rows fit."""
    want = {"user_id": "标识符", "title": "名称", "created_date": "时间", "total": "金额/数量", "order_state": "状态", "is_new": "标志位", "email": "电子邮箱", "mobile": "电话号码", "ip_addr": "IP 地址", "home_url": "URL", "avatar": "图片 URL", "desc": "描述", "api_key": "键", "kind_type": "类型", "body_json": "JSON 数据", "update_time_id": "标识符", "zip": "示例: x", "blob": ""}
    df = spark.createDataFrame([(n, "text", "x" if n == "zip" else "") for n in want], "n string, t string, s string")
    got = {r.n: r.c for r in df.select("n", scalars.inferred_comment(F.col("n"), F.col("t"), F.col("s")).alias("c")).collect()}
    assert got == want
    assert df.limit(1).select(scalars.inferred_comment(F.lit("x"), F.lit("y"), F.lit("a" * 25))).first()[0] == "示例: " + "a" * 20 + "..."


def test_workbook(spark, tmp_path):
    book = xlsx.write_book({"first": [["id", "name"], [1, "a & b"], [2, None]], "second": [["x"], [1.5]]})
    (tmp_path / "w.xlsx").write_bytes(book)
    assert xlsx.sheets(spark, str(tmp_path / "w.xlsx")) == ["first", "second"]
    assert rows(xlsx.read_sheet(spark, str(tmp_path / "w.xlsx"))) == [(1, "a & b"), (2, None)]
    assert rows(xlsx.read_sheet(spark, str(tmp_path / "w.xlsx"), "SECOND")) == [(1.5,)]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "d.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE users (id INTEGER PRIMARY KEY, name TEXT, score REAL)")
        db.execute("CREATE TABLE posts (id INTEGER PRIMARY KEY, user_id INTEGER REFERENCES users(id))")
        db.executemany("INSERT INTO users VALUES (?, ?, ?)", [(k, f"u{k}", k / 2) for k in range(100)])
    df = sqlite.read_table(spark, path, "users")
    assert df.count() == 100
    assert rows(df.where("id = 7").select("name", "score")) == [("u7", 3.5)]
    c = from_rows(spark, sqlite.collect(path))
    assert rows(analysis.declared_refs(c).select("from_table", "from_column", "to_table")) == [("posts", "user_id", "users")]
    assert rows(analysis.lint(c).where("rule = 'unindexed_foreign_key'").select("table", "detail")) == [("posts", "user_id")]


def test_addresses():
    d = dsn.parse("postgres://me:p%40ss@db.example/shop?label=pg&sslmode=require")
    assert (d.kind, d.host, d.port, d.user, d.password, d.database, d.label, d.options) == ("postgres", "db.example", 5432, "me", "p@ss", "shop", "pg", {"sslmode": "require"})
    assert "p@ss" not in repr(d)
    assert jdbc.options(d)["url"] == "jdbc:postgresql://db.example:5432/shop"
    assert dsn.parse("tsv:///data/x.tsv").options == {"delimiter": "tab"}
    assert jdbc.limited("oracle", "SELECT 1", 5).endswith("FETCH FIRST 5 ROWS ONLY")
    with pytest.raises(ValueError, match="unknown"):
        dsn.parse("ftp://x")


def serve(answer):
    """A local server; ``answer(path, body)`` gives the JSON of each request."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            try:
                body = json.dumps(answer(self.path, json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or "null"))).encode()
            except KeyError:
                self.send_error(404)
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        do_POST = do_GET

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server, f"http://127.0.0.1:{server.server_port}"


def test_http_services(spark):
    answers = {"/api/v1/query": {"data": {"resultType": "matrix", "result": [{"metric": {"job": "a"}, "values": [[1, "2"], [2, "3"]]}, {"metric": {"env": "x"}, "values": [[1, "5"]]}]}}, "/collections/c/points/count": {"result": {"count": 7}}, "/collections": {"result": {"collections": [{"name": "c"}]}}, "/collections/c": {"result": {"points_count": 7, "config": {"params": {"vectors": {"size": 4}}}, "payload_schema": {"city": {"data_type": "keyword"}}}}}
    server, base = serve(lambda path, body: answers[path.split("?")[0]])
    assert rows(services.read_prometheus(spark, base, "up").orderBy("timestamp", "value")) == [(None, "a", 1.0, 2.0), ("x", None, 1.0, 5.0), (None, "a", 2.0, 3.0)]
    assert rows(services.read_qdrant(spark, base, '{"count": "c"}')) == [("c", "7")]
    found = services.qdrant_catalog(base)
    assert (found["tables"], [c[4:6] for c in found["columns"]]) == ([("qdrant", "qdrant", "c", 7)], [("id", "id"), ("vector", "float[4]"), ("city", "keyword")])
    server.shutdown()


def test_elastic_pages(spark):
    """All pages of an SQL answer and of a search are read; a body's own size is one page."""
    hits = [{"_id": str(k), "_source": {"b": {"c": k}} | ({"late": "x"} if k == 4 else {})} for k in range(5)]

    def answer(path, body):
        if path.startswith("/_sql"):
            at = int(body.get("cursor", 0))
            assert "cursor" in body or body["fetch_size"] > 0
            return ({"columns": [{"name": "a"}]} if at == 0 else {}) | {"rows": [[f"r{at}"]]} | ({"cursor": str(at + 1)} if at < 3 else {})
        if path == "/_search/scroll":
            at = int(body["scroll_id"])
            return {"hits": {"hits": hits[at : at + 2]}, "_scroll_id": str(at + 2)}
        if path.startswith("/i/_search"):
            return {"hits": {"hits": hits[: body["size"]][:2]}, "_scroll_id": "2"}
        raise KeyError(path)

    server, base = serve(answer)
    assert sorted(rows(services.read_elastic(spark, base, "SELECT a FROM i"))) == [("r0",), ("r1",), ("r2",), ("r3",)]
    df = services.read_elastic(spark, base, "{}", "i")
    assert df.columns == ["_id", "b", "late"]
    assert sorted(rows(df))[-1] == ("4", '{"c": 4}', "x")
    assert df.count() == 5
    assert services.read_elastic(spark, base, '{"size": 1}', "i").count() == 1
    with pytest.raises(services.RequestError):
        services.elastic_names('{"script_fields": {"a": {"script": "x"}}}')
    server.shutdown()


class Documents(list):
    """A stand-in for a MongoDB collection and its cursors."""

    def find(self, filter=None, projection=None):
        return Documents(d for d in self if all(d.get(k) == v for k, v in (filter or {}).items()))

    def limit(self, n):
        return Documents(self[:n])

    def skip(self, n):
        return Documents(self[n:])

    def sort(self, keys):
        return Documents(sorted(self, key=lambda d: [d[k] * way for k, way in keys]))

    def aggregate(self, pipeline):
        return iter(self)

    def estimated_document_count(self):
        return len(self)


class Store(dict):
    def list_collection_names(self):
        return list(self)


def test_mongo(spark):
    client = {"shop": Store(users=Documents([{"_id": 2, "name": "b", "tags": [1, {"x": None}]}, {"_id": 1, "name": "a", "vip": True}]))}
    d = dsn.parse("mongodb://db.example/shop?label=m")
    df = services.read_mongo(spark, d, '{"find": "users", "sort": {"_id": 1}}', client)
    assert (df.columns, rows(df)) == (["_id", "name", "tags", "vip"], [("1", "a", None, "true"), ("2", "b", '[1, {"x": null}]', None)])
    assert services.read_mongo(spark, d, '{"find": "users", "limit": 1}', client).count() == 1
    assert services.read_mongo(spark, d, '{"find": "users", "filter": {"name": "z"}}', client).count() == 0
    found = services.mongo_catalog(client, d)
    assert [(c[4], c[5]) for c in found["columns"]] == [("_id", "int"), ("name", "str"), ("tags", "list"), ("vip", "bool")]
    e = Engine(spark, rules=Policy(deny_tables=("secrets",), deny_columns=("name",))).attach("m", Remote(d, client))
    assert e.ask("m", '{"find": "users"}').columns == ["_id", "tags", "vip"]
    for text in ('{"find": "secrets"}', '{"find": "users", "filter": {"name": "a"}}', '{"aggregate": "users", "pipeline": [{"$lookup": {"from": "secrets"}}]}', '{"aggregate": "users", "pipeline": [{"$unionWith": "secrets"}]}'):
        with pytest.raises(PolicyError):
            e.ask("m", text)


def test_engine_asks_servers(spark, tmp_path):
    def answer(path, body):
        assert "query=" in path
        return {"data": {"resultType": "vector", "result": [{"metric": {"zone": "n"}, "value": [1, "2"]}, {"metric": {"zone": "s"}, "value": [1, "3"]}]}}

    server, base = serve(answer)
    path = str(tmp_path / "d.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE zones (zone TEXT, city TEXT, code)")
        db.executemany("INSERT INTO zones VALUES (?, ?, ?)", [("n", "Oslo", 1), ("s", "Rome", "x7")])
    e = Engine(spark, rules=Policy(deny_tables=("hidden*",), mask_columns=("city",)))
    e.attach("mon", Remote(dsn.parse(base.replace("http", "prometheus")))).attach("db", Remote(dsn.parse(f"sqlite://{path}")))
    assert [tuple(r) for r in e.execute("SELECT z.zone, p.value FROM @mon.promql(sum by (zone) (queue_depth{a=\"(\"})) p JOIN @db.zones z ON p.zone = z.zone ORDER BY z.zone").rows] == [("n", 2.0), ("s", 3.0)]
    assert e.execute("SELECT city AS x FROM @db.zones LIMIT 1").rows == [("***",)]
    assert sorted(e.ask("db", "SELECT zone, code FROM zones").rows) == [("n", "1"), ("s", "x7")]
    assert e.ask("db", "SELECT city FROM zones").rows == [("***",), ("***",)]
    assert e.ask("mon", "queue_depth", limit=1).truncated
    for label, text in (("mon", "hidden_metric"), ("mon", '{__name__="hidden_metric"}'), ("db", "SELECT * FROM hidden"), ("db", "SELECT city AS x FROM zones"), ("db", "DROP TABLE zones"), ("db", "PRAGMA journal_mode(WAL)")):
        with pytest.raises(PermissionError):
            e.ask(label, text)
    with pytest.raises(PolicyError):
        e.query("SELECT * FROM @mon.promql(hidden_metric)")
    with pytest.raises(LookupError):
        e.ask("nobody", "x")
    server.shutdown()


def test_late_cells_are_kept(spark, tmp_path):
    (tmp_path / "late.csv").write_text("id,n,d\n" + "".join(f"{k},{k},2024-01-0{k % 9 + 1}\n" for k in range(150)) + "150,A7,soon\n151,,\n")
    df = files.read_delimited(spark, str(tmp_path / "late.csv"))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "string", "string"]
    assert rows(df.where("id >= 149").orderBy("id")) == [(149, "149", "2024-01-06"), (150, "A7", "soon"), (151, None, None)]
    book = xlsx.write_book({"s": [["id", "n"], *([k, k] for k in range(150)), [150, "A7"]]})
    (tmp_path / "late.xlsx").write_bytes(book)
    assert rows(xlsx.read_sheet(spark, str(tmp_path / "late.xlsx")).where("id = 150")) == [(150, "A7")]
    assert files.sampled_types(df)["n"] == "INTEGER"


def test_plain_lines_are_split(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n" + 'x,"say ""hi"""\n' * 50_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    assert files.read_delimited(spark, str(tmp_path / "a.csv")).rdd.getNumPartitions() > 2
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "b.csv").write_text('a,b\nx,"two\nlines"\n')
    assert rows(files.read_delimited(spark, str(tmp_path / "b.csv"))) == [("x", "two\nlines")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_delimited(spark, str(tmp_path / "none.csv"))


def test_server_catalogs(spark, tmp_path):
    """DuckDB's catalog from a live database; the other kinds' rows from recorded answers."""
    import duckdb

    db = duckdb.connect()
    db.execute("CREATE TABLE users (id INTEGER PRIMARY KEY, name VARCHAR NOT NULL, since DATE DEFAULT current_date)")
    db.execute("CREATE TABLE posts (id INTEGER, user_id INTEGER REFERENCES users(id))")
    db.execute("CREATE INDEX by_user ON posts (user_id)")
    found = servers.collect(dsn.parse("duckdb:///x.db?label=d"), lambda sql: db.execute(sql).fetchall())
    c = from_rows(spark, found)
    assert {(r["table"], r["column"], r["is_primary"]) for r in c.columns.where("table = 'users'").collect()} == {("users", "id", True), ("users", "name", False), ("users", "since", False)}
    assert rows(analysis.declared_refs(c).select("from_table", "from_column", "to_table", "to_column")) == [("posts", "user_id", "users", "id")]
    assert analysis.lint(c).where("rule = 'unindexed_foreign_key'").count() == 0
    recorded = {"tables": [("s", "t", 3.0)], "columns": [("s", "t", 0, "a", "int", 1, None, 1), ("s", "t", 1, "b", "int", 0, "7", 0)], "indexes": [("s", "t", "i", "b", 2, 1), ("s", "t", "i", "a", 1, 1)], "fks": [("s", "t", "b", "u", "id")]}
    for kind in ("mysql", "postgres", "gaussdb", "oracle", "clickhouse", "starrocks"):
        d = dsn.parse(f"{kind}://me@h/shop?label=x")
        asked = {sql.format(db="shop", user="me"): recorded[k] for k, sql in servers.STATEMENTS[kind].items()}
        out = servers.collect(d, asked.__getitem__)
        assert out["columns"][1] == ("x", "s", "t", 1, "b", "int", False, "7", False)
        assert out["indexes"] == ([("x", "s", "t", "i", ["a", "b"], True)] if "indexes" in servers.STATEMENTS[kind] else [])
        from_rows(spark, out).columns.count()


def test_hive_and_file_catalogs(spark, tmp_path):
    spark.sql("CREATE TABLE IF NOT EXISTS default.tw_facts (a INT, b STRING) USING parquet")
    spark.sql("INSERT INTO default.tw_facts VALUES (1, 'x')")
    spark.sql("ANALYZE TABLE default.tw_facts COMPUTE STATISTICS")
    found = servers.collect_hive(spark, "default")
    assert ("hive", "default", "tw_facts", 1) in found["tables"]
    assert [(c[4], c[5]) for c in found["columns"] if c[2] == "tw_facts"] == [("a", "int"), ("b", "string")]
    assert servers.described(spark, "default.tw_facts")["Provider"] == "parquet"
    spark.sql("DROP TABLE default.tw_facts")
    (tmp_path / "p.tsv").write_text("a\tb\n1\tx\n2\ty\n")
    found = servers.collect_files(spark, dsn.parse(f"tsv://{tmp_path}/p.tsv"))
    assert (found["tables"], [c[4:6] for c in found["columns"]]) == ([("p", "csv", "p", 2)], [("a", "INTEGER"), ("b", "TEXT")])


def test_context(spark, tmp_path):
    c = from_rows(spark, {"tables": [("i", "d", "a", 5), ("i", "d", "b", 2), ("i", "d", "lone", 0)], "columns": [("i", "d", t, k, n, "int", True, None, n == "id") for t in ("a", "b", "lone") for k, n in enumerate(("id", "b_id") if t == "a" else ("id", "x"))], "indexes": [("i", "d", "a", "ix", ["b_id"], False)], "fks": []})
    refs = analysis.all_refs(c)
    lines = [r.json for r in context.schema_json(c).orderBy("table").collect()]
    back = from_rows(spark, context.from_json(lines))
    assert rows(analysis.delta(analysis.fingerprints(c), analysis.fingerprints(back))) == []
    assert json.loads(lines[2])["foreign_keys"] == []
    assert [(r["table"], r.degree, r.refers_to) for r in context.topology(c, refs, top=2).collect()] == [("a", 1, ["b_id -> b.id"]), ("b", 1, [])]
    spark.sparkContext.setCheckpointDir(f"{tmp_path}/checkpoints")
    assert {(r.chunk, r.part, r["table"]) for r in context.chunks(c, refs, most_columns=3).collect()} == {("i/d/a", 0, "b"), ("i/d/a", 0, "a"), ("i/d/lone", 0, "lone")}
    context.write_context(c, refs, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out/report")).first()[0] == "3 tables, 6 columns, 1 references"
    assert spark.read.json(str(tmp_path / "out/topology")).count() == 3


def test_redis(spark):
    class Handler(StreamRequestHandler):
        def handle(self):
            while line := self.rfile.readline():
                words = []
                for _ in range(int(line[1:])):
                    n = int(self.rfile.readline()[1:])
                    words.append(self.rfile.read(n + 2)[:-2].decode())
                self.wfile.write({"GET": b"$1\r\n7\r\n", "TYPE": b"+string\r\n", "TTL": b":90\r\n", "LRANGE": b"*2\r\n$1\r\na\r\n$-1\r\n", "SCAN": b"*2\r\n$1\r\n0\r\n*1\r\n$4\r\nk:12\r\n"}[words[0]])

    server = TCPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    port = server.server_address[1]
    assert rows(services.read_redis(spark, "127.0.0.1", port, "GET x")) == [("7",)]
    assert rows(services.read_redis(spark, "127.0.0.1", port, "LRANGE l 0 -1")) == [("a",), (None,)]
    assert list(services.RedisClient("127.0.0.1", port).keys()) == ["k:12"]
    keys = services.redis_keys(spark, "127.0.0.1", port)
    assert rows(keys) == [("k:12", "string", 90)]
    assert rows(analysis.key_families(keys)) == [("k:{id}", 1, "k:12")]
    e = Engine(spark, rules=Policy(deny_tables=("secret:*",))).attach("r", Remote(dsn.parse(f"redis://127.0.0.1:{port}/0")))
    assert e.ask("r", "GET x").rows == [("7",)]
    with pytest.raises(PolicyError):
        e.ask("r", "GET secret:1")
    server.shutdown()


def test_native_requests():
    with pytest.raises(services.RequestError):
        services.check_redis("FLUSHALL")
    with pytest.raises(services.RequestError):
        services.check_mongo('{"aggregate": "c", "pipeline": [{"$facet": {"a": [{"$out": "x"}]}}]}')
    assert services.check_mongo('{"find": "c", "filter": {}}')["find"] == "c"
    assert services.qdrant_request('{"count": "points"}') == ("count", "points")
    with pytest.raises(services.RequestError):
        services.qdrant_request('{"search": {}}')


def test_schema_diff(spark):
    old = from_frames(spark, {"t": spark.createDataFrame([], "id int")})
    new = from_frames(spark, {"t": spark.createDataFrame([], "ID int, email string")})
    assert rows(analysis.diff_columns(old, new).select("column", "change", "new")) == [("email", "added", "string")]
    assert rows(analysis.delta(analysis.fingerprints(old), analysis.fingerprints(new)).select("change")) == [("changed",)]
    assert rows(analysis.delta(analysis.fingerprints(old), analysis.fingerprints(old))) == []
