"""Dialect, guard, policy, PromQL and result envelope; one test for each deliberate departure from plain Spark."""

import threading

import pytest

from tablewright.plans import dialect, guard, native, policy, promql
from tablewright.plans.engine import Engine


def engine(spark, **options):
    t = spark.createDataFrame([(1, "Ann", 10.0, None), (2, "bob", 20.0, "x"), (3, "Cid", 20.0, "y"), (4, None, 5.0, "x")], "id long, name string, v double, secret string")
    u = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "tid long, tag string")
    return Engine(spark, **options).register("main", {"t": t, "u": u})


def values(df):
    return [tuple(r) for r in df.collect()]


def test_references_outside_literals_only():
    assert dialect.references("SELECT '@a.b' FROM @x.t JOIN @y.u -- @c.d\n ON 1 = 1 JOIN @x.t") == [("x", "t"), ("y", "u")]


@pytest.mark.parametrize(("sql", "rows"), [
    ("SELECT id FROM t WHERE name LIKE 'A%'", [(1,)]),
    ("SELECT id FROM t WHERE name LIKE 'BOB'", [(2,)]),
    ("SELECT id FROM t WHERE name NOT LIKE '%b%'", [(1,), (3,)]),
    ("SELECT id FROM t WHERE id = 1 OR id = 2 AND v > 100", [(1,)]),
    ("SELECT name FROM t ORDER BY name", [("Ann",), ("Cid",), ("bob",), (None,)]),
    ("SELECT name FROM t ORDER BY name DESC", [(None,), ("bob",), ("Cid",), ("Ann",)]),
    ("SELECT CAST('12.0' AS INT) AS a, CAST('x' AS FLOAT) AS b", [(None, None)]),
    ("SELECT ROUND(2.5) AS a, ROUND(-1.005, 2) AS b", [(3.0, -1.0)]),
    ("SELECT count(name) AS n, count(*) AS m, count(DISTINCT v) AS d FROM t", [(3, 4, 3)]),
    ("SELECT count(*) AS n FROM t WHERE id > 9", [(0,)]),
    ("SELECT sum(v * 2) AS s, sum(v) / count(*) AS m FROM t", [(110.0, 13.75)]),
    ("SELECT v FROM t GROUP BY v ORDER BY v", [(5.0,), (10.0,), (20.0,)]),
    ("SELECT DISTINCT v FROM t ORDER BY v LIMIT 2", [(5.0,), (10.0,)]),
    ("SELECT id, sum(v) OVER (ORDER BY v) AS s FROM t WHERE v = 20 ORDER BY s", [(2, 20.0), (3, 40.0)]),
    ("SELECT DISTINCT ON (v) v, id FROM t ORDER BY v DESC, id DESC LIMIT 2", [(20.0, 3), (10.0, 1)]),
    ("SELECT t.id, u.tag FROM t LEFT JOIN u ON t.id = u.tid ORDER BY t.id LIMIT 3", [(1, "a"), (2, "b"), (3, None)]),
    ("SELECT u.tag, t.id FROM t RIGHT JOIN u ON t.id = u.tid ORDER BY u.tag", [("a", 1), ("b", 2), ("c", None)]),
    ("SELECT id FROM t WHERE id IN (SELECT tid FROM u)", [(1,), (2,)]),
    ("SELECT tag FROM u WHERE tid = 1 UNION SELECT name FROM t WHERE id = 1 ORDER BY tag", [("Ann",), ("a",)]),
    ("SELECT rank() OVER (ORDER BY v DESC) AS r FROM t ORDER BY r", [(1,), (1,), (3,), (4,)]),
    ("SELECT lag(id, 2) OVER (ORDER BY id) AS p FROM t ORDER BY p", [(1,), (2,), (None,), (None,)]),
])
def test_dialect(spark, sql, rows):
    assert values(engine(spark).query(sql)) == rows


@pytest.mark.parametrize("sql", ["select 1", "WITH a AS (SELECT 1 AS x) SELECT * FROM a", "SELECT 'DROP TABLE x' AS s", "EXPLAIN SELECT 1", "SELECT 1 UNION ALL SELECT 2", "SELECT /*+ BROADCAST(a) */ 1 AS a"])
def test_guard_allows(spark, sql):
    guard.check_read_only(spark, sql)


@pytest.mark.parametrize("sql", ["DROP TABLE t", "INSERT INTO t VALUES (1)", "CREATE TABLE a AS SELECT 1", "SELECT 1; SELECT 2", "SET x = 1", "TRUNCATE TABLE t", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "EXPLAIN INSERT INTO t VALUES (1)", "MERGE INTO t USING u ON t.id = u.tid WHEN MATCHED THEN DELETE", "CACHE TABLE t", "ALTER TABLE t ADD COLUMN x INT", "UPDATE t SET v = 1", "DELETE FROM t", "", "not sql"])
def test_guard_rejects(spark, sql):
    with pytest.raises(guard.GuardError):
        guard.check_read_only(spark, sql)


@pytest.mark.parametrize("sql", ["SHOW TABLES", "DESC t", "PRAGMA table_info(t)", "CHECK TABLE t", "SELECT a INTO @x FROM t", "EXPLAIN (ANALYZE, BUFFERS, FORMAT TEXT) SELECT 1", "EXPLAIN FORMAT=JSON SELECT 1", "EXPLAIN QUERY PLAN SELECT 1", "EXPLAIN PLAN FOR SELECT 1", "EXPLAIN /* c */ VERBOSE SELECT 1", "SELECT 'delete from t'", "SELECT replace(a, 'b', 'c') FROM t", "SELECT 1 AS set"])
def test_native_allows(sql):
    native.check_native(sql)


@pytest.mark.parametrize("sql", ["DELETE FROM t", "SELECT 1; DROP TABLE t", "SELECT * INTO x FROM t", "WITH d AS (DELETE FROM t RETURNING *) SELECT * FROM d", "EXPLAIN ANALYZE DELETE FROM t", "PRAGMA journal_mode = WAL", "SELECT 1 FOR UPDATE", "COPY t TO 'f'"])
def test_native_rejects(sql):
    with pytest.raises(guard.GuardError):
        native.check_native(sql)


@pytest.mark.parametrize("sql", ["SELECT * FROM u x", "SELECT * FROM t JOIN u ON t.id = u.tid", "SELECT * FROM t WHERE id IN (SELECT tid FROM u)", "WITH a AS (SELECT * FROM u) SELECT 1 AS one FROM a", "SELECT * FROM @main.u", "SELECT (SELECT max(tid) FROM u) AS m"])
def test_denied_table(spark, sql):
    with pytest.raises(policy.PolicyError):
        engine(spark, rules=policy.Policy(deny_tables=("U",))).query(sql)


@pytest.mark.parametrize("sql", ["SELECT secret FROM t", "SELECT x.secret AS y FROM t x", "SELECT id FROM t WHERE secret = 'x'", "SELECT upper(a.secret) AS s FROM (SELECT * FROM t) a", "SELECT count(secret) AS n FROM t", "SELECT id FROM t ORDER BY secret"])
def test_denied_column(spark, sql):
    with pytest.raises(policy.PolicyError):
        engine(spark, rules=policy.Policy(deny_columns=("t.sec*",))).query(sql)


def test_star_strips_denied_columns(spark):
    result = engine(spark, rules=policy.Policy(deny_columns=("t.secret",))).execute("SELECT * FROM t")
    assert result.columns == ["id", "name", "v"]
    assert result.stripped == ["secret"]
    assert engine(spark, rules=policy.Policy(deny_columns=("t.secret",))).query("SELECT id, tag FROM t JOIN u ON id = tid").count() == 2


def test_masks_and_statement_rules(spark):
    masked = engine(spark, rules=policy.Policy(mask_columns=("t.NAM?",), mask="#")).query("SELECT id, name FROM t ORDER BY id")
    assert values(masked) == [(1, "#"), (2, "#"), (3, "#"), (4, None)]
    with pytest.raises(policy.PolicyError):
        engine(spark, rules=policy.Policy(deny_statements=("cross join",))).query("SELECT 1 AS a FROM t CROSS  JOIN u")


def test_policy_from_environment():
    env = {"DENY_TABLES": "users, orders", "DB1_DENY_TABLES": "secrets", "DENY_COLUMNS": "users.password"}
    assert policy.Policy.from_env(env, "DB1").deny_tables == ("users", "orders", "secrets")
    assert policy.Policy.from_env(env).deny_columns == ("users.password",)
    with pytest.raises(policy.PolicyError):
        policy.check_native(policy.Policy(deny_columns=("password",)), ["users"], ["Password"])
    with pytest.raises(policy.PolicyError):
        policy.check_native(policy.Policy(deny_tables=("user:*",)), ["user:1"], [])


def test_row_limit_and_lock(spark):
    e = engine(spark, max_rows=2)
    assert (e.execute("SELECT * FROM t").row_count, e.execute("SELECT * FROM t").truncated) == (2, True)
    assert e.execute("SELECT * FROM t LIMIT 3").row_count == 3
    assert not e.execute("SELECT * FROM t", limit=10).truncated
    e.locks["main"] = threading.Lock()
    e.locks["main"].acquire()
    with pytest.raises(BlockingIOError):
        e.execute("SELECT * FROM @main.t")


def test_unknown_function_raises(spark):
    with pytest.raises(Exception, match="UNRESOLVED_ROUTINE"):
        engine(spark).query("SELECT nosuch(id) FROM t")


@pytest.mark.parametrize(("sql", "text"), [
    ("SELECT * FROM @mon.queue_depth", "queue_depth"),
    ("SELECT * FROM @mon.queue_depth WHERE shard='7'", 'queue_depth{shard="7"}'),
    ("SELECT * FROM @mon.queue_depth WHERE shard='7' AND zone='north'", 'queue_depth{shard="7",zone="north"}'),
    ("SELECT * FROM @mon.queue_depth WHERE shard!='7'", 'queue_depth{shard!="7"}'),
    ("SELECT zone, count(value) FROM @mon.queue_depth GROUP BY zone", "count by (zone) (queue_depth)"),
    ("SELECT zone FROM queue_depth WHERE disk LIKE '/d%_.x' ORDER BY zone", 'queue_depth{disk=~"/d.*.\\\\.x"}'),
])
def test_promql_text(sql, text):
    assert promql.compile_sql(sql) == text


@pytest.mark.parametrize("sql", ["SELECT COUNT(*) FROM @mon.queue_depth", "SELECT * FROM queue_depth GROUP BY zone", "SELECT * FROM a JOIN b ON 1 = 1", "SELECT * FROM queue_depth WHERE value > 1", "SELECT * FROM queue_depth WHERE a = 'x' OR b = 'y'", "SELECT zone, sum(value), max(value) FROM queue_depth GROUP BY zone"])
def test_promql_errors(sql):
    with pytest.raises(promql.PromError):
        promql.compile_sql(sql)


@pytest.mark.parametrize(("text", "names"), [
    ("queue_depth", (["queue_depth"], [])),
    ('sum by (zone) (rate(hits_total{zone="n",disk=~"d.*"}[5m])) / on (zone) group_left (team) limits', (["hits_total", "limits"], ["zone", "disk", "team"])),
    ('{__name__=~"a|b", zone!="x"}', (["a", "b"], ["__name__", "zone"])),
    ("topk(3, a offset 5m) and b > bool 1e3", (["a", "b"], [])),
    ('label_replace(a, "x", "$1", "y", "(.*)")', (["a"], [])),
])
def test_promql_names(text, names):
    assert policy.promql_names(text) == names


@pytest.mark.parametrize("sql", ["SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "SELECT id FROM t WHERE reflect('a.B', 'c') = '1'", "SELECT try_reflect('a.B', 'c')", "SELECT sum(v) OVER w FROM t WINDOW w AS (ORDER BY `reflect`('a.B', 'c'))", "WITH a AS (SELECT system.builtin.reflect('a.B', 'c') AS x) SELECT * FROM a", "SELECT IDENTIFIER('ref' || 'lect')('a.B', 'c')", "SELECT * FROM IDENTIFIER('t')", "SELECT TRANSFORM(id) USING 'cat' FROM t", "EXECUTE IMMEDIATE 'SELECT 1'", "BEGIN SELECT 1; END", "SELECT * FROM some_function(1)", "ADD JAR 'x.jar'", "DECLARE VARIABLE x INT", "SELECT 1 AS a FROM t WHERE id IN (SELECT reflect('a.B', 'c'))"])
def test_guard_refuses_code(spark, sql):
    with pytest.raises(guard.GuardError):
        guard.check_read_only(spark, sql)


@pytest.mark.parametrize("sql", ["SELECT 1 AS reflect", "SELECT * FROM range(3)", "SELECT explode(array(1, 2))", "SELECT * FROM t LATERAL VIEW explode(array(1)) x AS y", "VALUES (1), (2)", "TABLE t", "SHOW TABLES", "DESCRIBE t", "SELECT * FROM t UNPIVOT (v FOR k IN (a, b))", "SELECT 'reflect(x)' AS s", "FROM t |> WHERE id > 1"])
def test_guard_allows_reads(spark, sql):
    guard.check_read_only(spark, sql)


def test_only_registered_tables(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in/x.parquet")
    spark.range(3).write.parquet(f"{tmp_path}/out/x.parquet")
    spark.range(5).createOrReplaceTempView("beside")
    e = engine(spark, folder=f"{tmp_path}/in")
    assert e.query(f"SELECT id FROM parquet.`{tmp_path}/in/x.parquet`").count() == 3
    for sql in (f"SELECT * FROM parquet.`{tmp_path}/out/x.parquet`", f"SELECT * FROM parquet.`{tmp_path}/in/../out/x.parquet`", "SELECT * FROM beside", "SELECT id FROM t WHERE id IN (SELECT id FROM beside)", "SELECT * FROM global_temp.x"):
        with pytest.raises(policy.PolicyError):
            e.query(sql)
    with pytest.raises(policy.PolicyError):
        engine(spark, rules=policy.Policy(deny_tables=("*in/x*",)), folder=f"{tmp_path}/in").query(f"SELECT * FROM parquet.`{tmp_path}/in/x.parquet`")


@pytest.mark.parametrize(("sql", "rows"), [
    ("SELECT name AS x, upper(name) AS y, id FROM t WHERE id = 1", [("#", "#", 1)]),
    ("WITH a AS (SELECT name AS n FROM t WHERE id = 1) SELECT n FROM a", [("#",)]),
    ("SELECT 'q' AS x UNION ALL SELECT name FROM t WHERE id = 1", [("#",), ("#",)]),
    ("SELECT x FROM (SELECT explode(array(name)) AS x FROM t WHERE id = 1) a", [("#",)]),
    ("SELECT (SELECT max(name) FROM t) AS m", [("#",)]),
    ("SELECT max(name) AS m, count(name) AS n FROM t", [("#", 3)]),
    ("SELECT first_value(name) OVER (ORDER BY id) AS f FROM t WHERE id = 1", [("#",)]),
    ("SELECT tag AS name FROM u WHERE tid = 1", [("a",)]),
    ("SELECT id, name = 'Ann' AS same FROM t WHERE id = 1", [(1, "#")]),
    ("SELECT name FROM t WHERE id = 4", [(None,)]),
])
def test_masks_follow_columns(spark, sql, rows):
    assert values(engine(spark, rules=policy.Policy(mask_columns=("t.name",), mask="#")).query(sql)) == rows


@pytest.mark.parametrize("sql", ["WITH a AS (SELECT * FROM t) SELECT max(secret) AS m FROM a", "SELECT to_json(struct(*)) AS j FROM t", "SELECT struct(x.*) AS s FROM t x", "SELECT id FROM t UNION ALL SELECT length(secret) FROM t", "SELECT id FROM u JOIN t ON u.tag = t.secret"])
def test_denied_columns_behind_expressions(spark, sql):
    with pytest.raises(policy.PolicyError):
        engine(spark, rules=policy.Policy(deny_columns=("t.secret",))).query(sql)


def test_strips_through_common_tables(spark):
    assert engine(spark, rules=policy.Policy(deny_columns=("t.secret",))).query("WITH a AS (SELECT * FROM t) SELECT * FROM a").columns == ["id", "name", "v"]


@pytest.mark.parametrize(("sql", "rows"), [
    ("SELECT id FROM t WHERE 1 / (id - 1) > 0.4", [(2,), (3,)]),
    ("SELECT id FROM t WHERE name > 5", []),
    ("SELECT id FROM t WHERE id NOT IN (SELECT tid FROM u)", [(3,), (4,)]),
    ("SELECT name + 'x' AS y FROM t WHERE id < 3 ORDER BY id", [("Annx",), ("bobx",)]),
    ("SELECT (name + '-') + name AS y FROM t WHERE id = 1", [("Ann-Ann",)]),
    ("SELECT '1' + '2' AS y, id + 1 AS n, v + id AS m FROM t WHERE id = 1", [(3.0, 2, 11.0)]),
    ("WITH t AS (SELECT * FROM t WHERE id = 1) SELECT t.id FROM t", [(1,)]),
    ("SELECT t.id, x.id AS other FROM t JOIN t x ON t.id = x.id WHERE t.id = 1", [(1, 1)]),
    ("SELECT u.tag AS t FROM u WHERE tid = 1", [("a",)]),
    ("SELECT v, name, count(*) AS n FROM t WHERE id < 3 GROUP BY v ORDER BY v", [(10.0, "Ann", 1), (20.0, "bob", 1)]),
    ("SELECT x.v AS w, max(x.id) AS m, x.secret AS s FROM t x WHERE id = 3 GROUP BY x.v HAVING m > 0", [(20.0, 3, "y")]),
    ("SELECT sum(n) AS s FROM (SELECT v, name, count(*) AS n FROM t GROUP BY v) a", [(4,)]),
    ("SELECT v + 1 AS w, count(*) AS n FROM t GROUP BY v + 1 ORDER BY w LIMIT 1", [(6.0, 1)]),
    ("SELECT v, count(*) AS n FROM t GROUP BY ROLLUP (v) ORDER BY n DESC LIMIT 1", [(None, 4)]),
    ("SELECT DISTINCT ON (v) v, id FROM (SELECT * FROM t WHERE v = 20) z", [(20.0, 2)]),
])
def test_dialect_conventions(spark, sql, rows):
    assert values(engine(spark).query(sql)) == rows


def test_engines_keep_apart(spark):
    a = Engine(spark).register("main", {"t": spark.range(1)})
    b = Engine(spark).register("main", {"t": spark.range(2)})
    first, second = a.query("SELECT * FROM t"), b.query("SELECT * FROM t")
    assert (first.count(), second.count()) == (1, 2)
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"  # the engine's setting is its own session's


def test_locks_go_by_the_tables_read(spark):
    e = engine(spark)
    with e._locked(["main"]):
        with pytest.raises(BlockingIOError):
            e.execute("SELECT * FROM t")
        assert e.execute("SELECT 1 AS a").row_count == 1


def test_own_limit_is_bounded(spark):
    e = engine(spark, most_rows=2)
    with pytest.raises(ValueError, match="more than 2 rows"):
        e.execute("SELECT * FROM t LIMIT 3")


@pytest.mark.parametrize("sql", ["PRAGMA journal_mode(WAL)", "PRAGMA main.journal_mode(WAL)", "PRAGMA user_version = 3"])
def test_native_pragmas_that_set(sql):
    with pytest.raises(guard.GuardError):
        native.check_native(sql)


def test_promql_references():
    sql = "SELECT x.zone FROM @mon.promql(sum by (zone) (rate(a{b=\"x)\"}[5m]))) x JOIN @db.t ON TRUE"
    assert dialect.promql_calls(sql) == [("mon", 'sum by (zone) (rate(a{b="x)"}[5m]))')]
    assert dialect.references(dialect.with_views(sql)) == [("db", "t")]
