"""Sources that speak their own protocols: Prometheus, Elasticsearch, Qdrant, MongoDB and Redis.

Requests are checked before they are sent, answers are flattened to rows; both are plain functions. Prometheus, Elasticsearch
and Qdrant are read over HTTP, Redis over its text protocol, MongoDB through its own driver where that is installed. Answers
that come in pages are read page by page by an executor task, to the end. Tests run them against small local servers.
"""

from __future__ import annotations

import json
import re
import socket
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tablewright.sources.dsn import Dsn

#: Redis commands that only read.
REDIS_READS = frozenset("GET MGET STRLEN GETRANGE EXISTS TYPE TTL PTTL SCAN DBSIZE INFO HGET HGETALL HKEYS HVALS HLEN HEXISTS HSCAN LRANGE LLEN LINDEX SMEMBERS SCARD SISMEMBER SSCAN ZRANGE ZCARD ZSCORE ZCOUNT ZRANK ZSCAN XRANGE XLEN MEMORY".split())
#: MongoDB stages that write or show the server's inside.
MONGO_DENIED = frozenset({"$out", "$merge", "$indexStats", "$currentOp", "$collStats"})


class RequestError(PermissionError):
    """A request that isn't a plain read."""


def fetch(url: str, body: dict | None = None, timeout: float = 30.0) -> dict:
    """JSON over HTTP."""
    data = None if body is None else json.dumps(body).encode()
    with urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": "application/json"}), timeout=timeout) as answer:
        return json.load(answer)


def prometheus_rows(answer: dict) -> tuple[list[str], list[tuple]]:
    """Label columns in order, then timestamp and value; a matrix gives a row per sample, scalars and strings one row."""
    data = answer.get("data", answer)
    kind, result = data["resultType"], data["result"]
    if kind in ("scalar", "string"):
        return ["timestamp", "value"], [(float(result[0]), result[1])]
    labels = sorted({k for series in result for k in series["metric"]})
    rows = []
    for series in result:
        own = tuple(series["metric"].get(k) for k in labels)
        for at, value in series["values"] if kind == "matrix" else [series["value"]]:
            rows.append((*own, float(at), float(value)))
    return [*labels, "timestamp", "value"], rows


def _frame(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    kinds = {c: T.DoubleType() if c in ("timestamp", "value") and all(isinstance(r[k], float) for r in rows) else T.StringType() for k, c in enumerate(columns)}
    return spark.createDataFrame(rows, T.StructType([T.StructField(c, kinds[c]) for c in columns]))


def read_prometheus(spark: SparkSession, base: str, promql: str) -> DataFrame:
    """What an instant query returns; the server bounds its size."""
    return _frame(spark, *prometheus_rows(fetch(f"{base.rstrip('/')}/api/v1/query?{urllib.parse.urlencode({'query': promql})}")))


def prometheus_catalog(base: str, label: str = "prometheus") -> dict[str, list[tuple]]:
    """Rows for the metadata tables: one table of label names and one of metrics."""
    labels = fetch(f"{base.rstrip('/')}/api/v1/labels")["data"]
    metrics = fetch(f"{base.rstrip('/')}/api/v1/label/__name__/values")["data"]
    tables = [(label, "prometheus", "_labels", len(labels)), (label, "prometheus", "_metrics", len(metrics))]
    columns = [(label, "prometheus", t, k, n, "string", True, None, False) for t, names in (("_labels", labels), ("_metrics", metrics)) for k, n in enumerate(names)]
    return {"tables": tables, "columns": columns}


def elastic_columns(mapping: dict, label: str = "elasticsearch") -> dict[str, list[tuple]]:
    """Rows for the metadata tables from an index mapping; nested fields are named by their path."""
    out: dict[str, list[tuple]] = {"tables": [], "columns": []}

    def fields(properties: dict, before: str = ""):
        for name, field in sorted(properties.items()):
            yield f"{before}{name}", field.get("type", "object")
            yield from fields(field.get("properties", {}), f"{before}{name}.")

    for index, body in sorted(mapping.items()):
        out["tables"].append((label, "elasticsearch", index, 0))
        out["columns"] += [(label, "elasticsearch", index, k, n, t, True, None, False) for k, (n, t) in enumerate(fields(body["mappings"].get("properties", {})))]
    return out


def elastic_rows(answer: dict, names: list[str] | None = None) -> tuple[list[str], list[tuple]]:
    """Rows of an SQL answer, or of search hits with ``_id`` first, the fields ``names`` (all, by default) and nested values as JSON."""
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if "columns" in answer:
        return [c["name"] for c in answer["columns"]], [tuple(map(text, r)) for r in answer["rows"]]
    hits = answer["hits"]["hits"]
    names = sorted({k for h in hits for k in h["_source"]}) if names is None else names
    return ["_id", *names], [(h["_id"], *(text(h["_source"].get(k)) for k in names)) for h in hits]


def _paged(spark: SparkSession, columns: list[str], pages: Callable[[], Iterator[list[tuple]]]) -> DataFrame:
    """Text rows that one executor task reads page by page, so no page but the current one is held."""
    names = [f"c{k}" for k in range(len(columns))]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for rows in pages():
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([None if r[k] is None else str(r[k]) for r in rows], pa.string()) for k in range(len(columns))], names=names)

    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.range(0, 1, 1, 1).mapInArrow(run, schema).toDF(*columns)


#: Rows that a server is asked for at a time.
PAGE = 1000


def read_elastic(spark: SparkSession, base: str, query: str, index: str = "") -> DataFrame:
    """An SQL text, or a JSON search body on ``index``: all rows, page by page. A body's own ``size`` is its limit.

    The columns of a search are the fields of the index's mapping, or of the hits where there is none.
    """
    base = base.rstrip("/")
    if not query.lstrip().startswith("{"):
        first = fetch(f"{base}/_sql?format=json", {"query": query, "fetch_size": PAGE})
        columns, _ = elastic_rows(first)

        def sql_pages():
            answer = fetch(f"{base}/_sql?format=json", {"query": query, "fetch_size": PAGE})
            while True:
                yield elastic_rows({"columns": first["columns"], "rows": answer.get("rows", [])})[1]
                if not answer.get("cursor"):
                    return
                answer = fetch(f"{base}/_sql?format=json", {"cursor": answer["cursor"]})

        return _paged(spark, columns, sql_pages)
    body = json.loads(query)
    whole = "size" not in body

    def pages():
        answer = fetch(f"{base}/{index}/_search" + ("?scroll=1m" if whole else ""), body | ({"size": PAGE} if whole else {}))
        while answer["hits"]["hits"]:
            yield answer["hits"]["hits"]
            if not whole or not answer.get("_scroll_id"):
                return
            answer = fetch(f"{base}/_search/scroll", {"scroll": "1m", "scroll_id": answer["_scroll_id"]})

    try:
        fields = [c[4] for c in elastic_columns(fetch(f"{base}/{index}/_mapping"))["columns"]]
        names = sorted({f.split(".")[0] for f in fields})
    except (OSError, KeyError, AttributeError):
        names = sorted({k for hits in pages() for h in hits for k in h["_source"]})
    return _paged(spark, ["_id", *names], lambda: (elastic_rows({"hits": {"hits": hits}}, names)[1] for hits in pages()))


def elastic_names(text: str) -> tuple[list[str], list[str]]:
    """(indexes, fields) that a request names: the identifiers of SQL, the keys and field values of a search body."""
    if not text.lstrip().startswith("{"):
        from tablewright.plans.native import check_native

        tokens = check_native(text)
        plain = [t.text.strip('`"') for t in tokens if t.kind in ("word", "quoted", "string")]
        return [b.text.strip('`"') for a, b in zip(tokens, tokens[1:], strict=False) if a.key in ("FROM", "JOIN", "DESCRIBE", "TABLE") or a.text == ","], plain
    body = json.loads(text)
    if "script" in text and re.search(r'"(script|script_fields|runtime_mappings|scripted_metric)"', text):
        raise RequestError("scripts aren't allowed")
    return [x for x in str(body.get("index", "")).split(",") if x], list(_strings(body))


def _strings(x) -> Iterator[str]:
    """All keys and texts of a JSON value."""
    if isinstance(x, dict):
        for k, v in x.items():
            yield k
            yield from _strings(v)
    elif isinstance(x, list):
        for v in x:
            yield from _strings(v)
    elif isinstance(x, str):
        yield x


def qdrant_request(text: str) -> tuple[str, str]:
    """('scroll' or 'count', collection) of a JSON request; others are refused."""
    spec = json.loads(text)
    for op in ("scroll", "count"):
        if op in spec:
            name = spec[op] if isinstance(spec[op], str) else spec[op].get("collection", "")
            return op, name
    raise RequestError("only scroll and count are allowed")


def qdrant_rows(collection: str, answer: dict) -> tuple[list[str], list[tuple]]:
    return ["collection", "points"], [(collection, str(answer["result"]["count"]))]


def read_qdrant(spark: SparkSession, base: str, text: str) -> DataFrame:
    """(collection, points) for a scroll or count request: how many points the collection has."""
    _, collection = qdrant_request(text)
    answer = fetch(f"{base.rstrip('/')}/collections/{urllib.parse.quote(collection)}/points/count", {"exact": True})
    columns, rows = qdrant_rows(collection, answer)
    return _frame(spark, columns, rows)


def qdrant_catalog(base: str, label: str = "qdrant") -> dict[str, list[tuple]]:
    """Rows for the metadata tables: a table for each collection, with its id, payload fields and vectors."""
    base = base.rstrip("/")
    out: dict[str, list[tuple]] = {"tables": [], "columns": []}
    for c in sorted(x["name"] for x in fetch(f"{base}/collections")["result"]["collections"]):
        info = fetch(f"{base}/collections/{urllib.parse.quote(c)}")["result"]
        out["tables"].append((label, "qdrant", c, info.get("points_count") or 0))
        vectors = info.get("config", {}).get("params", {}).get("vectors", {})
        named = {"vector": vectors} if "size" in vectors else vectors
        fields = [("id", "id"), *((n, f"float[{v.get('size', '')}]") for n, v in sorted(named.items())), *((n, f.get("data_type", "")) for n, f in sorted(info.get("payload_schema", {}).items()))]
        out["columns"] += [(label, "qdrant", c, k, n, t, n != "id", None, n == "id") for k, (n, t) in enumerate(fields)]
    return out


def check_mongo(text: str) -> dict:
    """A find or aggregate request as a dict; stages that write or look inside the server are refused at any depth."""
    spec = json.loads(text)
    if not ("find" in spec or "aggregate" in spec):
        raise RequestError("only find and aggregate are allowed")

    def look(x):
        if isinstance(x, dict):
            for k, v in x.items():
                if k in MONGO_DENIED:
                    raise RequestError(f"{k} isn't allowed")
                look(v)
        elif isinstance(x, list):
            for v in x:
                look(v)

    look(spec.get("pipeline", []))
    return spec


def mongo_joined(spec: dict) -> list[str]:
    """Collections that the stages of a pipeline read beside its own."""
    found = []

    def look(x):
        if isinstance(x, dict):
            for k, v in x.items():
                if k in ("$lookup", "$graphLookup") and isinstance(v, dict) and "from" in v:
                    found.append(v["from"])
                elif k == "$unionWith":
                    found.append(v if isinstance(v, str) else v.get("coll", ""))
                look(v)
        elif isinstance(x, list):
            for v in x:
                look(v)

    look(spec.get("pipeline", []))
    return found


def mongo_fields(spec: dict) -> list[str]:
    """Field names that a request mentions, as keys or as ``$field`` values, each part of a path."""
    return [p for s in _strings({k: v for k, v in spec.items() if k not in ("find", "aggregate")}) if not s.startswith("$$") for p in s.lstrip("$").split(".") if p]


def mongo_rows(documents: list[dict], names: list[str] | None = None) -> tuple[list[str], list[tuple]]:
    """Documents as rows: ``_id`` first, then fields by name; nested values as JSON, others as text."""
    text = lambda v: None if v is None else v if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else json.dumps(v, ensure_ascii=False, default=str) if isinstance(v, (dict, list)) else str(v)
    if names is None:
        found = {k for d in documents for k in d}
        names = [*(["_id"] if "_id" in found else []), *sorted(found - {"_id"})]
    return names, [tuple(text(d.get(n)) for n in names) for d in documents]


def _mongo_client(dsn: Dsn):
    from pymongo import MongoClient  # a cluster that reads MongoDB brings the driver

    return MongoClient(host=dsn.host, port=dsn.port, username=dsn.user or None, password=dsn.password or None, **dsn.options)


def mongo_documents(client, dsn: Dsn, spec: dict) -> Iterator[dict]:
    """The documents of a checked request; the server's cursor is read to the end."""
    db = client[dsn.database]
    if "find" in spec:
        cursor = db[spec["find"]].find(spec.get("filter", {}), spec.get("projection"))
        cursor = cursor.sort(list(spec["sort"].items())) if spec.get("sort") else cursor
        cursor = cursor.skip(spec["skip"]) if spec.get("skip") else cursor
        return iter(cursor.limit(spec["limit"]) if spec.get("limit") else cursor)
    return iter(db[spec["aggregate"]].aggregate(spec.get("pipeline", [])))


def read_mongo(spark: SparkSession, dsn: Dsn, text: str, client=None) -> DataFrame:
    """A find or aggregate request: a column for each field that any document has. Two passes, one for the names."""
    spec = check_mongo(text)
    found: dict[str, None] = {}
    for d in mongo_documents(client or _mongo_client(dsn), dsn, spec):
        found |= dict.fromkeys(d)
    names = [*(["_id"] if "_id" in found else []), *sorted(set(found) - {"_id"})]

    def pages():
        held = []
        for d in mongo_documents(client or _mongo_client(dsn), dsn, spec):
            held.append(d)
            if len(held) >= PAGE:
                yield mongo_rows(held, names)[1]
                held = []
        yield mongo_rows(held, names)[1]

    return _paged(spark, names, pages) if names else spark.createDataFrame([], "_id string")


def mongo_catalog(client, dsn: Dsn, sample: int = 100) -> dict[str, list[tuple]]:
    """Rows for the metadata tables: collections, and the fields and types of their first documents."""
    out: dict[str, list[tuple]] = {"tables": [], "columns": [], "indexes": []}
    db, label = client[dsn.database], dsn.label
    for c in sorted(db.list_collection_names()):
        out["tables"].append((label, dsn.database, c, db[c].estimated_document_count()))
        kinds: dict[str, str] = {}
        for d in db[c].find({}).limit(sample):
            for k, v in d.items():
                kinds[k] = type(v).__name__ if kinds.get(k) in (None, "NoneType", type(v).__name__) else "mixed"
        out["columns"] += [(label, dsn.database, c, k, n, kinds[n], n != "_id", None, n == "_id") for k, n in enumerate(sorted(kinds, key=lambda n: (n != "_id", n)))]
    return out


def check_redis(command: str) -> list[str]:
    """The words of a command; only reads pass."""
    words = command.split()
    if not words or words[0].upper() not in REDIS_READS:
        raise RequestError(f"{words[0].upper() if words else 'nothing'} isn't allowed")
    return words


def redis_named(words: list[str]) -> list[str]:
    """Keys and key patterns that a checked command names."""
    verb, rest = words[0].upper(), words[1:]
    if verb in ("MGET", "EXISTS"):
        return rest
    if verb == "SCAN":
        return [rest[k + 1] for k in range(len(rest) - 1) if rest[k].upper() == "MATCH"] or ["*"]
    if verb == "MEMORY":
        return rest[1:2]
    return [] if verb in ("DBSIZE", "INFO") else rest[:1]


class RedisClient:
    """Redis' text protocol over one socket."""

    def __init__(self, host: str, port: int, timeout: float = 10.0):
        self.socket = socket.create_connection((host, port), timeout)
        self.stream = self.socket.makefile("rb")

    def call(self, *words: str):
        parts = [w.encode() for w in words]
        self.socket.sendall(b"*%d\r\n" % len(parts) + b"".join(b"$%d\r\n%s\r\n" % (len(p), p) for p in parts))
        return self._answer()

    def _answer(self):
        line = self.stream.readline().rstrip(b"\r\n")
        kind, rest = line[:1], line[1:]
        if kind == b"-":
            raise RuntimeError(rest.decode())
        if kind == b":":
            return int(rest)
        if kind == b"$":
            n = int(rest)
            return None if n < 0 else self.stream.read(n + 2)[:-2].decode(errors="replace")
        if kind == b"*":
            n = int(rest)
            return None if n < 0 else [self._answer() for _ in range(n)]
        return rest.decode()

    def keys(self, match: str = "*", count: int = 1000) -> Iterator[str]:
        cursor = "0"
        while True:
            cursor, found = self.call("SCAN", cursor, "MATCH", match, "COUNT", str(count))
            yield from found
            if cursor == "0":
                return


def read_redis(spark: SparkSession, host: str, port: int, command: str) -> DataFrame:
    """(value) rows that a read command returns."""
    answer = RedisClient(host, port).call(*check_redis(command))
    rows = answer if isinstance(answer, list) else [answer]
    return spark.createDataFrame([(None if r is None else str(r),) for r in rows], "value string")


def redis_keys(spark: SparkSession, host: str, port: int, match: str = "*") -> DataFrame:
    """(key, type, ttl in seconds, -1 without one) of every key that matches, scanned by one executor task."""

    def pages():
        client, held = RedisClient(host, port), []
        for key in client.keys(match):
            held.append((key, client.call("TYPE", key), client.call("TTL", key)))
            if len(held) >= PAGE:
                yield held
                held = []
        yield held

    df = _paged(spark, ["key", "type", "ttl"], pages).dropDuplicates(["key"])  # a scan may give a key twice
    return df.withColumn("ttl", df["ttl"].cast("long"))
