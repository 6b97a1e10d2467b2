"""Source addresses: ``scheme://user:password@host:port/database?label=..&option=..``."""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import parse_qsl, unquote, urlsplit

#: Schemes, the kind of source behind each, and default ports.
KINDS = {"mysql": "mysql", "postgres": "postgres", "postgresql": "postgres", "gaussdb": "gaussdb", "opengauss": "gaussdb", "sqlite": "sqlite", "oracle": "oracle", "clickhouse": "clickhouse", "hive": "hive", "starrocks": "starrocks", "duckdb": "duckdb", "redis": "redis", "rediss": "redis", "mongodb": "mongo", "mongo": "mongo", "elasticsearch": "elasticsearch", "es": "elasticsearch", "qdrant": "qdrant", "prometheus": "prometheus", "csv": "csv", "tsv": "csv", "xlsx": "xlsx"}
PORTS = {"mysql": 3306, "postgres": 5432, "gaussdb": 8000, "oracle": 1521, "clickhouse": 8123, "hive": 10000, "starrocks": 9030, "redis": 6379, "mongo": 27017, "elasticsearch": 9200, "qdrant": 6333, "prometheus": 9090}
SQL_KINDS = {"mysql", "postgres", "gaussdb", "sqlite", "oracle", "clickhouse", "hive", "starrocks", "duckdb"}
FILE_KINDS = {"csv", "xlsx"}
#: What each kind can do.
CAPABILITIES = {
    **dict.fromkeys(("mysql", "postgres", "gaussdb", "sqlite", "oracle"), {"foreign_key", "sampling", "row_count", "index", "sql"}),
    "clickhouse": {"sampling", "row_count", "partition", "sql"},
    "hive": {"sql", "row_count", "sampling"},
    "starrocks": {"sql", "row_count", "index", "partition", "sampling"},
    "duckdb": {"sql", "row_count", "sampling"},
    "redis": {"ttl", "sampling"},
    "mongo": {"row_count"},
    "elasticsearch": {"row_count", "sampling"},
    "qdrant": {"vector", "row_count"},
    "prometheus": {"row_count", "promql"},
    "csv": {"row_count", "file"},
    "xlsx": {"row_count", "file"},
}


@dataclass(frozen=True)
class Dsn:
    scheme: str
    kind: str
    host: str = ""
    port: int = 0
    user: str = ""
    password: str = field(default="", repr=False)
    database: str = ""
    label: str = ""
    options: dict = field(default_factory=dict)

    @property
    def capabilities(self) -> set[str]:
        return CAPABILITIES[self.kind]


def parse(text: str) -> Dsn:
    """The parts of an address; the label defaults to the database or file stem. Files keep their whole path."""
    scheme, found, rest = text.partition("://")
    scheme = scheme.lower()
    if not found or scheme not in KINDS:
        raise ValueError(f"unknown source scheme in {scheme!r}")
    kind = KINDS[scheme]
    if kind in FILE_KINDS or kind in ("sqlite", "duckdb"):
        path, _, query = rest.partition("?")
        options = dict(parse_qsl(query))
        label = options.pop("label", path.rstrip("/").rsplit("/", 1)[-1].split(".")[0])
        if scheme == "tsv":
            options.setdefault("delimiter", "tab")
        return Dsn(scheme, kind, database=unquote(path), label=label, options=options)
    url = urlsplit(text)
    options = dict(parse_qsl(url.query))
    database = unquote(url.path.lstrip("/"))
    label = options.pop("label", database or url.hostname or "")
    return Dsn(scheme, kind, url.hostname or "", url.port or PORTS[kind], unquote(url.username or ""), unquote(url.password or ""), database, label, options)
