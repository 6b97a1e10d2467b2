"""The pipeline's stages on planted cases, and the registered queries on the small tables."""

import duckdb
import pytest

import corpus_pipeline
from tablewright.llm import queries

STAGE = dict(corpus_pipeline.STAGES)


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]


@pytest.mark.parametrize("name", ["exact_dedup", "near_dedup", "mixing"])
def test_stage_columns_and_edges(spark, odd, name):
    docs = odd.select("doc_id", "text", "lang", "source")
    out = STAGE[name](spark, docs, "")
    assert out.columns == docs.columns
    assert {r.text for r in out.collect()} <= {r.text for r in docs.collect()}
    assert STAGE[name](spark, docs.limit(0), "").count() == 0


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    rows = out.select("doc_id", "start", "length", "doc_tokens", "sequence_id").collect()
    assert len({r.sequence_id for r in rows}) == len(rows) > 0
    assert all(r.length & (r.length - 1) == 0 for r in rows)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_registered_query(spark, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    key = "vec_id" if name.startswith("op6") else "doc_id"
    n = spark.read.parquet(f"{sf_dir}/{'embeddings' if key == 'vec_id' else 'documents'}.parquet").count()
    rows = df.collect()
    assert len({r[key] for r in rows}) == n
    if name in queries.oracle_sql():
        db = duckdb.connect()
        for t in ("documents", "embeddings"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        cursor = db.execute(queries.oracle_sql()[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(cursor.fetchall())
