"""The stream gives the batch's windows, but for those that the watermark hasn't closed."""

import shutil

from tablewright.streaming import events


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf_dir}/events.parquet", tmp_path / "in" / "events.parquet")
    batch = spark.read.parquet(str(tmp_path / "in"))
    query = events.follow(spark, str(tmp_path / "in"), batch.schema, str(tmp_path / "out"), str(tmp_path / "check"), every="1 day", late="1 hour")
    query.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in events.windowed(batch, "1 day").collect()}
    key = lambda r: (r[0], r[1], r[2], round(r[3], 6))
    got, want = set(map(key, got)), set(map(key, want))
    assert got <= want
    assert len(got) >= len(want) - 10
