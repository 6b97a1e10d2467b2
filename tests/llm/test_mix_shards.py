"""Sharding and mixing: sizes, laws of the draws and edge cases."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablewright.llm import mixing, sharding


def test_shards(spark, odd):
    got = sharding.uniform_shards(odd, ["doc_id", "text"], shards=4)
    assert got.columns == [*[c for c in odd.columns if c not in ("shard", "slot")], "shard", "slot"]
    rows = got.collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert sorted(map(len, slots.values())) == [2, 2, 3, 3]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert Counter(r.text for r in rows) == Counter(r.text for r in odd.collect())
    assert sharding.uniform_shards(odd.limit(0), ["doc_id"]).count() == 0


def test_reruns_agree_whatever_the_partitions(spark):
    df = spark.range(3000).withColumnRenamed("id", "doc_id")
    a, b = ({r.doc_id: (r.shard, r.slot) for r in sharding.uniform_shards(x, ["doc_id"]).collect()} for x in (df.repartition(3), df.repartition(11)))
    assert a == b
    assert {s for s, _ in a.values()} == set(range(8))
    first = np.array([a[k][0] for k in range(0, 1500)])
    assert abs(np.bincount(first, minlength=8) - 187.5).max() < 60


def test_matrix_rows_sum_up():
    sizes, blocks = np.array([5, 0, 12, 3, 7]), np.array([10, 9, 8])
    m = np.array([sharding.matrix_row(sizes, blocks, k, 1) for k in range(5)])
    assert m.sum(axis=1).tolist() == sizes.tolist()
    assert m.sum(axis=0).tolist() == blocks.tolist()
    mean = np.mean([sharding.matrix_row(sizes, blocks, 2, seed) for seed in range(600)], axis=0)
    assert mean == pytest.approx(12 * blocks / 27, abs=0.25)


def test_large_hypergeometric_has_the_right_moments():
    from tablewright.llm.common import generator

    good, bad, sample = 600_000_000, 1_400_000_000, 1_000_000
    x = [sharding._large_hypergeometric(generator(k), good, bad, sample) for k in range(400)]
    mean, sd = sample * 0.3, math.sqrt(sample * 0.3 * 0.7)
    assert abs(np.mean(x) - mean) < 5 * sd / 20
    assert 0.8 < np.std(x) / sd < 1.2
    assert sharding.split_counts(generator(1), np.array([good, bad]), sample).sum() == sample


def test_targets_stop_at_three_times():
    assert mixing.targets([10, 10, 10]) == pytest.approx([5, 10, 15])
    out = mixing.targets([100, 100, 1])
    assert out[2] == 3
    assert out[0] + out[1] == pytest.approx(198)
    assert out[1] == pytest.approx(2 * out[0])
    assert mixing.targets([0, 0]) == [0, 0]
    assert mixing.targets([]) == []


def test_exchange_is_unbiased_and_keeps_words():
    rng = np.random.default_rng(1)
    out = np.array([mixing.exchange(10, 4, 30, 9, rng.random()) for _ in range(4000)])
    assert out.sum(axis=1) == pytest.approx(np.full(4000, 13.0))
    assert out.mean(axis=0) == pytest.approx([4, 9], abs=0.4)
    assert all(mixing.integral(a, 10) or mixing.integral(b, 30) for a, b in out)


def test_few_are_settled_unbiased():
    sizes, masses = [50, 20, 10, 5], [20.0, 15.0, 3.0, 1.0]
    runs = np.array([mixing.settle_few(np.random.default_rng(k), sizes, masses) for k in range(3000)])
    assert runs.sum(axis=1) == pytest.approx(np.full(3000, 39.0))
    assert runs.mean(axis=0) == pytest.approx(masses, abs=1.5)
    assert all(sum(not mixing.integral(m, s) for m, s in zip(r, sizes, strict=True)) <= 1 for r in runs)


@pytest.mark.parametrize(("leaf", "fan"), [(8192, 256), (7, 2)])
def test_taken_words_come_near_targets(spark, monkeypatch, leaf, fan):
    monkeypatch.setattr(mixing, "LEAF_ROWS", leaf)
    monkeypatch.setattr(mixing, "FAN", fan)
    rng = np.random.default_rng(3)
    rows = [(k, "w " * int(rng.integers(0, 40)), [None, "é", "b", "z", "a"][k % 5]) for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken(df).collect()
    assert len(got) == 500
    assert sorted(map(tuple, mixing.taken(df.repartition(5)).collect())) == sorted(map(tuple, got))
    order = {r.doc_id: rows[r.doc_id][2] for r in got}
    sums = defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        assert r.size == len(rows[r.doc_id][1].split())
        assert r.taken % max(r.size, 1) == 0
        assert r.taken <= 3 * r.size
        sums[order[r.doc_id]] = [sums[order[r.doc_id]][0] + r.size, r.target, sums[order[r.doc_id]][2] + r.taken]
    want = mixing.targets([sums[s][0] for s in ("a", "b", "z", "é", None)])
    for s, t in zip(("a", "b", "z", "é", None), want, strict=True):
        assert sums[s][1] == pytest.approx(t)
        assert abs(sums[s][2] - t) <= (40 if leaf > 100 else 120)


def test_mix_edges(spark, odd):
    got = mixing.taken(odd).collect()
    assert len(got) == 10
    assert {r.taken for r in got if r.size == 0} == {0}
    copies = mixing.mixed(odd)
    assert copies.columns == odd.columns
    assert copies.count() > 0
    assert mixing.taken(odd.limit(0)).count() == 0
    assert mixing.mixed(odd.limit(0)).count() == 0
