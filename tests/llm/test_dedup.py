"""Exact, SimHash and embedding duplicates against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tablewright.llm import embedding_dedup, exact_dedup, near_copies, simhash


def test_exact(spark, odd):
    rows = [(d, t or "") for d, t in odd.select("doc_id", "text").collect()]
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), d is None, d or 0))
    got = exact_dedup.duplicate_groups(odd.repartition(3), capacity=2).collect()
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        own = sorted(by_sha[r.text_sha256])
        assert (r.group_size, r.keep_id) == (len(own), None if own[0][1] else own[0][2])
    assert sum(r.kept for r in got) == len(groups)
    unique = exact_dedup.unique_documents(odd)
    assert unique.columns == odd.columns
    assert unique.count() == len(groups)
    assert exact_dedup.duplicate_groups(odd.limit(0)).count() == 0


def test_exact_chains_compare_bytes():
    """Equal hashes of different texts stay apart."""
    rows = [(1, 5, 1, 10, 10, 1, "a"), (2, 5, 1, 11, 11, 1, "b"), (3, 5, 2, 9, 12, 2, " a")]

    class Batch:
        num_rows = len(rows)

        def slice(self, at, n):
            return self if at == 0 else None

        def column(self, name):
            at = ["rep_id", "key", "points", "doc_id", "row_id", "rows", "t"].index(name)
            return type("C", (), {"to_pylist": lambda _: [r[at] for r in rows]})()

    got = {r[0]: r[1:] for r in exact_dedup._owner([Batch()])}
    assert got == {1: (9, 12, 3), 3: (9, 12, 3), 2: (11, 11, 1)}


def test_directory_doubles():
    depth, slots = exact_dedup.directory(np.array([10, 1, 0, 0, 0, 0, 3, 3]), capacity=4)
    assert depth == 3
    assert slots.tolist() == [0, 1, 2, 2, 3, 3, 4, 5]
    depth, slots = exact_dedup.directory(np.array([0, 0, 0, 2, 0, 0, 0, 0]), 4)
    assert (depth, slots.tolist()) == (0, [0])


def slow_fingerprint(text, n):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprints():
    for text in ("", " \t", "one", "one two", "a b c", "A B C d a b c d\x0b\x1c x É é", "w " * 200, "x\xa0y z"):
        assert simhash.fingerprint(text) % 2**64 == slow_fingerprint(text, 3)
    assert simhash.fingerprint(None) == 0


@pytest.mark.parametrize("segments", [16, 21])
def test_links_are_complete(spark, segments):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63, 40)
    flips = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for b in base.tolist() for n in (1, 2, 2, 3, 4)]
    fps = sorted({int(np.uint64(x % 2**64).astype(np.int64)) for x in [*base.tolist(), *flips, 0, -1, 1, 3]})
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 2, segments).collect()}
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) % 2**64).bit_count() <= 2}
    assert got == want


def test_simhash_components(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    rows = [(d, t) for d, t in odd.select("doc_id", "text").collect()]
    assert len(got) == len(rows)
    fps = {f"{slow_fingerprint(t or '', 3):016x}" for _, t in rows}
    assert {r.fingerprint for r in got} == fps
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {3}
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_no_join_of_simhash_is_broadcast(spark, tmp_path):
    """Grid cells are 43 times the fingerprints whose files Spark goes by; nothing that grows with the input may reach the driver."""
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) == 10 << 20
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.range(2000).select(F.xxhash64("id").alias("fp")).write.parquet(f"{tmp_path}/fp")
    assert "Broadcast" not in plan(simhash.links(spark.read.parquet(f"{tmp_path}/fp")))
    rows = [(k, f"a text of its own {k % 50} and some more") for k in range(100)]
    assert "Broadcast" not in plan(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(4000)]
    texts = [" ".join(rng.choice(words, 300)) for _ in range(30)]
    rows = [(k, t) for k, t in enumerate(texts)]
    for k, t in enumerate(texts[:10]):  # three words of 300 replaced: similarity near 0.9
        w = t.split()
        for at in (50, 150, 250):
            w[at] = "changed"
        rows.append((100 + k, " ".join(w)))
    rows += [(200, ""), (201, ""), (202, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in simhash.unique_documents(df).collect()}
    assert left == set(range(30)) | {200, 201, 202}


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    rows = [(k, [float(x) for x in v], k % 3) for k, v in enumerate(base)]
    rows += [(100 + k, [float(x) for x in base[k % 20] + rng.normal(size=16) * (0.05 + 0.02 * (k % 10))], (k % 20) % 3) for k in range(80)]
    rows += [(300, rows[0][1], 0), (301, rows[0][1], None), (302, None, 0), (303, [0.0] * 16, 0), (304, [float("nan")] + [1.0] * 15, 0), (305, [None] + [1.0] * 15, 0), (306, [1.0, 2.0], 0), (307, [], 0), (308, [2 * x for x in rows[0][1]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    fine = {i: (np.array(v, float), y) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and any(v)}

    def linked(a, b):
        (x, p), (y, q) = fine[a], fine[b]
        return p == q and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.93

    root = components(sorted(fine), linked)
    degree = {a: sum(linked(a, b) for b in fine if b != a) for a in fine}
    assert max(degree.values()) > 3
    assert [embedding_dedup.axes_for(n) for n in (0, 10_000, 100_000, 10**9)] == [2, 2, 5, 5]
    for width, axes in ((8, 2), (5, 4)):
        monkeypatch.setattr(embedding_dedup, "LEAST_AXES", axes)
        got = embedding_dedup.near_duplicates(df, 0.93, width).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_links, r.component_id, r.kept) == (degree.get(r.vec_id, 0), root.get(r.vec_id, r.vec_id), root.get(r.vec_id, r.vec_id) == r.vec_id)


def test_split_cells_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in np.ones(8) + rng.normal(size=8) * 0.02], 1) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(embedding_dedup, "PART", 7)
    got = embedding_dedup.near_duplicates(df).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(59, 0)}


def slow_left(rows, similarity=0.8):
    """doc_ids that stay, by all pairs."""
    sets = {}
    for d, t in rows:
        w = t.split()
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = components(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]))
    return set(root.values())


def test_near_copies_at_the_limit_at_any_size(spark):
    """Pairs right above and below a similarity of 0.8 are told apart, however many other documents there are."""
    rng = np.random.default_rng(8)
    words = np.array([f"w{k}" for k in range(5000)])
    rows = []
    for k in range(200):
        w = rng.choice(words, int(rng.integers(60, 200))).tolist()
        rows.append((2 * k, " ".join(w)))
        at = int(rng.integers(10, len(w) - 10))
        w[at : at + int(len(w) * rng.uniform(0.02, 0.16))] = [f"n{k}"]
        rows.append((2 * k + 1, " ".join(w)))
    want = slow_left(rows)
    assert 220 < len(want) < 380
    for others in (0, 20_000):
        more = [(1000 + k, " ".join(rng.choice(words, 12))) for k in range(others)]
        left = {r.doc_id for r in simhash.unique_documents(spark.createDataFrame(rows + more, "doc_id long, text string")).collect()}
        assert left == want | {d for d, _ in more}


def test_near_copies_come_from_the_grid_first(spark, monkeypatch):
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(4000)]
    texts = [" ".join(rng.choice(words, 900)) for _ in range(12)]
    rows = list(enumerate(texts)) + [(100 + k, t.upper()) for k, t in enumerate(texts[:4])] + [(204 + k, f"{t} more") for k, t in enumerate(texts[4:8])]
    rows += [(300, "same " * 50), (301, "same " * 40 + "end of it"), (302, ""), (303, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {d: simhash.fingerprint(t, 5) for d, t in rows}
    far = lambda a, b: ((prints[a] ^ prints[b]) % 2**64).bit_count()
    pairs = {tuple(r) for r in simhash.candidates(docs, 5).collect()}
    assert {(k, 100 + k) for k in range(4)} <= pairs
    assert {(k, 200 + k) for k in range(4, 8) if far(k, 200 + k) <= 2} <= pairs
    assert all(a < b and far(a, b) <= 2 for a, b in pairs)
    # Wrong candidates are dropped, and right ones taken as they come.
    some = spark.createDataFrame([(0, 100), (1, 2), (302, 303)], "a long, b long")
    found = {tuple(r) for r in near_copies.links(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t")), 5, 0.8, some).collect()}
    assert (0, 100) in found and not found & {(1, 2), (302, 303)}

    given = []
    grid, after = simhash.links, near_copies.links
    monkeypatch.setattr(simhash, "links", lambda *args: given.append("grid") or grid(*args))
    monkeypatch.setattr(near_copies, "links", lambda *args: given.append(args[3].count()) or after(*args))
    assert {r.doc_id for r in simhash.unique_documents(docs).collect()} == set(range(12)) | {300, 301, 302, 303}
    assert given == ["grid", len(pairs)]


def test_near_copies_in_a_family_of_one_template(spark):
    """Near copies among documents that share most passages with one another all meet."""
    rng = np.random.default_rng(9)
    words = np.array([f"w{k}" for k in range(5000)])
    template = rng.choice(words, 90).tolist()
    texts = [template + rng.choice(words, 25).tolist() for _ in range(300)]  # some 0.6 alike
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    for k in range(100):
        w = list(texts[3 * k])
        w[95 + k % 8] = "changed"
        rows.append((1000 + k, " ".join(w)))
    chain = rng.choice(words, 100).tolist()  # neighbours are alike, the ends aren't
    for k in range(8):
        rows.append((2000 + k, " ".join(chain[6 * k :] + [f"c{n}" for n in range(6 * k)])))
    left = {r.doc_id for r in simhash.unique_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == slow_left(rows)
    assert not left & set(range(1000, 1100))


def test_parities_never_claim_too_many_differences():
    rng = np.random.default_rng(10)
    for _ in range(200):
        x, y = (rng.integers(0, 400, int(rng.integers(1, 300))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2))
        x, y = np.unique(x), np.unique(y)
        assert near_copies.least_difference(near_copies.parities(x), near_copies.parities(y)) <= len(np.setxor1d(x, y))


def near_rows(rng, sizes):
    """Documents of one point: node, n, short, root, parities; and their sets."""
    base = rng.choice(10**6, 400, replace=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sets = [np.unique(np.concatenate((rng.permutation(base[:n])[: int(n * 0.96)], rng.integers(0, 10**9, int(n * rng.random() * 0.1)).astype(np.uint64)))) for n in sizes]
    return sets, [(k, len(x), True, k % 7, near_copies.parities(x)) for k, x in enumerate(sets)]


@pytest.mark.parametrize("parts", [1, 3])
def test_compared_parts_lose_no_pair(parts):
    rng = np.random.default_rng(11)
    sets, rows = near_rows(rng, rng.integers(150, 400, 120))
    dealt = []
    for p in range(parts):
        dealt += [(5, p, False, *r) for r in rows if r[0] % parts == p]
        dealt += [(5, p, True, *r) for r in rows if r[0] % parts > p]
    dealt += [(6, 0, False, *r) for r in rows[:9]]
    names = ("point", "part", "visits", "node", "n", "short", "root", "bits")
    batches = [pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*dealt[at : at + 50], strict=True)), strict=True))) for at in range(0, len(dealt), 50)]
    got = [p for b in near_copies._compared(batches, 0.8) for p in zip(*b.to_pydict().values(), strict=True)]
    assert len(set(got)) == len(got)
    alike = {(a, b) for b in range(120) for a in range(b) if a % 7 != b % 7 and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))}
    assert alike and alike <= set(got)
    assert len(got) < 3 * len(alike) + 200


def test_prefixes_share_a_point():
    """Of every two sets that are similar enough, the prefixes by any common order share a member, also by the shorter rule."""
    rng = np.random.default_rng(12)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        x = set(rng.choice(200, n, replace=False).tolist())
        y = {int(rng.integers(200)) if rng.random() < 0.1 else v for v in x}
        if len(x & y) < 0.8 * len(x | y):
            continue
        order = dict(zip(range(200), rng.permutation(200).tolist(), strict=True))
        long, short = zip(*(near_copies.prefix_sizes(np.array([len(s)]), 0.8) for s in (x, y)), strict=True)
        first = [sorted(s, key=order.get) for s in (x, y)]
        assert set(first[0][: long[0][0]]) & set(first[1][: long[1][0]])
        less = 0 if len(x) <= len(y) else 1
        assert set(first[less][: short[less][0]]) & set(first[1 - less][: long[1 - less][0]])
