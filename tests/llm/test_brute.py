"""Operators without SQL against plain versions of what they compute, and on texts of a megabyte."""

import math
import re
import time
from collections import Counter, defaultdict
from array import array

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tablewright.llm import embedding_dedup, exact_dedup, licenses, lm_score, mixing, packing, sharding, simhash, token_store, toxicity
from tablewright.llm.common import generator
from tests.llm.test_scans import distance

PIECES, WORDS, BYTES = (public_tokenizers.path(n) for n in ("piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.json"))
STAGE = dict(corpus_pipeline.STAGES)


def slow_places(joined, notices, per_edit):
    """Every span of whole words within a notice's bound; of a start the one with fewest edits, then of those that overlap."""
    starts = [k for k in range(1, len(joined)) if joined[k - 1] == " " and joined[k] != " "]
    ends = [k for k in range(1, len(joined)) if joined[k] == " " and joined[k - 1] != " "]
    chosen = []
    for p, label in notices.items():
        k = len(p) // per_edit
        best = {}
        for a in starts:
            spans = [(d, abs(b - a - len(p)), b - a, b) for b in ends if abs(b - a - len(p)) <= k and (d := distance(p, joined[a:b])) <= k]
            if spans:
                best[a] = min(spans)
        taken = []
        for edits, a, b in sorted((d, a, b) for a, (d, *_, b) in best.items()):
            if all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                chosen.append((a, b, label, edits, len(p)))
    return sorted({(a, b, label, edits) for a, b, label, edits, n in chosen if not any(x <= a and b <= y and m > n for x, y, _, _, m in chosen)})


def test_fuzzy_places_equal_all_windows():
    notices = {"under the mit license": "mit", "cc by nc": "cc-by-nc", "creative commons attribution": "cc-by", "creative commons attribution noncommercial": "cc-by-nc", "gnu general public license": "gpl"}
    finder, rng = licenses.Finder(notices, {}, 10), np.random.default_rng(7)
    for _ in range(150):
        parts = []
        for _ in range(int(rng.integers(1, 6))):
            text = str(rng.choice([*notices, "x", "license", "the mit"]))
            for _ in range(int(rng.integers(0, 4))):
                at = int(rng.integers(0, len(text) + 1))
                text = [text[:at] + str(rng.choice(list("aeh l"))) + text[at:], text[:at] + text[at + 1 :]][rng.integers(2)]
            parts.append(text)
        joined = f" {' '.join(' '.join(parts).split())} "
        assert sorted(x[:4] for x in finder.fuzzy_places(joined)) == slow_places(joined, notices, 10), joined


def test_a_megabyte_of_notices(spark):
    df = spark.createDataFrame([(1, "Under teh MIT license. " * 50_000), (2, "cc by nc " * 120_000)], "doc_id long, text string")
    began = time.monotonic()
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert time.monotonic() - began < 60
    assert (len(got[1].matches), got[1].n_base, got[1].labels) == (50_000, 0, "mit")
    assert (got[2].n_base, got[2].first_word, got[2].last_word) == (120_000, 0, 3 * 119_999)


def slow_score(text, crf):
    """A document's score by messages kept for each token, in logs."""
    words = toxicity.words_of(text)
    top, mass = -toxicity.LIMIT, 0.0
    if words:
        f = [toxicity.features_of(w) for w in words]
        e = []
        for t in range(len(words)):
            x = crf.bias + sum(crf.own.get(h, 0.0) for h in f[t])
            x += crf.before.get(f[t - 1][0], 0.0) if t else 0.0
            x += crf.after.get(f[t + 1][0], 0.0) if t + 1 < len(words) else 0.0
            e.append(min(max(x, -toxicity.LIMIT), toxicity.LIMIT))
        step = [[0.0, 0.0], [crf.back, crf.stay]]
        alpha = [[0.0, e[0] + crf.start]]
        for x in e[1:]:
            alpha.append([np.logaddexp(alpha[-1][0] + step[0][y], alpha[-1][1] + step[1][y]) + (x if y else 0.0) for y in (0, 1)])
        beta = [[0.0, 0.0]]
        for x in reversed(e[1:]):
            beta.append([np.logaddexp(step[y][0] + beta[-1][0], step[y][1] + x + beta[-1][1]) for y in (0, 1)])
        whole = np.logaddexp(*alpha[-1])
        p = [math.exp(a[1] + b[1] - whole) for a, b in zip(alpha, reversed(beta), strict=True)]
        best = max(p)
        top = min(max(math.log(max(best, 1e-12)) - math.log(max(1 - best, 1e-12)), -toxicity.LIMIT), toxicity.LIMIT)
        mass = math.log1p(sum(x for x in p if x >= toxicity.TAGGED))
    a, b, c = crf.document
    return 1 / (1 + math.exp(-min(max(a * top + b * mass + c, -30), 30)))


def test_toxicity_scores_equal_slow_ones(spark, sf_dir):
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    crf = toxicity.train(documents, labels)
    got = toxicity.score(documents.limit(60), crf).select("row.text", "score").collect()
    assert [r.score for r in got] == pytest.approx([slow_score(r.text, crf) for r in got], abs=1e-6)


def test_toxicity_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (6, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    got = toxicity.score_documents(odd, labels).collect()
    assert len(got) == 10
    assert len({r.score for r in got if r.doc_id == 6}) == len({r.score for r in got if r.doc_id in (3, 4, 5)}) == 1
    kept = toxicity.drop_toxic(odd, labels)
    assert kept.columns == odd.columns
    # A doc_id that occurs often is one training row.
    many = odd.where("doc_id = 1").crossJoin(spark.range(50).select(F.col("id").alias("n"))).drop("n").unionByName(odd)
    assert toxicity.train(many, labels) == toxicity.train(odd, labels)


def test_shards_equal_one_process(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 200)
    df = spark.range(3001).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    seed, shards = 20, 8
    total, count = 3001, math.ceil(3001 / 200)
    keyed = df.select("doc_id", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(count)).alias("part"), *(F.xxhash64(F.lit(seed + k), "doc_id", "text").alias(f"h{k}") for k in (1, 2, 3))).collect()
    per_shard = math.ceil(count / shards)
    sizes = np.bincount([r.part for r in keyed], minlength=count)
    blocks = np.concatenate([sharding.even_sizes(n, per_shard) for n in sharding.even_sizes(total, shards).tolist()])
    sent = defaultdict(list)
    for part in range(count):
        rows = sorted((r for r in keyed if r.part == part), key=lambda r: (r.h1, r.h2))
        for r, block in zip(rows, np.repeat(np.arange(len(blocks)), sharding.matrix_row(sizes, blocks, part, seed)), strict=True):
            sent[int(block)].append(r)
    want, before = {}, Counter()
    for block in range(len(blocks)):
        for r in sorted(sent[block], key=lambda r: (r.h2, r.h3)):
            want[r.doc_id] = (block // per_shard, before[block // per_shard])
            before[block // per_shard] += 1
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.uniform_shards(df, ["doc_id", "text"]).collect()} == want


def test_pool_rounds_without_bias():
    sizes, part = [40, 17, 9, 9, 5, 1, 0], 0.37
    runs = []
    for seed in range(4000):
        pool, out = mixing.Pool(generator(seed), sum(sizes), part), []
        for s in sizes:
            up, mass = pool.settle(s)
            out.append(mass / s if up is None else up)
        runs.append(out)
        assert sum(0 < x < 1 for x in out) <= 1
        assert sum(x * s for x, s in zip(out, sizes, strict=True)) == pytest.approx(part * sum(sizes))
    assert np.mean(runs, axis=0) == pytest.approx([part] * len(sizes), abs=0.04)


def test_lm_scores_equal_all_segmentations(spark, monkeypatch):
    kept, plain = [], lm_score.lattice_of
    monkeypatch.setattr(lm_score, "lattice_of", lambda *a: kept.append(plain(*a)) or kept[-1])
    rows = [(1, "The theme of themes é"), (3, "a thé 上海 theme"), (16, ""), (18, "the the a")]
    got = lm_score.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), PIECES).collect()
    (pieces, logs, by_byte), end, _ = kept[-1]
    p, q = {x: math.exp(v) for x, v in zip(pieces, logs, strict=True)}, {b: math.exp(v) for b, v in by_byte.items()}

    def whole(word):
        if not word:
            return 1.0
        total = sum(p[word[:k]] * whole(word[k:]) for k in range(1, len(word) + 1) if word[:k] in p)
        return total if word[0] in p else total + math.prod(q[b] for b in word[0].encode()) * whole(word[1:])

    texts = dict(rows)
    for r in got:
        words = texts[r.doc_id].encode().lower().decode().split()
        assert r.score == pytest.approx((sum(math.log(whole("▁" + w)) for w in words) + end) / math.log(10))


def test_long_words_equal_short_ones(monkeypatch):
    parts, _, ids = lm_score.lattice_of(PIECES, {}, 10)
    lattice, rng = lm_score.Lattice(*parts), np.random.default_rng(5)
    words = ["▁" + "".join(rng.choice(list("abcdeéß上the in"), int(rng.integers(1, 60)))) for _ in range(100)]
    weights, plain, long = rng.random(100), np.zeros(len(ids)), np.zeros(len(ids))
    want = lattice(words, weights, plain)
    monkeypatch.setattr(lm_score, "LONG", 0)
    monkeypatch.setattr(lm_score, "STRETCH", 7)
    assert lattice(words, weights, long) == pytest.approx(want)
    assert long == pytest.approx(plain, abs=1e-9)


@pytest.fixture(scope="module")
def huge(spark):
    rng = np.random.default_rng(1)
    unbroken = "".join(map(chr, rng.integers(0x4E00, 0x5E00, 350_000)))
    spread = " ".join(rng.choice([f"word{k}" for k in range(3000)], 160_000))
    return spark.createDataFrame([(1, unbroken), (2, spread), (3, spread + " "), (4, spread + " more"), (5, ""), (6, None)], "doc_id long, text string").withColumn("source", F.lit("s"))


def test_a_megabyte_of_text(spark, huge):
    tokens = {1: 0, 2: 160_000, 3: 160_000, 4: 160_001, 5: 0, 6: 0}
    words = Tokenizer.from_file(WORDS)
    stored = {r.doc_id: r.n_tokens for r in token_store.token_digests(huge, WORDS, 2).collect()}
    assert stored == {r.doc_id: len(words.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in huge.collect()}
    assert packing.pack(huge, BYTES, 0).agg(F.sum("length"), F.countDistinct("doc_id")).first()[1] == 6
    groups = {r.doc_id: r.keep_id for r in exact_dedup.duplicate_groups(huge).collect()}
    assert (groups[2], groups[3], groups[4], groups[6]) == (3, 3, 4, 5)
    prints = {r.doc_id: r.component_id for r in simhash.near_duplicates(huge).collect()}
    assert (prints[3], prints[4], prints[6]) == (2, 2, 5)
    assert {r.doc_id for r in simhash.unique_documents(huge).collect()} == {1, 2, 5, 6}
    assert {r.doc_id: r["size"] for r in mixing.taken(huge).collect()} == tokens | {1: 1}
    began = time.monotonic()
    scores = {r.doc_id: r for r in lm_score.lm_scores(huge, PIECES).collect()}
    assert time.monotonic() - began < 120
    assert scores[1].n_tokens == 2
    assert scores[1].score < -100_000
    assert toxicity.score(huge, toxicity.Field()).count() == 6


def test_embeddings_with_odd_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = [(1, base.tolist(), "a"), (2, (base * 1e200).tolist(), "a"), (3, (base * 1e-200).tolist(), "a"), (4, (-base).tolist(), "a"), (5, base.tolist(), "b"), (6, base.tolist(), None)]
    rows += [(7, None, "a"), (8, [], "a"), (9, [0.0] * 16, "a"), (10, [float("nan")] * 16, "a"), (11, [None] * 16, "a"), (12, base[:8].tolist(), "a"), (None, base.tolist(), "a"), (1, base.tolist(), "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    clash = df.withColumns({c: F.lit("x") for c in ("node", "raw", "row", "v", "fine", "least", "size", "root", "n_links", "component_id", "kept", "part", "home", "block", "cell", "dim")})
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(clash).collect()]
    assert sorted(x for x in got if x[0] in (1, 2, 3)) == [(1, 4, 1, True)] * 2 + [(2, 4, 1, False), (3, 4, 1, False)]
    assert [x for x in got if x[0] is None] == [(None, 4, 1, False)]
    assert sorted(x for x in got if (x[0] or 0) > 3) == [(k, 0, k, True) for k in range(4, 13)]
    assert embedding_dedup.near_duplicates(clash.limit(0)).count() == 0


def test_stages_equal_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    ids = lambda df: {r.doc_id for r in df.collect()}
    scored = toxicity.score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
    assert ids(STAGE["toxicity"](spark, docs, sf_dir)) == {r.doc_id for r in scored if r.score < 0.7}

    groups = defaultdict(list)
    for d, r in rows.items():
        groups[re.sub(r"[ \t\n\v\f\r]", "", r.text or "")].append((-len(r.text or ""), d))
    assert ids(STAGE["exact_dedup"](spark, docs, sf_dir)) == {min(g)[1] for g in groups.values()}

    shingles = {}
    for d, r in rows.items():
        w = re.findall(r"[^ \t\n\v\f\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or ""))
        shingles[d] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(rows)
    for n, a in enumerate(order):
        for b in order[:n]:
            x, y = shingles[a], shingles[b]
            if x and y and 4 * max(len(x), len(y)) <= 5 * min(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    assert ids(STAGE["near_dedup"](spark, docs, sf_dir)) == {find(d) for d in rows}

    copies = Counter(r.doc_id for r in STAGE["mixing"](spark, docs, sf_dir).collect())
    sizes = {d: len((r.text or "").encode().split()) for d, r in rows.items()}
    sources = sorted({r.source for r in rows.values()}, key=lambda s: (s is None, s or ""))
    wanted = mixing.targets([sum(sizes[d] for d, r in rows.items() if r.source == s) for s in sources])
    for s, t in zip(sources, wanted, strict=True):
        own = [d for d, r in rows.items() if r.source == s]
        assert abs(sum(copies[d] * sizes[d] for d in own) - t) <= max(sizes[d] for d in own)
    assert max(copies.values()) <= 3

    whole = Tokenizer.from_file(BYTES)
    held = defaultdict(dict)
    for r in STAGE["packing"](spark, docs, sf_dir).collect():
        held[r.doc_id][r.start] = packing.ids_of(r.ids, r.length).tolist()
    for d, r in rows.items():
        assert [k for _, x in sorted(held[d].items()) for k in x] == [*whole.encode(r.text or "", add_special_tokens=False).ids, 0]


def test_ids_of_round_trip():
    ids = np.array([1, 70000, 3], np.uint32)
    assert packing.ids_of(array("I", ids.tolist()).tobytes(), 3).tolist() == ids.tolist()
