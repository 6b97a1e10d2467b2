"""Licence scan, toxicity field and lattice scores."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tablewright.llm import licenses, lm_score, toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def slow_base(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    return len(words), sorted(k for k, _ in found), ",".join(sorted({x for _, x in found}))


def test_license_base(odd):
    for r, (_, text) in zip(licenses.scan(odd).collect(), odd.select("doc_id", "text").collect(), strict=True):
        n, at, labels = slow_base(text)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, len(at), min(at, default=None), max(at, default=None), labels)
        assert set(filter(None, labels.split(","))) <= set(r.labels.split(","))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i, *itertools.accumulate(range(len(b)), lambda left, j, row=row, x=x: min(row[j] + (x != b[j]), row[j + 1] + 1, left + 1), initial=i)][1:]
    return row[-1]


def test_fuzzy_places_have_the_edits_reported(spark):
    texts = ["code is undr the MIT licence, ok", "Apache Licens Version 2", "the GNU generl public license v3", "cc by mc", "under a different license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert [got[k].labels for k in range(5)] == ["mit", "apache-2", "gpl", "", ""]
    assert all(got[k].n_base == 0 for k in range(5))
    for k in range(3):
        m = got[k].matches[0]
        place = " ".join(re.findall(r"[a-z0-9]+", texts[k][m.start : m.end].lower()))
        notice = next(p for p, label in licenses.NOTICES.items() if label == m.label)
        assert distance(place, notice) == m.edits > 0
        assert got[k].score == pytest.approx(1 - m.edits / len(notice))


def test_pigeonhole_finds_all_edits_within_bound():
    finder = licenses.Finder(licenses.NOTICES, licenses.BASE, licenses.CHARACTERS_PER_EDIT)
    rng = np.random.default_rng(4)
    for phrase, label in licenses.NOTICES.items():
        for _ in range(40):
            text = phrase
            for _ in range(len(phrase) // licenses.CHARACTERS_PER_EDIT):
                at = int(rng.integers(1, len(text) - 1))
                text = [text[:at] + "q" + text[at:], text[:at] + text[at + 1 :], text[:at] + "q" + text[at + 1 :]][rng.integers(3)]
            assert label in {x[2] for x in finder.fuzzy_places(f" before {text} after ")}, text


def test_edited_notice_before_an_unchanged_one():
    finder = licenses.Finder(licenses.NOTICES, licenses.BASE, licenses.CHARACTERS_PER_EDIT)
    one, other = "gnu general public licence", "gnu general public license"
    for parts, edits in (((one, other), [1, 0]), ((other, one), [0, 1]), ((one, one, other, one), [1, 1, 0, 1])):
        assert [x[3] for x in sorted(finder.fuzzy_places(f" {' '.join(parts)} x ")) if x[2] == "gpl"] == edits


def test_marginals_equal_enumeration():
    crf = toxicity.Field(start=-0.3, back=0.4, stay=0.9)
    e = np.array([0.5, -1.0, 2.0, 0.1, -0.7, 1.5])
    fresh = np.array([True, False, False, True, False, True])
    p, pair, logs = toxicity.marginals(e, fresh, crf)
    for a, b in ((0, 3), (3, 5), (5, 6)):
        weights, total = Counter(), 0.0
        for tags in itertools.product((0, 1), repeat=b - a):
            s = tags[0] * (e[a] + crf.start)
            for t in range(1, b - a):
                s += tags[t] * e[a + t] + crf.back * (tags[t - 1] > tags[t]) + crf.stay * (tags[t - 1] and tags[t])
            w = math.exp(s)
            total += w
            for t in range(b - a):
                weights["p", t] += w * tags[t]
                weights["pair", t] += w * (t > 0 and tags[t - 1] and tags[t])
        for t in range(b - a):
            assert p[a + t] == pytest.approx(weights["p", t] / total)
            assert pair[a + t] == pytest.approx(weights["pair", t] / total)
        # The empty tagging weighs 1, so the scales multiply to the partition sum.
        assert math.exp(logs[a:b].sum()) == pytest.approx(total)


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(0)
    plain = [f"{a}{b}" for a in ("ba", "do", "ki", "lu", "mo") for b in ("ra", "te", "no", "si")]
    rows, labels = [], []
    for k in range(400):
        words = list(rng.choice(plain, int(rng.integers(5, 60))))
        y = k % 4 == 0
        if y:
            for _ in range(2):
                words.insert(int(rng.integers(len(words))), str(rng.choice(["grumblex", "snarfing"])))
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(y)))
    rows += [(1000, None), (1001, ""), (None, "baba " * 10)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (5000, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(documents, marks).collect()}
    for k, _, y in labels:
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1)
        assert (got[k].score >= 0.7, got[k].predicted) == (bool(y), y)
        assert {rows[k][1][s.start : s.end] for s in got[k].spans} <= {"grumblex", "snarfing"}
        assert bool(got[k].spans) == bool(y)
    assert got[1000].score == got[1001].score < 0.3
    kept = toxicity.drop_toxic(documents, marks)
    assert (kept.columns, kept.count()) == (["doc_id", "text"], len(rows) - 100)
    assert toxicity.score_documents(documents, marks.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.score_documents(documents.limit(0), marks).count() == 0


def test_markers_of_rare_words():
    """15 of 1000 toxic documents and no clean one mark a word among a thousand tried."""
    toxic, clean = np.full(1000, 10.0), np.full(1000, 10.0)
    toxic[0], clean[0] = 15, 0
    assert np.flatnonzero(toxicity.markers(toxic, clean, 0.5)).tolist() == [0]
    assert toxicity.ROUNDS == 90


def slow_lattice(word, pieces, by_byte):
    if not word:
        return 1.0
    total = sum(pieces[word[:k]] * slow_lattice(word[k:], pieces, by_byte) for k in range(1, len(word) + 1) if word[:k] in pieces)
    if word[0] not in pieces:
        total += math.prod(by_byte for _ in word[0].encode()) * slow_lattice(word[1:], pieces, by_byte)
    return total


def test_lattice_equals_enumeration():
    pieces = {"▁": 0.1, "▁a": 0.05, "a": 0.2, "b": 0.1, "ab": 0.07, "ba": 0.03, "▁ab": 0.02, "aba": 0.01}
    lattice = lm_score.Lattice(list(pieces), [math.log(p) for p in pieces.values()], dict.fromkeys(range(256), math.log(0.001)))
    words = ["▁ab", "▁abab", "▁a", "▁baab", "▁aéb", "▁上", "▁" + "ab" * 30]
    got = lattice(words)
    for w, v in zip(words[:6], got[:6], strict=True):
        assert v == pytest.approx(math.log(slow_lattice(w, pieces, 0.001)))
    assert np.isfinite(got[6])


def test_expected_pieces_equal_enumeration():
    pieces = {"▁": 0.1, "▁a": 0.05, "a": 0.2, "b": 0.1, "ab": 0.07, "ba": 0.03}
    names, counts = list(pieces), np.zeros(6)
    lattice = lm_score.Lattice(names, [math.log(p) for p in pieces.values()], dict.fromkeys(range(256), math.log(0.001)))
    words, weights = ["▁abab", "▁baab", "▁aéa"], np.array([2.0, 1.0, 3.0])
    lattice(words, weights, counts)
    want = np.zeros(6)

    def cuts(word):
        if not word:
            yield 1.0, []
        for k in range(1, len(word) + 1):
            p = pieces.get(word[:k], 0.001**2 if word[:k] == "é" else 0)
            if p:
                for q, rest in cuts(word[k:]):
                    yield p * q, [word[:k], *rest]

    for w, c in zip(words, weights, strict=True):
        total = sum(p for p, _ in cuts(w))
        for p, found in cuts(w):
            for x in found:
                if x in pieces:
                    want[names.index(x)] += c * p / total
    assert counts == pytest.approx(want)


def test_two_passes_weigh_the_pieces(spark, monkeypatch):
    calls, plain = [], lm_score.expected_counts
    monkeypatch.setattr(lm_score, "expected_counts", lambda *a: calls.append(1) or plain(*a))
    df = spark.createDataFrame([(1, "some words of a text"), (3, "other words")], "doc_id long, text string")
    assert lm_score.lm_scores(df, PIECES).count() == 2
    assert len(calls) == 2


def test_lm_base(spark, odd):
    rows = [(d, t or "") for d, t in odd.select("doc_id", "text").collect()]
    train = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 != 2
    counts = Counter()
    for d, t in rows:
        if train(d):
            counts.update([*t.encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    got = sorted(lm_score.lm_scores(odd, PIECES).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for r, (d, t) in zip(got, want, strict=True):
        tokens = [*t.encode().lower().split(), None]
        assert (r.doc_id, r.held_out, r.n_tokens, r.train_tokens) == (d, not train(d), len(tokens), n)
        assert r.n_known == sum(counts[w] > 0 for w in tokens)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens))
        assert r.score < 0
    assert lm_score.lm_scores(odd.limit(0), PIECES).count() == 0
    assert lm_score.lm_scores(odd.where("doc_id IS NULL AND FALSE OR doc_id = 4"), PIECES).count() == 1
