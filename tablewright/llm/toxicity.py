"""Toxic spans and document scores by a two-tag linear-chain conditional random field.

Token labels come from document labels: a word feature that marks toxic documents almost only, beyond chance, tags its tokens
in toxic documents. The field has word, prefix and suffix features of a token, the words beside it and tag transitions, and is
trained by full-batch Adam. A document's score is a logistic function, fitted on the same rows, of its largest forward-backward
marginal and of the marginals' sum over tokens tagged toxic; the tokens tagged give the offending offsets.

Potentials of tag 0 are 1, so forward and backward messages are 2-vectors pushed through 2 x 2 matrices. All tokens of a batch
form one chain, whose matrices at document starts forget what came before; the chain is folded into rows, all rows advance
together, and a short scan over the rows' products joins them. Long documents cost as much per token as short ones.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import generator, mapped, worker_cache, written

#: Labelled rows of each class that the classifier is fitted on, by smallest hash of doc_id.
TRAIN_ROWS = 1000
ROUNDS = 90
RATE = 0.5
PENALTY = 2e-4
TAGGED = 0.5
#: Min-hashes that tell near copies among the training documents.
SKETCHES = 16
LIMIT = 12.0
WIDTH = 512
CACHED_WORDS = 300_000
SEPARATORS = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return (text or "").encode().translate(SEPARATORS).lower().split()


def features_of(word: bytes) -> list[int]:
    """64-bit hashes of the word, its prefixes of 4 to 6 bytes and its suffixes of 4 and 5; the word comes first."""
    n, h = len(word), xxhash.xxh64_intdigest
    return [h(word, 1), *(h(word[:k], 2) for k in (4, 5, 6) if n >= k), *(h(word[-k:], 3) for k in (4, 5) if n >= k)]


@dataclass
class Field:
    """Weights of the conditional random field and of the document score."""

    own: dict[int, float] = field(default_factory=dict)
    before: dict[int, float] = field(default_factory=dict)
    after: dict[int, float] = field(default_factory=dict)
    bias: float = -4.0
    start: float = 0.0
    #: Log potentials of the steps 0 -> 1 (in bias), 1 -> 0 and 1 -> 1.
    back: float = 0.0
    stay: float = 0.0
    document: tuple[float, float, float] = (0.0, 0.0, -4.0)


def _step(vector, e, start, back, stay, fresh):
    """One forward step of unnormalised messages (tag 0, tag 1) for all rows; returns them with their log scale."""
    a, b = vector
    x = np.exp(e)
    zero = np.where(fresh, a + b, a + b * back)
    one = np.where(fresh, (a + b) * start, a + b * stay) * x
    total = zero + one
    return zero / total, one / total, np.log(total)


def marginals(e: np.ndarray, fresh: np.ndarray, crf: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(tag 1) of each token, P(tag 1 here and at the token before), and the log of each forward scale."""
    n = len(e)
    width = min(WIDTH, max(1, int(np.sqrt(n))))
    rows = -(-n // width)
    pad = rows * width - n
    e = np.concatenate((e, np.full(pad, -LIMIT))).reshape(rows, width).T.copy()
    fresh = np.concatenate((fresh, np.ones(pad, bool))).reshape(rows, width).T.copy()
    start, back, stay = np.exp(crf.start), np.exp(crf.back), np.exp(crf.stay)
    # Each row's product, as images of the two unit vectors, with their scales.
    images = []
    for unit in (0, 1):
        a, b, scale = np.full(rows, 1.0 - unit), np.full(rows, float(unit)), np.zeros(rows)
        for t in range(width):
            a, b, s = _step((a, b), e[t], start, back, stay, fresh[t])
            scale += s
        images.append((a, b, scale))
    shift = np.maximum(images[0][2], images[1][2])
    m = [[(images[u][k] * np.exp(images[u][2] - shift)).tolist() for k in (0, 1)] for u in (0, 1)]
    into, a, b = [], 1.0, 0.0
    for r in range(rows):
        into.append((a, b))
        a, b = a * m[0][0][r] + b * m[1][0][r], a * m[0][1][r] + b * m[1][1][r]
        a, b = a / (a + b), b / (a + b)
    out_of, a, b = [None] * rows, 0.5, 0.5
    for r in reversed(range(rows)):
        out_of[r] = (a, b)
        a, b = m[0][0][r] * a + m[0][1][r] * b, m[1][0][r] * a + m[1][1][r] * b
        a, b = a / (a + b), b / (a + b)
    zero, one, logs, held = np.empty((width, rows)), np.empty((width, rows)), np.empty((width, rows)), np.empty((width, rows))
    a, b = np.array(into).T
    for t in range(width):
        held[t] = b
        a, b, logs[t] = _step((a, b), e[t], start, back, stay, fresh[t])
        zero[t], one[t] = a, b
    p, pair = np.empty((width, rows)), np.empty((width, rows))
    a, b = np.array(out_of).T
    for t in reversed(range(width)):
        whole = zero[t] * a + one[t] * b
        p[t] = one[t] * b / whole
        x = np.exp(e[t])
        pair[t] = np.where(fresh[t], 0.0, held[t] * stay * x * b / np.exp(logs[t]) / whole)
        zero_to = a + x * b
        a, b = np.where(fresh[t], 1.0, zero_to), np.where(fresh[t], 1.0, back * a + stay * x * b)
        total = a + b
        a, b = a / total, b / total
    flat = lambda v: v.T.reshape(-1)[:n]
    return flat(p), flat(pair), flat(logs)


def document_features(p: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each non-empty document: logit of the largest marginal, and log(1 + sum of marginals of tagged tokens)."""
    top = np.maximum.reduceat(p, starts)
    top = np.clip(np.log(np.maximum(top, 1e-12)) - np.log(np.maximum(1 - top, 1e-12)), -LIMIT, LIMIT)
    return top, np.log1p(np.add.reduceat(np.where(p >= TAGGED, p, 0.0), starts))


def markers(toxic: np.ndarray, clean: np.ndarray, rate: float) -> np.ndarray:
    """Which features occur in toxic documents almost only, in more of them than chance gives any of the features tried.

    ``toxic`` and ``clean``: documents of each class that hold a feature; ``rate``: the share of toxic documents.
    """
    enough = np.log(max(int((toxic + clean >= 4).sum()), 1)) + 3
    share = np.maximum(toxic, 1) / np.maximum(toxic + clean, 1)
    return (toxic >= 4) & (toxic >= 19 * clean) & (toxic * np.log(share / max(rate, 1e-9)) >= enough)


def sketches(words: list[bytes]) -> list[int]:
    """``SKETCHES`` min-hashes of the five-word shingles."""
    h = np.array([zlib.crc32(b" ".join(words[k : k + 5])) for k in range(max(1, len(words) - 4))], np.uint64)
    factors = generator(5).integers(1, 1 << 32, SKETCHES, dtype=np.uint64) | np.uint64(1)
    return [int(((h * m) % np.uint64(4294967291)).min()) for m in factors]


def fit(rows: Iterable[tuple[list[bytes], int]], shares: Callable[[int], float]) -> Field:
    """The field from (words, label) rows, read once; ``shares``: labelled rows that a row of a class stands for.

    Held at a time: a number for each token, the distinct words, and a number for each of their features.
    """
    vocabulary: dict[bytes, int] = {}
    tokens, starts, labels, kept, single = array("i"), [], [], [], []
    seen: set[tuple] = set()
    for words, y in rows:
        if words:
            starts.append(len(tokens))
            kept.append(len(labels))
            tokens.extend([vocabulary.setdefault(w, len(vocabulary)) for w in words])
            # Near copies count once, however much they were edited: documents that share two or more min-hashes with earlier
            # ones of their class, which nine in ten do at a similarity of a quarter. Words of one family else mark its class.
            own = {(y, n, h) for n, h in enumerate(sketches(words))}
            if len(own & seen) < 2:
                single.append(len(starts) - 1)
            seen |= own
        labels.append(y)
    labels = np.array(labels)
    if not len(tokens) or not (labels == 1).any():
        return Field()
    names = list(vocabulary)
    hashes = np.zeros((len(names), 6), np.uint64)
    for n, w in enumerate(names):
        own = features_of(w)
        hashes[n, : len(own)] = own
    features, table = np.unique(hashes, return_inverse=True)
    table = table.reshape(hashes.shape)
    ends = [*starts[1:], len(tokens)]
    tokens = np.frombuffer(tokens, np.int32)
    toxic, clean = np.zeros(len(features)), np.zeros(len(features))
    for n in single:
        held = np.unique(table[np.unique(tokens[starts[n] : ends[n]])])
        (toxic if labels[kept[n]] == 1 else clean)[held] += 1
    toxic[features == 0] = clean[features == 0] = 0
    marked = markers(toxic, clean, sum(labels[kept[n]] for n in single) / len(single))
    tagged = marked[table].any(axis=1)
    whole_word = np.zeros(len(features), bool)
    whole_word[table[:, 0]] = True
    used = (features != 0) & (toxic + clean >= np.where(whole_word, 5, 3))
    index = np.cumsum(used) - 1
    none = int(used.sum())
    index[~used] = none
    table, features = index[table], features[used]
    beside = table[:, 0]
    starts = np.array(starts)
    fresh = np.zeros(len(tokens), bool)
    fresh[starts] = True
    sizes = np.diff([*starts, len(tokens)])
    y = (tagged[tokens] & np.repeat(labels[kept] == 1, sizes)).astype(float)
    last = np.concatenate((fresh[1:], [True]))
    y_pair = np.where(fresh, 0.0, y * np.concatenate(([0.0], y[:-1])))
    crf, k = Field(), none + 1
    w = np.zeros(3 * k + 4)  # own, before, after; bias, start, back, stay
    w[3 * k] = -3.0
    first, second = np.zeros_like(w), np.zeros_like(w)
    y_back = np.where(fresh, 0.0, (1 - y) * np.concatenate(([0.0], y[:-1])))

    def emissions():
        own = w[:k][table].sum(axis=1)
        e = own[tokens] + w[3 * k]
        e[1:] += np.where(fresh[1:], 0.0, w[k : 2 * k][beside][tokens[:-1]])
        e[:-1] += np.where(last[:-1], 0.0, w[2 * k : 3 * k][beside][tokens[1:]])
        return np.clip(e, -LIMIT, LIMIT)

    for step in range(1, ROUNDS + 1):
        crf.start, crf.back, crf.stay = w[3 * k + 1 :]
        e = emissions()
        p, pair, _ = marginals(e, fresh, crf)
        d = y - p
        g = np.empty_like(w)
        by_word = np.bincount(tokens, d, len(names))
        g[:k] = np.bincount(table.ravel(), np.repeat(by_word, 6), k)
        g[k : 2 * k] = np.bincount(beside[tokens[:-1]], np.where(fresh[1:], 0.0, d[1:]), k)
        g[2 * k : 3 * k] = np.bincount(beside[tokens[1:]], np.where(last[:-1], 0.0, d[:-1]), k)
        p_before = np.where(fresh, 0.0, np.concatenate(([0.0], p[:-1])))
        g[3 * k :] = d.sum(), d[fresh].sum(), (y_back - (p_before - pair)).sum(), (y_pair - pair).sum()
        g -= PENALTY * len(starts) * w
        g[[none, k + none, 2 * k + none]] = 0
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w += RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        w[[none, k + none, 2 * k + none]] = 0
    keep = lambda part: {int(features[n]): float(part[n]) for n in np.flatnonzero(np.abs(part[:none]) > 0.05)}
    crf = Field(keep(w[:k]), keep(w[k : 2 * k]), keep(w[2 * k : 3 * k]), *map(float, w[3 * k :]))
    p, _, _ = marginals(emissions(), fresh, crf)
    top, mass = np.full(len(labels), -LIMIT), np.zeros(len(labels))
    top[kept], mass[kept] = document_features(p, starts)
    crf.document = _logistic(np.stack([top, mass, np.ones(len(labels))], axis=1), labels, np.where(labels == 1, shares(1), shares(0)))
    return crf


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Weighted logistic regression with a small penalty, by Newton's method."""
    b = np.array([0.5, 0.0, 0.0])
    weight = weight / weight.mean()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([0.3, 0.3, 0.01])
        b = b + np.linalg.solve(hessian, x.T @ (weight * (y - p)) - np.array([0.3, 0.3, 0.01]) * b)
    return tuple(map(float, b))


class Scorer:
    """Scores batches of texts; the emission weights of each distinct word are looked up once per worker."""

    def __init__(self, crf: Field):
        self.crf = crf
        self.rows: dict[tuple, int] = {}
        self.table = np.zeros((0, 3))
        outer = self

        class Known(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) >= CACHED_WORDS:
                    self.clear()
                self[word] = out = outer.row(word)
                return out

        self.known = Known()

    def row(self, word: bytes) -> int:
        own, found = self.crf.own, features_of(word)
        weights = (sum(own[f] for f in found if f in own), self.crf.before.get(found[0], 0.0), self.crf.after.get(found[0], 0.0))
        if weights not in self.rows:
            self.rows[weights] = len(self.rows)
            if len(self.rows) > len(self.table):
                self.table = np.concatenate((self.table, np.zeros((max(64, len(self.table)), 3))))
            self.table[len(self.rows) - 1] = weights
        return self.rows[weights]

    def __call__(self, texts: list[str | None]) -> tuple[list[float], list[list[tuple[int, int, float]]]]:
        """Scores, and for each text the tagged tokens as (first character, end, marginal)."""
        words = [words_of(t) for t in texts]
        kept = [k for k, w in enumerate(words) if w]
        top, mass = np.full(len(texts), -LIMIT), np.zeros(len(texts))
        spans: list[list] = [[] for _ in texts]
        if kept:
            sizes = np.array([len(words[k]) for k in kept])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            at = np.fromiter((i for k in kept for i in map(self.known.__getitem__, words[k])), np.int64, int(sizes.sum()))
            fresh = np.zeros(len(at), bool)
            fresh[starts] = True
            own, before, after = self.table[at].T
            e = own + self.crf.bias
            e[1:] += np.where(fresh[1:], 0.0, before[:-1])
            e[:-1] += np.where(fresh[1:], 0.0, after[1:])
            p, _, _ = marginals(np.clip(e, -LIMIT, LIMIT), fresh, self.crf)
            top[kept], mass[kept] = document_features(p, starts)
            by_document = defaultdict(list)
            for t in np.flatnonzero(p >= TAGGED).tolist():
                by_document[int(np.searchsorted(starts, t, "right")) - 1].append(t)
            for n, found in by_document.items():
                raw = texts[kept[n]].encode()
                places = [m.span() for m in WORD.finditer(raw)]
                for t in found:
                    a, b = places[t - int(starts[n])]
                    a = len(raw[:a].decode()) if len(raw) > len(texts[kept[n]]) else a
                    spans[kept[n]].append((a, a + len(raw[places[t - int(starts[n])][0] : b].decode()), float(p[t])))
        x = np.stack([top, mass, np.ones(len(texts))], axis=1) @ np.array(self.crf.document)
        return (1 / (1 + np.exp(-np.clip(x, -30, 30)))).tolist(), spans


def held_out(doc_id: Column, of: int = 3, remainder: int = 1) -> Column:
    """Whether crc32 of doc_id as text (null: empty) leaves ``remainder``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % of == remainder


def train(documents: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Field:
    """The field from at most ``most`` labelled documents of each class outside the held-out fold, by smallest hash of doc_id.

    A doc_id counts once, however many rows it has: with its largest label and its largest text. Null labels and other values
    than 0 and 1 aren't used; without a toxic document every score is that of no toxic word.
    """
    own = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).where(~held_out(F.col("doc_id"))).where("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = own.where("toxic = 1").orderBy(order, "doc_id").limit(most).unionByName(own.where("toxic = 0").orderBy(order, "doc_id").limit(most))
    sample = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = sample.groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    counts = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rows = ((words_of(r["text"]), r["toxic"]) for r in written(sample, "toxicity-sample").sortWithinPartitions("doc_id").toLocalIterator())
    return fit(rows, lambda y: counts.get(y, 0) / max(1, min(most, counts.get(y, 0))))


def score(documents: DataFrame, crf: Field) -> DataFrame:
    """(row: all columns of ``documents``, score, spans) for every whole text; empty and null texts get the score of no toxic word.

    No shuffle; a task holds a slice of a batch. Nulls in other columns, repeated rows and any further columns stay as they are.
    """
    source = documents.select(F.struct("*").alias("row"), documents["text"].cast("string").alias("t"))
    key = hashlib.sha256(repr([sorted(x.items()) if isinstance(x, dict) else x for x in vars(crf).values()]).encode()).hexdigest()

    def run(batches):
        cache = worker_cache("toxicity")
        if cache.get("toxicity", (None,))[0] != key:
            cache["toxicity"] = (key, Scorer(crf))
        scorer = cache["toxicity"][1]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for batch in batches:
            scores, spans = [], []
            for at in range(0, batch.num_rows, 512):
                s, found = scorer(batch.column("t").slice(at, 512).to_pylist())
                scores += s
                spans += [[{"start": a, "end": b, "p": p} for a, b, p in x] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["row", "score", "spans"])

    return mapped(source, run, f"row {source.schema['row'].dataType.simpleString()},score double,spans array<struct<start:int,end:int,p:double>>")


def score_documents(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted and spans for every row of ``documents``.

    Null and empty texts score as texts without a toxic word; null and repeated doc_ids keep a row each, and equal texts get
    equal scores; other columns aren't read; an empty table gives no rows.
    """
    scored = score(documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].alias("text")), train(documents, labels))
    return scored.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def drop_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``documents``, all columns whatever their names, that score below ``threshold``; nulls as in ``score_documents``."""
    return score(documents, train(documents, labels)).where(F.col("score") < threshold).select("row.*")
