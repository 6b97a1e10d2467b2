"""Marginal document likelihood over a subword lattice.

The vocabulary is an existing one; a piece's weight is its log share among the training texts' pieces, first as the existing
tokenizer cuts them, then as expected over all ways to cut them (``ROUNDS`` forward-backward passes). The vocabulary's own
scores are used where they are log probabilities; those of a merge-based model are ranks of merges, which can't weigh one way
to cut a word against another, so there the shares take their place. A word's probability sums over all ways to cut it into
pieces: a log-space forward recursion over its lattice. Pieces never cross words, so a document's is the sum of its words'
logs and that of the end. Words of one length run together; a very long one runs by itself, a stretch of it at a time.

No text meets a corpus-wide table. Scan tasks number the words of each block of documents and write documents as word
numbers and one row for each distinct word of the block. Those rows meet on the word, where counts are summed and each
distinct word's lattice is run once, and go back to their block, where documents are scored by array lookups.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import discard, mapped, worker_cache, written

#: Bytes of text in a block; its distinct words are held by one task.
BLOCK_BYTES = 32_000_000
#: What is added to the count of every piece of the vocabulary.
SMOOTHING = 0.1
#: Forward-backward passes over the training words that weigh the pieces anew.
ROUNDS = 2
#: Characters of distinct words that one task runs the lattices of, and tasks there are at most.
TASK_CHARS = 1_000_000
MOST_TASKS = 4096
#: Distinct words that run together.
WORDS = 50_000
#: Characters beyond which a word runs by itself, and of a stretch of it.
LONG = 1000
STRETCH = 20_000
SPACE = "▁"
LN10 = math.log(10)
LOG_DDL = "kind string,block bigint,doc_id bigint,train boolean,ids binary,id int,word binary,c bigint"


def _numbered(batches, of: int, remainder: int):
    """The log: 'doc' rows (block, doc_id, train, ids: word numbers, zstd) and 'word' rows (block, id, word, c: count in training rows)."""
    import zlib

    pack = zstandard.ZstdCompressor(level=1).compress
    names = [x.split()[0] for x in LOG_DDL.split(",")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.binary(), pa.int64()]

    class Numbers(dict):
        def __missing__(self, word):
            self[word] = n = len(self)
            return n

    numbers, counts, block, load = Numbers(), np.zeros(1 << 16, np.int64), TaskContext.get().partitionId() << 24, 0

    def made(**columns):
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in zip(names, kinds, strict=True)], names=names)

    def close():
        words = list(numbers)
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            yield made(kind=["word"] * len(part), block=[block] * len(part), id=np.arange(at, at + len(part), dtype=np.int32), word=part, c=counts[at : at + len(part)])

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            docs = {"doc_id": part.column("d").to_pylist(), "train": [], "ids": []}
            for doc_id, text in zip(docs["doc_id"], part.column("t").to_pylist(), strict=True):
                words = (text or "").encode().lower().split()
                ids = np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))
                train = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % of != remainder
                if len(numbers) > len(counts):
                    counts = np.concatenate((counts, np.zeros(len(numbers), np.int64)))
                if train and len(ids):
                    if len(ids) * 50 < len(numbers):
                        np.add.at(counts, ids, 1)
                    else:
                        counts[: len(numbers)] += np.bincount(ids, minlength=len(numbers))
                docs["train"].append(train)
                docs["ids"].append(pack(ids.tobytes()))
                load += len(text or "")
            yield made(kind=["doc"] * part.num_rows, block=[block] * part.num_rows, **docs)
            if load >= BLOCK_BYTES:
                yield from close()
                numbers, counts, block, load = Numbers(), np.zeros(1 << 16, np.int64), block + 1, 0
    yield from close()


class Lattice:
    """Log probabilities of words over all segmentations, for many words of one length at once."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str], logs: list[float], bytes_at: dict[int, float]):
        own = {p: v for p, v in zip(pieces, logs, strict=True)}
        self.longest = max(map(len, own), default=1)
        self.bytes_at = bytes_at
        pairs = sorted((self.key(p), v, k, p) for k, (p, v) in enumerate(own.items()))
        self.keys = np.array([k for k, *_ in pairs], np.uint64)
        self.logs = np.array([v for _, v, *_ in pairs])
        self.place = np.array([n for *_, n, _ in pairs])  # of a key among the pieces given
        self.codes = np.zeros((len(pairs), self.longest), np.uint32)
        for n, (*_, p) in enumerate(pairs):
            self.codes[n, : len(p)] = [ord(c) for c in p]
        self.sizes = np.array([len(p) for *_, p in pairs])
        # One byte for each value of a key's upper bits: most strings that are no piece end here.
        self.some = np.zeros(1 << 20, bool)
        self.some[self.keys >> np.uint64(44)] = True
        self.chars: dict[int, float] = {}

    def found(self, h: np.ndarray, codes: np.ndarray, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, places in the table) of the rows whose characters ``at`` to ``to`` are a piece; ``h`` are the strings' hashes."""
        rows = np.flatnonzero(self.some[h >> np.uint64(44)])
        if not rows.size:
            return rows, rows
        place = np.minimum(np.searchsorted(self.keys, h[rows]), len(self.keys) - 1)
        same = (self.keys[place] == h[rows]) & (self.sizes[place] == to - at)
        rows, place = rows[same], place[same]
        same = (self.codes[place, : to - at] == codes[rows, at:to]).all(axis=1)
        return rows[same], place[same]

    @classmethod
    def key(cls, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(cls.BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def by_bytes(self, code: int) -> float:
        """A character that no piece holds, as its bytes."""
        if code not in self.chars:
            self.chars[code] = sum(self.bytes_at[b] for b in chr(code).encode("utf-8", "surrogatepass"))
        return self.chars[code]

    def edges(self, codes: np.ndarray):
        """(i, j, rows, log, piece) of the lattices of the words in the rows of ``codes``; piece is -1 for bytes."""
        m, n = codes.shape
        steps = codes.astype(np.uint64) + np.uint64(1)
        for i in range(n):
            h = np.zeros(m, np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                with np.errstate(over="ignore"):
                    h = h * self.BASE + steps[:, j - 1]
                rows, at = self.found(h, codes, i, j)
                if rows.size:
                    yield i, j, rows, self.logs[at], self.place[at]
                if j == i + 1 and rows.size < m:
                    rows = np.setdiff1d(np.arange(m), rows, assume_unique=True)
                    yield i, j, rows, np.array([self.by_bytes(c) for c in codes[rows, i].tolist()]), np.full(rows.size, -1)

    def same_length(self, codes: np.ndarray, weights: np.ndarray | None = None, counts: np.ndarray | None = None) -> np.ndarray:
        """Log probabilities of the words in the rows of ``codes`` (code points); adds expected uses of pieces to ``counts``."""
        m, n = codes.shape
        alpha = np.full((n + 1, m), -np.inf)
        alpha[0] = 0.0
        held = []
        for edge in self.edges(codes):
            i, j, rows, log, _ = edge
            alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + log)
            if counts is not None:
                held.append(edge)
        if counts is not None:
            beta = np.full((n + 1, m), -np.inf)
            beta[n] = 0.0
            for i, j, rows, log, piece in reversed(held):
                through = log + beta[j, rows]
                beta[i, rows] = np.logaddexp(beta[i, rows], through)
                if piece[0] >= 0:
                    np.add.at(counts, piece, weights[rows] * np.exp(alpha[i, rows] + through - alpha[n, rows]))
        return alpha[n]

    def stretch(self, codes: np.ndarray, start: int, end: int) -> list[list[tuple[int, float, int]]]:
        """For each end j in (start, end] of one word: its pieces as (length, log, piece); piece is -1 for bytes."""
        out: list[list[tuple[int, float, int]]] = [[] for _ in range(end - start)]
        low = max(0, start + 1 - self.longest)
        # Row r of the windows is the word from low + r on.
        padded = np.concatenate((codes[low:end], np.zeros(self.longest, codes.dtype)))
        windows = np.lib.stride_tricks.sliding_window_view(padded, self.longest)[: end - low]
        steps, h = windows.astype(np.uint64) + np.uint64(1), np.zeros(end - low, np.uint64)
        for size in range(1, self.longest + 1):
            with np.errstate(over="ignore"):
                h = h * self.BASE + steps[:, size - 1]
            rows, at = self.found(h, windows, 0, size)
            hits = set()
            for r, log, piece in zip(rows.tolist(), self.logs[at].tolist(), self.place[at].tolist(), strict=True):
                j = low + r + size
                hits.add(r)
                if start < j <= end:
                    out[j - start - 1].append((size, log, piece))
            if size == 1:
                for r in range(start - low, end - low):
                    if r not in hits:
                        out[low + r - start].append((1, self.by_bytes(int(codes[low + r])), -1))
        return out

    def long_word(self, word: str, weight: float = 0.0, counts: np.ndarray | None = None) -> float:
        """As ``same_length`` for one long word: two numbers are held for each character, and the pieces of one stretch."""
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4")
        n, exp, log1p = len(codes), math.exp, math.log
        alpha = [0.0]
        for start in range(0, n, STRETCH):
            for edges in self.stretch(codes, start, min(n, start + STRETCH)):
                j = len(alpha)
                into = [alpha[j - size] + log for size, log, _ in edges if size <= j]
                top = max(into)
                alpha.append(top + log1p(sum(exp(x - top) for x in into)))
        if counts is not None:
            beta = [-math.inf] * n + [0.0]
            for start in reversed(range(0, n, STRETCH)):
                for back, edges in enumerate(reversed(self.stretch(codes, start, min(n, start + STRETCH)))):
                    j = min(n, start + STRETCH) - back
                    for size, log, piece in edges:
                        i = j - size
                        if i < 0:
                            continue
                        through = log + beta[j]
                        top = max(beta[i], through)
                        beta[i] = top + log1p(exp(beta[i] - top) + exp(through - top))
                        if piece >= 0:
                            counts[piece] += weight * exp(alpha[i] + through - alpha[n])
        return alpha[n]

    def __call__(self, words: list[str], weights: np.ndarray | None = None, counts: np.ndarray | None = None) -> np.ndarray:
        out = np.empty(len(words))
        lengths = np.array([len(w) for w in words])
        order = np.argsort(lengths, kind="stable")
        cuts = [0, *(np.flatnonzero(np.diff(lengths[order])) + 1).tolist(), len(words)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            n = int(lengths[order[a]]) if b > a else 0
            if n > LONG:
                for k in order[a:b].tolist():
                    out[k] = self.long_word(words[k], 0.0 if weights is None else float(weights[k]), counts)
                continue
            for at in range(a, b, max(1, 400_000 // (n + 1))):
                rows = order[at : min(b, at + max(1, 400_000 // (n + 1)))]
                codes = np.frombuffer("".join(words[k] for k in rows).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(rows), n)
                out[rows] = self.same_length(codes, None if weights is None else weights[rows], counts)
        return out


def _gathered(batches):
    """Batches joined up to ``WORDS`` rows, as the lattice runs all words of one length at once."""
    held = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= WORDS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _processor(model: str):
    cache = worker_cache("lm")
    if ("pieces", model) not in cache:
        from sentencepiece import SentencePieceProcessor

        cache["pieces", model] = SentencePieceProcessor(model_file=model)
    return cache["pieces", model]


def piece_counts(words: DataFrame, model: str) -> DataFrame:
    """(piece, n) over the words (word: binary, c) of the training rows, as the existing tokenizer cuts them; a task sends a row for each piece."""

    def run(batches):
        sp, total = _processor(model), None
        for batch in batches:
            total = np.zeros(sp.get_piece_size()) if total is None else total
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                texts = [w.decode() for w in part.column("word").to_pylist()]
                ids = sp.encode(texts, num_threads=1)
                weights = np.repeat(part.column("c").to_numpy(), [len(x) for x in ids])
                total += np.bincount([k for x in ids for k in x], weights, len(total))
        if total is not None:
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["piece", "n"])

    return mapped(words.where("c > 0").select("word", "c"), run, "piece int,n double").groupBy("piece").agg(F.sum("n").alias("n"))


def expected_counts(words: DataFrame, parts, n: int) -> DataFrame:
    """(at, n): expected uses of each of the lattice's ``n`` pieces over the words of the training rows; a task sends a row for each."""

    def run(batches):
        lattice, total = Lattice(*parts.value), np.zeros(n)
        for batch in _gathered(batches):
            lattice([SPACE + w.decode() for w in batch.column("word").to_pylist()], batch.column("c").to_numpy().astype(float), total)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["at", "n"])

    return mapped(words.where("c > 0").select("word", "c"), run, "at int,n double").groupBy("at").agg(F.sum("n").alias("n"))


def lattice_of(model: str, counts: dict[int, float], ends: int) -> tuple[tuple, float, list[int]]:
    """What Lattice is made of, the log probability of the end, and the vocabulary's id of each of the lattice's pieces."""
    sp = _processor(model)
    size = sp.get_piece_size()
    usable = [k for k in range(size) if not sp.is_control(k) and not sp.is_unknown(k)]
    whole = sum(counts.get(k, 0.0) for k in usable) + SMOOTHING * len(usable) + ends + 1
    logs = {k: math.log((counts.get(k, 0.0) + SMOOTHING) / whole) for k in usable}
    bytes_at = {int(sp.id_to_piece(k)[3:5], 16): v for k, v in logs.items() if sp.is_byte(k)}
    text = [k for k in usable if not sp.is_byte(k) and SPACE not in sp.id_to_piece(k)[1:]]
    return ([sp.id_to_piece(k) for k in text], [logs[k] for k in text], bytes_at), math.log((ends + 1) / whole), text


def lm_scores(documents: DataFrame, model: str, of: int = 7, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``documents``.

    Training rows are those whose crc32 of doc_id as text (null: empty) leaves another remainder. Null texts are empty: the
    end alone. Null and repeated doc_ids keep a row each; other columns aren't read; an empty table gives no rows, and one
    without training rows makes every token unknown and all pieces alike.
    """
    source = documents.select(documents["doc_id"].cast("long").alias("d"), documents["text"].cast("string").alias("t"))

    def number(batches):
        yield from _numbered(batches, of, remainder)

    log = written(mapped(source, number, LOG_DDL), "lm-log", partition_by=["kind"])
    rows = log.where("kind = 'word'").select("block", "id", "word", "c")
    docs = log.where("kind = 'doc'").select("block", "doc_id", "train", "ids")
    words = written(rows.groupBy("word").agg(F.sum("c").alias("c")), "lm-words")
    ends = docs.where("train").count()
    seen = F.col("c") > 0
    known, tokens, chars = words.agg(F.count_if(seen), F.coalesce(F.sum(F.when(seen, F.col("c"))), F.lit(0)), F.coalesce(F.sum(F.length("word") + 1), F.lit(0))).first()
    # The lattices cost time by characters, not by bytes of the table.
    counted, words = words, written(words.repartition(max(1, min(MOST_TASKS, math.ceil(chars / TASK_CHARS))), "word"), "lm-words")
    discard(counted)
    n_all, n_distinct = tokens + ends, known + (ends > 0)
    share = documents.sparkSession.sparkContext.broadcast  # of what is as large as the vocabulary
    counts = {r["piece"]: r["n"] for r in piece_counts(words, model).collect()}
    parts, end, ids = lattice_of(model, counts, ends)
    bound = share(parts)
    for _ in range(ROUNDS):
        again = {ids[r["at"]]: r["n"] for r in expected_counts(words, bound, len(ids)).collect()}
        again |= {k: v for k, v in counts.items() if _processor(model).is_byte(k)}  # bytes stay as first counted
        parts, end, ids = lattice_of(model, again, ends)
        bound = share(parts)

    def run_lattice(batches):
        lattice = Lattice(*bound.value)
        for batch in _gathered(batches):
            logs = lattice([SPACE + w.decode() for w in batch.column("word").to_pylist()]) / LN10
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(logs)], names=["word", "c", "lp"])

    priced = mapped(words, run_lattice, "word binary,c bigint,lp double")
    back = rows.select("block", "id", "word").join(priced, "word").select("block", F.lit(0).alias("kind"), "id", "c", "lp", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("train"), F.lit(None).cast("binary").alias("ids"))
    there = docs.select("block", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("id"), F.lit(None).cast("long").alias("c"), F.lit(None).cast("double").alias("lp"), "doc_id", "train", "ids")
    below = math.log10(n_all + n_distinct + 1)

    def score(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        block, parts, table = None, [], None
        for batch in batches:
            blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            change = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
            cuts = [0, *change.tolist(), len(blocks)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if blocks[a] != block:
                    block, parts, table = blocks[a], [], None
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    parts.append((part.column("c").to_numpy(), part.column("lp").to_numpy()))
                    continue
                if table is None:
                    c = np.concatenate([x for x, _ in parts]) if parts else np.zeros(0)
                    table = (c > 0, np.log10(c + 1.0) - below, np.concatenate([x for _, x in parts]) if parts else np.zeros(0))
                    parts = []
                out = []
                for ids in part.column("ids").to_pylist():
                    at = np.frombuffer(unpack(ids), np.uint32)
                    out.append((len(at) + 1, int(table[0][at].sum()) + (ends > 0), float(table[1][at].sum()) + math.log10(ends + 1) - below, float(table[2][at].sum()) + end / LN10))
                n_tokens, n_known, base, model_score = zip(*out, strict=True)
                held = pa.compute.invert(part.column("train"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), held, pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array([n_all] * len(out), pa.int64()), pa.array(base), pa.array(model_score)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    # Blocks are numbered by task and, within it, in order, so each gets a partition of its own.
    tasks, most = docs.agg(F.max(F.shiftright("block", 24)), F.max(F.col("block").bitwiseAND(F.lit((1 << 24) - 1)))).first()
    number = (F.shiftright("block", 24) + F.col("block").bitwiseAND(F.lit((1 << 24) - 1)) * ((tasks or 0) + 1)).cast("int")
    met = back.unionByName(there).repartitionById(((tasks or 0) + 1) * ((most or 0) + 1), number).sortWithinPartitions("block", "kind", "id")
    return mapped(met, score, "doc_id bigint,held_out boolean,n_tokens bigint,n_known bigint,train_tokens bigint,base_score double,score double")
