"""Fuzzy search for short licence notices: exact seeds by the pigeonhole principle, then bounded-error matching.

A notice that may differ in k edits is cut into k + 1 seeds, one of which any such match holds unchanged. An Aho-Corasick
automaton finds all seeds of all notices in one pass. A seed leaves at most 2 k + 1 characters where its notice can start; at
each word that starts there the regex library matches the notice with at most k errors, over a bounded stretch of text and once
for each start, so a text costs in proportion to its length and its seeds. Of places of one notice that overlap the one with
the fewest edits counts, then the first; a place inside one of a longer notice doesn't count. All of it runs over a text's
words, lower-cased and joined by single blanks.
"""

from __future__ import annotations

import bisect
import re

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tablewright.llm.common import mapped, rows_of, worker_cache

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notices that the fuzzy search knows beside the base phrases.
NOTICES = BASE | {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "gnu affero general public license": "agpl",
    "eclipse public license": "epl",
    "boost software license version": "bsl",
    "free and unencumbered software released into the public domain": "unlicense",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
}
#: Characters of a notice for each edit allowed.
CHARACTERS_PER_EDIT = 10
KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def seeds(notice: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` pieces of ``notice`` with their offsets."""
    size, extra = divmod(len(notice), k + 1)
    cuts = [0]
    for n in range(k + 1):
        cuts.append(cuts[-1] + size + (n < extra))
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Finder:
    """Exact places of the base phrases and fuzzy places of all notices in a text."""

    def __init__(self, notices: dict[str, str], base: dict[str, str], per_edit: int):
        self.base = [(f" {p} ", label) for p, label in base.items()]
        self.notices = [(p, label, len(p) // per_edit) for p, label in notices.items()]
        self.patterns = [[regex.compile(rf"(?:{regex.escape(p)}){{e<={e}}}(?!\S)") for e in range(k + 1)] for p, _, k in self.notices]
        self.automaton = ahocorasick.Automaton()
        held: dict[str, list] = {}
        for n, (p, _, k) in enumerate(self.notices):
            for at, seed in seeds(p, k):
                held.setdefault(seed, []).append((n, at, len(seed)))
        for seed, uses in held.items():
            self.automaton.add_word(seed, uses)
        self.automaton.make_automaton()

    def base_places(self, joined: str) -> list[tuple[int, str]]:
        """(first word, label) of each base phrase in ``joined`` (words between single blanks, blanks at both ends)."""
        out = []
        for phrase, label in self.base:
            at, known, words = joined.find(phrase), 0, 0
            while at >= 0:
                words, known = words + joined.count(" ", known, at), at
                out.append((words, label))
                at = joined.find(phrase, at + 1)
        return out

    def match(self, joined: str, n: int, start: int) -> tuple[int, int] | None:
        """(edits, end) of notice ``n`` from ``start``: fewest edits, then the length nearest to the notice's, then the shorter."""
        p, _, k = self.notices[n]
        found = self.patterns[n][k].match(joined, start, start + len(p) + k + 1)
        if not found:
            return None
        for e, pattern in enumerate(self.patterns[n]):
            for off in sorted(range(-e, e + 1), key=lambda x: (abs(x), x)):
                end = start + len(p) + off
                if start < end < len(joined) and joined[end] == " " and joined[end - 1] != " " and pattern.fullmatch(joined, start, end):
                    return e, end
        return None

    def fuzzy_places(self, joined: str) -> list[tuple[int, int, str, int, float]]:
        """(start, end, label, edits, score) in ``joined`` in order, each place of a notice once."""
        tried: dict[int, dict[int, tuple[int, int]]] = {}
        for last, uses in self.automaton.iter(joined):
            for n, at, size in uses:
                k, known = self.notices[n][2], tried.setdefault(n, {})
                middle = last + 1 - size - at
                for start in range(max(1, middle - k), middle + k + 1):
                    if start not in known and start < len(joined) and joined[start - 1] == " " and joined[start] != " ":
                        known[start] = self.match(joined, n, start)
        chosen = []
        for n, known in tried.items():
            chosen += [(start, end, n, edits) for start, (edits, end) in _apart([(s, m) for s, m in known.items() if m])]
        chosen.sort(key=lambda x: (x[0], -x[1]))
        out, reach = [], []
        for start, end, n, edits in chosen:
            p, label, _ = self.notices[n]
            reach = [x for x in reach if x[1] > start]
            if not any(a <= start and end <= b and size > len(p) for a, b, size in reach) and not any(o[2] == label and o[0] == start for o in out[-8:]):
                out.append((start, end, label, edits, 1 - edits / len(p)))
            reach.append((start, end, len(p)))
        return out


def _apart(found: list[tuple[int, tuple[int, int]]]) -> list[tuple[int, tuple[int, int]]]:
    """Matches that don't overlap, those with the fewest edits first, then the earliest; in order of their starts."""
    out, cluster, reach = [], [], 0
    for start, (edits, end) in [*sorted(found), (1 << 62, (0, 0))]:
        if start >= reach:  # nothing before overlaps what comes now
            kept: list[tuple[int, int, int]] = []
            starts: list[int] = []
            for e, a, b in sorted((e, a, b) for a, (e, b) in cluster):
                place = bisect.bisect(starts, a)
                if (place == 0 or kept[place - 1][2] <= a) and (place == len(kept) or kept[place][1] >= b):
                    kept.insert(place, (e, a, b))
                    starts.insert(place, a)
            out += [(a, (e, b)) for e, a, b in kept]
            cluster = []
        cluster.append((start, (edits, end)))
        reach = max(reach, end)
    return out


def scan(documents: DataFrame, notices: dict[str, str] | None = None, base: dict[str, str] | None = None, per_edit: int = CHARACTERS_PER_EDIT) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    ``matches`` lists fuzzy places: label, characters from start to end in the original text, edits. The score is 1 for an
    unchanged notice, less an edit's share of it for the best other one, 0 without any. Null texts are empty; null and
    repeated doc_ids keep a row each; other columns aren't read; an empty table gives no rows. No shuffle.
    """
    notices, base = notices or NOTICES, BASE if base is None else base
    kind = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("matches", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())])))])
    source = documents.select(documents["doc_id"].cast("long").alias("d"), documents["text"].cast("string").alias("t"))

    def run(batches):
        cache, key = worker_cache("notices"), ("notices", tuple(notices.items()), tuple(base.items()), per_edit)
        finder = cache.get(key) or cache.setdefault(key, Finder(notices, base, per_edit))
        held = []
        for doc_id, text in rows_of(batches, "d", "t"):
            words = (text or "").encode().translate(KEEP).split(b" ")
            words = [w for w in words if w]
            joined = f" {b' '.join(words).decode()} " if words else ""
            places = finder.base_places(joined)
            fuzzy = finder.fuzzy_places(joined)
            matches = []
            if fuzzy:
                spans, known, before = [m.span() for m in WORD.finditer(text)], 0, 0
                for start, end, label, edits, _ in fuzzy:
                    before, known = before + joined.count(" ", known, start), start  # blanks before the place: its first word's number, from 1
                    last = before + joined.count(" ", start, end)
                    matches.append({"label": label, "start": spans[before - 1][0], "end": spans[last - 1][1], "edits": edits})
            at = [w for w, _ in places]
            base_labels = sorted({x for _, x in places})
            labels = sorted({*base_labels, *(x[2] for x in fuzzy)})
            score = 1.0 if places else max((x[4] for x in fuzzy), default=0.0)
            held.append((doc_id, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(base_labels), ",".join(labels), score, matches))
            if len(held) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kind.types, strict=True)], schema=kind)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kind.types, strict=True)], schema=kind)

    return mapped(source, run, "doc_id bigint,n_words bigint,n_base bigint,first_word bigint,last_word bigint,base_labels string,labels string,score double,matches array<struct<label:string,start:int,end:int,edits:int>>")
