"""Encoding, the token store and packing against the tokenizer on whole texts."""

import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewright.llm import packing, token_store
from tablewright.llm.tokenizing import PieceEncoder

WORDS, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def whole(path):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("path", "spaces"), [(WORDS, False), (BYTES, True)])
def test_pieces_equal_whole_texts(path, spaces):
    own, reference = PieceEncoder(path, spaces), whole(path)

    @settings(max_examples=400, deadline=None)
    @given(st.text(alphabet=st.sampled_from(list(" \n\t\x01\x1c\x85 ab'sXÉéß́İΣ12.,!?$|<>上")), max_size=40))
    def check(text):
        assert own.encode(text) == array("I", reference(text)).tobytes()

    check()
    for text in ("<|endoftext|> a <|startoftext|>", "x<|endoftext|>y <|ENDOFTEXT|>  <|end", "<|startoftext|>", "don't we'll I'VE", "a  b   c\n\n d ", "x" * 3000, "Straße ẞ ǅ ﬁ Å Ω"):
        assert own.encode(text) == array("I", reference(text)).tobytes()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), min_size=1, max_size=1500))
def test_codes_round_trip_and_random_access(ids):
    levels, bitmaps, ranks = token_store.dac_encode(np.array(ids, np.uint32))
    assert token_store.dac_decode(levels, bitmaps).tolist() == ids
    for at in {0, len(ids) // 2, len(ids) - 1, *range(0, len(ids), 97)}:
        assert token_store.dac_get(levels, bitmaps, ranks, at) == ids[at]


def test_store(spark, odd, tmp_path):
    reference = whole(WORDS)
    path = f"file://{tmp_path}/tokens"
    token_store.write_tokens(odd, path, WORDS, end_id=2)
    got = sorted(token_store.read_tokens(spark, path).collect(), key=lambda r: r.start)
    given_rows = sorted(((d, t or "") for d, t in odd.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))  # equal doc_ids hold equal texts here
    ids = [[*reference(t), 2] for _, t in given_rows]
    assert [r.doc_id for r in got] == [d for d, _ in given_rows]
    assert [r.ids for r in got] == [array("I", x).tobytes() for x in ids]
    assert [r.start for r in got] == np.concatenate(([0], np.cumsum([len(x) for x in ids])[:-1])).tolist()
    flat = [k for x in ids for k in x]
    positions = spark.createDataFrame([(k,) for k in (0, 5, len(flat) - 1, len(flat), 30)], "position long")
    assert sorted(map(tuple, token_store.tokens_at(positions, path).collect())) == sorted((k, flat[k]) for k in (0, 5, 30, len(flat) - 1))


def test_many_empty_documents_and_lookups(spark, tmp_path):
    path = f"file://{tmp_path}/tokens"
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    token_store.write_tokens(docs, path, WORDS, end_id=2)
    assert token_store.read_tokens(spark, path).agg(F.sum("n_tokens"), F.max("start"), F.max("first_id")).first() == (200_000, 199_999, 2)
    wanted = spark.range(0, 200_010, 1).select(F.col("id").alias("position"))
    assert token_store.tokens_at(wanted, path).agg(F.count("*"), F.sum("id")).first() == (200_000, 400_000)


def test_long_document(spark, tmp_path):
    path, text = f"file://{tmp_path}/tokens", " ".join(f"w{k} 上é{k % 7}" for k in range(80_000))
    token_store.write_tokens(spark.createDataFrame([(1, "a b"), (2, text), (3, "c")], "doc_id long, text string"), path, WORDS, end_id=2)
    flat = [k for t in ("a b", text, "c") for k in (*whole(WORDS)(t), 2)]
    assert len(flat) > 3 * token_store.SEGMENT_TOKENS
    at = [*range(0, len(flat), 4999), len(flat) - 1]
    got = token_store.tokens_at(spark.createDataFrame([(k,) for k in at], "position long"), path).collect()
    assert sorted(map(tuple, got)) == [(k, flat[k]) for k in at]


def test_store_empty(spark, odd):
    assert token_store.token_digests(odd.limit(0), WORDS, 2).count() == 0


def test_binary_lengths():
    for n in [*range(1, 3000, 7), 1024, 1023, 1025]:
        parts = packing.binary_lengths(n)
        assert sum(parts) == n
        assert parts == sorted(parts, reverse=True)
        assert all(p & (p - 1) == 0 and p <= 1024 for p in parts)
        assert len(set(parts)) + n // 1024 - (n >= 1024) == len(parts)


def test_packing(spark, odd):
    reference = whole(BYTES)
    got = packing.pack(odd, BYTES, end_id=0).collect()
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    lengths = [r.length for r in sorted(got, key=lambda r: r.sequence_id)]
    assert lengths == sorted(lengths)
    assert {(r.doc_id, r.start, r.length, r.sequence_id) for r in packing.pack(odd, BYTES, end_id=0).collect()} == {(r.doc_id, r.start, r.length, r.sequence_id) for r in got}
    assert {r.offset for r in got} == {0}
    documents = {}
    for r in got:
        ids = packing.ids_of(r.ids, r.length)
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32
        documents.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids.tolist()))
    want = {}
    for d, t in odd.select("doc_id", "text").collect():
        want.setdefault((d, len(reference(t)) + 1), []).append([*reference(t), 0])
    assert documents.keys() == want.keys()
    for key, texts in want.items():
        flat = [k for _, ids in sorted(documents[key]) for k in ids]
        assert sorted(flat) == sorted(k for x in texts for k in x)
    assert packing.pack(odd.limit(0), BYTES, 0).count() == 0
