import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing
from tessera.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def encoder():
    return packing.encoder(tokenizer_path())


def whole(encoder, text):
    return [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, packing.END_ID]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab'srvelmdtSTé1!? \n\t<|>ÀßşĲΣ́\x1c²"), max_size=8))
def test_encoder_matches_tokenizer(texts):
    encoder = packing.encoder(tokenizer_path())
    assert [x.tolist() for x in encoder.encode(texts)] == [whole(encoder, t) for t in texts]


def test_encoder_long_and_special(encoder):
    rng = random.Random(3)
    long_text = " ".join("".join(rng.choice("abcdefé'") for _ in range(rng.randint(1, 9))) for _ in range(400_000))
    for text in (long_text, "<|endoftext|> a", "İstanbul ΑΣ", ""):
        assert next(encoder.encode([text])).tolist() == whole(encoder, text)


def test_cut_gives_reciprocal_lengths():
    for n in [*range(1, 300), 4095, 4096, 4097, 100_000]:
        pieces = packing.cut(n)
        assert sum(x for _, x in pieces) == n
        assert all(x == packing.CAPACITY // k for k, x in pieces if k) and all(0 < x < 64 for k, x in pieces if not k)


def check_packed(rows, docs, encoder):
    """Every id of every document exactly once, sequences gapless and at most the capacity."""
    want = sorted(tuple(whole(encoder, t or "")) for _, t in docs)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    sizes = []
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at and r.length > 0
            at += r.length
        sizes.append(at)
    assert max(sizes, default=0) <= packing.CAPACITY
    assert sum(r.length for r in rows) == sum(map(len, want))
    return sizes


def test_pack_small_and_odd(spark, odd_documents, no_documents, encoder):
    rows = packing.pack(odd_documents, tokenizer_path()).collect()
    docs = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    check_packed(rows, docs, encoder)
    for doc, text in docs:
        ids = np.array(whole(encoder, text or ""), dtype="<u4")
        own = [r for r in rows if r.doc_id == doc and r.doc_tokens == len(ids)]
        assert own and all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    assert packing.pack(no_documents, tokenizer_path()).count() == 0


def test_little_padding(spark, encoder):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(docs, tokenizer_path()).collect()
    sizes = check_packed(rows, [(r.doc_id, r.text) for r in docs.collect()], encoder)
    padding = sum(packing.CAPACITY - n for n in sizes if n & (n - 1))
    assert padding < 0.01 * sum(sizes)


def test_pieces_that_are_known_age_no_others(monkeypatch):
    from tessera.llm.queries import tokenizer_path

    monkeypatch.setattr(packing, "PIECE_CACHE", 40)
    own, words = packing.Encoder(tokenizer_path()), [f"word{c}" for c in "abcdefghijkl"]
    assert own.known(words) == own.known(words) and set(own.young) == set(words) and not own.old
