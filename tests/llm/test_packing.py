import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from matchloom.llm import packing, tokenization

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


LIBRARIES = {p: Tokenizer.from_file(p) for p in (WORDS, BYTES)}
ENCODERS = {p: tokenization.ChunkEncoder(p) for p in (WORDS, BYTES)}
ALPHABET = "aZé́Σß1 23'st.,!  \n\n\t\r\x0b\x0c\x1c\x1f\x85\xa0  　​<|endoftext|>日🙂"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=40) | st.text(max_size=20))
def test_chunks_give_the_ids_of_the_whole_text(text):
    for path, encoder in ENCODERS.items():
        want = np.array(LIBRARIES[path].encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert encoder.encode(text) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | st.lists(st.text(alphabet=ALPHABET, min_size=1, max_size=8) | st.sampled_from(["word", "don't", "x1,"]), max_size=30).map(" ".join), max_size=12))
def test_chunks_of_many_texts_are_learned_together(texts):
    for path, library in LIBRARIES.items():
        want = [np.array(library.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
        assert list(tokenization.ChunkEncoder(path).encode_all(texts)) == want


def test_small_limits_change_nothing(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["alpha", "beta.\nGamma", "x" * 90, "d'être", "12345"]) + str(rng.randrange(50)) for _ in range(800))
    monkeypatch.setattr(tokenization, "KEPT", 40)
    monkeypatch.setattr(tokenization, "PART", 64)
    monkeypatch.setattr(tokenization, "JOINED", 7)
    for path in LIBRARIES:
        for value in (text, text.replace(" x", "  x")):
            want = LIBRARIES[path].encode(value, add_special_tokens=False).ids
            encoder = tokenization.ChunkEncoder(path)
            assert np.frombuffer(encoder.encode(value), "<u4").tolist() == want
            assert all(np.frombuffer(x, "<u4").tolist() == want for x in encoder.encode_all([value, value]))


def test_binary_lengths():
    for n in (*range(1, 70), 2047, 2048, 2049, 10_000):
        lengths = list(packing.binary_lengths(n))
        assert sum(lengths) == n and all(x & (x - 1) == 0 and x <= 2048 for x in lengths)
        assert lengths == sorted(lengths, reverse=True)


def test_pieces_cover_every_document(spark, monkeypatch):
    monkeypatch.setattr(packing, "HANDED", 50_000)
    rows = [(1, None, 7), (2, "", 7), (3, "Some Words here, some there.", 7), (3, "Some Words here, some there.", 7), (None, "no id", 7), (5, "long text " * 4000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.with_digest(packing.decompose(docs, WORDS)).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    want = {}
    for key, text, _ in rows:
        ids = LIBRARIES[WORDS].encode(text or "", add_special_tokens=False).ids + [1]
        want[key, len(ids)] = ids
    seen = {}
    for r in sorted(got, key=lambda r: (r.doc_id or 0, r.sequence_id)):
        ids = want[r.doc_id, r.doc_tokens][r.start : r.start + r.length]
        data = np.array(ids, dtype="<u4").tobytes()
        assert bytes(r.ids) == data and r.ids_crc32 == zlib.crc32(data) and r.offset == 0
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    length = {key: n for key, n in want}
    assert seen == {1: 1, 2: 1, 3: 2 * length[3], None: length[None], 5: length[5]}
    assert packing.decompose(docs.limit(0), WORDS).count() == 0
    with pytest.raises(ValueError):
        packing.decompose(docs, WORDS, longest=1000)
