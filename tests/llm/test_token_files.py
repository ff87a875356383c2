import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from matchloom.llm import token_files
from matchloom.llm.token_files import EliasFano

BYTES = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 1 << 62) | st.integers(0, 300), max_size=700).map(sorted))
def test_elias_fano_round_trip(values):
    code = EliasFano.from_bytes(EliasFano.encode(np.array(values, dtype=np.uint64)).to_bytes())
    assert code.decode().tolist() == values
    for i in range(0, len(values), 41):
        assert code[i] == values[i]
        assert code.span(i, len(values) - i // 2).tolist() == values[i : len(values) - i // 2]
    with pytest.raises(IndexError):
        code[len(values)]


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000))
    assert len(EliasFano.encode(ends).to_bytes()) * 8 / len(ends) < 2.6 + np.log2(ends[-1] / len(ends))


def test_files_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "HANDED", 3000)
    library = Tokenizer.from_file(BYTES)
    rows = [(9, "nine <|endoftext|> words", 1), (-4, None, 1), (3, "", 1), (3, "three again", 1), (None, "no number", 1)]
    rows += [(100 + i, f"Text {i}\n\nwith  lines" * (i % 40), 1) for i in range(200)] + [(77, "very long text, " * 9000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(5)
    manifest = token_files.write_tokens(docs, f"file:{tmp_path}/out", BYTES)
    got = token_files.read_tokens(manifest).collect()
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    want = {}
    for number, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        want.setdefault(number, []).append(np.array(ids, dtype="<u4").tobytes())
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens * 4 == len(r.ids) and bytes(r.ids) in want[r.doc_id]
        at += r.n_tokens
    shards = manifest.orderBy("shard").collect()
    assert sum(s.n_tokens for s in shards) == at and sum(s.n_docs for s in shards) == len(rows)
    first = token_files.Shard(shards[0].path)
    for i in range(shards[0].n_docs):
        assert zlib.crc32(first.document(i).tobytes()) == zlib.crc32(bytes(got[i].ids))
    assert token_files.read_tokens(token_files.write_tokens(docs.limit(0), str(tmp_path / "none"), BYTES)).count() == 0
