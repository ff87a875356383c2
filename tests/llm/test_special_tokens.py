import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from matchloom.llm import queries, tokenization

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "nine <|endoftext|> words", "<|startoftext|>glued<|endoftext|>", "a  b <|endoftext|>\n c", "plain words\nhere", None, "",
    "<|ENDOFTEXT|> <|endoftext", "end <|endoftext|>",
]


def test_ids_of_the_unmodified_library():
    rng = random.Random(3)
    parts = ["<|endoftext|>", "<|startoftext|>", " ", "\n", "  ", "word", "É", "<|", "|>", "\x1c"]
    for path in (WORDS, BYTES):
        library, encoder = Tokenizer.from_file(path), tokenization.ChunkEncoder(path, literal=False)
        for text in [*filter(None, TEXTS), *("".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(1500))]:
            assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_queries_and_pipeline_keep_the_library_default(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    def want(path, end):
        library = Tokenizer.from_file(path)
        return {i: [*library.encode(t or "", add_special_tokens=False).ids, end] for i, t in enumerate(TEXTS)}

    crc = lambda ids: zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    ids, at = want(BYTES, 0), 0
    for r in sorted(queries.QUERIES["op8_elias_fano_tokens"](spark, str(tmp_path)).collect(), key=lambda r: r.doc_id):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]), crc(ids[r.doc_id]))
        at += r.n_tokens
    ids = want(WORDS, 1)
    packed = queries.QUERIES["op9_binary_packing"](spark, str(tmp_path)).collect()
    packed += corpus_pipeline.binary_packing(spark, docs, str(tmp_path)).collect()
    assert len({r.doc_id for r in packed}) == len(TEXTS)
    for r in packed:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length])
