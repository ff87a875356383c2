import numpy as np
import pytest

from matchloom.llm import permutation


def brute(rows, queries, k):
    out = {}
    for q, x in queries:
        near = sorted(((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q))
        out[q] = [(i, -s) for s, i in near[:k]]
    return out


def search(spark, rows, k=20, schema="vec_id long, embedding array<float>"):
    index = permutation.build_index(spark.createDataFrame(rows, schema))
    got = {}
    for r in permutation.search(index, index.where("id % 20 = 0"), k).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: [(i, s) for _, i, s in sorted(v)] for q, v in got.items()}


def vectors(n, d, seed, scale=0.0):
    x = np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True) * np.exp(scale * np.random.default_rng(7).normal(size=(n, 1))).astype(np.float32)


@pytest.mark.parametrize("scale", [0.0, 0.5])
def test_recall_over_several_shards(spark, monkeypatch, scale):
    monkeypatch.setattr(permutation, "SHARD_ROWS", 2500)
    monkeypatch.setattr(permutation, "BLOCK_ROWS", 200)
    monkeypatch.setattr(permutation, "LEAST", 20)
    x = vectors(6000, 32, 3, scale)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    got = search(spark, rows)
    d = x.astype(np.float64)
    hits = 0
    for q in range(0, 6000, 20):
        s = d @ d[q]
        s[q] = -9
        best = set(np.argsort(-s, kind="stable")[:20])
        assert len(got[q]) == 20
        hits += len(best & {i for i, _ in got[q]})
        assert all(abs(score - s[i]) < 1e-12 for i, score in got[q])
    assert hits / (300 * 20) >= 0.9


def test_small_tables_copies_and_bad_vectors(spark):
    x = [[float(v) for v in row] for row in vectors(60, 8, 5)]
    rows = list(enumerate(x)) + [(100 + i, x[3]) for i in range(45)] + [(60, x[3]), (61, x[0]), (61, x[0])]
    want = brute([r for r in {i: (i, [float(np.float32(a)) for a in v]) for i, v in rows}.values()], [(i, v) for i, v in rows if i % 20 == 0], 20)
    bad = [(200, None), (220, []), (240, [0.0] * 8), (260, [float("nan")] + [1.0] * 7), (280, [None] + [1.0] * 7), (300, [float("inf")] * 8), (320, [1.0, 2.0]), (None, x[1])]
    got = search(spark, rows + bad)
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
    assert search(spark, [(20, x[0]), (21, x[1])]) == {20: [(21, pytest.approx(sum(a * b for a, b in zip(x[0], x[1]))))]}
    assert search(spark, []) == {}
    assert search(spark, bad[:4]) == {}
