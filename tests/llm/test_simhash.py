import random
import re

import xxhash

from matchloom.llm import simhash
from matchloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    root = {i: i for i, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in fps:
        for j, b in fps:
            if i < j and (a ^ b).bit_count() <= 2:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in fps}


def texts(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}É" for i in range(200)] + ["The", "OF"]
    out = [None, "", " \t\n", "one", "One", "two words", "x\x0by z"]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            if rng.random() < 0.6:
                copy[rng.randrange(len(copy))] = "edited"
            out.append(rng.choice((" ", "\n")).join(copy))
    return out


def test_near_duplicates_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    want = slow_components(fps)
    assert len(got) == len(rows)
    for i, fp in fps:
        assert (got[i].fingerprint, got[i].component_id) == (f"{fp:016x}", want[i])


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 150:
        near = rng.choice(sorted(fps))
        for _ in range(rng.randint(1, 3)):
            near ^= 1 << rng.randrange(64)
        fps.add(near)
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    want = slow_components(list(enumerate(fps)))
    for limit in (1, 8, 10_000):
        monkeypatch.setattr(simhash, "PAIRED", limit)
        edges = simhash.links(spark.createDataFrame(signed, "fp long"))
        for u, v in edges.collect():
            assert ((u ^ v) & ((1 << 64) - 1)).bit_count() <= 2
        roots = {r.node: r.root for r in components(edges).collect()}
        groups, slow = {}, {}
        for i, (s,) in enumerate(signed):
            groups.setdefault(roots.get(s, s), set()).add(i)
            slow.setdefault(want[i], set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, slow.values()))


def test_blocks_and_long_texts(monkeypatch):
    text = " ".join(f"word{i % 977}" for i in range(5000))
    want = slow_fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    got = simhash.fingerprint(text)
    assert got & ((1 << 64) - 1) == want
    for n in (62, 63, 64, 65, 66, 128, 129):
        part = " ".join(f"{'x' * 20}{i}" for i in range(n))
        assert simhash.fingerprint(part) & ((1 << 64) - 1) == slow_fingerprint(part)


def test_one_per_class_keeps_columns_and_one_row(spark):
    rows = [(1, "a b c d", "u"), (1, "a b c d", "u"), (2, "a b c d", "v"), (3, "other words are here now", None), (None, "q r s t", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.one_per_class(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.fp or "") for r in got.collect()) == [(0, "z"), (1, "u"), (3, "")]
    assert simhash.one_per_class(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs.limit(0).drop("fp")).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(7, 7), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)} | {200: 200, 201: 200}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
