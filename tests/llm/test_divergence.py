import random
import re
from collections import Counter, defaultdict

from matchloom.llm import divergence as D


def terms(text):
    plain = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", plain)


def brute(rows):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        counts[lang, source].update(terms(text))
        docs[lang].update(set(terms(text)))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        sources = [s for g, s in counts if g == lang]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        everywhere = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        p = lambda n, of: 1 + 10**9 * (n + 1) // (of + len(kept))
        f = lambda x, y: (x - y) ** 2 // y
        for s in sources:
            mine = {t: p(counts[lang, s][t], total[s]) for t in kept}
            pairs = [(-sum(f(mine[t], p(counts[lang, o][t], total[o])) for t in kept), o) for o in sources if o != s]
            language = {t: p(everywhere[t], sum(everywhere.values())) for t in kept}
            apart = [(-f(mine[t], language[t]), t) for t in kept if counts[lang, s][t] and mine[t] > language[t]]
            for part, found, top in (("pair", pairs, None), ("term", apart, 200)):
                ranked = sorted(found, key=lambda x: (x[0], x[1].encode()))[:top]
                out += [(lang, s, part, item, -v, rank) for rank, (v, item) in enumerate(ranked, 1)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    return sorted(tuple(r) for r in D.source_divergence(df).collect())


def corpus(seed, n):
    rng = random.Random(seed)
    letter = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    word = lambda skew: letter(int(rng.paretovariate(0.7)) % 900 + skew)
    rows = []
    for _ in range(n):
        source = rng.choice(["a", "b", "c", "d"])
        rows.append((" ".join(word(ord(source) % 3) for _ in range(rng.randrange(1, 80))), rng.choice(["en", "de"]), source))
    return rows


def test_equals_brute_force(spark):
    rows = corpus(1, 300) + [("solo term", "xx", "a"), (None, "xx", "b"), ("Über ÜBER über 1a2", "de", "a")] * 2
    assert run(spark, rows) == brute(rows)


def test_small_blocks_and_chunks_merge_to_the_same(spark, monkeypatch):
    rows = corpus(2, 150)
    want = brute(rows)
    monkeypatch.setattr(D, "ENTRIES", 100)
    monkeypatch.setattr(D, "CHUNK", 3)
    block = D._Block(3)
    chunks = []
    for text, lang, source in rows:
        block.add(lang, source, text)
        if block.size() >= 100:
            chunks += block.runs()
    chunks += block.runs()
    assert len(chunks) > 100
    monkeypatch.setattr(D, "MERGED", 7)
    merged, docs, seen = Counter(), Counter(), set()
    for lang, words, n, word, source, count in D._merged_terms(iter(sorted(chunks, key=lambda c: c[:3]))):
        assert words == sorted(words) and not seen & {(lang, w) for w in words}
        seen |= {(lang, w) for w in words}
        docs.update({(lang, w): int(x) for w, x in zip(words, n)})
        merged.update({(lang, words[w], s): int(c) for w, s, c in zip(word, source, count)})
    want_counts, want_docs = Counter(), Counter()
    for text, lang, source in rows:
        want_counts.update((lang.encode(), t.encode(), source) for t in terms(text))
        want_docs.update({(lang.encode(), t.encode()) for t in terms(text)})
    assert merged == want_counts and docs == want_docs
    assert run(spark, rows) == want


def test_pairs_of_many_sources_pass_through_small_sums(spark, monkeypatch):
    rows = corpus(3, 120)
    monkeypatch.setattr(D, "HELD", 1)
    assert run(spark, rows) == brute(rows)


def test_odd_input(spark):
    rows = [(None, None, None), ("", "", ""), ("One one two", None, "s"), ("one", "", None), ("ONE three", "", "s"), ("123 .", "zz", "q"), ("x " * 400_000, "en", "a"), ("x", "en", "b"), ("x", "en", "b")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    clash = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS term", "2 AS count", "3 AS n", "4 AS part")
    assert sorted(tuple(r) for r in D.source_divergence(clash).collect()) == brute(rows)
