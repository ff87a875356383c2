import math
import random
import re
from collections import Counter

from matchloom.llm import search as S


def terms(text):
    plain = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", plain)


def brute(docs, queries, top):
    cut = [(id, terms(text)) for id, text in docs]
    n_docs, n_words = sum(bool(t) for _, t in cut), sum(len(t) for _, t in cut)
    df = Counter(w for _, t in cut for w in set(t))
    out = []
    for item, text in queries:
        scored = []
        for id, t in cut:
            counts, score = Counter(t), 0
            for w in set(terms(text)) & set(t):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                m = 100 - 50 + (50 * len(t) * n_docs) // n_words
                score += weight * ((1_000_000_000 * counts[w]) // (1000 * counts[w] + 20 * m))
            if score > 0:
                scored.append((-score, id is None, id or 0, id))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def run(spark, docs, queries, top=S.TOP):
    df, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    return sorted(tuple(r) for r in S.ranked_search(df, asked, top=top).collect())


def corpus(seed, n, words=400):
    rng = random.Random(seed)
    return [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % words}" for _ in range(rng.randrange(1, 60)))) for i in range(n)]


def test_equals_brute_force(spark):
    docs = corpus(1, 300) + [(1000 + i, "tie tie word") for i in range(8)]
    queries = [(i, text) for i, text in corpus(2, 40)] + [(90, "tie"), (91, "nowhere"), (92, ""), (93, None)]
    assert run(spark, docs, queries, 7) == brute(docs, queries, 7)


def test_blocks_of_queries_and_small_blocks_of_documents_change_nothing(spark, monkeypatch):
    docs, queries = corpus(3, 200), [(i, text) for i, text in corpus(4, 12)]
    whole = run(spark, docs, queries, 5)
    monkeypatch.setattr(S, "QUERIES", 5)
    monkeypatch.setattr(S, "TERMS", 60)
    monkeypatch.setattr(S, "CELLS", 500)
    assert run(spark, docs, queries, 5) == whole == brute(docs, queries, 5)


def test_graph_adds_up_every_query_and_shares_parts():
    rng = random.Random(6)
    common = [set(rng.sample(range(200), 12)) for _ in range(4)]
    queries = [frozenset(set().union(*rng.sample(common, 2)) | set(rng.sample(range(200), 5))) for _ in range(60)] + [frozenset()]
    graph = S.sharing_graph(queries)
    inside = [Counter(a) for a in graph.atoms]
    for a, b in graph.pairs:
        inside.append(inside[a] + inside[b])
    for terms_, parts in zip(queries, graph.queries):
        assert sum((inside[p] for p in parts), Counter()) == Counter(terms_)
    adds = len(graph.pairs) + sum(max(0, len(p) - 1) for p in graph.queries)
    assert adds < 0.6 * sum(max(0, len(q) - 1) for q in queries)


def test_odd_input(spark):
    docs = [(1, None), (2, ""), (3, "..."), (None, "apple pie"), (4, "Apple APPLE"), (4, "Apple APPLE"), (5, "Äpfel äpfel Straße-12"), (6, "pie " * 50_000)]
    queries = [(1, "apple"), (2, "Äpfel 12"), (3, "äpfel"), (4, "pie apple")]
    assert run(spark, docs, queries) == brute(docs, queries, 50)
    assert run(spark, [], queries) == [] and run(spark, docs, []) == [] and run(spark, [(1, None)], queries) == []
    clash = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS score", "3 AS id", "4 AS n")
    asked = spark.createDataFrame(queries, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS rank")
    assert sorted(tuple(r) for r in S.ranked_search(clash, asked).collect()) == brute(docs, queries, 50)
