import random

import numpy as np
import pytest

from matchloom.llm import langid


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    parts = {"aa": ["tion", "the", "ing", "ou", "nd"], "bb": ["ção", "uma", "lh", "ei", "os"], "cc": ["sch", "ung", "ä", "eit", "der"]}
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(parts))
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(words), lang))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string, lang string")


def test_learns_held_out_rows(spark, docs):
    model = langid.train(docs)
    assert model.languages == ("aa", "bb", "cc")
    unseen = corpus(120, seed=9)
    right = [model.predict(t)[0] == lang for _, t, lang in unseen]
    assert np.mean(right) > 0.97
    again = langid.train(docs)
    assert np.array_equal(model.table, again.table) and model.least == again.least


def test_texts_without_letters_and_clashing_columns(spark, docs):
    model = langid.train(docs)
    odd = spark.createDataFrame(
        [(1, None, 1), (2, "", 1), (3, "12 %% 34\n", 1), (4, "the tion ing", 1), (4, "the tion ing", 1), (None, "ung sch" * 50_000, 1)],
        "doc_id long, text string, score int",
    )
    got = langid.identify(odd, model, "language").select("doc_id", "score", "language.lang", "language.score").toDF("id", "mine", "lang", "score").collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append((r.lang, r.score))
        assert r.mine == 1 and 0 <= r.score <= 1
    assert [by[i] for i in (1, 2, 3)] == [[("und", 0.0)]] * 3
    assert len(by[4]) == 2 and by[4][0][0] == "aa" and by[None][0][0] == "cc"
    assert langid.identify(odd.limit(0), model).count() == 0


def test_blocks_do_not_change_counts(monkeypatch):
    text = "Ärger über die Straße, 42 mal! " * 40
    want = langid.bag(text)
    for size in (7, 33, 100):
        monkeypatch.setattr(langid, "BLOCK", size)
        assert np.array_equal(langid.bag(text), want)


def test_no_labels_and_one_language(spark, docs):
    none = langid.train(docs.where("lang = 'zz'"))
    assert none.predict("the tion") == ("und", 0.0, False)
    one = langid.train(docs.where("lang = 'aa'"))
    assert one.predict("the tion")[:2] == ("aa", 1.0)


def test_rejection_bounds_the_error():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 2000)
    logits = rng.normal(0, 1.5, (2000, 3))
    logits[np.arange(2000), y] += 2
    temperature, least = langid.calibrate(logits, y)
    scores = langid.softmax(logits / temperature)
    accepted = scores.max(axis=1) >= least
    wrong = scores.argmax(axis=1) != y
    assert wrong[accepted].mean() <= 0.0101 < wrong.mean()
    assert 0.05 < accepted.mean() < 1
