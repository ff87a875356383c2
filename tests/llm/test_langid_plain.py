"""Counts and scores of language identification against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from matchloom.llm import langid as L


def plain_bag(text):
    """N-grams of 2 to 4 letters or gaps of the whole text, one at a time, hashed in 32 bits."""
    codes = [32, *[ord(c) if c.isalpha() else 32 for c in text.lower()], 32]
    if all(c == 32 for c in codes):
        return None
    counts = Counter()
    for at in range(len(codes)):
        for n in (2, 3, 4):
            gram = codes[at : at + n]
            if len(gram) < n or gram[0] == gram[1] == 32:
                continue
            value = gram[0] * 2654435761 % 2**32
            for code in gram[1:]:
                value = value * 16777619 % 2**32 ^ code * 2654435761 % 2**32
            mixed = (value ^ value >> 15) * 2246822519 % 2**32
            counts[mixed >> 18] += 1
    return counts


@pytest.mark.parametrize("block", [1 << 18, 11])
def test_bag_counts_every_ngram_once_also_over_blocks(block, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", block)
    assert L.BUCKETS == 1 << 14
    rng = random.Random(3)
    for text in ["a", "Été à Paris, 12 ans!", "  two\n\nwords ", "x" * 50, "12.7 -- !", "", "".join(rng.choice("ab Ω1ß.\n") for _ in range(300))]:
        got, want = L.bag(text), plain_bag(text)
        assert (got is None) == (want is None)
        if want is not None:
            assert {int(i): int(n) for i, n in enumerate(got) if n} == dict(want)


def test_scores_equal_an_unfolded_forward_pass():
    rng = np.random.default_rng(4)
    embedding, output, bias = rng.normal(size=(L.BUCKETS, 5)), rng.normal(size=(5, 3)), rng.normal(size=3)
    model = L.Model(("a", "b", "c"), embedding @ output, bias, temperature=1.7, least=0.4)
    for text in ("hello there, world", "Straße", "a" * 1000):
        counts = plain_bag(text)
        hidden = [sum(n * embedding[p][d] for p, n in counts.items()) / sum(counts.values()) for d in range(5)]
        logits = [sum(hidden[d] * output[d][k] for d in range(5)) + bias[k] for k in range(3)]
        powers = [math.exp(x / 1.7) for x in logits]
        best = max(range(3), key=lambda k: powers[k])
        lang, score, accepted = model.predict(text)
        assert lang == "abc"[best] and score == pytest.approx(powers[best] / sum(powers)) and accepted == (score >= 0.4)
    assert model.predict("123") == ("und", 0.0, False) and model.predict(None) == ("und", 0.0, False)
