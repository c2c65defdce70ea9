"""Base scores against counting, the model as a distribution, and its gain on held-out text."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from signalloom.llm import lm

TYPES = "doc_id long, text string, score string, n_tokens int"


def _rows(seed=1):
    r = random.Random(seed)
    nouns, verbs, others = ([f"{k}{i}" for i in range(20)] for k in ("noun", "verb", "rare"))
    rows = []
    for i in range(300):
        said = []
        for _ in range(r.randint(0, 30)):
            said += ["the", r.choice(nouns), r.choice(verbs), *([r.choice(others) + str(r.randrange(500))] if r.random() < 0.1 else [])]
        rows.append((i, " ".join(said).upper() if i % 3 else "\t".join(said), "clash", 1))
    return rows + [(400, None, "", 0), (401, "", "", 0), (402, "é É x \x0b y", "", 0), (402, "é É x \x0b y", "", 0), (None, "the noun1", "", 0), (403, "w" * 100_000, "", 0)]


def _fit(frame, rows, monkeypatch, known=40):
    monkeypatch.setattr(lm, "KNOWN", known)
    training = frame([r for r in rows if r[0] is None or r[0] % 5], TYPES)
    counts, vocabulary = lm.count_words(training)
    model = lm.train(training, vocabulary, rounds=2)
    got = lm.score(frame(rows, TYPES), ["doc_id"], counts, vocabulary, model).collect()
    return vocabulary, model, got


@pytest.mark.parametrize("known", [40, 1 << 18])
def test_base_score(frame, monkeypatch, known):
    rows = _rows()
    _, _, got = _fit(frame, rows, monkeypatch, known)
    counted = Counter(w for i, t, *_ in rows if i is None or i % 5 for w in lm.words(t))
    n, v = sum(counted.values()), len(counted)
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for g in got:
        found = lm.words(texts[g["doc_id"]])
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(found), sum(counted[w] > 0 for w in found), n)
        assert abs(g["base_score"] - sum(math.log10((counted[w] + 1) / (n + v + 1)) for w in found)) < 1e-6
        assert g["score"] < 0
    held = [g for g in got if g["doc_id"] is not None and g["doc_id"] % 5 == 0]
    assert sum(g["score"] for g in held) > 0.8 * sum(g["base_score"] for g in held)  # less than 0: nearer to 0 is likelier


def test_probabilities_sum_to_one(frame, monkeypatch):
    vocabulary, model, _ = _fit(frame, _rows(), monkeypatch)
    features = lm.contexts(np.array([5, 7, 9, 11]), np.array([4]))
    total = np.zeros(4)
    for leaf in range(lm.CLASSES**2):
        total += 10 ** model.log10(features, np.full(4, leaf))
    assert np.allclose(total, 1, atol=1e-4)


def test_contexts_stay_in_their_text():
    name = np.array([1, 2, 3, 4, 5, 2, 3, 4, 5])
    f = lm.contexts(name, np.array([5, 4]))
    g = lm.contexts(name[5:], np.array([4]))
    assert (f[5:] == g).all() and len(lm.contexts(name[:0], np.array([], int))) == 0


def test_scores_by_hand(frame, monkeypatch):
    """A text's score is the sum over its words of leaf and word probabilities."""
    rows = _rows()
    vocabulary, model, got = _fit(frame, rows, monkeypatch)
    counted = Counter(w for i, t, *_ in rows if i is None or i % 5 for w in lm.words(t))
    text = rows[10][1]
    found = lm.words(text)
    h, ending = lm._hashes(found)
    _, leaf, name = vocabulary.look_up(h, ending)
    want = model.log10(lm.contexts(name, np.array([len(found)])), leaf).sum()
    for w, y in zip(found, leaf, strict=True):
        if y >= lm.SINGLE:
            want += math.log10(counted[w] + 1) - vocabulary.leaf_total[y]
    assert abs(want - next(g["score"] for g in got if g["doc_id"] == 10)) < 1e-6


def test_nothing_to_learn(frame):
    none = frame([], TYPES)
    counts, vocabulary = lm.count_words(none)
    model = lm.train(none, vocabulary)
    got = lm.score(frame([(1, "a b", "", 0), (2, None, "", 0)], TYPES), ["doc_id"], counts, vocabulary, model).collect()
    assert sorted((g["doc_id"], g["n_tokens"], g["n_known"], g["train_tokens"], g["base_score"]) for g in got) == [(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)]
    assert lm.score(none, ["doc_id"], counts, vocabulary, model).count() == 0
