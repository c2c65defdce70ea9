"""Mixtures found by expectation-maximisation, held-out accuracy, odd texts."""

import random
from itertools import combinations

import numpy as np
import pytest

from signalloom.llm import language

WORDS = {
    "en": "the of and that with from which there have this will water house under people another",
    "de": "der die und nicht mit auf eine werden haben wasser haus unter leute andere straße schön",
    "fr": "le la et que dans pour avec une être eau maison sous gens autre très où déjà",
}
TYPES = "doc_id long, text string, lang string, score string, mixture int"


def _text(r, lang, n):
    return " ".join(r.choice(WORDS[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def model(frame):
    r = random.Random(1)
    rows = [(i, _text(r, lang, r.randint(3, 60)), lang, "clash", 1) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    rows += [(900, None, "en", "", 0), (901, "the the", None, "", 0), (902, "", "xx", "", 0)]
    return language.fit(frame(rows, TYPES))


def test_held_out(frame, model):
    assert model.langs == ["de", "en", "fr"]
    r = random.Random(2)
    rows = [(i, _text(r, lang, r.randint(2, 40)), lang, "", 1) for i, lang in enumerate(["en", "de", "fr"] * 50)]
    got = language.predict(frame(rows, TYPES), model).collect()
    assert len(got) == 150 and set(got[0].asDict()) == {"doc_id", "text", "lang", "lang_pred", "score", "mixture"}
    assert sum(g["lang"] == g["lang_pred"] for g in got) >= 148
    assert all(0 <= g["score"] <= 1 for g in got)


def test_mixture_proportions(model):
    r = random.Random(3)
    text = _text(r, "en", 300) + " " + _text(r, "de", 150)
    lang, score, shares = model.mixture(text)
    assert lang == "en" and set(shares) == {"en", "de"}
    assert abs(shares["en"] - 0.66) < 0.12 and abs(sum(shares.values()) - 1) < 1e-6 and abs(score - shares["en"]) < 1e-9
    assert set(model.mixture(_text(r, "fr", 200))[2]) == {"fr"}


def _exhaustive(model, text):
    """Languages and proportions of the best of all language sets, each by a long plain expectation-maximisation."""
    n = np.bincount(language.grams(language.normalise(text)), minlength=language.BUCKETS)
    at = np.flatnonzero(n)
    p, n = model.p[at], n[at] / language.OVERLAP
    best = None
    for size in range(1, len(model.langs) + 1):
        for some in combinations(range(len(model.langs)), size):
            share = np.full(size, 1 / size)
            for _ in range(1500):
                joint = p[:, some] * share
                share = (joint / joint.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) / n.sum()
            value = n @ np.log(p[:, some] @ share) - 0.5 * np.log(max(2.0, n.sum())) * (size - 1)
            if share.min() >= language.LEAST and (best is None or value > best[0]):
                best = value, {model.langs[k]: x for k, x in zip(some, share, strict=True)}
    return best[1]


def test_language_sets_against_all_subsets(model):
    r = random.Random(11)
    parts = [("en",), ("de",), ("fr",), ("en", "de"), ("de", "fr"), ("en", "fr"), ("en", "de", "fr")]
    for k in range(42):
        text = " ".join(_text(r, lang, r.randint(40, 160)) for lang in parts[k % len(parts)])
        lang, _, shares = model.mixture(text)
        want = _exhaustive(model, text)
        assert set(shares) == set(want), (parts[k % len(parts)], shares, want)
        assert all(abs(shares[x] - want[x]) < 0.02 for x in want) and lang == max(want, key=want.get)


def test_odd_texts(frame, model):
    texts = [None, "", " \n", "123 +-*/ 4", "___", "q", "😀😀", "the " * 50_000, "ÜBER STRAẞE", "漢字"]
    got = {g["doc_id"]: g for g in language.predict(frame([(i, t, None, "", 0) for i, t in enumerate(texts)], TYPES), model).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 3, 4, 6)] == ["und"] * 6 and all(got[i]["score"] == 0 for i in (0, 1, 2, 3, 4, 6))
    assert got[7]["lang_pred"] == "en" and got[5]["lang_pred"] != "und" and got[9]["lang_pred"] != "und"


def test_nothing_to_learn(frame):
    none = language.fit(frame([(1, None, "en", "", 0), (2, "words", None, "", 0)], TYPES))
    assert none.mixture("words") == ("und", 0.0, {})
    assert language.predict(frame([], TYPES), none).count() == 0
