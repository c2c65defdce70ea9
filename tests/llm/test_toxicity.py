"""Kernel against its definition, held-out accuracy, gapped and inserted letters."""

import random
from itertools import combinations

import numpy as np
import pytest

from signalloom.llm import toxicity as t

INSULTS = ["grumblewort", "snotface", "dimmelhead", "vexpail"]
TYPES = "doc_id long, text string, score string, lang string"


def _plain(s, u):
    """The kernel by listing all subsequences."""
    total = 0.0
    places = lambda w: [(c, "".join(w[i] for i in c)) for c in combinations(range(len(w)), t.ORDER)]
    for a, x in places(s):
        for b, y in places(u):
            if x == y:
                total += t.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_kernel():
    r = random.Random(1)
    words = ["".join(r.choice("abcd") for _ in range(r.randint(1, 9))) for _ in range(60)]
    one, two = words[:30], words[30:]
    got = t.kernel(t.codes(one), t.codes(two))
    assert np.allclose(got, [_plain(a, b) for a, b in zip(one, two, strict=True)], rtol=1e-5)
    every = np.arange(30)
    assert np.allclose(t._kernels(t.codes(one), t.codes(two), every, every), got, rtol=1e-5)


def test_tokens():
    assert t.tokens("you a b s o l u t e x-y a") == ["you", "absolute", "x-y", "a"]
    assert t.tokens(None) == [] and t.letters("G.r_u-m!") == "^grum" and t.letters("...") == ""
    long = "ab" * 100
    assert "".join(p[: t.SPAN // 2] for p in t.pieces(long)).startswith(long[:150])


def _docs(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(300)]
    rows = []
    for i in range(n):
        said = [r.choice(words) for _ in range(r.randint(5, 120))]
        bad = i % 4 == 0
        for _ in range(r.randint(1, 2) if bad else 0):
            said.insert(r.randrange(len(said)), r.choice(INSULTS))
        rows.append((seed * 10_000 + i, " ".join(said) + ".", bad))
    return rows


@pytest.fixture(scope="module")
def model(spark, frame):
    rows = _docs(1, 400)
    labels = [(i, int(bad), 0) for i, _, bad in rows] + [(rows[0][0], None, 0), (None, 1, 0), (rows[1][0], 0, 0), (99, 1, 0)]
    return t.fit(frame([(i, x, "clash", "") for i, x, _ in rows] + [(None, None, "", "")], TYPES), frame(labels, "doc_id long, toxic int, text int"))


def _scores(frame, model, texts):
    got = t.score(frame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string"), model).collect()
    return [r["score"] for r in sorted(got, key=lambda r: r["doc_id"])]


def test_held_out(frame, model):
    rows = _docs(2, 200)
    scores = _scores(frame, model, [x for _, x, _ in rows])
    right = sum((s >= 0.5) == bad for s, (_, _, bad) in zip(scores, rows, strict=True))
    assert right >= 194 and all(0 <= s <= 1 for s in scores)


def test_inserted_and_gapped(frame, model):
    base = "mora leti pusa "
    plain, *changed = _scores(frame, model, [base + "leti", base + "grum.ble.wort", base + "g r u m b l e w o r t", base + "grumxblewort", base + "snot_face", base + "SNOTFFACE"])
    assert plain < 0.5 and all(s > 0.5 for s in changed)


def test_odd_texts(frame, model):
    none, empty, marks, long = _scores(frame, model, [None, "", "... !!", "x" * 100_000])
    assert none == empty == marks < 0.5 and long < 0.5
    assert _scores(frame, model, ["mora " * 50_000 + "vexpail"])[0] > 0.5  # whole texts


def test_nothing_to_learn(frame):
    labels = frame([(1, 1, 0), (2, None, 0)], "doc_id long, toxic int, text int")
    model = t.fit(frame([(1, "some text", "", ""), (2, "more", "", "")], TYPES), labels)
    assert model.landmarks is None and _scores(frame, model, ["a", None]) == [0.4999, 0.4999]
    assert t.fit(frame([], TYPES), labels).landmarks is None


def _with(r, word, n):
    for _ in range(n):
        at = r.randrange(1, len(word))
        word = word[:at] + r.choice("xqzjkhy") + word[at:]
    return word


def test_letters_put_in_anywhere(model):
    """Two and three strange letters at any places, and one between all letters, leave an insult near its landmark."""
    r = random.Random(5)
    marks = t.Landmarks(model.landmarks)
    said = [i for i in INSULTS if i in model.landmarks]
    assert len(said) == len(INSULTS)
    ways = [lambda w: _with(r, w, 2), lambda w: _with(r, w, 3), lambda w: "".join(c + r.choice("xqzjkhy") for c in w), lambda w: "q".join(w)]  # a letter that no insult holds; one of its own counts as the insult does
    for way in ways:
        words = [(i, way(i)) for i in said for _ in range(50)]
        found = {(n, model.landmarks[z]) for n, z, _ in zip(*marks.near([t.letters(w) for _, w in words]), strict=True)}
        near = sum((n, i) in found for n, (i, _) in enumerate(words))
        assert near >= 0.97 * len(words), near / len(words)


def _seen(word, mark):
    """A word's value with a landmark, from listed subsequences."""
    out = "".join(c if c in mark else "\0" for c in word)
    alone = "".join(c if c in mark else chr(0xE000 + i) for i, c in enumerate(word))
    left = sum(t.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1) for a in combinations(range(len(out)), t.ORDER) for b in combinations(range(len(out)), t.ORDER)
               if "\0" not in (x := "".join(out[i] for i in a)) and x == "".join(out[i] for i in b))
    own = (left * _plain(alone, alone)) ** 0.25 * _plain(mark, mark) ** 0.5
    value = _plain(word, mark) / own if own else 0.0
    return value**t.POWER if value >= t.FLOOR else 0.0


def test_score_by_hand(frame, model):
    """Whole scores from listed subsequences, without the operator's filters."""
    texts = ["mora vexpail leti. pusa gru", "snxotfxace mora", "mora leti pusa", "dimmelhad. grumb lewort"]
    for text, got in zip(texts, _scores(frame, model, texts), strict=True):
        best = model.bias
        for sentence in text.split("."):
            rows = [[_seen(t.letters(w), t.letters(z)) for z in model.landmarks] for w in sentence.split()]
            if rows and np.max(rows) > 0:
                best = max(best, float(np.max(rows, axis=0) @ model.weights) + model.bias)
        assert abs(got - 1 / (1 + np.exp(-np.clip(model.slope * best + model.shift, -30, 30)))) < 1e-4
