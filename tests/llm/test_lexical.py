import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from signalloom.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, k):
    counts = [(i, Counter(TERM.findall((t or "").translate(FOLD)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    out = []
    for item_id, text in items:
        terms = set(TERM.findall((text or "").translate(FOLD)))
        w = {t: floor(1000 * log((2 * n_docs + 2) / (2 * sum(t in c for _, c in counts) + 1))) for t in terms}
        scored = []
        for i, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(w[t] * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item_id, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


DOCS = [(1, "red fox, red dog"), (2, "Red FOX red dog"), (3, None), (4, ""), (5, "... !!"), (6, "ñu über 日本語 x1"), (7, "fox " * 5000),
        (8, "dog"), (9, "dog"), (9, "dog"), (None, "dog"), (10, "x1\x00x1_x1-fox")]
ITEMS = [(1, "Red fox!"), (2, "dog dog DOG"), (3, None), (4, "?!"), (5, "nowhere"), (None, "x1 日本語"), (2, "dog dog DOG"), (6, "fox dog ñu")]


@pytest.mark.parametrize("k", [1, 2, 10])
def test_equals_brute_force(frame, k):
    docs = frame([(*d, "a", 1) for d in DOCS], "doc_id long, text string, item_id string, rank int")
    items = frame([(*i, 7) for i in ITEMS], "item_id long, text string, doc_id int")
    expected = sorted(brute(DOCS, ITEMS, k), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    got = rows(lexical.search(docs, items, k))
    assert [r[1:] if r[0] == 2 else r for r in got] == [r[1:] if r[0] == 2 else r for r in expected]


def test_random_tables_and_blocks(frame):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)]
    share = 1 / np.arange(1, 61)
    say = lambda n: " ".join(rng.choice(words, n, p=share / share.sum()))
    docs = [(i, say(int(rng.integers(1, 60)))) for i in range(600)] + [(1000 + i, "w50 w51 w52") for i in range(300)]
    items = [(i, say(int(rng.integers(1, 80)))) for i in range(12)] + [(20, "w50 w51"), (21, " ".join(words))]
    expected = sorted(brute(docs, items, 10))
    tables = frame(docs, "doc_id long, text string", 5), frame(items, "item_id long, text string")
    assert rows(lexical.search(*tables)) == expected
    assert rows(lexical.search(*tables, block_chars=500)) == expected


def test_empty_tables(frame):
    docs, items = frame(DOCS, "doc_id long, text string"), frame(ITEMS, "item_id long, text string")
    assert lexical.search(docs.limit(0), items).collect() == []
    out = lexical.search(docs, items.limit(0))
    assert out.collect() == [] and out.columns == ["item_id", "rank", "doc_id", "score"]


def test_masks_group_equal_term_sets():
    rng = np.random.default_rng(2)
    counts = (rng.random((150, 400)) < 0.01).astype(np.int32) * 3  # more terms than a word of bits
    group, first = lexical.masks_of(counts)
    sets = [tuple(np.flatnonzero(c)) for c in counts.T]
    assert len(set(sets)) == len(first) == len(set(zip(sets, group.tolist())))
    assert [sets[i] for i in first[group]] == sets


def test_scoring_ends_once_the_bound_is_too_low():
    counts = np.zeros((2, 4000), np.int32)
    counts[0, :] = 1
    counts[:, :30] = 2
    ranking = lexical.Ranking([0, 1], np.array([10, 5000]), 10)
    scored = ranking.look(counts, np.full(4000, 100), np.arange(4000), np.ones(4000, bool))
    assert scored < 100 and ranking.ids.tolist() == list(range(10))
