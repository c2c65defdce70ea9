"""Groups against all pairs of full shingle sets, and components against a plain search."""

import random
import re

import pytest

from signalloom.llm import minhash
from signalloom.llm.components import components
from signalloom.llm.shingles import shingle_sets

TYPES = "doc_id long, text string, node string, kept int"


def _set(text, size):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < size else [tuple(words[i:i + size]) for i in range(len(words) - size + 1)])


def _rows(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    words = [word() for _ in range(400)]
    rows, n = [], 0
    for _ in range(40):
        base = [r.choice(words) for _ in range(r.randint(3, 120))]
        for _ in range(r.randint(1, 6)):
            text = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                text[r.randrange(len(text))] = word()
            rows.append((n, " ".join(text), "clash", 1))
            n += 1
    base = [r.choice(words) for _ in range(80)]
    for _ in range(60):  # a large group whose members are linked through others
        text = list(base)
        for _ in range(r.randint(0, 5)):
            text[r.randrange(len(text))] = word()
        rows.append((n, " ".join(text).upper(), "", 0))
        n += 1
    r.shuffle(rows)
    same = rows[0][1]
    return [*rows, (900, None, "", 0), (901, "", "", 0), (902, " \n", "", 0), (903, "one", "", 0), (904, "ONE", "", 0), (905, "one two", "", 0), (906, "É x", "", 0), (907, "é x", "", 0),
            (908, same, "", 0), (908, same, "", 0), (None, same, "", 0), (909, "a " * 50_000, "", 0), (910, "a " * 9, "", 0)]


def _brute(rows, size, percent):
    sets = [(i, _set(t, size)) for i, t, *_ in rows if i is not None]
    top = list(range(len(sets)))

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if sets[a][0] == sets[b][0] or (x and y and 100 * len(x & y) >= percent * len(x | y)):
                top[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(i, least.get(root(k), i))
    return {i: (len(s), least[root(k)]) for k, (i, s) in enumerate(sets)}


@pytest.mark.parametrize(("size", "region"), [(4, 8192), (5, 20)])
def test_against_all_pairs(frame, size, region):
    rows = _rows(size)
    want = _brute(rows, size, 80)
    got = minhash.near_duplicates(frame(rows, TYPES), size, 0.8, region).collect()
    assert len(got) == len(rows)
    for g in got:
        if g["doc_id"] is None:
            assert g["component_id"] is None and g["kept"]
        else:
            assert (g["n_shingles"], g["component_id"]) == want[g["doc_id"]], g
            assert g["kept"] == (g["doc_id"] == g["component_id"])


def test_shingles():
    texts = ["a b c d e", "A  b\tc d", "a b", "a", "", None, "a b c d a b c d a b c d", "é É  "]
    value, counts = shingle_sets(texts, 4)
    assert counts.tolist() == [len(_set(t, 4)) for t in texts]
    assert len(set(value.tolist())) == len(set().union(*[_set(t, 4) for t in texts]))


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1200)] + [(2000, k) for k in range(2001, 2300)] + [(5, 5), (None, 3)]
    got = {row["node"]: row["component"] for row in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    top = {}
    for a, b in edges:
        if None not in (a, b) and a != b:
            top.setdefault(a, a)
            top.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if None not in (a, b) and a != b and top[a] != top[b]:
                top[a] = top[b] = min(top[a], top[b])
                changed = True
    assert got == top
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty(frame):
    assert minhash.near_duplicates(frame([], TYPES)).count() == 0
    assert [tuple(r) for r in minhash.near_duplicates(frame([(1, None, "", 0)], TYPES)).collect()] == [(1, 0, 1, True)]


def test_many_variants_of_one_text(spark):
    """More variants than a region holds, each with hashes that no other one has: one component."""
    r = random.Random(5)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for n in range(4000):
        text = list(base)
        text[r.randrange(300)] = f"x{n}"
        rows.append((n, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    got = minhash.near_duplicates(docs, 5, 0.8, 500).groupBy("component_id").count().collect()
    assert [tuple(g) for g in got] == [(0, 4000)]


def test_no_set_leaves_a_large_region(spark):
    """Every set of a large region stays in a region of two sets or more in every tree, whatever its hashes."""
    r = random.Random(6)
    rows = []
    for n in range(600):
        hashes = [k if k % 8 < 3 or r.random() < 0.9 else 1000 + 128 * n + k for k in range(minhash.HASHES)]
        rows.append((n, b"".join(h.to_bytes(4, "little") for h in hashes)))
    for n in range(600, 900):  # equal in all hashes
        rows.append((n, b"".join((7000 + k).to_bytes(4, "little") for k in range(minhash.HASHES))))
    signed = spark.createDataFrame(rows, "node long, hashes binary").repartition(4)
    sizes: dict = {}
    for row in minhash.regions(signed, 64).collect():
        sizes.setdefault((row["tree"], row["prefix"]), set()).add(row["node"])
    paired = {(tree, n) for (tree, _), nodes in sizes.items() if len(nodes) > 1 for n in nodes}
    assert len(paired) == 900 * minhash.TREES
    assert max(map(len, sizes.values())) <= 2 * 64
