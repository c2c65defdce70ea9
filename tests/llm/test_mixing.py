"""Targets against a plain resharing loop, and the rounding's promises."""

import random
from collections import defaultdict

from signalloom.llm import mixing

TYPES = "doc_id long, source string, size long, target string"


def _targets(sizes, weights=(1, 2, 3), most=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, total = {}, set(names), float(sum(sizes.values()))
    while left:
        share = {s: total * w[s] / sum(w[x] for x in left) for s in left}
        full = [s for s in left if share[s] > most * sizes[s]]
        if not full:
            return out | share
        for s in full:
            out[s] = most * sizes[s]
            total -= out[s]
            left.discard(s)
    return out


def _rows(seed, n, sources=7):
    r = random.Random(seed)
    rows = [(i, r.choice(["hot"] * 5 + [f"s{k}" for k in range(sources)] + [None]), r.choice([0, 1, 5, 40, 200, 900]), "clash") for i in range(n)]
    return rows + [(n, "tiny", 2, None), (n + 1, "zero", 0, None), (None, "s1", 30, None), (None, "s1", 30, None), (5, "s2", 10, None), (5, "s2", 10, None), (7, "s1", None, None)]


def _mixed(frame, rows, **options):
    return mixing.mix(frame(rows, TYPES), **options).collect()


def test_targets_and_rounding(frame):
    rows = _rows(1, 3000)
    got = _mixed(frame, rows)
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, s, n, _ in rows:
        size[s] += n or 0
    want = _targets(size)
    taken = defaultdict(int)
    largest = defaultdict(int)
    for r in got:
        assert r["source_size"] == size[r["source"]]
        assert abs(r["target"] - want[r["source"]]) <= 1e-6 * max(1, want[r["source"]])
        rate = want[r["source"]] / size[r["source"]] if size[r["source"]] else 0
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["taken"] <= 3 * r["size"]
        if r["size"]:
            assert int(rate + 1e-9) <= r["copies"] <= int(rate + 1 - 1e-9) or abs(r["copies"] - rate) < 1e-6
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in size:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-3
    assert abs(sum(want.values()) - sum(size.values())) < 1e-3


def test_reruns_agree_and_seeds_differ(spark, frame):
    rows = _rows(3, 400)
    one, two = (sorted(map(str, mixing.mix(spark.createDataFrame(rows, TYPES).repartition(n)).collect())) for n in (2, 7))
    assert one == two
    assert one != sorted(map(str, _mixed(frame, rows, seed=1)))


def test_expectations_hold(frame):
    rows = [(i, "ab"[i % 2], 10 + i % 3, "") for i in range(40)]
    sums = defaultdict(float)
    for seed in range(12):
        for r in _mixed(frame, rows, seed=seed):
            sums[r["doc_id"]] += r["copies"] / 12
    size = {s: sum(n for _, t, n, _ in rows if t == s) for s in "ab"}
    want = _targets(size)
    for s in "ab":
        mean = sum(v for i, v in sums.items() if "ab"[i % 2] == s) / 20
        assert abs(mean - want[s] / size[s]) < 0.1


def test_small_cases(frame):
    assert _mixed(frame, []) == []
    assert [r["taken"] for r in _mixed(frame, [(1, None, None, "")])] == [0]
    assert [(r["taken"], r["target"]) for r in _mixed(frame, [(1, "a", 9, "")])] == [(9, 9.0)]
