"""Links and components against all pairs in double precision."""

import numpy as np

from signalloom.llm import embedding

TYPES = "vec_id long, embedding array<float>, label int, n_links string"


def _vectors(seed=0, dims=16):
    r = np.random.default_rng(seed)
    rows, n = [], 0
    for _ in range(40):
        centre = r.normal(size=dims)
        for _ in range(r.integers(1, 8)):
            noise = r.uniform(0, 0.5)
            rows.append((n, (centre + noise * r.normal(size=dims)).astype(np.float32).tolist(), 1, "clash"))
            n += 1
    same = rows[3][1]
    rows += [(n + k, same, 2, None) for k in range(30)] + [(n + 40, [x * 7 for x in same], 2, None)]
    rows += [(900, None, 1, None), (901, [], 1, None), (902, [0.0] * dims, 1, None), (903, [float("nan")] + [1.0] * (dims - 1), 1, None),
             (904, [None] + [1.0] * (dims - 1), 1, None), (905, [float("inf")] * dims, 1, None), (None, same, 1, None), (906, same[:5], 1, None), (907, same[:5], 1, None),
             (908, [1e-30] * dims, 1, None), (909, [1e30] * dims, 1, None), (910, [-0.0] * (dims - 1) + [1.0], 1, None), (911, [0.0] * (dims - 1) + [1.0], 1, None)]
    return rows


def _brute(rows, threshold):
    good = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            good[i] = x / np.linalg.norm(x)
    top = {i: i for i, *_ in rows}
    links = {i: set() for i, *_ in rows}
    for i, x in good.items():
        for j, y in good.items():
            if i < j and len(x) == len(y) and x @ y >= threshold:
                links[i].add(j)
                links[j].add(i)
    changed = True
    while changed:
        changed = False
        for i in links:
            low = min([top[i], *[top[j] for j in links[i]]], default=None) if i is not None else None
            if i is not None and low != top[i]:
                top[i], changed = low, True
    return sorted(((i, len(links[i]), top[i], True if i is None else top[i] == i) for i in links), key=str)


def test_against_all_pairs(frame):
    rows = _vectors()
    for threshold, tile, group in ((0.95, 2048, 4), (0.95, 16, 2), (0.8, 7, 1), (0.99, 50, 3)):
        got = embedding.near_duplicates(frame(rows, TYPES), threshold, tile, group).collect()
        assert sorted((tuple(r) for r in got), key=str) == _brute(rows, threshold)


def test_doubles_and_repeated_rows(frame):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 1e-9])]
    got = sorted(map(tuple, embedding.near_duplicates(frame(rows, "vec_id long, embedding array<double>")).collect()))
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]


def test_open_pairs(frame):
    """Pairs that int8 leaves open are judged once each, inside a tile and between tiles, also where rows share an id."""
    r = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x)
    rows = []
    for k in range(30):
        one = unit(r.normal(size=24))
        side = r.normal(size=24)
        side = unit(side - (side @ one) * one)
        for n, cosine in enumerate((0.9499, 0.9501, 0.955, 0.945)):
            rows.append((100 * k + 1 + n, (cosine * one + np.sqrt(1 - cosine**2) * side).tolist(), 1, None))
        rows.append((100 * k, one.tolist(), 1, None))
    for tile, group in ((2048, None), (8, 1), (8, None)):
        got = embedding.near_duplicates(frame(rows, TYPES), 0.95, tile, group).collect()
        assert sorted((tuple(x) for x in got), key=str) == _brute(rows, 0.95)
    one, side = [1.0] + [0.0] * 7, [0.95001, 0.31221] + [0.0] * 6
    got = embedding.near_duplicates(frame([(1, one, 1, None), (1, [0.0] * 7 + [1.0], 1, None), (2, side, 1, None)], TYPES)).collect()
    assert [x["n_links"] for x in got if x["vec_id"] == 2] == [1]


def test_tiles_far_apart_are_left_out():
    r = np.random.default_rng(3)
    near = lambda c: embedding._unit(c + 0.02 * r.normal(size=(40, 12)))
    a, b = embedding._unit(r.normal(size=(2, 12)))
    mid = embedding._unit((a + b)[None, :])[0]
    tiles = []
    for x, c in ((near(a), a), (near(b), b), (near(mid), mid)):
        tiles.append({"centre": c, "radius": float(np.arccos(np.clip(x @ c, -1, 1)).max()), "x": x})
    for one in tiles:
        for two in tiles:
            for threshold in (0.5, 0.8, 0.95):
                if embedding._apart(one, two, threshold):
                    assert (one["x"] @ two["x"].T).max() < threshold
    assert embedding._apart(tiles[0], tiles[1], 0.95)


def test_empty(frame):
    assert embedding.near_duplicates(frame([], TYPES)).count() == 0
    assert embedding.near_duplicates(frame([(1, None, 1, None)], TYPES)).collect()[0]["kept"]


def test_bounds_are_rigorous():
    r = np.random.default_rng(1)
    for scale in (1e-20, 1.0, 1e20):
        x = (r.normal(size=(300, 33)) * scale).astype(np.float32).astype(float)
        q, s, err = embedding._quantise(x)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        close = q * s[:, None]
        off = np.abs(close @ close.T - unit @ unit.T)
        assert (off <= (1 + err[:, None]) * err[None, :] + err[:, None] + 1e-12).all()
