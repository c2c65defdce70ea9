"""Removed bytes against a set of all windows seen so far, and the order of suffixes against sorting."""

import hashlib
import random

import numpy as np
import pytest

from signalloom.llm import suffix

TYPES = "doc_id long, text string, doc string, id int"


def _brute(rows, n=suffix.LENGTH):
    seen, out = set(), {}
    key = lambda r: (suffix.LAST if r[0] is None else r[0], suffix._digest((r[1] or "").encode()))
    for doc_id, text, *_ in sorted({r[:2] for r in rows}, key=key):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - n + 1):
            if data[p:p + n] in seen:
                gone[p:p + n] = b"\1" * n
            seen.add(data[p:p + n])
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out[doc_id, text] = (len(data), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(data, gone, strict=True) if not g)).hexdigest())
    return out


def _rows(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("aéio") + r.choice("nrst") for _ in range(r.randint(1, 4))) for _ in range(80)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = [say(r.choice([15, 25, 60])) for _ in range(8)]
    rows = []
    for k in range(160):
        parts = [say(r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(shared), say(r.randint(0, 10))]
        rows.append((k * 3 % 161, " ".join(parts), "clash", 0))
    line = "=" * 70 + "a common line of the footer"
    rows += [(200 + k, f"{say(3)} {line} {say(3)} {line}", "", 0) for k in range(40)]
    rows += [(300, None, "", 0), (301, "", "", 0), (302, "x" * 99, "", 0), (303, "x" * 99, "", 0), (304, "y" * 1000, "", 0), (305, "y" * 100, "", 0), (306, "ab" * 500, "", 0)]
    rows += [rows[0], rows[0], (rows[1][0], rows[2][1], "", 0), (None, rows[3][1], "", 0), (None, say(60), "", 0), (307, "\0" * 150 + say(40) + "\0" * 150, "", 0)]
    return rows


@pytest.mark.parametrize(("hot", "piece_bytes"), [(2000, 4 << 20), (3, 3000)])
def test_against_brute_force(spark, frame, monkeypatch, hot, piece_bytes):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "SLICE", piece_bytes)
    rows = _rows(1)
    want = _brute(rows)
    got = suffix.remove_repeats(frame(rows, TYPES)).collect()
    assert len(got) == len(rows)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], set()).add(want[r[:2]])
    for g in got:
        assert (g["n_bytes"], g["n_removed"], g["n_spans"], g["kept_sha256"]) in texts[g["doc_id"]]
        if g["kept"] is not None:
            assert hashlib.sha256(g["kept"]).hexdigest() == g["kept_sha256"]
    assert sorted((g["n_bytes"], g["n_removed"]) for g in got) == sorted(want[r[:2]][:2] for r in rows)
    assert sum(g["n_removed"] for g in got) > 10_000


def test_order_of_suffixes():
    r = random.Random(3)
    for turn in range(120):
        letters = r.choice(["ab", "a", "abcdef", "\0a"])
        text = "".join(r.choice(letters) for _ in range(r.randint(1, 500)))
        if turn % 2:
            text = (text[: r.randint(1, len(text))] * 8)[:600]
        data = np.frombuffer(text.encode(), np.uint8)
        wanted = np.array([r.random() < (0.3 if turn % 3 else 1) for _ in data])
        order = suffix.suffix_order(data, wanted)
        assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist()
        starts = [(text + "\0" * 200)[i:i + suffix.LENGTH] for i in order]
        assert starts == sorted(starts)
        common = suffix.common_prefixes(data, order)
        for k in range(1, len(order)):
            a, b = text[order[k]:], text[order[k - 1]:]
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert common[k] == min(n, suffix.LENGTH)


def test_anchors_of_equal_windows_are_equal():
    r = random.Random(4)
    text = "".join(r.choice("ab ") for _ in range(150))
    a, b = ("pre" * 20 + text).encode(), (text + "post" * 20).encode()
    found = []
    for data, shift in ((a, 60), (b, 0)):
        h, at, first, last = suffix.window_anchors(np.frombuffer(data, np.uint8), np.array([len(data)]))
        found.append({p - shift: (int(h[k]), int(at[k]) - shift) for k in range(len(h)) for p in range(first[k], last[k] + 1)})
    both = [p for p in range(len(text) - suffix.LENGTH + 1)]
    assert all(found[0][p] == found[1][p] for p in both)


def test_empty(frame):
    assert suffix.remove_repeats(frame([], TYPES)).count() == 0
    assert [r["n_removed"] for r in suffix.remove_repeats(frame([(1, None, "", 0)], TYPES)).collect()] == [0]
