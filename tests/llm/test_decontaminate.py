"""Occurrences within the budget against a plain edit distance."""

import random

from signalloom.llm import decontaminate as d

TYPES = "doc_id long, text string, found string, item_ids int"


def _fewest(passage, text):
    """Fewest edits between the passage and any substring of the text, by the textbook table."""
    row = list(range(len(passage) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(passage, 1):
            new.append(min(row[i - 1] + (x != c), row[i] + 1, new[i - 1] + 1))
        row, best = new, min(best, new[-1])
    return best


def _brute(items, text):
    clean, out = d.normalise(text), {}
    for item, t in items:
        t = d.normalise(t)
        if item is None or not t:
            continue
        if len(t) < d.LEAST:
            if f" {t} " in f" {clean} ":
                out[item] = 0
            continue
        for p in d.passages(t):
            n = _fewest(p, clean)
            if n <= d.budget(p):
                out[item] = min(n, out.get(item, n))
    return out


def _edit(r, text, n):
    chars = list(text)
    for _ in range(n):
        i = r.randrange(len(chars))
        kind = r.randrange(3)
        if kind == 0:
            chars[i] = r.choice("abcde")
        elif kind == 1:
            chars.insert(i, r.choice("abcde"))
        elif len(chars) > 1:
            del chars[i]
    return "".join(chars)


def _case(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(60)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, say(r.choice([5, 9, 20, 45, 90]))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "short"), (None, say(30)), (23, items[0][1]), (24, "a" * 200)]
    docs = []
    for k in range(60):
        text = say(r.randint(0, 60))
        if k % 2:
            item = d.normalise(r.choice(items[:12])[1])
            cut = item if k % 4 == 1 else item[: max(40, len(item) * 2 // 3)]
            text += ".\n" + _edit(r, cut, r.randint(0, len(cut) // 12 + 1)).upper() + "! " + say(5)
        docs.append((k, text, "clash", 1))
    docs += [(100, None, "", 1), (101, "", "", 1), (102, "a" * 5000, "", 1), (102, "a" * 5000, "", 1), (103, items[3][1] + " " + items[3][1], "", 1)]
    return items, docs


def test_distance():
    r = random.Random(5)
    for _ in range(200):
        p, t = ("".join(r.choice("ab c") for _ in range(r.randint(lo, 80))) for lo in (1, 0))
        assert d.Pattern(p).distance(t) == _fewest(p, t)


def test_against_brute_force(spark, frame):
    items, docs = _case(1)
    for blocks in (1 << 20, 400):
        got = d.find(frame(docs, TYPES), spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string"), block_chars=blocks).collect()
        assert len(got) == len(docs) and got[0]["found"] in ("clash", "")
        for row in got:
            want = _brute(items, row["text"])
            assert row["item_ids"] == sorted(want) and row["n_matches"] == len(want)
            assert row["distances"] == [want[i] for i in sorted(want)]
            assert row["distance"] == (min(want.values()) if want else None)
    assert sum(bool(row["n_matches"]) for row in got) > 15


def test_pieces_cover_a_passage():
    for n in (32, 47, 160):
        p = "".join(chr(97 + i % 26) for i in range(n))
        assert "".join(t for _, t in d.pieces(p)) == p and len(d.pieces(p)) == d.budget(p) + 1
    for n in (80, 133, 333, 900):
        long = "".join(chr(97 + i % 26) for i in range(n))
        size = min(d.PASSAGE, max(d.SHORTEST, n // 2 * 3 // 5))
        assert d.passages(long)[-1] == long[-size:] and all(len(p) == size for p in d.passages(long))
    assert d.passages("a" * 79) == ["a" * 79]


def test_every_half_of_an_item_is_found():
    r = random.Random(11)
    for n in (20, 31, 47, 79, 80, 81, 97, 131, 133, 160, 199, 240, 333, 430):
        item = d.normalise("".join(r.choice("abcdefgh  ") for _ in range(2 * n)))[:n].strip()
        known = d.Benchmark([(1, item)])
        assert known.matches(f"before {item} after") == {1: 0}
        size = len(item) if len(item) < 2 * d.SHORTEST else (len(item) + 1) // 2
        for start in range(0, len(item) - size + 1):
            assert known.matches(f"zz {item[start:start + size]} zz").get(1, 99) <= 1, (n, start)


def test_short_items_stand_between_word_borders():
    known = d.Benchmark([(1, "What is the capital of France?"), (2, "yes"), (3, "!!")])
    assert known.matches("Q: what is the CAPITAL of France") == {1: 0}
    assert known.matches("what is the capital of frances") == {} and known.matches("eyes yes") == {2: 0}
    assert known.matches("yes") == {2: 0} and known.matches("yesterday") == {} and known.matches("") == {}


def test_empty(spark, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_matches"] for r in d.find(frame([(1, "some text", "", 1)], TYPES), none).collect()] == [0]
    assert d.find(frame([], TYPES), none).count() == 0
