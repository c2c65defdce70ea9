import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from signalloom.llm import alignment
from signalloom.llm.queries import TOKENIZERS

A_FILE, B_FILE = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
FIELDS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def files():
    return alignment.Tokenizers.read(A_FILE, B_FILE)


@pytest.fixture(scope="module")
def whole(files):
    """Groups of a text encoded in one go by the two libraries, or none."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    a, b = Tokenizer.from_file(A_FILE), SentencePieceProcessor(model_file=B_FILE)
    a.encode_special_tokens = True
    byte = alignment._byte_characters()
    for c in map(chr, [*range(0x250), *range(0x250, 0x20000, 37), 0x10FFFF]):
        if not "\ud800" <= c <= "\udfff":
            written = "".join(t for t, _ in ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c))
            assert bytes(byte[x] for x in written) == c.encode()

    def groups(text):
        if not text:
            return []
        x, y = a.encode(" " + text, add_special_tokens=False), b.encode(text)
        spell_a = [bytes(byte[c] for c in t) for t in x.tokens]
        spell_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        raw = (" " + text).encode()
        if b"".join(spell_a) != raw or b"".join(spell_b) != raw:
            return []
        ends_a, ends_b = np.cumsum([len(s) for s in spell_a]).tolist(), np.cumsum([len(s) for s in spell_b]).tolist()
        out, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            k, m = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            out.append((x.ids[i:k], y[j:m]))
            i, j = k, m
        return out

    return groups


def expected(docs, whole):
    linked = [(i, g, Counter((p, q) for a, b in g for p in a for q in b)) for i, g in ((i, whole(t)) for i, t in docs)]
    counts = Counter(pair for _, _, links in linked for pair in links)
    best = defaultdict(int)
    for (p, _), n in counts.items():
        best[p] = max(best[p], n)
    out = []
    for i, g, links in linked:
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(links.values()),
                    sum(n for (p, q), n in links.items() if counts[p, q] == best[p]), sum(n * counts[pair] for pair, n in links.items()),
                    sha256(said.encode()).hexdigest() if g else ""))
    return sorted(out, key=repr)


def rated(docs, files):
    aligned = alignment.align(docs, files)
    out = alignment.rate(aligned, alignment.cut(alignment.pair_counts(aligned, files.n_ids_b()), "pairs"))
    return sorted((tuple(r) for r in out.select(*FIELDS).collect()), key=repr)


BITS = ["a", "b", "the", "  ", " ", "\n", "\t", "é", "日本", "<s>", "<0x41>", "<|endoftext|>", "1234", "'s", " ", "　", "\x1c", "\x00", "!!", "ñ", "​", "😀",
        "\r\n", "ing", " ", " ", " ", "A", "word", "Tokenizer", " "]
EDGES = [(1, None), (2, ""), (3, " "), (4, "a▁b"), (5, "x  y"), (6, "same text"), (7, "same text"), (7, "same text"), (None, "same"), (8, " leading and trailing "),
         (9, "<|endoftext|> <s></s> <unk>"), (10, "z" * 5000), (11, "日本語のテキスト" * 200), (12, "\n\n \n x")]


def test_equals_whole_texts_encoded_at_once(frame, files, whole):
    rng = random.Random(5)
    docs = EDGES + [(100 + i, "".join(rng.choices(BITS, k=rng.randrange(1, 60)))) for i in range(800)]
    table = frame([(*d, 5) for d in docs], "doc_id long, text string, n_a int", 5)
    assert rated(table, files) == expected(docs, whole)


def test_few_pairs_broadcast_small_parts_and_forgotten_chunks(frame, files, whole, monkeypatch):
    rng = random.Random(6)
    docs = EDGES + [(100 + i, "".join(rng.choices(BITS, k=rng.randrange(1, 40)))) for i in range(200)]
    for name, value in (("HOT_PAIRS", 7), ("PART", 5), ("REMEMBERED", 20), ("LISTED", 6), ("PIECE", 16)):
        monkeypatch.setattr(alignment, name, value)
    assert rated(frame(docs, "doc_id long, text string", 4), files) == expected(docs, whole)


def test_empty_table(frame, files):
    assert rated(frame([(1, "x")], "doc_id long, text string").limit(0), files) == []


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 64, 10_000])
def test_merge_path(piece):
    rng = np.random.default_rng(piece)
    for n, m in ((0, 0), (5, 0), (0, 5), (50, 400), (300, 300)):
        a, b = (np.sort(rng.choice(600, k, replace=False)) for k in (n, m))
        at_a, at_b = alignment.merge_path(a, b, piece)
        work = np.diff(at_a + at_b)
        assert (work[:-1] == piece).all() and (not len(work) or work[-1] <= piece)
        merged = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
        for i, j in zip(at_a, at_b):
            assert sum(1 for _, side in merged[: i + j] if side == 0) == i
        assert alignment.common_ends(a, b, piece).tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_large_groups_are_counted_in_blocks(monkeypatch):
    monkeypatch.setattr(alignment, "LISTED", 50)
    rng = np.random.default_rng(1)
    n_a, n_b = np.array([3, 40, 1, 2]), np.array([2, 30, 1, 9])
    a, b = rng.integers(0, 6, n_a.sum()), rng.integers(0, 9, n_b.sum())
    found = Counter()
    for group, pair, n in alignment.group_pairs(a, b, n_a, n_b, 100):
        for g, p, k in zip(group.tolist(), pair.tolist(), n.tolist()):
            found[g, p] += k
    want, i, j = Counter(), 0, 0
    for g, (x, y) in enumerate(zip(n_a, n_b)):
        want.update((g, int(p) * 100 + int(q)) for p in a[i : i + x] for q in b[j : j + y])
        i, j = i + x, j + y
    assert found == want


def test_chunks_join_to_the_text():
    rng = random.Random(9)
    for _ in range(2000):
        text = "".join(rng.choices(BITS, k=rng.randrange(0, 30)))
        assert " ".join(alignment.chunks_of(text)) == text
