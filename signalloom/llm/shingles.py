"""Word shingles as sorted 64-bit hashes, and minimum hashes of them, in numpy batches."""

from __future__ import annotations

import numpy as np

_A = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A[3]
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, each text's in rising order, and how many each text has.

    A-Z count as a-z; words stand between ASCII spaces. A text of fewer than `size`
    words is one shingle, a text without words has none.
    """
    from xxhash import xxh3_64_intdigest

    number: dict[bytes, int] = {}
    ids, counts = [], []
    for t in texts:
        found = t.encode("utf-8", "surrogatepass").lower().split() if t else []
        counts.append(len(found))
        ids += [number.setdefault(w, len(number)) for w in found]
    h = np.fromiter(map(xxh3_64_intdigest, number), np.uint64, len(number))[np.asarray(ids, np.int64)] if ids else np.zeros(0, np.uint64)
    counts = np.asarray(counts, np.int64)
    starts = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(starts + counts, counts) - np.arange(len(h))  # words from here to the text's end
    with np.errstate(over="ignore"):
        value = np.zeros(len(h), np.uint64)
        for k in range(size):
            ahead = np.zeros(len(h), np.uint64)
            ahead[: len(h) - k] = h[k:]
            value = mix(value * _A[0] + np.where(left > k, ahead, np.uint64(0)) + np.uint64(k + 1))
        # Full shingles, or the start of a text that is shorter than one, told apart by its length.
        short = np.repeat((counts < size) & (counts > 0), counts)
        value = np.where(short, mix(value + np.repeat(counts, counts).astype(np.uint64) * _A[1]), value)
    first = np.arange(len(h)) == np.repeat(starts, counts)
    keep = (left >= size) | (short & first)
    value, owner = value[keep], owner[keep]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.bincount(owner, minlength=len(counts)).astype(np.int64)


def min_hashes(value: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """`n` minimum hashes of every set, 0 for empty sets."""
    out = np.zeros((len(counts), n), np.uint32)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    starts = (np.cumsum(counts) - counts)[full]
    odd = np.random.default_rng(7).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(n):
            out[full, k] = np.minimum.reduceat((value * odd[k]) >> np.uint64(32), starts).astype(np.uint32)
    return out
