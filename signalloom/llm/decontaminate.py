"""Benchmark decontamination: test passages in documents, up to a budget of errors.

Items and documents are compared as words of letters and digits, in lower case, with
one space between. An item of at least twice `SHORTEST` characters is cut into passages,
the last one ending with the item, whose length and distance follow from its own length:
any half of its characters holds a whole passage, so every half of an item is found. A
shorter item is one passage, and one of fewer than `LEAST` characters counts only where it
stands unchanged between word borders. A passage of m characters may differ by
k = m // `PER_ERROR` inserted, deleted or replaced characters. Cut into k + 1 pieces, one piece must occur unchanged
(pigeonhole); all pieces are looked up in one pass of the text, and around each hit
Myers' bit-parallel distance decides whether the passage occurs within its budget.
The search is exact: every occurrence within the budget is found.

Documents stay where they are and never meet each other. Items go to the tasks in
blocks of `block_chars` characters, so memory does not grow with the benchmark; each
block is one more pass of the texts.

Defined results: null and empty texts hold nothing; null items, and items without a
letter or digit, are in no document; equal items are all reported, null item ids are not. Repeated documents are answered alike. Other
columns stay, but for `item_ids`, `distances`, `n_matches` and `distance`, which are replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalloom.llm.common import slices

#: Most and fewest characters of a passage of a longer item, characters that each allow one error, and of the shortest item that may differ.
PASSAGE, SHORTEST, PER_ERROR, LEAST = 160, 40, 16, 32

_OTHER = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def passages(item: str) -> list[str]:
    """Passages of an item such that half of its characters, taken anywhere, hold one of them."""
    half = len(item) // 2
    if half < SHORTEST:
        return [item]
    size = min(PASSAGE, max(SHORTEST, half * 3 // 5))
    starts = range(0, len(item) - size, half - size + 1)
    return [item[s : s + size] for s in [*starts, len(item) - size]]


def budget(passage: str) -> int:
    return len(passage) // PER_ERROR


def pieces(passage: str) -> list[tuple[int, str]]:
    """Offset and text of budget + 1 pieces of nearly equal length."""
    n = budget(passage) + 1
    edges = [len(passage) * i // n for i in range(n + 1)]
    return [(a, passage[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


class Pattern:
    """Myers' bit vectors of a passage."""

    def __init__(self, text: str):
        self.n, self.bits = len(text), defaultdict(int)
        for i, c in enumerate(text):
            self.bits[c] |= 1 << i

    def distance(self, text: str) -> int:
        """Fewest edits between the passage and any substring of `text`."""
        full, top = (1 << self.n) - 1, 1 << (self.n - 1)
        plus, minus, score, best, bits = full, 0, self.n, self.n, self.bits
        for c in text:
            met = bits[c] if c in bits else 0
            diagonal = (((met & plus) + plus) ^ plus) | met | minus
            up = minus | ~(diagonal | plus) & full
            down = plus & diagonal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                if score < best:
                    best = score
            up = (up << 1) & full  # an occurrence may begin anywhere
            down = (down << 1) & full
            plus = down | (~(diagonal | up) & full)
            minus = up & diagonal
        return best


class Benchmark:
    """Passages of items and the search for their pieces."""

    def __init__(self, items: list[tuple[int, str | None]]):
        import ahocorasick

        self.owners: list[list[int]] = []
        self.texts: list[str] = []
        number: dict[str, int] = {}
        where: dict[str, list] = defaultdict(list)
        for item_id, text in sorted(items, key=lambda x: x[0]):
            clean = normalise(text)
            if not clean:
                continue
            for p in passages(clean):
                if p not in number:
                    number[p] = len(self.texts)
                    self.texts.append(p)
                    self.owners.append([])
                    for offset, piece in pieces(p) if len(p) >= LEAST else [(0, p)]:
                        where[piece].append((number[p], offset))
                if item_id not in self.owners[number[p]]:
                    self.owners[number[p]].append(item_id)
        self.search = ahocorasick.Automaton()
        for piece, found in where.items():
            self.search.add_word(piece, (len(piece), found))
        if where:
            self.search.make_automaton()
        self.patterns: dict[int, Pattern] = {}

    def matches(self, text: str | None) -> dict[int, int]:
        """Item to the fewest errors with which one of its passages occurs in `text`."""
        clean = normalise(text)
        best: dict[int, int] = {}
        if not self.texts or not clean:
            return {}
        done: dict[int, int] = {}  # passage: where the text verified for it ends
        for end, (size, found) in self.search.iter(clean):
            for number, offset in found:
                if best.get(number) == 0:
                    continue
                passage = self.texts[number]
                if len(passage) < LEAST:
                    before, after = end - size, end + 1
                    if (before < 0 or clean[before] == " ") and (after == len(clean) or clean[after] == " "):
                        best[number] = 0
                    continue
                k = budget(passage)
                start = end - size + 1 - offset - k
                stop = start + len(passage) + 2 * k
                # What was verified before needs no second look where the new window lies within it.
                if number in done and done[number][0] <= start and stop <= done[number][1]:
                    continue
                start, stop = max(0, start), stop
                if number not in self.patterns:
                    self.patterns[number] = Pattern(passage)
                distance = self.patterns[number].distance(clean[start:stop])
                done[number] = (start if start else -len(clean) - len(passage), stop)
                if distance <= k and distance < best.get(number, k + 1):
                    best[number] = distance
        out: dict[int, int] = {}
        for number, distance in best.items():
            for item in self.owners[number]:
                out[item] = min(distance, out.get(item, distance))
        return out


def _finder(items: list[tuple[int, str | None]], text: str, add: bool):
    def find(batches):
        known = Benchmark(items)
        for batch in slices(batches, text):
            before = batch.column("found").to_pylist() if add else [None] * batch.num_rows
            found = [dict(b or ()) | known.matches(t) for b, t in zip(before, batch.column(text).to_pylist(), strict=True)]
            columns = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "found" or not add]
            made = pa.array([sorted(f.items()) for f in found], pa.map_(pa.int64(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*[c for _, c in columns], made], [*[n for n, _ in columns], "found"])

    return find


def find(docs: DataFrame, items: DataFrame, text: str = "text", block_chars: int = 4 << 20) -> DataFrame:
    """`docs` with item_ids (those found), distances (errors of each), n_matches and distance (fewest errors, null if none).

    `items`: item_id, text.
    """
    docs = docs.drop("item_ids", "distances", "n_matches", "distance")
    clash = {"found": "__found"} if "found" in docs.columns else {}
    docs = docs.withColumnsRenamed(clash)
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, ceil(chars / block_chars))
    schema = T.StructType([*docs.schema.fields, T.StructField("found", T.MapType(T.LongType(), T.IntegerType()))])
    for k in range(blocks):
        block = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()]  # about block_chars characters
        docs = docs.mapInArrow(_finder(block, text, k > 0), schema)
    ids = F.array_sort(F.map_keys("found"))
    each = F.transform(ids, lambda i: F.element_at("found", i))
    out = docs.withColumns({"item_ids": ids, "distances": each, "n_matches": F.size("found").cast("long"), "distance": F.array_min(F.map_values("found"))}).drop("found")
    return out.withColumnsRenamed({v: k for k, v in clash.items()})
