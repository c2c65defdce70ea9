"""Ranked lexical search: the documents of highest score for every item, found by masks of the terms they hold.

A first pass writes, for every document, its number of terms and how often it holds each
term of the items; numbers over all documents (documents with terms, all terms, documents
of a term) come from that table. A second pass takes it in batches of `BATCH` documents.
For each item, the bits "document holds term" of a batch form a mask per document, and
documents of equal masks form a group. A mask's highest possible score follows from its
terms, the most occurrences and the shortest document of the batch. Groups are scored in
falling order of that bound until it lies below the k-th best score found so far by the
task, so what is left cannot be among the best. A task hands on k documents an item at
most, and a window over these gives the ranks.

Items go to the tasks in blocks of about `block_chars` characters; each block is one more
pass of the texts, so memory does not grow with the items. Nothing of the documents
reaches the driver but three sums and one count a term of a block.

Defined results: a null, empty or term-less text is in no ranking and does not count as a
document; an item without terms has no row. A null item id is answered like any other, a
null document id comes last among equal scores. Every row of `items` is answered, repeated
ones again; every row of `docs` is a document of its own, repeated ones too. Very long
texts count whole. Other columns of either table are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalloom.llm.common import cut, slices

#: Documents whose masks are grouped together.
BATCH = 4096

#: Bytes of a term as they are compared: A-Z as a-z, all other ASCII but digits as a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

_POSTINGS = "doc_id long, n long, terms array<int>, counts array<int>"
_FOUND = "item long, item_id long, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    """All terms of a text in order: runs of letters, digits and characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    """Of a term that `df` of `n_docs` documents hold."""
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values, pa.int32()))


def _count(number: dict[bytes, int]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = [terms_of(t) for t in batch.column("text").to_pylist()]
            n = np.array([len(w) for w in words], np.int64)
            ids = np.fromiter((i for w in words for i in map(number.get, w, repeat(-1))), np.int64, int(n.sum()))
            owner = np.repeat(np.arange(len(words)), n)
            held = ids >= 0
            pairs, counts = np.unique((owner[held] << 32) | ids[held], return_counts=True)
            sizes = np.bincount(pairs >> 32, minlength=len(words))
            yield pa.record_batch({"doc_id": batch.column("doc_id").cast(pa.int64()), "n": pa.array(n),
                                   "terms": _lists(sizes, pairs & 0xFFFFFFFF), "counts": _lists(sizes, counts)})

    return count


def postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms with repeats), terms (places in `vocabulary` of those held) and counts (of each), for every row of `docs`."""
    number = {t: i for i, t in enumerate(vocabulary)}
    return docs.select("doc_id", "text").mapInArrow(_count(number), _POSTINGS)


def masks_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of each document by the mask of terms it holds, and one document of each group; `counts`: terms x documents."""
    bits = np.packbits(counts > 0, axis=0)
    bits = np.concatenate([bits, np.zeros((-len(bits) % 8, bits.shape[1]), np.uint8)])
    words = np.ascontiguousarray(bits.T).view(np.uint64)
    group = np.zeros(len(words), np.int64)
    for k in range(words.shape[1]):
        values, inner = np.unique(words[:, k], return_inverse=True)
        _, first, group = np.unique(group * len(values) + inner, return_index=True, return_inverse=True)
    return group, first


class Ranking:
    """The k best documents of one item so far."""

    def __init__(self, terms: list[int], weights: np.ndarray, k: int):
        self.terms, self.weights, self.k = terms, weights, k
        self.scores, self.ids, self.known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """A score below this is not among the best."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        """`known`: false where the document has no id."""
        good = scores > 0
        scores, ids, known = (np.concatenate([a, b[good]]) for a, b in ((self.scores, scores), (self.ids, ids), (self.known, known)))
        best = np.lexsort((ids, ~known, -scores))[: self.k]
        self.scores, self.ids, self.known = scores[best], ids[best], known[best]

    def look(self, counts: np.ndarray, m: np.ndarray, ids: np.ndarray, known: np.ndarray) -> int:
        """Takes a batch (`counts`: terms x documents); returns how many documents were scored."""
        group, first = masks_of(counts)
        most = counts.max(axis=1).astype(np.int64)
        highest = self.weights * (1_000_000_000 * most // (1000 * most + 8 * int(m.min())))
        bound = highest @ (counts[:, first] > 0)
        falling = np.argsort(-bound, kind="stable")
        members = np.argsort(group, kind="stable")
        starts = np.append(0, np.cumsum(np.bincount(group, minlength=len(first))))
        at, scored, step = 0, 0, self.k  # documents scored between two looks at the bound, twice as many each time
        while at < len(falling) and bound[falling[at]] >= self.least():
            chosen, size = [], 0
            while at < len(falling) and size < step and bound[falling[at]] >= self.least():
                chosen.append(members[starts[falling[at]] : starts[falling[at] + 1]])
                size, at = size + len(chosen[-1]), at + 1
            docs = np.concatenate(chosen)
            tf = counts[:, docs].astype(np.int64)
            self.add(self.weights @ (1_000_000_000 * tf // (1000 * tf + 8 * m[docs])), ids[docs], known[docs])
            scored, step = scored + len(docs), 2 * step
        return scored


def _rank(items: list[tuple[int, int | None, list[int]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rankings = [Ranking(terms, weights[terms], k) for _, _, terms in items]
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                sizes = pa.compute.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(batch.num_rows), sizes)
                terms, tf = (batch.column(c).flatten().to_numpy() for c in ("terms", "counts"))
                order = np.argsort(terms, kind="stable")
                owner, tf = owner[order], tf[order]
                starts = np.searchsorted(terms[order], np.arange(len(weights) + 1))
                known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                ids = batch.column("doc_id").fill_null(0).to_numpy()
                m = np.array([10 + 90 * n * n_docs // max(1, n_terms) for n in batch.column("n").to_pylist()], np.int64)
                for (_, _, held), ranking in zip(items, rankings, strict=True):
                    counts = np.zeros((len(held), batch.num_rows), np.int32)
                    for row, t in enumerate(held):
                        part = slice(starts[t], starts[t + 1])
                        counts[row, owner[part]] = tf[part]
                    ranking.look(counts, m, ids, known)
        for (number, item_id, _), r in zip(items, rankings, strict=True):
            if len(r.scores):
                yield pa.record_batch({
                    "item": pa.array([number] * len(r.scores), pa.int64()), "item_id": pa.array([item_id] * len(r.scores), pa.int64()),
                    "doc_id": pa.array(r.ids, mask=~r.known), "score": pa.array(r.scores)})

    return rank


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_chars: int = 200_000) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the `k` documents of highest score for each row of `items` (item_id, text).

    `docs`: doc_id, text. Only scores above 0 count; equal ones rank by id.
    """
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks, found = max(1, ceil(chars / block_chars)), None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # about block_chars characters
        wanted = [(r["item_id"], sorted(set(terms_of(r["text"])))) for r in rows]
        vocabulary = sorted({t for _, terms in wanted for t in terms})
        if not vocabulary:
            continue
        number = {t: i for i, t in enumerate(vocabulary)}
        held = cut(postings(docs, vocabulary), "postings")
        n_docs, n_terms = held.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = dict(held.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # one row a term of the block
        weights = np.array([weight(n_docs, df.get(i, 0)) for i in range(len(vocabulary))], np.int64)
        numbered = [((b << 32) + i, item_id, [number[t] for t in terms]) for i, (item_id, terms) in enumerate(wanted) if terms]
        part = held.where(F.size("terms") > 0).mapInArrow(_rank(numbered, weights, n_docs, n_terms, k), _FOUND)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], _FOUND)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
