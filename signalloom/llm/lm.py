"""LM scoring by a hashed maximum-entropy model with class-factored softmax.

Every word belongs to one of `CLASSES` * `CLASSES` leaves: the most frequent words and
the end mark have a leaf of their own, all others share leaves by their last letters.
The model multiplies P(class | context), P(leaf | class, context) and P(word | leaf).
The first two are softmaxes whose weights are found by hashing features of the context:
the word before (bigram), the one before that (skip) and, for the class, the pair of both
(trigram); frequent words enter by identity, others by their ending. P(word | leaf) is
(c + 1) / (n + v + 1), with the leaf's training words and distinct words.

Training makes `rounds` passes, each over another share of the documents, so all are
used once: every task takes gradient steps on its documents from the common weights,
and the tasks' changes, in small blocks, are averaged by a grouped sum. Counts cover
all training documents. Words are 64-bit hashes. The `KNOWN` most frequent words go to
the tasks with their counts, a fixed bound; occurrences of all others are joined with
the counts by shuffle, so nothing grows with the vocabulary.

Defined results: a null or empty text is the end mark alone. Without training
documents every word is unknown and all leaves are equally likely. Repeated rows are
scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.common import cut, slices

CLASSES = 16
#: Leaves of single words (the end mark is the first), words that enter contexts by identity, words whose counts the tasks hold.
SINGLE, NAMED, KNOWN = 128, 8192, 1 << 18
SHARED = CLASSES * CLASSES - SINGLE
#: Rows of hashed weights of the two softmaxes, words of a gradient step, weights of a block.
ROWS1, ROWS2, STEP, BLOCK = 1 << 15, (1 << 16) - CLASSES, 1 << 14, 1 << 13
#: Features of the leaf given its class; the class has the trigram as well.
LEAF_FEATURES = 2
RATE = 0.25
#: Parts into which the tasks' changes are summed before the last sum.
TREE = 64
#: Bytes of text that a task works on at a time.
SLICE = 4 << 20
#: Words of a training task, about.
TASK = 6_000_000
END = b" "  # no word holds a space


def words(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case, then the end mark."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def _hashes(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and shared leaf of words."""
    from xxhash import xxh3_64_intdigest

    h = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found)).view(np.int64)
    ending = np.fromiter((xxh3_64_intdigest(w[-3:]) % SHARED for w in found), np.int64, len(found))
    return h, ending


def _index(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Numbers of all words of the texts, words per text, and the distinct words."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    sizes, out = [], []
    for t in texts:
        found = words(t)
        sizes.append(len(found))
        out.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
    return np.concatenate(out) if out else np.zeros(0, np.int32), np.asarray(sizes, np.int64), list(number)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE):
        found: Counter = Counter()
        for t in batch.column("text").to_pylist():
            found.update(words(t))
        h, ending = _hashes(list(found))
        yield pa.record_batch({"h": pa.array(h), "ending": pa.array(ending, pa.int32()), "n": pa.array(list(found.values()), pa.int64())})


@dataclass
class Vocabulary:
    """Known words (hashes in order, counts, leaf, name in contexts) and sums over all words."""

    h: np.ndarray
    n: np.ndarray
    leaf: np.ndarray
    named: np.ndarray
    leaf_total: np.ndarray
    train_tokens: int
    distinct: int

    def look_up(self, h: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count (-1: not held here), leaf and context name of words."""
        at = np.minimum(np.searchsorted(self.h, h), max(0, len(self.h) - 1))
        here = self.h[at] == h if len(self.h) else np.zeros(len(h), bool)
        shared = SINGLE + ending
        if not len(self.h):
            return np.full(len(h), -1), shared, ending
        named = here & self.named[at]
        return np.where(here, self.n[at], -1), np.where(here & (self.leaf[at] >= 0), self.leaf[at], shared), np.where(named, h, ending)


def count_words(docs: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """All training words with their counts (h, ending, n), as a table, and what the tasks hold of them."""
    counts = docs.select("text").mapInArrow(_count, "h long, ending int, n long").groupBy("h").agg(F.sum("n").alias("n"), F.first("ending").alias("ending"))
    counts = cut(counts, "words")
    end = int(_hashes([END])[0][0])
    # Words per step of the logarithm of their count, some thousand rows, tell which steps hold KNOWN words.
    step = F.floor(F.log2("n") * 64)
    steps = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("v")).orderBy(F.desc("step")).collect()
    held, least = 0, 1 << 30
    for r in steps:
        held += r["v"]
        if held > KNOWN:
            break
        least = r["step"]
    # At most KNOWN rows of 20 bytes, and the end mark.
    top = counts.where((step >= least) | (F.col("h") == end)).toArrow()
    h, n, ending = (top.column(c).to_numpy() for c in ("h", "n", "ending"))
    order = np.lexsort((h, -n, h != end))
    h, n, ending = h[order], n[order], ending[order]
    rank = np.arange(len(h))
    leaf = np.where(rank < SINGLE, rank, -1)
    total = np.zeros(CLASSES * CLASSES)
    for r in counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():  # SHARED rows
        alone = (ending == r["ending"]) & (leaf >= 0)
        total[SINGLE + r["ending"]] = r["n"] + r["v"] - n[alone].sum() - alone.sum()
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    order = np.argsort(h)
    return counts, Vocabulary(h[order], n[order], leaf[order], rank[order] < NAMED, np.log10(total + 1), int(tokens), int(distinct))


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def contexts(name: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of the features of each word's context, a column per feature; texts do not reach into each other."""
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(len(name)) - starts
    before = []
    for k in (1, 2):
        x = np.full(len(name), -k, np.int64)
        x[k:] = name[:-k]
        before.append(np.where(place >= k, x, -k))
    one, two = before
    with np.errstate(over="ignore"):
        return np.stack([_mix(one, 1), _mix(two, 2), _mix(one, 4) ^ (_mix(two, 5) >> np.uint64(7))], axis=1)


class Weights:
    """Weights of both softmaxes; the last row of each is the bias."""

    def __init__(self, first: np.ndarray | None = None, second: np.ndarray | None = None):
        self.first = np.zeros((ROWS1 + 1, CLASSES), np.float32) if first is None else first
        self.second = np.zeros((ROWS2 + CLASSES, CLASSES), np.float32) if second is None else second

    @staticmethod
    def rows(features: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the first softmax and, given the true class, of the second."""
        top = (leaf // CLASSES).astype(np.uint64)
        one = (features >> np.uint64(40)).astype(np.int64) % ROWS1
        with np.errstate(over="ignore"):
            two = (((features[:, :LEAF_FEATURES] ^ (top[:, None] + np.uint64(1)) * np.uint64(0x94D049BB133111EB)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % ROWS2
        n = len(leaf)  # rows are 16-bit numbers, which sort fastest
        return np.hstack([one, np.full((n, 1), ROWS1)]).astype(np.uint16), np.hstack([two, ROWS2 + top.astype(np.int64)[:, None]]).astype(np.uint16)

    @staticmethod
    def softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
        sums = weights.take(rows[:, 0], axis=0)
        for k in range(1, rows.shape[1]):
            sums += weights.take(rows[:, k], axis=0)
        np.clip(sums, -60, 60, out=sums)
        np.exp(sums, out=sums)
        sums /= (sums @ np.ones(CLASSES, np.float32))[:, None]
        return sums

    def log10(self, features: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        out = np.empty(len(leaf))
        for at in range(0, len(leaf), STEP):
            f, y = features[at : at + STEP], leaf[at : at + STEP]
            each = np.arange(len(y))
            one, two = self.rows(f, y)
            p = self.softmax(self.first, one)[each, y // CLASSES].astype(np.float64) * self.softmax(self.second, two)[each, y % CLASSES]
            out[at : at + STEP] = np.log10(np.maximum(p, 1e-30))
        return out

    def learn(self, features: np.ndarray, leaf: np.ndarray, squares: list[np.ndarray]) -> None:
        """One adaptive gradient step on some words."""
        each = np.arange(len(leaf))
        one, two = self.rows(features, leaf)
        for k, (weights, rows, aim) in enumerate(((self.first, one, leaf // CLASSES), (self.second, two, leaf % CLASSES))):
            error = self.softmax(weights, rows)
            error[each, aim] -= 1
            flat = rows.ravel()
            order = np.argsort(flat, kind="stable")
            flat = flat[order]
            first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
            used = flat[first]
            gradient = np.add.reduceat(error.take(order // rows.shape[1], axis=0), first, axis=0)
            squares[k][used] += gradient**2
            weights[used] -= RATE * gradient / np.sqrt(squares[k][used] + 1e-6)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.first.ravel(), self.second.ravel()])

    @classmethod
    def of(cls, flat: np.ndarray) -> Weights:
        n = (ROWS1 + 1) * CLASSES
        return cls(flat[:n].reshape(-1, CLASSES), flat[n:].reshape(-1, CLASSES))


def _learner(start: np.ndarray, known: Vocabulary):
    def learn(batches):
        model = Weights.of(start.copy())
        squares = [np.zeros_like(model.first), np.zeros_like(model.second)]
        seen = 0
        for batch in slices(batches, "text", SLICE):
            ids, sizes, found = _index(batch.column("text").to_pylist())
            _, leaf, name = known.look_up(*_hashes(found))
            features = contexts(name[ids], sizes)
            leaves = leaf[ids]
            step = max(256, min(STEP, len(ids) // 8))  # some steps for few words too
            for at in range(0, len(ids), step):
                model.learn(features[at : at + step], leaves[at : at + step], squares)
            seen += len(ids)
        if seen:
            from pyspark import TaskContext

            change = (model.flat() - start) * np.float32(seen)
            parts = [change[at : at + BLOCK].tobytes() for at in range(0, len(change), BLOCK)]
            part = TaskContext.get().partitionId() % TREE
            yield pa.record_batch({"block": pa.array(range(len(parts)), pa.int32()), "part": pa.array([part] * len(parts), pa.int32()),
                                   "words": pa.array([seen] * len(parts), pa.int64()), "change": pa.array(parts, pa.binary())})

    return learn


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per block, of which there is a fixed number; `change` is a sum over `words` words."""
    total: dict[int, np.ndarray] = {}
    weight: Counter = Counter()
    for batch in batches:
        for block, seen, change in zip(batch.column("block").to_pylist(), batch.column("words").to_pylist(), batch.column("change").to_pylist(), strict=True):
            x = np.frombuffer(change, np.float32)
            total[block] = total[block] + x if block in total else x.copy()
            weight[block] += seen
    for block, x in total.items():
        yield pa.record_batch({"block": pa.array([block], pa.int32()), "part": pa.array([0], pa.int32()), "words": pa.array([weight[block]], pa.int64()), "change": pa.array([x.tobytes()], pa.binary())})


def train(docs: DataFrame, known: Vocabulary, rounds: int = 3) -> Weights:
    """Weights from all rows of `docs` (text)."""
    # Each task hands on weights of one size, so small partitions are read together.
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, known.train_tokens // TASK)
    flat = Weights().flat()
    share = F.pmod(F.xxhash64("text"), F.lit(rounds))
    for k in range(rounds):
        form = "block int, part int, words long, change binary"
        changes = docs.where(share == k).select("text").coalesce(tasks).mapInArrow(_learner(flat, known), form)
        sums = changes.repartition("block", "part").mapInArrow(_sum, form).repartition("block").mapInArrow(_sum, form)
        # As many rows as blocks, together the size of the weights.
        blocks = sums.toArrow().sort_by("block")
        if blocks.num_rows:
            flat = flat + np.frombuffer(b"".join(blocks.column("change").to_pylist()), np.float32) / np.float32(blocks.column("words")[0].as_py())
    return Weights.of(flat)


def _scorer(model: np.ndarray, known: Vocabulary, kept: list[str]):
    def score(batches):
        from pyspark import TaskContext

        weights, row = Weights.of(model), TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text", SLICE):
            ids, sizes, found = _index(batch.column("text").to_pylist())
            h, ending = _hashes(found)
            n, leaf, name = known.look_up(h, ending)
            starts = np.cumsum(sizes) - sizes
            total = lambda x: np.add.reduceat(x[ids], starts)
            log_n = np.where(n >= 0, np.log10(np.maximum(n, 0) + 1.0), 0.0)
            leaves = leaf[ids]
            by_leaf = weights.log10(contexts(name[ids], sizes), leaves) - known.leaf_total[leaves]
            rare = np.flatnonzero(n[ids] < 0)
            owner = np.repeat(np.arange(len(sizes)), sizes)[rare]
            pair = owner * len(found) + ids[rare]
            pair, times = np.unique(pair, return_counts=True)
            offsets = np.searchsorted(pair, np.arange(len(sizes) + 1) * len(found))
            yield pa.RecordBatch.from_arrays([
                pa.array(row + np.arange(len(sizes))), *[batch.column(c) for c in kept], pa.array(sizes), pa.array(total(n >= 0).astype(np.int64)),
                pa.array(total(log_n)), pa.array(total(np.where(leaf < SINGLE, 0.0, log_n)) + np.add.reduceat(by_leaf, starts)),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(h[pair % len(found)])),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(times.astype(np.int32))),
            ], ["row", *kept, "n_tokens", "known", "log_known", "model", "rare", "times"])
            row += len(sizes)

    return score


def score(docs: DataFrame, kept: list[str], counts: DataFrame, known: Vocabulary, model: Weights) -> DataFrame:
    """The columns `kept` of `docs` (with text), n_tokens, n_known, train_tokens, base_score and score."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    scored = docs.select(*kept, "text").mapInArrow(
        _scorer(model.flat(), known, kept), f"row long, {types}, n_tokens long, known long, log_known double, model double, rare array<long>, times array<int>")
    scored = cut(scored, "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x")["rare"].alias("h"), F.col("x")["times"].alias("times"))
    met = rare.join(counts.select("h", "n"), "h").groupBy("row").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("log_rare"))
    log_rare = F.coalesce("log_rare", F.lit(0.0))
    size = float(np.log10(known.train_tokens + known.distinct + 1.0))
    return scored.drop("rare", "times").join(met, "row", "left").select(
        *kept, "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(known.train_tokens).cast("long").alias("train_tokens"),
        (F.col("log_known") + log_rare - F.col("n_tokens") * F.lit(size)).alias("base_score"), (F.col("model") + log_rare).alias("score"))
