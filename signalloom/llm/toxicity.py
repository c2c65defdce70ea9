"""Toxicity by a support vector machine over a gap-weighted subsequence string kernel.

The kernel of two words sums, over all common subsequences of `ORDER` letters, a decay
per letter that their spans take in both words, divided by the words' own kernels; a
letter put between (or left out) costs one decay and keeps the rest. So that strange
letters do not weigh by their number, a word's own kernel with a landmark is the mean
(geometric) of two: letters that the landmark has not are left out in one, and like no
other letter in the other. Marks inside words
are dropped, and letters that stand alone one after the other are one word. A word's
start counts as a letter. A word enters as the `POWER`-th power of its kernel with each
landmark word (0 below `FLOOR`), a sentence as the largest value per landmark, whitened
by the landmarks' own kernel matrix (Nyström). A linear machine separates toxic
sentences from others; a document's value is that of its most toxic sentence, put on a
0 to 1 scale by a logistic curve.

Learning: labels are of documents. Landmarks are the words that most tell toxic
documents of the sample from others, none too like another. A toxic document gives its
sentence that is nearest to the landmarks, a clean one its nearest three, so the machine
learns from the hardest clean sentences; each landmark with a letter put in is a toxic
sentence more. The sample is bounded: `most_docs` labelled
documents of each class, smallest hash of the id first, of at most `most_bytes` each.
Scores use texts alone and cover whole texts; words longer than `SPAN` letters enter in
overlapping pieces.

Defined results: null and empty texts have no word near a landmark and get the score
of a document without any; a document may have several or contradicting label rows, the
larger label counts; null labels are none. Without labels of both classes, or without
words that tell them apart, the score is 0.4999, so nothing is predicted. Repeated rows
score alike; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm.common import cut, slices

ORDER, DECAY, FLOOR, POWER = 3, 0.9, 0.4, 3
#: Share of a landmark's neighbouring letters that a word must have, and least plain kernel with it, to be looked at further.
NEEDED, CLOSE = 0.6, 0.03
#: Letters of a word, or of a piece of a longer one; words of a sentence at most.
SPAN, SENTENCE = 24, 32
LANDMARKS = 96
#: Landmarks with a letter put in, as sentences to learn from, per toxic sentence.
ALTERED = 1.0
#: Letters put between all letters of a landmark to learn from.
STRANGE = "xqzjkvwyxqzjkvwyxqzjkvwy"
#: Distinct words whose kernels a task keeps.
CACHE = 300_000

_DECAYS = np.tril(DECAY ** np.clip(np.subtract.outer(np.arange(SPAN), np.arange(SPAN)) - 1, 0, None), -1).astype(np.float32)
#: Stands before the first letter of each word, so that word beginnings count as letters do.
START = "^"
_MARKS = re.compile(r"[\W_]+")


def letters(word: str) -> str:
    """Letters and digits of the word, in lower case; marks put between letters are gone."""
    plain = word.lower() if word.isalnum() else _MARKS.sub("", word.lower())
    return START + plain if plain else plain


def pieces(word: str) -> list[str]:
    return [word] if len(word) <= SPAN else [word[i : i + SPAN] for i in range(0, len(word) - SPAN // 2, SPAN // 2)]


def codes(words: list[str]) -> np.ndarray:
    """Code points, one row a word, 0 behind its end."""
    out = np.zeros((len(words), SPAN), np.uint32)
    for row, w in zip(out, words, strict=True):
        row[: len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), "<u4")
    return out


def kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Subsequence kernel of each row of `s` with the same row of `t`."""
    met = ((s[:, :, None] == t[:, None, :]) & (s[:, :, None] > 0)).astype(np.float32) * np.float32(DECAY**2)
    left, right = _DECAYS[: s.shape[1], : s.shape[1]], _DECAYS[: t.shape[1], : t.shape[1]].T
    now = met
    for _ in range(ORDER - 1):
        now = met * (left @ now @ right)
    return now.sum(axis=(1, 2))


def _pairs(c: np.ndarray, reach: int) -> np.ndarray:
    """Marks of the pairs of letters at most `reach` places apart, 128 bits a word."""
    out = np.zeros((len(c), 2), np.uint64)
    for apart in range(1, reach + 1):
        a, b = c[:, :-apart], c[:, apart:]
        bit = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) >> np.uint32(25)
        marks = np.where(b > 0, np.uint64(1) << (bit & np.uint32(63)).astype(np.uint64), np.uint64(0))
        for half in (0, 1):
            out[:, half] |= np.bitwise_or.reduce(np.where(bit >> np.uint32(6) == half, marks, np.uint64(0)), axis=1)
    return out


def _kernels(s: np.ndarray, t: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Kernel of row at[i] of `s` with row to[i] of `t`, in blocks no wider than their words."""
    out = np.zeros(len(at), np.float32)
    wide, high = (((x > 0) * np.arange(1, x.shape[1] + 1)).max(axis=1) for x in (s, t))
    size = (np.maximum(wide[at], 1) + 3) // 4 * 8 + (np.maximum(high[to], 1) + 3) // 4
    for kind in np.unique(size):
        where = np.flatnonzero(size == kind)
        rows, columns = int(kind) // 8 * 4, int(kind) % 8 * 4
        for i in range(0, len(where), 8192):
            part = where[i : i + 8192]
            out[part] = kernel(s[at[part], :rows], t[to[part], :columns])
    return out


def _own(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Own kernel (its root) of each row of `s` as its row of `t` sees it: strange letters left out, and all different."""
    strange = (s > 0) & ~(s[:, :, None] == t[:, None, :]).any(axis=2)
    alone = np.where(strange, np.uint32(0x110000) + np.arange(s.shape[1], dtype=np.uint32), s)
    out = np.where(strange, np.uint32(0), s)
    every = np.arange(len(s))
    # The rest of a word stays in its place, so the gaps count in its own kernel too.
    return np.sqrt(np.sqrt(_kernels(out, out, every, every) * _kernels(alone, alone, every, every)))


@dataclass
class Landmarks:
    words: list[str]

    def __post_init__(self):
        self.codes = codes([letters(w) for w in self.words])
        self.own = np.sqrt(kernel(self.codes, self.codes))
        self.pairs = _pairs(self.codes, 1)
        # A word that has too few of a landmark's pairs, with up to two letters between, counts as 0.
        self.needed = np.maximum(2, np.ceil(NEEDED * np.bitwise_count(self.pairs).sum(axis=1))).astype(np.uint8)

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word number, landmark number and kernel of all pairs at `FLOOR` or above."""
        found = []
        for start in range(0, len(words), 4096):
            owner, parts = [], []
            for n, w in enumerate(words[start : start + 4096], start):
                for p in pieces(w):
                    owner.append(n)
                    parts.append(p)
            c = codes(parts)
            pairs = _pairs(c, 3)
            shared = sum(np.bitwise_count(pairs[:, None, half] & self.pairs[None, :, half]) for half in (0, 1)) >= self.needed[None, :]
            w, z = np.nonzero(shared)
            if not len(w):
                continue
            used, back = np.unique(w, return_inverse=True)
            own = np.sqrt(_kernels(c, c, used, used))[back]
            value = _kernels(c, self.codes, w, z)
            value /= np.maximum(own * self.own[z], 1e-12)
            close = value >= CLOSE
            w, z, value, own = w[close], z[close], value[close], own[close]
            # Seen by the landmark, a word with strange letters is nearer than by its plain kernel.
            value *= own / np.maximum(_own(c[w], self.codes[z]), 1e-12)
            keep = value >= FLOOR
            found.append((np.asarray(owner)[w[keep]], z[keep], value[keep] ** POWER))
        if not found:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class _Words:
    """Kernels of the words seen, a bounded number of them; `near` per word is None or a row of values."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks, self.number, self.rows, self.ends = landmarks, {}, [], []

    def numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        new = list(dict.fromkeys(t for toks in texts for t in toks if t not in self.number))
        if len(self.number) + len(new) > CACHE and self.number:
            self.number, self.rows, self.ends = {}, [], []
            new = list(dict.fromkeys(t for toks in texts for t in toks))
        base = len(self.rows)
        self.rows += [None] * len(new)
        self.ends += [t[-1] in ".!?|;" for t in new]
        self.number.update(zip(new, range(base, base + len(new)), strict=True))
        for w, z, v in zip(*self.landmarks.near([letters(t) for t in new]), strict=True):
            if self.rows[base + w] is None:
                self.rows[base + w] = np.zeros(len(self.landmarks.words), np.float32)
            self.rows[base + w][z] = max(self.rows[base + w][z], v)
        self.has = np.array([r is not None for r in self.rows], bool)
        self.end = np.array(self.ends, bool)
        return [np.fromiter(map(self.number.__getitem__, toks), np.int64, len(toks)) for toks in texts]

    def sentences(self, ids: np.ndarray) -> np.ndarray:
        """A row for each sentence that has a word near a landmark."""
        at = np.flatnonzero(self.has[ids])
        if not len(at):
            return np.zeros((0, len(self.landmarks.words)), np.float32)
        ends = np.concatenate([[0], np.cumsum(self.end[ids])[:-1]])
        first = np.searchsorted(ends, ends, "left")  # of the word's sentence
        key = ends * (len(ids) + 1) + (np.arange(len(ids)) - first) // SENTENCE
        _, start = np.unique(key[at], return_index=True)
        return np.maximum.reduceat(np.stack([self.rows[i] for i in ids[at]]), start, axis=0)


def tokens(text: str | None) -> list[str]:
    """Words between spaces; single letters in a row are one word."""
    found = (text or "").lower().split()
    if not any(len(t) == 1 for t in found):
        return found
    out, run = [], []
    for t in [*found, "  "]:
        if len(t) == 1 and t.isalnum():
            run.append(t)
            continue
        if run:
            out += ["".join(run)] if len(run) > 2 else run
            run = []
        out.append(t)
    return out[:-1]


@dataclass
class Model:
    """Landmarks, machine and curve; `landmarks` None where there was nothing to learn from."""

    landmarks: list[str] | None
    weights: np.ndarray | None = None
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def values(self, rows: np.ndarray) -> np.ndarray:
        return rows @ self.weights + self.bias

    def score(self, sentences: np.ndarray) -> float:
        if self.landmarks is None:
            return 0.4999
        best = max(self.bias, float(self.values(sentences).max()) if len(sentences) else self.bias)
        return float(1 / (1 + np.exp(-np.clip(self.slope * best + self.shift, -30, 30))))


def _labels(labels: DataFrame) -> DataFrame:
    return labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))


def _sample(docs: DataFrame, per: DataFrame, n: dict[int, int], most_docs: int, most_bytes: int) -> DataFrame:
    """Texts and labels of the sample; what is chosen are ids, so that only the sample's texts move.

    `n` documents of each class: a range of hashes that holds about twice the wanted number is ordered, no more.
    """
    known = docs.where("text IS NOT NULL").where(F.octet_length("text") <= most_bytes)
    ids = known.select("doc_id").distinct().join(per, "doc_id").withColumn("h", F.xxhash64("doc_id"))
    parts = []
    for y in (1, 0):
        share = min(1.0, 2 * most_docs / max(1, n.get(y, 0)))
        mine = ids.where((F.col("toxic") == y) & (F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))))
        parts.append(mine.orderBy("h").limit(most_docs))
    chosen = cut(parts[0].unionByName(parts[1]), "toxic-ids")  # at most 2 * most_docs rows, so fit to broadcast
    return known.join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def _choose_landmarks(spark: SparkSession, sample: DataFrame) -> list[str]:
    """Words by how much they tell the classes apart (log-likelihood ratio), each unlike those before it."""
    words = sample.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("w")).where((F.length("w") >= ORDER) & (F.length("w") < SPAN))
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return []
    counts = words.groupBy("w").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    pa_, pb = (F.col("a") + 0.5) / (n[1] + 1), (F.col("b") + 0.5) / (n[0] + 1)
    counts = counts.withColumn("gain", F.col("a") * F.log(pa_ / pb))
    telling = [r["w"] for r in counts.where((pa_ > 2 * pb) & (F.col("gain") >= 8)).orderBy(F.desc("gain"), "w").limit(12 * LANDMARKS).collect()]
    chosen: list[str] = []
    for w in telling:
        if chosen:
            c, others = codes([letters(w)] * len(chosen)), codes([letters(x) for x in chosen])
            own = np.sqrt(kernel(c[:1], c[:1]) * kernel(others, others))
            if (kernel(c, others) / np.maximum(own, 1e-12)).max() > 0.8:
                continue
        chosen.append(w)
        if len(chosen) == LANDMARKS:
            break
    return chosen


def _nearest(landmarks: list[str]):
    def nearest(batches):
        known = _Words(Landmarks(landmarks))
        for batch in slices(batches, "text"):
            labels, rows, first = [], [], []
            for toxic, ids in zip(batch.column("toxic").to_pylist(), known.numbers([tokens(t) for t in batch.column("text").to_pylist()]), strict=True):
                found = known.sentences(ids)
                best = np.argsort(-found.max(axis=1), kind="stable")[: 1 if toxic else 3] if len(found) else []
                for r in [found[i] for i in best] or [np.zeros(len(landmarks), np.float32)]:
                    labels.append(toxic)
                    rows.append(r.tobytes())
                first += [True] + [False] * (max(1, len(best)) - 1)
            yield pa.record_batch({"toxic": pa.array(labels, pa.int32()), "row": pa.array(rows, pa.binary()), "first": pa.array(first, pa.bool_())})

    return nearest


def _whitening(landmarks: list[str]) -> np.ndarray:
    c = codes([letters(w) for w in landmarks])
    n = len(landmarks)
    i, j = np.divmod(np.arange(n * n), n)
    own = np.sqrt(kernel(c, c))
    gram = ((kernel(c[i], c[j]) / np.maximum(own[i] * own[j], 1e-12)) ** POWER).reshape(n, n)
    value, vector = np.linalg.eigh(gram.astype(np.float64))
    value = np.maximum(value, 0.05)
    return vector @ np.diag(value**-0.5) @ vector.T


def _altered(landmarks: list[str], toxic: int) -> np.ndarray:
    """Sentences of one landmark each, with a strange letter or one of its own put in, and with strange letters between all."""
    variants = [w[:m] + c + w[m:] for w in landmarks for m, c in ((len(w) // 2, "x"), (max(1, len(w) // 3), w[max(1, len(w) // 3) - 1]), (len(w) // 2, "qj"))]
    variants += ["".join(a + b for a, b in zip(w, STRANGE, strict=False)) for w in landmarks]
    rows = np.zeros((len(variants), len(landmarks)), np.float32)
    for n, z, value in zip(*Landmarks(landmarks).near([letters(v) for v in variants]), strict=True):
        rows[n, z] = max(rows[n, z], value)
    return np.tile(rows, (max(1, round(ALTERED * toxic / len(variants))), 1))


def _fit_machine(x: np.ndarray, y: np.ndarray, rounds: int = 400, cost: float = 1e-4) -> tuple[np.ndarray, float]:
    """Squared-hinge machine, classes weighing alike, by accelerated gradient steps."""
    sign = np.where(y > 0, 1.0, -1.0)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    x1 = np.hstack([x, np.ones((len(x), 1))])
    step = 1 / (2 * np.linalg.norm(x1 * np.sqrt(share)[:, None], 2) ** 2 + cost)
    w = back = np.zeros(x1.shape[1])
    for k in range(rounds):
        slack = np.maximum(0, 1 - sign * (x1 @ back))
        new = back - step * (-2 * x1.T @ (share * sign * slack) + cost * np.append(back[:-1], 0))
        back, w = new + k / (k + 3) * (new - w), new
    return w[:-1], float(w[-1])


def _fit_curve(value: np.ndarray, y: np.ndarray, of_toxic: float) -> tuple[float, float]:
    """Logistic curve through the machine's values, by Newton steps, at a share `of_toxic` toxic documents; its slope is positive."""
    share = np.where(y > 0, of_toxic / max(1, (y > 0).sum()), (1 - of_toxic) / max(1, (y == 0).sum()))
    x, beta = np.stack([value, np.ones_like(value)], axis=1), np.array([1.0, 0.0])
    aim = np.where(y > 0, 0.99, 0.01)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta = beta - np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2), x.T @ (share * (p - aim)) + 1e-4 * beta)
    return max(0.5, float(beta[0])), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, most_docs: int = 6000, most_bytes: int = 1 << 16) -> Model:
    """Learn from `docs` (doc_id, text) and `labels` (doc_id, toxic)."""
    spark = docs.sparkSession
    per = _labels(labels)
    n = {r["toxic"]: r["n"] for r in per.join(docs.select("doc_id"), "doc_id").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = cut(_sample(docs, per, n, most_docs, most_bytes), "toxic-sample")
    landmarks = _choose_landmarks(spark, sample)
    if len(landmarks) < 2:
        return Model(None)
    # At most 4 rows of a few hundred bytes for each document of the bounded sample.
    near = sample.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(_nearest(landmarks), "toxic int, row binary, first boolean").toPandas()
    y = near["toxic"].to_numpy()
    if len(set(y)) < 2:
        return Model(None)
    rows = np.frombuffer(b"".join(near["row"]), np.float32).reshape(len(near), -1)
    first = near["first"].to_numpy()
    white = _whitening(landmarks)
    more = _altered(landmarks, int((y > 0).sum()))
    weights, bias = _fit_machine(np.vstack([rows, more]) @ white, np.append(y, np.ones(len(more), y.dtype)))
    model = Model(landmarks, (white @ weights).astype(np.float64), bias)
    model.slope, model.shift = _fit_curve(np.maximum(model.values(rows), bias)[first], y[first], n[1] / (n[0] + n[1]))
    return model


def _scorer(model: Model):
    def score(batches):
        known = _Words(Landmarks(model.landmarks)) if model.landmarks is not None else None
        for batch in slices(batches, "text", 2 << 20):
            texts = [tokens(t) for t in batch.column("text").to_pylist()]
            empty = np.zeros((0, 1), np.float32)
            rows = [empty] * len(texts) if known is None else map(known.sentences, known.numbers(texts))
            values = pa.array([model.score(r) for r in rows], pa.float64())
            yield pa.RecordBatch.from_arrays([*[c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "text"], values], [*[n for n in batch.schema.names if n != "text"], "score"])

    return score


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every column of `docs` but text, and score."""
    kept = docs.drop("text").schema.add("score", "double")
    return docs.mapInArrow(_scorer(model), kept)
