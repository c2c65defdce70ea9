"""Language ID: every document is a mixture of languages.

Training counts hashed byte n-grams (1 to 4 bytes of lower-cased text in which all but
letters is one space) per language over all labelled documents. For a document,
expectation-maximisation finds the proportions under which its n-grams are likeliest.
The set of languages is chosen by penalised likelihood: starting from the single best
language, the language that raises the likelihood most is added while the gain beats
log(n-grams) / 2 per language (n-grams overlap, so likelihoods count 1 / `OVERLAP`).
The answer is the language with the largest proportion, the score its proportion times
its posterior probability against the other single languages.

Defined results: null texts and texts without a letter are `und` with score 0. Null
languages teach nothing; without any labelled document everything is `und`, score 0.
Documents of a language that all are empty teach nothing about it. Equal proportions:
the smaller code point wins. Repeated rows are answered alike; other columns stay,
whatever their names, but for `lang_pred`, `score` and `mixture`, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalloom.llm.common import slices

BUCKETS = 1 << 16
OVERLAP = 4.0
#: Steps of expectation-maximisation; proportions below `LEAST` are as good as none.
STEPS, LEAST = 12, 0.02
UND = "und"

_OTHER = re.compile(r"[\W\d_]+")


def normalise(text: str | None) -> bytes:
    """Lower case, runs of anything but letters as one space; empty if there is no letter."""
    words = _OTHER.sub(" ", text or "").strip().lower()
    return f" {words} ".encode("utf-8", "surrogatepass") if any(map(str.isalpha, words)) else b""


def grams(data: bytes) -> np.ndarray:
    """Hashes of all runs of 1 to 4 bytes."""
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    out, h = [], np.zeros(len(x), np.uint32)
    for n in range(1, 5):
        if len(x) < n:
            break
        h = (h[: len(x) - n + 1] * np.uint32(0x01000193)) ^ (x[n - 1 :] + np.uint32(n << 8))
        mixed = h * np.uint32(0x9E3779B1)
        out.append((mixed >> np.uint32(16)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in slices(batches, "text"):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = np.bincount(grams(normalise(text)), minlength=BUCKETS)
            if lang in sums:
                sums[lang] += found
            elif found.any():
                sums[lang] = found
        while len(sums) > 64:  # hands on what it has, so that odd language codes do not fill memory
            yield _counted(*sums.popitem())
    for lang, n in sums.items():
        yield _counted(lang, n)


def _counted(lang: str, n: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(n)
    return pa.record_batch({"lang": pa.array([lang] * len(at), pa.string()), "gram": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})


class Model:
    """Languages in code point order and log-likelihoods, a row for each n-gram bucket."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        total = counts.sum(axis=0, keepdims=True)
        every = (counts.sum(axis=1, keepdims=True) + 0.5) / (counts.sum() + 0.5 * BUCKETS)
        weight = 500.0  # n-grams' worth of all languages together, against sparse counts
        self.p = ((counts + weight * every) / (total + weight)).astype(np.float64)

    def mixture(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        data = normalise(text)
        if not data or not self.langs:
            return UND, 0.0, {}
        n = np.bincount(grams(data), minlength=BUCKETS)
        gram = np.flatnonzero(n)
        p, n = self.p[gram], n[gram] / OVERLAP
        single = n @ np.log(p)
        chosen, best = [int(np.argmax(single))], float(single.max())
        share = np.ones(1)
        posterior = float(1 / np.exp(np.clip(single - best, -700, 0)).sum())
        price = 0.5 * np.log(max(2.0, n.sum()))
        while len(chosen) < len(self.langs):
            mixed = p[:, chosen] @ share
            slope = (n / mixed) @ p / n.sum()  # above 1: a little of that language raises the likelihood
            slope[chosen] = 0
            new = int(np.argmax(slope))
            if slope[new] <= 1 + LEAST:
                break
            tried = [*chosen, new]
            shares, value = self._proportions(p[:, tried], n)
            if value - best <= price or shares.min() < LEAST:
                break
            chosen, share, best = tried, shares, value
        order = sorted(range(len(chosen)), key=lambda k: (-share[k], chosen[k]))
        top = order[0]
        return self.langs[chosen[top]], float(share[top] * (posterior if len(chosen) == 1 else 1.0)), {self.langs[chosen[k]]: float(share[k]) for k in order}

    @staticmethod
    def _proportions(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        share = np.full(p.shape[1], 1 / p.shape[1])
        for _ in range(STEPS):
            joint = p * share
            share = (n / joint.sum(axis=1)) @ joint / n.sum()
        return share, float(n @ np.log(p @ share))


def fit(docs: DataFrame) -> Model:
    """Learn from all rows of `docs` (text, lang); the table has a row per language and bucket at most."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text")
    counted = known.mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # A row per language: its buckets as two arrays.
    rows = sorted(counted.groupBy("lang").agg(F.collect_list("gram").alias("gram"), F.collect_list("n").alias("n")).toArrow().to_pylist(), key=lambda r: r["lang"])
    table = np.zeros((BUCKETS, len(rows)))
    for k, r in enumerate(rows):
        table[np.asarray(r["gram"], int), k] = r["n"]
    return Model([r["lang"] for r in rows], table)


def _predictor(model: Model, text: str):
    def predict(batches):
        for batch in slices(batches, text):
            found = [model.mixture(t) for t in batch.column(text).to_pylist()]
            added = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                     pa.array([list(f[2].items()) for f in found], pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "lang_pred", "score", "mixture"])

    return predict


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with lang_pred, score and mixture (language to proportion)."""
    docs = docs.drop("lang_pred", "score", "mixture")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("mixture", T.MapType(T.StringType(), T.DoubleType()))])
    return docs.mapInArrow(_predictor(model, text), schema)
