"""Secret scans: fixed patterns, and random strings told from ordinary ones by two character chains.

Base spans are the leftmost non-overlapping matches of each of `KINDS`, kept where they are
long enough. Further spans, of kind `random`, are runs of `LEAST` or more letters, digits
and `+/_-` outside of base matches whose log-likelihood ratio exceeds `MARGIN`: the
probability of every character given the one before it, in a chain learnt from random
strings over that in one learnt from ordinary words and numbers. Both chains are counts
of pairs of characters, so a model is one number for each pair, whatever it learnt from.

All work is DataFrame functions in the row of a text: no shuffle, and no Python code.
Matches come with the pieces between them, and their places from running sums of
lengths, taken in blocks, so the work for a text grows with its length and its matches.

Defined results: null texts count as empty, empty ones have no span. Very long texts are
scanned whole. Every row is answered, repeated rows alike, null ids too. A model without
samples takes all characters as equally likely in both chains and adds no span. Other
columns stay, but for `spans`, which is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = ("password", "passwd", "secret", "token", "api_?key")
_EITHER = "|".join(re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", w) for w in _WORD)
#: Kind: pattern, group that holds the secret, least characters of that group. In the order of kinds.
KINDS = {
    "assign": (rf"({_EITHER})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),  # as runs are taken whole, long ones are those of the pattern with +
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
RANDOM = "random"
#: Fewest characters of a run that the chains judge, log-likelihood ratio it must exceed, and count added to every pair.
LEAST, MARGIN, ADDED = 16, 10.0, 0.5
#: Characters of the chains.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
RUN = "[A-Za-z0-9+/_-]"
#: Base matches first, so that a run begins outside of them; the run is group 3.
_ANY = f"{KINDS['assign'][0]}|{KINDS['access'][0]}|{KINDS['hex'][0]}|({RUN}{{{LEAST},}})"
#: What a text must hold for a pattern to be tried; only saves time.
_HOLDS = {
    "assign": lambda t: (t.contains("=") | t.contains(":")) & t.rlike("(?=[PpSsTtAa])" + KINDS["assign"][0]),
    "access": lambda t: t.contains("AKIA"),
    "hex": lambda t: t.rlike("[0-9a-f]{24}"),
    RANDOM: lambda t: t.rlike(f"{RUN}{{{LEAST}}}"),
}
#: Documents that ordinary words are taken from, and random strings, at most.
SAMPLE_DOCS, SAMPLE_STRINGS = 2_000, 20_000

_SPAN = "struct<kind:string,start:int,end:int>"
_BLOCK = 256


def _placed(gaps: Column, sizes: Column) -> Column:
    """array<struct<start, end>> of matches of these sizes with these gaps before them.

    Arrays grow by copying, so running sums are taken in blocks and the blocks moved.
    """
    steps = F.zip_with(F.slice(gaps, 1, F.size(sizes)), sizes, lambda g, n: F.struct(g.alias("gap"), n.alias("n")))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(sizes) - 1) / _BLOCK)).cast("int")),
                         lambda b: F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK)))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def add(done: Column, step: Column) -> Column:
        start = done["at"] + step["gap"]
        return F.struct((start + step["n"]).alias("at"), F.array_append(done["out"], F.struct(start.alias("start"), (start + step["n"]).alias("end"))).alias("out"))

    local = F.transform(blocks, lambda b: F.aggregate(b, F.struct(F.lit(0).alias("at"), none.alias("out")), add))

    def move(done: Column, block: Column) -> Column:
        moved = F.transform(block["out"], lambda s: F.struct((s["start"] + done["at"]).alias("start"), (s["end"] + done["at"]).alias("end")))
        return F.struct((done["at"] + block["at"]).alias("at"), F.array_append(done["out"], moved).alias("out"))

    whole = F.aggregate(local, F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int>>>").alias("out")), move)
    return F.flatten(whole["out"])


def _matches(text: Column, pattern: str, kind: str, judge: Callable[[Column], Column]) -> Column:
    """Spans of the matches that the judge accepts."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spans = _placed(F.transform(F.split(text, pattern, -1), F.length), F.transform(found, F.length))
    good = F.filter(F.zip_with(spans, found, lambda s, m: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), m.alias("m"))),
                    lambda s: judge(s["m"]))
    spans = F.transform(good, lambda s: s.dropFields("m"))
    return F.when(_HOLDS[kind](text), spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _value(match: Column, kind: str) -> Column:
    """The secret in a base match."""
    pattern, group, _ = KINDS[kind]
    return F.regexp_extract(match, pattern, group) if group else match


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end>> of all kinds, one kind after the other; code points, end exclusive."""
    return F.concat(*[_matches(text, pattern, kind, lambda m, k=kind, n=least: F.length(_value(m, k)) >= n) for kind, (pattern, _, least) in KINDS.items()])


def in_order(spans: Column) -> Column:
    """By start, then kind in the order of `KINDS`, the added kind last."""
    place = lambda kind: F.array_position(F.array(*[F.lit(k) for k in (*KINDS, RANDOM)]), kind)
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), place(s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _pairs(text: Column) -> Column:
    """Each character with the one before it, the first one with the empty text."""
    chars = F.split(text, "")
    return F.zip_with(F.concat(F.array(F.lit("")), F.slice(chars, 1, F.size(chars) - 1)), chars, lambda a, b: F.struct(F.ascii(a).alias("a"), F.ascii(b).alias("b")))


def labelled(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_strings: int = SAMPLE_STRINGS) -> DataFrame:
    """text, label: random strings (1) and ordinary ones (0) of `docs` (text), each once.

    Random: what base matches hold, letters as well as digits, at most `sample_strings`, by
    their hash. Ordinary: runs of six or more characters without letters or without
    digits, of the `sample_docs` texts of smallest hash.
    """
    text = F.coalesce("text", F.lit(""))
    mixed = F.col("text").rlike("[A-Za-z]") & F.col("text").rlike("[0-9]")
    held = F.concat(*[F.when(_HOLDS[kind](text), F.filter(F.regexp_extract_all(text, F.lit(p), F.lit(group)), lambda v, n=least: F.length(v) >= n))
                      .otherwise(F.array().cast("array<string>")) for kind, (p, group, least) in KINDS.items()])
    secret = docs.select(F.explode(held).alias("text"))
    secret = secret.select(F.regexp_replace("text", f"[^{RUN[1:-1]}]", "").alias("text")).where(mixed).distinct()
    secret = secret.orderBy(F.md5("text"), "text").limit(sample_strings)
    hashes = docs.select(F.md5("text").alias("h")).where("h IS NOT NULL").distinct().orderBy("h").limit(sample_docs)
    last = hashes.agg(F.max("h")).first()[0] or ""
    words = docs.where(F.md5("text") <= last).select(F.explode(F.regexp_extract_all("text", F.lit(f"{RUN}{{6,}}"), F.lit(0))).alias("text"))
    return secret.withColumn("label", F.lit(1)).unionByName(words.where(~mixed).distinct().withColumn("label", F.lit(0)))


def fit(samples: DataFrame) -> np.ndarray:
    """Log-likelihood ratios by code of a character and of the one before it (0: none), from `samples` (text, label 0 or 1)."""
    counts = np.zeros((2, 128, 128))
    pairs = samples.where("text <> '' AND label IN (0, 1)").select("label", F.explode(_pairs(F.col("text"))).alias("p")).select("label", "p.*")
    for label, a, b, n in pairs.where("a < 128 AND b < 128").groupBy("label", "a", "b").count().collect():  # one row a pair of characters
        counts[label, a, b] = n
    used = [ord(c) for c in ALPHABET]
    seen = counts[:, :, used].sum(axis=2, keepdims=True)
    chance = (counts + ADDED) / (seen + ADDED * len(used))
    ratio = np.log(chance[1]) - np.log(chance[0])
    if not counts[0].any() or not counts[1].any():
        ratio[:] = 0.0
    return ratio


def _ratio(model: np.ndarray, text: Column) -> Column:
    table = F.split(F.lit(",".join(map(repr, model.ravel().tolist()))), ",").cast("array<double>")
    return F.aggregate(_pairs(text), F.lit(0.0), lambda s, p: s + F.get(table, p["a"] * 128 + p["b"]))


def random_spans(text: Column, model: np.ndarray) -> Column:
    """Spans of runs outside of base matches that the random chain explains better by more than `MARGIN`."""
    run = lambda m: F.regexp_extract(m, _ANY, 3)
    return _matches(text, _ANY, RANDOM, lambda m: (F.length(run(m)) >= LEAST) & (_ratio(model, m) > MARGIN))


def scan(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """`docs` (text and others) with spans: array<struct<kind, start, end>> in order; code points, end exclusive."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("spans", in_order(F.concat(base_spans(text), random_spans(text, model))))
