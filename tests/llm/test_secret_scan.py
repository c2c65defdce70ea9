import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.llm import secret_scan

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


HEX = "0123456789abcdef" * 2
TEXTS = [None, "", "plain words only", f"token = \"{HEX}\" and", "PassWord:'short' passwd=longer1", "token:token:abcdefgh", "token=token=abcdef1",
         "ſecret=abcdefg toKen=abcdefg", "AKIA" + "Z" * 15, "xAKIA" + "Z0" * 8 + "yAKIAAKIA" + "Q" * 20, "é日本" + HEX + "😀" + HEX + "g" + HEX[:23],
         "api_key  =  'a.b-c_d' apikey:\"zzzzzz\" API_KEY=\nabcdef", f"hex {HEX}token={HEX}", "secret" * 3000 + "=abcdef1", f" {HEX}, token=abc123;" * 700]
RUNS = ["kX9f2LmQ7zR4tB8w", "Zk3/pQ+9vT2xLw8YbN4c"]


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(3)
    strings = ["".join(rng.choices(secret_scan.ALPHABET[:62], k=32)) for _ in range(400)]
    words = ["".join(rng.choices(["ka", "lo", "mi", "tur", "een", "sta"], k=5)) for _ in range(800)] + [str(rng.randrange(10**15, 10**16)) for _ in range(300)]
    samples = [(s, 1) for s in strings] + [(w, 0) for w in words]
    return secret_scan.fit(spark.createDataFrame(samples + [("skipped", None), (None, 1), ("", 0)], "text string, label int")), samples


def test_base_spans_equal_a_plain_search(frame, model):
    docs = frame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id int, text string, spans string")
    found = {r["doc_id"]: [tuple(s) for s in r["spans"] if s["kind"] != "random"] for r in secret_scan.scan(docs, model[0]).collect()}
    assert found == {i: base(t) for i, t in enumerate(TEXTS)}


def test_random_tables(frame, model):
    rng = random.Random(8)
    bits = ["token", "secret", "Api_Key", "passwd", "=", ":", " ", "\"", "'", "abcdef", "AKIA", "Q7Z", HEX, "0a", "é", "日", ".", "\n", "x"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(1, 60))) for _ in range(1500)]
    docs = frame(list(enumerate(texts)), "doc_id int, text string")
    found = {r["doc_id"]: [tuple(s) for s in r["spans"] if s["kind"] != "random"] for r in secret_scan.scan(docs, model[0]).collect()}
    assert all(found[i] == base(t) for i, t in enumerate(texts))


def test_model_equals_counts_by_hand(model):
    ratios, samples = model
    counts, seen = [Counter(), Counter()], [Counter(), Counter()]
    for text, label in samples:
        for a, b in zip("\0" + text, text):
            counts[label][a, b] += 1
            seen[label][a] += 1
    for a, b in [("\0", "k"), ("k", "a"), ("9", "Z"), ("Q", "+")]:
        chance = [(counts[x][a, b] + 0.5) / (seen[x][a] + 0.5 * 66) for x in (0, 1)]
        assert math.isclose(ratios[ord(a), ord(b)], math.log(chance[1] / chance[0]))


def test_random_runs_are_added_and_ordinary_ones_are_not(frame, model):
    texts = [f"note {r} ends" for r in RUNS] + ["stakalomitureensta 4321432143214321", "é " + RUNS[0] + "," + RUNS[1], f"token={RUNS[1]}"]
    docs = frame(list(enumerate(texts)), "doc_id int, text string")
    found = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secret_scan.scan(docs, model[0]).collect()}
    assert found[0] == [("random", 5, 21)] and found[1] == [("random", 5, 25)] and found[2] == []
    assert found[3] == [("random", 2, 18), ("random", 19, 39)]
    assert found[4] == [("assign", 0, 26)]


def test_held_out_accuracy(spark, model):
    rng = random.Random(77)
    strings = ["".join(rng.choices(secret_scan.ALPHABET[:62], k=24)) for _ in range(500)]
    words = ["".join(rng.choices(["ka", "lo", "mi", "tur", "een", "sta"], k=9)) for _ in range(500)]
    table = spark.createDataFrame([(s, 1) for s in strings] + [(w, 0) for w in words], "text string, label int")
    rows = table.select("label", secret_scan._ratio(model[0], F.col("text")).alias("r")).collect()
    caught = {label: np.mean([r["r"] > secret_scan.MARGIN for r in rows if r["label"] == label]) for label in (0, 1)}
    assert caught[0] == 0 and caught[1] > 0.9  # the margin rather misses a string than flags a word


def test_labels_come_from_base_matches_and_words(frame):
    docs = frame([(f"token = \"{HEX}\" and AKIA{'Z0' * 9}, password=correcthorse",), ("ordinary_words 12345678 mixed1words",), (None,), ("",)], "text string")
    assert {tuple(r) for r in secret_scan.labelled(docs).collect()} == {
        (HEX, 1), ("AKIA" + "Z0" * 9, 1), ("password", 0), ("correcthorse", 0), ("ordinary_words", 0), ("12345678", 0)}
    assert secret_scan.labelled(docs.limit(0)).collect() == []


def test_empty_tables_and_samples(frame, spark):
    model = secret_scan.fit(spark.createDataFrame([], "text string, label int"))
    assert not model.any()
    docs = frame([(1, RUNS[0])], "doc_id int, text string")
    assert secret_scan.scan(docs, model).collect()[0]["spans"] == []
    assert secret_scan.scan(docs.limit(0), model).collect() == []


def test_no_python_in_the_plan(frame, model):
    plan = secret_scan.scan(frame([(1, "a")], "doc_id int, text string"), model[0])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
