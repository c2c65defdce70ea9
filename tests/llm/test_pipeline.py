"""Every stage against a plain version of it, each on the stage's own input, and the whole."""

import os
import random
import re
import subprocess
import sys
from collections import defaultdict

import pytest
from pyspark import cloudpickle

import corpus_pipeline as p
from signalloom.llm import decontaminate, language, minhash, suffix
from signalloom.session import clear_scratch

TYPES = "doc_id long, text string, lang string, source string, n_chars long, rest string"
WORDS = {"en": "the of and that with from which there have this will water house under", "de": "der die und nicht mit auf eine werden haben wasser haus unter leute"}


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    r = random.Random(1)
    say = lambda lang, n: " ".join(r.choice(WORDS[lang].split()) + (str(r.randrange(9)) if r.random() < 0.6 else "") for _ in range(n))
    items = [(i, say("en", 40)) for i in range(5)] + [(9, None)]
    rows = []
    for i in range(150):
        lang = "de" if i % 3 == 0 else "en"
        rows.append((i, say(lang, r.randint(5, 90)), lang, r.choice(["a", "a", "a", "b", "c", None]), 0, "clash"))
    line = say("en", 60)
    rows += [(200 + i, f"{say('en', 20)} {line} {say('en', 20)}", "en", "b", 0, "") for i in range(6)]
    rows += [(300 + i, f"{say('en', 20)} {items[i % 5][1]}", "en", "c", 0, "") for i in range(5)]
    long = rows[7][1] + " " + say("en", 60)
    rows += [(400, long, "en", "a", 0, ""), (401, long + " new", "en", "a", 0, ""), (402, long, None, "a", 0, ""), (402, long, None, "a", 0, "")]
    rows += [(500, None, "en", "a", 0, ""), (501, "123 !", "en", "a", 0, ""), (502, "", "de", "b", 0, ""), (None, say("en", 30), "en", "a", 0, ""), (503, say("en", 9000), None, "b", None, "")]
    spark.createDataFrame(rows, TYPES).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def by_id(rows):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in rows)


def _set(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(words)} if len(words) < n else {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in p.STAGES:
        before = docs.collect()
        docs = p.cut(stage(spark, docs, sf_dir), "test")
        seen[name] = (before, docs.collect())
        if name != p.STAGES[-1][0]:
            assert docs.columns == p.COLUMNS
    assert [n for n, _ in p.STAGES] == list(seen)

    before, after = seen["language ID"]
    model = language.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sure = [r for r in before if re.search(r"[^\W\d_]", r.text or "") and model.mixture(r.text)[1] >= p.LANGUAGE_SCORE]
    assert by_id(after) == by_id(sure) and any(r.doc_id is None for r in after)

    before, after = seen["MinHash near-dedup"]
    texts = {(r.doc_id is None, r.doc_id or 0, k): r.text for k, r in enumerate(before)}  # in the order of labels
    sets = {i: _set(t) for i, t in texts.items()}
    top = {i: i for i in texts}
    changed = True
    links = [(i, j) for i in texts for j in texts if i < j and len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            if top[i] != top[j]:
                top[i] = top[j] = min(top[i], top[j])
                changed = True
    groups = defaultdict(set)
    for i, t in texts.items():
        groups[top[i]].add(t)
    kept = [r.text for r in after]
    assert len(kept) == len(groups) < len(before) and all(len(g & set(kept)) == 1 for g in groups.values())
    unique = {i for i in top.values() if sum(r.doc_id == i[1] for r in before) == 1 and not i[0]}
    assert {i[1] for i in unique} <= {r.doc_id for r in after}

    before, after = seen["suffix-array dedup"]
    seen_windows, want = set(), {}
    for r in sorted(before, key=lambda r: (r.doc_id is None, r.doc_id)):
        data = r.text.encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 99):
            if data[k:k + 100] in seen_windows:
                gone[k:k + 100] = b"\1" * 100
            seen_windows.add(data[k:k + 100])
        rest = bytes(x for x, g in zip(data, gone, strict=True) if not g).decode("utf-8", "ignore")
        if rest or not data:
            want[r.doc_id] = rest
    assert {r.doc_id: r.text for r in after} == want and any(want[r.doc_id] != r.text for r in before if r.doc_id in want)
    assert all(r.n_chars == len(r.text) for r in after if {b.doc_id: b.text for b in before}[r.doc_id] != r.text)

    before, after = seen["benchmark decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if r.text]
    known = decontaminate.Benchmark(items)
    dirty = {r.doc_id for r in before if known.matches(r.text)}
    assert dirty and {r.doc_id for r in after} == {r.doc_id for r in before} - dirty

    before, after = seen["mixing sources"]
    size, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in before:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        size[r.source] += n
        largest[r.source] = max(largest[r.source], n)
    for r in after:
        taken[r.source] += r.size
        target[r.source] = r.target
        assert r.source_size == size[r.source] and 1 <= r.copy <= 3
    assert all(abs(taken[s] - t) <= largest[s] + 1e-3 for s, t in target.items())
    assert len({(r.doc_id, r.copy) for r in after}) == len(after)


def test_run(spark, sf_dir):
    rows = p.run(spark, sf_dir).collect()
    assert rows and sorted(map(str, rows)) == sorted(map(str, p.run(spark, sf_dir).collect()))


def test_only_the_last_result_is_left(spark, sf_dir):
    clear_scratch()
    out = p.run(spark, sf_dir)
    files = [x for x in out.inputFiles()]
    folder = os.path.dirname(files[0]).removeprefix("file:").removeprefix("//")
    shared = os.path.dirname(folder)
    left = [x for x in os.listdir(shared) if os.path.isdir(f"{shared}/{x}") and any("-" in x and f.endswith(".parquet") for f in os.listdir(f"{shared}/{x}"))]
    assert left == [os.path.basename(folder)]


def test_rows_that_share_an_id_stay_apart(spark, sf_dir):
    say = lambda k: " ".join(f"{w}{k}x{i}" for i, w in enumerate(WORDS["en"].split() * 8))
    rows = [(1, say(1)), (1, say(2)), (1, say(2)), (2, say(1)), (None, say(3)), (None, say(4)), (None, say(4)), (3, say(5))]
    docs = spark.createDataFrame([(i, t, "en", "a", 1, "x") for i, t in rows], TYPES).repartition(4)
    for stage in (p.near_dedup, p.exact_dedup):
        assert {r.text for r in stage(spark, docs, sf_dir).collect()} == {t for _, t in rows}
        assert stage(spark, docs, sf_dir).count() == 5


def test_tasks_need_neither_module_nor_package(spark):
    for function in (suffix._decode, suffix._keep, minhash._signer(5), language._count, decontaminate._finder([], "text", False)):
        sent = cloudpickle.dumps(function)
        code = f"import sys, pickle; sys.path = [x for x in sys.path if x not in ('', {os.path.dirname(os.path.abspath(p.__file__))!r})]; pickle.loads({sent!r})"
        subprocess.run([sys.executable, "-I", "-c", code], check=True, cwd="/")


def test_empty(spark, tmp_path):
    spark.createDataFrame([], TYPES).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
