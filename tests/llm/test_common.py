"""Rows parted by bits of their keys, and what a written table leaves behind."""

import random
import time

import pytest

import corpus_pipeline as p
from signalloom.llm.common import cut, parted


def _shuffle_files(spark):
    """Bytes of shuffle files by name."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in files if f.getName().startswith("shuffle_")}


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("most", [1 << 25, 1 << 15])
def test_parted(spark, frame, most):
    r = random.Random(3)
    keys = list({r.getrandbits(63) - (1 << 62) for _ in range(4000)})
    rows = [(k, str(k), i) for i, k in enumerate(keys)] + [(keys[0], "again", -1), (None, "none", -2)]
    few = cut(frame([(k,) for k in keys[:1500]] + [(keys[0],)], "of long"), "few")
    table = frame(rows, "key long, text string, bits int")
    maybe, others = (part.collect() for part in parted(table, table["key"], few, most))
    assert sorted(map(str, maybe + others)) == sorted(map(str, table.collect()))
    assert not {x.key for x in others} & set(keys[:1500])
    if most > 1 << 15:
        assert len(maybe) < 1501 + 400
    none = cut(frame([], "of long"), "none")
    assert [part.count() for part in parted(table, table["key"], none)] == [0, len(rows)]


def test_shuffles_of_a_table_go(spark, no_broadcast):
    before = set(_shuffle_files(spark))
    rows = spark.range(2000).repartition(5)
    joined = cut(rows.join(spark.range(0, 2000, 2), "id"), "joined")
    for _ in range(50):
        left = set(_shuffle_files(spark)) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left and joined.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


@pytest.mark.parametrize("stage", [p.near_dedup, p.exact_dedup])
def test_rows_without_a_match_are_not_shuffled(spark, frame, no_broadcast, stage):
    r = random.Random(4)
    texts = [" ".join(f"{r.getrandbits(64):x}" for _ in range(600)) for _ in range(200)]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    rows += [(300, texts[5] + " more", "en", "a", 0), (301, texts[6] + " more", "en", "a", 0)]
    docs = cut(frame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "docs")
    found = stage(spark, docs, "")
    before = set(_shuffle_files(spark))
    found.write.format("noop").mode("overwrite").save()
    moved = sum(n for f, n in _shuffle_files(spark).items() if f not in before)
    got = {x.doc_id: x.text for x in found.collect()}
    assert {i: got[i] for i in range(200)} == dict(enumerate(texts))
    if stage is p.near_dedup:
        assert len(got) == 200
    else:
        assert sorted(got) == [*range(200), 300, 301] and max(len(got[300]), len(got[301])) < 120
    assert moved < 200_000 < sum(map(len, texts)) / 10
