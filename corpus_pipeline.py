"""A corpus from `documents`: filtered, deduplicated, decontaminated and mixed.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All
but the last return the columns of `documents`; each runs the operator of its name and
leaves only small tables (labels of rows) or changed texts in the shared folder. `run`
removes a stage's tables once the next one has written its result.

Rows are told apart by a label that is their id where the id is theirs alone. Rows that
share an id, and rows without one, get labels of their own, so none of them stands for another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm import decontaminate, language, minhash, mixing, suffix
from signalloom.llm.common import cut, parted, pick, table, word_count
from signalloom.session import scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The pipeline's near-duplicates: words of a shingle and similarity.
SHINGLE, SIMILARITY = 5, 0.8
#: Least score of a document's language, its share of the text times how sure it is.
LANGUAGE_SCORE = 0.35


def labelled(docs: DataFrame) -> DataFrame:
    """`docs` with a `label` for every row: its id, or a larger number where the id is shared or null."""
    docs = pick(docs, *COLUMNS)
    shared = cut(docs.groupBy(F.col("doc_id").alias("of")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR of IS NULL").select("of"), "shared")
    if shared.isEmpty():
        return docs.withColumn("label", F.col("doc_id").cast("long"))
    same = F.col("doc_id").eqNullSafe(F.col("of"))
    top = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0)).cast("long")).first()[0]
    # Written, so that every reader sees the same labels.
    many = cut(docs.join(shared, same, "left_semi").withColumn("label", F.lit(top + 1) + F.monotonically_increasing_id()), "labelled")
    return docs.join(shared, same, "left_anti").withColumn("label", F.col("doc_id").cast("long")).unionByName(many)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language: those without a letter go, and those of no language for `LANGUAGE_SCORE` of them."""
    docs = pick(docs, *COLUMNS)
    found = language.predict(docs, language.fit(docs))
    return found.where((F.col("lang_pred") != language.UND) & (F.col("score") >= LANGUAGE_SCORE)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest label."""
    docs = labelled(docs)
    with scratch() as scope:
        found = minhash.near_duplicates(docs.select(F.col("label").alias("doc_id"), "text"), SHINGLE, SIMILARITY)
        gone = scope.keep(found.where("NOT kept").select(F.col("doc_id").alias("label")), "gone")
    # Few go, so most rows stay where they are.
    maybe, others = parted(docs, F.col("label"), gone)
    return maybe.join(gone, "label", "left_anti").unionByName(others).select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds; those of which nothing is left go.

    Passages are judged by bytes; what is left of a character that one cuts goes with it.
    """
    docs = labelled(docs)
    with scratch() as scope:
        found = suffix.remove_repeats(docs.select(F.col("label").alias("doc_id"), "text")).where("n_removed > 0")
        rest = scope.keep(suffix.decoded(found).select(F.col("doc_id").alias("label"), F.col("kept").alias("rest")), "rest")
    maybe, others = parted(docs, F.col("label"), rest.select("label"))
    docs = maybe.join(rest, "label", "left").unionByName(others, allowMissingColumns=True)
    docs = docs.where(F.col("rest").isNull() | (F.col("rest") != ""))
    shorter = F.col("rest").isNotNull()
    return docs.withColumns({"text": F.coalesce("rest", "text"), "n_chars": F.when(shorter, F.length("rest").cast("long")).otherwise(F.col("n_chars"))}).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    found = decontaminate.find(pick(docs, *COLUMNS), pick(table(spark, sf_dir, "benchmark"), "item_id", "text"))
    return found.where("n_matches = 0").select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for every copy of a document that it takes, with its number, size and its source's target."""
    docs = labelled(docs)
    with scratch() as scope:
        plan = mixing.mix(docs.select(F.col("label").alias("doc_id"), "source", word_count(F.col("text")).alias("size"))).where("copies > 0")
        plan = scope.keep(plan.select(F.col("doc_id").alias("label"), "size", "source_size", "target", "copies"), "plan")
    plan = plan.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")
    return docs.join(plan, "label").select(*COLUMNS, "copy", "size", "source_size", "target")


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", exact_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", source_mix),
]

#: SQL has neither the language model, the edit distance of substrings nor the mix's hash.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each is written and read again before the next, and what it read is removed then."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with scratch() as scope:
            docs = scope.keep(stage(spark, docs, sf_dir), "stage")
        if before is not None:
            before.clear()
        before = scope
    return docs
