"""Mixing sources to target weights by pivotal dependent rounding.

Only DataFrame functions. Every document of a source gets the same expected number of
copies, target over source size; its whole part is sure and its fraction is rounded.
Fractions are paired: words move at random from one document of the pair to the other
until one fraction is 0 or 1, such that expectations and the words of the pair stay as
they are. What is left of a block of documents, one fraction, meets the rests of other
blocks on the next level of a tree, until one fraction per source is left, which is
drawn. So a source misses its target by less than one document. Within a block, large
documents come first, so that the rest is mostly that of a small one.

Blocks are a hash of the document, so a source of any size is spread over as many
blocks as it needs, and all random choices are hashes: reruns agree.

Defined results: sizes null or below 0 count as 0 and are not taken; a null source is
a source, the last; rows repeated are rounded one by one; an empty table gives no row;
other columns are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalloom.llm.common import cut

BLOCK = 64


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Per source its size and target: shares of all words by weight, none above `most` times its size.

    Sources are ordered by code point, null last, and take the weights in turn. Sharing
    the excess of full sources again and again ends where each target is the smaller of
    its limit and one common level times its weight; the level is found by ordering the
    sources by the level at which they are full.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    by_full = Window.orderBy((F.col("limit") / F.col("weight")), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(by_full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    per = per.withColumn("level", rest / open_weight)
    # The first source that does not fill up sets the level for all behind it.
    first_open = F.min(F.when(F.col("limit") > F.col("level") * F.col("weight"), F.struct(F.col("limit") / F.col("weight"), F.col("level").alias("level")))).over(everything)
    per = per.withColumn("common", first_open["level"])
    return per.select("source", "source_size", "n_rows", F.least("limit", F.coalesce(F.col("common") * F.col("weight"), F.col("limit"))).alias("target"))


def _settle(seed: int, level: int) -> str:
    """SQL that folds a block's documents (n, id, copy, p) into settled ones and a rest."""
    one = "struct<n:bigint,id:bigint,copy:bigint,p:double>"
    up, down = "least((1 - a.p) * a.n, x.p * x.n)", "least(a.p * a.n, (1 - x.p) * x.n)"
    draw = f"(xxhash64({seed}L, {level}, a.id, a.copy, x.id, x.copy) & 9007199254740991L) / 9007199254740992D"
    snap = lambda e: f"CASE WHEN {e} < 1e-12 THEN 0D WHEN {e} > 1 - 1e-12 THEN 1D ELSE {e} END"
    pair = lambda p, q: f"array(named_struct('n', a.n, 'id', a.id, 'copy', a.copy, 'p', {snap(p)}), named_struct('n', x.n, 'id', x.id, 'copy', x.copy, 'p', {snap(q)}))"
    moved = f"""CASE WHEN {draw} * ({up} + {down}) < {down}
        THEN {pair(f"(a.p + {up} / a.n)", f"(x.p - {up} / x.n)")}
        ELSE {pair(f"(a.p - {down} / a.n)", f"(x.p + {down} / x.n)")} END"""
    two = f"element_at(transform(array(acc.rest), a -> {moved}), 1)"
    fractional = "(r -> r.p > 0 AND r.p < 1)"
    step = f"""element_at(transform(array(CASE WHEN acc.rest IS NULL THEN array(x) ELSE {two} END), m -> named_struct(
        'rest', element_at(filter(m, {fractional}), 1),
        'done', concat(acc.done, filter(m, r -> r.p <= 0 OR r.p >= 1)))), 1)"""
    start = f"named_struct('rest', CAST(NULL AS {one}), 'done', CAST(array() AS array<{one}>))"
    return f"aggregate(docs, {start}, (acc, x) -> {step})"


def round_copies(sizes: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """Whole copies for every row of `sizes` (doc_id, source, size): doc_id, source, size, source_size, target, copies."""
    rows = sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m"))
    rows = rows.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("copy"))
    named = targets.withColumnRenamed("source", "of_source")
    rows = rows.join(named, rows["source"].eqNullSafe(named["of_source"])).drop("of_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("sure", F.when(F.col("size") > 0, F.floor(rate)).otherwise(0).cast("long"))
    rows = rows.withColumn("p", F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(0.0))
    rows = cut(rows, "mix-rows")
    most = targets.agg(F.max("n_rows")).first()[0] or 0
    left = rows.where("p > 0").select("source", "n_rows", F.struct(F.col("size").alias("n"), F.col("doc_id").cast("long").alias("id"), "copy", "p").alias("doc"))
    settled, level = None, 0
    while True:
        blocks = F.ceil(F.col("n_rows") / BLOCK).cast("long")
        block = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("doc")["id"], F.col("doc")["copy"], F.col("doc")["n"]), blocks)
        grouped = left.withColumn("block", block).groupBy("source", "n_rows", "block").agg(F.collect_list("doc").alias("docs"))
        by_size = F.expr("array_sort(docs, (l, r) -> CASE WHEN l.n <> r.n THEN CASE WHEN l.n > r.n THEN -1 ELSE 1 END "
                         "WHEN l.id <=> r.id THEN CASE WHEN l.copy < r.copy THEN -1 WHEN l.copy > r.copy THEN 1 ELSE 0 END "
                         "WHEN l.id IS NULL THEN -1 WHEN r.id IS NULL THEN 1 WHEN l.id < r.id THEN -1 ELSE 1 END)")
        folded = cut(grouped.withColumn("docs", by_size).select("source", "n_rows", F.expr(_settle(seed, level)).alias("end")), "mix-level")
        done = folded.select("source", F.explode("end.done").alias("doc"))
        settled = done if settled is None else settled.unionByName(done)
        left = folded.where("end.rest IS NOT NULL").select("source", F.ceil(F.col("n_rows") / BLOCK).cast("long").alias("n_rows"), F.col("end.rest").alias("doc"))
        most, level = ceil(most / BLOCK), level + 1
        if most <= 1:
            break
    draw = (F.xxhash64(F.lit(seed), F.lit("last"), F.col("doc")["id"], F.col("doc")["copy"]).bitwiseAND(F.lit((1 << 53) - 1))) / float(1 << 53)
    last = left.select("source", F.col("doc").withField("p", F.when(draw < F.col("doc")["p"], 1.0).otherwise(0.0)).alias("doc"))
    settled = settled.unionByName(last).select(
        F.col("source").alias("s_source"), F.col("doc")["n"].alias("s_n"), F.col("doc")["id"].alias("s_id"), F.col("doc")["copy"].alias("s_copy"), F.col("doc")["p"].cast("long").alias("extra"))
    same = (rows["doc_id"].cast("long").eqNullSafe(settled["s_id"]) & (rows["copy"] == settled["s_copy"])
            & rows["source"].eqNullSafe(settled["s_source"]) & (rows["size"] == settled["s_n"]))
    return rows.join(settled, same, "left").select(
        "doc_id", "source", "size", "source_size", "target", (F.col("sure") + F.coalesce("extra", F.lit(0))).alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: int = 0) -> DataFrame:
    """Plan the mix of `docs` (doc_id, source, size); see the module for the cases.

    Returns a row per row: doc_id, source, size, source_size, target, copies, taken.
    """
    size = F.greatest(F.coalesce(F.col("size").cast("long"), F.lit(0)), F.lit(0)).alias("size")
    sizes = cut(docs.select("doc_id", "source", size), "mix-sizes")
    targets = cut(source_targets(sizes, weights, most), "mix-targets")
    return round_copies(sizes, targets, seed).withColumn("taken", F.col("copies") * F.col("size"))
