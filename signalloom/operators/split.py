"""Train and test splits, and contiguous folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions.scalar import named
from signalloom.operators.series import attach, join_groups, join_written
from signalloom.session import cut

HASH_STEP = 4        # hex digits: 65,536 buckets of equal expected size
CUT_ROWS = 100_000   # rows that are ranked to find the hash at the cut


def row_hash(columns: Sequence[str], seed: int) -> Column:
    """Hash of the row key; the same on any cluster and in any layout."""
    return F.md5(F.concat_ws("-", *[named(c).cast("string") for c in columns], F.lit(str(seed))))


def hold_out(df: DataFrame, key: Sequence[str], share: float = 0.4, seed: int = 1, by: Sequence[str] = (),
             name: str = "is_test") -> DataFrame:
    """Mark exactly ceil(share n) rows per group as test rows: those with the smallest hashes.

    The rows are not sorted or shuffled. Counting rows per hash prefix tells in
    which prefix the cut lies, and again inside it, until a bounded number of rows is
    ranked to find the hash at the cut; all rows are compared with it. The key must be
    unique within a group; two rows of one hash at the cut are an error.
    """
    hashed = cut(df.select(*by, row_hash(key, seed).alias("__h")), "hashes")
    groups = list(by)
    if not groups:
        hashed, groups = hashed.withColumn("__all", F.lit(0)), ["__all"]
    # Narrow down on the hash at the cut: one more hex digit block per round, inside the block that holds it.
    state, digits = None, 0
    while True:
        digits += HASH_STEP
        inside = hashed.withColumn("__prefix", F.substring("__h", 1, digits))
        if state is not None:
            before = state.withColumnRenamed("__prefix", "__old")
            inside = join_written(inside.withColumn("__old", F.substring("__h", 1, digits - HASH_STEP)), before.select(*groups, "__old"), [*groups, "__old"]).drop("__old")
        counts = inside.groupBy(*groups, "__prefix").agg(F.count(F.lit(1)).alias("__rows"))
        running = Window.partitionBy(*groups).orderBy("__prefix").rowsBetween(Window.unboundedPreceding, 0)
        if state is None:
            counts = counts.withColumn("__place", F.ceil(F.sum("__rows").over(Window.partitionBy(*groups)) * F.lit(float(share))))
        else:
            counts = join_groups(counts, state.select(*groups, "__place"), groups)
        counts = counts.withColumn("__upto", F.sum("__rows").over(running))
        holds = (F.col("__upto") >= F.col("__place")) & (F.col("__upto") - F.col("__rows") < F.col("__place"))
        state = cut(counts.filter(holds).select(
            *groups, "__prefix", "__rows", (F.col("__place") - F.col("__upto") + F.col("__rows")).alias("__place")), "cut")
        most = state.agg(F.max("__rows")).first()[0] or 0
        if most <= CUT_ROWS:
            break
        if digits >= 32:
            raise ValueError(f"the key of a hold-out is not unique: {most} rows have one hash")
    order = Window.partitionBy(*groups, "__prefix").orderBy("__h")
    last = join_written(hashed.withColumn("__prefix", F.substring("__h", 1, digits)), state.drop("__rows"), [*groups, "__prefix"])
    ranked_rows = last.select("*", F.row_number().over(order).alias("__rn"), F.lead("__h").over(order).alias("__next"))
    twice = F.when(F.col("__h") == F.col("__next"), F.raise_error(F.lit("the key of a hold-out is not unique"))).otherwise(F.col("__h"))
    limit = ranked_rows.filter(F.col("__rn") == F.col("__place")).select(*groups, twice.alias("__limit"))
    if not by:
        row = limit.first()
        bound = F.lit(row["__limit"]) if row else F.lit("")
        return df.withColumn(name, row_hash(key, seed) <= bound)
    return (attach(df, limit, groups, "left")
            .withColumn(name, F.coalesce(row_hash(key, seed) <= F.col("__limit"), F.lit(False))).drop("__limit"))


def tail_test(pos: Column, rows: Column, share: float = 0.4, cut_from: Column | None = None) -> Column:
    """Is the row among the last round(share n) of `rows`? Halves round to even.

    `cut_from` gives the row count the share is taken of, when it differs.
    """
    size = F.bround((rows if cut_from is None else cut_from) * F.lit(float(share)), 0).cast("bigint")
    return pos >= rows - size


def tail_validation(pos: Column, rows: Column, share: float = 0.15) -> Column:
    """Is the row behind the first floor((1 - share) n) rows?"""
    return pos >= F.floor(rows * F.lit(1.0 - share))


def fold_number(pos: Column, rows: Column, folds: int = 5) -> Column:
    """Contiguous fold of a row; the first n mod folds folds are one row longer."""
    size, longer = F.floor(rows / folds), rows % folds
    edge = longer * (size + 1)
    return F.when(pos < edge, F.floor(pos / (size + 1))).otherwise(
        longer + F.floor(F.try_divide(pos - edge, size))).cast("int")


def fold_sets(df: DataFrame, fold: str, folds: int = 5) -> DataFrame:
    """Every row once per fold, with `part` = validate for its own fold, train for the others."""
    return df.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn(
        "part", F.when(F.col("run") == F.col(fold), "validate").otherwise("train"))
