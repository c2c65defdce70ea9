"""Column choice: signals, input sets, derived columns and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.functions.scalar import named, residual


def choose(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[named(c) for c in columns])


def without(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def add_residual(df: DataFrame, total: str = "fm", part: str = "fb", out: str = "fr") -> DataFrame:
    return df.withColumn(out, residual(named(total), named(part)))


def replace_by_difference(df: DataFrame, left: str, right: str, out: str) -> DataFrame:
    """Keep only the difference of two columns, such as two encoder positions."""
    return df.withColumn(out, residual(named(left), named(right))).drop(left, right)


def axis_inputs(df: DataFrame, at: Sequence[str], signals: Sequence[str], axes: Sequence[int],
                active: int | None = None, axis: str = "axis") -> DataFrame:
    """Inputs of the active axis only, or of all axes side by side.

    All axes: one row per `at`, columns `{signal}|{axis}`. The axes are given, so
    no extra job looks for them, and cells are combined before the shuffle.
    """
    if active is not None:
        chosen = df.filter(named(axis) == active)
        return chosen.select(*at, *[named(s).alias(f"{s}|{active}") for s in signals])
    return df.groupBy(*at).agg(*[
        F.max(F.when(named(axis) == k, named(s))).alias(f"{s}|{k}") for k in axes for s in signals])


def reorder_by(df: DataFrame, ranking: DataFrame, name: str = "name", rank: str = "rank", k: int | None = None,
               keep: Sequence[str] = ()) -> DataFrame:
    """The columns `keep`, then columns in the order of a ranking table, which has one row per column."""
    rows = ranking.select(name, rank).orderBy(rank).collect()
    names = [r[0] for r in rows if r[0] in df.columns]
    return choose(df, [*keep, *(names[:k] if k else names)])


def paired(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both sides with equal keys; a row of either side that has no partner is an error."""
    one = left.withColumn("__left", F.lit(True))
    two = right.withColumn("__right", F.lit(True))
    both = one.join(two, list(keys), "full")
    alone = F.col("__left").isNull() | F.col("__right").isNull()
    checked = F.when(alone, F.raise_error(F.lit("a row has no partner on the other side"))).otherwise(F.lit(True))
    return both.withColumn("__ok", checked.cast("boolean")).filter("__ok").drop("__left", "__right", "__ok")
