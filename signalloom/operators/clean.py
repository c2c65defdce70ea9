"""Gap filling, missing-value rules and table profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalloom.functions.scalar import MISSING_TEXT, named, null_nan, null_text
from signalloom.operators.series import BUCKET, SeriesSpec, bucketed


def forward_fill(df: DataFrame, spec: SeriesSpec, columns: Sequence[str] | None = None) -> DataFrame:
    """Replace each null by the last known value before it; leading nulls stay.

    Rows are filled inside their bucket. What a bucket inherits comes from a
    table with the last known values of each bucket (one row per bucket), so a
    gap may span any number of buckets.
    """
    fixed = {*spec.keys, spec.order, *spec.tie, BUCKET}
    columns = [c for c in (columns or df.columns) if c not in fixed]
    cut_up = bucketed(df, spec)
    # A lone order key stays a plain number, which keeps this aggregate in hash tables.
    place = named(spec.order) if not spec.tie else F.struct(*[part.alias(f"p{i}") for i, part in enumerate(
        p for c in (spec.order, *spec.tie) for p in (named(c).isNull(), named(c)))])
    lasts = cut_up.groupBy(*spec.keys, BUCKET).agg(
        *[F.max_by(named(c), F.when(named(c).isNotNull(), place)).alias(f"__last{i}") for i, c in enumerate(columns)])
    earlier = spec.over_buckets().rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*spec.keys, BUCKET, *[
        F.last(f"__last{i}", ignorenulls=True).over(earlier).alias(f"__carry{i}") for i in range(len(columns))])
    so_far = spec.by_bucket().rowsBetween(Window.unboundedPreceding, 0)
    filled = cut_up.select(
        *[named(c) for c in cut_up.columns if c not in columns],
        *[F.last(named(c), ignorenulls=True).over(so_far).alias(c) for c in columns])
    out = filled.join(carried, [*spec.keys, BUCKET]).select(*[
        F.coalesce(named(c), F.col(f"__carry{columns.index(c)}")).alias(c) if c in columns else named(c)
        for c in cut_up.columns])
    return out if BUCKET in df.columns else out.drop(BUCKET)


def null_out_missing(df: DataFrame, columns: Sequence[str] | None = None,
                     tokens: Sequence[str] = MISSING_TEXT) -> DataFrame:
    """Missing-value texts and NaN become NULL, so one notion of missing is left."""
    chosen = set(columns or df.columns)
    out = []
    for f in df.schema.fields:
        c = named(f.name)
        if f.name in chosen and isinstance(f.dataType, T.StringType):
            c = null_text(c, tokens).alias(f.name)
        elif f.name in chosen and isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = null_nan(c).alias(f.name)
        out.append(c)
    return df.select(*out)


def table_profile(df: DataFrame) -> DataFrame:
    """One row per column in file order: ordinal, name, type and count of missing values."""
    def missing(f: T.StructField):
        c = named(f.name)
        gone = c.isNull()
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            gone = gone | F.isnan(c)
        return F.count_if(gone)

    entries = [F.struct(F.lit(i).cast("int").alias("ordinal"), F.lit(f.name).alias("name"),
                        F.lit(f.dataType.simpleString()).alias("type"), missing(f).alias("n_null"))
               for i, f in enumerate(df.schema.fields)]
    return df.agg(F.array(*entries).alias("e")).select(F.inline("e"))


def null_counts(df: DataFrame) -> DataFrame:
    """Missing values per column, as (name, n_null)."""
    return table_profile(df).select("name", "n_null")


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop every row with a missing value in any of the columns."""
    return df.dropna("any", subset=list(columns) if columns else None)
