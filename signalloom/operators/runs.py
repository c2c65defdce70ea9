"""Measurement runs: stretches of rows with one tag, numbered along the series.

A run may be longer than any bucket and a bucket may hold many runs, so neither is
gathered: changes are found inside buckets, and one row per bucket carries over the
last tag, the number of changes so far and where the open run began.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions.scalar import named
from signalloom.operators.series import BUCKET, SeriesSpec, attach, bucketed
from signalloom.session import cut


def with_run(df: DataFrame, spec: SeriesSpec, by: Sequence[str | Column] = ("tag",), run: str = "run", pos: str = "run_pos") -> DataFrame:
    """Number `run` 0, 1, ... of each stretch of equal `by` values, and the row's position 0, 1, ... in it.

    Null is a value like any other. The rows are written once, numbered inside their
    buckets; rows that share order key and tie have no defined order.
    """
    tags = [named(c) if isinstance(c, str) else c for c in by]
    over = spec.by_bucket()
    so_far = over.rowsBetween(Window.unboundedPreceding, 0)
    tagged = bucketed(df, spec).withColumn("__tag", F.struct(*[t.alias(f"t{i}") for i, t in enumerate(tags)]))
    placed = tagged.withColumn("__inner", F.row_number().over(over).cast("bigint") - 1)
    turned = placed.withColumn("__turn", (F.col("__inner") > 0) & ~F.col("__tag").eqNullSafe(F.lag("__tag").over(over)))
    numbered = cut(turned.select(
        "*", F.count_if("__turn").over(so_far).alias("__turns"),
        F.max(F.when(F.col("__turn"), F.col("__inner"))).over(so_far).alias("__begun")), "runs")

    buckets = numbered.groupBy(*spec.keys, BUCKET).agg(
        F.count(F.lit(1)).alias("__rows"), F.max("__turns").alias("__all"), F.max("__begun").alias("__last"),
        F.max(F.when(F.col("__inner") == 0, F.col("__tag"))).alias("__head"), F.max_by("__tag", "__inner").alias("__foot"))
    order = spec.over_buckets()
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    first = F.lag("__rows").over(order).isNull()
    buckets = buckets.select(
        "*", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__offset"), first.alias("__first"),
        (~first & ~F.col("__head").eqNullSafe(F.lag("__foot").over(order))).alias("__enters"))
    opened = F.when(F.col("__last").isNotNull(), F.col("__offset") + F.col("__last")).when(
        F.col("__first") | F.col("__enters"), F.col("__offset"))
    entered = F.col("__enters").cast("bigint")
    carried = buckets.select(
        *spec.keys, BUCKET, "__offset",
        (F.coalesce(F.sum(F.col("__all") + entered).over(earlier), F.lit(0)) + entered).alias("__before"),
        F.when(F.col("__first") | F.col("__enters"), F.col("__offset")).otherwise(F.max(opened).over(earlier)).alias("__open"))

    out = attach(numbered, carried, [*spec.keys, BUCKET])
    start = F.coalesce(F.col("__offset") + F.col("__begun"), F.col("__open"))
    kept = [c for c in df.columns if c not in (run, pos)]
    return out.select(*[named(c) for c in kept], (F.col("__before") + F.col("__turns")).alias(run),
                      (F.col("__offset") + F.col("__inner") - start).alias(pos))


def run_spec(spec: SeriesSpec, run: str = "run") -> SeriesSpec:
    """The layout in which every run is a series of its own, for lags, rolling frames and windows that end with it."""
    return replace(spec, keys=(*spec.keys, run))
