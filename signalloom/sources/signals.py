"""Signal tables from the star-schema test tables."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.operators.series import SeriesSpec, fit_spec


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as axis signals: axis, cycle, ts, tag, v, a, fm, fb; one long series `all`.

    No two signals are equal, and all of them but the time have gaps: v wherever the
    event is an error, the others at their own steps once the series have begun.
    """
    number = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    at = F.col("event_id")

    def gappy(value: Column, step: int, rest: int) -> Column:
        return F.when((at <= 200) | (at % step != rest), value)

    return table(spark, sf_dir, "events").select(
        F.lit("all").alias("series"),
        (F.col("user_id") % 3).cast("int").alias("axis"),
        at.alias("cycle"),
        "ts",
        gappy(F.col("event_type"), 5, 3).alias("tag"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("v"),
        gappy(number, 7, 2).alias("a"),
        gappy(F.col("value") + at % 4, 11, 5).alias("fm"),
        gappy(number + at % 3, 13, 6).alias("fb"),
    )


def spec_for(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = ("axis",)) -> SeriesSpec:
    """Series layout of `signals`, fitted once per table and key set."""
    return _spec(spark.sparkContext.applicationId, spark, sf_dir, keys)


@lru_cache(maxsize=64)
def _spec(application: str, spark: SparkSession, sf_dir: str, keys: tuple[str, ...]) -> SeriesSpec:
    return fit_spec(signals(spark, sf_dir), keys, "cycle")


def forget_layouts() -> None:
    """Fit the layouts anew when they are next asked for."""
    _spec.cache_clear()
