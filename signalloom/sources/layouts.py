"""The two file layouts, and the one long form all operators work on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.functions.scalar import named, parse_time
from signalloom.sources.csv import scan_signals

# Column names of the file layouts.
TIME_2022, TIME_2023 = "_time", "time_"
CYCLE_2022 = "CYCLE"
AXIS_2022 = "/NC/_N_CH_GD9_ACX/SYG_I9|2"
TAG_2022, TAG_2023 = "/NC/_N_CH_GD9_ACX/SYG_S9|4", "CH1_ProcessTag2"
BLOCK_2023 = "CH1_ActProgramBlock"
SIGNALS_2022 = ("DES_POS", "VEL_FFW", "TORQUE_FFW", "CONT_DEV", "ENC1_POS", "ENC2_POS", "CURRENT")
SIGNALS_2023 = {"v": "v_dir_lp", "a": "a_dir_lp", "fm": "FM_lp", "fb": "FB_dir_lp"}


def scan_2022(spark: SparkSession, path: str, columns: Sequence[str], series: str = "file",
              index_type: str = "bigint", line: str | None = None) -> DataFrame:
    """Numbered-axis layout: series, idx, ts, cycle, axis, tag and the wanted `{signal}|{axis}` columns; the `line` on request."""
    types = {TIME_2022: "string", CYCLE_2022: "bigint", AXIS_2022: "int", TAG_2022: "string",
             **{c: "double" for c in columns}}
    names = {TIME_2022: "ts", CYCLE_2022: "cycle", AXIS_2022: "axis", TAG_2022: "tag"}
    df = scan_signals(spark, path, types, "idx", names, index_type=index_type, line=line)
    return df.withColumn("ts", parse_time(F.col("ts"))).select(F.lit(series).alias("series"), "*")


def scan_2023(spark: SparkSession, path: str, axes: Sequence[str] = ("X", "Y", "Z"), series: str = "file",
              index_type: str = "bigint", line: str | None = None) -> DataFrame:
    """Lettered-axis layout: series, idx, ts, tag, block and `{axis}1_...` columns, in file order by idx, or by `line` on request."""
    types = {TIME_2023: "string", TAG_2023: "string", BLOCK_2023: "string",
             **{f"{a}1_{s}": "double" for a in axes for s in SIGNALS_2023.values()}}
    df = scan_signals(spark, path, types, "idx", {TIME_2023: "ts", TAG_2023: "tag", BLOCK_2023: "block"},
                      index_type=index_type, line=line)
    return df.withColumn("ts", parse_time(F.col("ts"))).select(F.lit(series).alias("series"), "*")


def long_2023(df: DataFrame, axes: Sequence[str] = ("X", "Y", "Z"), order: str = "idx") -> DataFrame:
    """One row per index (or other order column) and axis: series, axis, cycle, ts, tag, v, a, fm, fb."""
    rows = [F.struct(F.lit(a).alias("axis"), *[named(f"{a}1_{s}").alias(n) for n, s in SIGNALS_2023.items()])
            for a in axes]
    return df.select("series", named(order).alias("cycle"), "ts", "tag", F.inline(F.array(*rows)))
