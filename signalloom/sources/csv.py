"""CSV scans of signal files, and the result files."""

from __future__ import annotations

from collections.abc import Sequence
from csv import reader

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalloom.functions.scalar import MISSING_TEXT, named, null_nan, null_text
from signalloom.operators.series import attach
from signalloom.session import cut

MAX_PARTS = 99_999  # names of parts have five digits, so more of them would not sort by number


def _headers(spark: SparkSession, path: str) -> list[list[str]]:
    """The distinct header lines of the files under `path`, split; one row per distinct header is fetched."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"))
    first = lines.groupBy("f").agg(F.min_by("value", "i").alias("header")).select("header").distinct()
    return [next(reader([r["header"].removeprefix("\ufeff")])) for r in first.collect()]


def _whole(text: Column, kind: str) -> Column:
    """A whole number, also one written as 12.0; other fractions are an error."""
    number = text.cast("double")
    odd = number != F.floor(number)
    exact = F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), text.cast("bigint")).otherwise(number.cast("bigint"))
    return F.when(odd, F.raise_error(F.concat(F.lit("not a whole number: "), text)).cast("bigint")).otherwise(exact).cast(kind)


def _places() -> list[Column]:
    """Where a row stands: file, start of its piece of the file, and a number that grows along the piece."""
    return [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
            F.monotonically_increasing_id().alias("__at")]


def _with_lines(scanned: DataFrame, line: str, by: Sequence[str] = ()) -> DataFrame:
    """Line numbers 0, 1, ... of a scan that holds `_places`, files in the order of their paths.

    Each piece of a file is read from its start to its end by one task, so a row's line is
    the number of rows in earlier pieces plus its place in its own. The rows are written
    first, so that both come from one reading. The only ordered window runs over one row
    per piece (128 MB by default).
    """
    rows = cut(scanned, "lines")
    pieces = rows.groupBy(*by, "__file", "__block").agg(F.count(F.lit(1)).alias("__rows"), F.min("__at").alias("__start"))
    earlier = Window.partitionBy(*by).orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("__file", "__block", (F.coalesce(F.sum("__rows").over(earlier), F.lit(0)) - F.col("__start")).alias("__shift"))
    out = attach(rows, starts, ["__file", "__block"])
    kept = [c for c in scanned.columns if c not in ("__file", "__block", "__at")]
    return out.select(*[named(c) for c in kept], (F.col("__shift") + F.col("__at")).alias(line))


def scan_signals(spark: SparkSession, path: str, types: dict[str, str], index: str | None = "idx",
                 rename: dict[str, str] | None = None, tokens: Sequence[str] = MISSING_TEXT,
                 index_type: str = "bigint", line: str | None = None) -> DataFrame:
    """Read the named columns of CSV files with a header; the first column is the index.

    `types` gives a Spark type per header name, `index_type` that of the index, a number
    or a timestamp. Fields are read as text so that every missing-value token becomes
    NULL, then cast; text that does not fit its type is an error, and so is a line with
    fewer or more fields than the header. Whole numbers may be written as 12.0. All files
    under `path` must have the same header; the name of the index may be empty. `line` names
    a column for the line of each row, 0 for the first below the header, counted on over the
    files in the order of their paths: a dense order key where the index repeats.
    """
    headers = _headers(spark, path)
    if len(headers) != 1:
        raise ValueError(f"{len(headers)} different headers under {path}" if headers else f"no header under {path}")
    names = [n or f"_c{i}" for i, n in enumerate(headers[0])]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.schema(schema).option("columnPruning", False).csv(path, header=True, sep=",", mode="FAILFAST", escape='"')
    whole = ("int", "bigint", "long", "smallint")
    cast = lambda text, kind: _whole(text, kind) if kind in whole else text.cast(kind)
    rename = rename or {}
    columns = []
    if index:
        columns.append(cast(named(names[0]), index_type).alias(index))
    for name, kind in types.items():
        value = cast(null_text(named(name), tokens), kind)
        columns.append((null_nan(value) if kind == "double" else value).alias(rename.get(name, name)))
    return _with_lines(raw.select(*columns, *_places()), line) if line else raw.select(*columns)


def scan_numbers(spark: SparkSession, path: str, columns: dict[str, str], partitioned_by: dict[str, str] | None = None,
                 line: str | None = None) -> DataFrame:
    """Read headerless numeric CSV files; a Spark type per column, and per folder column such as a lettered axis.

    `line` names a column for the line of each row, from 0 in each folder, files in the order of their names.
    """
    keys = partitioned_by or {}
    # Numbers are read as doubles, as whole ones may have a fraction of zero.
    schema = ", ".join([*(f"`{c}` double" for c in columns), *(f"`{k}` {t}" for k, t in keys.items())])
    raw = spark.read.schema(schema).csv(path, header=False, sep=",", mode="FAILFAST")
    wanted = [*[named(k) for k in keys], *[named(c).cast(t).alias(c) for c, t in columns.items()]]
    return _with_lines(raw.select(*wanted, *_places()), line, tuple(keys)) if line else raw.select(*wanted)


def _in_order(df: DataFrame, *order: str) -> DataFrame:
    """Rows sorted over all parts: the parts, in the order of their names, concatenate to the sorted table."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if parts > MAX_PARTS:
        raise ValueError(f"names of more than {MAX_PARTS} parts do not sort by number")
    return df.orderBy(*[named(c) for c in order])


def _write_column(df: DataFrame, path: str, axis: str, order: str, column: str) -> None:
    """A headerless column in a folder per axis, in row order by the names of its parts."""
    # A text axis that may be null would be sorted again by the writer, by the axis alone.
    folder = named(axis)
    if isinstance(df.schema[axis].dataType, T.StringType):
        folder = F.coalesce(folder, F.lit("__HIVE_DEFAULT_PARTITION__"))
    rows = df.select(folder.alias(axis), named(order).alias("__order"), named(column).alias("__value"))
    (_in_order(rows, axis, "__order").select(named(axis), F.col("__value").alias(column))
     .write.partitionBy(axis).mode("errorifexists").csv(path, header=False))


def write_predictions(df: DataFrame, path: str, pos: str = "pos", predicted: str = "y_pred",
                      axis: str = "axis", in_order: bool = False) -> None:
    """One `pos,prediction` line per row without header, in a folder per axis.

    Files of a distributed write have no common order, so the position is kept. With
    `in_order` the lines hold the prediction alone: rows are sorted by position over all
    parts, and the parts of a folder, in the order of their names, concatenate to one
    file with a line per position.
    """
    if in_order:
        return _write_column(df, path, axis, pos, predicted)
    (df.select(named(axis), named(pos).alias("pos"), named(predicted).alias("y_pred"))
     .write.partitionBy(axis).mode("errorifexists").csv(path, header=False))


def write_outliers(df: DataFrame, path: str, rank: str = "rank", pos: str = "pos", axis: str = "axis",
                   in_order: bool = False) -> None:
    """One `rank,pos` line per outlier without header, worst first by rank; with `in_order` the position alone, in that order."""
    if in_order:
        return _write_column(df, path, axis, rank, pos)
    (df.select(named(axis), named(rank).alias("rank"), named(pos).alias("pos"))
     .write.partitionBy(axis).mode("errorifexists").csv(path, header=False))


def write_signals(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """CSV with header, missing values as the text `nan`; sorted over all parts by `order`, if given."""
    (_in_order(df, *order) if order else df).write.mode("errorifexists").csv(path, header=True, nullValue="nan")
