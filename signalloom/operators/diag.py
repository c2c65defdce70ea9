"""Tables behind the diagnostic figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.functions.scalar import exceeds, named
from signalloom.session import cut


def comparison(df: DataFrame, actual: str, predicted: str, over: dict[str, str], threshold: float = 200.0,
               keep: Sequence[str] = ()) -> DataFrame:
    """Measured and predicted values, and those that differ most, over several x columns.

    Long form (keep..., x_kind, x, series, y); `over` maps x kinds to columns.
    Each input row is read once and expands to at most three rows per x kind.
    """
    error = F.abs(named(actual) - named(predicted))
    def entry(kind: str, column: str, series: str, y: str):
        return F.struct(F.lit(kind).alias("x_kind"), named(column).cast("double").alias("x"),
                        F.lit(series).alias("series"), named(y).cast("double").alias("y"))

    entries = []
    for kind, column in over.items():
        entries += [entry(kind, column, "measured", actual), entry(kind, column, "predicted", predicted),
                    F.when(exceeds(error, threshold), entry(kind, column, "most difference", actual))]
    return df.select(*keep, F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))


def scatter_counts(df: DataFrame, x: str, y: str, width: float, by: Sequence[str] = ()) -> DataFrame:
    """Measured against predicted as counts per square cell, so a figure of any table stays small."""
    cell = lambda c: F.floor(named(c) / F.lit(width)).cast("bigint")
    return df.groupBy(*by, cell(x).alias("x_cell"), cell(y).alias("y_cell")).agg(F.count(F.lit(1)).alias("n_rows"))


def pyramid(df: DataFrame, values: Sequence[str], by: Sequence[str] = (), pos: str = "pos", base: int = 64, fan: int = 8) -> DataFrame:
    """Least and greatest value per cell of positions, in levels of ever wider cells.

    (by..., level, cell, n_rows, {value}_min, {value}_max). Cells of level k hold `base` x `fan`^k
    positions, up to the level at which one cell holds the longest series. The cells of
    level 0 are counted from the rows and written; each then counts in all levels at once,
    so there is one further grouping, of 1/base of the rows, whatever the number of levels.
    Nulls are left out; a cell of nulls only has null ends.
    """
    ends = [f for v in values for f in (F.min(named(v)).alias(f"{v}_min"), F.max(named(v)).alias(f"{v}_max"))]
    cell = F.expr(f"`{pos}` div {base}L").alias("cell")
    cells = cut(df.groupBy(*[named(k) for k in by], cell).agg(F.count(F.lit(1)).alias("n_rows"), *ends), "cells")
    widths, top = [1], cells.agg(F.max("cell")).first()[0] or 0
    while top // widths[-1] > 0:
        widths.append(widths[-1] * fan)
    levels = [F.struct(F.lit(i).alias("level"), F.expr(f"cell div {w}L").alias("__cell")) for i, w in enumerate(widths)]
    merged = [f for v in values for f in (F.min(named(f"{v}_min")).alias(f"{v}_min"), F.max(named(f"{v}_max")).alias(f"{v}_max"))]
    return (cells.select("*", F.inline(F.array(*levels)))
            .groupBy(*[named(k) for k in by], "level", F.col("__cell").alias("cell")).agg(F.sum("n_rows").alias("n_rows"), *merged))


def write_pyramid(cells: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """A folder per level, in it cells in order of series and place, so that a figure reads few row groups."""
    (cells.repartitionByRange(*[named(c) for c in ("level", *by, "cell")]).sortWithinPartitions(*[named(c) for c in ("level", *by, "cell")])
     .write.partitionBy("level").mode("errorifexists").parquet(path))


def zoom_level(n_rows: int, cells: int, base: int = 64, fan: int = 8) -> int:
    """The finest level at which any `n_rows` positions touch at most `cells` cells."""
    if cells < 2:
        raise ValueError("a window can touch two cells at any level")
    level, width = 0, base
    while -(-(n_rows - 1) // width) + 1 > cells:
        level, width = level + 1, width * fan
    return level


def zoomed(cells: DataFrame, start: int, stop: int, most: int = 2000, base: int = 64, fan: int = 8) -> DataFrame:
    """The cells of a figure over positions start..stop-1 of each series, `most` per series at most, with `start` and `stop` of each.

    Every extreme of the range is in it; cells at the edges hold rows beyond them too. A range beyond the widest level
    is shown by that level, which has one cell.
    """
    if stop <= start:
        return cells.where(F.lit(False)).withColumns({"start": F.col("cell"), "stop": F.col("cell")})
    level = zoom_level(stop - start, most, base, fan)
    top = cells.agg(F.max("level")).first()[0]
    level = level if top is None else min(level, top)
    width = base * fan ** level
    return (cells.where((F.col("level") == level) & F.col("cell").between(start // width, (stop - 1) // width))
            .withColumns({"start": F.col("cell") * width, "stop": (F.col("cell") + 1) * width}))
