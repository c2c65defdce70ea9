"""Lag, lead and difference features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.functions.scalar import named
from signalloom.operators.series import Feature, SeriesSpec, add_features


def _shift(kind: str, column: str, k: int, default: float | None) -> Feature:
    edge = "NULL" if default is None else f"{float(default)!r}D"
    name = column.replace("`", "``")
    back, ahead = (k, 0) if kind == "lag" else (0, k)
    return Feature(f"{column}_{'-' if back else '+'}{k}", back, ahead,
                   lambda frame: F.expr(f"{kind}(`{name}`, {k}, {edge}) {frame.clause}"))


def shift_features(columns: Sequence[str], steps: int, both: bool = False,
                   default: float | None = 0.0) -> list[Feature]:
    """`{column}_-{k}` (and `{column}_+{k}`) for k = 1..steps.

    The default stands in where the series has no such row; a null value of an
    existing row stays null.
    """
    out: list[Feature] = []
    for k in range(1, steps + 1):
        out += [_shift("lag", c, k, default) for c in columns]
        if both:
            out += [_shift("lead", c, k, default) for c in columns]
    return out


def add_shifts(df: DataFrame, spec: SeriesSpec, columns: Sequence[str], steps: int, both: bool = False,
               default: float | None = 0.0, pos: str = "pos") -> DataFrame:
    """Original columns plus shifted copies, named by step."""
    return add_features(df, spec, shift_features(columns, steps, both, default), pos)


def lag_array_features(columns: Sequence[str], steps: int, default: float = 0.0) -> list[Feature]:
    """All lags of a signal as one array column `{column}_lags`, nearest first.

    For models with many lags: one wide column in place of hundreds of narrow
    ones. Edge rows are padded with the default like the named form; a missing
    value is NaN.
    """
    def build(c: str):
        def column(frame) -> Column:
            value = F.coalesce(named(c).cast("double"), F.lit(float("nan")))
            seen = F.collect_list(value).over(frame.ordered().rowsBetween(-steps, -1))
            return F.concat(F.reverse(seen), F.array_repeat(F.lit(float(default)), F.lit(steps) - F.size(seen)))
        return column

    return [Feature(f"{c}_lags", steps, 0, build(c)) for c in columns]


def lag_names(columns: Sequence[str], steps: int) -> list[str]:
    """Names of the lags in the arrays, in array order."""
    return [f"{c}_-{k}" for c in columns for k in range(1, steps + 1)]


def difference_features(columns: Sequence[str]) -> list[Feature]:
    """First difference `{column}_diff`; null on the first row."""
    def build(c: str):
        return lambda frame: named(c) - F.lag(named(c)).over(frame.ordered())

    return [Feature(f"{c}_diff", 1, 0, build(c)) for c in columns]


def undo_difference_features(differences: dict[str, str]) -> list[Feature]:
    """Add the previous original value back to each difference: {difference: original}."""
    def build(d: str, c: str):
        return lambda frame: named(d) + F.lag(named(c)).over(frame.ordered())

    return [Feature(f"{d}_undone", 1, 0, build(d, c)) for d, c in differences.items()]
