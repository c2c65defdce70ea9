"""Fixed-length windows of rows as arrays, for sequence models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.functions.scalar import named
from signalloom.operators.series import Feature, SeriesSpec, add_features


def _rows(columns: Sequence[str]):
    # Wrapped in a struct because a bare collect_list leaves nulls out.
    return F.collect_list(F.struct(*[named(c).alias(c) for c in columns]))


def supervised_windows(df: DataFrame, spec: SeriesSpec, columns: Sequence[str], target: str, steps: int,
                       pos: str = "pos") -> DataFrame:
    """One row per position from `steps` on: the `steps` rows before it and its target.

    Gives n - steps rows per series, with `window array<struct>` and the target.
    """
    feature = Feature("window", steps, 0, lambda f: _rows(columns).over(f.ordered().rowsBetween(-steps, -1)))
    out = add_features(df.select(*[named(c) for c in dict.fromkeys((*spec.keys, pos, *columns, target))]),
                       spec, [feature], pos)
    return out.filter(F.size("window") == steps).select(*spec.keys, pos, "window", named(target))


def multistep_windows(df: DataFrame, spec: SeriesSpec, column: str, steps_in: int, steps_out: int,
                      pos: str = "pos") -> DataFrame:
    """`steps_in` values from each position on and the `steps_out` values after them.

    Gives n - steps_in - steps_out + 1 rows per series.
    """
    reach = steps_in + steps_out - 1
    features = [
        Feature("inputs", 0, reach, lambda f: _rows([column]).over(f.ordered().rowsBetween(0, steps_in - 1))),
        Feature("targets", 0, reach, lambda f: _rows([column]).over(f.ordered().rowsBetween(steps_in, reach))),
    ]
    out = add_features(df.select(*spec.keys, pos, named(column)), spec, features, pos)
    plain = [F.transform(c, lambda s: s[column]).alias(c) for c in ("inputs", "targets")]
    return (out.filter((F.size("inputs") == steps_in) & (F.size("targets") == steps_out))
            .select(*spec.keys, pos, *plain))
