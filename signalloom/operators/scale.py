"""Affine scalers: fitted by one aggregate, applied as plain column arithmetic.

Every scaler maps x to (x - center) / scale, so chains collapse into one pair of
numbers per column and inverses are exact. The definitions differ from MLlib's
on purpose: population deviation, and zero ranges divide by one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.functions.scalar import named, null_nan
from signalloom.operators.quantile import exact_quantiles
from signalloom.operators.series import attach, join_groups

# Accepted scaler names and what they mean.
METHODS = {
    "MinMax": "unit", "MinMax()": "unit", "MinMax(0,1)": "unit", "MinMax(0.1)": "unit",
    "MinMax(-1.1)": "symmetric",
    "Standard": "standard",
    "Robust": "robust",
}


def scaler_kind(method: str) -> str:
    """Scaler for a name; unknown names raise ValueError."""
    if method not in METHODS:
        raise ValueError(f"unknown scaling method {method!r}")
    return METHODS[method]


def column_statistics(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), quartiles: bool = True) -> DataFrame:
    """(by..., name, min, max, mean, std, q25, median, q75), one row per column; std is the population one.

    Nulls and NaN are left out of all of them.
    """
    def moments(c: str) -> Column:
        x = null_nan(named(c).cast("double"))
        return F.struct(F.lit(c).alias("name"), F.min(x).alias("min"), F.max(x).alias("max"),
                        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))

    table = (df.groupBy(*by).agg(F.array(*[moments(c) for c in columns]).alias("e"))
             .select(*by, F.inline("e")))
    if not quartiles:
        return table
    spread = (exact_quantiles(df, columns, [0.25, 0.5, 0.75], by).groupBy(*by, "name")
              .agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n)
                     for p, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))]))
    return join_groups(table, spread, [*by, "name"], "left")


def _pair(kind: str, s: dict[str, Column]) -> tuple[Column, Column]:
    """(center, scale) of one scaler from the statistics of its input."""
    one = lambda width: F.when(width == 0, F.lit(1.0)).otherwise(width)
    if kind == "unit":
        return s["min"], one(s["max"] - s["min"])
    if kind == "symmetric":
        half = one(s["max"] - s["min"]) / 2
        return s["min"] + half, half
    if kind == "standard":
        return s["mean"], one(s["std"])
    return s["median"], one(s["q75"] - s["q25"])


def scaling_table(df: DataFrame, columns: Sequence[str], methods: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., name, center, scale) of a chain of scalers.

    Later scalers of the chain see scaled values. Their statistics follow from
    the first ones because all maps are affine and rising, so one pass is enough.
    """
    kinds = [scaler_kind(m) for m in methods]
    stats = column_statistics(df, columns, by, "robust" in kinds)
    center, scale = F.lit(0.0), F.lit(1.0)
    for kind in kinds:
        seen = {}
        for n in ("min", "max", "mean", "q25", "median", "q75"):
            if n in stats.columns:
                seen[n] = (F.col(n) - center) / scale
        seen["std"] = F.col("std") / scale
        c, s = _pair(kind, seen)
        center, scale = center + scale * c, scale * s
    return stats.select(*by, "name", center.alias("center"), scale.alias("scale"))


@dataclass(frozen=True)
class Scaler:
    """Fitted scaler; apply and invert are pure expressions."""

    center: dict[str, float]
    scale: dict[str, float]

    @staticmethod
    def fit(df: DataFrame, columns: Sequence[str], methods: Sequence[str]) -> "Scaler":
        """Two numbers per column come to the driver."""
        rows = scaling_table(df, columns, methods).collect()
        return Scaler({r["name"]: r["center"] for r in rows}, {r["name"]: r["scale"] for r in rows})

    def forward(self, column: str, value: Column | None = None) -> Column:
        x = named(column) if value is None else value
        return (x - F.lit(self.center[column])) / F.lit(self.scale[column])

    def backward(self, column: str, value: Column | None = None) -> Column:
        z = named(column) if value is None else value
        return z * F.lit(self.scale[column]) + F.lit(self.center[column])

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[self.forward(c).alias(c) if c in self.center else named(c) for c in df.columns])

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.select(*[self.backward(c).alias(c) if c in self.center else named(c) for c in df.columns])


def scale_by(df: DataFrame, columns: Sequence[str], methods: Sequence[str], by: Sequence[str],
             invert: bool = False, fitted: DataFrame | None = None) -> DataFrame:
    """Scale each group with its own statistics, such as train and test apart.

    `fitted` is a table of `scaling_table`; with `invert` the same table undoes it.
    """
    table = scaling_table(df, columns, methods, by) if fitted is None else fitted
    wide = table.groupBy(*by).agg(*[
        F.max(F.when(F.col("name") == c, F.col(part))).alias(f"__{part}{i}")
        for i, c in enumerate(columns) for part in ("center", "scale")])
    joined = attach(df, wide, by)

    def value(c: str) -> Column:
        if c not in columns:
            return named(c)
        i = list(columns).index(c)
        center, scale = F.col(f"__center{i}"), F.col(f"__scale{i}")
        return (named(c) * scale + center if invert else (named(c) - center) / scale).alias(c)

    return joined.select(*[value(c) for c in df.columns])
