"""Scoring by worst error and by rows over a threshold; a least-squares baseline."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions.scalar import absolute_error, exceeds, named
from signalloom.operators.scale import Scaler
from signalloom.operators.series import attach, ranked
from signalloom.session import cut

def worst(error: Column) -> Column:
    """Largest error; null as soon as one error is missing."""
    return _known(error, F.max(error))


def _known(error: Column, value: Column) -> Column:
    return F.when(F.count_if(error.isNull() | F.isnan(error)) == 0, value)


def metrics(df: DataFrame, actual: str, predicted: str, threshold: float = 200.0, by: Sequence[str] = ()) -> DataFrame:
    """Rows, worst error, rows over the threshold, mean squared and mean absolute error in one pass.

    As soon as one error is missing, all three errors are null.
    """
    error = absolute_error(named(actual), named(predicted))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), worst(error).alias("worst_error"),
        F.count_if(exceeds(error, threshold)).alias("n_over"),
        _known(error, F.avg(error * error)).alias("mse"), _known(error, F.avg(error)).alias("mae"))


def outliers(df: DataFrame, error: str = "err", threshold: float = 200.0, pos: str = "pos",
             by: Sequence[str] = ()) -> DataFrame:
    """All rows over the threshold with their rank, worst first; equal errors by position.

    Only the survivors are sorted, in a distributed way, however many they are.
    They are written first, as the sort reads its input twice.
    """
    over = cut(df.filter(exceeds(named(error), threshold)), "outliers")
    return ranked(over, [named(error).desc(), named(pos).asc()], "rank", by)


#: Ranks up to which Spark cuts groups down before they are shuffled (spark.sql.optimizer.windowGroupLimitThreshold).
PRUNED = 1000


def worst_rows(df: DataFrame, k: int, error: str = "err", pos: str = "pos", by: Sequence[str] = ()) -> DataFrame:
    """The k rows of largest error with their `rank`, overall or per group.

    Tasks hand on k rows at most, overall or of each group; only for more than `PRUNED`
    rows of each group, all rows are sorted, in a distributed way.
    """
    known = df.filter(named(error).isNotNull() & ~F.isnan(named(error)))
    order = [named(error).desc(), named(pos).asc()]
    if by and k > PRUNED:
        return ranked(known, order, "rank", by).filter(F.col("rank") <= k)
    if not by:
        known = known.orderBy(*order).limit(k)
    place = F.row_number().over(Window.partitionBy(*[named(c) for c in by]).orderBy(*order))
    return known.withColumn("rank", place).filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


@dataclass(frozen=True)
class Score:
    """Rated predictions; the score table and the ranked outliers are built when asked for."""

    predictions: DataFrame
    actual: str
    predicted: str
    threshold: float
    pos: str
    by: tuple[str, ...]

    @cached_property
    def summary(self) -> DataFrame:
        return metrics(self.predictions, self.actual, self.predicted, self.threshold, self.by)

    @cached_property
    def outliers(self) -> DataFrame:
        return outliers(self.predictions, "err", self.threshold, self.pos, self.by)


def score(df: DataFrame, actual: str, predicted: str, threshold: float = 200.0, pos: str = "pos",
          by: Sequence[str] = (), scaler: Scaler | None = None, scaled_as: str | None = None) -> Score:
    """Undo target scaling if there was any, then rate the predictions.

    `scaled_as` is the column name the target scaler was fitted under.
    """
    if scaler is not None:
        name = scaled_as or actual
        df = df.withColumn(actual, scaler.backward(name, named(actual))).withColumn(
            predicted, scaler.backward(name, named(predicted)))
    rated = df.withColumn("err", absolute_error(named(actual), named(predicted)))
    return Score(rated, actual, predicted, threshold, pos, tuple(by))


def baseline(df: DataFrame, target: str, feature: str, by: Sequence[str] = (), out: str = "y_pred",
             train: Column | None = None) -> DataFrame:
    """Least squares of the target on one feature, per group, fitted by one aggregate.

    `train` restricts the fit; the prediction covers all rows.
    """
    used = df if train is None else df.filter(train)
    line = used.groupBy(*by).agg(F.regr_slope(named(target), named(feature)).alias("__slope"),
                                 F.regr_intercept(named(target), named(feature)).alias("__base"))
    if by:
        joined = attach(df, line, by, "left")
        return joined.withColumn(out, F.col("__slope") * named(feature) + F.col("__base")).drop("__slope", "__base")
    slope, base = line.first()
    return df.withColumn(out, F.lit(slope).cast("double") * named(feature) + F.lit(base).cast("double"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson matrix in long form (a, b, r); each pair uses the rows where both are known."""
    pair = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                                 F.corr(named(a).cast("double"), named(b).cast("double")).alias("r"))
    upper = [pair(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    table = df.agg(F.array(*upper).alias("e")).select(F.inline("e"))
    mirrored = F.array(F.struct("a", "b", "r"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    return table.select(F.explode(F.when(F.col("a") == F.col("b"), F.slice(mirrored, 1, 1)).otherwise(mirrored)).alias("m")
                        ).select("m.*")


def value_counts(df: DataFrame, predicate: Column, name: str = "hit") -> DataFrame:
    return df.groupBy(predicate.alias(name)).agg(F.count(F.lit(1)).alias("n_rows"))
