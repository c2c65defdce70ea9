"""Tree regressors on feature columns, by way of MLlib."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalloom.functions.scalar import named
from signalloom.operators.score import worst

FEATURES = "__features"
LOWEST = -1e300
MAX_BINS = 256  # candidate splits per feature; a setting may give another number
# What the feature-subset names of forests mean in MLlib.
SUBSETS = {"auto": "all", "sqrt": "sqrt", "log2": "log2"}


def assemble(df: DataFrame, columns: Sequence[str], warmup: str = "keep") -> DataFrame:
    """Gather feature columns, numbers or arrays of numbers, into one vector.

    Rows with missing features, such as the first rows of a rolling window, are
    kept: a missing value becomes one below all others, which a tree can split
    off. With `warmup="drop"` such rows are left out.
    """
    missing = F.lit(LOWEST)
    known = lambda x: F.coalesce(F.nanvl(x, missing), missing)
    parts, numbers = [], []
    for c in columns:
        if isinstance(df.schema[c].dataType, T.ArrayType):
            parts.append(F.transform(named(c), known))
        else:
            numbers.append(known(named(c).cast("double")))
    values = F.concat(F.array(*numbers), *parts) if parts else F.array(*numbers)
    wide = df.withColumn(FEATURES, values)
    if warmup == "drop":
        wide = wide.filter(~F.array_contains(FEATURES, missing))
    return wide.withColumn(FEATURES, array_to_vector(FEATURES))


def boosted_trees(params: Mapping[str, Any], target: str, seed: int = 1, out: str = "y_pred") -> GBTRegressor:
    """Boosted trees. Both column-sampling shares act per node here, so they multiply."""
    columns = float(params.get("colsample_bytree", 1.0)) * float(params.get("colsample_bylevel", 1.0))
    return GBTRegressor(
        featuresCol=FEATURES, labelCol=target, predictionCol=out, seed=seed,
        stepSize=float(params.get("learning_rate", 0.3)), maxBins=int(params.get("max_bins", MAX_BINS)), subsamplingRate=float(params.get("subsample", 1.0)),
        featureSubsetStrategy="all" if columns >= 1 else str(columns),
        maxDepth=int(params.get("max_depth", 6)), minInstancesPerNode=int(params.get("min_child_weight", 1)),
        maxIter=int(params.get("n_estimators", 100)))


def forest(params: Mapping[str, Any], target: str, seed: int = 1, out: str = "y_pred") -> RandomForestRegressor:
    leaf = max(int(params.get("min_samples_leaf", 1)), int(params.get("min_samples_split", 2)) // 2)
    return RandomForestRegressor(
        featuresCol=FEATURES, labelCol=target, predictionCol=out, seed=seed,
        numTrees=int(params.get("n_estimators", 100)), maxDepth=int(params.get("max_depth", 10)),
        minInstancesPerNode=leaf, maxBins=int(params.get("max_bins", MAX_BINS)), bootstrap=bool(params.get("bootstrap", True)),
        featureSubsetStrategy=SUBSETS[params.get("max_features", "auto")])


def decision_tree(params: Mapping[str, Any], target: str, seed: int = 1, out: str = "y_pred") -> DecisionTreeRegressor:
    return DecisionTreeRegressor(
        featuresCol=FEATURES, labelCol=target, predictionCol=out, seed=seed,
        maxDepth=int(params.get("max_depth", 10)), minInstancesPerNode=int(params.get("min_samples_leaf", 1)),
        maxBins=int(params.get("max_bins", MAX_BINS)))


# Estimator names as the entry scripts give them.
MODELS = {"XGBoost": boosted_trees, "RandomForrest": forest, "DecisionTree": decision_tree}


def fit_predict(df: DataFrame, estimator, train, target: str) -> tuple[Any, DataFrame]:
    """Fit on the rows that `train` selects and predict all rows of `df`."""
    model = estimator.fit(df.filter(train).filter(named(target).isNotNull()))
    return model, model.transform(df)


def importances(spark, model, columns: Sequence[str]) -> DataFrame:
    """(rank, name, importance), most important first, names ascending on ties.

    One name per vector entry: plain columns first, then the entries of arrays.
    """
    values = [float(v) for v in model.featureImportances.toArray()]
    table = spark.createDataFrame(list(zip(columns, values, strict=True)), "name string, importance double")
    place = F.row_number().over(Window.orderBy(F.col("importance").desc(), "name"))
    return table.select(place.alias("rank"), "name", "importance")


def top_features(ranking: DataFrame, k: int = 10) -> DataFrame:
    return ranking.orderBy("rank").limit(k)


class WorstErrorEvaluator(Evaluator):
    """Largest absolute error, for model selection; smaller is better.

    Infinite as soon as one prediction is missing, or where there is no row.
    """

    labelCol = Param(Params._dummy(), "labelCol", "target column", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "prediction column", TypeConverters.toString)

    def __init__(self, labelCol: str = "label", predictionCol: str = "y_pred"):
        super().__init__()
        self._set(labelCol=labelCol, predictionCol=predictionCol)

    def _evaluate(self, dataset: DataFrame) -> float:
        error = F.abs(named(self.getOrDefault("labelCol")) - named(self.getOrDefault("predictionCol")))
        value = dataset.agg(worst(error)).first()[0]
        return float("inf") if value is None else float(value)

    def isLargerBetter(self) -> bool:
        return False
