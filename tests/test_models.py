import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.operators import model, score, search, series, split

SPEC = series.SeriesSpec(("series",), "cycle")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    rows = [("s", i, float(v), float(a), float(3 * v + (a > 0.5)))
            for i, (v, a) in enumerate(zip(rng.normal(size=600), rng.random(600)))]
    df = spark.createDataFrame(rows, "series string, pos bigint, v double, a double, fr double")
    return split.hold_out(df, ["pos"])


@pytest.mark.parametrize("name", ["XGBoost", "RandomForrest", "DecisionTree"])
def test_models_learn(data, name):
    vectors = model.assemble(data, ["v", "a"])
    estimator = model.MODELS[name]({"max_depth": 5, "n_estimators": 10, "learning_rate": 0.3}, "fr")
    _, predicted = model.fit_predict(vectors, estimator, ~F.col("is_test"), "fr")
    assert predicted.count() == 600
    rated = score.metrics(predicted, "fr", "y_pred", by=["is_test"]).collect()
    assert len(rated) == 2 and all(r.mae < 1.0 for r in rated)


def test_parameters_reach_the_model():
    trees = model.boosted_trees({"max_depth": 7, "min_child_weight": 3, "learning_rate": 0.06, "subsample": 0.7,
                                 "colsample_bytree": 0.5, "colsample_bylevel": 0.5}, "fr")
    assert (trees.getMaxDepth(), trees.getMinInstancesPerNode(), trees.getStepSize(), trees.getSubsamplingRate()) == (7, 3, 0.06, 0.7)
    assert trees.getFeatureSubsetStrategy() == "0.25"


def test_incomplete_rows(spark):
    df = spark.createDataFrame([(1.0, [1.0, 2.0]), (None, [1.0, 2.0]), (1.0, [None, 2.0]), (1.0, [float("nan"), 2.0])],
                               "x double, l array<double>")
    assert model.assemble(df, ["x", "l"], warmup="drop").count() == 1
    kept = [list(r[model.FEATURES]) for r in model.assemble(df, ["x", "l"]).collect()]
    assert kept == [[1.0, 1.0, 2.0], [model.LOWEST, 1.0, 2.0], [1.0, model.LOWEST, 2.0], [1.0, model.LOWEST, 2.0]]


def test_importances_sum_to_one(spark, data):
    vectors = model.assemble(data, ["v", "a"])
    fitted, _ = model.fit_predict(vectors, model.decision_tree({"max_depth": 4}, "fr"), F.lit(True), "fr")
    table = model.importances(spark, fitted, ["v", "a"]).orderBy("rank").collect()
    assert [r.name for r in table] == ["v", "a"] and abs(sum(r.importance for r in table) - 1) < 1e-9


def test_random_search_reports_what_it_used(data):
    space = {"max_depth": [2, 4], "learning_rate": [0.3], "n_estimators": [3], "shifting": [0, 1], "step_size": [2], "forward": [0, 1],
             "scaling": [0, 1], "scaling_method": ["MinMax", "Standard"]}
    found = search.RandomSearch(space, 4, ["v", "a"], threshold=1.0).fit_predict(data, SPEC, ["v", "a"], "fr")
    scores = found.scores.orderBy("candidate").collect()
    assert len(scores) == 4 and found.best_score == min(r.worst_error for r in scores)
    assert abs(found.score.summary.first().worst_error - found.best_score) < 1e-9
    again = search.RandomSearch(space, 4, ["v", "a"], threshold=1.0).fit_predict(data, SPEC, ["v", "a"], "fr")
    assert again.best_params == found.best_params and abs(again.best_score - found.best_score) < 1e-9


def test_broken_predictions_never_win(spark):
    known = spark.createDataFrame([(1.0, 3.0), (2.0, None)], "fr double, y_pred double")
    rate = model.WorstErrorEvaluator("fr", "y_pred")
    assert rate.evaluate(known) == float("inf") and rate.evaluate(known.limit(0)) == float("inf")
    assert rate.evaluate(known.dropna()) == 2.0


def test_importances_need_all_names(spark, data):
    fitted, _ = model.fit_predict(model.assemble(data, ["v", "a"]), model.decision_tree({"max_depth": 2}, "fr"), F.lit(True), "fr")
    with pytest.raises(ValueError):
        model.importances(spark, fitted, ["v"])


def test_scaler_chain_in_the_search(data):
    space = {"max_depth": [3], "n_estimators": [2], "scaling": [1], "scaling_method": ["Standard"], "shifting": [0]}
    plain, chain = (search.RandomSearch(space, 1, ["v"], threshold=1.0, scale_first=first).fit_predict(data, SPEC, ["v", "a"], "fr")
                    for first in ((), ("Robust",)))
    # Trees do not mind affine scaling, so the score on the original scale is the same.
    assert abs(plain.best_score - chain.best_score) < 1e-6


def test_baseline_search_does_not_grow_with_candidates(spark, data):
    space = {"signal": ["v", "a"], "step_size": search.Whole(0, 3), "threshold": search.LogUniform(0.1, 5.0)}
    few, many = (search.baseline_search(data, SPEC, "fr", ["v", "a"], search.sample_candidates(spark, space, n)) for n in (5, 400))
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(many) < 1.2 * size(few)
    rows = {r.candidate: r for r in many.collect()}
    assert len(rows) == 400 and all(rows[r.candidate] == r for r in few.collect())
    pdf = data.toPandas().sort_values("pos")
    for r in list(rows.values())[:20]:
        x = pdf[r.signal].shift(r.step_size, fill_value=0.0) if r.step_size else pdf[r.signal]
        err = (pdf.fr - np.polyval(np.polyfit(x, pdf.fr, 1), x)).abs()
        assert r.n_rows == 600 and abs(r.worst_error - err.max()) < 1e-9 and r.n_over == (err > r.threshold).sum()


def test_fold_search_prefers_the_smaller_worst_error(spark, data):
    folds = data.withColumn("fold", split.fold_number(F.col("pos"), F.lit(600), 5))
    vectors = model.assemble(folds, ["v", "a"])
    candidates = [{"max_depth": 1}, {"max_depth": 6}]
    found = search.cross_validate(vectors, model.decision_tree, candidates, "fr")
    scores = search.fold_scores(spark, found, candidates).orderBy("candidate").collect()
    assert scores[1].mean_worst_error < scores[0].mean_worst_error
    assert found.bestModel.getMaxDepth() == 6
