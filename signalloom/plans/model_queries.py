"""Predictors, candidate search and whole analyses."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from signalloom.functions.scalar import named
from signalloom.operators import lowpass, model, project, quantile, rolling, scale, score, search, sequence, series, shift, split, trees
from signalloom.plans import prepare, spaces
from signalloom.plans.clean_queries import OUTLIERS
from signalloom.plans.feature_queries import _low_pass_sql
from signalloom.plans.registry import (RUN, THRESHOLD, predicted_of, query, rnd, run_of, signals, spec_for, sql, sql_rnd)
from signalloom.session import scratch_path
from signalloom.sources import csv, layouts


def _marked_run(spark, sf_dir):
    """Rows are marked before features are added, while they are narrow."""
    run, spec = run_of(spark, sf_dir, columns=("v", "a", "fr"))
    return split.hold_out(run, ["axis", "pos"], by=["axis"]), spec


def _marked_frame(spark, sf_dir, lags=3, both=False, sizes=(64,)):
    run, spec = _marked_run(spark, sf_dir)
    frame, names = prepare.model_frame(run, spec, lags, both, sizes)
    return frame, names, spec


def _vectors(frame, names, keep=()):
    """Feature vectors written once, as fits read their input many times."""
    return series.cut(model.assemble(frame, names).select("axis", "pos", "fr", "is_test", *[named(c) for c in keep], model.FEATURES))


def _predicted(frame, names, spec):
    """All rows, predicted by one model that learnt from those outside the test part."""
    table = trees.binned(frame.withColumn("part", F.col("is_test").cast("int")), names, "fr", ["axis", "pos"], "part")
    return trees.predictions(table, [trees.replace(spec, held=(1,))]).select("axis", "pos", F.col("y").alias("fr"), "y_pred")


#: Forests that a search over folds draws.
FORESTS = 10

# --- predictors ----------------------------------------------------------------------------


@query("l01_boosted_trees")
def boosted_trees(spark, sf_dir):
    frame, names, spec = _marked_frame(spark, sf_dir)
    predicted = _predicted(frame, names, trees.boosted(spaces.SINGLE_FIT))
    return score.score(predicted, "fr", "y_pred", THRESHOLD, by=spec.keys).summary


@query("l02_forest")
def forest(spark, sf_dir):
    frame, names, spec = _marked_frame(spark, sf_dir, both=True, sizes=())
    params = {"min_samples_leaf": 2, "max_features": "sqrt"}
    return score.metrics(_predicted(frame, names, trees.forest(params)), "fr", "y_pred", THRESHOLD, spec.keys)


def _importances(spark, sf_dir):
    frame, names, _ = _marked_frame(spark, sf_dir)
    data = _vectors(frame, names, names)
    fitted, _ = model.fit_predict(data, model.decision_tree({}, "fr"), ~F.col("is_test"), "fr")
    return model.importances(spark, fitted, names), data


@query("l03_tree_importances")
def tree_importances(spark, sf_dir):
    return _importances(spark, sf_dir)[0]


_STUMP_SQL = sql("run", f"""
SELECT a > edge AS above, count(*) AS n_rows, {sql_rnd('avg(y_pred)')} AS y_pred
FROM (SELECT *, avg(fr) OVER (PARTITION BY a > edge) AS y_pred FROM known, best) GROUP BY 1""", more="""
known AS (SELECT a, fr FROM run WHERE a IS NOT NULL AND fr IS NOT NULL),
splits AS (SELECT t.edge, count(*) FILTER (a <= t.edge) AS n1, sum(fr) FILTER (a <= t.edge) AS s1, count(*) AS n, sum(fr) AS s
           FROM known, (SELECT DISTINCT a AS edge FROM known) t GROUP BY t.edge),
best AS (SELECT arg_max(edge, s1 * s1 / n1 + (s - s1) * (s - s1) / (n - n1)) AS edge FROM splits WHERE n1 < n)""")


def _stump(spark, sf_dir, estimator):
    """Predictions of one split on a whole-number signal, whose best place SQL can find."""
    run, _ = run_of(spark, sf_dir, columns=("a", "fr"))
    known = run.select("axis", "pos", "a", "fr").dropna()
    _, predicted = model.fit_predict(series.cut(model.assemble(known, ["a"])), estimator, F.lit(True), "fr")
    low = predicted.agg(F.min_by("y_pred", "a")).first()[0]  # of the left side
    return predicted.groupBy((F.col("y_pred") != low).alias("above")).agg(
        F.count(F.lit(1)).alias("n_rows"), rnd(F.avg("y_pred")).alias("y_pred"))


_ONE_SPLIT = {"max_depth": 1, "max_bins": 4096}


@query("l01b_one_round", _STUMP_SQL)
def one_round(spark, sf_dir):
    return _stump(spark, sf_dir, model.boosted_trees({**_ONE_SPLIT, "n_estimators": 1}, "fr"))


@query("l02b_one_tree", _STUMP_SQL)
def one_tree(spark, sf_dir):
    return _stump(spark, sf_dir, model.forest({**_ONE_SPLIT, "n_estimators": 1, "bootstrap": False}, "fr"))


@query("l03b_stump", _STUMP_SQL)
def stump(spark, sf_dir):
    return _stump(spark, sf_dir, model.decision_tree(_ONE_SPLIT, "fr"))


def _tree_sql(rounds: int, depth: int, factor: float, l2: float, start: float, boosted: bool, fair: str = "TRUE", weight=lambda k: "1") -> str:
    """CTEs of models on `known` (axis, pos, a, s, fr), one level of one tree after the other; the last is `r<rounds>`."""
    parts = [f"r0 AS (SELECT axis, pos, a, s, fr, CAST({start} AS DOUBLE) AS pred FROM known)"]
    for k in range(rounds):
        parts.append(f"t{k}_0 AS MATERIALIZED (SELECT *, 1 AS node, {'pred - fr' if boosted else '-fr'} AS g, CAST({weight(k)} AS DOUBLE) AS w FROM r{k})")
        for d in range(depth):
            t = f"t{k}_{d}"
            cells = " UNION ALL ".join(f"SELECT node, {i} AS feature, {c} AS x, sum(g * w) AS g, sum(w) AS h, count(*) AS n FROM {t} WHERE w > 0 GROUP BY ALL"
                                       for i, c in enumerate(("a", "s")))
            parts += [
                f"c{k}_{d} AS ({cells})",
                f"""l{k}_{d} AS (
  SELECT *, sum(g) OVER o AS lg, sum(h) OVER o AS lh, sum(n) OVER o AS ln, sum(g) OVER p AS tg, sum(h) OVER p AS th, sum(n) OVER p AS tn
  FROM c{k}_{d} WINDOW o AS (PARTITION BY node, feature ORDER BY x), p AS (PARTITION BY node, feature))""",
                f"""b{k}_{d} AS MATERIALIZED (
  SELECT node, feature, x FROM (
    SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, x) AS place FROM (
      SELECT *, lg * lg / (lh + {l2}) + (tg - lg) * (tg - lg) / (th - lh + {l2}) - tg * tg / (th + {l2}) AS gain
      FROM l{k}_{d} WHERE ln < tn AND {fair})) WHERE place = 1 AND gain > {trees.GAIN})""",
                f"""t{k}_{d + 1} AS MATERIALIZED (
  SELECT {t}.* REPLACE (CASE WHEN b.node IS NULL THEN {t}.node ELSE 2 * {t}.node + CAST(CASE feature WHEN 0 THEN a ELSE s END > b.x AS INTEGER) END AS node)
  FROM {t} LEFT JOIN b{k}_{d} b ON b.node = {t}.node)"""]
        parts += [f"v{k} AS (SELECT node, -sum(g * w) / (sum(w) + {l2}) AS value FROM t{k}_{depth} WHERE w > 0 GROUP BY node)",
                  f"r{k + 1} AS (SELECT axis, pos, a, s, fr, pred + {factor} * value AS pred FROM t{k}_{depth} JOIN v{k} USING (node))"]
    return ",\n".join(parts)


_KNOWN = "known AS (SELECT axis, pos, a, floor(v / 40) AS s, fr FROM run WHERE a IS NOT NULL AND v IS NOT NULL AND fr IS NOT NULL),\n"
_LEAVES = f"SELECT {sql_rnd('pred')} AS y_pred, count(*) AS n_rows, {sql_rnd('sum(fr)', 3)} AS sum_fr FROM {{last}} GROUP BY 1"


def _leaves(spark, sf_dir, spec):
    """Rows by the prediction they get."""
    run, _ = run_of(spark, sf_dir, columns=("v", "a", "fr"))
    known = run.select("axis", "pos", "a", F.floor(F.col("v") / 40).alias("s"), "fr").dropna()
    found = trees.predictions(trees.binned(known, ["a", "s"], "fr", ["axis", "pos"]), [spec])
    return found.groupBy(rnd("y_pred").alias("y_pred")).agg(F.count(F.lit(1)).alias("n_rows"), rnd(F.sum("y"), 3).alias("sum_fr"))


_TWO_ROUNDS = {"n_estimators": 2, "max_depth": 2, "learning_rate": 0.3, "min_child_weight": 5}


@query("l01c_two_rounds", sql("run", _LEAVES.format(last="r2"), more=_KNOWN + _tree_sql(2, 2, 0.3, 1.0, 0.5, True, "lh >= 5 AND th - lh >= 5")))
def two_rounds(spark, sf_dir):
    """Two boosted trees of depth 2 on all columns."""
    return _leaves(spark, sf_dir, trees.boosted(_TWO_ROUNDS))


def _hash_sql(x: str, *keys: int) -> str:
    """The engine's hash of a row's number and keys, in 128-bit arithmetic."""
    whole, half = 1 << 64, lambda v: f"CAST('{v}' AS UHUGEINT)"
    for k in keys:
        salt = (k * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % whole
        for factor, shift in ((0xBF58476D1CE4E5B9, 31), (0x94D049BB133111EB, 29)):
            x = f"((xor({x}, {half(salt)}) * {half(factor)}) % {half(whole)})" if shift == 31 else f"(({x} * {half(factor)}) % {half(whole)})"
            x = f"(SELECT xor(y, y // {half(1 << shift)}) FROM (SELECT {x} AS y))"
    return x


def _bootstrap_sql(k: int) -> str:
    """How often a tree's sample takes a row."""
    number = "CAST(CAST('0x' || substr(md5(concat_ws('-', axis, pos)), 1, 15) AS UBIGINT) AS UHUGEINT)"
    chances = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(n + 1)) for n in range(9)]
    steps = " + ".join(f"CAST(u >= CAST('{c!r}' AS DOUBLE) AS INTEGER)" for c in chances)
    return f"(SELECT {steps} FROM (SELECT CAST({_hash_sql(number, 1, 4, k)} // CAST('2048' AS UHUGEINT) AS DOUBLE) / 9007199254740992 AS u))"


@query("l02c_three_trees", sql("run", _LEAVES.format(last="r3"), more=_KNOWN + _tree_sql(3, 2, 1 / 3, 0.0, 0.0, False, "ln >= 3 AND tn - ln >= 3 AND tn >= 40", _bootstrap_sql)))
def three_trees(spark, sf_dir):
    """A forest of three bootstrapped trees of depth 2."""
    return _leaves(spark, sf_dir, trees.forest({"n_estimators": 3, "max_depth": 2, "min_samples_leaf": 3, "min_samples_split": 40}))


@query("o06_top_features")
def top_features(spark, sf_dir):
    return model.top_features(_importances(spark, sf_dir)[0], 10)


@query("d04_importance_and_correlation")
def importance_and_correlation(spark, sf_dir):
    """Bars and heat map of the ten most important features as one table."""
    ranking, data = _importances(spark, sf_dir)
    top = [r["name"] for r in model.top_features(ranking, 10).collect()]
    bars = ranking.filter(F.col("rank") <= 10).select(F.lit("importance").alias("table"), F.col("name").alias("a"),
                                                      F.lit(None).cast("string").alias("b"), F.col("importance").alias("value"))
    heat = score.correlations(data, top).select(F.lit("correlation").alias("table"), "a", "b", F.col("r").alias("value"))
    return bars.unionByName(heat)


@query("l04_baseline", sql("pred", f"SELECT axis, pos, {sql_rnd('fr')} AS fr, {sql_rnd('y_pred')} AS y_pred FROM pred"))
def baseline(spark, sf_dir):
    predicted, _ = predicted_of(spark, sf_dir)
    return predicted.select("axis", "pos", rnd("fr").alias("fr"), rnd("y_pred").alias("y_pred"))


@query("l05_score", sql("pred", f"""
SELECT axis, rank, pos, {sql_rnd('err')} AS err, worst_error, n_over
FROM outliers JOIN (SELECT axis, {sql_rnd('max(err)')} AS worst_error, count(*) FILTER (WHERE err > {THRESHOLD}) AS n_over
                    FROM pred GROUP BY axis) USING (axis)""", more=OUTLIERS))
def score_bundle(spark, sf_dir):
    """Target scaled before the fit and scaled back for the score."""
    run, spec = run_of(spark, sf_dir, columns=("v", "fr"))
    scaler = scale.Scaler.fit(run, ["fr"], ["Standard"])
    predicted = score.baseline(scaler.transform(run), "fr", "v", spec.keys)
    rated = score.score(predicted.select("axis", "pos", "fr", "y_pred"), "fr", "y_pred", THRESHOLD, by=spec.keys, scaler=scaler)
    return rated.outliers.join(rated.summary, "axis").select(
        "axis", "rank", "pos", rnd("err").alias("err"), rnd("worst_error").alias("worst_error"), "n_over")


# --- search --------------------------------------------------------------------------------

_SIGNALS = ("v", "a")
_STEPS = 6


def _shape_sql() -> str:
    """Every (signal, lag) as feature, its line per axis, and the errors."""
    lagged = ", ".join(f"lag({s}, {k}, CAST(0 AS DOUBLE)) OVER w AS {s}{k}" for s in _SIGNALS for k in range(_STEPS + 1))
    rows = " UNION ALL ".join(f"SELECT axis, fr, '{s}' AS signal, {k} AS step_size, {s}{k} AS x FROM wide"
                              for s in _SIGNALS for k in range(_STEPS + 1))
    return f"""
wide AS (SELECT axis, fr, {lagged} FROM run WINDOW w AS (PARTITION BY axis ORDER BY pos)),
pairs AS ({rows}),
fitted AS (SELECT axis, signal, step_size, regr_slope(fr, x) AS slope, regr_intercept(fr, x) AS base FROM pairs GROUP BY 1, 2, 3),
rated AS (SELECT signal, step_size, abs(fr - (slope * x + base)) AS err FROM pairs JOIN fitted USING (axis, signal, step_size))"""


def _draw(key: str) -> str:
    return (f"(CAST(('0x' || substr(md5(concat_ws('-', candidate, '{key}', '1')), 1, 8)) AS UBIGINT) "
            f"/ CAST(4294967296 AS DOUBLE))")


_SAMPLED = f"""
candidates AS (
  SELECT candidate, ['v', 'a'][CAST(floor({_draw('signal')} * 2) AS INTEGER) + 1] AS signal,
         CAST(floor({_draw('step_size')} * {_STEPS + 1}) AS BIGINT) AS step_size,
         exp('{math.log(20.0)!r}'::DOUBLE + {_draw('threshold')} * '{math.log(200.0) - math.log(20.0)!r}'::DOUBLE) AS threshold
  FROM range(0, 40) t(candidate))"""
_GRID = f"""
candidates AS (
  SELECT row_number() OVER (ORDER BY i, step_size, threshold) - 1 AS candidate, signal, step_size, threshold
  FROM (VALUES (0, 'v'), (1, 'a')) s(i, signal) CROSS JOIN (VALUES (0), (1), (2), (6)) k(step_size)
  CROSS JOIN (VALUES (CAST(50 AS DOUBLE)), (CAST(100 AS DOUBLE))) t(threshold))"""
_RATED = f"""
SELECT candidate, signal, CAST(step_size AS BIGINT) AS step_size, {sql_rnd('threshold')} AS threshold,
       {sql_rnd('CASE WHEN count(err) = count(*) THEN max(err) END')} AS worst_error,
       count(*) FILTER (WHERE err > c.threshold) AS n_over, count(*) AS n_rows
FROM candidates c JOIN rated USING (signal, step_size) GROUP BY candidate, signal, step_size, c.threshold"""


def _rated(spark, sf_dir, candidates):
    run, spec = run_of(spark, sf_dir)
    return search.baseline_search(run.select("axis", "pos", "fr", *_SIGNALS), spec, "fr", _SIGNALS, candidates)


def _rounded(scores):
    return scores.withColumn("threshold", rnd("threshold")).withColumn("worst_error", rnd("worst_error"))


@query("l06_sampled_candidates", sql("run", _RATED, more=_shape_sql() + "," + _SAMPLED))
def sampled_candidates(spark, sf_dir):
    space = {"signal": list(_SIGNALS), "step_size": search.Whole(0, _STEPS), "threshold": search.LogUniform(20.0, 200.0)}
    return _rounded(_rated(spark, sf_dir, search.sample_candidates(spark, space, 40)))


def _grid(spark):
    return search.grid_candidates(spark, {"signal": _SIGNALS, "step_size": (0, 1, 2, 6), "threshold": (50.0, 100.0)})


@query("l07_grid_candidates", sql("run", _RATED, more=_shape_sql() + "," + _GRID))
def grid_candidates(spark, sf_dir):
    return _rounded(_rated(spark, sf_dir, _grid(spark)))


@query("l08_random_search")
def random_search(spark, sf_dir):
    marked, spec = _marked_run(spark, sf_dir)
    found = search.RandomSearch(spaces.SHIFTED_SPACE, signals=["v", "a"], threshold=THRESHOLD, scale_first=["Robust"]).fit_predict(marked, spec, ["v", "a"], "fr")
    return found.scores


def _forests(spark):
    """The forests that a search over folds compares, drawn from their space."""
    drawn = search.sample_candidates(spark, spaces.FOREST_SPACE, FORESTS).orderBy("candidate").collect()
    return [{k: v for k, v in r.asDict().items() if k != "candidate"} for r in drawn]


@query("l09_fold_search")
def fold_search(spark, sf_dir):
    run, spec = run_of(spark, sf_dir)
    frame, names = prepare.model_frame(run, spec, 3, True, ())
    folds = frame.withColumn("fold", split.fold_number(F.col("pos"), F.col("n_rows"), spaces.FOLDS))
    table = trees.binned(folds, names, "fr", ["axis", "pos"], "fold")
    return search.fold_search(table, _forests(spark), spaces.FOLDS)


@query("l10_best_candidate", sql("run", f"""
SELECT candidate, signal, CAST(step_size AS BIGINT) AS step_size, {sql_rnd('worst_error')} AS worst_error
FROM (SELECT candidate, signal, step_size, max(err) AS worst_error
      FROM candidates JOIN rated USING (signal, step_size) GROUP BY ALL)
ORDER BY worst_error, candidate LIMIT 1""", more=_shape_sql() + "," + _GRID))
def best_candidate(spark, sf_dir):
    best = search.best_candidate(_rated(spark, sf_dir, _grid(spark)), ["signal", "step_size"])
    return best.withColumn("worst_error", rnd("worst_error"))


# --- whole analyses ------------------------------------------------------------------------

FLAGSHIP_SQL = sql("run", f"""
SELECT axis, count(*) AS n_rows, {sql_rnd('max(err)')} AS worst_error, count(*) FILTER (WHERE err > {THRESHOLD}) AS n_over,
       {sql_rnd('avg(err * err)')} AS mse, {sql_rnd('avg(err)')} AS mae FROM rated GROUP BY axis""", more="""
wide AS (
  SELECT axis, fr, CASE WHEN count(v) OVER f = 64 THEN avg(v) OVER f END AS mean64, lag(v, 3, CAST(0 AS DOUBLE)) OVER w AS lag3
  FROM run WINDOW w AS (PARTITION BY axis ORDER BY pos), f AS (PARTITION BY axis ORDER BY pos ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)),
ready AS (SELECT axis, fr, mean64 - lag3 AS x FROM wide WHERE mean64 IS NOT NULL AND lag3 IS NOT NULL),
line AS (SELECT axis, regr_slope(fr, x) AS slope, regr_intercept(fr, x) AS base FROM ready GROUP BY axis),
rated AS (SELECT axis, abs(fr - (slope * x + base)) AS err FROM ready JOIN line USING (axis))""")


@query("flagship", FLAGSHIP_SQL)
def flagship(spark, sf_dir):
    """Fill, pick the run, derive the target, add features, fit the baseline, score per axis."""
    run, spec = run_of(spark, sf_dir)
    frame, _ = prepare.model_frame(run.select("axis", "pos", "v", "a", "fr"), spec, 3)
    ready = frame.select("axis", "pos", "fr", (F.col("MeanV64") - named("v_-3")).alias("x")).dropna()
    rated = score.metrics(score.baseline(ready, "fr", "x", spec.keys), "fr", "y_pred", THRESHOLD, spec.keys)
    return rated.select("axis", "n_rows", "n_over", *[rnd(c).alias(c) for c in ("worst_error", "mse", "mae")])


@query("x01_single_fit")
def single_fit(spark, sf_dir):
    """One boosted fit on rolling statistics and 75 lags of both inputs; its outliers, worst first."""
    run, spec = _marked_run(spark, sf_dir)
    features = (rolling.rolling_bundle("v", "a", spaces.ROLLING_SIZES)
                + shift.lag_array_features(["v", "a"], spaces.SINGLE_FIT["step_size"]))
    frame = series.add_features(run, spec, features)
    predicted = _predicted(frame, ["v", "a", *[f.name for f in features]], trees.boosted(spaces.SINGLE_FIT))
    rated = score.score(predicted, "fr", "y_pred", THRESHOLD, by=spec.keys)
    return rated.outliers


@query("x05_forest_search")
def forest_search(spark, sf_dir):
    """Sampled forests compared by k folds of the training rows; the best one's four worst rows over all rows."""
    marked, spec = _marked_run(spark, sf_dir)
    frame, names = prepare.model_frame(marked, spec, 3, True, ())
    data = series.cut(frame.select("axis", "pos", "is_test", "fr", *[named(n) for n in names]))
    # Folds are contiguous in the order of the training rows; test rows are in none.
    train = series.with_position(data.filter(~F.col("is_test")), series.fit_spec(data, ["axis"], "pos"), "place", "n_train")
    train = train.withColumn("fold", split.fold_number(F.col("place"), F.col("n_train"), spaces.FOLDS).cast("int")).select("axis", "pos", "fold")
    marked = data.join(train, ["axis", "pos"], "left")
    table = trees.binned(marked.withColumn("fold", F.coalesce("fold", F.lit(-1))), names, "fr", ["axis", "pos"], "fold")
    candidates = _forests(spark)
    best = search.best_candidate(search.fold_search(table, candidates, spaces.FOLDS, left_out=(-1,)), ["params"], "mean_worst_error").first()["candidate"]
    refit = trees.replace(trees.forest(candidates[best]), held=(-1,))
    predicted = trees.predictions(table, [refit]).select("axis", "pos", F.col("y").alias("fr"), "y_pred")
    rated = score.score(predicted, "fr", "y_pred", THRESHOLD, by=spec.keys)
    return score.worst_rows(rated.predictions, 4)


_SEQUENCE_SQL = f"""
SELECT axis, is_test, count(*) AS n_rows, {sql_rnd('sum(weighted)', 2)} AS weighted, {sql_rnd('min(fr)')} AS low, {sql_rnd('max(fr)')} AS high FROM (
  SELECT axis, pos, fr, list_sum(list_transform(list(v) OVER w, lambda x, i: x * i)) AS weighted,
         pos >= n_rows - CAST(round_even(n_rows * CAST(0.4 AS DOUBLE), 0) AS BIGINT) AS is_test
  FROM run WINDOW w AS (PARTITION BY axis ORDER BY pos ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
WHERE pos >= 60 GROUP BY axis, is_test"""


@query("x02_sequence_sets", sql("run", _SEQUENCE_SQL))
def sequence_sets(spark, sf_dir):
    """Windows of 60 rows with their target, cut into training rows and a test tail."""
    run, spec = run_of(spark, sf_dir)
    target = F.struct("fr", "n_rows").alias("target")
    windows = sequence.supervised_windows(run.select("axis", "pos", "v", "a", target), spec, ["v", "a"], "target", spaces.SEQUENCE_STEPS)
    weighted = F.aggregate(F.transform("window", lambda r, i: r["v"] * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    cells = windows.select("axis", "pos", "target.*", weighted.alias("weighted"))
    tail = split.tail_test(F.col("pos") - 60, F.col("n_rows") - 60, 0.4, F.col("n_rows"))
    return cells.withColumn("is_test", tail).groupBy("axis", "is_test").agg(
        F.count(F.lit(1)).alias("n_rows"), rnd(F.sum("weighted"), 2).alias("weighted"),
        rnd(F.min("fr")).alias("low"), rnd(F.max("fr")).alias("high"))


_FILTERED_SQL = sql("run", f"""
SELECT axis, count(*) AS n_rows, {sql_rnd('max(err)')} AS worst_error, count(*) FILTER (WHERE err > 50) AS n_over,
       {sql_rnd('avg(err * err)')} AS mse, {sql_rnd('avg(err)')} AS mae FROM rated GROUP BY axis""",
    more=_low_pass_sql(*lowpass.coefficients(0.1)) + """,
wide AS (SELECT run.axis, pass2.x AS y, v - a AS enc FROM run JOIN pass2 ON pass2.axis = run.axis AND pass2.p = run.pos + 6),
line AS (SELECT axis, regr_slope(y, enc) AS slope, regr_intercept(y, enc) AS base FROM wide GROUP BY axis),
rated AS (SELECT axis, abs(y - (slope * enc + base)) AS err FROM wide JOIN line USING (axis) WHERE enc IS NOT NULL)""")


@query("x03_filtered_target", _FILTERED_SQL)
def filtered_target(spark, sf_dir):
    """Encoder difference as input, low-passed target, robust-then-standard scaling, score on the original scale."""
    run, spec = run_of(spark, sf_dir, columns=("v", "a", "fm"))
    smooth = lowpass.low_pass(run.select("axis", "pos", "v", "a", "fm"), spec, "fm", 0.1, "y")
    data = smooth.select("axis", "pos", "y", (F.col("v") - F.col("a")).alias("enc")).dropna()
    scaler = scale.Scaler.fit(data, ["enc", "y"], ["Robust", "Standard"])
    predicted = score.baseline(scaler.transform(data), "y", "enc", spec.keys)
    summary = score.score(predicted, "y", "y_pred", 50.0, by=spec.keys, scaler=scaler).summary
    return summary.select("axis", "n_rows", "n_over", *[rnd(c).alias(c) for c in ("worst_error", "mse", "mae")])


@query("x04_binned_baseline", sql("run", f"""
SELECT bin_v, count(*) AS n_rows, {sql_rnd('avg(fr)')} AS mean_fr FROM binned GROUP BY bin_v""", more="""
edges AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM run),
binned AS (SELECT fr, CAST(CASE WHEN v IS NULL THEN NULL WHEN v <= q1 THEN 0 WHEN v <= q2 THEN 1 WHEN v <= q3 THEN 2 ELSE 3 END AS INTEGER) AS bin_v
           FROM run CROSS JOIN edges)"""))
def binned_baseline(spark, sf_dir):
    """Residual target by quartile bin of the velocity."""
    run, _ = run_of(spark, sf_dir, columns=("v", "fr"))
    bins = quantile.quantile_bins(run.select("v", "fr"), {"v": "bin_v"})
    return bins.groupBy("bin_v").agg(F.count(F.lit(1)).alias("n_rows"), rnd(F.avg("fr")).alias("mean_fr"))


def _numbered_file(spark, sf_dir):
    """The signals as a numbered-axis file, read back: the axis' position, velocity, encoders and current."""
    path = scratch_path(spark, "numbered")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    csv.write_signals(signals(spark, sf_dir).select(
        F.col("cycle").alias("idx"), stamp.alias(layouts.TIME_2022), F.col("cycle").alias(layouts.CYCLE_2022),
        (F.col("axis") + 1).alias(layouts.AXIS_2022), F.col("tag").alias(layouts.TAG_2022),
        F.col("v").alias("VEL_FFW|1"), F.col("a").alias("DES_POS|1"), F.col("fm").alias("ENC1_POS|1"),
        F.col("fb").alias("ENC2_POS|1"), (F.col("fm") + F.col("fb")).alias("CURRENT|1")), path)
    columns = ["VEL_FFW|1", "DES_POS|1", "ENC1_POS|1", "ENC2_POS|1", "CURRENT|1"]
    read = layouts.scan_2022(spark, path, columns).withColumn("axis", F.col("axis") - 1)
    return read, spec_for(spark, sf_dir, ("axis",))


_NUMBERED = """
file AS (SELECT axis, cycle, tag, v, a, fm, fb, fm + fb AS current FROM sig),
full_file AS (SELECT * REPLACE (last_value(tag IGNORE NULLS) OVER w AS tag, last_value(v IGNORE NULLS) OVER w AS v, last_value(a IGNORE NULLS) OVER w AS a,
                last_value(fm IGNORE NULLS) OVER w AS fm, last_value(fb IGNORE NULLS) OVER w AS fb, last_value(current IGNORE NULLS) OVER w AS current)
              FROM file WINDOW w AS (PARTITION BY axis ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
rows_used AS (SELECT axis, current AS y, {x} AS x FROM full_file WHERE regexp_matches(tag, '{run}')),
line AS (SELECT axis, regr_slope(y, x) AS slope, regr_intercept(y, x) AS base FROM rows_used GROUP BY axis),
rated AS (SELECT axis, abs(y - (slope * x + base)) AS err FROM rows_used JOIN line USING (axis))"""


def _numbered_sql(x: str) -> str:
    return sql("sig", f"""
SELECT axis, count(*) AS n_rows, count(*) FILTER (WHERE err > {THRESHOLD}) AS n_over,
       {sql_rnd('CASE WHEN count(err) = count(*) THEN max(err) END')} AS worst_error,
       {sql_rnd('CASE WHEN count(err) = count(*) THEN avg(err) END')} AS mae FROM rated GROUP BY axis""",
               more=_NUMBERED.format(x=x, run=RUN))


def _numbered_summary(summary):
    return summary.select("axis", "n_rows", "n_over", rnd("worst_error").alias("worst_error"), rnd("mae").alias("mae"))


@query("x06_numbered_file", _numbered_sql("v"))
def numbered_file(spark, sf_dir):
    """From a numbered-axis file to the score of the current predicted from the velocity."""
    read, spec = _numbered_file(spark, sf_dir)
    run = prepare.measurement_run(read, spec, RUN, ("VEL_FFW|1", "CURRENT|1"), write=True, target="CURRENT|1", parts=None)
    predicted = score.baseline(run, "CURRENT|1", "VEL_FFW|1", spec.keys)
    return _numbered_summary(score.metrics(predicted, "CURRENT|1", "y_pred", THRESHOLD, spec.keys))


@query("x07_numbered_file_scaled", _numbered_sql("fm - fb"))
def numbered_file_scaled(spark, sf_dir):
    """The same from the difference of the encoders, robust then standard scaled, scored on the original scale."""
    read, spec = _numbered_file(spark, sf_dir)
    wanted = ("ENC1_POS|1", "ENC2_POS|1", "CURRENT|1")
    run = prepare.measurement_run(read, spec, RUN, wanted, write=True, target="CURRENT|1", parts=None)
    data = project.replace_by_difference(run, "ENC1_POS|1", "ENC2_POS|1", "enc")
    scaler = scale.Scaler.fit(data, ["enc", "CURRENT|1"], ["Robust", "Standard"])
    predicted = score.baseline(scaler.transform(data), "CURRENT|1", "enc", spec.keys)
    return _numbered_summary(score.score(predicted, "CURRENT|1", "y_pred", THRESHOLD, by=spec.keys, scaler=scaler).summary)
