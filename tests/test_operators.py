import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import gappy, pandas_sorted, same, spark_frame
from signalloom.functions import scalar
from signalloom.operators import clean, diag, lowpass, project, quantile, scale, score, search, series, split

SPEC = series.SeriesSpec(("series",), "cycle")


def numbers(spark, values):
    return spark.createDataFrame([(float(x) if x is not None else None,) for x in values], "x double")


# --- missing values ------------------------------------------------------------------------


def test_missing_texts_and_nan_become_null(spark):
    df = spark.createDataFrame([("nan", float("nan"), 1), ("ok", 2.0, 2), (None, None, 3), (" NULL ", 4.0, 4)], "t string, x double, i int")
    out = clean.null_out_missing(df).orderBy("i").collect()
    assert [(r.t, r.x) for r in out] == [(None, None), ("ok", 2.0), (None, None), (None, 4.0)]
    counts = {r.name: r.n_null for r in clean.null_counts(df).collect()}
    assert counts == {"t": 1, "x": 2, "i": 0}


def test_profile_lists_columns_in_order(spark):
    df = spark.createDataFrame([(1, None)], "b bigint, `a.b|1` double")
    assert [(r.ordinal, r.name, r.type, r.n_null) for r in clean.table_profile(df).orderBy("ordinal").collect()] == [
        (0, "b", "bigint", 0), (1, "a.b|1", "double", 1)]


def test_tag_search(spark):
    df = spark.createDataFrame([("Feed_01",), ("Other",), (None,)], "tag string")
    assert df.filter(scalar.tag_matches(F.col("tag"), "Feed")).count() == 1
    assert df.filter(scalar.tag_matches(F.col("tag"), "F.*1$")).count() == 1
    assert df.filter(scalar.tag_matches(F.col("tag"), ".", literal=True)).count() == 0
    with pytest.raises(Exception):
        df.filter(scalar.tag_matches(F.col("tag"), "Feed", strict=True)).count()


def test_time_text(spark):
    df = spark.createDataFrame([("2023-01-16 12:53:00.5",), ("soon",)], "t string")
    assert df.filter(scalar.parse_time(F.col("t"), strict=False).isNull()).count() == 1
    with pytest.raises(Exception):
        df.select(scalar.parse_time(F.col("t"))).collect()
    assert df.limit(1).select(scalar.day_text(scalar.parse_time(F.col("t")))).first()[0] == "2023-01-16"


def test_stabilise_has_no_value_below_one(spark):
    out = numbers(spark, [0.5, 1.0, 20.0]).select(scalar.stabilise(F.col("x")).alias("z"), "x").orderBy("x").collect()
    assert out[0].z is None and out[1].z == 0.0 and math.isclose(out[2].z, math.sqrt(math.log(20.0)))


# --- quantiles -----------------------------------------------------------------------------

ADVERSARIAL = {
    "ties": [1.0] * 500 + [2.0] * 300 + list(range(3, 60)),
    "signs": [-1e300, -1.0, -5e-324, 0.0, -0.0, 5e-324, 1.0, 1e300, 1e-300, -1e-300],
    "close": [1.0 + i * 2.0 ** -52 for i in range(3000)],
    "wide": list(np.random.default_rng(1).normal(size=2000) * 10.0 ** np.random.default_rng(2).integers(-200, 200, 2000)),
    "single": [4.25],
    "gaps": [None, float("nan"), 3.0, 1.0, None, 2.0],
}


@pytest.mark.parametrize("case", sorted(ADVERSARIAL))
@pytest.mark.parametrize("rounds", [1, 4])
def test_quantiles_are_exact(spark, monkeypatch, case, rounds):
    monkeypatch.setattr(quantile, "ROUNDS", rounds)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    known = np.array([x for x in ADVERSARIAL[case] if x is not None and not math.isnan(x)])
    got = {r.prob: r.value for r in
           quantile.exact_quantiles(numbers(spark, ADVERSARIAL[case]), ["x"], probs).collect()}
    want = np.quantile(known, probs)
    assert all(math.isclose(got[p], w, rel_tol=1e-12, abs_tol=5e-324) for p, w in zip(probs, want))


def test_quantiles_per_group(spark):
    pdf = gappy()
    probs = [0.25, 0.5, 0.75]
    got = quantile.exact_quantiles(spark_frame(spark, pdf), ["v", "a"], probs, ["series"]).collect()
    want = {(s, c, p): g[c].quantile(p) for s, g in pdf.groupby("series") for c in ("v", "a") for p in probs}
    assert {(r.series, r["name"], r.prob) for r in got} == {k for k, v in want.items() if not math.isnan(v)}
    assert all(math.isclose(r.value, want[r.series, r["name"], r.prob], rel_tol=1e-12) for r in got)


def test_one_more_row_changes_no_other_quantile(spark):
    """The same way for every size: quantiles of a table and of the table ten times over agree where ranks allow it."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=501)
    for copies in (1, 3):
        got = quantile.exact_quantiles(numbers(spark, list(x) * copies), ["x"], [0.0, 0.5, 1.0]).collect()
        assert sorted(r.value for r in got) == [x.min(), np.median(x), x.max()]


def test_bins_equal_qcut(spark):
    pdf = gappy()
    out = pandas_sorted(quantile.quantile_bins(spark_frame(spark, pdf), {"v": "bin_v", "a": "bin_a"}), ["series", "cycle"])
    assert same(out.bin_v, pd.qcut(pdf.v, 4, labels=False)) and same(out.bin_a, pd.qcut(pdf.a, 4, labels=False))
    by = pandas_sorted(quantile.quantile_bins(spark_frame(spark, pdf), {"a": "b"}, by=["series"]), ["series", "cycle"])
    assert same(by.b, pdf.groupby("series").a.transform(lambda x: pd.qcut(x, 4, labels=False)))


def test_equal_edges_are_refused(spark):
    with pytest.raises(ValueError):
        quantile.quantile_bins(numbers(spark, [1.0] * 10 + [2.0]), {"x": "b"})
    grouped = numbers(spark, [1.0] * 10 + [2.0]).withColumn("g", F.lit(1))
    with pytest.raises(Exception):
        quantile.quantile_bins(grouped, {"x": "b"}, by=["g"]).collect()


# --- filter --------------------------------------------------------------------------------


def recursive_filter(x, cutoff):
    gain, decay = lowpass.coefficients(cutoff)
    wide = np.r_[2 * x[0] - x[6:0:-1], x, 2 * x[-1] - x[-2:-8:-1]]

    def one_way(z):
        y = np.empty_like(z)
        y[0] = z[0]
        for i in range(1, len(z)):
            y[i] = gain * (z[i] + z[i - 1]) + decay * y[i - 1]
        return y

    return one_way(one_way(wide)[::-1])[::-1][6:-6]


@pytest.mark.parametrize("cutoff,n", [(0.1, 7), (0.1, 4000), (0.3, 900), (0.02, 9000), (0.7, 300)])
def test_low_pass(spark, cutoff, n):
    x = np.random.default_rng(5).normal(100, 30, n)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "series string, pos bigint, x double")
    got = lowpass.low_pass(df, SPEC, "x", cutoff).orderBy("pos").toPandas()
    assert len(got) == n and np.abs(got.x_lp - recursive_filter(x, cutoff)).max() < 1e-9


def test_low_pass_coefficients():
    gain, decay = lowpass.coefficients(0.1)
    assert math.isclose(gain, 0.136728735997, rel_tol=1e-9) and math.isclose(decay, 0.726542528005, rel_tol=1e-9)


def test_low_pass_of_gaps_and_short_series(spark):
    gaps = spark.range(20).select(F.lit("s").alias("series"), F.col("id").alias("pos"), F.when(F.col("id") != 3, 1.0).alias("x"))
    out = lowpass.low_pass(gaps, SPEC, "x")
    assert out.count() == 20 and out.filter("x_lp is not null").count() == 0
    with pytest.raises(Exception):
        lowpass.low_pass(gaps.filter("pos < 6").fillna(1.0), SPEC, "x").collect()


# --- scalers -------------------------------------------------------------------------------


def test_scalers(spark):
    values = np.array([1.0, 2.0, 4.0, 9.0, 9.5])
    df = numbers(spark, values).withColumn("flat", F.lit(3.0))
    q25, median, q75 = np.quantile(values, [0.25, 0.5, 0.75])
    span = values.max() - values.min()
    want = {"MinMax": (values - values.min()) / span, "MinMax(-1.1)": 2 * (values - values.min()) / span - 1,
            "Standard": (values - values.mean()) / values.std(), "Robust": (values - median) / (q75 - q25)}
    flat = {"MinMax": 0.0, "MinMax(-1.1)": -1.0, "Standard": 0.0, "Robust": 0.0}
    for name, expected in want.items():
        fitted = scale.Scaler.fit(df, ["x", "flat"], [name])
        out = fitted.transform(df)
        rows = out.orderBy("x").toPandas()
        assert same(rows.x, expected) and same(rows.flat, [flat[name]] * 5), name
        back = fitted.inverse(out).orderBy("x").toPandas()
        assert same(back.x, values) and same(back.flat, [3.0] * 5)


def test_scaler_chain_and_groups(spark):
    pdf = gappy()
    df = spark_frame(spark, pdf)
    median, q25, q75 = pdf.a.median(), pdf.a.quantile(0.25), pdf.a.quantile(0.75)
    first = (pdf.a - median) / (q75 - q25)
    for name, second in (("Standard", (first - first.mean()) / first.std(ddof=0)),
                         ("MinMax(-1.1)", 2 * (first - first.min()) / (first.max() - first.min()) - 1),
                         ("Robust", first)):
        got = pandas_sorted(scale.Scaler.fit(df, ["a"], ["Robust", name]).transform(df), ["series", "cycle"])
        assert same(got.a, second), name
    table = scale.scaling_table(df, ["a", "v"], ["Standard"], ["series"])
    scaled = scale.scale_by(df, ["a", "v"], ["Standard"], ["series"], fitted=table)
    groups = pdf.groupby("series")
    got = pandas_sorted(scaled, ["series", "cycle"])
    spread = groups.v.transform(lambda x: x.std(ddof=0)).replace(0.0, 1.0)  # the short series has one value
    assert same(got.v, (pdf.v - groups.v.transform("mean")) / spread)
    back = pandas_sorted(scale.scale_by(scaled, ["a", "v"], ["Standard"], ["series"], invert=True, fitted=table), ["series", "cycle"])
    assert same(back.a, pdf.a) and same(back.v, pdf.v)


def test_unknown_scaler():
    with pytest.raises(ValueError):
        scale.scaler_kind("MaxAbs")


# --- splits --------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 5, 1001])
def test_hold_out_is_exact_and_repeatable(spark, n):
    sizes = []
    for partitions in (1, 7):
        out = split.hold_out(spark.range(n).repartition(partitions), ["id"], 0.4, seed=1)
        sizes.append({r.id for r in out.filter("is_test").collect()})
    assert sizes[0] == sizes[1] and len(sizes[0]) == math.ceil(0.4 * n)
    other = {r.id for r in split.hold_out(spark.range(n), ["id"], 0.4, seed=2).filter("is_test").collect()}
    assert n < 10 or other != sizes[0]


def test_hold_out_per_group(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 997, "big").otherwise("small"))
    out = split.hold_out(df, ["g", "id"], 0.4, by=["g"]).groupBy("g").agg(F.count_if("is_test").alias("k")).collect()
    assert {r.g: r.k for r in out} == {"big": math.ceil(0.4 * 997), "small": 2}


@pytest.mark.parametrize("n", [3, 5, 7, 23])
def test_folds_and_tails(spark, n):
    df = spark.range(n).select(F.col("id").alias("pos"), F.lit(n).alias("n"))
    out = df.select("pos", split.fold_number(F.col("pos"), F.col("n"), 5).alias("fold"),
                    split.tail_test(F.col("pos"), F.col("n")).alias("test"),
                    split.tail_validation(F.col("pos"), F.col("n")).alias("valid")).orderBy("pos").toPandas()
    assert list(out.fold) == [f for f, part in enumerate(np.array_split(np.arange(n), 5)) for _ in part]
    assert out.test.sum() == round(0.4 * n) and out.valid.sum() == n - math.floor(n * (1.0 - 0.15))
    sets = split.fold_sets(df.withColumn("fold", split.fold_number(F.col("pos"), F.col("n"), 5)), "fold", 5)
    assert sets.count() == 5 * n and sets.filter("part = 'validate'").count() == n


# --- scores --------------------------------------------------------------------------------


def test_score_rules(spark):
    rows = [("a", 0, 1.0, 1.0), ("a", 1, 500.0, 0.0), ("a", 2, 0.0, 500.0), ("a", 3, 0.0, 200.0), ("b", 0, 1.0, None)]
    df = spark.createDataFrame(rows, "series string, pos bigint, y double, p double")
    rated = score.score(df, "y", "p", 200.0, by=["series"])
    summary = {r.series: r for r in rated.summary.collect()}
    assert summary["a"].worst_error == 500.0 and summary["a"].n_over == 2
    assert summary["b"].worst_error is None and summary["b"].n_over == 0
    assert [(r["rank"], r.pos) for r in rated.outliers.orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert score.outliers(rated.predictions, threshold=1e9).count() == 0
    nan = df.withColumn("p", F.coalesce("p", F.lit(float("nan"))))
    again = {r.series: r for r in score.metrics(nan, "y", "p", 200.0, ["series"]).collect()}
    assert again["b"].worst_error is None and again["b"].n_over == 0


def test_worst_rows_are_cut_down_in_the_tasks(spark):
    df = spark.range(1000).selectExpr("id AS pos", "id % 5 AS g", "CAST(id AS DOUBLE) AS err").repartition(4)
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan(score.worst_rows(df, 4)) and "rangepartitioning" not in plan(score.worst_rows(df, 4))
    assert plan(score.worst_rows(df, 4, by=["g"])).count("WindowGroupLimit") == 2


def test_worst_rows(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("pos"), (F.col("id") % 50).cast("double").alias("err"))
    assert [r.pos for r in score.worst_rows(df, 4).orderBy("rank").collect()] == [49, 99, 149, 199]
    assert score.worst_rows(df, 4).schema == score.worst_rows(df, 2000).schema and score.worst_rows(df, 2000).count() == 1000
    top = score.worst_rows(df, 3, by=["g"]).orderBy("g", "rank").collect()
    assert [(r.g, r.pos) for r in top] == [(0, 99), (0, 249), (0, 399), (1, 49), (1, 199), (1, 349), (2, 149), (2, 299), (2, 449)]


def test_correlations_use_complete_pairs(spark):
    pdf = gappy()
    got = {(r.a, r.b): r.r for r in score.correlations(spark_frame(spark, pdf), ["v", "a", "cycle"]).collect()}
    want = pdf[["v", "a", "cycle"]].corr()
    assert len(got) == 9 and all(math.isclose(got[a, b], want.loc[a, b], abs_tol=1e-9) for a, b in got)


def test_comparison_and_scatter(spark):
    df = spark.createDataFrame([(1.0, 0.0, 7.0), (5.0, 4.5, 8.0)], "y double, p double, v double")
    out = diag.comparison(df, "y", "p", {"velocity": "v"}, 0.9)
    assert sorted((r.series, r.x, r.y) for r in out.collect()) == [
        ("measured", 7.0, 1.0), ("measured", 8.0, 5.0), ("most difference", 7.0, 1.0), ("predicted", 7.0, 0.0), ("predicted", 8.0, 4.5)]
    assert diag.scatter_counts(df, "y", "p", 10.0).collect()[0].n_rows == 2


def test_projections(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (1, 1, 6.0), (2, 1, 7.0)], "cycle bigint, axis int, v double")
    wide = project.axis_inputs(df, ["cycle"], ["v"], [0, 1]).orderBy("cycle").collect()
    assert [(r["v|0"], r["v|1"]) for r in wide] == [(5.0, 6.0), (None, 7.0)]
    ranking = spark.createDataFrame([(2, "cycle"), (1, "v"), (3, "axis")], "rank int, name string")
    assert project.reorder_by(df, ranking).columns == ["v", "cycle", "axis"]
    assert project.reorder_by(df, ranking, k=1).columns == ["v"]
    assert project.replace_by_difference(df, "v", "cycle", "d").columns == ["axis", "d"]


# --- candidates ----------------------------------------------------------------------------


def test_sampled_candidates(spark):
    space = {"depth": range(6, 15), "rate": [0.05, 0.06], "leaf": search.Whole(2, 6), "share": search.Uniform(0.2, 0.4),
             "step": search.LogUniform(0.001, 0.1), "name": ["x", "y"]}
    one, two = (search.sample_candidates(spark, space, 400, seed=4).toPandas() for _ in range(2))
    assert one.equals(two)
    assert set(one.depth) == set(range(6, 15)) and set(one.leaf) == {2, 3, 4, 5, 6} and set(one.name) == {"x", "y"}
    assert one.share.between(0.2, 0.4).all() and one.step.between(0.001, 0.1).all() and (one.step < 0.01).mean() > 0.35
    assert not one.drop(columns="candidate").equals(search.sample_candidates(spark, space, 400, 5).toPandas().drop(columns="candidate"))


def test_grid_is_the_full_product(spark):
    grid = search.grid_candidates(spark, {"a": [1, 2, 3], "b": ["x", "y"], "c": [0.5, 0.7]}).orderBy("candidate").collect()
    want = [(a, b, c) for a in (1, 2, 3) for b in ("x", "y") for c in (0.5, 0.7)]
    assert [(r.a, r.b, r.c) for r in grid] == want and [r.candidate for r in grid] == list(range(12))


def test_first_of_equal_scores_wins(spark):
    scores = spark.createDataFrame([(2, "c", 1.0), (1, "b", 1.0), (0, "a", 3.0)], "candidate bigint, name string, worst_error double")
    assert search.best_candidate(scores, ["name"]).first()["name"] == "b"


# --- groups --------------------------------------------------------------------------------


def test_null_is_a_group_like_any_other(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"g": [None, "a"] * 150, "id": range(300), "x": rng.normal(size=300), "y": rng.normal(size=300)})
    df = spark.createDataFrame([tuple(r) for r in pdf.itertuples(index=False)], "g string, id bigint, x double, y double")
    one, other = pdf[pdf.g.isna()], pdf[pdf.g.notna()]
    got = {(r.g, r.prob): r.value for r in quantile.exact_quantiles(df, ["x"], [0.25, 0.5], ["g"]).collect()}
    assert len(got) == 4 and math.isclose(got[None, 0.25], one.x.quantile(0.25)) and math.isclose(got["a", 0.5], other.x.median())
    marked = split.hold_out(df, ["id"], 0.4, by=["g"])
    assert {r.g: r.k for r in marked.groupBy("g").agg(F.count_if("is_test").alias("k")).collect()} == {None: 60, "a": 60}
    scaled = pandas_sorted(scale.scale_by(df, ["x"], ["Robust"], ["g"]), ["id"])
    want = (one.x - one.x.median()) / (one.x.quantile(0.75) - one.x.quantile(0.25))
    assert len(scaled) == 300 and same(scaled.x[pdf.g.isna()], want)
    line = np.polyfit(one.x, one.y, 1)
    fitted = pandas_sorted(score.baseline(df, "y", "x", ["g"]), ["id"])
    assert same(fitted.y_pred[pdf.g.isna()], np.polyval(line, one.x))
    top = score.worst_rows(df.withColumnRenamed("x", "err"), 2, pos="id", by=["g"]).collect()
    assert sorted(r.id for r in top if r.g is None) == sorted(one.nlargest(2, "x").id)
    ranks = series.ranked(df.select("g", "x"), [F.col("x").desc()], "rank", ["g"]).toPandas()
    assert len(ranks) == 300 and ranks.groupby("g", dropna=False)["rank"].max().tolist() == [150, 150]


def test_statistics_leave_nan_out(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (4.0,)], "x double")
    row = scale.column_statistics(df, ["x"]).first()
    assert (row["min"], row["max"], row["mean"], row["std"], row["median"]) == (1.0, 4.0, 2.5, 1.5, 2.5)


def test_missing_errors_make_scores_null(spark):
    df = spark.createDataFrame([(1.0, 0.5), (2.0, None)], "y double, p double")
    row = score.metrics(df, "y", "p").first()
    assert (row.n_rows, row.worst_error, row.mse, row.mae) == (2, None, None, None)


def test_hold_out_refuses_repeated_keys_at_the_cut(spark, monkeypatch):
    monkeypatch.setattr(split, "CUT_ROWS", 3)
    once = split.hold_out(spark.range(300), ["id"], 0.4)
    assert once.filter("is_test").count() == 120
    with pytest.raises(Exception, match="unique"):
        split.hold_out(spark.range(300).selectExpr("7 AS id"), ["id"], 0.4).count()


def test_wide_tables_are_not_short(spark):
    from signalloom.session import cut

    narrow = cut(spark.range(1000))
    assert series.is_short(narrow)
    assert not series.is_short(cut(spark.range(200).select("id", F.expr("repeat('x', 1000000)").alias("t"))))


def test_null_series_keys_are_refused(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2)], "series string, cycle bigint")
    with pytest.raises(ValueError):
        series.fit_spec(df, ["series"], "cycle")


def test_sizes_are_seen_while_writing(spark):
    df = spark.range(50).select("id", F.expr("repeat('x', 10)").alias("t"))
    table, short, counts = series.written(df, "some", odd=F.count_if(F.col("id") % 2 == 1))
    assert short and counts == {"odd": 25} and table.count() == 50
    for nothing in (df.limit(0), df.where("id < 0"), spark.createDataFrame([], df.schema)):
        table, short, counts = series.written(nothing, "none", odd=F.count_if(F.col("id") % 2 == 1))
        assert short and counts == {"odd": 0} and table.count() == 0
    assert not series.written(spark.range(200).select("id", F.expr("repeat('x', 1000000)").alias("t")), "long")[1]
