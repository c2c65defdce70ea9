import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import TYPES, gappy, pandas_sorted, same, spark_frame
from signalloom.operators import clean, rolling, sequence, series, shift

SPEC = series.SeriesSpec(("series",), "cycle", bucket_width=64, chunk_rows=100)


@pytest.fixture(scope="module")
def pdf():
    return gappy()


@pytest.mark.parametrize("partitions", [1, 8])
@pytest.mark.parametrize("width", [7, 64, 1 << 20])
@pytest.mark.parametrize("write", [False, True])
def test_position(spark, pdf, partitions, width, write):
    spec = series.SeriesSpec(("series",), "cycle", bucket_width=width)
    got = pandas_sorted(series.with_position(spark_frame(spark, pdf, partitions=partitions), spec, length="n", write=write),
                        ["series", "cycle"])
    assert (got.pos == pdf.groupby("series").cumcount()).all()
    assert (got.n == pdf.groupby("series").cycle.transform("size")).all()
    assert series.BUCKET not in got.columns


def test_position_with_ties_and_missing_keys(spark):
    rows = [("s", None, 3), ("s", 2, 1), ("s", 2, 0), ("s", -5, 0), ("s", None, 1), ("s", 9, 0)]
    df = spark.createDataFrame(rows, "series string, cycle bigint, idx bigint")
    spec = series.SeriesSpec(("series",), "cycle", ("idx",), bucket_width=2)
    got = [(r.cycle, r.idx) for r in series.with_position(df, spec).orderBy("pos").collect()]
    assert got == [(-5, 0), (2, 0), (2, 1), (9, 0), (None, 1), (None, 3)]


def test_position_by_sort_matches(spark, pdf):
    df = spark_frame(spark, pdf).withColumn("cycle", F.col("cycle") * F.col("cycle"))
    got = pandas_sorted(series.position_by_sort(df, SPEC), ["series", "cycle"])
    assert (got.pos == pdf.groupby("series").cumcount()).all()


def test_rank_of_a_group_with_most_rows(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("g"), (F.col("id") % 7).alias("x"), "id")
    got = series.ranked(df, [F.col("x").desc(), F.col("id").asc()], "rank", ["g"]).toPandas()
    want = got.sort_values(["g", "x", "id"], ascending=[True, False, True])
    assert (want.groupby("g").cumcount() + 1 == want["rank"]).all() and len(got) == 20000


@pytest.mark.parametrize("width", [5, 64, 1 << 20])
def test_forward_fill(spark, pdf, width):
    spec = series.SeriesSpec(("series",), "cycle", bucket_width=width)
    got = pandas_sorted(clean.forward_fill(spark_frame(spark, pdf), spec, ["v"]), ["series", "cycle"])
    assert same(got.v, pdf.groupby("series").v.ffill())
    assert list(got.columns) == list(pdf.columns)


def test_fill_crosses_runs_and_keeps_leading_gaps(spark):
    rows = [("s", 1, None, 1.0, "x"), ("s", 2, 5.0, 1.0, "x"), ("s", 3, None, 1.0, "y"), ("s", 900, None, 1.0, "y")]
    got = clean.forward_fill(spark.createDataFrame(rows, TYPES), SPEC).orderBy("cycle").collect()
    assert [r.v for r in got] == [None, 5.0, 5.0, 5.0]


@pytest.mark.parametrize("n", [1, 3, 16, 17, 64, 300])
@pytest.mark.parametrize("chunk", [None, 50])
def test_rolling(spark, pdf, n, chunk):
    spec = series.SeriesSpec(("series",), "cycle", bucket_width=64, chunk_rows=chunk)
    placed = series.with_position(spark_frame(spark, pdf), spec)
    features = [rolling.rolling(c, n, s, f"{c}{s}") for c in ("v", "a") for s in ("mean", "std")]
    got = pandas_sorted(series.add_features(placed, spec, features), ["series", "cycle"])
    grouped = pdf.groupby("series")
    for c in ("v", "a"):
        for s in ("mean", "std"):
            assert same(got[f"{c}{s}"], getattr(grouped[c].rolling(n), s)().reset_index(drop=True), 1e-7), (c, s)


def test_rolling_of_a_constant_is_flat(spark):
    df = spark.range(500).select(F.lit("s").alias("series"), F.col("id").alias("pos"), F.lit(0.1).alias("v"))
    out = series.add_features(df, SPEC, [rolling.rolling("v", 100, "std", "s"), rolling.rolling("v", 100, "mean", "m")])
    low, high, known = out.agg(F.max("s"), F.max(F.abs(F.col("m") - 0.1)), F.count("s")).first()
    assert low < 1e-12 and high < 1e-12 and known == 401


@pytest.mark.parametrize("chunk", [10, 100, None])
def test_shifts_keep_nulls_and_fill_edges(spark, pdf, chunk):
    spec = series.SeriesSpec(("series",), "cycle", bucket_width=64, chunk_rows=chunk)
    placed = series.with_position(spark_frame(spark, pdf), spec)
    got = pandas_sorted(shift.add_shifts(placed, spec, ["v", "a"], 12, both=True), ["series", "cycle"])
    grouped = pdf.groupby("series")
    for k in (1, 7, 12):
        for c in ("v", "a"):
            assert same(got[f"{c}_-{k}"], grouped[c].shift(k, fill_value=0))
            assert same(got[f"{c}_+{k}"], grouped[c].shift(-k, fill_value=0))
    assert list(got.columns)[6:10] == ["v_-1", "v_+1", "a_-1", "a_+1"] or set(got.columns) >= {"v_-1", "v_+1"}


def test_lag_arrays_equal_named_lags(spark, pdf):
    placed = series.with_position(spark_frame(spark, pdf), SPEC)
    features = shift.shift_features(["v"], 9) + shift.lag_array_features(["v"], 9)
    got = series.add_features(placed, SPEC, features).toPandas()
    for k in range(1, 10):
        assert same(got[f"v_-{k}"], got.v_lags.str[k - 1])
    assert shift.lag_names(["v"], 2) == ["v_-1", "v_-2"]


def test_difference_and_back(spark, pdf):
    placed = series.with_position(spark_frame(spark, pdf), SPEC)
    out = series.add_features(placed, SPEC, shift.difference_features(["a"]))
    back = pandas_sorted(series.add_features(out, SPEC, shift.undo_difference_features({"a_diff": "a"})), ["series", "cycle"])
    assert same(back.a_diff, pdf.groupby("series").a.diff())
    assert same(back.a_diff_undone[back.pos > 0], back.a[back.pos > 0])


@pytest.mark.parametrize("chunk", [20, None])
def test_windows(spark, pdf, chunk):
    spec = series.SeriesSpec(("series",), "cycle", bucket_width=64, chunk_rows=chunk)
    placed = series.with_position(spark_frame(spark, pdf), spec)
    got = pandas_sorted(sequence.supervised_windows(placed, spec, ["v", "a"], "a", 30), ["series", "pos"])
    assert len(got) == (1500 - 30) + (700 - 30)
    first = pdf[pdf.series == "s0"].reset_index(drop=True)
    for row in (0, 500, 1469):
        at = got[(got.series == "s0") & (got.pos == row + 30)].iloc[0]
        assert same([r["v"] for r in at.window], first.v[row:row + 30])
        assert at.a == first.a[row + 30]
    steps = pandas_sorted(sequence.multistep_windows(placed, spec, "a", 6, 2), ["series", "pos"])
    assert len(steps) == (1500 - 7) + (700 - 7)
    at = steps[(steps.series == "s0") & (steps.pos == 40)].iloc[0]
    assert list(at.inputs) == list(first.a[40:46]) and list(at.targets) == list(first.a[46:48])


def test_fitted_spec_bounds_buckets(spark):
    crowded = spark.range(20000).select(F.lit("s").alias("series"), F.when(F.col("id") < 19000, F.col("id"))
                                        .otherwise(F.col("id") * 1_000_000).alias("cycle"))
    spec = series.fit_spec(crowded, ["series"], "cycle", target_rows=500, min_pieces=16)
    fullest = crowded.groupBy(spec.bucket.alias("b")).count().agg(F.max("count")).first()[0]
    assert fullest <= 500


def test_one_crowded_key_is_refused(spark):
    df = spark.range(5000).select(F.lit("s").alias("series"), F.lit(7).cast("bigint").alias("cycle"))
    with pytest.raises(ValueError):
        series.fit_spec(df, ["series"], "cycle", target_rows=100, min_pieces=50)


def test_wide_rows_are_never_gathered(spark, pdf):
    placed = series.with_position(spark_frame(spark, pdf), SPEC, write=True)
    plan = series.add_features(placed, SPEC, rolling.rolling_bundle("v", "a", (64, 128)) + shift.shift_features(["v"], 5))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in text
    assert text.count("Exchange hashpartitioning") == 1


def test_nothing_depends_on_row_order(spark, pdf):
    def run(partitions):
        df = spark_frame(spark, pdf.sample(frac=1, random_state=partitions), partitions=partitions)
        filled = clean.forward_fill(series.bucketed(df, SPEC), SPEC, ["v"]).filter(F.col("tag").contains("run"))
        placed = series.with_position(filled, SPEC).drop(series.BUCKET)
        return pandas_sorted(series.add_features(placed, SPEC, rolling.rolling_bundle("v", "a", (20,))), ["series", "pos"])
    one, many = run(1), run(8)
    assert (one.cycle == many.cycle).all() and same(one.MeanV20, many.MeanV20) and same(one.StdV20, many.StdV20)
    assert np.isnan(one.MeanV20).sum() > 0
