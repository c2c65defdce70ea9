"""Runs against pandas, for layouts with far more and far fewer buckets than runs."""

import numpy as np
import pandas as pd
import pytest
from helpers import pandas_sorted, spark_frame

from signalloom.operators import rolling, runs, sequence, series, shift
from signalloom.operators.series import SeriesSpec

TYPES = "series string, cycle bigint, tag string, v double"


def _frame(sizes, share, seed=1):
    """Tags that stay with probability `share`, nulls among them, order keys with gaps."""
    rng = np.random.default_rng(seed)
    parts = []
    for i, n in enumerate(sizes):
        turns = np.cumsum(rng.random(n) > share)
        names = np.array(["run", "idle", None, "other run"], dtype=object)[rng.integers(0, 4, n + 1)]
        parts.append(pd.DataFrame({"series": f"s{i}", "cycle": np.cumsum(rng.integers(1, 6, n)), "tag": names[turns], "v": rng.normal(0, 5, n).round(3)}))
    return pd.concat(parts, ignore_index=True)


def _numbered(pdf):
    tag = pdf["tag"].fillna("<null>")
    turn = tag.ne(tag.shift()) & pdf["series"].eq(pdf["series"].shift())
    out = pdf.assign(run=turn.groupby(pdf["series"]).cumsum().astype(int))
    return out.assign(run_pos=out.groupby(["series", "run"]).cumcount())


@pytest.mark.parametrize("width", [1, 7, 300, 10_000])
@pytest.mark.parametrize("share", [0.0, 0.9, 0.998])
def test_runs_equal_pandas(spark, width, share):
    pdf = _frame((900, 40, 1), share)
    out = runs.with_run(spark_frame(spark, pdf, TYPES), SeriesSpec(("series",), "cycle", (), width))
    got, want = pandas_sorted(out, ["series", "cycle"]), _numbered(pdf)
    assert out.columns == [*pdf.columns, "run", "run_pos"]
    assert got["run"].tolist() == want["run"].tolist() and got["run_pos"].tolist() == want["run_pos"].tolist()


def test_one_run_over_all_buckets_and_an_empty_table(spark):
    pdf = _frame((500,), 1.0)
    df = spark_frame(spark, pdf.assign(tag=None), TYPES)
    spec = SeriesSpec(("series",), "cycle", (), 9)
    got = pandas_sorted(runs.with_run(df, spec), ["series", "cycle"])
    assert set(got["run"]) == {0} and got["run_pos"].tolist() == list(range(500))
    assert runs.with_run(df.limit(0), spec).count() == 0


def test_features_end_with_their_run(spark):
    pdf = _frame((800, 60), 0.95)
    spec = SeriesSpec(("series",), "cycle", (), 50)
    numbered = runs.with_run(spark_frame(spark, pdf, TYPES), spec)
    inside = runs.run_spec(spec)
    out = series.add_features(numbered, inside, [*shift.shift_features(["v"], 2, default=None), rolling.rolling("v", 4, "mean", pos="run_pos")], "run_pos")
    got, want = pandas_sorted(out, ["series", "cycle"]), _numbered(pdf)
    groups = want.groupby(["series", "run"])["v"]
    assert np.allclose(got["v_-1"], groups.shift(1), equal_nan=True) and np.allclose(got["v_-2"], groups.shift(2), equal_nan=True)
    assert np.allclose(got["v_mean4"], groups.rolling(4).mean().reset_index([0, 1], drop=True).sort_index(), equal_nan=True)
    windows = sequence.supervised_windows(numbered, inside, ["v"], "v", 5, "run_pos")
    assert windows.count() == int(np.maximum(groups.size() - 5, 0).sum())
