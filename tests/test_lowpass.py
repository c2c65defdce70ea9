"""The low-pass of any order against a row-by-row filter of another form."""

import math

import numpy as np
import pandas as pd
import pytest
from helpers import pandas_sorted, spark_frame

from signalloom.operators import lowpass
from signalloom.operators.series import SeriesSpec

SPEC = SeriesSpec(("series",), "pos")


def trapezoidal(x, order, cutoff):
    """One pass as a chain of integrators, started in the steady state of the first value."""
    g = math.tan(math.pi * cutoff / 2)
    y = np.array(x, float)
    if order % 2:
        state, out = y[0], np.empty_like(y)
        for i, value in enumerate(y):
            step = (value - state) * g / (1 + g)
            out[i] = step + state
            state = out[i] + step
        y = out
    for j in range(order // 2):
        k = 2 * math.cos(math.pi * (2 * j + 1) / (2 * order) if order % 2 == 0 else math.pi * (j + 1) / order)
        a1 = 1 / (1 + g * (g + k))
        first, second, out = 0.0, y[0], np.empty_like(y)
        for i, value in enumerate(y):
            rest = value - second
            v1 = a1 * first + g * a1 * rest
            v2 = second + g * a1 * first + g * g * a1 * rest
            first, second, out[i] = 2 * v1 - first, 2 * v2 - second, v2
        y = out
    return y


def both_ways(x, order, cutoff):
    edge = 3 * (order + 1)
    x = np.concatenate([2 * x[0] - x[edge:0:-1], x, 2 * x[-1] - x[-2:-edge - 2:-1]])
    there = trapezoidal(x, order, cutoff)
    return trapezoidal(there[::-1], order, cutoff)[::-1][edge:-edge]


def _series(sizes, seed=5):
    rng = np.random.default_rng(seed)
    return pd.concat([pd.DataFrame({"series": f"s{i}", "pos": np.arange(n), "v": np.round(np.cumsum(rng.normal(0, 3, n)) + 40, 3)})
                      for i, n in enumerate(sizes)], ignore_index=True)


@pytest.mark.parametrize("order,cutoff", [(1, 1e-4), (2, 0.1), (3, 0.5), (4, 0.1), (4, 1e-4), (5, 0.93), (8, 0.02), (2, 1e-6)])
def test_any_order_equals_the_row_by_row_filter(spark, order, cutoff):
    pdf = _series((9000, 700, 28))
    df = spark_frame(spark, pdf, "series string, pos bigint, v double")
    got = pandas_sorted(lowpass.low_pass(df, SPEC, "v", cutoff, "f", order=order), ["series", "pos"])
    want = np.concatenate([both_ways(g["v"].to_numpy(), order, cutoff) for _, g in pdf.groupby("series")])
    assert np.abs(got["f"].to_numpy() - want).max() < 1e-7
    assert list(got["v"]) == list(pdf["v"])


@pytest.mark.parametrize("order", [1, 3])
def test_many_chunks_hand_on_their_states(spark, monkeypatch, order):
    """Chunks of 64 rows, 140 of them in a series, so that the scan takes several steps."""
    monkeypatch.setattr(lowpass, "PLAIN_ROWS", 64)
    pdf = _series((9000, 65))
    df = spark_frame(spark, pdf, "series string, pos bigint, v double")
    got = pandas_sorted(lowpass.carried_low_pass(df, SPEC, "v", 1e-3, order, "f"), ["series", "pos"])
    want = np.concatenate([both_ways(g["v"].to_numpy(), order, 1e-3) for _, g in pdf.groupby("series")])
    assert np.abs(got["f"].to_numpy() - want).max() < 1e-7


def test_both_forms_of_first_order_agree(spark):
    df = spark_frame(spark, _series((5000,)), "series string, pos bigint, v double")
    halo = pandas_sorted(lowpass.low_pass(df, SPEC, "v", 0.1, "f"), ["series", "pos"])["f"]
    carried = pandas_sorted(lowpass.carried_low_pass(df, SPEC, "v", 0.1, 1, "f"), ["series", "pos"])["f"]
    assert np.abs(halo - carried).max() < 1e-10


def test_missing_values_short_series_and_bad_settings(spark):
    pdf = _series((40, 50))
    pdf.loc[10, "v"] = np.nan
    df = spark_frame(spark, pdf, "series string, pos bigint, v double")
    got = pandas_sorted(lowpass.low_pass(df, SPEC, "v", 0.2, "f", order=2), ["series", "pos"])
    assert got["f"].isna().tolist() == [True] * 40 + [False] * 50
    assert lowpass.low_pass(df.limit(0), SPEC, "v", 0.2, "f", order=2).count() == 0
    with pytest.raises(Exception, match="too short"):
        lowpass.low_pass(spark_frame(spark, _series((9,)), "series string, pos bigint, v double"), SPEC, "v", 0.2, "f", order=2).collect()
    for order, cutoff in ((0, 0.1), (9, 0.1), (2, 1.0)):
        with pytest.raises(ValueError):
            lowpass.butterworth_modes(order, cutoff)
