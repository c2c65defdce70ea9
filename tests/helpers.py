"""Small fixtures with every kind of gap, and plain reference computations."""

import numpy as np
import pandas as pd

TYPES = "series string, cycle bigint, v double, a double, tag string"


def gappy(rows=(1500, 700, 5), seed=3):
    """Series of different lengths: nulls at the start, a long null run, nulls at the end, single nulls."""
    rng = np.random.default_rng(seed)
    frames = []
    for i, n in enumerate(rows):
        v = np.round(rng.normal(10, 50, n), 3)
        v[rng.random(n) < 0.1] = np.nan
        v[: min(4, n - 1)] = np.nan
        if n > 600:
            v[100:500] = np.nan
            v[-20:] = np.nan
        frames.append(pd.DataFrame({
            "series": f"s{i}", "cycle": np.cumsum(rng.integers(1, 5, n)), "v": v, "a": np.round(rng.exponential(5, n), 2),
            "tag": rng.choice(["run one", "run two", "idle"], n)}))
    return pd.concat(frames, ignore_index=True)


def spark_frame(spark, pdf, types=TYPES, partitions=8):
    clean = pdf.astype(object).where(pdf.notna(), None)
    return spark.createDataFrame([tuple(r) for r in clean.itertuples(index=False)], types).repartition(partitions)


def pandas_sorted(df, by):
    return df.toPandas().sort_values(by, ignore_index=True)


def same(left, right, tolerance=1e-9):
    left, right = np.asarray(left, float), np.asarray(right, float)
    return bool(np.all((np.isnan(left) & np.isnan(right)) | (np.abs(left - right) <= tolerance)))
