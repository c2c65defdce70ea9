"""Order by lines of files, sinks in row order, and the pyramid of extremes."""

import glob

import numpy as np
import pandas as pd
import pytest
from helpers import same, spark_frame

from signalloom.operators import diag
from signalloom.sources import csv, layouts


@pytest.fixture
def small_pieces(spark):
    """Files are read in pieces of some 2,000 bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def _numbers(n, seed=2):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 10, n), np.round(rng.normal(0, 9, n), int(rng.integers(1, 6)))


def test_split_files_with_repeated_index_keep_their_lines(spark, tmp_path, small_pieces):
    idx, v = _numbers(3000)
    for name, rows in (("b", range(1800, 3000)), ("a", range(1800)), ("c", [])):
        (tmp_path / f"{name}.csv").write_text("\n".join([",x", *[f"{idx[i]},{v[i]}" for i in rows]]) + "\n")
    read = csv.scan_signals(spark, str(tmp_path), {"x": "double"}, line="line")
    got = read.toPandas().sort_values("line")
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
    assert got["line"].tolist() == list(range(3000))
    assert got["idx"].tolist() == idx.tolist() and same(got["x"], v)


def test_lines_of_an_empty_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",x\n")
    read = csv.scan_signals(spark, str(tmp_path), {"x": "double"}, line="line")
    assert read.columns == ["idx", "x", "line"] and read.count() == 0


def test_layouts_by_line(spark, tmp_path):
    names = [f"X1_{s}" for s in layouts.SIGNALS_2023.values()]
    rows = [f"2023-01-16,2023-01-16 12:53:0{i},run,N1," + ",".join([f"{i}.5"] * 4) for i in (7, 3, 3, 9)]
    (tmp_path / "a.csv").write_text("\n".join([f",{layouts.TIME_2023},{layouts.TAG_2023},{layouts.BLOCK_2023}," + ",".join(names), *rows]) + "\n")
    wide = layouts.scan_2023(spark, str(tmp_path / "a.csv"), ["X"], index_type="timestamp_ntz", line="line")
    long = layouts.long_2023(wide, ["X"], "line").orderBy("cycle").collect()
    assert [(r.cycle, r.v) for r in long] == [(0, 7.5), (1, 3.5), (2, 3.5), (3, 9.5)]


@pytest.mark.parametrize("axes,kind", [(["X", "Y", "Z"], "string"), ([0, 1, 2], "int")])
def test_parts_of_a_sink_concatenate_to_the_file(spark, tmp_path, small_pieces, axes, kind):
    """One axis with most rows, so that its folder has several parts."""
    sizes = dict(zip(axes, (6000, 40, 0)))
    pdf = pd.concat([pd.DataFrame({"axis": a, "pos": np.arange(n), "y_pred": _numbers(n)[1]}) for a, n in sizes.items()], ignore_index=True)
    df = spark_frame(spark, pdf.sample(frac=1, random_state=1), f"axis {kind}, pos bigint, y_pred double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        csv.write_predictions(df, str(tmp_path / "p"), in_order=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for a in axes:
        parts = sorted(glob.glob(str(tmp_path / "p" / f"axis={a}" / "part-*")))
        assert len(parts) > 3 or sizes[a] < 100
        lines = [float(x) for p in parts for x in open(p).read().split()]
        assert lines == pdf[pdf["axis"] == a]["y_pred"].tolist()
    read = csv.scan_numbers(spark, str(tmp_path / "p"), {"y_pred": "double"}, {"axis": kind}, line="pos")
    got = read.toPandas().sort_values(["axis", "pos"], ignore_index=True)
    assert got["pos"].tolist() == pdf["pos"].tolist() and same(got["y_pred"], pdf["y_pred"])


def test_outliers_and_signals_in_order(spark, tmp_path):
    pdf = pd.DataFrame({"axis": [1, 1, 1, 2], "rank": [2, 1, 3, 1], "pos": [40, 7, 12, 5]})
    csv.write_outliers(spark_frame(spark, pdf, "axis int, rank bigint, pos bigint"), str(tmp_path / "o"), in_order=True)
    parts = sorted(glob.glob(str(tmp_path / "o" / "axis=1" / "part-*")))
    assert "".join(open(p).read() for p in parts).split() == ["7", "40", "12"]
    csv.write_signals(spark_frame(spark, pdf, "axis int, rank bigint, pos bigint"), str(tmp_path / "s"), ["pos"])
    read = csv.scan_signals(spark, str(tmp_path / "s"), {"pos": "bigint"}, line="line")
    assert [r.pos for r in read.orderBy("line").collect()] == [5, 7, 12, 40]


def _cells(pdf, width):
    groups = pdf.assign(cell=pdf["pos"] // width).groupby(["series", "cell"])["v"]
    return groups.agg(["size", "min", "max"]).reset_index()


def test_pyramid_equals_pandas_and_zooms_are_bounded(spark, tmp_path):
    rng = np.random.default_rng(4)
    pdf = pd.concat([pd.DataFrame({"series": f"s{i}", "pos": np.arange(n), "v": rng.normal(0, 9, n)}) for i, n in enumerate((5000, 300, 1))])
    pdf.loc[(pdf["series"] == "s0") & pdf["pos"].between(16, 40), "v"] = np.nan
    df = spark_frame(spark, pdf, "series string, pos bigint, v double")
    path = str(tmp_path / "pyramid")
    diag.write_pyramid(diag.pyramid(df, ["v"], ["series"], base=8, fan=4), path, ["series"])
    cells = spark.read.parquet(path)
    got = cells.toPandas()
    assert sorted(got["level"].unique()) == list(range(6)) and (got[got["level"] == 5].groupby("series").size() == 1).all()
    for level, part in got.groupby("level"):
        part = part.sort_values(["series", "cell"], ignore_index=True)
        want = _cells(pdf, 8 * 4 ** level)
        assert part["n_rows"].tolist() == want["size"].tolist() and part["cell"].tolist() == want["cell"].tolist()
        assert same(part["v_min"], want["min"]) and same(part["v_max"], want["max"])
    for start, stop, most in ((0, 5000, 10), (123, 1999, 40), (17, 18, 2), (0, 10 ** 9, 2), (4990, 5000, 3)):
        shown = diag.zoomed(cells, start, stop, most, 8, 4).toPandas()
        assert shown.groupby("series").size().max() <= most
        for name, rows in pdf[pdf["pos"].between(start, stop - 1)].groupby("series"):
            mine = shown[shown["series"] == name]
            if rows["v"].notna().any():
                assert mine["v_min"].min() <= rows["v"].min() and mine["v_max"].max() >= rows["v"].max()
            assert mine["start"].min() <= start and mine["stop"].max() >= min(stop, rows["pos"].max() + 1)
    assert diag.zoomed(cells, 5, 5, 10, 8, 4).count() == 0


def test_pyramid_of_nothing(spark):
    df = spark.createDataFrame([], "series string, pos bigint, v double")
    cells = diag.pyramid(df, ["v"], ["series"])
    assert cells.count() == 0 and diag.zoomed(cells, 0, 100, 5).count() == 0
    with pytest.raises(ValueError):
        diag.zoom_level(10, 1)
