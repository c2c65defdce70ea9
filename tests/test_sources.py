import pytest

from signalloom.operators import clean, project
from signalloom.sources import csv, layouts


def test_lettered_layout(spark, tmp_path):
    names = [f"{a}1_{s}" for a in "XYZ" for s in ("v_dir_lp", "a_dir_lp", "FM_lp", "FB_dir_lp")]
    head = ",time_,CH1_ProcessTag2,CH1_ActProgramBlock,/Channel/ProgramInfo/block|u1.2," + ",".join(names)
    rows = ["0,2023-01-16 12:53:00,Lineare_Referenzfahrt_Feed_1,N10,u," + ",".join(["1.5"] * 12),
            "1,2023-01-16 12:53:01,nan,,u," + ",".join(["nan"] * 6 + [""] * 3 + ["-2.5e1"] * 3)]
    path = tmp_path / "b.csv"
    path.write_text("\n".join([head, *rows]) + "\n")
    df = layouts.scan_2023(spark, str(path)).orderBy("idx").collect()
    assert df[0].idx == 0 and df[0].series == "file" and df[0]["Z1_FB_dir_lp"] == 1.5
    assert df[1].tag is None and df[1].block is None and df[1]["X1_v_dir_lp"] is None and df[1]["Z1_FB_dir_lp"] == -25.0
    long = layouts.long_2023(layouts.scan_2023(spark, str(path)))
    assert long.count() == 6 and long.columns == ["series", "cycle", "ts", "tag", "axis", "v", "a", "fm", "fb"]
    assert {r.name: r.n_null for r in clean.null_counts(long).collect()}["v"] == 3


def test_numbered_layout(spark, tmp_path):
    head = f",{layouts.TIME_2022},CYCLE,{layouts.AXIS_2022},{layouts.TAG_2022},DES_POS|1,CURRENT|1,DES_POS|2"
    path = tmp_path / "a.csv"
    path.write_text(head + "\n5,2022-07-28 10:00:00.25,12,1,Lineare_Referenzfahrt_Feed,0.5,1.25,9\n")
    row = layouts.scan_2022(spark, str(path), ["DES_POS|1", "CURRENT|1"]).first()
    assert (row.idx, row.cycle, row.axis, row["CURRENT|1"], str(row.ts)) == (5, 12, 1, 1.25, "2022-07-28 10:00:00.250000")


def test_bad_number_is_an_error(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text(",x\n0,1.5\n1,oops\n")
    with pytest.raises(Exception):
        csv.scan_signals(spark, str(path), {"x": "double"}).collect()


def _write(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


@pytest.mark.parametrize("line", ["0,1.5", "0,1.5,2,3", "0"])
def test_short_and_long_lines_are_errors(spark, tmp_path, line):
    path = _write(tmp_path, c=f",x,y\n1,2.5,3.5\n{line}\n")
    with pytest.raises(Exception):
        csv.scan_signals(spark, path, {"x": "double"}).collect()


def test_another_column_order_is_an_error(spark, tmp_path):
    path = _write(tmp_path, a=",x,y\n0,1,2\n", b=",y,x\n1,2,1\n")
    with pytest.raises(ValueError, match="different headers"):
        csv.scan_signals(spark, path, {"x": "double", "y": "double"})
    with pytest.raises(ValueError, match="no header"):
        csv.scan_signals(spark, _empty(tmp_path), {"x": "double"})


def _empty(tmp_path):
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.csv").write_text("")
    return str(tmp_path / "none")


def test_index_types_and_whole_numbers(spark, tmp_path):
    path = _write(tmp_path, c=",n,t\n2022-07-28 10:00:00,12.0,\"a \"\"b\"\"\"\n2022-07-29,9007199254740993,nan\n")
    rows = csv.scan_signals(spark, path, {"n": "bigint", "t": "string"}, index_type="timestamp_ntz").orderBy("idx").collect()
    assert [(str(r.idx), r.n, r.t) for r in rows] == [("2022-07-28 10:00:00", 12, 'a "b"'), ("2022-07-29 00:00:00", 9007199254740993, None)]
    with pytest.raises(Exception):
        csv.scan_signals(spark, _write(tmp_path, c=",n\n0,12.5\n"), {"n": "int"}).collect()


def test_result_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 2.5), (1, 1, -3.0), (2, 0, 0.125)], "axis int, pos bigint, y_pred double")
    csv.write_predictions(df, str(tmp_path / "y"))
    back = csv.scan_numbers(spark, str(tmp_path / "y"), {"pos": "bigint", "y_pred": "double"}, {"axis": "int"})
    assert sorted(map(tuple, back.collect())) == [(1, 0, 2.5), (1, 1, -3.0), (2, 0, 0.125)]
    letters = df.selectExpr("IF(axis = 1, 'X', 'Y') AS axis", "pos AS rank", "pos * 10 AS pos")
    csv.write_outliers(letters, str(tmp_path / "i"))
    ranks = csv.scan_numbers(spark, str(tmp_path / "i"), {"rank": "bigint", "pos": "bigint"}, {"axis": "string"})
    assert sorted(map(tuple, ranks.collect())) == [("X", 0, 0), ("X", 1, 10), ("Y", 0, 0)]
    (tmp_path / "n.csv").write_text("3.0\n1.0\n")
    assert sorted(r.x for r in csv.scan_numbers(spark, str(tmp_path / "n.csv"), {"x": "int"}).collect()) == [1, 3]


def test_pairs_need_both_sides(spark):
    one, two = spark.createDataFrame([(1, 2.0), (2, 3.0)], "pos bigint, a double"), spark.createDataFrame([(2, 5.0), (1, 4.0)], "pos bigint, b double")
    assert sorted(map(tuple, project.paired(one, two, ["pos"]).collect())) == [(1, 2.0, 4.0), (2, 3.0, 5.0)]
    for left, right in ((one.limit(1), two), (one, two.limit(1))):
        with pytest.raises(Exception, match="partner"):
            project.paired(left, right, ["pos"]).collect()
