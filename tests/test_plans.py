"""Plans and pipelines that must keep all rows and touch only what they need."""

from pyspark.sql import functions as F

from signalloom.operators import series
from signalloom.plans import prepare


def _gappy(spark):
    rows = [("s", i, "run one" if i % 5 == 0 else None, float(i) if i % 3 else None, float(i % 7) if i % 2 else None,
             float(2 * i) if i % 4 else None, float(i) if i % 6 else None, float(-i)) for i in range(1, 51)]
    return spark.createDataFrame(rows, "series string, cycle bigint, tag string, v double, a double, fm double, fb double, other double")


def test_no_row_is_lost_to_gaps(spark):
    spec = series.fit_spec(_gappy(spark), ["series"], "cycle")
    run = prepare.measurement_run(_gappy(spark), spec, "run").toPandas().sort_values("pos", ignore_index=True)
    want = _gappy(spark).toPandas().sort_values("cycle")
    want[["tag", "v", "a", "fm", "fb"]] = want[["tag", "v", "a", "fm", "fb"]].ffill()
    want = want[want.tag.notna()].reset_index(drop=True)
    assert len(run) == len(want) == 46 and (run.n_rows == 46).all()
    for c in ("v", "a", "fm", "fb"):
        assert (run[c] == want[c]).all()
    assert (run.fr == want.fm - want.fb).all()


def test_run_reads_and_writes_what_is_asked(spark, tmp_path):
    _gappy(spark).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    spec = series.fit_spec(table, ["series"], "cycle")
    run = prepare.measurement_run(table, spec, "run", ("v",), write=True)
    assert set(run.columns) == {"series", "cycle", "v", "pos", "n_rows"}
    lazy = prepare.measurement_run(table, spec, "run").select("series", "pos", "v")
    plan = lazy._jdf.queryExecution().executedPlan().toString()
    for line in (x for x in plan.splitlines() if "FileScan" in x):
        assert not any(c in line.split("ReadSchema")[-1] for c in ("fm", "fb", "other")), line


def test_another_target(spark):
    spec = series.fit_spec(_gappy(spark), ["series"], "cycle")
    run = prepare.measurement_run(_gappy(spark), spec, "run", ("v", "other"), target="other", parts=None)
    assert "fr" not in run.columns and run.filter(F.col("other").isNull()).count() == 0 and run.count() == 46
