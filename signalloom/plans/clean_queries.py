"""Scans, sinks, projections, cleaning, filters and joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from signalloom.functions import scalar
from signalloom.functions.scalar import named
from signalloom.operators import clean, diag, project, score, series, shift, split
from signalloom.plans.registry import (RUN, THRESHOLD, predicted_of, query, rnd, run_of, signals, spec_for, sql, sql_rnd)
from signalloom.session import scratch_path
from signalloom.sources import csv, layouts

# --- sources and sinks ---------------------------------------------------------------------


@query("s01_csv_scan", sql("sig", """
SELECT cycle AS idx, strftime(ts, '%Y-%m-%d %H:%M:%S') AS second, tag, v, a FROM sig"""))
def csv_scan(spark, sf_dir):
    path = scratch_path(spark, "signals")
    csv.write_signals(signals(spark, sf_dir).select(
        F.col("cycle").alias("idx"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time_"),
        F.col("tag").alias("CH1_ProcessTag2"), F.col("v").alias("X1_v_dir_lp"), F.col("a").alias("X1_a_dir_lp")), path)
    read = csv.scan_signals(
        spark, path, {"time_": "string", "CH1_ProcessTag2": "string", "X1_v_dir_lp": "double", "X1_a_dir_lp": "double"},
        rename={"time_": "ts", "CH1_ProcessTag2": "tag", "X1_v_dir_lp": "v", "X1_a_dir_lp": "a"})
    stamp = F.date_format(scalar.parse_time(F.col("ts")), "yyyy-MM-dd HH:mm:ss")
    return read.select("idx", stamp.alias("second"), "tag", "v", "a")


@query("s01b_csv_scan_dates", sql("sig", """
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS second, cycle, CAST(axis + 1 AS INTEGER) AS axis, tag, v, a FROM sig"""))
def csv_scan_dates(spark, sf_dir):
    """The numbered-axis layout: dates as index, whole numbers written with a fraction of zero."""
    path = scratch_path(spark, "signals")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    csv.write_signals(signals(spark, sf_dir).select(
        stamp.alias("idx"), stamp.alias(layouts.TIME_2022), F.concat(F.col("cycle"), F.lit(".0")).alias(layouts.CYCLE_2022),
        F.concat(F.col("axis") + 1, F.lit(".0")).alias(layouts.AXIS_2022), F.col("tag").alias(layouts.TAG_2022),
        F.col("v").alias("DES_POS|1"), F.col("a").alias("CURRENT|1")), path)
    read = layouts.scan_2022(spark, path, ["DES_POS|1", "CURRENT|1"], index_type="timestamp_ntz")
    return read.select(F.date_format("idx", "yyyy-MM-dd HH:mm:ss").alias("second"), "cycle", "axis", "tag",
                       named("DES_POS|1").alias("v"), named("CURRENT|1").alias("a"))


def _outliers(spark, sf_dir):
    predicted, spec = predicted_of(spark, sf_dir)
    return score.outliers(predicted.select("axis", "pos", "err"), threshold=THRESHOLD, by=spec.keys)


OUTLIERS = f"""outliers AS (
  SELECT *, row_number() OVER (PARTITION BY axis ORDER BY err DESC, pos) AS rank FROM pred WHERE err > {THRESHOLD})"""


@query("s02_number_scan", sql("pred", "SELECT CAST(pos AS INTEGER) AS x FROM outliers", more=OUTLIERS))
def number_scan(spark, sf_dir):
    path = scratch_path(spark, "numbers")
    _outliers(spark, sf_dir).select("pos").write.csv(path, header=False)
    return csv.scan_numbers(spark, path, {"x": "int"})


_LETTERS = "['X', 'Y', 'Z'][axis + 1]"


@query("s03_prediction_sink", sql("pred", f"SELECT axis, pos, {sql_rnd('y_pred')} AS y_pred FROM pred"))
def prediction_sink(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    csv.write_predictions(predicted_of(spark, sf_dir)[0], path)
    read = csv.scan_numbers(spark, path, {"pos": "bigint", "y_pred": "double"}, {"axis": "int"})
    return read.select("axis", "pos", rnd("y_pred").alias("y_pred"))


def _lettered(df):
    return df.withColumn("axis", F.element_at(F.array(*map(F.lit, "XYZ")), F.col("axis") + 1))


@query("s03b_prediction_sink_letters", sql("pred", f"SELECT {_LETTERS} AS axis, pos, {sql_rnd('y_pred')} AS y_pred FROM pred"))
def prediction_sink_letters(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    csv.write_predictions(_lettered(predicted_of(spark, sf_dir)[0]), path)
    read = csv.scan_numbers(spark, path, {"pos": "bigint", "y_pred": "double"}, {"axis": "string"})
    return read.select("axis", "pos", rnd("y_pred").alias("y_pred"))


@query("s03c_predictions_in_order", sql("pred", f"SELECT axis, pos, {sql_rnd('y_pred')} AS y_pred FROM pred"))
def predictions_in_order(spark, sf_dir):
    """One number a line; the position is the line."""
    path = scratch_path(spark, "predictions")
    csv.write_predictions(predicted_of(spark, sf_dir)[0], path, in_order=True)
    read = csv.scan_numbers(spark, path, {"y_pred": "double"}, {"axis": "int"}, line="pos")
    return read.select("axis", "pos", rnd("y_pred").alias("y_pred"))


@query("s04_outlier_sink", sql("pred", "SELECT axis, rank, pos FROM outliers", more=OUTLIERS))
def outlier_sink(spark, sf_dir):
    path = scratch_path(spark, "outliers")
    csv.write_outliers(_outliers(spark, sf_dir), path)
    return csv.scan_numbers(spark, path, {"rank": "bigint", "pos": "bigint"}, {"axis": "int"})


@query("s04b_outlier_sink_letters", sql("pred", f"SELECT {_LETTERS} AS axis, rank, pos FROM outliers", more=OUTLIERS))
def outlier_sink_letters(spark, sf_dir):
    path = scratch_path(spark, "outliers")
    csv.write_outliers(_lettered(_outliers(spark, sf_dir)), path)
    return csv.scan_numbers(spark, path, {"rank": "bigint", "pos": "bigint"}, {"axis": "string"})


@query("s04c_outliers_in_order", sql("pred", f"SELECT {_LETTERS} AS axis, rank, pos FROM outliers", more=OUTLIERS))
def outliers_in_order(spark, sf_dir):
    """One position a line, worst first; the rank is the line, and lettered axes are the folders."""
    path = scratch_path(spark, "outliers")
    csv.write_outliers(_lettered(_outliers(spark, sf_dir)), path, in_order=True)
    read = csv.scan_numbers(spark, path, {"pos": "bigint"}, {"axis": "string"}, line="line")
    return read.select("axis", (F.col("line") + 1).alias("rank"), "pos")


_COLUMNS = [("series", "string"), ("axis", "int"), ("cycle", "bigint"), ("ts", "timestamp_ntz"), ("tag", "string"),
            ("v", "double"), ("a", "double"), ("fm", "double"), ("fb", "double")]


@query("s05_table_profile", sql("sig", " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS ordinal, '{c}' AS name, '{t}' AS type, count(*) - count({c}) AS n_null FROM sig"
    for i, (c, t) in enumerate(_COLUMNS))))
def table_profile(spark, sf_dir):
    return clean.table_profile(signals(spark, sf_dir))


# --- projections ---------------------------------------------------------------------------


@query("p01_select", sql("sig", "SELECT axis, cycle, v, a FROM sig"))
def select(spark, sf_dir):
    return project.choose(signals(spark, sf_dir), ["axis", "cycle", "v", "a"])


@query("p02_axis_inputs", sql("sig", "SELECT cycle // 3 AS step, " + ", ".join(
    f"max(CASE WHEN axis = {k} THEN {s} END) AS \"{s}|{k}\"" for k in range(3) for s in ("v", "a", "fm"))
    + " FROM sig GROUP BY 1"))
def axis_inputs(spark, sf_dir):
    steps = signals(spark, sf_dir).withColumn("step", F.expr("cycle div 3"))
    return project.axis_inputs(steps, ["step"], ["v", "a", "fm"], [0, 1, 2])


@query("p02b_active_axis_inputs", sql("sig", """
SELECT cycle, v AS "v|1", a AS "a|1", fm AS "fm|1" FROM sig WHERE axis = 1"""))
def active_axis_inputs(spark, sf_dir):
    return project.axis_inputs(signals(spark, sf_dir), ["cycle"], ["v", "a", "fm"], [0, 1, 2], active=1)


@query("p03_drop", sql("sig", "SELECT * EXCLUDE (ts, fm, fb) FROM sig"))
def drop(spark, sf_dir):
    return project.without(signals(spark, sf_dir), ["ts", "fm", "fb"])


@query("p04_residual", sql("sig", f"SELECT axis, cycle, {sql_rnd('fm - fb')} AS fr FROM sig"))
def residual(spark, sf_dir):
    return project.add_residual(signals(spark, sf_dir)).select("axis", "cycle", rnd("fr").alias("fr"))


@query("p05_encoder_difference", sql("sig", f"SELECT axis, cycle, {sql_rnd('v - a')} AS enc_diff FROM sig"))
def encoder_difference(spark, sf_dir):
    df = signals(spark, sf_dir).select("axis", "cycle", "v", "a")
    return project.replace_by_difference(df, "v", "a", "enc_diff").withColumn("enc_diff", rnd("enc_diff"))


@query("p06_step_names", sql("run", "SELECT axis, pos, v, a, " + ", ".join(
    f"{f}({c}, {k}, CAST(0 AS DOUBLE)) OVER (PARTITION BY axis ORDER BY pos) AS \"{c}_{s}{k}\""
    for k in (1, 2) for c in ("v", "a") for f, s in (("lag", "-"), ("lead", "+"))) + " FROM run"))
def step_names(spark, sf_dir):
    run, spec = run_of(spark, sf_dir)
    return shift.add_shifts(run.select("axis", "pos", "v", "a"), spec, ["v", "a"], 2, both=True)


@query("p07_reorder", sql("run", """
SELECT axis, pos, list_reduce(list_transform(list_reverse_sort([{r: abs(corr_v), n: 'v'}, {r: abs(corr_a), n: 'a'}, {r: abs(corr_p), n: 'place'}]),
         lambda x: x.n), lambda x, y: x || ' ' || y) AS in_order, v, a, CAST(cycle AS DOUBLE) AS place
FROM run, (SELECT corr(v, fr) AS corr_v, corr(a, fr) AS corr_a, corr(cycle, fr) AS corr_p FROM run)"""))
def reorder(spark, sf_dir):
    """Columns by the strength of their correlation with the target, and the order as data."""
    run, _ = run_of(spark, sf_dir, columns=("v", "a", "fr"))
    wide = run.select("axis", "pos", "v", "a", F.col("cycle").cast("double").alias("place"), "fr")
    strength = score.correlations(wide, ["v", "a", "place", "fr"]).filter((F.col("a") != "fr") & (F.col("b") == "fr"))
    place = F.row_number().over(Window.orderBy(F.abs("r").desc(), F.col("a").desc()))  # one row per column
    ranking = strength.select(F.col("a").alias("name"), place.alias("rank"))
    ordered = project.reorder_by(wide, ranking, keep=["axis", "pos"])
    return ordered.withColumn("in_order", F.lit(" ".join(ordered.columns[2:])))


@query("p08_parse_time", sql("sig", "SELECT cycle, strftime(ts, '%Y-%m-%d %H:%M:%S') AS second, "
                                    "CAST(hour(ts) AS INTEGER) AS hour FROM sig"))
def parse_time(spark, sf_dir):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    df = signals(spark, sf_dir).select("cycle", scalar.parse_time(text).alias("ts"))
    return df.select("cycle", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("second"), F.hour("ts").alias("hour"))


@query("p09_day_text", sql("sig", "SELECT cycle, strftime(ts, '%Y-%m-%d') AS day FROM sig"))
def day_text(spark, sf_dir):
    return signals(spark, sf_dir).select("cycle", scalar.day_text(F.col("ts")).alias("day"))


@query("p10_absolute_error", sql("pred", f"SELECT axis, pos, {sql_rnd('err')} AS err FROM pred"))
def absolute_error(spark, sf_dir):
    predicted, _ = predicted_of(spark, sf_dir)
    return predicted.select("axis", "pos", rnd(scalar.absolute_error(F.col("fr"), F.col("y_pred"))).alias("err"))


@query("p11_stabilise", sql("sig", f"""
SELECT cycle, {sql_rnd('z', 9)} AS z, {sql_rnd('exp(z * z)', 7)} AS back
FROM (SELECT cycle, CASE WHEN fm >= 1 THEN sqrt(ln(fm)) END AS z FROM sig)"""))
def stabilise(spark, sf_dir):
    df = signals(spark, sf_dir).select("cycle", scalar.stabilise(F.col("fm")).alias("z"))
    return df.select("cycle", rnd("z", 9).alias("z"), rnd(scalar.destabilise(F.col("z")), 7).alias("back"))


# --- cleaning and filters ------------------------------------------------------------------

_LAST = "last_value({0} IGNORE NULLS) OVER (PARTITION BY {1} ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("c01_forward_fill", sql("sig", f"""
SELECT cycle, {_LAST.format('v', 'series')} AS v, {_LAST.format('a', 'series')} AS a, {_LAST.format('tag', 'series')} AS tag
FROM (SELECT series, cycle, v, CASE WHEN cycle % 7 < 3 THEN a END AS a, nullif(tag, 'view') AS tag FROM sig)"""))
def forward_fill(spark, sf_dir):
    gaps = signals(spark, sf_dir).select("series", "cycle", "v", F.when(F.col("cycle") % 7 < 3, F.col("a")).alias("a"),
                                         F.nullif(F.col("tag"), F.lit("view")).alias("tag"))
    return clean.forward_fill(gaps, spec_for(spark, sf_dir, ("series",))).drop("series")


@query("c01b_forward_fill_one", sql("sig", f"SELECT axis, cycle, tag, {_LAST.format('v', 'axis')} AS v FROM sig"))
def forward_fill_one(spark, sf_dir):
    df = signals(spark, sf_dir).select("axis", "cycle", "tag", "v")
    return clean.forward_fill(df, spec_for(spark, sf_dir), ["v"])


@query("c02_null_tokens", sql("sig", f"""
SELECT axis, cycle, {_LAST.format('tag', 'axis')} AS tag, {_LAST.format('v', 'axis')} AS v
FROM (SELECT axis, cycle, nullif(tag, 'error') AS tag, v FROM sig)"""))
def null_tokens(spark, sf_dir):
    dirty = signals(spark, sf_dir).select(
        "axis", "cycle", F.when(F.col("tag") == "error", "nan").otherwise(F.col("tag")).alias("tag"),
        F.coalesce("v", F.lit(float("nan"))).alias("v"))
    return clean.forward_fill(clean.null_out_missing(dirty), spec_for(spark, sf_dir), ["tag", "v"])


@query("c03_null_counts", sql("sig", " UNION ALL ".join(
    f"SELECT '{c}' AS name, count(*) - count({c}) AS n_null FROM sig" for c, _ in _COLUMNS)))
def null_counts(spark, sf_dir):
    nan = F.coalesce("v", F.lit(float("nan"))).alias("v")
    df = signals(spark, sf_dir)
    return clean.null_counts(df.select(*[nan if c == "v" else c for c in df.columns]))


@query("c04_drop_incomplete", sql("sig", "SELECT axis, cycle, v, a FROM sig WHERE v IS NOT NULL AND a IS NOT NULL"))
def drop_incomplete(spark, sf_dir):
    return clean.drop_incomplete(signals(spark, sf_dir).select("axis", "cycle", "v", "a"))


@query("c05_edge_default", sql("sig", """
SELECT axis, cycle, lag(v, 5, CAST(0 AS DOUBLE)) OVER w AS back, lead(v, 5, CAST(0 AS DOUBLE)) OVER w AS ahead
FROM sig WINDOW w AS (PARTITION BY axis ORDER BY cycle)"""))
def edge_default(spark, sf_dir):
    spec = spec_for(spark, sf_dir)
    placed = series.with_position(signals(spark, sf_dir).select("axis", "cycle", "v"), spec)
    pair = [f for f in shift.shift_features(["v"], 5, both=True) if f.name in ("v_-5", "v_+5")]
    return series.add_features(placed, spec, pair).select(
        "axis", "cycle", named("v_-5").alias("back"), named("v_+5").alias("ahead"))


@query("f01_axis_filter", sql("filled", "SELECT cycle, v, a FROM filled WHERE axis = 1"))
def axis_filter(spark, sf_dir):
    df = signals(spark, sf_dir).select("axis", "cycle", "v", "a")
    return clean.forward_fill(df, spec_for(spark, sf_dir)).filter(F.col("axis") == 1).select("cycle", "v", "a")


@query("f02_tag_filter", sql("sig", """
SELECT cycle, tag FROM (SELECT cycle, nullif(tag, 'signup') AS tag FROM sig)
WHERE coalesce(regexp_matches(tag, '^(cl|vi|si)'), false)"""))
def tag_filter(spark, sf_dir):
    df = signals(spark, sf_dir).select("cycle", F.nullif(F.col("tag"), F.lit("signup")).alias("tag"))
    return df.filter(scalar.tag_matches(F.col("tag"), "^(cl|vi|si)"))


@query("f03_tag_filter_strict", sql("filled", f"SELECT cycle, tag FROM filled WHERE regexp_matches(tag, '{RUN}')", "series"))
def tag_filter_strict(spark, sf_dir):
    """A null tag would be an error here, so the gaps are filled first."""
    df = signals(spark, sf_dir).select("series", "cycle", "tag")
    return clean.forward_fill(df, spec_for(spark, sf_dir, ("series",))).filter(
        scalar.tag_matches(F.col("tag"), RUN, strict=True)).select("cycle", "tag")


@query("f04_threshold", sql("pred", f"SELECT axis, pos FROM pred WHERE err > {THRESHOLD}"))
def threshold(spark, sf_dir):
    predicted, _ = predicted_of(spark, sf_dir)
    return predicted.filter(scalar.exceeds(F.col("err"), THRESHOLD)).select("axis", "pos")


# --- joins by position ---------------------------------------------------------------------


@query("j01_align", sql("run", """
SELECT axis, pos, v, a, lag(v, 1, CAST(0 AS DOUBLE)) OVER w AS "v_-1", lead(a, 1, CAST(0 AS DOUBLE)) OVER w AS "a_+1"
FROM run WINDOW w AS (PARTITION BY axis ORDER BY pos)"""))
def align(spark, sf_dir):
    run, spec = run_of(spark, sf_dir)
    back = shift.add_shifts(run.select("axis", "pos", "v"), spec, ["v"], 1)
    ahead = shift.add_shifts(run.select("axis", "pos", "a"), spec, ["a"], 1, both=True).drop("a_-1")
    return back.join(ahead, ["axis", "pos"])


_SPLIT = """split AS (
  SELECT *, row_number() OVER (PARTITION BY axis ORDER BY md5(concat_ws('-', axis, pos, '1')))
            <= ceil(n_rows * CAST(0.4 AS DOUBLE)) AS is_test FROM run)"""


@query("j02_training_companion", sql("run", """
SELECT axis, pos, back, ahead FROM (
  SELECT axis, pos, is_test, lag(v, 3, CAST(0 AS DOUBLE)) OVER w AS back, lead(v, 3, CAST(0 AS DOUBLE)) OVER w AS ahead
  FROM split WINDOW w AS (PARTITION BY axis ORDER BY pos)) WHERE NOT is_test""", more=_SPLIT))
def training_companion(spark, sf_dir):
    run, spec = run_of(spark, sf_dir, columns=("v",))
    marked = split.hold_out(run.select("axis", "pos", "v"), ["axis", "pos"], by=["axis"])
    shifted = shift.add_shifts(marked, spec, ["v"], 3, both=True)
    return shifted.filter(~F.col("is_test")).select("axis", "pos", named("v_-3").alias("back"), named("v_+3").alias("ahead"))


@query("j03_positional_take", sql("pred", "SELECT axis, rank, pos, cycle, v, a FROM outliers", more=OUTLIERS))
def positional_take(spark, sf_dir):
    predicted, spec = predicted_of(spark, sf_dir)
    over = score.outliers(predicted.select("axis", "pos", "err"), threshold=THRESHOLD, by=spec.keys).drop("err")
    return over.join(predicted.select("axis", "pos", "cycle", "v", "a"), ["axis", "pos"])


@query("j04_pair_predictions", sql("pred", f"""
SELECT axis, count(*) AS n_rows, count(*) AS n_loaded, {sql_rnd('max(err)')} AS worst_error FROM pred GROUP BY axis"""))
def pair_predictions(spark, sf_dir):
    """Predictions read back from their files, paired with the rows by position; neither side may have rows of its own."""
    predicted, _ = predicted_of(spark, sf_dir)
    path = scratch_path(spark, "predictions")
    csv.write_predictions(predicted, path)
    loaded = csv.scan_numbers(spark, path, {"pos": "bigint", "y_loaded": "double"}, partitioned_by={"axis": "int"})
    paired = project.paired(predicted.select("axis", "pos", "fr"), loaded, ["axis", "pos"])
    return paired.groupBy("axis").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("y_loaded").alias("n_loaded"),
        rnd(score.worst(scalar.absolute_error(F.col("fr"), F.col("y_loaded")))).alias("worst_error"))


# --- diagnostic tables ---------------------------------------------------------------------

_KINDS = {"velocity": "v", "acceleration": "a", "time": "cycle"}


@query("d01_comparison", sql("pred", " UNION ALL ".join(
    f"SELECT axis, '{k}' AS x_kind, CAST({c} AS DOUBLE) AS x, '{s}' AS series, {sql_rnd(y)} AS y FROM pred{cond}"
    for k, c in _KINDS.items() for s, y, cond in (
        ("measured", "fr", ""), ("predicted", "y_pred", ""), ("most difference", "fr", f" WHERE err > {THRESHOLD}")))))
def comparison(spark, sf_dir):
    predicted, _ = predicted_of(spark, sf_dir)
    return diag.comparison(predicted, "fr", "y_pred", _KINDS, THRESHOLD, ["axis"]).withColumn("y", rnd("y"))


_BASE, _FAN = 16, 4
_CELL_ENDS = "count(*) AS n_rows, " + ", ".join(f"{sql_rnd(f'{f}({c})')} AS {c}_{f}" for c in ("fr", "y_pred") for f in ("min", "max"))


def _pyramid(spark, sf_dir):
    predicted, _ = predicted_of(spark, sf_dir)
    return diag.pyramid(predicted, ["fr", "y_pred"], ["axis"], "pos", _BASE, _FAN)


def _rounded_ends(cells):
    return cells.withColumns({f"{c}_{f}": rnd(f"{c}_{f}") for c in ("fr", "y_pred") for f in ("min", "max")})


@query("d01b_pyramid", sql("pred", f"""
SELECT axis, level, pos // width AS cell, {_CELL_ENDS} FROM pred, levels GROUP BY axis, level, pos // width""", more=f"""levels AS (
  SELECT CAST(l AS INTEGER) AS level, CAST({_BASE} * pow({_FAN}, l) AS BIGINT) AS width FROM range(0, 20) t(l)
  WHERE l = 0 OR (SELECT max(pos) FROM pred) // {_BASE} // CAST(pow({_FAN}, l - 1) AS BIGINT) > 0)"""))
def pyramid(spark, sf_dir):
    """Extremes of measured and predicted values in all levels of a zoomable figure."""
    return _rounded_ends(_pyramid(spark, sf_dir))


@query("d01c_zoom", sql("pred", f"""
SELECT axis, CAST(1 AS INTEGER) AS level, pos // 64 AS cell, pos // 64 * 64 AS start, pos // 64 * 64 + 64 AS stop, {_CELL_ENDS}
FROM pred WHERE pos // 64 BETWEEN 50 // 64 AND 349 // 64 GROUP BY axis, pos // 64"""))
def zoom(spark, sf_dir):
    """The figure of positions 50 to 349 in ten cells at most, read from a written pyramid."""
    path = scratch_path(spark, "pyramid")
    diag.write_pyramid(_pyramid(spark, sf_dir), path, ["axis"])
    return _rounded_ends(diag.zoomed(spark.read.parquet(path), 50, 350, 10, _BASE, _FAN))


@query("d03_scatter", sql("pred", """
SELECT axis, CAST(floor(fr / 10) AS BIGINT) AS x_cell, CAST(floor(y_pred / 10) AS BIGINT) AS y_cell, count(*) AS n_rows
FROM pred GROUP BY ALL"""))
def scatter(spark, sf_dir):
    predicted, _ = predicted_of(spark, sf_dir)
    return diag.scatter_counts(predicted, "fr", "y_pred", 10.0, ["axis"])
