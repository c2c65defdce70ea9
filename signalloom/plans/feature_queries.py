"""Windows, positions, rankings, splits, scalers and aggregates."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.operators import lowpass, quantile, rolling, runs, scale, score, sequence, series, shift, split
from signalloom.plans.registry import (RUN, THRESHOLD, predicted_of, query, rnd, run_of, signals, spec_for, sql, sql_rnd,
                                       table)
from signalloom.functions import scalar
from signalloom.functions.scalar import named
from signalloom.plans import prepare
from signalloom.session import scratch_path
from signalloom.sources import csv
from signalloom.plans.clean_queries import OUTLIERS, _SPLIT

# --- aggregates ----------------------------------------------------------------------------


@query("a01_worst_error", sql("pred", f"SELECT axis, {sql_rnd('max(err)')} AS worst_error FROM pred GROUP BY axis"))
def worst_error(spark, sf_dir):
    predicted, _ = predicted_of(spark, sf_dir)
    return predicted.groupBy("axis").agg(rnd(score.worst(F.col("err"))).alias("worst_error"))


@query("a02_max_error", sql("pred", f"SELECT {sql_rnd('max(abs(fr - y_pred))')} AS max_error FROM pred"))
def max_error(spark, sf_dir):
    predicted, _ = predicted_of(spark, sf_dir)
    return score.metrics(predicted, "fr", "y_pred").select(rnd("worst_error").alias("max_error"))


@query("a03_exceedances", sql("pred", f"""
SELECT axis, count(*) FILTER (WHERE err > {THRESHOLD}) AS n_over FROM pred GROUP BY axis"""))
def exceedances(spark, sf_dir):
    predicted, _ = predicted_of(spark, sf_dir)
    return score.metrics(predicted, "fr", "y_pred", THRESHOLD, ["axis"]).select("axis", "n_over")


@query("a04_mean_squared_error", sql("pred", f"SELECT axis, {sql_rnd('avg(err * err)')} AS mse FROM pred GROUP BY axis"))
def mean_squared_error(spark, sf_dir):
    predicted, _ = predicted_of(spark, sf_dir)
    return score.metrics(predicted, "fr", "y_pred", by=["axis"]).select("axis", rnd("mse").alias("mse"))


@query("a05_mean_absolute_error", sql("pred", f"SELECT axis, {sql_rnd('avg(err)')} AS mae FROM pred GROUP BY axis"))
def mean_absolute_error(spark, sf_dir):
    predicted, _ = predicted_of(spark, sf_dir)
    return score.metrics(predicted, "fr", "y_pred", by=["axis"]).select("axis", rnd("mae").alias("mae"))


_TAIL = "pos >= n_rows - CAST(round_even(n_rows * CAST(0.4 AS DOUBLE), 0) AS BIGINT)"


@query("a06_metrics_by_subset", sql("pred", f"""
SELECT axis, {_TAIL} AS is_test, count(*) AS n_rows, {sql_rnd('max(err)')} AS worst_error,
       count(*) FILTER (WHERE err > {THRESHOLD}) AS n_over, {sql_rnd('avg(err * err)')} AS mse, {sql_rnd('avg(err)')} AS mae
FROM pred GROUP BY 1, 2"""))
def metrics_by_subset(spark, sf_dir):
    predicted, _ = predicted_of(spark, sf_dir)
    marked = predicted.withColumn("is_test", split.tail_test(F.col("pos"), F.col("n_rows")))
    table = score.metrics(marked, "fr", "y_pred", THRESHOLD, ["axis", "is_test"])
    return table.select("axis", "is_test", "n_rows", "n_over", *[rnd(c).alias(c) for c in ("worst_error", "mse", "mae")])


_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("a07_correlation", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {sql_rnd(f'corr({a}, {b})', 9)} AS r FROM x"
    for a in _NUMBERS for b in _NUMBERS).replace(
    "FROM x", "FROM (SELECT * REPLACE (CASE WHEN l_returnflag <> 'R' THEN l_discount END AS l_discount) FROM lineitem)"))
def correlation(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn(
        "l_discount", F.when(F.col("l_returnflag") != "R", F.col("l_discount")))
    return score.correlations(df, _NUMBERS).withColumn("r", rnd("r", 9))


@query("a08_value_counts", sql("sig", f"SELECT coalesce(regexp_matches(tag, '{RUN}'), false) AS hit, count(*) AS n_rows FROM sig GROUP BY 1"))
def value_counts(spark, sf_dir):
    return score.value_counts(signals(spark, sf_dir), scalar.tag_matches(F.col("tag"), RUN))


def _stats_sql(column: str, source: str) -> str:
    parts = {"min": f"min({column})", "max": f"max({column})", "mean": f"avg({column})", "std": f"stddev_pop({column})",
             "q25": f"quantile_cont({column}, 0.25)", "median": f"quantile_cont({column}, 0.5)",
             "q75": f"quantile_cont({column}, 0.75)"}
    return f"SELECT '{column}' AS name, " + ", ".join(f"{sql_rnd(v)} AS {k}" for k, v in parts.items()) + f" FROM {source}"


@query("a09_scaler_statistics", " UNION ALL ".join(_stats_sql(c, "lineitem") for c in _NUMBERS[:3]))
def scaler_statistics(spark, sf_dir):
    stats = scale.column_statistics(table(spark, sf_dir, "lineitem"), _NUMBERS[:3])
    return stats.select("name", *[rnd(c).alias(c) for c in stats.columns if c != "name"])


# --- windows -------------------------------------------------------------------------------


def _lag_sql(columns, steps, both):
    kinds = [("lag", "-")] + ([("lead", "+")] if both else [])
    return ", ".join(f"{f}({c}, {k}, CAST(0 AS DOUBLE)) OVER w AS \"{c}_{s}{k}\""
                     for k in range(1, steps + 1) for c in columns for f, s in kinds)


@query("w01_lags", sql("run", f"""
SELECT axis, pos, v, a, {_lag_sql(('v', 'a'), 75, False)} FROM run WINDOW w AS (PARTITION BY axis ORDER BY pos)"""))
def lags(spark, sf_dir):
    run, spec = run_of(spark, sf_dir)
    return shift.add_shifts(run.select("axis", "pos", "v", "a"), spec, ["v", "a"], 75)


@query("w01b_lag_arrays", sql("run", """
SELECT axis, pos, size, total, nearest, farthest FROM (
  SELECT axis, pos, CAST(75 AS INTEGER) AS size,
         round(coalesce(sum(v) OVER (PARTITION BY axis ORDER BY pos ROWS BETWEEN 75 PRECEDING AND 1 PRECEDING), 0), 4) AS total,
         lag(v, 1, CAST(0 AS DOUBLE)) OVER w AS nearest, lag(v, 75, CAST(0 AS DOUBLE)) OVER w AS farthest
  FROM run WINDOW w AS (PARTITION BY axis ORDER BY pos))"""))
def lag_arrays(spark, sf_dir):
    run, spec = run_of(spark, sf_dir)
    wide = series.add_features(run.select("axis", "pos", "v"), spec, shift.lag_array_features(["v"], 75))
    total = F.aggregate("v_lags", F.lit(0.0), lambda s, x: s + F.nanvl(x, F.lit(0.0)))
    return wide.select("axis", "pos", F.size("v_lags").alias("size"), F.round(total, 4).alias("total"),
                       F.element_at("v_lags", 1).alias("nearest"), F.element_at("v_lags", 75).alias("farthest"))


_PROGRAM = "'N' || CAST((cycle // 50) * (cycle // 50) % 3 AS VARCHAR)"
_RUNS = f"""turned AS (
  SELECT axis, cycle, v, a, fm - fb AS fr, {_PROGRAM} AS program, row_number() OVER s AS place,
         coalesce({_PROGRAM} IS DISTINCT FROM lag({_PROGRAM}) OVER s AND row_number() OVER s > 1, false) AS turn
  FROM filled WINDOW s AS (PARTITION BY axis ORDER BY cycle)),
numbered AS (SELECT *, CAST(count(*) FILTER (WHERE turn) OVER (PARTITION BY axis ORDER BY place) AS BIGINT) AS run FROM turned),
runs AS (SELECT *, row_number() OVER (PARTITION BY axis, run ORDER BY place) - 1 AS run_pos FROM numbered)"""


def _runs_of(spark, sf_dir):
    """All filled rows by runs of one program number, some longer than others."""
    spec = spec_for(spark, sf_dir, ("axis",))
    step = F.expr("cycle div 50")
    rows = prepare.filled(signals(spark, sf_dir).select("axis", "cycle", "v", "a", "fm", "fb"), spec)
    rows = rows.withColumns({"program": F.concat(F.lit("N"), (step * step % 3).cast("string")), "fr": F.col("fm") - F.col("fb")})
    return runs.with_run(rows, spec, ["program"]).drop("__bucket"), runs.run_spec(spec)


@query("w01c_lags_by_run", sql("filled", """
SELECT axis, run, run_pos, program, v, lag(v, 1, CAST(0 AS DOUBLE)) OVER w AS "v_-1", lag(v, 5, CAST(0 AS DOUBLE)) OVER w AS "v_-5",
       lag(a, 1, CAST(0 AS DOUBLE)) OVER w AS "a_-1", lag(a, 5, CAST(0 AS DOUBLE)) OVER w AS "a_-5"
FROM runs WINDOW w AS (PARTITION BY axis, run ORDER BY run_pos)""", more=_RUNS))
def lags_by_run(spark, sf_dir):
    """Lags that never reach into another measurement run."""
    numbered, spec = _runs_of(spark, sf_dir)
    wide = shift.add_shifts(numbered.select("axis", "run", "run_pos", "program", "v", "a"), spec, ["v", "a"], 5, pos="run_pos")
    return wide.select("axis", "run", "run_pos", "program", "v", *[named(f"{c}_-{k}") for c in "va" for k in (1, 5)])


@query("w02_lags_and_leads", sql("run", f"""
SELECT axis, pos, v, a, {_lag_sql(('v', 'a'), 8, True)} FROM run WINDOW w AS (PARTITION BY axis ORDER BY pos)"""))
def lags_and_leads(spark, sf_dir):
    run, spec = run_of(spark, sf_dir)
    return shift.add_shifts(run.select("axis", "pos", "v", "a"), spec, ["v", "a"], 8, both=True)


@query("w03_lags_with_training_rows", sql("run", f"""
SELECT axis, pos, is_test, v, {_lag_sql(('v',), 3, True)} FROM split
WINDOW w AS (PARTITION BY axis ORDER BY pos)""", more=_SPLIT))
def lags_with_training_rows(spark, sf_dir):
    run, spec = run_of(spark, sf_dir)
    marked = split.hold_out(run.select("axis", "pos", "v"), ["axis", "pos"], by=["axis"])
    return shift.add_shifts(marked, spec, ["v"], 3, both=True)


def _roll_sql(column: str, n: int, stat: str, digits: int, by: str = "PARTITION BY axis") -> str:
    frame = f"OVER ({by} ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    value = f"{'avg' if stat == 'mean' else 'stddev_samp'}({column}) {frame}"
    return f"CASE WHEN count({column}) {frame} = {n} THEN {sql_rnd(value, digits)} END"


@query("w04_rolling_mean", sql("run", f"SELECT axis, pos, {_roll_sql('v', 64, 'mean', 10)} AS mean64 FROM run"))
def rolling_mean(spark, sf_dir):
    run, spec = run_of(spark, sf_dir)
    out = series.add_features(run.select("axis", "pos", "v"), spec, [rolling.rolling("v", 64, "mean", "mean64")])
    return out.select("axis", "pos", rnd("mean64", 10).alias("mean64"))


@query("w05_rolling_std", sql("run", f"SELECT axis, pos, {_roll_sql('v', 64, 'std', 6)} AS std64 FROM run"))
def rolling_std(spark, sf_dir):
    run, spec = run_of(spark, sf_dir)
    out = series.add_features(run.select("axis", "pos", "v"), spec, [rolling.rolling("v", 64, "std", "std64")])
    return out.select("axis", "pos", rnd("std64").alias("std64"))


_SIZES = (64, 128, 256)
_BUNDLE = [(f"{k}{n}", c, n, s) for n in _SIZES for k, c, s in (
    ("MeanV", "v", "mean"), ("MeanA", "a", "mean"), ("StdV", "v", "std"), ("StdA1", "a", "std"))]


@query("w06_rolling_bundle", sql("run", "SELECT axis, pos, " + ", ".join(
    f"{_roll_sql(c, n, s, 10 if s == 'mean' else 6)} AS {name}" for name, c, n, s in _BUNDLE) + " FROM run"))
def rolling_bundle(spark, sf_dir):
    run, spec = run_of(spark, sf_dir)
    out = rolling.add_rolling(run.select("axis", "pos", "v", "a"), spec, "v", "a", _SIZES)
    return out.select("axis", "pos", *[rnd(name, 10 if s == "mean" else 6).alias(name) for name, _, _, s in _BUNDLE])


_LONG = (512, 2000, 5000)


@query("w06b_rolling_long", f"""
WITH placed AS (SELECT o_orderkey, o_totalprice AS x, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)
SELECT pos, """ + ", ".join(
    f"{_roll_sql('x', n, s, d, '')} AS {s}{n}" for n in _LONG for s, d in (("mean", 4 if n == 512 else 6), ("std", 5))
    if not (n == 512 and s == "mean")) + " FROM placed")
def rolling_long(spark, sf_dir):
    """Frames of thousands of rows over one long series."""
    orders = table(spark, sf_dir, "orders").select(F.lit("all").alias("series"), "o_orderkey", F.col("o_totalprice").alias("x"))
    spec = series.fit_spec(orders, ["series"], "o_orderkey")
    wanted = [(n, s) for n in _LONG for s in ("mean", "std") if (n, s) != (512, "mean")]
    out = series.add_features(series.with_position(orders, spec), spec,
                              [rolling.rolling("x", n, s, f"{s}{n}") for n, s in wanted])
    return out.select("pos", *[rnd(f"{s}{n}", 6 if s == "mean" else 5).alias(f"{s}{n}") for n, s in wanted])


def _bin_sql(column: str, source: str, out: str) -> str:
    edges = [f"(SELECT quantile_cont({column}, {q}) FROM {source})" for q in (0.25, 0.5, 0.75)]
    return (f"CAST(CASE WHEN {column} IS NULL THEN NULL WHEN {column} <= {edges[0]} THEN 0 WHEN {column} <= {edges[1]} THEN 1 "
            f"WHEN {column} <= {edges[2]} THEN 2 ELSE 3 END AS INTEGER) AS {out}")


@query("w07_quantile_bins", sql("sig", f"""
SELECT cycle, {_bin_sql('v', 'sig', 'bin_v')}, {_bin_sql('a', 'sig', 'bin_a')} FROM sig"""))
def quantile_bins(spark, sf_dir):
    df = signals(spark, sf_dir).select("cycle", "v", "a")
    return quantile.quantile_bins(df, {"v": "bin_v", "a": "bin_a"}).select("cycle", "bin_v", "bin_a")


@query("w07b_quantiles_selected", " UNION ALL ".join(
    f"SELECT l_returnflag, '{c}' AS name, CAST({q} AS DOUBLE) AS prob, {sql_rnd(f'quantile_cont({c}, {q})')} AS value "
    f"FROM lineitem GROUP BY l_returnflag" for c in _NUMBERS[:2] for q in (0.0, 0.25, 0.5, 0.75, 1.0)))
def quantiles_selected(spark, sf_dir):
    table_ = quantile.exact_quantiles(table(spark, sf_dir, "lineitem"), _NUMBERS[:2], [0, .25, .5, .75, 1], ["l_returnflag"])
    return table_.select("l_returnflag", "name", "prob", rnd("value").alias("value"))


@query("w08_supervised_windows", sql("run", """
SELECT axis, pos, CAST(60 AS INTEGER) AS size, round(weighted, 4) AS weighted, round(sum_a, 4) AS sum_a, round(fr, 6) AS fr FROM (
  SELECT axis, pos, fr,
         list_sum(list_transform(list(coalesce(v, 0)) OVER w, lambda x, i: x * i)) AS weighted, sum(a) OVER w AS sum_a
  FROM run WINDOW w AS (PARTITION BY axis ORDER BY pos ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
WHERE pos >= 60"""))
def supervised_windows(spark, sf_dir):
    run, spec = run_of(spark, sf_dir)
    out = sequence.supervised_windows(run, spec, ["v", "a"], "fr", 60)
    weighted = F.aggregate(F.transform("window", lambda r, i: F.coalesce(r["v"], F.lit(0.0)) * (i + 1)),
                           F.lit(0.0), lambda s, x: s + x)
    sum_a = F.aggregate("window", F.lit(0.0), lambda s, r: s + r["a"])
    return out.select("axis", "pos", F.size("window").alias("size"), F.round(weighted, 4).alias("weighted"),
                      F.round(sum_a, 4).alias("sum_a"), F.round("fr", 6).alias("fr"))


@query("w08b_windows_by_run", sql("filled", """
SELECT axis, run, run_pos, CAST(8 AS INTEGER) AS size, round(weighted, 4) AS weighted, round(sum_a, 4) AS sum_a, round(fr, 6) AS fr FROM (
  SELECT axis, run, run_pos, fr,
         list_sum(list_transform(list(coalesce(v, 0)) OVER w, lambda x, i: x * i)) AS weighted, sum(a) OVER w AS sum_a
  FROM runs WINDOW w AS (PARTITION BY axis, run ORDER BY run_pos ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
WHERE run_pos >= 8""", more=_RUNS))
def windows_by_run(spark, sf_dir):
    """Windows of eight rows of one measurement run."""
    numbered, spec = _runs_of(spark, sf_dir)
    out = sequence.supervised_windows(numbered, spec, ["v", "a"], "fr", 8, "run_pos")
    weighted = F.aggregate(F.transform("window", lambda r, i: F.coalesce(r["v"], F.lit(0.0)) * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    sum_a = F.when(F.exists("window", lambda r: r["a"].isNotNull()),
                   F.aggregate("window", F.lit(0.0), lambda s, r: s + F.coalesce(r["a"], F.lit(0.0))))
    return out.select("axis", "run", "run_pos", F.size("window").alias("size"), F.round(weighted, 4).alias("weighted"),
                      F.round(sum_a, 4).alias("sum_a"), F.round("fr", 6).alias("fr"))


@query("w09_multistep_windows", sql("run", """
SELECT axis, pos, round(in_sum, 4) AS in_sum, round(out_sum, 4) AS out_sum, first_in, last_out FROM (
  SELECT axis, pos, n_rows,
         sum(fm) OVER (PARTITION BY axis ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS in_sum,
         sum(fm) OVER (PARTITION BY axis ORDER BY pos ROWS BETWEEN 10 FOLLOWING AND 12 FOLLOWING) AS out_sum,
         fm AS first_in, lead(fm, 12) OVER (PARTITION BY axis ORDER BY pos) AS last_out
  FROM run) WHERE pos < n_rows - 12"""))
def multistep_windows(spark, sf_dir):
    run, spec = run_of(spark, sf_dir)
    out = sequence.multistep_windows(run, spec, "fm", 10, 3)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 4)
    return out.select("axis", "pos", total("inputs").alias("in_sum"), total("targets").alias("out_sum"),
                      F.element_at("inputs", 1).alias("first_in"), F.element_at("targets", -1).alias("last_out"))


@query("w10_difference", sql("run", f"""
SELECT axis, pos, {sql_rnd('fm - lag(fm) OVER w')} AS diff, CASE WHEN pos > 0 THEN {sql_rnd('fm')} END AS undone
FROM run WINDOW w AS (PARTITION BY axis ORDER BY pos)"""))
def difference(spark, sf_dir):
    run, spec = run_of(spark, sf_dir)
    out = series.add_features(run.select("axis", "pos", "fm"), spec, shift.difference_features(["fm"]))
    back = series.add_features(out, spec, shift.undo_difference_features({"fm_diff": "fm"}))
    return back.select("axis", "pos", rnd("fm_diff").alias("diff"), rnd("fm_diff_undone").alias("undone"))


def _low_pass_sql(gain: float, decay: float, taps: int = 110) -> str:
    """Both passes as weighted sums over the extended series, with edge values repeated outwards."""
    return f"""
ends AS MATERIALIZED (SELECT axis, count(*) AS n, max(fm) FILTER (WHERE pos = 0) AS x0, max(fm) FILTER (WHERE pos = n_rows - 1) AS xn
         FROM run GROUP BY axis),
ext AS MATERIALIZED (
  SELECT axis, pos + 6 AS p, fm AS x FROM run
  UNION ALL SELECT axis, 6 - pos, 2 * x0 - fm FROM run JOIN ends USING (axis) WHERE pos BETWEEN 1 AND 6
  UNION ALL SELECT axis, 2 * (n - 1) - pos + 6, 2 * xn - fm FROM run JOIN ends USING (axis) WHERE pos BETWEEN n - 7 AND n - 2),
size AS MATERIALIZED (SELECT axis, max(p) AS top FROM ext GROUP BY axis),
taps AS MATERIALIZED (SELECT k, CAST(CASE WHEN k = 0 THEN '{gain!r}'::DOUBLE
                        ELSE '{gain!r}'::DOUBLE * (1 + '{decay!r}'::DOUBLE) * pow('{decay!r}'::DOUBLE, k - 1) END AS DOUBLE) AS h
         FROM range(0, {taps}) t(k)),
pass1 AS MATERIALIZED (
  SELECT o.axis, o.p, sum(h * i.x) AS x FROM (SELECT axis, p, greatest(p - k, 0) AS q, h FROM ext CROSS JOIN taps) o
  JOIN ext i ON i.axis = o.axis AND i.p = o.q GROUP BY o.axis, o.p),
pass2 AS MATERIALIZED (
  SELECT o.axis, o.p, sum(h * i.x) AS x
  FROM (SELECT axis, p, least(p + k, top) AS q, h FROM pass1 JOIN size USING (axis) CROSS JOIN taps) o
  JOIN pass1 i ON i.axis = o.axis AND i.p = o.q GROUP BY o.axis, o.p)"""


@query("w11_low_pass", sql("run", f"""
SELECT run.axis, pos, {sql_rnd('pass2.x')} AS filtered FROM run JOIN pass2 ON pass2.axis = run.axis AND pass2.p = run.pos + 6""",
    more=_low_pass_sql(*lowpass.coefficients(0.1))))
def low_pass(spark, sf_dir):
    run, spec = run_of(spark, sf_dir)
    out = lowpass.low_pass(run.select("axis", "pos", "fm"), spec, "fm", 0.1, "filtered")
    return out.select("axis", "pos", rnd("filtered").alias("filtered"))


_ORDERS = {"o1_low": (1, 1e-4), "o2": (2, 0.1), "o3": (3, 0.1), "o4": (4, 0.1), "o4_low": (4, 1e-4)}


def _section(order: int, cutoff: float) -> list[float | None]:
    """Constants of a chain of integrators: one of first order for odd orders, then up to two of second order."""
    g = math.tan(math.pi * cutoff / 2)
    out = [g / (1 + g) if order % 2 else None]
    for j in range(2):
        angle = math.pi * (2 * j + 1) / (2 * order) if order % 2 == 0 else math.pi * (j + 1) / order
        a = 1 / (1 + g * (g + 2 * math.cos(angle)))
        out += [a, g * a, g * g * a] if j < order // 2 else [None] * 3
    return out


def _chain_sql(name: str, rows: str, start: str, step: int) -> str:
    """One pass, row by row, over `rows` (f, axis, p, x) from each series' row `start`, in the steady state of its value."""
    def second(i: str, x: str) -> str:
        return f"""{x} - r.z{i} AS rest{i}, c.a{i} * r.w{i} + c.b{i} * rest{i} AS u{i}, r.z{i} + c.b{i} * r.w{i} + c.c{i} * rest{i} AS o{i},
               2 * u{i} - r.w{i} AS nw{i}, 2 * o{i} - r.z{i} AS nz{i}, coalesce(o{i}, {x}) AS y{i}"""

    return f"""
{name}_start AS MATERIALIZED (SELECT f, axis, p, x FROM {rows} JOIN (SELECT f, axis, {start}(p) AS p FROM {rows} GROUP BY f, axis) USING (f, axis, p)),
{name} AS (
  SELECT f, axis, p - {step} AS p, x AS s, CAST(0 AS DOUBLE) AS w1, x AS z1, CAST(0 AS DOUBLE) AS w2, x AS z2, x AS y FROM {name}_start
  UNION ALL
  SELECT f, axis, p, ns, nw1, nz1, nw2, nz2, y2 FROM (
    SELECT e.f, e.axis, e.p, (e.x - r.s) * c.h AS v0, coalesce(v0 + r.s, e.x) AS y0, y0 + v0 AS ns,
           {second('1', 'y0')}, {second('2', 'y1')}
    FROM {name} r JOIN {rows} e ON e.f = r.f AND e.axis = r.axis AND e.p = r.p + {step} JOIN constants c ON c.f = e.f))"""


def _orders_sql() -> str:
    number = lambda v: "CAST(NULL AS DOUBLE)" if v is None else f"'{v!r}'::DOUBLE"
    rows = ", ".join(f"('{n}', CAST({3 * (o + 1)} AS BIGINT), {', '.join(map(number, _section(o, c)))})" for n, (o, c) in _ORDERS.items())
    return f"""
constants AS MATERIALIZED (SELECT * FROM (VALUES {rows}) AS t(f, edge, h, a1, b1, c1, a2, b2, c2)),
given AS MATERIALIZED (SELECT axis, pos, n_rows AS n, fm, first_value(fm) OVER w AS x0, last_value(fm) OVER w AS xn FROM run
          WINDOW w AS (PARTITION BY axis ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
ext AS MATERIALIZED (
  SELECT f, axis, pos + edge AS p, fm AS x FROM given, constants
  UNION ALL SELECT f, axis, edge - pos, 2 * x0 - fm FROM given, constants WHERE pos BETWEEN 1 AND edge
  UNION ALL SELECT f, axis, 2 * (n - 1) - pos + edge, 2 * xn - fm FROM given, constants WHERE pos BETWEEN n - 1 - edge AND n - 2),
{_chain_sql('there', 'ext', 'min', 1)},
passed AS MATERIALIZED (SELECT f, axis, p, y AS x FROM there WHERE p >= 0),
{_chain_sql('back', 'passed', 'max', -1)}"""


@query("w11b_low_pass_orders", sql("run", f"""
SELECT back.f AS filter, back.axis, run.pos, {sql_rnd('back.y')} AS filtered
FROM back JOIN constants USING (f) JOIN run ON run.axis = back.axis AND run.pos = back.p - edge""",
    more=_orders_sql()).replace("WITH ", "WITH RECURSIVE ", 1))
def low_pass_orders(spark, sf_dir):
    """Orders one to four, at a tenth and a ten-thousandth of the Nyquist frequency."""
    run, spec = run_of(spark, sf_dir, columns=("fm", "fr"))
    out = [lowpass.low_pass(run.select("axis", "pos", "fm"), spec, "fm", cutoff, "filtered", order=order)
           .select(F.lit(name).alias("filter"), "axis", "pos", rnd("filtered").alias("filtered"))
           for name, (order, cutoff) in _ORDERS.items()]
    return reduce(DataFrame.unionByName, out)


@query("d02_raw_and_filtered", sql("run", f"""
SELECT run.axis, cycle, round(fm, 6) AS raw, {sql_rnd('pass2.x')} AS filtered
FROM run JOIN pass2 ON pass2.axis = run.axis AND pass2.p = run.pos + 6""",
    more=_low_pass_sql(*lowpass.coefficients(0.1))))
def raw_and_filtered(spark, sf_dir):
    run, spec = run_of(spark, sf_dir)
    out = lowpass.low_pass(run.select("axis", "pos", "cycle", "fm"), spec, "fm", 0.1, "filtered")
    return out.select("axis", "cycle", F.round("fm", 6).alias("raw"), rnd("filtered").alias("filtered"))


@query("w12_fold_number", sql("run", """
SELECT axis, pos, CAST(ntile(5) OVER (PARTITION BY axis ORDER BY pos) - 1 AS INTEGER) AS fold FROM run"""))
def fold_number(spark, sf_dir):
    run, _ = run_of(spark, sf_dir)
    return run.select("axis", "pos", split.fold_number(F.col("pos"), F.col("n_rows"), 5).alias("fold"))


# --- positions and rankings ----------------------------------------------------------------


@query("o01_position", sql("sig", "SELECT 3 * cycle + cycle % 2 AS cycle, row_number() OVER (ORDER BY cycle) - 1 AS pos, count(*) OVER () AS n_rows FROM sig"))
def position(spark, sf_dir):
    """Dense positions of all rows, by an order key with gaps."""
    spec = spec_for(spark, sf_dir, ("series",))
    df = signals(spark, sf_dir).select("series", (3 * F.col("cycle") + F.col("cycle") % 2).alias("cycle"))
    return series.with_position(df, spec, length="n_rows").drop("series")


@query("o01b_position_by_sort", sql("sig", "SELECT axis, cycle, row_number() OVER (PARTITION BY axis ORDER BY tag, fm, cycle) - 1 AS pos FROM sig"))
def position_by_sort(spark, sf_dir):
    spec = series.SeriesSpec(("axis",), "tag", ("fm", "cycle"))
    return series.position_by_sort(signals(spark, sf_dir).select("axis", "cycle", "tag", "fm"), spec).select("axis", "cycle", "pos")


@query("o01c_file_order", sql("sig", """
SELECT row_number() OVER (ORDER BY cycle) - 1 AS pos, cycle // 10 AS idx, cycle, tag, v FROM sig"""))
def file_order(spark, sf_dir):
    """Positions by the order of lines in the files, where the index repeats and tells no order."""
    path = scratch_path(spark, "signals")
    rows = signals(spark, sf_dir).select("cycle", F.expr("cycle div 10").alias("idx"), "tag", "v")
    csv.write_signals(rows.select("idx", F.col("cycle").alias("CYCLE"), "tag", "v"), path, ["CYCLE"])
    read = csv.scan_signals(spark, path, {"CYCLE": "bigint", "tag": "string", "v": "double"}, rename={"CYCLE": "cycle"}, line="pos")
    return read.select("pos", "idx", "cycle", "tag", "v")


@query("o02_sort_by_cycle", sql("sig", """
SELECT cycle, counter, row_number() OVER (ORDER BY counter NULLS LAST, cycle) AS place
FROM (SELECT cycle, CASE WHEN tag <> 'view' THEN cycle // 4 END AS counter FROM sig)"""))
def sort_by_cycle(spark, sf_dir):
    counter = F.when(F.col("tag") != "view", F.expr("cycle div 4"))
    df = signals(spark, sf_dir).select("cycle", counter.alias("counter"))
    return series.ranked(df, [F.col("counter").asc_nulls_last(), F.col("cycle").asc()], "place")


@query("o03_error_ranking", sql("pred", "SELECT axis, pos, row_number() OVER (PARTITION BY axis ORDER BY err DESC, pos) AS rank FROM pred"))
def error_ranking(spark, sf_dir):
    predicted, spec = predicted_of(spark, sf_dir)
    return series.ranked(predicted.select("axis", "pos", "err"), [F.col("err").desc(), F.col("pos").asc()], "rank",
                         spec.keys).drop("err")


@query("o04_outliers", sql("pred", f"SELECT axis, rank, pos, {sql_rnd('err')} AS err FROM outliers", more=OUTLIERS))
def outliers(spark, sf_dir):
    predicted, spec = predicted_of(spark, sf_dir)
    over = score.outliers(predicted.select("axis", "pos", "err"), threshold=THRESHOLD, by=spec.keys)
    return over.select("axis", "rank", "pos", rnd("err").alias("err"))


@query("o05_worst_rows", sql("pred", f"""
SELECT row_number() OVER (ORDER BY pred.err DESC, pos) AS rank, axis, pos, cycle, {sql_rnd('err')} AS err
FROM pred ORDER BY pred.err DESC, pos LIMIT 4"""))
def worst_rows(spark, sf_dir):
    predicted, _ = predicted_of(spark, sf_dir)
    return score.worst_rows(predicted.select("axis", "pos", "cycle", "err"), 4).withColumn("err", rnd("err"))


@query("o05b_worst_rows_per_axis", sql("pred", f"""
SELECT axis, pos, rank, {sql_rnd('err')} AS err FROM outliers WHERE rank <= 4""",
    more=OUTLIERS.replace(f"WHERE err > {THRESHOLD}", "")))
def worst_rows_per_axis(spark, sf_dir):
    predicted, spec = predicted_of(spark, sf_dir)
    top = score.worst_rows(predicted.select("axis", "pos", "err"), 4, by=spec.keys)
    return top.select("axis", "pos", "rank", rnd("err").alias("err"))


# --- splits --------------------------------------------------------------------------------


@query("t01_hold_out", """
SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat_ws('-', o_orderkey, '1')))
       <= ceil(count(*) OVER () * CAST(0.4 AS DOUBLE)) AS is_test FROM orders""")
def hold_out(spark, sf_dir):
    return split.hold_out(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])


@query("t01b_hold_out_per_axis", sql("run", "SELECT axis, pos, is_test FROM split", more=_SPLIT))
def hold_out_per_axis(spark, sf_dir):
    run, _ = run_of(spark, sf_dir)
    return split.hold_out(run.select("axis", "pos"), ["axis", "pos"], by=["axis"])


@query("t02_tail_split", sql("run", """
SELECT axis, pos, pos - 60 >= n_rows - 60 - CAST(round_even(n_rows * CAST(0.4 AS DOUBLE), 0) AS BIGINT) AS is_test
FROM run WHERE pos >= 60"""))
def tail_split(spark, sf_dir):
    """The share is taken of the rows before windowing, the cut is made after it."""
    run, spec = run_of(spark, sf_dir)
    windows = sequence.supervised_windows(run, spec, ["v"], "n_rows", 60)
    place, left = F.col("pos") - 60, F.col("n_rows") - 60
    return windows.select("axis", "pos", split.tail_test(place, left, 0.4, F.col("n_rows")).alias("is_test"))


@query("t03_validation_tail", sql("run", """
SELECT axis, pos, pos >= floor(n_rows * (CAST(1 AS DOUBLE) - CAST(0.15 AS DOUBLE))) AS is_validation FROM run"""))
def validation_tail(spark, sf_dir):
    run, _ = run_of(spark, sf_dir)
    return run.select("axis", "pos", split.tail_validation(F.col("pos"), F.col("n_rows"), 0.15).alias("is_validation"))


@query("t04_fold_sets", sql("run", """
SELECT axis, CAST(r.run AS INTEGER) AS run, CASE WHEN r.run = fold THEN 'validate' ELSE 'train' END AS part,
       count(*) AS n_rows, round(sum(fm), 4) AS total
FROM (SELECT axis, fm, ntile(5) OVER (PARTITION BY axis ORDER BY pos) - 1 AS fold FROM run) CROSS JOIN range(0, 5) r(run)
GROUP BY 1, 2, 3"""))
def fold_sets(spark, sf_dir):
    run, _ = run_of(spark, sf_dir)
    folds = run.withColumn("fold", split.fold_number(F.col("pos"), F.col("n_rows"), 5))
    return split.fold_sets(folds, "fold", 5).groupBy("axis", "run", "part").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("fm"), 4).alias("total"))


# --- scalers -------------------------------------------------------------------------------

_SCALED = {"unit": "(x - lo) / (hi - lo)", "symmetric": "2 * (x - lo) / (hi - lo) - 1", "standard": "(x - mu) / sd",
           "robust": "(x - q50) / (q75 - q25)"}


def _stats(column: str, source: str) -> str:
    return (f"SELECT min({column}) AS lo, max({column}) AS hi, avg({column}) AS mu, stddev_pop({column}) AS sd, "
            f"quantile_cont({column}, 0.25) AS q25, quantile_cont({column}, 0.5) AS q50, quantile_cont({column}, 0.75) AS q75 "
            f"FROM {source}")


def _scaled_sql(expression: str, out: str = "z") -> str:
    return (f"SELECT l_orderkey, l_linenumber, {sql_rnd(expression, 7)} AS {out} "
            f"FROM (SELECT *, l_extendedprice AS x FROM lineitem) CROSS JOIN ({_stats('l_extendedprice', 'lineitem')})")


def _scaled(spark, sf_dir, *methods):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("z"))
    return scale.Scaler.fit(df, ["z"], methods).transform(df).withColumn("z", rnd("z", 7))


for _name, _method, _kind in (("m01_unit_range", "MinMax", "unit"), ("m02_symmetric_range", "MinMax(-1.1)", "symmetric"),
                              ("m03_standard", "Standard", "standard"), ("m04_robust", "Robust", "robust")):
    query(_name, _scaled_sql(_SCALED[_kind]))(lambda spark, sf_dir, m=_method: _scaled(spark, sf_dir, m))


@query("m05_chain", f"""
WITH first AS (SELECT l_orderkey, l_linenumber, (x - q50) / (q75 - q25) AS x
               FROM (SELECT *, l_extendedprice AS x FROM lineitem) CROSS JOIN ({_stats('l_extendedprice', 'lineitem')}))
SELECT l_orderkey, l_linenumber, {sql_rnd(_SCALED['standard'], 7)} AS z
FROM first CROSS JOIN ({_stats('x', 'first')})""")
def chain(spark, sf_dir):
    return _scaled(spark, sf_dir, "Robust", "Standard")


@query("m06_inverse", f"SELECT l_orderkey, l_linenumber, {sql_rnd('l_extendedprice', 5)} AS z, {sql_rnd('l_quantity', 5)} AS y FROM lineitem")
def inverse(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("z"), F.col("l_quantity").alias("y"))
    scaler = scale.Scaler.fit(df, ["z", "y"], ["Robust", "MinMax(-1.1)"])
    back = scaler.inverse(scaler.transform(df))
    return back.select("l_orderkey", "l_linenumber", rnd("z", 5).alias("z"), rnd("y", 5).alias("y"))


@query("m07_scaled_apart", sql("run", f"""
SELECT axis, pos, is_test, {sql_rnd('(fm - avg(fm) OVER w) / stddev_pop(fm) OVER w', 7)} AS fm
FROM split WINDOW w AS (PARTITION BY is_test)""", more=_SPLIT))
def scaled_apart(spark, sf_dir):
    run, _ = run_of(spark, sf_dir)
    marked = split.hold_out(run.select("axis", "pos", "fm"), ["axis", "pos"], by=["axis"])
    return scale.scale_by(marked, ["fm"], ["Standard"], ["is_test"]).withColumn("fm", rnd("fm", 7))


_NAMES = {"MinMax": "unit", "MinMax()": "unit", "MinMax(0,1)": "unit", "MinMax(0.1)": "unit", "MinMax(-1.1)": "symmetric",
          "Standard": "standard"}


@query("m08_scaler_names", " UNION ALL ".join(
    f"SELECT '{n}' AS method, o_orderkey, {sql_rnd(_SCALED[k], 7)} AS z "
    f"FROM (SELECT o_orderkey, o_totalprice AS x FROM orders) CROSS JOIN ({_stats('o_totalprice', 'orders')})"
    for n, k in _NAMES.items()))
def scaler_names(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("x"))
    fitted = {n: scale.Scaler.fit(df, ["x"], [n]) for n in _NAMES}
    return df.select("o_orderkey", F.inline(F.array(*[
        F.struct(F.lit(n).alias("method"), rnd(s.forward("x"), 7).alias("z")) for n, s in fitted.items()])))
