"""Register of queries and of the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.functions.scalar import named
from signalloom.operators.series import SeriesSpec
from signalloom.plans import prepare
from signalloom.sources.signals import signals, spec_for, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

RUN = "click|view"
THRESHOLD = 40.0


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql:
            ORACLE[name] = sql
        return build
    return register


def rnd(value: Column | str, digits: int = 6) -> Column:
    """Rounded number that compares equal across engines; no negative zero."""
    x = named(value) if isinstance(value, str) else value
    return F.when(F.abs(x) < 0.5 * 10.0 ** -digits, F.lit(0.0)).otherwise(F.round(x, digits))


def sql_rnd(value: str, digits: int = 6) -> str:
    return (f"CASE WHEN abs({value}) < CAST('{0.5 * 10.0 ** -digits!r}' AS DOUBLE) THEN CAST(0 AS DOUBLE) "
            f"ELSE round({value}, {digits}) END")


def run_of(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = ("axis",),
           columns: tuple[str, ...] | None = None) -> tuple[DataFrame, SeriesSpec]:
    """The run for a single reader; with `columns` just these, written for several readers."""
    spec = spec_for(spark, sf_dir, keys)
    return prepare.measurement_run(signals(spark, sf_dir), spec, RUN, columns, write=columns is not None), spec


def predicted_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, SeriesSpec]:
    run, spec = run_of(spark, sf_dir, columns=("cycle", "v", "a", "fr"))
    return prepare.baseline_score(run, spec, THRESHOLD).predictions, spec


def _gappy(value: str, step: int, rest: int) -> str:
    return f"CASE WHEN event_id <= 200 OR event_id % {step} <> {rest} THEN {value} END"


_NUMBER = "CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)"
_SIG = f"""sig AS (
  SELECT 'all' AS series, CAST(user_id % 3 AS INTEGER) AS axis, event_id AS cycle, ts, {_gappy('event_type', 5, 3)} AS tag,
         CASE WHEN event_type <> 'error' THEN value END AS v, {_gappy(_NUMBER, 7, 2)} AS a,
         {_gappy('value + event_id % 4', 11, 5)} AS fm, {_gappy(_NUMBER + ' + event_id % 3', 13, 6)} AS fb
  FROM events)"""


def _filled(keys: str) -> str:
    last = ", ".join(f"last_value({c} IGNORE NULLS) OVER so_far AS {c}" for c in ("ts", "tag", "v", "a", "fm", "fb"))
    return f"""filled AS (
  SELECT * REPLACE ({last}) FROM sig
  WINDOW so_far AS (PARTITION BY {keys} ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _run(keys: str) -> str:
    return f"""run AS (
  SELECT *, fm - fb AS fr, row_number() OVER (PARTITION BY {keys} ORDER BY cycle) - 1 AS pos,
         count(*) OVER (PARTITION BY {keys}) AS n_rows
  FROM filled WHERE regexp_matches(tag, '{RUN}'))"""


_PRED = """line AS (
  SELECT axis, regr_slope(fr, v) AS slope, regr_intercept(fr, v) AS base FROM run GROUP BY axis),
pred AS (
  SELECT run.*, slope * v + base AS y_pred, abs(fr - (slope * v + base)) AS err FROM run JOIN line USING (axis))"""


def sql(stage: str, body: str, keys: str = "axis", more: str = "") -> str:
    """SQL over the shared stages sig, filled, run and pred, up to the one named."""
    stages = [_SIG, _filled(keys), _run(keys), _PRED][: ["sig", "filled", "run", "pred"].index(stage) + 1]
    return "WITH " + ",\n".join(stages + ([more] if more else [])) + "\n" + body


__all__ = ["ORACLE", "QUERIES", "RUN", "THRESHOLD", "predicted_of", "query", "rnd", "run_of", "signals", "spec_for",
           "sql", "sql_rnd", "table"]
