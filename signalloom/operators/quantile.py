"""Exact linear-interpolated quantiles and quantile bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions.scalar import named
from signalloom.operators.series import attach, join_groups, written
from signalloom.session import cut

FINE_BINS = 1 << 16
ROUNDS = 4


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Quantiles in long form: (by..., name, prob, value), nulls and NaN left out.

    One way for every size: the wanted ranks are found by counting, see `_select_ranks`.
    """
    entries = [F.struct(F.lit(c).alias("name"), F.when(~F.isnan(named(c).cast("double")), named(c).cast("double")).alias("x"))
               for c in columns]
    values = (df.select(*by, F.explode(F.array(*entries)).alias("e")).select(*by, "e.name", "e.x")
              .filter(F.col("x").isNotNull()))
    return _select_ranks(cut(values, "values"), [*by, "name"], [float(p) for p in probs])


def _magnitude(x: Column) -> Column:
    """Integer that never falls as x rises: 32 steps per doubling, at most 140,000 values."""
    size = F.least(F.greatest(F.abs(x), F.lit(5e-324)), F.lit(1.7e308))
    step = (F.floor(F.log2(size) * 32) + 40000).cast("bigint")
    return F.when(x > 0, step).when(x < 0, -step).otherwise(F.lit(0))


def _fine(x: Column, low: Column, high: Column) -> Column:
    share = F.when(high > low, (x - low) / (high - low)).otherwise(F.lit(0.0))
    return F.least(F.floor(share * FINE_BINS), F.lit(FINE_BINS - 1)).cast("bigint")


def _select_ranks(values: DataFrame, group: list[str], probs: list[float]) -> DataFrame:
    """Rank selection by repeated counting.

    Each round counts values per bin (combined before the shuffle), finds the bins
    that hold the wanted ranks, and goes on inside those only. A bin whose values are
    all equal is the answer, so ties end early. A group has at most 140,000 bins in the
    first round and 65,536 per bin later, whatever the data. Bins shrink by 65,536 per
    round, so after four rounds a bin holds few distinct doubles, which are counted one
    by one. No step gathers an unbounded group, and values are never sorted as a whole.
    """
    points = F.array(*[F.lit(p) for p in probs])
    inside, keys, state, done, short = values, list(group), None, None, False
    for level in range(ROUNDS + 1):
        last = level == ROUNDS
        if state is None:
            bin_key = "k0"
            inside = inside.withColumn(bin_key, _magnitude(F.col("x")))
        else:
            inside = join_groups(inside, state.select(*keys, "low", "high"), keys, short=short)
            bin_key = "x" if last else f"k{level}"
            if not last:
                inside = inside.withColumn(bin_key, _fine(F.col("x"), F.col("low"), F.col("high")))
            inside = inside.drop("low", "high")
        bins = inside.groupBy(*keys, bin_key).agg(F.count(F.lit(1)).alias("rows"), *(
            [] if last else [F.min("x").alias("low"), F.max("x").alias("high")]))
        if last:
            bins = bins.withColumn("low", F.col("x")).withColumn("high", F.col("x"))
        up_to = Window.partitionBy(*keys).orderBy(bin_key).rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("upto", F.sum("rows").over(up_to))
        if state is None:
            bins = bins.withColumn("n", F.sum("rows").over(Window.partitionBy(*group))).withColumn("before", F.lit(0).cast("bigint"))
            floor = lambda p: F.floor((F.col("n") - 1) * p)
            bins = bins.withColumn("ranks", F.array_distinct(F.flatten(F.transform(
                points, lambda p: F.array(floor(p), F.least(floor(p) + 1, F.col("n") - 1))))))
        else:
            bins = join_groups(bins, state.select(*keys, "n", "before", "ranks"), keys)
        bins = bins.withColumn("before", F.col("before") + F.col("upto") - F.col("rows"))
        end = F.col("before") + F.col("rows")
        bins = (bins.withColumn("ranks", F.filter("ranks", lambda r: (r >= F.col("before")) & (r < end)))
                .filter(F.size("ranks") > 0).drop("upto"))
        bins, short, counts = written(bins, "bins", open=F.count_if(F.col("low") < F.col("high")))
        answer = bins.filter(F.col("low") == F.col("high")).select(*group, "n", "ranks", F.col("low").alias("x"))
        done = answer if done is None else done.unionByName(answer)
        state, keys = bins.filter(F.col("low") < F.col("high")), [*keys, bin_key]
        if last or not counts["open"]:
            break
    bins = done
    found = bins.select(*group, "n", F.explode("ranks").alias("rank"), F.col("x").alias("v"))
    ends = found.groupBy(*group, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    place = (F.col("n") - 1) * F.col("prob")
    low = F.floor(place)
    below = F.element_at("at", low)
    above = F.element_at("at", F.least(low + 1, F.col("n") - 1))
    return (ends.select("*", F.explode(points).alias("prob"))
            .select(*group, "prob", (below + (above - below) * (place - low)).alias("value")))


def quantile_bins(df: DataFrame, columns: dict[str, str], bins: int = 4, by: Sequence[str] = ()) -> DataFrame:
    """Add bin numbers 0..bins-1: {source column: bin column}.

    Bins are cut at equally spaced quantiles of the whole column, closed on the
    right with the lowest value included, so equal values share a bin and nulls
    stay null. Two equal edges are an error.
    """
    probs = [i / bins for i in range(bins + 1)]
    edges = exact_quantiles(df, list(columns), probs, by)
    table = edges.groupBy(*by).agg(*[
        F.array_sort(F.collect_list(F.when(F.col("name") == c, F.col("value")))).alias(f"__edge{i}")
        for i, c in enumerate(columns)])
    if by:
        wide = attach(df, table, by)
        edge = {c: F.col(f"__edge{i}") for i, c in enumerate(columns)}
    else:
        row = table.first()
        wide = df
        edge = {c: F.array(*[F.lit(e) for e in row[i]]) for i, c in enumerate(columns)}
        for c, values in zip(columns, row):
            if len(set(values)) < len(values):
                raise ValueError(f"bin edges of {c} are not unique")
    for c, name in columns.items():
        steps = [F.when(named(c) > edge[c][i], 1).otherwise(0) for i in range(1, bins)]
        number = F.when(named(c).isNotNull() & ~F.isnan(named(c).cast("double")), sum(steps[1:], steps[0]))
        if by:
            number = F.when(F.size(F.array_distinct(edge[c])) < F.size(edge[c]),
                            F.raise_error(F.lit(f"bin edges of {c} are not unique"))).otherwise(number)
        wide = wide.withColumn(name, number.cast("int"))
    return wide.select(*[named(c) for c in df.columns], *columns.values())
