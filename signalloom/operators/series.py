"""Order-dependent work on series of any length.

A window ordered over a whole series would put that series into one task. The
functions here split every series, however long, into bounded pieces:

* *buckets* are ranges of the order key. They are a pure function of the row, so
  a lost task can be recomputed, and small per-bucket tables (row counts, last
  known values) carry what one bucket has to know of the earlier ones.
* *chunks* are ranges of the dense row position. Rows near a chunk edge are also
  sent to the neighbours that need them (the halo), so that any frame of bounded
  length is complete inside its chunk.

Series keys must not be null, as joins on them would lose rows: the scans in
`signalloom.sources` always name a series, and `fit_spec` refuses null keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalloom.functions.scalar import named
from signalloom.session import cut

BUCKET = "__bucket"
CHUNK = "__chunk"
LAST_BUCKET = (1 << 63) - 1
TARGET_ROWS = 1 << 20
PLAIN_ROWS = 4096  # default of spark.sql.windowExec.buffer.in.memory.threshold
SHORT_BYTES = 64 << 20  # a written table of up to this size in memory is broadcast


@dataclass(frozen=True)
class SeriesSpec:
    """How rows form ordered series.

    keys          columns naming a series
    order         integer order key; null sorts last
    tie           further columns that make the order total
    bucket_width  order-key values per bucket
    chunk_rows    rows per chunk; chosen from the frame length when not given
    """

    keys: tuple[str, ...] = ("series",)
    order: str = "cycle"
    tie: tuple[str, ...] = ()
    bucket_width: int = TARGET_ROWS
    chunk_rows: int | None = None

    @property
    def sort(self) -> list[Column]:
        return [named(c).asc_nulls_last() for c in (self.order, *self.tie)]

    @property
    def bucket(self) -> Column:
        return F.coalesce(F.expr(f"(`{self.order}` - pmod(`{self.order}`, {self.bucket_width}L)) div {self.bucket_width}L"),
                          F.lit(LAST_BUCKET))

    def by_bucket(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, BUCKET).orderBy(*self.sort)

    def over_buckets(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(BUCKET)


def fit_spec(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: Sequence[str] = (),
    target_rows: int = TARGET_ROWS,
    min_pieces: int | None = None,
) -> SeriesSpec:
    """Choose the bucket width from the key range and the row count.

    Reads only the key columns and returns a handful of numbers to the driver.
    The fullest bucket is counted, and the width shrinks until it is small
    enough; keys that stay crowded even so need `position_by_sort`. No bucket holds more
    than `target_rows` rows, whatever the size of the input.
    """
    pieces = min_pieces or 4 * df.sparkSession.sparkContext.defaultParallelism
    unnamed = F.count_if(F.greatest(F.lit(False), *[named(k).isNull() for k in keys]))
    low, high, rows, lost = df.agg(F.min(order), F.max(order), F.count(F.lit(1)), unnamed).first()
    if lost:
        raise ValueError(f"{lost} rows have a null series key")
    count = max(1, -(-rows // target_rows), pieces)
    span = (high - low + 1) if low is not None else 1
    spec = SeriesSpec(tuple(keys), order, tuple(tie), max(1, -(-span // count)))
    while True:
        fullest = (df.groupBy(*keys, spec.bucket.alias(BUCKET)).count()
                   .agg(F.max("count")).first()[0]) or 0
        if fullest <= target_rows:
            return spec
        if spec.bucket_width == 1:
            raise ValueError("one order key holds too many rows: use position_by_sort first")
        spec = replace(spec, bucket_width=max(1, spec.bucket_width * target_rows // (2 * fullest)))


def join_groups(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner",
                short: bool = False) -> DataFrame:
    """Join on group keys where null is a group like any other, as in groupBy; a `short` table is broadcast."""
    renamed = table.select(*[named(c).alias(f"__key{keys.index(c)}") if c in keys else named(c) for c in table.columns])
    if short:
        renamed = F.broadcast(renamed)
    same = reduce(and_, [named(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)])
    return df.join(renamed, same, how).drop(*[f"__key{i}" for i in range(len(keys))])


def _sizes(schema: T.StructType) -> list[Column]:
    """Aggregates for `_bytes`: the number of rows, and the length of each column of texts or arrays."""
    long = [f for f in schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType))]
    size = lambda f: F.octet_length(named(f.name)) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.size(named(f.name)) * 32
    return [F.count(F.lit(1)).alias("rows"), *[F.sum(F.greatest(size(f), F.lit(0))).alias(f"long{i}") for i, f in enumerate(long)]]


def _bytes(schema: T.StructType, found: dict[str, int | None]) -> int:
    return 16 * found["rows"] * len(schema) + sum(found[k] or 0 for k in found if k.startswith("long"))


def is_short(table: DataFrame) -> bool:
    """Is a written table small enough to broadcast, by its rows, its width and the length of its texts and arrays?"""
    return _bytes(table.schema, table.agg(*_sizes(table.schema)).first().asDict()) <= SHORT_BYTES


def written(df: DataFrame, name: str = "cut", **counts: Column) -> tuple[DataFrame, bool, dict[str, int]]:
    """`df` written to the shared folder, whether it is short, and further `counts`, all seen while writing.

    So no second reading of the table is needed to learn its size.
    """
    wanted = [*_sizes(df.schema), *[c.alias(n) for n, c in counts.items()]]
    seen = Observation()
    table = cut(df.observe(seen, *wanted), name)
    found = dict(seen.get)
    if not {"rows", *counts} <= set(found):  # nothing was run, as the plan is known to be empty
        found = table.agg(*wanted).first().asDict()
    return table, _bytes(df.schema, found) <= SHORT_BYTES, {n: found[n] for n in counts}


def join_written(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a written table, broadcast if its size in bytes says so."""
    return join_groups(df, table, list(keys), how, short=is_short(table))


def attach(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a per-group table to the rows of its groups.

    The table is written out and counted on the way. It is broadcast only when it is
    short, so a group with most of the rows is not sent to one task; a long table
    means many groups, and then both sides are shuffled on the key.
    """
    kept, short, _ = written(table)
    return join_groups(df, kept, list(keys), how, short)


def bucketed(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Attach the bucket column; a chain that keeps it shuffles only once."""
    return df if BUCKET in df.columns else df.withColumn(BUCKET, spec.bucket)


def _as_given(out: DataFrame, given: DataFrame) -> DataFrame:
    return out if BUCKET in given.columns else out.drop(BUCKET)


def with_position(df: DataFrame, spec: SeriesSpec, pos: str = "pos", length: str | None = None,
                  write: bool = False) -> DataFrame:
    """Dense position 0..n-1 of each row in its series, and the series length on request.

    Rows are numbered inside their bucket; the rows of earlier buckets are added
    from a table with one row per bucket. By default that table is counted from
    the input, which suits plain scans, and joined on the keys the numbering is
    partitioned by, so the wide side is not shuffled again. With `write` the
    numbered rows are written first and counted from there, which suits inputs
    that are costly to compute or read more than once.
    """
    cut_up = bucketed(df, spec)
    inner, offset, total = "__inner", "__offset", length or "__length"
    earlier = spec.over_buckets().rowsBetween(Window.unboundedPreceding, -1)
    numbered = cut_up.withColumn(inner, F.row_number().over(spec.by_bucket()).cast("bigint") - 1)
    if write:
        numbered = cut(numbered, "placed")
    counts = (numbered if write else cut_up).groupBy(*spec.keys, BUCKET).agg(F.count(F.lit(1)).alias("__rows"))
    offsets = counts.select(
        *spec.keys, BUCKET,
        F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias(offset),
        *([F.sum("__rows").over(Window.partitionBy(*spec.keys)).alias(total)] if length else []),
    )
    join_keys = [*spec.keys, BUCKET]
    out = attach(numbered, offsets, join_keys) if write else numbered.join(offsets, join_keys)
    out = out.withColumn(pos, F.col(inner) + F.col(offset))
    names = [c for c in cut_up.columns if c != pos] + [pos] + ([total] if length else [])
    return _as_given(out.select(*[named(c) for c in names]), df)


def position_by_sort(df: DataFrame, spec: SeriesSpec, pos: str = "pos") -> DataFrame:
    """Dense position for order keys of any shape, by one distributed sort.

    Range partitions are drawn from a sample and stay balanced whatever the key
    looks like. The sorted rows are written to the shared folder before they
    are counted, so that counts and rows always belong together.
    """
    return ranked(df, spec.sort, pos, by=spec.keys).withColumn(pos, F.col(pos) - 1)


def ranked(df: DataFrame, order: Sequence[Column], rank: str = "rank", by: Sequence[str] = ()) -> DataFrame:
    """Rank 1..n of every row under a total order, per group or overall.

    No group is gathered into one task: rows are range-partitioned by group and
    order, numbered inside their partition, and shifted by the number of rows in
    earlier partitions (one small row per partition).
    """
    inner, part, offset = "__inner", "__part", "__offset"
    sorted_rows = cut(
        df.orderBy(*[named(k) for k in by], *order)
        .withColumn(part, F.spark_partition_id())
        .withColumn(inner, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "sorted")
    pieces = cut(sorted_rows.groupBy(part, *by).agg(F.count(F.lit(1)).alias("__rows"), F.min(inner).alias("__first")))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = pieces.groupBy(part).agg(F.sum("__rows").alias("__rows")).select(
        part, F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias(offset))
    shifts = pieces.join(F.broadcast(offsets), part)
    if by:
        start = F.min(F.col(offset) + F.col("__first")).over(Window.partitionBy(*by))
        shifts = shifts.withColumn(offset, F.col(offset) - start)
    return (attach(sorted_rows, shifts.select(part, *by, offset), [part, *by])
            .withColumn(rank, F.col(inner) + F.col(offset) + 1)
            .select(*[named(c) for c in df.columns], rank))


@dataclass(frozen=True)
class Feature:
    """A column that looks at up to `back` earlier and `ahead` later rows.

    `build` gives the column from the windows of the chunk. `blocks` are helper
    columns it needs: aggregates that grow through blocks of a fixed number of
    rows, forwards or backwards. `running` ones grow through the whole chunk.
    """

    name: str
    back: int
    ahead: int
    build: Callable[["ChunkFrame"], Column]
    blocks: tuple["BlockColumn", ...] = ()
    running: tuple["RunningColumn", ...] = ()


@dataclass(frozen=True)
class BlockColumn:
    """`aggregate` over the rows of the block up to the current one, from the far end if `backwards`."""

    name: str
    rows: int
    backwards: bool
    aggregate: Callable[[], Column]


@dataclass(frozen=True)
class RunningColumn:
    """`aggregate` over the rows of the chunk up to the current one."""

    name: str
    aggregate: Callable[[], Column]


@dataclass(frozen=True)
class ChunkFrame:
    """Windows available inside a chunk.

    `chains` are block lengths, each a multiple of the next. Windows of a chain
    name all its block numbers, either to split by or to order by. As block
    numbers rise with the position this changes no result, but lets Spark see
    that one sort serves them all.
    """

    keys: tuple[str, ...]
    pos: str
    chains: tuple[tuple[int, ...], ...] = ()

    @staticmethod
    def chain(lengths: set[int]) -> tuple[tuple[int, ...], ...]:
        chains: list[list[int]] = []
        for n in sorted(lengths, reverse=True):
            fitting = next((c for c in chains if c[-1] % n == 0), None)
            fitting.append(n) if fitting else chains.append([n])
        return tuple(map(tuple, chains))

    @property
    def numbers(self) -> list[Column]:
        """Block numbers counted up, and down for windows that run backwards."""
        return [F.expr(f"{sign}(`{self.pos}` div {n}L)").alias(f"{name}{n}")
                for c in self.chains for n in c for name, sign in (("__up", ""), ("__down", "0L - "))]

    @property
    def _order(self) -> list[str]:
        return [*[f"__up{n}" for n in (self.chains[0] if self.chains else ())], self.pos]

    @property
    def clause(self) -> str:
        """The plain window as SQL text, which is quicker to build for hundreds of columns."""
        keys = ", ".join(f"`{k}`" for k in (*self.keys, CHUNK))
        return f"OVER (PARTITION BY {keys} ORDER BY {', '.join(f'`{c}`' for c in self._order)})"

    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, CHUNK).orderBy(*self._order)

    def backwards(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, CHUNK).orderBy(F.col(self.pos).desc())

    def block(self, n: int, backwards: bool) -> WindowSpec:
        chain = next(c for c in self.chains if n in c)
        numbers = [f"{'__down' if backwards else '__up'}{m}" for m in chain]
        at = chain.index(n) + 1
        last = F.col(self.pos).desc() if backwards else F.col(self.pos).asc()
        return Window.partitionBy(*self.keys, CHUNK, *numbers[:at]).orderBy(*numbers[at:], last)


def chunked(df: DataFrame, spec: SeriesSpec, back: int, ahead: int, pos: str = "pos",
            chunk_rows: int | None = None) -> DataFrame:
    """Send each row to its chunk and to every chunk whose frames reach it.

    Chunks hold no more rows than a window keeps in plain memory, unless the halo
    would then make up more than a quarter.
    """
    halo = back + ahead
    rows = chunk_rows or spec.chunk_rows or max(PLAIN_ROWS - halo, 4 * halo)
    return df.withColumn(CHUNK, F.explode(F.sequence(
        F.expr(f"(`{pos}` - {ahead}) div {rows}L"), F.expr(f"(`{pos}` + {back}) div {rows}L"))
    )).withColumn("__own", F.col(CHUNK) == F.expr(f"`{pos}` div {rows}L"))


def unchunked(df: DataFrame) -> DataFrame:
    """Keep each row once, in its own chunk."""
    return df.filter("__own").drop("__own", CHUNK)


def add_features(df: DataFrame, spec: SeriesSpec, features: Sequence[Feature], pos: str = "pos") -> DataFrame:
    """Append all features with one exchange and one ordering of the chunks."""
    back = max((f.back for f in features), default=0)
    ahead = max((f.ahead for f in features), default=0)
    helpers = {b.name: b for f in features for b in f.blocks}
    frame = ChunkFrame(spec.keys, pos, ChunkFrame.chain({b.rows for b in helpers.values()}))
    pieces = chunked(df, spec, back, ahead, pos)
    if helpers:
        # Blocks split chunks further; placed by chunk first, all windows share one exchange.
        pieces = pieces.repartition(*spec.keys, CHUNK).select("*", *frame.numbers)
        for backwards in (True, False):
            for chain in reversed(frame.chains):
                pieces = pieces.select("*", *[
                    b.aggregate().over(frame.block(b.rows, backwards).rowsBetween(Window.unboundedPreceding, 0)).alias(n)
                    for n, b in helpers.items() if b.backwards == backwards and b.rows in chain])
    running = {r.name: r for f in features for r in f.running}
    if running:
        so_far = frame.ordered().rowsBetween(Window.unboundedPreceding, 0)
        pieces = pieces.select("*", *[r.aggregate().over(so_far).alias(n) for n, r in running.items()])
    out = pieces.select("*", *[f.build(frame).alias(f.name) for f in features])
    return unchunked(out).select(*[named(c) for c in df.columns], *[named(f.name) for f in features])
