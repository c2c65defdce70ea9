"""Zero-phase Butterworth low-pass of any order, over series of any length."""

from __future__ import annotations

import cmath
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalloom.functions.scalar import named
from signalloom.operators.series import CHUNK, PLAIN_ROWS, ChunkFrame, SeriesSpec, attach, chunked, unchunked
from signalloom.session import cut

EDGE_ROWS = 6  # odd extension on either side: three times the filter length of two


def coefficients(cutoff: float) -> tuple[float, float]:
    """(gain, decay) of y[i] = gain (x[i] + x[i-1]) + decay y[i-1]; cutoff relative to Nyquist."""
    if not 0 < cutoff < 1:
        raise ValueError("cutoff must lie between 0 and 1")
    k = math.tan(math.pi * cutoff / 2)
    return k / (1 + k), (1 - k) / (1 + k)


def payload_type(df: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])


def _pass(x: str, place: Column, frame: ChunkFrame, decay: float, gain: float, descending: bool) -> Column:
    """One recursive pass over a chunk, as a growing sum of exponentially weighted inputs.

    With u[i] = gain (x[i] + x[i-1]) the recursion solves to
    y[j] = decay^j (y[0] + sum of u[i] decay^-i), starting in the steady state of
    the first value. The weights grow with i, so early rounding fades away.
    """
    window = frame.backwards() if descending else frame.ordered()
    whole = window.rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag(x).over(window)
    # The first row carries the steady state, y[0] = x[0].
    drive = F.when(before.isNull(), F.col(x)).otherwise((F.col(x) + before) * gain)
    return drive * F.pow(F.lit(decay), -place), whole


def _extended(df: DataFrame, keys: list[str], column: str, pos: str, edge: int) -> DataFrame:
    """Rows as (keys, __gaps, __size, __base, __p, __x, __row) with `edge` mirrored ones, without a row, on either side.

    `__size` is the extended length and `__base` the first extended value.
    """
    value = named(column).cast("double")
    ends = df.groupBy(*keys).agg(
        F.max(F.when(F.col(pos) == 0, value)).alias("__first"),
        F.max(F.when(F.col(pos) == edge, value)).alias("__turn"),
        F.max_by(value, pos).alias("__last"),
        F.count(F.lit(1)).alias("__n"),
        (F.count(value) < F.count(F.lit(1))).alias("__gaps"))
    p, n, x = F.col("__p"), F.col("__n"), F.col("__x")
    payload = F.struct(*[named(c) for c in df.columns])
    known = attach(df.select(*keys, payload.alias("__row"), F.col(pos).alias("__p"),
                             F.coalesce(value, F.lit(0.0)).alias("__x")), ends, keys)
    short = F.raise_error(F.lit("series too short to filter")).cast("bigint")
    nothing = F.lit(None).cast(payload_type(df))

    def at(place: Column, level: Column, row: Column) -> Column:
        return F.struct(place.alias("__p"), level.alias("__x"), row.alias("__row"))

    base = F.coalesce(2 * F.col("__first") - F.col("__turn"), F.lit(0.0))
    return known.select(*keys, "__gaps", (n + 2 * edge).alias("__size"), base.alias("__base"), F.inline(F.filter(F.array(
        at(F.when(n <= edge, short).otherwise(p + edge), x, F.col("__row")),
        F.when(p.between(1, edge), at(edge - p, 2 * F.col("__first") - x, nothing)),
        F.when(p.between(n - 1 - edge, n - 2), at(2 * (n - 1) - p + edge, 2 * F.col("__last") - x, nothing)),
    ), lambda r: r.isNotNull())))


def low_pass(df: DataFrame, spec: SeriesSpec, column: str, cutoff: float = 0.1, out: str | None = None,
             pos: str = "pos", order: int = 1) -> DataFrame:
    """Filter forward, then backward, over the series extended by three mirrored rows per filter tap.

    At first order the response fades as decay^rows, so each chunk needs a bounded halo
    for a result equal to the full recursion to rounding. Where that halo would not fit a
    chunk, and for higher orders, `carried_low_pass` hands states from chunk to chunk. A
    series with a missing value filters to null throughout; one no longer than its
    extension (six rows at first order) is an error.
    """
    out = out or f"{column}_lp"
    gain, decay = coefficients(cutoff)
    fade = math.log(abs(decay) or 1e-18)
    reach = math.ceil(-42 / fade)                        # |decay|^reach < 1e-18
    if order != 1 or reach > PLAIN_ROWS:
        return carried_low_pass(df, spec, column, cutoff, order, out, pos)
    rows = math.floor(-600 / fade) - 2 * reach           # |decay|^-(rows + halo) stays finite
    keys = list(spec.keys)
    p = F.col("__p")
    extended = _extended(df, keys, column, pos, EDGE_ROWS).select(*keys, "__gaps", "__p", "__x", "__row")

    frame = ChunkFrame(tuple(keys), "__p")
    pieces = chunked(extended, spec, reach, reach, "__p", rows)
    # Exponents count from the end of the chunk where the pass starts, halo included.
    up = p - (F.col(CHUNK) * rows - reach)
    down = ((F.col(CHUNK) + 1) * rows - 1 + reach) - p
    for source, target, place, descending in (("__x", "__f", up, False), ("__f", "__y", down, True)):
        drive, whole = _pass(source, place, frame, decay, gain, descending)
        pieces = (pieces.withColumn("__drive", drive)
                  .withColumn(target, F.sum("__drive").over(whole) * F.pow(F.lit(decay), place)))
    return (unchunked(pieces).filter(F.col("__row").isNotNull())
            .select("__row.*", F.when(~F.col("__gaps"), F.col("__y")).alias(out)))


# --- any order, any cutoff ---------------------------------------------------------------

STEP = 16  # chunks that one step of the scan over chunks joins
GONE = 1e-20  # share of a state that is nothing any more


@dataclass(frozen=True)
class Mode:
    """One pole of the filter with its weight; a complex one stands for its conjugate too."""

    pole: complex
    weight: complex

    @property
    def is_real(self) -> bool:
        return self.pole.imag == 0

    def power(self, exponent: Column) -> tuple[Column, Column | None]:
        """Real and imaginary part of the pole to a whole power."""
        if self.is_real:
            return F.pow(F.lit(self.pole.real or 1e-18), exponent), None
        size, angle = F.pow(F.lit(abs(self.pole)), exponent), exponent * cmath.phase(self.pole)
        return size * F.cos(angle), size * F.sin(angle)


def butterworth_modes(order: int, cutoff: float) -> tuple[float, list[Mode]]:
    """(gain, modes) of y[n] = gain x[n] + sum of Re(weight s[n-1]), with s[n] = pole s[n-1] + x[n] in each mode.

    The bilinear transform of the analogue filter, as a sum over its poles. All poles
    differ, so this is the very filter, and unlike its polynomials it keeps its digits
    at low cutoffs.
    """
    if not 0 < cutoff < 1:
        raise ValueError("cutoff must lie between 0 and 1")
    if not 1 <= order <= 8:
        raise ValueError("order must lie between 1 and 8")
    g = math.tan(math.pi * cutoff / 2)
    analogue = [-1 + 0j if 2 * k + 1 == order else cmath.exp(1j * math.pi * (2 * k + order + 1) / (2 * order)) for k in range(order)]
    poles = [(1 + g * s) / (1 - g * s) for s in analogue]
    gain = math.prod((g / (1 - g * s) for s in analogue), start=1 + 0j).real
    modes = []
    for k, p in enumerate(poles):
        if analogue[k].imag < -1e-12:
            continue
        others = math.prod((p - q for j, q in enumerate(poles) if j != k), start=1 + 0j)
        weight = gain * (1 + p) ** order / others
        real = abs(analogue[k].imag) <= 1e-12
        modes.append(Mode(complex(p.real), complex(weight.real)) if real else Mode(p, 2 * weight))
    return gain, modes


def _times(left: tuple[Column, Column | None], right: tuple[Column, Column | None]) -> tuple[Column, Column | None]:
    (a, b), (c, d) = left, right
    if b is None or d is None:
        return a * c, b * c if b is not None else (a * d if d is not None else None)
    return a * c - b * d, a * d + b * c


def _scaled(mode: Mode, factor: complex, state: tuple[Column, Column | None]) -> tuple[Column, Column | None]:
    return _times((F.lit(factor.real), None if mode.is_real else F.lit(factor.imag)), state)


def _states(modes: list[Mode], prefix: str) -> list[list[str]]:
    """Names of the columns that hold the states: one of a real mode, two of a complex one."""
    return [[f"{prefix}{i}{part}" for part in ("r" if m.is_real else "ri")] for i, m in enumerate(modes)]


def _sweep(rows: DataFrame, keys: list[str], gain: float, modes: list[Mode], length: int, source: str, target: str,
           backwards: bool) -> DataFrame:
    """One pass of the filter from a state of rest, along `__p` or against it.

    A chunk of `length` rows maps the state s before it to pole^length s + c, where c
    is a weighted sum of its own rows: one row per chunk. These maps are composed by
    a scan in steps of 16, 256, ... chunks, each one grouped sum, until a state has
    faded or every chunk is reached. Inside a chunk a growing sum of inputs, weighted
    by inverse powers of the pole, gives the rest.
    """
    p, x, size = F.col("__p"), F.col(source), F.col("__size")
    chunk = F.expr(f"`__p` div {length}L")
    placed = rows.withColumn(CHUNK, chunk)
    first = F.col(CHUNK) * length
    place = (first + (length - 1) - p) if backwards else (p - first)
    names = _states(modes, "__s")
    columns = [n for state in names for n in state]

    own = [F.sum(x * part).alias(n) for m, state in zip(modes, names)
           for n, part in zip(state, m.power(F.lit(length - 1) - place))]
    table = placed.groupBy(*keys, CHUNK).agg(F.expr(f"(max(`__size`) - 1) div {length}L").alias("__top"), *own)
    sign = -1 if backwards else 1
    inside = F.col("__to").between(0, F.col("__top"))
    reach = 1
    while max(abs(m.pole) for m in modes) ** (length * reach) > GONE:
        hops = []
        for d in range(STEP):
            factors = [m.pole ** (length * reach * d) for m in modes]
            moved = [c.alias(n) for m, state, f in zip(modes, names, factors)
                     for n, c in zip(state, _scaled(m, f, tuple(map(F.col, state)) + ((None,) if m.is_real else ())))]
            hops.append(F.struct((F.col(CHUNK) + sign * reach * d).alias("__to"), "__top", *moved))
        table = (table.select(*keys, F.inline(F.array(*hops))).where(inside)
                 .groupBy(*keys, F.col("__to").alias(CHUNK), "__top").agg(*[F.sum(n).alias(n) for n in columns]))
        reach *= STEP
    carried = (table.withColumn("__to", F.col(CHUNK) + sign).where(inside)
               .select(*keys, F.col("__to").alias(CHUNK), *columns))
    known = attach(placed, carried, [*keys, CHUNK], "left")

    order = p.desc() if backwards else p.asc()
    before = Window.partitionBy(*keys, CHUNK).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums, sum_names = [], _states(modes, "__u")
    for m, state in zip(modes, sum_names):
        sums += [(x * part).alias(n) for n, part in zip(state, m.power(-place))]
    known = known.select("*", *sums)
    known = known.select("*", *[F.coalesce(F.sum(n).over(before), F.lit(0.0)).alias(f"{n}_") for state in sum_names for n in state])
    y = x * gain
    for m, state, grown in zip(modes, names, sum_names):
        def pair(cols: list[Column], m: Mode = m) -> tuple[Column, Column | None]:
            return (cols[0], None) if m.is_real else (cols[0], cols[1])
        inner = _times(pair([F.col(f"{n}_") for n in grown]), m.power(place - 1))
        outer = _times(pair([F.coalesce(n, F.lit(0.0)) for n in state]), m.power(place))
        both = (inner[0] + outer[0], None if m.is_real else inner[1] + outer[1])
        y = y + _scaled(m, m.weight, both)[0]
    return known.select(*[named(c) for c in rows.columns], y.alias(target))


def carried_low_pass(df: DataFrame, spec: SeriesSpec, column: str, cutoff: float = 0.1, order: int = 1, out: str | None = None,
                     pos: str = "pos") -> DataFrame:
    """The filter of any order and cutoff, forward and backward, without a halo.

    The series is extended by 3 (order + 1) mirrored rows. Each pass starts in the steady state
    of its first value, that is, at rest after this value is taken off. The
    first pass is written once, as the second needs its last value and reads it twice.
    """
    out = out or f"{column}_lp"
    keys = list(spec.keys)
    gain, modes = butterworth_modes(order, cutoff)
    smallest = min(abs(m.pole) for m in modes)
    length = min(PLAIN_ROWS, math.floor(-600 / math.log(max(smallest, 1e-18))))  # inverse powers stay finite
    extended = _extended(df, keys, column, pos, 3 * (order + 1)).withColumn("__x", F.col("__x") - F.col("__base"))
    there = _sweep(extended, keys, gain, modes, length, "__x", "__f", False)
    there = cut(there.select(*keys, "__gaps", "__size", "__p", "__row", (F.col("__f") + F.col("__base")).alias("__f")), "there")
    ends = there.where(F.col("__p") == F.col("__size") - 1).select(*keys, F.col("__f").alias("__base"))
    known = attach(there, ends, keys).withColumn("__x", F.col("__f") - F.col("__base"))
    back = _sweep(known, keys, gain, modes, length, "__x", "__y", True)
    return back.where(F.col("__row").isNotNull()).select("__row.*", F.when(~F.col("__gaps"), F.col("__y") + F.col("__base")).alias(out))
