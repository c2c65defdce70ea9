"""Embedding near-dedup by int8 tile products with error bounds.

Vectors are scaled to length 1 and written as int8 with their own scale; the length e
of what rounding took is stored. By the triangle inequality a product of two such
vectors is off by at most (1 + e1) * e2 + e1. A pair whose product less this bound
reaches the threshold is a link, one whose product plus this bound does not is none.
The others, and only they, are computed again from the original numbers in double
precision. Products of int8 numbers are whole numbers and exact, so a pair is judged
alike wherever it is met.

Equal vectors are one class. Classes go to the cell of their nearest pivot (a bounded
sample of vectors), cells are cut into tiles, tiles are dealt to groups; a task takes
the int8 forms of two groups and multiplies tile by tile. It leaves out two tiles whose
centres lie further apart than both radii and the threshold's angle together, which
loses nothing. It returns the number of links per vector, a spanning forest of the links
it found, and the vectors with an open pair per pair of tiles, never the pairs. Those
vectors alone travel again, in full. There are `GROUPS` groups until one is `GROUP_BYTES`
large, so till then a vector is sent a fixed number of times; products still grow with
the square of the vectors where no tiles are left out.

Defined results: vectors that are null, empty, zero or hold null, NaN or infinite
numbers, and rows without an id, link with nothing (component is the id itself, kept).
Vectors of different lengths are not comparable. Repeated rows are vectors of their
own that link with each other; a row stays if its id is its component. An empty table
gives no row; other columns are ignored.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalloom.llm.common import cut
from signalloom.llm.components import components

TILE_ROWS = 2048
#: Groups that tiles are dealt to, bytes of int8 numbers of a group at most, pivots of a vector length.
GROUPS, GROUP_BYTES, PIVOTS = 8, 32 << 20, 256


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of `x`, scaled to length 1."""
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 numbers, scale and error length of the rows of `x`, scaled to length 1."""
    x = _unit(x)
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    lost = x - q * scale[:, None]
    return q, scale, np.sqrt(np.einsum("ij,ij->i", lost, lost)) * (1 + 1e-9) + 1e-12


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    top = np.einsum("ij,ij->i", x, y)
    return top / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def _pairs(one: dict, two: dict, threshold: float, same: bool):
    """Blocks of row numbers (in one, in two) of pairs that may be links, and whether they are sure ones."""
    exact = np.float32 if one["q"].shape[1] * 127**2 < 1 << 24 else np.float64  # holds all sums of the products
    a, b = one["q"].astype(exact), two["q"].astype(exact).T
    worst = (1 + one["err"].max()) * two["err"].max() + one["err"].max()
    least = (threshold - worst - 1e-5) / two["scale"]
    step = max(1, (1 << 21) // max(1, b.shape[1]))
    for start in range(0, len(a), step):
        product = a[start : start + step] @ b
        i, j = np.nonzero(product * one["scale"][start : start + step, None].astype(exact) >= least[None, :].astype(exact))
        whole = product[i, j].astype(np.float64)
        i += start
        if same:
            upper = i < j
            i, j, whole = i[upper], j[upper], whole[upper]
        near = whole * one["scale"][i] * two["scale"][j]
        off = (1 + one["err"][i]) * two["err"][j] + one["err"][i] + 1e-9
        possible = near + off >= threshold
        i, j, sure = i[possible], j[possible], near[possible] - off[possible] >= threshold
        for at in range(0, len(i), 1 << 18):
            yield i[at : at + (1 << 18)], j[at : at + (1 << 18)], sure[at : at + (1 << 18)]


def _forest(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> None:
    """Lower the labels of 0..n-1 until both ends of each link agree."""
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _apart(one: dict, two: dict, threshold: float) -> bool:
    """Whether no vector of one tile can reach the threshold with one of the other."""
    angle = float(np.arccos(np.clip(one["centre"] @ two["centre"], -1, 1)))
    return angle - one["radius"] - two["radius"] > np.arccos(threshold) + 1e-6


def _result(ids: np.ndarray, count: np.ndarray, label: np.ndarray, opened: list[tuple]) -> pa.Table:
    """Linked vectors with their links here and their tree's top; opened: (keys, tile, tile, side)."""
    seen = np.flatnonzero(count)
    lengths = [len(o[0]) for o in opened]
    repeat = lambda k: np.repeat([o[k] for o in opened], lengths) if opened else []
    none = pa.nulls(len(seen), pa.int64())
    closed = pa.table({"id": pa.array(ids[seen]), "key": pa.nulls(len(seen), pa.binary()), "n": pa.array(count[seen]), "top": pa.array(ids[label[seen]]), "u": none, "v": none, "side": pa.nulls(len(seen), pa.int32())})
    still = pa.array([k.tobytes() for o in opened for k in o[0]], pa.binary())
    none = pa.nulls(len(still), pa.int64())
    rest = pa.table({"id": none, "key": still, "n": none, "top": none, "u": pa.array(repeat(1), pa.int64()), "v": pa.array(repeat(2), pa.int64()), "side": pa.array(repeat(3), pa.int32())})
    return pa.concat_tables([closed, rest])


def _compare(threshold: float):
    def compare(tiles: pa.Table) -> pa.Table:
        parts = []
        for r in tiles.to_pylist():
            n = r["n"]
            parts.append({
                "group": r["group"], "tile": r["tile"], "a": r["a"], "b": r["b"], "keys": np.frombuffer(r["keys"], "V16"), "ids": np.frombuffer(r["ids"], "<i8"), "m": np.frombuffer(r["m"], "<i8"),
                "q": np.frombuffer(r["q"], np.int8).reshape(n, -1), "scale": np.frombuffer(r["scale"], "<f8"), "err": np.frombuffer(r["err"], "<f8"),
                "centre": np.frombuffer(r["centre"], "<f8"), "radius": r["radius"]})
        parts.sort(key=lambda p: (p["group"], p["tile"]))
        first, last = parts[0]["a"], parts[0]["b"]
        ids = np.concatenate([p["ids"] for p in parts])
        starts = np.cumsum([0, *[len(p["ids"]) for p in parts]])
        count, label, opened = np.zeros(len(ids), np.int64), np.arange(len(ids)), []
        for u, one in enumerate(parts):
            for v, two in enumerate(parts):
                if v < u or one["group"] != first or two["group"] != last or (u != v and _apart(one, two, threshold)):
                    continue
                left, right = np.zeros(len(one["ids"]), bool), np.zeros(len(two["ids"]), bool)
                for i, j, sure in _pairs(one, two, threshold, u == v):
                    left[i[~sure]] = right[j[~sure]] = True
                    i, j = i[sure], j[sure]
                    np.add.at(count, starts[u] + i, two["m"][j])
                    np.add.at(count, starts[v] + j, one["m"][i])
                    _forest(len(ids), starts[u] + i, starts[v] + j, label)
                if u == v:
                    left |= right
                    right[:] = False
                opened += [(part["keys"][at], one["tile"], two["tile"], side) for side, (part, at) in enumerate(((one, left), (two, right))) if at.any()]
        return _result(ids, count, label, opened)

    return compare


def _confirm(threshold: float, kind: str):
    def confirm(rows: pa.Table) -> pa.Table:
        """Open pairs of two tiles (or of one), from the vectors that have any."""
        same = rows.column("u")[0].as_py() == rows.column("v")[0].as_py()
        side = rows.column("side").to_numpy()
        ids, m = rows.column("id").to_numpy(), rows.column("m").to_numpy()
        x = np.frombuffer(b"".join(rows.column("raw").to_pylist()), kind).reshape(len(ids), -1).astype(np.float64)
        q, scale, err = _quantise(x)
        at = [np.arange(len(ids))] * 2 if same else [np.flatnonzero(side == 0), np.flatnonzero(side == 1)]
        count, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        if len(at[0]) and len(at[1]):
            one, two = ({"q": q[k], "scale": scale[k], "err": err[k]} for k in at)
            for i, j, sure in _pairs(one, two, threshold, same):
                i, j = at[0][i[~sure]], at[1][j[~sure]]
                for start in range(0, len(i), 1 << 15):
                    k, n = i[start : start + (1 << 15)], j[start : start + (1 << 15)]
                    linked = _cosines(x[k], x[n]) >= threshold
                    k, n = k[linked], n[linked]
                    np.add.at(count, k, m[n])
                    np.add.at(count, n, m[k])
                    _forest(len(ids), k, n, label)
        return _result(ids, count, label, []).select(["id", "n", "top"])

    return confirm


def _pack(kind: str):
    def pack(rows: pa.Table) -> pa.Table:
        raw = rows.column("raw").to_pylist()
        x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1)
        q, scale, err = _quantise(x.astype(np.float64))
        unit = _unit(x.astype(np.float64))
        centre = unit.sum(axis=0)
        centre = _unit(centre[None, :])[0] if np.abs(centre).max() > 1e-9 else unit[0]
        radius = float(np.arccos(np.clip(unit @ centre, -1, 1)).max()) + 1e-6
        put = lambda v, t: pa.array([np.ascontiguousarray(v.astype(t)).tobytes()], pa.binary())
        return pa.table({
            "dims": pa.array([x.shape[1]], pa.int32()), "tile": pa.array([rows.column("tile")[0].as_py()], pa.int64()), "n": pa.array([len(raw)], pa.int32()),
            "keys": pa.array([b"".join(rows.column("key").to_pylist())], pa.binary()), "ids": put(rows.column("rep").to_numpy(), "<i8"), "m": put(rows.column("m").to_numpy(), "<i8"), "q": put(q, np.int8), "scale": put(scale, "<f8"),
            "err": put(err, "<f8"), "centre": put(centre, "<f8"), "radius": pa.array([radius], pa.float64())})

    return pack


def _cells(pivots: dict[int, bytes], kind: str):
    def cells(batches):
        """The number of the nearest pivot beside each vector; 0 for lengths without pivots."""
        marks = {d: _unit(np.frombuffer(p, kind).reshape(-1, d).astype(np.float64)).T for d, p in pivots.items()}
        for batch in batches:
            dims, raw = batch.column("dims").to_numpy(), batch.column("raw").to_pylist()
            cell = np.zeros(len(dims), np.int32)
            for d, mark in marks.items():
                at = np.flatnonzero(dims == d)
                for start in range(0, len(at), 1024):
                    part = at[start : start + 1024]
                    x = np.frombuffer(b"".join(raw[k] for k in part), kind).reshape(len(part), d).astype(np.float64)
                    cell[part] = (_unit(x) @ mark).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    return cells


def _digest(kind: str, vector: str):
    def digest(batches):
        from hashlib import blake2b

        for batch in batches:
            ids, raw, keys, dims = [], [], [], []
            values = batch.column(vector)
            flat, offsets, valid = values.flatten(), values.offsets.to_numpy(), values.is_valid().to_numpy(zero_copy_only=False)
            numbers, base = flat.to_numpy(zero_copy_only=False).astype(kind), offsets[0]
            lengths = values.value_lengths().to_pylist()
            at = 0
            for row, vec_id in enumerate(batch.column("vec_id").to_pylist()):
                n = (lengths[row] or 0) if valid[row] else 0
                x = numbers[at : at + n]
                at += n
                good = vec_id is not None and n > 0 and bool(np.isfinite(x).all()) and bool(x.any())
                x = x + 0.0  # one zero
                ids.append(vec_id)
                raw.append(x.tobytes() if good else None)
                keys.append(blake2b(raw[-1], digest_size=16).digest() if good else None)
                dims.append(n)
            yield pa.record_batch({"vec_id": pa.array(ids, pa.int64()), "key": pa.array(keys, pa.binary()), "raw": pa.array(raw, pa.binary()), "dims": pa.array(dims, pa.int32())})

    return digest


def _pivots(classes: DataFrame, wide: dict[int, int]) -> dict[int, bytes]:
    """Some vectors of each length in `wide` (their number), those of the smallest keys; at most `PIVOTS` of a length come here."""
    if not wide:
        return {}
    rank = F.row_number().over(Window.partitionBy("dims").orderBy("key"))
    first = classes.where(F.col("dims").isin(list(wide))).withColumn("rank", rank).where(F.col("rank") <= min(PIVOTS, max(wide.values())))
    found: dict[int, list] = {}
    for r in first.orderBy("dims", "rank").select("dims", "rank", "raw").collect():
        if r["rank"] <= wide[r["dims"]]:
            found.setdefault(r["dims"], []).append(bytes(r["raw"]))
    return {d: b"".join(v) for d, v in found.items()}


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, tile_rows: int = TILE_ROWS, group_tiles: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors` (vec_id, embedding)."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine above 0")
    spark = vectors.sparkSession
    inner = vectors.schema["embedding"].dataType.elementType
    kind = "<f4" if isinstance(inner, T.FloatType) else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding"))
    # 8 KB: 1024 doubles; a batch of 10,000 such rows is 80 MB at most for common widths.
    rows = cut(rows.mapInArrow(_digest(kind, "embedding"), "vec_id long, key binary, raw binary, dims int"), "vectors")
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"), F.first("raw").alias("raw"), F.first("dims").alias("dims"))
    classes = cut(classes, "classes")
    sizes = {r["dims"]: r["n"] for r in classes.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per vector length
    pivots = _pivots(classes, {d: min(PIVOTS, ceil(n / tile_rows)) for d, n in sizes.items() if n > tile_rows})
    form = "key binary, rep long, m long, raw binary, dims int"
    dealt = cut(classes.select("key", "rep", "m", "raw", "dims").mapInArrow(_cells(pivots, kind), form + ", cell int"), "dealt")
    # At most PIVOTS rows per vector length: each cell takes as many tiles as it fills.
    places, tiles = [], dict.fromkeys(sizes, 0)
    for r in dealt.groupBy("dims", "cell").agg(F.count(F.lit(1)).alias("n")).orderBy("dims", "cell").collect():
        places.append((r["dims"], r["cell"], tiles[r["dims"]], ceil(r["n"] / tile_rows)))
        tiles[r["dims"]] += places[-1][3]
    deal = lambda d, n: group_tiles or max(1, min(ceil(n / GROUPS), GROUP_BYTES // (tile_rows * d)))
    per = spark.createDataFrame([(d, c, first, n, deal(d, tiles[d]), ceil(tiles[d] / deal(d, tiles[d]))) for d, c, first, n in places], "dims int, cell int, first long, n long, per long, groups long")
    placed = dealt.join(F.broadcast(per), ["dims", "cell"]).withColumn("tile", F.col("first") + F.pmod(F.xxhash64("key"), F.col("n")))
    packed = placed.select("dims", "tile", "key", "rep", "m", "raw").groupBy("dims", "tile").applyInArrow(
        _pack(kind), "dims int, tile long, n int, keys binary, ids binary, m binary, q binary, scale binary, err binary, centre binary, radius double")
    packed = cut(packed, "tiles").join(F.broadcast(per.select("dims", "per", "groups").distinct()), "dims")
    copies = packed.withColumn("group", F.floor(F.col("tile") / F.col("per"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    copies = copies.withColumn("a", F.least("group", "other")).withColumn("b", F.greatest("group", "other"))
    judged = cut(copies.groupBy("dims", "a", "b").applyInArrow(_compare(threshold), "id long, key binary, n long, top long, u long, v long, side int"), "judged")
    still = judged.where("u IS NOT NULL").select("key", "u", "v", "side").join(dealt.select("key", F.col("rep").alias("id"), "dims", "m", "raw"), "key")
    confirmed = still.groupBy("dims", "u", "v").applyInArrow(_confirm(threshold, kind), "id long, n long, top long")
    found = cut(judged.where("u IS NULL").select("id", "n", "top").unionByName(confirmed), "found")
    linked = found.groupBy("id").agg(F.sum("n").alias("n"))
    parts = components(found.select(F.col("id").alias("a"), F.col("top").alias("b")))
    per_class = classes.select("key", "rep", "m").join(linked, F.col("rep") == linked["id"], "left").join(parts, F.col("rep") == parts["node"], "left")
    per_class = per_class.select("key", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("vec_id", "key").join(per_class, "key", "left")
    part = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), part.alias("component_id"), F.col("vec_id").eqNullSafe(part).alias("kept"))
