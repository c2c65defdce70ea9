"""MinHash near-dedup by an LSH forest.

Every distinct shingle set has `HASHES` minimum hashes. Tree t orders the sets by the
hashes from number t * HASHES / TREES on, after HASHES / TREES of them by the others in an
order of its own, so sets with a long common prefix are neighbours. A region is all sets
with one prefix; it is `DEPTHS[0]` hashes long, and where more than `REGION` sets share it
the next longer one is taken, region by region. Sets whose longer prefix few others share
are put together, half a region of one parent at a time, and one set of the large region
stands in all regions out of it; so no set leaves a region unpaired. Sets equal in all
hashes are dealt to parts, tree by tree in another way. A region is one task's work.

Within a region, hash agreement estimates similarity. Sets propose their `BEST` partners
by estimate (four standard deviations below the threshold at least) as far as these are
not connected yet; the pairs are confirmed on the full shingle sets, and confirmed links
make connected components. In regions that have partners of later rank in other
components, one task then counts the common shingles of all of them exactly, block by
block, and returns a spanning forest of the links it finds. So large groups of copies
never become their pairs, and no partner is cut off.

Recall: sets of similarity s meet in a region with 1 - (1 - s^3)^16, or 0.99999 at 0.8;
in regions that had to go deeper it is less for a single pair, while large groups of
near copies stay one component, as every tree puts them together in another way.

Defined results: null or empty texts have no shingles and link with nothing. Equal sets
are one node. Rows without an id link with nothing, component null, kept. Rows that
repeat an id are documents of their own with one id. An empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.llm.common import cut, parted, slices
from signalloom.llm.components import components
from signalloom.llm.shingles import min_hashes, shingle_sets
from signalloom.session import scratch

HASHES, TREES = 128, 16
DEPTHS = (3, 4, 6, 8, 12, 16, 32, 64, 128)
REGION = 8192
#: Partners that a set proposes; a first round takes one, in a quarter of the trees.
BEST = 4
#: Rows and shingles of a block in which common shingles are counted.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 2048


def _node(shingles: np.ndarray) -> int:
    return int.from_bytes(blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _signer(size: int):
    def sign(batches):
        for batch in slices(batches, "text"):
            value, counts = shingle_sets(batch.column("text").to_pylist(), size)
            ends = np.cumsum(counts)
            nodes = [_node(value[e - c : e]) if c else None for e, c in zip(ends, counts, strict=True)]
            found = min_hashes(value, counts, HASHES)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_shingles": pa.array(counts), "node": pa.array(nodes, pa.int64()),
                                   "hashes": pa.array([h.tobytes() if c else None for h, c in zip(found, counts, strict=True)], pa.binary()),
                                   "low": pa.array([h.tobytes() if c else None for h, c in zip(found.astype(np.uint8), counts, strict=True)], pa.binary())})

    return sign


def _setter(size: int):
    def make(batches):
        for batch in slices(batches, "text", 2 << 20):
            value, counts = shingle_sets(batch.column("text").to_pylist(), size)
            ends = np.cumsum(counts)
            wanted, nodes, shingles = batch.column("node").to_pylist(), [], []
            for node, e, c in zip(wanted, ends, counts, strict=True):
                if c and _node(value[e - c : e]) == node:  # an id may stand for another text as well
                    nodes.append(node)
                    shingles.append(value[e - c : e].view(np.int64))
            yield pa.record_batch({"node": pa.array(nodes, pa.int64()), "shingles": pa.array(shingles, pa.list_(pa.int64()))})

    return make


def _order() -> np.ndarray:
    """The hashes by which each tree orders the sets: its own, which no other tree starts with, then all others in an order of its own."""
    own = HASHES // TREES
    rest = [(t * own + own + np.random.default_rng(t).permutation(HASHES - own)) % HASHES for t in range(TREES)]
    return np.hstack([np.arange(HASHES).reshape(TREES, own), np.stack(rest)])


ORDER = _order()


def _prefixes(depth: int):
    """(node, hashes) to a row per tree: node, tree, prefix."""

    def prefixes(batches):
        trees = np.arange(TREES)
        for batch in batches:
            found = np.frombuffer(b"".join(batch.column("hashes").to_pylist()), np.uint32).reshape(-1, HASHES)
            key = _prefix(found, np.broadcast_to(trees, (len(found), TREES)), depth)
            yield pa.record_batch({"node": pa.array(np.repeat(batch.column("node").to_numpy(), TREES)), "tree": pa.array(np.tile(trees, len(found)).astype(np.int32)), "prefix": pa.array(key.ravel())})

    return prefixes


def _prefix(hashes: np.ndarray, trees: np.ndarray, depth: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.full(trees.shape, depth, np.uint64)
        for k in range(depth):
            key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.take_along_axis(hashes, ORDER[trees, k], axis=1)
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return key.view(np.int64)


def _deeper(depth: int):
    """Adds the longer prefix `child` to rows with hashes."""

    def deeper(batches):
        for batch in batches:
            found = np.frombuffer(b"".join(batch.column("hashes").to_pylist()), np.uint32).reshape(-1, HASHES)
            child = _prefix(found, batch.column("tree").to_numpy().astype(np.int64)[:, None], depth)
            yield pa.record_batch({c: batch.column(c) for c in ("node", "tree", "prefix", "guide")} | {"child": pa.array(child.ravel())})

    return deeper


def regions(signed: DataFrame, most: int = REGION) -> DataFrame:
    """node, tree, prefix of all regions; prefixes are as long as the region needs.

    Where a region is too large, its sets go on by longer prefixes. Those of which only few
    share the longer prefix are put together, some `most` / 2 of one parent, so no set is
    left alone. All regions out of one large region also hold its `guide`, one of its sets.
    """
    form = "node long, tree int, prefix long"
    rows = cut(signed.select("node", "hashes").mapInArrow(_prefixes(DEPTHS[0]), form), "prefixes")
    sizes = cut(rows.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("guide")).where("n > 1"), "sizes")
    done = rows.join(sizes.where(F.col("n") <= most), ["tree", "prefix"]).select("node", "tree", "prefix")
    large = sizes.where(F.col("n") > most)
    if large.isEmpty():
        return done
    rows, pieces = rows.join(large.drop("n"), ["tree", "prefix"]), []
    for depth in DEPTHS[1:]:
        deeper = rows.join(signed.select("node", "hashes"), "node").select("node", "tree", "prefix", "guide", "hashes").mapInArrow(_deeper(depth), form + ", guide long, child long")
        deeper = cut(deeper, "prefixes")
        sizes = cut(deeper.groupBy("tree", "prefix", "child").agg(F.count(F.lit(1)).alias("n")), "sizes")
        few = F.col("n") <= max(1, most // 32)
        heaps = cut(sizes.where(few).groupBy("tree", "prefix").agg(F.ceil(F.sum("n") / max(1, most // 2)).alias("heaps")), "heaps")
        many = cut(sizes.where(~few), "many")
        found = deeper.join(many, ["tree", "prefix", "child"], "left")
        heap = found.where("n IS NULL").join(heaps, ["tree", "prefix"]).withColumn("prefix", F.xxhash64("prefix", F.lit(depth), F.pmod("child", "heaps")))
        alone = found.where(F.col("n") <= most).withColumn("prefix", F.col("child"))
        pieces += [x.select("node", "tree", "prefix", "guide") for x in (heap, alone)]
        rows = found.where(F.col("n") > most).select("node", "tree", F.col("child").alias("prefix"), "guide")
        if many.where(F.col("n") > most).isEmpty():
            break
    else:
        # Equal in all hashes and still too many: dealt to parts, tree by tree in another way.
        parts = many.where(F.col("n") > most).select("tree", F.col("child").alias("prefix"), F.ceil(F.col("n") / max(1, most // 2)).alias("parts"))
        dealt = rows.join(parts, ["tree", "prefix"]).withColumn("prefix", F.xxhash64("prefix", F.pmod(F.xxhash64("tree", "node"), "parts")))
        pieces.append(dealt.select("node", "tree", "prefix", "guide"))
    split = pieces[0]
    for piece in pieces[1:]:
        split = split.unionByName(piece)
    split = cut(split, "split")
    guides = split.select(F.col("guide").alias("node"), "tree", "prefix").distinct()
    split = split.select("node", "tree", "prefix")
    guides = guides.join(split, ["node", "tree", "prefix"], "left_anti")
    return done.unionByName(split).unionByName(guides)


def _agreement(low8: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """Equal hashes of the sets `mine` with all sets; 0 with itself."""
    agree = np.zeros((len(mine), len(low8)), np.uint8)
    for k in range(low8.shape[1]):
        agree += low8[mine, k][:, None] == low8[:, k][None, :]
    agree[np.arange(len(mine)), mine] = 0
    return agree


def _propose(part: np.ndarray, low8: np.ndarray, best: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a region, the second among the best of the first and in another part; and who has such partners of later rank, or is one."""
    a, b, late = [], [], np.zeros(len(part), bool)
    step = max(1, (1 << 20) // len(part))
    for at in range(0, len(part), step):
        mine = np.arange(at, min(len(part), at + step))
        agree = _agreement(low8, mine)
        near = agree >= least
        apart = part[mine][:, None] != part[None, :]
        for r in np.flatnonzero((near & apart).any(axis=1)):
            found = np.flatnonzero(near[r])
            found = found[np.argsort(-agree[r][found].astype(np.int64), kind="stable")]
            other = part[found] != part[mine[r]]
            chosen = found[:best][other[:best]]
            a.append(np.full(len(chosen), mine[r]))
            b.append(chosen)
            later = found[best:][other[best:]]
            if len(later):
                late[later] = late[mine[r]] = True
    none = np.zeros(0, np.int64)
    return np.concatenate(a) if a else none, np.concatenate(b) if b else none, late


class _Regions:
    """Takes rows sorted by region and hands on whole regions."""

    def __init__(self, columns: tuple[str, ...]):
        self.columns, self.held = columns, []

    def whole(self, batches):
        """(tree, prefix, rows by column) of every region."""
        now = None
        for batch in batches:
            tree, prefix = batch.column("tree").to_numpy(), batch.column("prefix").to_numpy()
            if not len(tree):
                continue
            rows = [batch.column(c) for c in self.columns]
            edges = [0, *(np.flatnonzero((tree[1:] != tree[:-1]) | (prefix[1:] != prefix[:-1])) + 1).tolist(), len(tree)]
            for start, stop in zip(edges, edges[1:], strict=False):
                key = (int(tree[start]), int(prefix[start]))
                if key != now and self.held:
                    yield *now, self._joined()
                now = key
                self.held.append([c.slice(start, stop - start) for c in rows])
        if self.held:
            yield *now, self._joined()

    def _joined(self) -> list[pa.Array]:
        held, self.held = self.held, []
        return [pa.concat_arrays(c) if len(c) > 1 else c[0] for c in zip(*held, strict=True)]


def _low8(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _proposer(best: int, least: int):
    """Pairs to confirm (a, b), and the sets that have more partners (a, b null), of every region."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (np.int64, np.int64, bool, np.int32, np.int64)
        a, b, pair, tree, prefix = (np.concatenate(c) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, t) for t in types)
        return pa.record_batch({"a": pa.array(a), "b": pa.array(b, mask=~pair), "tree": pa.array(tree, pa.int32()), "prefix": pa.array(prefix)})

    def propose(batches):
        rows: list[tuple] = []
        for tree, prefix, (node, part, low) in _Regions(("node", "part", "low")).whole(batches):
            node, part, low8 = node.to_numpy(), part.to_numpy(), _low8(low)
            if len(node) == 2:  # the usual region, without the matrices
                close = part[0] != part[1] and (low8[0] == low8[1]).sum() >= least
                a, b, late = (np.array([0]), np.array([1]), np.zeros(2, bool)) if close else (np.zeros(0, int), np.zeros(0, int), np.zeros(2, bool))
            else:
                a, b, late = _propose(part, low8, best, least)
            late = node[late]
            n, m = len(a), len(late)
            if n + m:
                rows.append((np.append(np.minimum(node[a], node[b]), late), np.append(np.maximum(node[a], node[b]), late * 0),
                             np.append(np.ones(n, bool), np.zeros(m, bool)), np.full(n + m, tree, np.int32), np.full(n + m, prefix)))
            if len(rows) >= 10_000:
                yield batch(rows)
                rows = []
        yield batch(rows)

    return propose


def common_counts(sets: list[np.ndarray]):
    """Blocks of rows, and the number of shingles that each has in common with every set."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, number, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[number] > 1
    renumber = np.cumsum(times > 1) - 1
    number, owner = renumber[number[shared]], owner[shared]
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    n_shared = int((times > 1).sum())
    edges = np.searchsorted(number, np.arange(0, n_shared + BLOCK_SHINGLES, BLOCK_SHINGLES))
    for at in range(0, len(sets), BLOCK_ROWS):
        mine = np.arange(at, min(len(sets), at + BLOCK_ROWS))
        common = np.zeros((len(mine), len(sets)), np.float32)
        for k in range(len(edges) - 1):
            part = slice(edges[k], edges[k + 1])
            has = np.zeros((len(sets), BLOCK_SHINGLES), np.float32)
            has[owner[part], number[part] - k * BLOCK_SHINGLES] = 1
            common += has[mine] @ has.T
        yield mine, common


def _closer(least: int, percent: int):
    """A spanning forest of the links between different parts of every region, confirmed on the sets."""

    def close(batches):
        for _, _, (node, part, low, shingles) in _Regions(("node", "part", "low", "shingles")).whole(batches):
            node, part, low8 = node.to_numpy(), part.to_numpy(), _low8(low)
            sets = [np.asarray(s) for s in shingles.to_numpy(zero_copy_only=False)]
            sizes = np.array([len(s) for s in sets])
            _, label = np.unique(part, return_inverse=True)
            ends = []
            for mine, common in common_counts(sets):
                linked = 100 * common >= percent * (sizes[mine][:, None] + sizes[None, :] - common)
                linked &= (label[mine][:, None] != label[None, :]) & (_agreement(low8, mine) >= least)
                i, j = np.nonzero(linked)
                # One link for each pair of parts is enough to connect them.
                _, first = np.unique(label[mine[i]] * (label.max() + 1) + label[j], return_index=True)
                ends.append((mine[i[first]], j[first]))
            i, j = (np.concatenate(c) for c in zip(*ends, strict=True))
            if len(i):
                top = np.arange(label.max() + 1)
                kept = []
                for k, (x, y) in enumerate(zip(label[i].tolist(), label[j].tolist(), strict=True)):
                    while top[x] != x:
                        x = top[x]
                    while top[y] != y:
                        y = top[y]
                    if x != y:
                        top[max(x, y)] = min(x, y)
                        kept.append(k)
                yield pa.record_batch({"a": pa.array(node[i[kept]]), "b": pa.array(node[j[kept]])})

    return close


def _confirm(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose full sets reach the similarity."""
    one, two = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    both = pairs.join(one, "a").join(two, "b")
    common: Column = F.size(F.array_intersect("of_a", "of_b"))
    percent = round(similarity * 100)
    return both.where(common * 100 >= (F.size("of_a") + F.size("of_b") - common) * percent).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, region: int = REGION) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut(docs.mapInArrow(_signer(size), "doc_id long, n_shingles long, node long, hashes binary, low binary"), "signed")
    nodes = signed.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.first("hashes").alias("hashes"), F.first("low").alias("low"))
    nodes = cut(nodes, "nodes")
    with scratch() as scope:
        open_rows = scope.keep(regions(nodes, region), "regions")
    needed = open_rows.select("node").distinct().join(nodes.select("node", "least"), "node").select(F.col("least").alias("doc_id"), "node").distinct()
    needed = cut(needed, "needed")
    # Texts without partners are most of all; they are not shuffled.
    texts = parted(docs, F.col("doc_id"), needed.select("doc_id"))[0].join(needed, "doc_id").select("node", "text")
    sets = cut(texts.mapInArrow(_setter(size), "node long, shingles array<long>"), "sets")
    low = nodes.select("node", "low")
    spread = (similarity * (1 - similarity) / HASHES) ** 0.5
    least = int(HASHES * max(0.0, similarity - 4 * spread))

    def with_parts(rows: DataFrame, parts: DataFrame) -> DataFrame:
        """Rows of regions that hold more than one part."""
        rows = rows.join(parts.withColumnRenamed("component", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
        split = rows.groupBy("tree", "prefix").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").drop("p", "q")
        return rows.join(split, ["tree", "prefix"]).join(low, "node").select("node", "tree", "prefix", "part", "low")

    def by_region(rows: DataFrame) -> DataFrame:
        return rows.repartition("tree", "prefix").sortWithinPartitions("tree", "prefix")

    def proposed(rows: DataFrame, best: int) -> DataFrame:
        return cut(by_region(rows).mapInArrow(_proposer(best, least), "a long, b long, tree int, prefix long"), "proposed")

    def confirmed(found: DataFrame) -> DataFrame:
        return cut(_confirm(found.where("b IS NOT NULL").select("a", "b").distinct(), sets, similarity), "confirmed")

    first = open_rows.where(F.col("tree") % 4 == 0).withColumn("part", F.col("node")).join(low, "node").select("node", "tree", "prefix", "part", "low")
    links = confirmed(proposed(first, 1))
    parts = cut(components(links), "parts")
    found = proposed(with_parts(open_rows, parts), BEST)
    links = links.unionByName(confirmed(found))
    parts = cut(components(links), "parts")
    late = with_parts(found.where("b IS NULL").select(F.col("a").alias("node"), "tree", "prefix"), parts)
    if not late.isEmpty():
        closed = by_region(late.join(sets, "node")).mapInArrow(_closer(least, round(similarity * 100)), "a long, b long")
        parts = components(links.unionByName(cut(closed, "closed")))
    return _answer(signed, nodes, parts)


def _answer(signed: DataFrame, nodes: DataFrame, parts: DataFrame) -> DataFrame:
    named = nodes.select("node", "least").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    tops = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(tops, "component").select("node", "component_id")
    out = signed.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    part = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", part.alias("component_id"), F.col("doc_id").eqNullSafe(part).alias("kept"))
