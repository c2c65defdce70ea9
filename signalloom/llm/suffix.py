"""Suffix-array dedup: bytes that repeat an earlier passage of the corpus.

A window is `LENGTH` bytes. A byte goes if a window over it also starts earlier, in a
document with a smaller id or in the same document. How equal windows meet:

1. Every window has an anchor, its `GRAM`-byte string of smallest hash (the leftmost, if
   equal), so equal windows have equal anchors at equal places. Anchors are counted by
   hash across the corpus, 8 bytes each; only those that occur twice go on.
2. A piece is what the windows of one anchor cover. Pieces are dealt by their anchor.
   An anchor with very many pieces is dealt again, its windows halved by their place
   around the anchor and keyed by all bytes the half has in common, until a window's
   whole text is its key; equal pieces of a task are one before they are dealt.
3. A task sorts the suffixes that its pieces' windows start, in two stages: those smaller
   than their successor are sorted directly, all others are induced by scanning the
   buckets of first bytes in order. Neighbours with a common prefix of `LENGTH` bytes are
   equal windows; all but the earliest go.

Equal texts are one text, that of the smallest id; the others go as a whole if they
have a window. Anchors may match by hash alone, which costs work and changes nothing;
whole texts are told apart by 64 bits of BLAKE2b.

Defined results: a null text is empty, texts shorter than a window stay. Null ids are
the largest. Rows that repeat id and text are one document; texts that share an id are
ordered by their hash. An empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.common import cut, parted, slices
from signalloom.llm.shingles import mix
from signalloom.session import scratch

LENGTH, GRAM = 100, 32
SLICE = 2 << 20
#: Anchors of a bucket in which they are counted, about.
BUCKET = 1 << 17
#: An anchor with more pieces, and with more than a millionth of all, is dealt again.
HOT, HOT_SHARE = 2000, 1_000_000
LAST = (1 << 63) - 1

_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = 0x9E3779B97F4A7C15


def _digest(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on."""
    h, size, power = _TABLE[data], 1, _ODD
    while size < GRAM:  # GRAM is a power of two
        h = h[:-size] * np.uint64(power) + h[size:]
        size, power = 2 * size, power * power % (1 << 64)
    return mix(h)


def window_anchors(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of texts written one after the other: hash, place, first and last window start of each run."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none.astype(np.uint64), none, none, none
    h = gram_hashes(data)
    value, place = (h >> np.uint64(32)).astype(np.uint32), np.arange(len(h), dtype=np.int32)
    width, size = LENGTH - GRAM + 1, 1

    def join(by: int, value: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        later = value[by:] < value[:-by]
        return np.where(later, value[by:], value[:-by]), np.where(later, place[by:], place[:-by])

    while 2 * size <= width:
        value, place = join(size, value, place)
        size *= 2
    if width > size:
        value, place = join(width - size, value, place)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    long = sizes >= LENGTH
    edge = np.zeros(len(place) + 1, np.int8)  # windows that lie within one text
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - LENGTH + 1, -1)
    valid = np.flatnonzero(np.cumsum(edge[:-1]))
    anchor = place[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(valid)) - 1
    at = anchor[first].astype(np.int64)
    return h[at], at, valid[first], valid[last]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]


def _in_order(*keys: np.ndarray) -> np.ndarray:
    return np.lexsort(keys[::-1])


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values.astype(np.int32)))


_SCAN = "doc_id long, doc long, n_bytes long, sha string, bucket int, gram binary, docs binary, ordinal binary, mark array<int>"
_SCAN_TYPES = pa.schema([("doc_id", pa.int64()), ("doc", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.string()), ("bucket", pa.int32()),
                         ("gram", pa.binary()), ("docs", pa.binary()), ("ordinal", pa.binary()), ("mark", pa.list_(pa.int32()))])


def _rows(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SCAN_TYPES], schema=_SCAN_TYPES)


def _scanner(buckets: int):
    """Per document a row; per slice and bucket the anchors; anchors that repeat within a slice."""

    def scan(batches):
        for batch in slices(batches, "text", SLICE):
            texts = _texts(batch)
            docs = [_digest(t) for t in texts]
            yield _rows(len(texts), doc_id=batch.column("doc_id"), doc=pa.array(docs, pa.int64()), n_bytes=pa.array([len(t) for t in texts], pa.int64()),
                        sha=pa.array([sha256(t).hexdigest() for t in texts], pa.string()))
            once = list(dict(zip(docs, texts, strict=True)).items())
            sizes = np.array([len(t) for _, t in once], np.int64)
            h, at, _, _ = window_anchors(np.frombuffer(b"".join(t for _, t in once), np.uint8), sizes)
            if not len(h):
                continue
            ends = np.cumsum(sizes)
            owner = np.searchsorted(ends, at, "right")
            ordinal = (np.arange(len(at)) - np.searchsorted(owner, owner, "left")).astype(np.uint32)
            doc = np.array([d for d, _ in once], np.int64)[owner]
            order = np.argsort(h, kind="stable")
            h, doc, ordinal, owner = h[order], doc[order], ordinal[order], owner[order]
            new = np.append(True, h[1:] != h[:-1])
            alone = new & np.append(new[1:], True)
            marks = np.flatnonzero(~alone)
            if len(marks):
                marks = marks[np.argsort(owner[marks], kind="stable")]
                first = np.flatnonzero(np.append(True, owner[marks][1:] != owner[marks][:-1]))
                yield _rows(len(first), doc=pa.array(doc[marks[first]]), mark=_lists(ordinal[marks], first))
            h, doc, ordinal = h[new], doc[new], ordinal[new]
            bucket = (h >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64) if buckets > 1 else np.zeros(len(h), np.int64)
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            low = h.astype(np.uint32)
            full = [b for b in range(buckets) if edges[b] < edges[b + 1]]
            blob = lambda x: pa.array([x[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary())
            yield _rows(len(full), bucket=pa.array(full, pa.int32()), gram=blob(low), docs=blob(doc), ordinal=blob(ordinal))

    return scan


def _repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by bucket: anchors that occur at two places of the corpus, a row per document."""

    def found(held: list) -> pa.RecordBatch:
        gram, doc, ordinal = (np.frombuffer(b"".join(r[k] for r in held), t) for k, t in ((0, "<u4"), (1, "<i8"), (2, "<u4")))
        order = _in_order(gram, doc, ordinal)
        gram, doc, ordinal = gram[order], doc[order], ordinal[order]
        keep = np.append(True, (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1]) | (ordinal[1:] != ordinal[:-1]))  # an equal text is no repeat
        gram, doc, ordinal = gram[keep], doc[keep], ordinal[keep]
        same = gram[1:] == gram[:-1]
        again = np.append(False, same) | np.append(same, False)
        doc, ordinal = doc[again], ordinal[again]
        order = np.argsort(doc, kind="stable")
        doc, ordinal = doc[order], ordinal[order]
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(doc[first]), _lists(ordinal, first)], ["doc", "mark"])

    held, now = [], None
    for batch in batches:
        for bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "gram", "docs", "ordinal")), strict=True):
            if bucket != now and held:
                yield found(held)
                held = []
            now = bucket
            held.append(row)
    if held:
        yield found(held)


def _pack(batches):
    import zstandard

    for batch in slices(batches, "text", SLICE):
        texts, compressor = _texts(batch), zstandard.ZstdCompressor(level=1)
        ids = [LAST if i is None else i for i in batch.column("doc_id").to_pylist()]
        yield pa.record_batch({"id": pa.array(ids, pa.int64()), "doc": pa.array([_digest(t) for t in texts], pa.int64()),
                               "packed": pa.array([compressor.compress(t) for t in texts], pa.binary())})


def _unpacked(batch: pa.RecordBatch) -> list[bytes]:
    import zstandard

    decompressor = zstandard.ZstdDecompressor()
    return [decompressor.decompress(p) for p in batch.column("packed").to_pylist()]


_PIECE = "key long, id long, doc long, at int, until int, place int, low int, high int, piece binary"
_PIECE_NAMES = [c.split()[0] for c in _PIECE.split(", ")]


def _piece_rows(key, id_, doc, at, until, place, low, high, piece) -> pa.RecordBatch:
    types = [pa.int64()] * 3 + [pa.int32()] * 5
    return pa.RecordBatch.from_arrays([*[pa.array(x, t) for x, t in zip((key, id_, doc, at, until, place, low, high), types, strict=True)], pa.array(piece, pa.binary())], _PIECE_NAMES)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the marked anchors; of equal pieces only the first, the others as runs without a piece."""
    seen: set[int] = set()
    span = LENGTH - GRAM
    for batch in slices(batches, "packed", 1 << 18):
        texts, docs, ids, marks = _unpacked(batch), batch.column("doc").to_pylist(), batch.column("id").to_pylist(), batch.column("marks").to_pylist()
        chosen = [k for k, d in enumerate(docs) if not (d in seen or seen.add(d))]  # rows that repeat id and text
        chosen.sort(key=lambda k: (ids[k], docs[k]))
        known: set[tuple[int, bytes]] = set()
        out = []
        for k in chosen:
            text = texts[k]
            h, place, first, last = window_anchors(np.frombuffer(text, np.uint8), np.array([len(text)], np.int64))
            wanted = np.unique(np.concatenate([np.asarray(m, np.int64) for m in marks[k]]))
            wanted = wanted[wanted < len(h)]
            for key, p, a, b in zip(h[wanted].view(np.int64).tolist(), place[wanted].tolist(), first[wanted].tolist(), last[wanted].tolist(), strict=True):
                piece = text[a : b + LENGTH]
                if (key, piece) in known:
                    out.append((key, ids[k], docs[k], a, b + LENGTH, p - a, 0, span, None))
                else:
                    known.add((key, piece))
                    out.append((key, ids[k], docs[k], a, b + LENGTH, p - a, 0, span, piece))
        if out:
            yield _piece_rows(*zip(*out, strict=True))


def _halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Halves of pieces, by the distance from window start to anchor; keyed by what all windows of a half share."""
    for batch in batches:
        out = []
        columns = [batch.column(c).to_pylist() for c in _PIECE_NAMES]
        known: set[tuple[int, bytes]] = set()
        for key, id_, doc, at, until, place, low, high, piece in sorted(zip(*columns, strict=True), key=lambda r: (r[1], r[2], r[3])):
            middle = (low + high) // 2
            for a, b in ((low, middle), (middle + 1, high)):
                start, stop = place - min(b, place), place - max(a, place - (len(piece) - LENGTH))  # of window starts in the piece
                if start > stop or a > b:
                    continue
                part = piece[start : stop + LENGTH]
                core = piece[place - a : place - b + LENGTH]
                new = _digest(b"%d,%d," % (a, b) + core)
                row = (new, id_, doc, at + start, at + stop + LENGTH, place - start, a, b)
                out.append((*row, None if (new, part) in known else part))
                known.add((new, part))
        if out:
            yield _piece_rows(*zip(*out, strict=True))


def suffix_order(data: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions `wanted` (true where a suffix is asked for) in the order of their first LENGTH bytes.

    Two-stage sorting. A suffix larger than its successor needs that one, so successors
    are sorted along up to the next suffix that is smaller than its own.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(LENGTH + 8, np.uint8)])
    differs = np.append(np.flatnonzero(data[1:] != data[:-1]), n - 1)
    change = differs[np.searchsorted(differs, np.arange(n))]  # the last byte of the run of equal bytes
    smaller = padded[change] < padded[change + 1]  # than its successor; the end of all data is smallest
    # Each wanted suffix, and its successors up to the first that is smaller than its own.
    stops = np.append(np.flatnonzero(smaller), n - 1)
    upto = stops[np.searchsorted(stops, np.flatnonzero(wanted))]
    reach = np.zeros(n + 1, np.int32)
    np.add.at(reach, np.flatnonzero(wanted), 1)
    np.add.at(reach, upto + 1, -1)
    used = np.cumsum(reach[:-1]) > 0
    words = _words(padded, n)

    def direct(at: np.ndarray) -> np.ndarray:
        """Sorted by LENGTH bytes, eight at a time, where still tied."""
        order = at[np.argsort(words[at], kind="stable")]
        tied = np.append(words[order][1:] == words[order][:-1], False)
        group = np.cumsum(np.append(True, ~tied[:-1])) if len(order) else order
        for depth in range(8, LENGTH, 8):
            open_ = np.flatnonzero(tied | np.append(False, tied[:-1])) if len(order) else order
            if not len(open_):
                break
            part = order[open_]
            next_ = words[np.minimum(part + depth, n + LENGTH - 1)]
            inner = np.lexsort((next_, group[open_]))
            order[open_], next_, g = part[inner], next_[inner], group[open_][inner]
            tied[open_] = np.append((g[1:] == g[:-1]) & (next_[1:] == next_[:-1]), False)
            split = np.ones(len(order), bool)
            split[1:] = ~tied[:-1]
            group = np.cumsum(split)
        return order

    sorted_ = direct(np.flatnonzero(used & smaller))
    by_byte = np.searchsorted(data[sorted_], np.arange(257))  # direct suffixes of each bucket
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    done = []
    end = np.array([n - 1]) if used[n - 1] and not smaller[n - 1] else np.zeros(0, np.int64)
    for byte in range(256):
        placed = []

        def scan(at: np.ndarray, byte: int = byte, placed: list = placed) -> np.ndarray:
            """Hands the predecessors of sorted suffixes to their buckets; returns those of this bucket."""
            placed.append(at)
            before = at[at > 0] - 1
            before = before[used[before] & ~smaller[before]]
            if not len(before):
                return before
            first = data[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            edges = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
            own = before[:0]
            for a, b in zip(edges, [*edges[1:], len(first)], strict=True):
                if first[a] == byte:
                    own = before[a:b]
                else:
                    waiting[first[a]].append(before[a:b])
            return own

        now = [end] if len(end) and data[n - 1] == byte else []
        now = np.concatenate([*now, *waiting[byte]]) if now or waiting[byte] else np.zeros(0, np.int64)
        while len(now):
            now = scan(now)
        last = sorted_[by_byte[byte] : by_byte[byte + 1]]
        if len(last):
            scan(last)
        done += placed
    order = np.concatenate(done) if done else np.zeros(0, np.int64)
    return order[wanted[order]]


def _words(padded: np.ndarray, n: int) -> np.ndarray:
    """Eight bytes from each position on, as one number in their order."""
    out = np.zeros(n + LENGTH, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(out)]
    return out


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Common prefix of each suffix of `order` with the one before it, up to `most` bytes; 0 for the first."""
    padded = np.concatenate([data, np.zeros(most + 8, np.uint8)])
    out = np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    for depth in range(most):
        a, b = order[open_] + depth, order[open_ - 1] + depth
        open_ = open_[(padded[a] == padded[b]) & (np.maximum(a, b) < len(data))]
        if not len(open_):
            break
        out[open_] += 1
    return out


def _repeats(data: np.ndarray, sizes: np.ndarray, id_: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which window starts of the pieces equal an earlier window; true per byte of `data`."""
    starts = np.cumsum(sizes) - sizes
    inside = np.arange(len(data)) - np.repeat(starts, sizes)
    wanted = inside <= np.repeat(sizes - LENGTH, sizes)
    order = suffix_order(data, wanted)
    equal = common_prefixes(data, order) >= LENGTH
    group = np.cumsum(~equal)
    owner = np.searchsorted(starts, order, "right") - 1
    rank = _in_order(group, id_[owner], doc[owner], at[owner] + inside[order])
    gone = np.zeros(len(data), bool)
    gone[order[rank]] = np.append(False, group[rank][1:] == group[rank][:-1]) if len(rank) else False
    return gone


def _sort_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over pieces sorted by key: runs of bytes to remove, per document."""

    def runs(held: list[tuple]) -> pa.RecordBatch:
        # Equal pieces of a key are one, the earliest; windows of the others are all repeats.
        held.sort(key=lambda r: (r[0], r[4], r[1], r[2], r[3]))
        again = [i > 0 and held[i][0] == held[i - 1][0] and held[i][4] == held[i - 1][4] for i in range(len(held))]
        doc, start, stop = ([r[k] for r, x in zip(held, again, strict=True) if x] for k in (2, 3, 3))
        stop = [s + len(r[4]) for s, r in zip(stop, (r for r, x in zip(held, again, strict=True) if x), strict=True)]
        one = [r for r, x in zip(held, again, strict=True) if not x]
        keys = [r[0] for r in one]
        one = [r for i, r in enumerate(one) if (i and keys[i - 1] == keys[i]) or (i + 1 < len(keys) and keys[i + 1] == keys[i])]
        if one:
            sizes = np.array([len(r[4]) for r in one], np.int64)
            id_, docs, at = (np.array([r[k] for r in one], np.int64) for k in (1, 2, 3))
            gone = _repeats(np.frombuffer(b"".join(r[4] for r in one), np.uint8), sizes, id_, docs, at)
            where = np.flatnonzero(gone)
            if len(where):
                starts = np.cumsum(sizes) - sizes
                owner = np.searchsorted(starts, where, "right") - 1
                new = np.append(True, (where[1:] != where[:-1] + 1) | (owner[1:] != owner[:-1]))
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(where)) - 1
                place = at[owner] + where - starts[owner]
                doc += docs[owner[first]].tolist()
                start += place[first].tolist()
                stop += (place[last] + LENGTH).tolist()
        return pa.record_batch({"doc": pa.array(doc, pa.int64()), "start": pa.array(start, pa.int32()), "stop": pa.array(stop, pa.int32())})

    held, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "doc", "at", "piece")), strict=True):
            if size >= SLICE and row[0] != held[-1][0]:
                yield runs(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield runs(held)


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "packed", 1 << 18):
        rows = []
        for text, found in zip(_unpacked(batch), batch.column("runs").to_pylist(), strict=True):
            edge = np.zeros(len(text) + 1, np.int32)
            np.add.at(edge, [r["start"] for r in found], 1)
            np.add.at(edge, [r["stop"] for r in found], -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            rows.append((int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), kept))
        yield pa.record_batch({"id": batch.column("id"), "doc": batch.column("doc"), "removed": pa.array([r[0] for r in rows], pa.int64()),
                               "spans": pa.array([r[1] for r in rows], pa.int64()), "kept": pa.array([r[2] for r in rows], pa.binary())})


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [None if k is None else k.decode("utf-8", "ignore") for k in batch.column("kept").to_pylist()]
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "kept": pa.array(texts, pa.string())})


def decoded(found: DataFrame) -> DataFrame:
    """doc_id, kept as text, of rows of `remove_repeats`; bytes left of a character that a passage cut are dropped."""
    return found.select("doc_id", "kept").mapInArrow(_decode, "doc_id long, kept string")


def scanned(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A row for each of `docs` (doc_id, text), the texts that are the first of their kind, and the marked anchors of these."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 << max(8, (total * 2 // (LENGTH - GRAM) // BUCKET).bit_length())
    with scratch() as scope:  # all anchors go before texts are packed
        scan = cut(docs.mapInArrow(_scanner(buckets), _SCAN), "scan")
        whole = scope.keep(scan.where("sha IS NOT NULL").select("doc_id", "doc", "n_bytes", "sha"), "whole")
        firsts = scope.keep(whole.groupBy("doc").agg(F.min(F.coalesce("doc_id", F.lit(LAST))).alias("id")), "firsts")
        anchors = scan.where("bucket IS NOT NULL").select("bucket", "gram", "docs", "ordinal").repartition("bucket").sortWithinPartitions("bucket")
        marks = scan.where("mark IS NOT NULL").select("doc", "mark").unionByName(anchors.mapInArrow(_repeat, "doc long, mark array<int>"))
        marks = scope.keep(marks.groupBy("doc").agg(F.collect_list("mark").alias("marks")).join(firsts, "doc"), "marks")
    return whole, firsts, marks


def repeated_runs(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Runs to remove from `docs` (doc_id, text) that have marked anchors."""
    packed = docs.mapInArrow(_pack, "id long, doc long, packed binary")
    rows = cut(packed.join(marks, ["doc", "id"]).mapInArrow(_pieces, _PIECE), "pieces")
    runs = rows.where("piece IS NULL").select("doc", F.col("at").alias("start"), F.col("until").alias("stop"))
    rows, ready = rows.where("piece IS NOT NULL"), None
    span = LENGTH - GRAM
    while True:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        limit = max(HOT, sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // HOT_SHARE)
        hot = cut(sizes.where(F.col("n") > limit).select("key"), "hot")  # at most HOT_SHARE keys, so fit to broadcast
        cool = rows.join(F.broadcast(hot), "key", "left_anti")
        ready = cool if ready is None else ready.unionByName(cool)
        if span == 0 or hot.isEmpty():
            break
        halves = cut(rows.join(F.broadcast(hot), "key", "left_semi").select(*_PIECE_NAMES).mapInArrow(_halve, _PIECE), "halves")
        runs = runs.unionByName(halves.where("piece IS NULL").select("doc", F.col("at").alias("start"), F.col("until").alias("stop")))
        rows, span = halves.where("piece IS NOT NULL"), span // 2
    if span == 0:
        ready = ready.unionByName(rows.join(F.broadcast(hot), "key", "left_semi"))
    dealt = ready.select("key", "id", "doc", "at", "piece").repartition("key").sortWithinPartitions("key")
    return runs.unionByName(dealt.mapInArrow(_sort_pieces, "doc long, start int, stop int"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes; null: all of the text), kept_sha256 for every row of `docs` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    whole, firsts, marks = scanned(docs)
    with scratch() as scope:  # pieces go before texts are packed again
        runs = repeated_runs(docs, marks)
        per_doc = scope.keep(runs.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("runs")).join(firsts, "doc"), "runs")
    packed = parted(docs, F.coalesce("doc_id", F.lit(LAST)), per_doc.select("id"))[0]
    packed = packed.mapInArrow(_pack, "id long, doc long, packed binary").join(per_doc, ["doc", "id"])
    shorter = packed.mapInArrow(_keep, "id long, doc long, removed long, spans long, kept binary")
    shorter = cut(shorter.withColumn("kept_sha", F.sha2("kept", 256)), "shorter").dropDuplicates(["doc", "id"]).withColumnRenamed("id", "of")
    rows = whole.select("doc_id", "doc", "n_bytes", "sha", F.coalesce("doc_id", F.lit(LAST)).alias("at"))
    rows = rows.join(firsts, "doc").withColumn("copy", (F.col("at") != F.col("id")) & (F.col("n_bytes") >= LENGTH)).drop("id")
    rows = rows.join(shorter.withColumnRenamed("doc", "of_doc"), (F.col("doc") == F.col("of_doc")) & (F.col("at") == F.col("of")), "left")
    nothing = sha256(b"").hexdigest()
    return rows.select(
        "doc_id", "n_bytes", F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copy"), F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
        F.when(F.col("copy"), nothing).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    )
