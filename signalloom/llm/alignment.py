"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Both tokenizers always end a token before a space that stands between two characters
other than white space: no pattern of A and no piece of B goes on over it. A text
therefore is a sequence of chunks that are encoded on their own, and each distinct chunk
is encoded and aligned once by a task (`Chunks`, of bounded size); a text without such
spaces is one chunk.

Byte ends of A's and of B's tokens are two rising sequences to be merged. Merge-path
partitioning cuts this work: on diagonals `PIECE` elements apart, a binary search finds
how many elements of each sequence come before, so that pieces of equal work are merged
independently, however unequal the texts are. A piece emits the ends that both sequences
have, and its tokens by the groups these ends close; groups that reach over the border of
pieces are stitched from the parts. A group's links are all pairs of its A and B tokens.

A first pass writes for every document its digests and its distinct id pairs with their
occurrences, packed in pieces of `PART` pairs. Counts over documents are sums of
partial counts made in the tasks. A second pass looks the `HOT_PAIRS` most common pairs up in
a broadcast table of that size at most, and hands the others to a join by shuffle.

Defined results: a text that is null or empty, or whose joined token bytes of A or B are
not the space and the text, has no tokens: zeros, an empty digest, no part in counts.
Special strings in a text are plain text. Very long texts are whole; a group of very many tokens is
taken in blocks. Rows with equal or null ids are documents of their own. Other columns
of the input are not looked at.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.common import cut, slices

#: Elements of a piece of the merge, pairs of a row, pairs of the broadcast table, and links of a group that are listed at once.
PIECE, PART, HOT_PAIRS, LISTED = 1 << 14, 1 << 16, 1 << 20, 1 << 20
#: Chunks that a worker remembers, the longest of them in characters, and the most pairs of all chunks held between batches.
REMEMBERED, SHORT, HELD_PAIRS = 600_000, 64, 1 << 23

_ALIGNED = "row long, doc_id long, first boolean, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, occurrences binary"
_RATED = "row long, doc_id long, first boolean, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rare array<struct<pair:long,n:long>>"


@dataclass(frozen=True)
class Tokenizers:
    """The files' contents; they travel to the tasks, so that executors need not reach them."""

    a: str
    b: bytes

    @staticmethod
    def read(byte_level_json: str, piece_model: str) -> Tokenizers:
        with open(byte_level_json, encoding="utf-8") as a, open(piece_model, "rb") as b:
            return Tokenizers(a.read(), b.read())

    def n_ids_b(self) -> int:
        from sentencepiece import SentencePieceProcessor

        return SentencePieceProcessor(model_proto=self.b).get_piece_size()


def _byte_characters() -> dict[str, int]:
    """Character by which byte-level vocabularies write a byte: printable ones as they are, the others from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(others)}


#: The words of byte-level vocabularies, as the pre-tokenizer of A cuts them. Fixed value.
_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Codec:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, files: Tokenizers):
        from sentencepiece import SentencePieceProcessor

        model = json.loads(files.a)["model"]
        byte = _byte_characters()
        special = {t["content"] for t in json.loads(files.a)["added_tokens"]}
        entries = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        self.encode_a = self._by_rank(entries, model["merges"]) or self._by_merges(files.a)
        self.bytes_a = [b""] * (max(model["vocab"].values()) + 1)
        for token, i in entries.items():
            self.bytes_a[i] = token
        self.b = SentencePieceProcessor(model_proto=files.b)
        self.n_b = self.b.get_piece_size()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(map(self.b.id_to_piece, range(self.n_b)))]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))

        # An id and what stands after it: in a group or as the last of its side.
        self.written = [f"{i}{after}".encode() for i in range(len(self.bytes_a)) for after in ",|"] + [f"{i}{after}".encode() for i in range(self.n_b) for after in ",;"]

    @staticmethod
    def _by_rank(entries: dict[bytes, int], merges: list):
        """Where merges stand in the order of their ids, ids are ranks; encoding by ranks is several times as fast."""
        import tiktoken

        byte = _byte_characters()
        made = [bytes(byte[c] for c in "".join(m if isinstance(m, list) else m.split(" "))) for m in merges]
        if [entries.get(m) for m in made] != list(range(len(entries) - len(made), len(entries))):
            return None
        return tiktoken.Encoding("a", pat_str=_WORDS, mergeable_ranks=entries, special_tokens={}).encode_ordinary

    @staticmethod
    def _by_merges(file: str):
        from tokenizers import Tokenizer

        a = Tokenizer.from_str(file)
        a.encode_special_tokens = True
        return lambda text: a.encode(text, add_special_tokens=False).ids

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of every chunk with a space before it."""
        return [self.encode_a(" " + c) for c in chunks], self.b.encode(chunks, num_threads=1)


_CLEAN_SPACE = re.compile(r"(?<=\S) (?=\S)")


def chunks_of(text: str) -> list[str]:
    """The text cut at each space between two characters other than white space; these spaces belong to no chunk."""
    return _CLEAN_SPACE.split(text)


def merge_path(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """How many elements of each rising sequence lie before every diagonal; equal elements: a's first.

    Diagonals are `piece` elements apart; all are searched at once.
    """
    diagonals = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (low < high).any():
        open_ = low < high
        mid = (low + high) >> 1
        before = np.zeros(len(diagonals), bool)  # a[mid] lies before the diagonal
        before[open_] = a[mid[open_]] <= b[diagonals[open_] - mid[open_] - 1]
        low, high = np.where(open_ & before, mid + 1, low), np.where(open_ & ~before, mid, high)
    return low, diagonals - low


def common_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """The elements that two strictly rising sequences share, merged piece by piece."""
    at_a, at_b = merge_path(a, b, piece)
    found = []
    for i, j, i2, j2 in zip(at_a[:-1], at_b[:-1], at_a[1:], at_b[1:], strict=True):
        mine, other = a[i:i2], b[j:j2]
        if not len(other):
            continue
        place = np.searchsorted(mine, other)
        inside = place < len(mine)
        shared = np.zeros(len(other), bool)
        shared[inside] = mine[place[inside]] == other[inside]
        if i and i <= len(a):  # the border: an end of a just before the piece whose equal is b's first
            shared[0] |= bool(a[i - 1] == other[0])
        found.append(other[shared])
    return np.concatenate(found) if found else a[:0]


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the runs that begin at `starts`, one run after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def group_pairs(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, n_ids_b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Group, pair and occurrences of all links of consecutive groups with `n_a` and `n_b` tokens, some `LISTED` at a time.

    A pair is its A id times `n_ids_b` and its B id. In a very large group ids are counted first.
    """
    start_a, start_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    links = n_a * n_b
    usual = np.flatnonzero(links <= LISTED)
    total = np.cumsum(links[usual])
    edges = np.append(np.searchsorted(total, np.arange(0, int(total[-1]) if len(total) else 0, LISTED), "left"), len(usual))
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        part = usual[low:high]
        inside = _ragged(np.zeros(len(part), np.int64), links[part])
        group, width = np.repeat(part, links[part]), np.repeat(n_b[part], links[part])
        pair = a[start_a[group] + inside // width] * n_ids_b + b[start_b[group] + inside % width]
        yield group, pair, np.ones(len(pair), np.int64)
    for g in np.flatnonzero(links > LISTED):
        ids_a, times_a = np.unique(a[start_a[g] : start_a[g] + n_a[g]], return_counts=True)
        ids_b, times_b = np.unique(b[start_b[g] : start_b[g] + n_b[g]], return_counts=True)
        step = max(1, LISTED // len(ids_b))
        for k in range(0, len(ids_a), step):
            pair = (ids_a[k : k + step, None] * n_ids_b + ids_b).ravel()
            yield np.full(len(pair), g), pair, (times_a[k : k + step, None] * times_b).ravel()


class _Numbers(dict):
    """Numbers of chunks; a new one gets the next."""

    def __init__(self, known=()):
        super().__init__(known)
        self.new: list[str] = []
        self.next = len(self)

    def __missing__(self, chunk: str) -> int:
        self.new.append(chunk)
        self[chunk] = n = self.next
        self.next += 1
        return n


class Chunks:
    """Encoded and aligned chunks, each with a number; a bounded number of short ones is remembered."""

    def __init__(self, codec: Codec):
        none = np.zeros(0, np.int64)
        self.codec, self.number = codec, _Numbers()
        self.sums = np.zeros((0, 5), np.int64)  # tokens of A and B, groups, links, 1 if joined bytes differ
        self.said: list[bytes] = []  # the groups as text
        self.pairs, self.times, self.sizes, self.hits = none, none, none, none

    def numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Numbers of the chunks of each text, new ones aligned now."""
        of = self.number.__getitem__
        out = [np.fromiter(map(of, chunks), np.int64, len(chunks)) for chunks in texts]
        new, self.number.new = self.number.new, []
        if new:
            self._add(new)
            for c in new:
                if len(c) > SHORT:
                    del self.number[c]
        self.hits = np.append(self.hits, np.zeros(len(self.said) - len(self.hits), np.int64))
        if out:
            self.hits += np.bincount(np.concatenate(out), minlength=len(self.hits))
        return out

    def forget(self) -> None:
        """Once too many are held, only short ones that came more than once stay, half of the bound at most."""
        if len(self.said) <= REMEMBERED and len(self.pairs) <= HELD_PAIRS:
            return
        short = [(c, i) for c, i in self.number.items() if self.hits[i] > 1]
        short = sorted(short, key=lambda x: -self.hits[x[1]])[: REMEMBERED // 2]
        keep = np.array([i for _, i in short], np.int64)
        starts = np.cumsum(self.sizes) - self.sizes
        at = _ragged(starts[keep], self.sizes[keep])
        self.number = _Numbers({c: k for k, (c, _) in enumerate(short)})
        self.pairs, self.times, self.sizes = self.pairs[at], self.times[at], self.sizes[keep]
        self.sums, self.said = self.sums[keep], [self.said[i] for i in keep.tolist()]
        self.hits = np.zeros(len(keep), np.int64)

    def _add(self, chunks: list[str]) -> None:
        codec = self.codec
        ids_a, ids_b = codec.encode(chunks)
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
        raw = [f" {c}".encode("utf-8", "surrogatepass") for c in chunks]
        bad = self._differ(a, n_a, codec.bytes_a, raw) | self._differ(b, n_b, codec.bytes_b, raw)
        # A chunk that either tokenizer changes has no tokens.
        a, b = a[np.repeat(~bad, n_a)], b[np.repeat(~bad, n_b)]
        n_a[bad] = n_b[bad] = 0
        ends_a, ends_b = np.cumsum(codec.size_a[a]), np.cumsum(codec.size_b[b])
        shared = common_ends(ends_a, ends_b)
        upto_a, upto_b = np.searchsorted(ends_a, shared) + 1, np.searchsorted(ends_b, shared) + 1
        in_a, in_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
        owner = np.repeat(np.arange(len(chunks)), n_a)[upto_a - 1] if len(a) else upto_a
        groups = np.bincount(owner, minlength=len(chunks))
        links = np.zeros(len(chunks), np.int64)
        np.add.at(links, owner, in_a * in_b)
        self.sums = np.concatenate([self.sums, np.stack([n_a, n_b, groups, links, bad], axis=1)])
        self.said += self._written(a, b, in_a, in_b, groups)
        keys, times = [], []
        for group, pair, n in group_pairs(a, b, in_a, in_b, codec.n_b):
            key, place = np.unique((owner[group] << 32) | pair, return_inverse=True)
            keys.append(key)
            times.append(np.bincount(place, weights=n, minlength=len(key)).astype(np.int64))
        if keys:
            key, place = np.unique(np.concatenate(keys), return_inverse=True)
            self.pairs = np.append(self.pairs, key & 0xFFFFFFFF)
            self.times = np.append(self.times, np.bincount(place, weights=np.concatenate(times), minlength=len(key)).astype(np.int64))
            self.sizes = np.append(self.sizes, np.bincount(key >> 32, minlength=len(chunks)))
        else:
            self.sizes = np.append(self.sizes, np.zeros(len(chunks), np.int64))

    @staticmethod
    def _differ(ids: np.ndarray, n: np.ndarray, spelled: list[bytes], raw: list[bytes]) -> np.ndarray:
        """Chunks whose joined token bytes are not their own."""
        said = list(map(spelled.__getitem__, ids.tolist()))
        size = np.fromiter(map(len, said), np.int64, len(said))
        ends = np.append(0, np.cumsum(size))[np.cumsum(n)]
        if ends.tolist() == np.cumsum([len(r) for r in raw]).tolist() and b"".join(said) == b"".join(raw):
            return np.zeros(len(raw), bool)
        starts = np.cumsum(n) - n
        return np.array([b"".join(said[i : i + k]) != r for i, k, r in zip(starts.tolist(), n.tolist(), raw, strict=True)], bool)

    def _written(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, groups: np.ndarray) -> list[bytes]:
        """The groups of every chunk as text, each with a semicolon after it."""
        after_a, after_b = np.cumsum(in_a), np.cumsum(in_b)
        code = np.zeros(len(a) + len(b), np.int64)  # tokens in the order of the text: twice the id, one more for a group's last
        code[np.arange(len(a)) + np.repeat(after_b - in_b, in_a)] = 2 * a
        code[np.arange(len(b)) + np.repeat(after_a, in_b)] = 2 * (b + len(self.codec.bytes_a))
        code[after_a + after_b - in_b - 1] += 1
        code[after_a + after_b - 1] += 1
        ends = np.append(0, after_a + after_b)[np.cumsum(groups)].tolist()
        said, words = code.tolist(), self.codec.written
        return [b"".join(map(words.__getitem__, said[i:k])) for i, k in zip([0, *ends[:-1]], ends, strict=True)]


def _aligner(files):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = vars(files.value)  # stays in the worker, with its chunks, for later tasks
        chunks = held.setdefault("chunks", None) or Chunks(Codec(files.value))
        held["chunks"] = chunks
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text", 2 << 20):
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            numbers = chunks.numbers([chunks_of(t) if t else [] for t in texts])
            starts = np.cumsum(chunks.sizes) - chunks.sizes
            rows = []
            for doc_id, mine in zip(ids, numbers, strict=True):
                n_a, n_b, n_groups, n_links, bad = (int(x) for x in chunks.sums[mine].sum(axis=0))
                pairs = times = np.zeros(0, np.int64)
                if bad or not n_a:
                    n_a = n_b = n_groups = n_links = 0
                    digest = ""
                else:
                    digest = sha256(b"".join(map(chunks.said.__getitem__, mine.tolist()))[:-1]).hexdigest()
                    once, often = np.unique(mine, return_counts=True)
                    at = _ragged(starts[once], chunks.sizes[once])
                    pairs, place = np.unique(chunks.pairs[at], return_inverse=True)
                    times = np.bincount(place, weights=chunks.times[at] * np.repeat(often, chunks.sizes[once]), minlength=len(pairs)).astype(np.int64)
                for k in range(0, max(1, len(pairs)), PART):
                    part = slice(k, k + PART)
                    rows.append((row, doc_id, k == 0, *((n_a, n_b, n_groups, n_links) if k == 0 else (0, 0, 0, 0)), digest if k == 0 else None,
                                 *_packed(pairs[part], times[part])))
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)
            chunks.forget()

    return align


_NAMES = [x.split()[0] for x in _ALIGNED.split(", ")]
_TYPES = [{"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in _ALIGNED.split(", ")]


def _packed(pairs: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes]:
    """Rising pairs as differences, and occurrences, in the fewest bytes of numpy's types."""
    return pairs.astype(np.uint32).tobytes(), (times.astype(np.uint8) if not len(times) or times.max() < 256 else times).tobytes()


def _unpacked(pairs: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(pairs, np.uint32).astype(np.int64)
    return found, np.frombuffer(times, np.uint8 if len(times) == len(found) else np.int64).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of the task each pair is."""
    pairs = n = np.zeros(0, np.int64)
    held, size = [], 0

    def add() -> tuple[np.ndarray, np.ndarray]:
        found, place = np.unique(np.concatenate([pairs, *held]), return_inverse=True)
        weights = np.append(n, np.ones(len(place) - len(n), np.int64))
        return found, np.bincount(place, weights=weights, minlength=len(found)).astype(np.int64)

    for batch in batches:
        for packed in batch.column("pairs").to_pylist():
            held.append(np.frombuffer(packed, np.uint32))
            size += len(held[-1])
        if size > 1 << 22:
            pairs, n = add()
            held, size = [], 0
            if len(pairs) > 1 << 22:  # handed on; equal ones meet in the shuffle
                yield pa.record_batch({"pair": pa.array(pairs), "n": pa.array(n)})
                pairs = n = np.zeros(0, np.int64)
    pairs, n = add()
    for k in range(0, len(pairs), 1 << 16):
        yield pa.record_batch({"pair": pa.array(pairs[k : k + (1 << 16)]), "n": pa.array(n[k : k + (1 << 16)])})


def _rater(hot):
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = hot.value
        for batch in batches:
            best_of, sum_of, rare = [], [], []
            for packed, times in zip(batch.column("pairs").to_pylist(), batch.column("occurrences").to_pylist(), strict=True):
                pairs, n = _unpacked(packed, times)
                place = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
                met = known[place] == pairs if len(known) else np.zeros(len(pairs), bool)
                at = place[met]
                best_of.append(int(n[met][best[at]].sum()))
                sum_of.append(int((n[met] * counts[at]).sum()))
                rare.append([{"pair": p, "n": k} for p, k in zip(pairs[~met].tolist(), n[~met].tolist(), strict=True)])
            kept = [batch.column(c) for c in _NAMES[:-2]]
            more = [pa.array(best_of, pa.int64()), pa.array(sum_of, pa.int64()), pa.array(rare, pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([*kept, *more], [*_NAMES[:-2], "n_best", "count_sum", "rare"])

    return rate


def align(docs: DataFrame, files: Tokenizers) -> DataFrame:
    """Rows of every document of `docs` (doc_id, text), written: its numbers and digest in the first, its id pairs in all."""
    sent = docs.sparkSession.sparkContext.broadcast(files)  # the two vocabulary files
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut(docs.mapInArrow(_aligner(sent), _ALIGNED), "aligned")


def pair_counts(aligned: DataFrame, n_ids_b: int) -> DataFrame:
    """pair, a, b, n (documents that hold the pair linked), best (n is the highest of the A id): the map between the vocabularies."""
    counts = aligned.select("pairs").mapInArrow(_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = counts.select("pair", F.expr(f"pair div {n_ids_b}").alias("a"), F.expr(f"pair % {n_ids_b}").alias("b"), "n")
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(highest, "a").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def rate(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    `counts`: a written table of `pair_counts`.
    """
    hot = counts.orderBy(F.col("n").desc(), "pair").limit(HOT_PAIRS).select("pair", "n", "best").toArrow().sort_by("pair")
    last = hot.column("n").to_numpy().min() if hot.num_rows else 0
    tables = tuple(hot.column(c).to_numpy() for c in ("pair", "n", "best"))
    sent = aligned.sparkSession.sparkContext.broadcast(tables)
    rated = cut(aligned.mapInArrow(_rater(sent), _RATED), "rated")
    # Only pairs that are no more common than the last one sent can be among the others.
    others = counts.where(F.col("n") <= int(last)).select("pair", F.col("n").alias("count"), "best")
    rare = rated.select("row", F.explode("rare").alias("r")).select("row", "r.pair", "r.n").join(others, "pair")
    rare = rare.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("first"), *[F.lit(0).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")],
                       F.lit(None).cast("string").alias("groups_sha256"), F.when(F.col("best"), F.col("n")).otherwise(0).alias("n_best"),
                       (F.col("n") * F.col("count")).alias("count_sum"))
    sums = [F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    out = rated.drop("rare").unionByName(rare).groupBy("row").agg(F.max("doc_id").alias("doc_id"), *sums, F.max("groups_sha256").alias("groups_sha256"))
    return out.drop("row")
