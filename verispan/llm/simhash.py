"""SimHash near-duplicates: bit-sliced distances inside multi-index buckets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, hex16, kernel, materialize, signed, spread, text_buffers
from .components import connected_components

#: Distinct fingerprints that a bucket may hold before it is split by further blocks.
BUCKET = 2048
RADIUS = 2
#: Blocks of the 64 bits; any two of the five may differ within the radius, so three agree.
PARTS = 5
#: Words of 64 lanes, over all shifts, whose distances are added up at once.
STRIP = 1 << 14


def fingerprint(words: list[bytes], width: int = 3) -> int:
    """SimHash of the words' shingles; zero without words."""
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    return _vote(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, len(grams)))


def _vote(hashes: np.ndarray) -> int:
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            data, at = text_buffers(batch.column("text"))
            out = np.zeros(batch.num_rows, np.uint64)
            for i in range(batch.num_rows):
                words = data[at[i] : at[i + 1]].tobytes().lower().split()
                if not words:
                    continue
                joined = b" ".join(words)
                ends = np.cumsum([len(w) + 1 for w in words]) - 1
                starts = np.concatenate([[0], ends[:-1] + 1])
                n = max(1, len(words) - width + 1)
                last = ends[width - 1 :] if len(words) >= width else ends[-1:]
                grams = [joined[a:b] for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)]
                out[i] = _vote(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, n))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), signed(out)], ["doc_id", "mark", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, mark, fp: long): one row per input row; null and wordless texts get zero.

    mark is a hash of the text, which tells rows of one doc_id apart.
    """
    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark")).mapInArrow(kernel(_fingerprints(width)), "doc_id long, mark long, fp long")


def masks(bits: int, parts: int, keep: int) -> list[int]:
    """Masks of every choice of ``keep`` blocks among ``parts`` blocks of the set bits of ``bits``."""
    places = [i for i in range(64) if bits >> i & 1]
    cut = [places[len(places) * k // parts : len(places) * (k + 1) // parts] for k in range(parts)]
    return [sum(1 << i for block in chosen for i in block) for chosen in combinations(cut, keep)]


def _long(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that join, within and across buckets, all distinct fps at RADIUS or fewer bits.

    Three of five blocks agree for such a pair, so the ten tables of three blocks hold all
    pairs. Fingerprints alone in a bucket go at once. A bucket of over BUCKET fingerprints
    is split again by three of five blocks of its other 26 bits, which leaves at most 11 free
    bits, so no bucket holds over 2,048 distinct fingerprints whatever the data. Buckets keep
    only edges of a spanning forest, never all pairs.
    """
    first = masks((1 << 64) - 1, PARTS, PARTS - RADIUS)
    second = [masks(((1 << 64) - 1) ^ m, PARTS, PARTS - RADIUS) for m in first]
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_long(m)))).alias("key")) for t, m in enumerate(first)])
    keyed = fps.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key")
    counted = keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
    finer = F.array(*[F.array(*[F.lit(_long(m)) for m in row]) for row in second])
    split = F.when(F.col("n") <= BUCKET, F.array("key")).otherwise(F.transform(F.get(finer, F.col("t")), lambda m: F.xxhash64("key", m, F.col("fp").bitwiseAND(m))))
    buckets = counted.select("fp", F.explode(split).alias("key"))
    return buckets.repartition(spread(fps), "key").sortWithinPartitions("key", "fp").mapInArrow(kernel(_within_buckets), "a long, b long")


def _within_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between fingerprints of equal keys; the rows come sorted by key."""
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        keys = np.concatenate([keys, batch.column("key").to_numpy()])
        fps = np.concatenate([fps, batch.column("fp").to_numpy()])
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
        yield from _edges(keys[:cut], fps[:cut])
        keys, fps = keys[cut:], fps[cut:]
    yield from _edges(keys, fps)


def _edges(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(keys) < 2:
        return
    left, right, _ = near_pairs(keys, fps.view(np.uint64))
    if len(left):
        root = forest(len(fps), left, right)
        child = np.flatnonzero(root != np.arange(len(fps)))
        yield pa.RecordBatch.from_arrays([pa.array(fps[child]), pa.array(fps[root[child]])], ["a", "b"])


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """Bit plane k, of the fingerprints' bit k, 64 fingerprints to a word; two words of zeros follow."""
    n, size = len(fps), fps.shape[1] * 8
    width = -(-n // 64)
    raw = np.zeros((width * 64, size), np.uint8)
    raw[:n] = np.ascontiguousarray(fps).view(np.uint8).reshape(n, size)
    bits = np.packbits(np.unpackbits(raw, axis=1, bitorder="little"), axis=0, bitorder="little")
    planes = np.zeros((size * 8, width + 2), np.uint64)
    planes[:, :width] = np.ascontiguousarray(bits.T).view("<u8")
    return planes


class _Counters:
    """Carry-save counters of a bit a lane and level, which start so that they overflow past the radius.

    Inputs wait in pairs, so that a full adder takes two at once; overflows go to ``over`` for good.
    """

    def __init__(self, over: np.ndarray, radius: int):
        levels = int(radius).bit_length()
        self.start = (1 << levels) - 1 - radius
        self.over = over
        self.sums = [np.full_like(over, np.uint64(0xFFFFFFFFFFFFFFFF) if self.start >> k & 1 else np.uint64(0)) for k in range(levels)]
        self.waiting: list[np.ndarray | None] = [None] * levels

    def add(self, bits: np.ndarray, level: int = 0) -> None:
        if level == len(self.sums):
            self.over |= bits
        elif self.waiting[level] is None:
            self.waiting[level] = bits
        else:
            other, self.waiting[level] = self.waiting[level], None
            half = self.sums[level] ^ other
            carry = self.sums[level] & other | half & bits
            self.sums[level] = half ^ bits
            self.add(carry, level + 1)

    def settle(self) -> None:
        for level, other in enumerate(self.waiting):
            if other is not None:
                self.waiting[level] = None
                carry = self.sums[level] & other
                self.sums[level] = self.sums[level] ^ other
                self.add(carry, level + 1)

    def keep(self, which: np.ndarray) -> None:
        self.over, self.sums = self.over[which], [s[which] for s in self.sums]

    def distances(self, word: np.ndarray, lane: np.ndarray) -> np.ndarray:
        total = np.full(len(word), -self.start, np.int64)
        for level, s in enumerate(self.sums):
            total += (s[word] >> lane.astype(np.uint64) & np.uint64(1)).astype(np.int64) << level
        return total


def near_pairs(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance), i < j, of pairs with one key and at most ``radius`` differing bits, bit-sliced.

    keys are sorted; fps holds one or more 64-bit words a row. For each distance between the
    partners' places the planes are compared with themselves shifted, and carry-save counters add up
    the differing bits of 64 pairs at once. Words whose lanes all exceed the radius, or belong to
    different buckets, are abandoned after every few planes.
    """
    fps = fps.reshape(len(fps), -1)
    n = len(fps)
    planes = bit_planes(fps)
    width = planes.shape[1] - 2
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(first, n))
    left_over = np.repeat(first + size, size) - np.arange(n)  # rows from here to the bucket's end
    dead, held, found = [], [], []
    for gap in range(1, int(size.max())):
        live = np.zeros(width * 64, bool)
        live[:n] = left_over > gap
        over = ~np.packbits(live, bitorder="little").view("<u8")
        words = np.flatnonzero(over != np.uint64(0xFFFFFFFFFFFFFFFF))
        dead.append(over[words])
        held.append(np.stack([words, np.full(len(words), gap)]))
        if sum(map(len, dead)) >= STRIP:
            found.append(_compared(planes, np.concatenate(dead), np.concatenate(held, axis=1), radius))
            dead, held = [], []
    if dead:
        found.append(_compared(planes, np.concatenate(dead), np.concatenate(held, axis=1), radius))
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def _compared(planes: np.ndarray, over: np.ndarray, at: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, gaps = at
    counters = _Counters(over, radius)
    every = 4 if radius < 8 else 16
    low = words + gaps // 64
    shift = (gaps % 64).astype(np.uint64)
    for k, row in enumerate(planes):
        high = row[low + 1] << np.uint64(1) << np.uint64(63) - shift  # a shift by 64 in two steps
        counters.add(row[words] ^ (row[low] >> shift | high))
        if k % every == every - 1:
            counters.settle()
            alive = counters.over != np.uint64(0xFFFFFFFFFFFFFFFF)
            if np.count_nonzero(alive) < 0.75 * len(alive):
                counters.keep(alive)
                words, gaps, low, shift = words[alive], gaps[alive], low[alive], shift[alive]
                if not len(words):
                    break
    lanes = np.unpackbits(np.ascontiguousarray(~counters.over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    w, lane = np.nonzero(lanes)
    i = words[w] * 64 + lane
    return i, i + gaps[w], counters.distances(w, lane)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes over the given pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        fresh = root.copy()
        np.minimum.at(fresh, root[left], low)
        np.minimum.at(fresh, root[right], low)
        while True:
            hop = fresh[fresh]
            if np.array_equal(hop, fresh):
                break
            fresh = hop
        if np.array_equal(fresh, root):
            return root
        root = fresh


def nearest_forest(n: int, left: np.ndarray, right: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Places of the pairs that join, nearest first, all of the n nodes that the pairs join (Boruvka's rounds)."""
    order = np.lexsort((right, left, distance))
    root, chosen = np.arange(n), []
    while True:
        a, b = root[left[order]], root[right[order]]
        order, a, b = order[a != b], a[a != b], b[a != b]
        if not len(order):
            return np.sort(np.concatenate([np.zeros(0, np.int64), *chosen]))
        first = np.full(n, len(order))
        for ends in (a, b):
            nearest = np.full(n, len(order))
            nearest[ends[::-1]] = np.arange(len(order))[::-1]  # of several, the first pair is written last
            first = np.minimum(first, nearest)
        pick = np.unique(first[first < len(order)])
        chosen.append(order[pick])
        root = forest(n, a[pick], b[pick])[root]


def _named(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, mark, fp, component_id, root) of each row."""
    prints = materialize(fingerprints(docs, width), "simhash")
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = connected_components(links(groups.select("fp")))
    rooted = groups.join(joined, groups.fp == joined.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(lowest, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of docs.

    docs needs doc_id and text; other columns are ignored, so clashing names do no harm.
    Documents whose fingerprints differ in at most RADIUS bits are linked; component_id is
    the smallest doc_id reachable. Null, empty and wordless texts have fingerprint zero and
    link like any other. Repeated rows give repeated results. A null doc_id takes part in
    links but is never the smallest unless its whole component is null. No rows give none.
    Equal fingerprints are merged first, so a group of copies counts once in the search.
    """
    return _named(docs, width).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
