"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, kernel, materialize, signed, text_buffers
from .words import hashed_words, mix

SHINGLE = 5
LEAST = 0.8
BITS = 128
#: Blocks of a fingerprint, and bits that may differ in the nearest. One in a hundred unrelated blocks is as near.
BLOCKS, BLOCK_RADIUS = 4, 9
#: Fingerprints within this radius have a block within BLOCK_RADIUS, for if all blocks differed in more, they would in more.
#: At a similarity of 0.8 fingerprints differ in 19 bits on average, with a deviation of four.
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Window fingerprints that are compared at once.
STRIP = 1 << 12
#: Bytes of benchmark text that are sent to every task; a larger benchmark is joined by shingles instead.
SENT_BYTES = 8 << 20
#: Bits of the filter that keeps other shingles out of that join.
FILTER_BITS = 1 << 23
FOUND = "doc_id long, item_id long, start long, distance int, similarity double"


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the five-word shingles that start at each word but the last four."""
    n = len(hashes) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n]
    for k in range(1, SHINGLE):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return out


def _signs(shingle: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the BITS bits of each shingle's hash."""
    words = np.stack([mix(shingle + np.uint64(7 + k)) for k in range(BITS // 64)], axis=1)
    return np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def window_bits(shingle: np.ndarray, length: int) -> np.ndarray:
    """The fingerprint, as bits, of every run of ``length`` shingles; a shingle weighs as often as it occurs."""
    sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(_signs(shingle), axis=0, dtype=np.int32)])
    return sums[length:] > sums[:-length]


def _packed(bits: np.ndarray) -> np.ndarray:
    """Fingerprints as BLOCKS numbers each."""
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint32)


def repeating(shingle: np.ndarray, length: int) -> np.ndarray:
    """Which runs of ``length`` shingles hold one of them twice."""
    n = len(shingle)
    order = np.argsort(shingle, kind="stable")
    before = np.full(n, -1, np.int64)
    same = shingle[order[1:]] == shingle[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    # a run from s repeats if any place in it has an equal one at s or later
    reach = np.maximum.accumulate(np.concatenate([[-1], before]))
    ends = np.arange(length, n + 1)
    return reach[ends] >= ends - length


def overlaps(shingle: np.ndarray, item: np.ndarray, length: int) -> np.ndarray:
    """Shingles, with repeats, that each run of ``length`` shingles has in common with the item.

    An occurrence counts in the windows that hold fewer earlier ones than the item has.
    """
    starts = len(shingle) - length + 1
    keys, most = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(keys, shingle), len(keys) - 1)
    place = np.flatnonzero(keys[at] == shingle)
    which = at[place]
    by = np.lexsort((place, which))
    place, which = place[by], which[by]
    back = np.arange(len(place)) - most[which]  # the occurrence that many times earlier
    same = (back >= 0) & (which[np.maximum(back, 0)] == which)
    low = np.maximum(np.where(same, place[np.maximum(back, 0)] + 1, 0), place - length + 1)
    high = np.minimum(place, starts - 1)
    low = np.maximum(low, 0)
    ok = low <= high
    steps = np.bincount(low[ok], minlength=starts + 1) - np.bincount(high[ok] + 1, minlength=starts + 1)
    return np.cumsum(steps)[:starts]


class Items:
    """Benchmark items: their shingles, by shingle and by size, and the blocks of their fingerprints by size."""

    def __init__(self, rows: list[tuple[int, str]]):
        data, at = text_buffers(pa.array([text for _, text in rows], pa.large_string()))
        hashes, _, cut = hashed_words(data, at)
        self.ids, self.shingles = [], []
        for k, (item_id, _) in enumerate(rows):
            own = shingles(hashes[cut[k] : cut[k + 1]])
            if len(own):
                self.ids.append(item_id)
                self.shingles.append(own)
        sizes = [len(s) for s in self.shingles]
        flat = np.concatenate([*self.shingles, np.zeros(0, np.uint64)])
        keys, owner = flat, np.repeat(np.arange(len(sizes)), sizes)
        pairs = np.unique(np.stack([keys, owner.astype(np.uint64)], axis=1), axis=0) if len(keys) else np.zeros((0, 2), np.uint64)
        self.keys, self.owners = pairs[:, 0], pairs[:, 1].astype(np.int64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.index = {}
        for size in set(sizes):
            members = np.flatnonzero(np.array(sizes) == size)
            repeats = np.array([len(np.unique(self.shingles[k])) < size for k in members])
            self.index[size] = (members, _packed(np.concatenate([window_bits(self.shingles[k], size) for k in members])), repeats)

    def anchors(self, shingle: np.ndarray) -> np.ndarray:
        """Where the shingles are those of some item."""
        maybe = np.flatnonzero(self.seen[(shingle >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, shingle[maybe]), max(0, len(self.keys) - 1))
        return maybe[self.keys[at] == shingle[maybe]] if len(self.keys) else maybe[:0]

    def sizes_at(self, shingle: np.ndarray) -> list[tuple[int, int]]:
        """(place, item size) for every item with the shingle at that place."""
        first, last = np.searchsorted(self.keys, shingle, "left"), np.searchsorted(self.keys, shingle, "right")
        return [(k, len(self.shingles[o])) for k in range(len(shingle)) for o in self.owners[first[k] : last[k]].tolist()]

    def candidates(self, size: int, shingle: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of the runs of ``length`` shingles and the items of a size within RADIUS.

        Only pairs with a block within BLOCK_RADIUS are compared in full, which holds for all pairs
        within RADIUS. Where a shingle repeats, in the window or the item, fingerprints tell less, and
        the pair is a candidate whatever its distance.
        """
        members, theirs, repeats = self.index[size]
        mine, twice = _packed(window_bits(shingle, length)), repeating(shingle, length)
        found = []
        step = max(1, STRIP // len(members))
        for a in range(0, len(mine), step):
            own = mine[a : a + step]
            met = twice[a : a + step, None] | repeats[None]
            for k in range(BLOCKS):
                met = met | (np.bitwise_count(own[:, k, None] ^ theirs[None, :, k]) <= BLOCK_RADIUS)
            w, k = np.nonzero(met)
            distance = np.bitwise_count(own[w] ^ theirs[k]).sum(axis=1, dtype=np.int64)
            near = (distance <= RADIUS) | twice[a + w] | repeats[k]
            found.append((a + w[near], members[k[near]], distance[near]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def matches(shingle: np.ndarray, items: Items) -> dict[int, tuple[float, int, int]]:
    """item number -> (similarity, start, distance) of a document's best window for each item it contains.

    Only windows that share a shingle with an item of their size are looked at; all others have
    similarity zero to it.
    """
    anchors = items.anchors(shingle)
    if not len(anchors):
        return {}
    spans: dict[int, set[tuple[int, int]]] = {}
    for k, size in items.sizes_at(shingle[anchors]):
        p = int(anchors[k])
        length = min(size, len(shingle))
        spans.setdefault(size, set()).add((max(0, p - length + 1), min(p, len(shingle) - length)))
    best: dict[int, tuple[float, int, int]] = {}
    for size, own in spans.items():
        length = min(size, len(shingle))
        for first, last in _merged(sorted(own)):
            part = shingle[first : last + length]
            w, item, distance = items.candidates(size, part, length)
            for k in np.unique(item).tolist():
                shared = overlaps(part, items.shingles[k], length)
                at, d = w[item == k], distance[item == k]
                alike = shared[at] / (length + size - shared[at])
                top = int(np.lexsort((at, -alike))[0])
                if alike[top] >= LEAST:
                    got = (float(alike[top]), first + int(at[top]), int(d[top]))
                    held = best.get(k)
                    if held is None or (-got[0], got[1]) < (-held[0], held[1]):
                        best[k] = got
    return best


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in spans:
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _hits(texts: pa.Array, items: Items) -> Iterator[tuple[int, dict[int, tuple[float, int, int]]]]:
    """(row, its matches) for the rows that have any."""
    hashes, _, cut = hashed_words(*text_buffers(texts))
    everywhere = shingles(hashes)  # those across two texts are left out below
    hot = items.anchors(everywhere)
    for k in np.unique(np.searchsorted(cut, hot, "right") - 1).tolist():
        if found := matches(everywhere[cut[k] : max(cut[k], cut[k + 1] - SHINGLE + 1)], items):
            yield k, found


def _found(out: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()), strict=True)]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FOUND.split(", ")])


def _search(rows: list[tuple[int, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(rows)
        for batch in blocks(batches):
            ids = batch.column("doc_id")
            out = [(ids[k].as_py(), items.ids[item], start, distance, alike) for k, found in _hits(batch.column("text"), items) for item, (alike, start, distance) in sorted(found.items())]
            if out:
                yield _found(out)

    return run


def _spare(rows: list[tuple[int, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(rows)
        for batch in blocks(batches):
            stays = np.ones(batch.num_rows, bool)
            stays[[k for k, _ in _hits(batch.column("text"), items)]] = False
            yield batch.filter(pa.array(stays))

    return run


def _sent(items: DataFrame) -> list[tuple[int, str]] | None:
    """The items, if they are few enough to go to every task."""
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    return [tuple(r) for r in items.collect()] if size <= SENT_BYTES else None


def _item_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's shingles of least hash, so many that a window alike by LEAST holds one of them."""
    for batch in blocks(batches):
        hashes, _, cut = hashed_words(*text_buffers(batch.column("text")))
        everywhere = shingles(hashes)
        owner, keys = [], []
        for k in range(batch.num_rows):
            own = everywhere[cut[k] : max(cut[k], cut[k + 1] - SHINGLE + 1)]
            if len(own):
                most = np.unique(np.sort(own)[: len(own) - int(np.ceil(len(own) * LEAST - 1e-9)) + 1])
                owner += [k] * len(most)
                keys.append(most)
        yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(owner, pa.int64())), signed(np.concatenate([*keys, np.zeros(0, np.uint64)]))], ["item", "key"])


def _doc_keys(bits: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
        for batch in blocks(batches):
            hashes, _, cut = hashed_words(*text_buffers(batch.column("text")))
            everywhere = shingles(hashes)
            place = np.flatnonzero(held[(everywhere % np.uint64(FILTER_BITS)).astype(np.int64)])
            owner = np.searchsorted(cut, place, "right") - 1
            inside = place + SHINGLE <= cut[owner + 1]
            both = np.unique(np.stack([owner[inside].astype(np.uint64), everywhere[place[inside]]]), axis=1)
            own = pa.array(both[0].astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(own), batch.column("mark").take(own), signed(both[1])], ["id", "mark", "key"])

    return run


def _filter_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros(FILTER_BITS, bool)
    for batch in batches:
        held[(batch.column("key").to_numpy().view(np.uint64) % np.uint64(FILTER_BITS)).astype(np.int64)] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(held, bitorder="little").tobytes()])], ["bits"])


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        out = []
        for k, (doc_id, item_id, item) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "item_id", "item_text")), strict=True)):
            for _, found in _hits(batch.column("text").slice(k, 1), Items([(item_id, item)])):
                out += [(doc_id, item_id, start, distance, alike) for alike, start, distance in found.values()]
        if out:
            yield _found(out)


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Matches of a benchmark that is too large to be sent about: texts meet the items whose shingles they share."""
    known = items.withColumn("item", F.xxhash64("text"))
    keys = materialize(known.select("item", "text").mapInArrow(kernel(_item_keys), "item long, key long").distinct(), "items")
    held = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in keys.select("key").coalesce(8).mapInArrow(kernel(_filter_bits), "bits binary").toLocalIterator():
        held |= np.frombuffer(row["bits"], np.uint8)
    own = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("mark"))
    met = own.mapInArrow(kernel(_doc_keys(held.tobytes())), "id long, mark long, key long").join(keys, "key").select("id", "mark", "item").distinct()
    both = own.join(met, ["id", "mark"]).join(known.withColumnRenamed("text", "item_text"), "item")
    return both.select("doc_id", "text", "item_id", "item_text").mapInArrow(kernel(_one_by_one), FOUND)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, distance, similarity): items of which a document holds a near copy.

    Every window of a document with as many words as the item counts (the whole text, if that is
    shorter). Words are runs of letters and digits in lower case (A-Z); a window matches if the
    Jaccard likeness of its five-word shingles to the item's, weighted by how often they occur, is
    LEAST or more. Of each item's windows the likest is returned, of equal ones the first; start is
    its first word. Windows that share a shingle with an item of their size are compared with it by
    SimHash: those within RADIUS, found by blocks, and those in which a shingle repeats get the exact
    likeness. Items and texts under five words never match; null texts neither; null ids stay; repeated
    rows, of docs or items, repeat; no docs or no items give none; other columns are ignored.
    Items of up to SENT_BYTES in all are sent to the scan of docs, which are not shuffled; of a larger
    benchmark each item meets the texts that share one of its shingles, by a join.
    """
    texts, known = _narrowed(docs, items)
    rows = _sent(known)
    return _joined(texts, known) if rows is None else texts.mapInArrow(kernel(_search(rows)), FOUND)


def _narrowed(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    texts = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null")
    return texts, items.select(F.col("item_id").cast("long"), "text").where("text is not null")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs whose texts hold no near copy of an item; all columns stay, whatever their names.

    Rows are judged one by one, by the rule of ``contaminated``: a row goes for its own text only, never
    for another of the same doc_id or without one. Null and empty texts stay; repeated rows share their
    fate; without items, or with null ones only, all rows stay.
    """
    texts, known = _narrowed(docs, items)
    rows = _sent(known)
    if rows is not None:
        return docs.mapInArrow(kernel(_spare(rows)), docs.schema)
    marked = texts.select(F.xxhash64("text").alias("doc_id"), "text").dropDuplicates(["doc_id"])
    hit = _joined(marked, known).select(F.col("doc_id").alias("_benchmark_hit")).distinct()
    return docs.join(hit, F.xxhash64(docs["text"]) == hit["_benchmark_hit"], "left_anti")
