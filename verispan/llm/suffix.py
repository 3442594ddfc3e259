"""Exact substring dedup: suffix arrays of shards, common prefixes, and a merge across shards.

Two lengths count at once: strings of SPAN bytes, which are removed where they repeat, and of
LEAST bytes, whose repeats are only reported. Every place where LEAST bytes begin is led to one
shard by their content: its anchor is the leftmost of their GRAM-byte grams with the least hash.
Equal strings, of either length, have equal anchors, so strings need comparing only with strings of
the same anchor. The strings of one anchor occurrence begin side by side and make a region.

1. Anchors. A scan lists each document's regions: anchor, digest of the region, place.
2. Anchors that occur once hold no repeat. Where all regions of an anchor are equal, all of
   their strings repeat. Of the others, one region for each digest goes on.
3. Shards. Regions are shuffled by anchor, anchors with over CROWD regions by a salt too. Each
   shard builds a suffix array by Larsson-Sadakane refinement and finds repeats by common prefixes.
4. Merge. Strings of salted anchors that stayed single in their shard are searched in the sorted
   strings of the other shards.
5. Runs of repeats go back to all places of their regions and are cut out of the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, blocks, drop_path, kernel, materialize, pack, signed, spread, stored, text_buffers, unpack

SPAN = 400
#: Repeats of this many bytes, some fifty words, are reported.
LEAST = 272
LEVELS = (LEAST, SPAN)
GRAM = 32
#: Bytes to which all suffixes of a shard are sorted, before those at strings' beginnings go on.
STEP = 64
WINDOW = LEAST - GRAM + 1
#: Strings of a single text that are anchored at once.
SEGMENT = 1 << 22
#: Bytes of regions that one suffix array covers (its arrays then fit a core's cache), and regions of an anchor that one shard gets.
SHARD_BYTES = 1 << 17
CROWD = 2048
#: Strings of salted anchors that one task of the merge should hold.
MERGED = 1 << 20
#: No byte of UTF-8.
SEPARATOR = b"\xff"
_NOBODY = -(1 << 63)
_PLACE = np.uint64((1 << 24) - 1)


def _loads(data: np.ndarray, order: str) -> np.ndarray:
    """The eight bytes from each place on as a number; zeros follow the data."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), f"{order}u8", buffer=padded, strides=(1,)).astype(np.uint64)


def _grams(data: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM-byte grams at each place that has one."""
    x = _loads(data, "<")
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    n = len(data) - GRAM + 1
    h = x[:n] * np.uint64(0xD6E8FEB86659FD93)
    h += x[8 : 8 + n] * np.uint64(0xA0761D6478BD642F)
    h += x[16 : 16 + n] * np.uint64(0xE7037ED1A0B428DB)
    h += x[24 : 24 + n] * np.uint64(0x8EBC6AF09C88C6E3)
    h ^= h >> np.uint64(31)
    return h * np.uint64(0x9E3779B97F4A7C15)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimums of all runs of ``width`` values, by prefix and suffix minimums of blocks."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def regions(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, text, first, strings): the texts' regions; in a region ``strings`` strings of LEAST
    bytes begin one after the other at byte ``first`` of data, all with one anchor."""
    found = [[], [], [], []]
    total = len(data) - LEAST + 1
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at)) if total > 0 else None
    for low in range(0, max(0, total), SEGMENT):
        high = min(low + SEGMENT, total)
        h = _grams(data[low : high + LEAST - 1])
        least = _sliding_min(h & ~_PLACE | np.arange(len(h), dtype=np.uint64), WINDOW)
        anchor = (least & _PLACE).astype(np.int64)
        inside = np.flatnonzero(owner[low:high] == owner[low + LEAST - 1 : high + LEAST - 1])
        if not len(inside):
            continue
        begin = np.concatenate([[True], (np.diff(inside) != 1) | (np.diff(anchor[inside]) != 0)])
        first = inside[begin]
        for out, values in zip(found, (h[anchor[first]], owner[low + first], low + first, np.diff(np.append(np.flatnonzero(begin), len(inside)))), strict=True):
            out.append(values)
    kinds = (np.uint64, np.int64, np.int64, np.int64)
    return tuple(np.concatenate([np.zeros(0, k), *f]).astype(k) for f, k in zip(found, kinds, strict=True))


OCCURRENCES = "anchor long, digest long, id long, mark long, first int, strings int, size int"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Regions with the digest of their bytes, which go on to the end of their last string of SPAN bytes or of the text."""
    for batch in blocks(batches):
        data, at = text_buffers(batch.column("text"))
        anchor, text, first, strings = regions(data, at)
        end = np.minimum(first + strings - 1 + SPAN, at[text + 1])
        raw = memoryview(np.ascontiguousarray(data))
        digests = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:z]) for a, z in zip(first.tolist(), end.tolist(), strict=True)), np.uint64, len(first))
        columns = [signed(anchor), signed(digests), *[batch.column(c).take(pa.array(text)) for c in ("id", "mark")]]
        columns += [pa.array(x.astype(np.int32)) for x in (first - at[text], strings, end - first)]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in OCCURRENCES.split(", ")])


def suffix_array(text: np.ndarray, depth: int = SPAN, only: np.ndarray | None = None) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes or more, by Larsson-Sadakane refinement.

    Suffixes are grouped by their first eight bytes; each round sorts those of unsorted groups by
    the group of the suffix h bytes further on, and doubles h. Groups of one are done. If only the
    suffixes at some places are wanted, doubling ends at STEP bytes, and only those go on, by the
    groups of the suffixes STEP, 2 * STEP, ... bytes further on.
    """
    head = _loads(text, ">")
    n = len(text)
    order = np.argsort(head)
    ordered = head[order]
    starts = np.concatenate([[True], ordered[1:] != ordered[:-1]])[:n]
    rank = np.zeros(n + depth, np.int64)  # a place behind the text ranks first
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0)) + 1
    h = 8
    open_ = np.flatnonzero(~(starts & np.append(starts[1:], True)))
    while len(open_) and h < (depth if only is None else STEP):
        at = order[open_]
        open_, at, ranks = _refined(open_, at, rank[at], rank[at + h])
        order[open_[0]] = at
        rank[at] = ranks
        open_ = open_[1]
        h *= 2
    if only is None:
        return order
    order = only[np.argsort(rank[only])]
    own = rank[order]
    starts = np.concatenate([[True], own[1:] != own[:-1]])[: len(order)]
    group = np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0)) + 1
    open_ = np.flatnonzero(~(starts & np.append(starts[1:], True)))
    while len(open_) and h < depth:
        at = order[open_]
        open_, at, ranks = _refined(open_, at, group[open_], rank[at + h])
        order[open_[0]] = at
        group[open_[0]] = ranks
        open_ = open_[1]
        h += STEP
    return order


def _refined(open_: np.ndarray, at: np.ndarray, group: np.ndarray, further: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """((places, those still open), suffixes, groups): the suffixes of unsorted groups, sorted by ``further`` within each."""
    keys = group << 32 | further
    by = np.argsort(keys)
    keys = keys[by]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    alone = new & np.append(new[1:], True)
    return (open_, open_[~alone]), at[by], np.maximum.accumulate(np.where(new, open_, 0)) + 1


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int | None = None) -> np.ndarray:
    """For each suffix in ``order``, by place, the bytes in common with the one before it there (Kasai).

    A suffix that follows, in the text, one whose neighbour is followed by its own neighbour has one
    byte less in common; only the other suffixes are compared, eight bytes at a time, up to ``most`` bytes.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    held = np.zeros(n, bool)
    held[order] = True
    carries = np.zeros(n, bool)
    prior = before[:-1]
    carries[1:] = (prior >= 0) & (before[1:] == prior + 1) & (text[:-1] == text[np.maximum(prior, 0)])
    place = np.flatnonzero(held & ~carries)
    head = np.concatenate([_loads(text, ">"), np.zeros(1, np.uint64)])
    length = np.zeros(len(place), np.int64)
    live = np.flatnonzero(before[place] >= 0)
    step = 0
    while len(live) and (most is None or step < most):
        p, q = place[live] + step, before[place[live]] + step
        room = np.maximum(n - np.maximum(p, q), 0)
        same = np.minimum(_equal_bytes(head[np.minimum(p, n)] ^ head[np.minimum(q, n)]), room)
        length[live] += same
        live = live[same == 8]
        step += 8
    last = np.maximum.accumulate(np.where(carries, 0, np.arange(n)))
    out = np.zeros(n, np.int64)
    out[order] = length[np.searchsorted(place, last[order])] - (order - last[order])
    return out


def _equal_bytes(differs: np.ndarray) -> np.ndarray:
    """The leading bytes that are zero in each number."""
    same = np.zeros(len(differs), np.int64)
    for bits in (32, 16, 8):
        zero = differs < np.uint64(1 << (64 - bits))
        same += zero * (bits // 8)
        differs = np.where(zero, differs << np.uint64(bits), differs)
    return same + (differs == 0)


def string_groups(order: np.ndarray, prefixes: np.ndarray, is_start: np.ndarray, span: int) -> np.ndarray:
    """For each place, a number that equal strings of ``span`` bytes share; -1 where none starts."""
    out = np.full(len(prefixes), -1, np.int64)
    out[order] = np.cumsum(prefixes[order] < span)
    out[~is_start] = -1
    return out


WANTED = "anchor long, salt int, salts int, digest long, strings int, region binary"
FOUND = "route long, anchor long, digest long, level int, a int, z int, strings binary"
RUNS = "anchor long, digest long, level int, a int, z int"


def _cut_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        data, at = text_buffers(batch.column("text"))
        raw = data.tobytes()
        each, owner = _flat(batch.column("wanted"))
        low = at[owner] + each["first"]
        regions_ = [raw[a:z] for a, z in zip(low.tolist(), (low + each["size"]).tolist(), strict=True)]
        salts = each["salts"]
        columns = [pa.array(each["anchor"]), pa.array((each["digest"] % salts).astype(np.int32)), pa.array(salts), pa.array(each["digest"]), pa.array(each["strings"]), binary_column(regions_)]
        whole = pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in WANTED.split(", ")])
        for k in range(0, whole.num_rows, 2000):
            yield whole.slice(k, 2000)


def _flat(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The fields of a column of lists of structs, all rows' one after the other, and the row of each; null lists are empty."""
    held = column.flatten()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    fields = {held.type.field(k).name: pc.struct_field(held, [k]).to_numpy(zero_copy_only=False) for k in range(held.type.num_fields)}
    return fields, np.repeat(np.arange(len(column)), size)


def _shards(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            columns = [batch.column(c.split()[0]).to_pylist() for c in WANTED.split(", ")]
            for row in zip(*columns, strict=True):
                if size > SHARD_BYTES and row[:2] != held[-1][:2]:  # an anchor's share stays together
                    yield from _shard(held, buckets)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield from _shard(held, buckets)

    return run


def _shard(rows: list[tuple], buckets: int) -> Iterator[pa.RecordBatch]:
    """Runs of repeated strings; and of salted anchors all distinct strings, sorted, a blob for each bucket of digests."""
    text = np.frombuffer(b"".join(r[5] + SEPARATOR for r in rows), np.uint8)
    size = np.array([len(r[5]) for r in rows])
    low = np.cumsum(size + 1) - size - 1
    owner = np.repeat(np.arange(len(rows)), size + 1)
    place = np.arange(len(text)) - low[owner]
    begins = place < np.array([r[4] for r in rows])[owner]
    order = suffix_array(text, SPAN, np.flatnonzero(begins))
    prefixes = common_prefixes(text, order, int(size.max()) + 8)
    kinds = np.array([(r[0], r[3]) for r in rows], np.int64)
    salts = np.array([r[2] for r in rows])
    for level, span in enumerate(LEVELS):
        group = string_groups(order, prefixes, begins & (size[owner] - place >= span), span)
        starts = np.flatnonzero(group >= 0)
        if not len(starts):
            continue
        _, first, inverse, count = np.unique(group[starts], return_index=True, return_inverse=True, return_counts=True)
        flags = np.zeros(len(text) + 2, np.int8)
        flags[starts[count[inverse] > 1] + 1] = 1
        edges = np.diff(flags)
        rises, falls = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1
        at = owner[rises]
        if len(rises):
            yield _found(kinds[at, 1] ^ rises | np.int64(_NOBODY), kinds[at], level, rises - low[at], falls - low[at], [None] * len(rises))
        salted = (salts > 1)[owner[starts[first]]]
        if salted.any():
            yield from _sorted_strings(text, starts[first][salted], (count > 1)[salted], owner, low, kinds, level, buckets)


def _sorted_strings(text: np.ndarray, places: np.ndarray, twice: np.ndarray, owner: np.ndarray, low: np.ndarray, kinds: np.ndarray, level: int, buckets: int) -> Iterator[pa.RecordBatch]:
    raw, span = memoryview(text), LEVELS[level]
    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[p : p + span]) for p in places.tolist()), "<u8").reshape(-1, 2)
    bucket = (digests[:, 0] % np.uint64(buckets)).astype(np.int64)
    for b in np.unique(bucket).tolist():
        own = np.flatnonzero(bucket == b)
        own = own[np.lexsort((digests[own, 1], digests[own, 0]))]
        of, table = np.unique(owner[places[own]], return_inverse=True)
        offset = places[own] - low[owner[places[own]]]
        blob = pack(digests[own], table.astype("<u4"), offset.astype("<u4"), twice[own].astype(np.uint8), kinds[of])
        yield _found(np.array([b * len(LEVELS) + level]), np.zeros((1, 2), np.int64), level, np.zeros(1), np.zeros(1), [blob])


def _found(route: np.ndarray, kinds: np.ndarray, level: int, a: np.ndarray, z: np.ndarray, blobs: list) -> pa.RecordBatch:
    columns = [pa.array(route.astype(np.int64)), *[pa.array(np.ascontiguousarray(kinds[:, k])) for k in range(2)], pa.array(np.full(len(route), level, np.int32))]
    columns += [pa.array(a.astype(np.int32)), pa.array(z.astype(np.int32)), pa.array(blobs, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FOUND.split(", ")])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs as they come; of the single strings of a bucket of digests, those that another shard has too."""
    names = [c.split()[0] for c in RUNS.split(", ")]
    bucket, blobs = None, []
    for batch in batches:
        runs = batch.filter(pc.is_null(batch.column("strings"))).select(names)
        if runs.num_rows:
            yield runs
        for route, level, blob in zip(*(batch.column(c).to_pylist() for c in ("route", "level", "strings")), strict=True):
            if blob is None:
                continue
            if (route, level) != bucket and blobs:
                yield from _settled(blobs, bucket[1])
                blobs = []
            bucket = route, level
            blobs.append(blob)
    if blobs:
        yield from _settled(blobs, bucket[1])


def _settled(blobs: list[bytes], level: int) -> Iterator[pa.RecordBatch]:
    """Single strings found, by binary search in all shards' sorted strings, more than once."""
    shards = [unpack(b) for b in blobs]
    kind = np.dtype([("x", "<u8"), ("y", "<u8")])
    each = [np.frombuffer(s[0], kind) for s in shards]
    merged = np.sort(np.concatenate(each), order=("x", "y"))
    for keys, (_, table, offset, twice, kinds) in zip(each, shards, strict=True):
        single = np.flatnonzero(np.frombuffer(twice, np.uint8) == 0)
        own = keys[single]
        hit = single[np.searchsorted(merged, own, "right") - np.searchsorted(merged, own, "left") > 1]
        if len(hit):
            at = np.frombuffer(offset, "<u4")[hit].astype(np.int32)
            of = np.frombuffer(kinds, np.int64).reshape(-1, 2)[np.frombuffer(table, "<u4")[hit]]
            columns = [pa.array(np.ascontiguousarray(of[:, k])) for k in range(2)] + [pa.array(np.full(len(hit), level, np.int32)), pa.array(at), pa.array(at)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RUNS.split(", ")])


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, n_repeated long, kept binary"


def _covered(low: np.ndarray, high: np.ndarray, size: int) -> np.ndarray:
    steps = np.bincount(low, minlength=size + 1) - np.bincount(high, minlength=size + 1)
    return np.cumsum(steps[:size]) > 0


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        data, at = text_buffers(batch.column("text"))
        each, owner = _flat(batch.column("repeats"))
        low, high, level = at[owner] + each["low"], at[owner] + each["high"], each["level"] > 0
        repeated, gone = _covered(low, high, len(data)), _covered(low[level], high[level], len(data))
        rises = gone.copy()
        rises[1:] &= ~gone[:-1]
        edges = at[:-1][at[:-1] < at[-1]]
        rises[edges] = gone[edges]  # a run never goes on from one text into the next
        within = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at])
        left = data[~gone].tobytes()
        cut = np.concatenate([[0], np.cumsum(np.diff(at) - within(gone))]).tolist()
        kept = [left[a:z] for a, z in zip(cut[:-1], cut[1:], strict=True)]
        columns = [batch.column("doc_id"), pa.array(np.diff(at)), *[pa.array(within(x)) for x in (gone, rises, repeated)], binary_column(kept)]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in OUT.split(", ")])


def _runs_of(rows: DataFrame) -> DataFrame:
    """(id, mark, low, high, level) of regions all of whose strings repeat."""
    last = F.least(F.col("strings"), F.col("size") - (SPAN - 1))
    both = F.array(
        F.struct((F.col("first") + F.col("strings") + (LEAST - 1)).alias("high"), F.lit(0).alias("level"), F.col("strings").alias("n")),
        F.struct((F.col("first") + last + (SPAN - 1)).alias("high"), F.lit(1).alias("level"), last.alias("n")),
    )
    return rows.select("id", "mark", F.col("first").alias("low"), F.inline(both)).where("n > 0").drop("n")


def _runs(texts: DataFrame, kinds: DataFrame, crowd: DataFrame) -> DataFrame:
    """Runs of repeated strings in the regions of ``kinds``, by shards and their merge."""
    salted = crowd.where("salts > 1").agg(F.sum("all")).first()[0] or 0
    wanted = kinds.join(crowd.select("anchor", "salts"), "anchor").groupBy("id", "mark").agg(F.collect_list(F.struct("anchor", "salts", "digest", "first", "strings", "size")).alias("wanted"))
    cut = texts.join(wanted, ["id", "mark"]).dropDuplicates(["id", "mark"]).select("doc_id", "text", "wanted").mapInArrow(kernel(_cut_regions), WANTED)
    width = spread(texts)
    buckets = max(width, -(-salted // MERGED))
    shards = cut.repartition(width, "anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(kernel(_shards(buckets)), FOUND)
    return materialize(shards.repartition(buckets, "route").sortWithinPartitions("route").mapInArrow(kernel(_merge), RUNS), "runs")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, n_repeated, kept): each row's UTF-8 bytes without repeated strings.

    A byte goes if it is in a string of SPAN bytes that starts anywhere else too, in the same text
    or another; all strings are judged on the texts as they come. kept holds the other bytes, and
    n_spans counts the runs cut out. n_repeated counts the bytes in strings of LEAST bytes that start
    elsewhere too, kept or not. docs needs doc_id and text; other columns are ignored. Null texts
    count as empty, shorter texts stay whole, matches never cross texts. Repeated rows repeat each
    other, null doc_ids are rows like others, and no rows give none.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NOBODY))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("id"), F.xxhash64("text").alias("mark"), "text")
    places, path = stored(texts.where(F.octet_length("text") >= LEAST).select("id", "mark", "text").mapInArrow(kernel(_occurrences), OCCURRENCES), "places")
    met = places.groupBy("anchor").agg(F.count("*").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    # written, so that adaptive execution can split the join where an anchor is hot
    met = materialize(met.where("n > 1").select("anchor", (F.col("low") == F.col("high")).alias("equal")), "anchors")
    again = materialize(places.join(met, "anchor"), "repeats")
    drop_path(spark, path)
    whole = again.where("equal")
    # equal rows count as often as they occur, but their places go on once
    mixed = again.where("not equal").groupBy("anchor", "digest", "id", "mark", "first", "strings", "size").agg(F.count("*").alias("times"))
    mixed = materialize(mixed, "mixed")
    kinds = mixed.groupBy("anchor", "digest").agg(F.sum("times").alias("n"), F.min(F.struct("id", "mark", "first", "strings", "size")).alias("one"))
    kinds = materialize(kinds.select("anchor", "digest", "n", "one.*"), "kinds")
    crowd = materialize(kinds.groupBy("anchor").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("salts"), F.sum("strings").alias("all")), "crowd")
    runs = _runs(texts, kinds, crowd)
    some = mixed.select("id", "mark", "anchor", "digest", "first").join(runs, ["anchor", "digest"])
    span = F.when(F.col("level") == 0, LEAST).otherwise(SPAN)
    some = some.select("id", "mark", (F.col("first") + F.col("a")).alias("low"), (F.col("first") + F.col("z") + span).alias("high"), "level")
    copied = mixed.join(kinds.where("n > 1").select("anchor", "digest"), ["anchor", "digest"], "left_semi")
    repeats = _runs_of(whole).unionByName(_runs_of(copied)).unionByName(some)
    repeats = repeats.groupBy("id", "mark").agg(F.collect_set(F.struct("low", "high", "level")).alias("repeats"))
    return texts.join(repeats, ["id", "mark"], "left").select("doc_id", "text", "repeats").mapInArrow(kernel(_cut_out), OUT)
