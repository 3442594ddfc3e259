"""SimHash near-dedup by five-word shingles: bit-sliced distances inside min-hash buckets, then the exact likeness."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, kernel, materialize, signed, spread, text_buffers
from .components import connected_components
from .decontaminate import SHINGLE, shingles
from .simhash import near_pairs, nearest_forest
from .words import hashed_words, mix

#: Jaccard likeness from which documents are linked: 4 / 5, in whole numbers.
PART, WHOLE = 4, 5
#: Bits of a fingerprint, and how many may differ: at a likeness of 0.8 it is 19 on average, with a deviation of four to five.
BITS = 128
RADIUS = 40
#: Buckets of a document and least hashes in each key: texts alike by 0.8 share no bucket with a chance of 6e-7.
BANDS, ROWS = 20, 3
#: Buckets whose nearest pairs come first.
FIRST = 4
#: Bits that tell, for as many classes of shingles, whether a set holds an odd number of them.
PARITY = 1024
#: Fingerprints that are compared in one piece.
PIECE = 1024
#: Bytes between words, as bytes.split() has them.
UNSPACED = np.ones(256, bool)
UNSPACED[list(b" \t\n\r\x0b\x0c")] = False
_LAST = (1 << 63) - 1
_ODD = np.random.default_rng(8).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def shingle_sets(data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes in ascending order; a text of one to four words is one shingle."""
    hashes, _, cut = hashed_words(data, at, UNSPACED)
    everywhere = shingles(hashes)
    for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if z - a >= SHINGLE:
            yield np.unique(everywhere[a : z - SHINGLE + 1])
        else:
            yield reduce(lambda x, y: mix(x * np.uint64(0x9E3779B97F4A7C15) + y), np.split(hashes[a:z], z - a)) if z > a else hashes[:0]


def sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, bucket keys) of sets that aren't empty: SimHash of BITS bits, and BANDS keys of ROWS least hashes."""
    flat = np.concatenate(sets)
    size = np.array([len(s) for s in sets])
    start = np.cumsum(size) - size
    words = np.stack([mix(flat + np.uint64(7 + k)) for k in range(BITS // 64)], axis=1)
    ones = np.add.reduceat(np.unpackbits(words.view(np.uint8), axis=1, bitorder="little"), start, axis=0, dtype=np.int32)
    prints = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view("<u8")
    keys = np.zeros((len(sets), BANDS), np.uint64)
    for k, odd in enumerate(_ODD):
        keys[:, k // ROWS] = mix(keys[:, k // ROWS] * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(flat * odd, start) + np.uint64(k))
    return prints, keys


def parities(sets: list[np.ndarray]) -> list[bytes]:
    """PARITY bits of each set. No two sets differ in more of them than in elements."""
    return [np.packbits((np.bincount((s % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1).astype(np.uint8), bitorder="little").tobytes() for s in sets]


MADE = "id long, mark long, node long, low long, high long, n int, parity binary, keys array<long>"


def _made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        sets = list(shingle_sets(*text_buffers(batch.column("text"))))
        some = np.flatnonzero([len(s) > 0 for s in sets])
        node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64)
        prints, keys = np.zeros((len(sets), 2), np.uint64), np.zeros((len(some), BANDS), np.uint64)
        if len(some):
            prints[some], keys = sketches([sets[k] for k in some])
        ends = np.zeros(len(sets) + 1, np.int32)
        ends[some + 1] = BANDS
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), signed(keys.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), signed(node), signed(prints[:, 0]), signed(prints[:, 1]), pa.array([len(s) for s in sets], pa.int32()), pa.array(parities(sets), pa.binary()), lists], [c.split()[0] for c in MADE.split(", ")])


def _by_key(compare):
    """A kernel that calls ``compare`` with the columns of whole keys; the rows come sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            fresh = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
            held = fresh if held is None else [np.concatenate(x) for x in zip(held, fresh, strict=True)]
            if len(held[0]):
                cut = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on
                yield from compare([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None:
            yield from compare(held)

    return run


def _near(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a key within RADIUS, but for those whose parities differ too much for their sizes.

    Sets that are alike enough differ in at most a ninth of both sizes' sum.
    """
    key, _, low, high, n, parity = columns[:6]
    left, right, distance = near_pairs(key, np.stack([low, high], axis=1).view(np.uint64), RADIUS)
    bits = np.frombuffer(b"".join(parity), np.uint64).reshape(len(key), -1)
    keep = np.zeros(len(left), bool)
    for a in range(0, len(left), 1 << 15):
        i, j = left[a : a + (1 << 15)], right[a : a + (1 << 15)]
        keep[a : a + (1 << 15)] = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) * (PART + WHOLE) <= (n[i].astype(np.int64) + n[j]) * (WHOLE - PART)
    return left[keep], right[keep], distance[keep]


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])


def _nearest(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if len(columns[0]) > 1:
        left, right, distance = _near(columns)
        pick = nearest_forest(len(columns[0]), left, right, distance)
        yield _pairs(columns[1][left[pick]], columns[1][right[pick]])


def _apart(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if len(columns[0]) > 1:
        left, right, _ = _near(columns)
        open_ = columns[6][left] != columns[6][right]
        yield _pairs(columns[1][left[open_]], columns[1][right[open_]])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "one"):
        ones, twos = (shingle_sets(*text_buffers(batch.column(c))) for c in ("one", "two"))
        yes = [len(np.intersect1d(x, y, assume_unique=True)) * (PART + WHOLE) >= (len(x) + len(y)) * PART for x, y in zip(ones, twos, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))


def _verified(pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) whose texts' sets are alike enough, exactly."""
    side = lambda k, to: texts.select(F.col("node").alias(k), F.col("text").alias(to))
    met = pairs.distinct().join(side("a", "one"), "a").join(side("b", "two"), "b").select("a", "b", "one", "two")
    return materialize(met.mapInArrow(kernel(_alike), "a long, b long"), name)


def _met(entries: DataFrame, sketch: DataFrame, run, width: int) -> DataFrame:
    entries = entries.join(sketch, "node").select("key", "node", "low", "high", "n", "parity", *[c for c in entries.columns if c not in ("key", "node")])
    return entries.repartition(width, "key").sortWithinPartitions("key").mapInArrow(kernel(_by_key(run)), "a long, b long")


def _open(entries: DataFrame) -> DataFrame:
    """(key, node, root): pieces in which all pairs of a bucket meet that aren't in one group.

    A bucket whose entries are all of one group has none. Of others, pieces of the largest
    group meet pieces of the rest, and pieces of the rest each other: a group is never compared with itself.
    """
    counts = entries.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key")
    counts = counts.agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.max_by("root", F.struct("c", "root")).alias("main")).where("n > most")
    pieces = lambda c: F.ceil(F.col(c) / (PIECE // 2)).cast("int")
    counts = counts.withColumn("rest", F.col("n") - F.col("most")).withColumn("p", pieces("most")).withColumn("q", pieces("rest"))
    rows = entries.join(counts.select("key", "n", "main", "p", "q"), "key")
    own = F.when(F.col("root") == F.col("main"), F.pmod(F.xxhash64("node"), F.col("p").cast("long"))).otherwise(F.pmod(F.xxhash64("node"), F.col("q").cast("long"))).cast("int")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    main = F.transform(upto("q"), lambda i: F.xxhash64("key", F.lit(1), own, i))
    across = F.transform(upto("p"), lambda i: F.xxhash64("key", F.lit(1), i, own))
    among = F.transform(upto("q"), lambda i: F.xxhash64("key", F.lit(2), F.least(own, i), F.greatest(own, i)))
    rest = F.when(F.col("q") > 1, F.concat(across, among)).otherwise(across)
    keys = F.when(F.col("n") <= PIECE, F.array("key")).when(F.col("root") == F.col("main"), main).otherwise(rest)
    return rows.select(F.explode(keys).alias("key"), "node", "root")


def _grouped(docs: DataFrame) -> DataFrame:
    """(id, mark, node, root): one row per row of docs, null doc_ids last."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64("text").alias("mark"), "text")
    width = spread(docs)
    made = materialize(rows.mapInArrow(kernel(_made), MADE), "sketches")
    prints = made.select("id", "mark", "node")
    sketch = materialize(made.drop("id", "mark").dropDuplicates(["node"]), "sketches")
    keyed = sketch.select(F.posexplode("keys").alias("band", "key"), "node")
    shared = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    entries = materialize(keyed.join(shared, "key"), "buckets")
    wanted = entries.select("node").distinct()
    holders = prints.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("id", "mark")).alias("of")).select("node", "of.*")
    texts = materialize(rows.join(holders, ["id", "mark"]).select("node", "text").dropDuplicates(["node"]), "texts")
    sketch = sketch.select("node", "low", "high", "n", "parity")
    piece = F.xxhash64("key", F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("c") / PIECE)))
    first = _verified(_met(entries.where(F.col("band") < FIRST).select(piece.alias("key"), "node"), sketch, _nearest, width), texts, "nearest")
    joined = connected_components(first).select("node", F.col("root").alias("to"))
    placed = materialize(entries.join(joined, "node", "left").select("key", "node", F.coalesce("to", "node").alias("root")), "placed")
    second = _verified(_met(_open(placed), sketch, _apart, width), texts, "apart")
    groups = connected_components(first.unionByName(second))
    return prints.join(groups, "node", "left").select("id", "mark", "node", F.coalesce("root", "node").alias("root"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest doc_id.

    Documents are linked if the sets of their five-word shingles have a Jaccard likeness of 0.8 or
    more; words stand between spaces, A-Z count as a-z, and a text of one to four words is one
    shingle. Groups are the components of the links. Null, empty and wordless texts are one group.
    Candidates share a bucket and have SimHash fingerprints within RADIUS of BITS bits, found by
    bit-sliced comparison, and parities of their sets that allow it; the exact likeness decides. Buckets are keyed by least hashes of the sets,
    so a pair can be lost by chance, of about 1e-6 at a likeness of 0.8 and less above (under 1e-3
    for texts of under a dozen words, by their fingerprints). The nearest pairs of some buckets are
    tried first; then, in all buckets, all pairs that no link joins yet, none capped.
    Null doc_ids come last; of rows with the smallest doc_id one stays, by a hash of its text, whole
    repeats included. All columns stay, whatever their names; no rows give none.
    """
    stay = _grouped(docs).groupBy("root").agg(F.min(F.struct(F.col("id").alias("_shingle_id"), F.col("mark").alias("_shingle_mark"))).alias("first")).select("first.*")
    own = docs.withColumn("_shingle_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))).withColumn("_shingle_of", F.xxhash64("text"))
    kept = own.join(stay, (F.col("_shingle_key") == F.col("_shingle_id")) & (F.col("_shingle_of") == F.col("_shingle_mark")), "left_semi")
    return kept.dropDuplicates(["_shingle_key", "_shingle_of"]).select(*docs.columns)
