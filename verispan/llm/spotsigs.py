"""SpotSigs fingerprints: chains of content words that follow common words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, kernel, spread, text_buffers
from .words import hash_of, hashed_words, mix

#: Common words whose occurrences anchor signatures (fixed values).
ANCHORS = (
    "a an and are as at be by for from has have he in is it of on or that the this to was were which with "
    "au aux ce dans de des du elle en est et il je la le les ne pas par pour qui que se son sur un une "
    "als auch auf aus bei das dem den der des die ein eine er es für im ist mit nicht sich sie und von zu "
    "al como con del el es esta la las lo los no o para pero por que se su sus un una y"
).split()
CHAIN = 2
#: Bytes of text that a range of doc_ids should hold, and ranges at most.
RANGE_BYTES = 64 << 20
RANGES = 1 << 14
_START = np.uint64(0x5851F42D4C957F2D)
_ANCHOR = np.unique(np.array([hash_of(w) for w in ANCHORS], np.uint64))


def signatures(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts): each text's distinct 32-bit signatures, sorted, as text number << 32 | signature.

    A signature is an anchor, a common word or the text's start, with the CHAIN content words that
    follow it; at a text's end the chain is as long as there are words. So each text with words has some.
    """
    hashes, _, cut = hashed_words(data, at)
    n = len(at) - 1
    spot = np.minimum(np.searchsorted(_ANCHOR, hashes), len(_ANCHOR) - 1)
    common = _ANCHOR[spot] == hashes if len(hashes) else np.zeros(0, bool)
    content, inner = np.flatnonzero(~common), np.flatnonzero(common)
    some = np.flatnonzero(np.diff(cut))
    anchors = np.concatenate([cut[some], inner])
    owner = np.concatenate([some, np.searchsorted(cut, inner, "right") - 1])
    chain = np.concatenate([np.full(len(some), _START), hashes[inner]])
    following, last = np.searchsorted(content, anchors), np.searchsorted(content, cut[1:])[owner]
    for k in range(CHAIN):
        own = np.flatnonzero(following + k < last)
        chain[own] = mix(chain[own] * np.uint64(0x9E3779B97F4A7C15) + hashes[content[following[own] + k]])
    keys = np.unique(owner.astype(np.uint64) << np.uint64(32) | mix(chain) >> np.uint64(32))
    return keys, np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=n)


def hexed(keys: np.ndarray, counts: np.ndarray) -> list[str]:
    """Each text's signatures in ascending order, eight hex digits each."""
    blob = (keys & np.uint64(0xFFFFFFFF)).astype(">u4").tobytes().hex()
    ends = np.cumsum(counts) * 8
    return [blob[a:z] for a, z in zip((ends - counts * 8).tolist(), ends.tolist(), strict=True)]


def jaccard(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    """Text by text, the Jaccard likeness of two key lists; two empty sets are alike."""
    common = np.bincount((np.intersect1d(a, b, assume_unique=True) >> np.uint64(32)).astype(np.int64), minlength=len(sizes_a))
    total = sizes_a + sizes_b - common
    return np.where(total == 0, 1.0, common / np.maximum(total, 1))


def _buffers(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return text_buffers(pa.array(texts, pa.large_string()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_signatures, fingerprint) of each row's whole text.

    Null and wordless texts have the empty fingerprint. Equal texts have equal fingerprints.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            keys, counts = signatures(*text_buffers(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hexed(keys, counts))], ["doc_id", "n_signatures", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(kernel(run), "doc_id long, n_signatures long, fingerprint string")


def _bucket(splits: list[int]) -> Column:
    """The number of splits below ``order``, by a balanced tree of comparisons."""

    def tree(low: int, high: int) -> str:
        if low == high:
            return str(low)
        mid = (low + high) // 2
        return f"IF(`order` <= {splits[mid]}L, {tree(low, mid)}, {tree(mid + 1, high)})"

    return F.expr(tree(0, len(splits)))


def in_order(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(bucket, guest, doc_id, text): docs dealt by ranges of doc_id and sorted, each range ending
    with a guest, the first row of the next range (after the last: of the first).

    Null doc_ids come first and null texts count as empty; equal doc_ids go by text. There are
    ``buckets`` ranges or, unsaid, as many as the texts' bytes call for, RANGES at most; only split
    points and first ids reach the driver. A task streams its range, so its size costs no memory.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("order", F.coalesce("doc_id", F.lit(-(1 << 63))))
    if buckets is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = min(RANGES, max(spread(docs), -(-size // RANGE_BYTES)))
    splits = sorted({int(x) for x in rows.where("doc_id is not null").stat.approxQuantile("doc_id", [k / buckets for k in range(1, buckets)], 0.1 / buckets)}) if buckets > 1 else []
    placed = rows.withColumn("bucket", _bucket(splits))
    firsts = sorted((r["bucket"], r["first"]) for r in placed.groupBy("bucket").agg(F.min("order").alias("first")).collect())
    hosts = [(first, firsts[k - 1][0]) for k, (_, first) in enumerate(firsts)]
    guests = docs.sparkSession.createDataFrame(hosts, "least long, host int")
    heads = placed.where(F.col("order").isin([first for first, _ in hosts])).groupBy("order", "doc_id").agg(F.min("text").alias("text"))
    heads = heads.join(F.broadcast(guests), heads.order == guests.least).select(F.col("host").alias("bucket"), F.lit(1).alias("guest"), "order", "doc_id", "text")
    dealt = placed.select("bucket", F.lit(0).alias("guest"), "order", "doc_id", "text").unionByName(heads)
    return dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "guest", "order", "text").select("bucket", "guest", "doc_id", "text")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in OUT.split(", ")]
    ids: list = []
    texts: list[str] = []
    size = 0

    def flush() -> pa.RecordBatch:
        """Results of all held rows but the last, which follows the others."""
        n = len(texts) - 1
        keys, counts = signatures(*_buffers(texts))
        own = keys[: int(counts[:-1].sum())]
        later = keys[int(counts[0]) :] - np.uint64(1 << 32)
        edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts[:-1], texts[1:], strict=True)]
        edited_keys, edited_counts = signatures(*_buffers(edited))
        arrays = [
            pa.array(ids[:n], pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array(hexed(own, counts[:-1])),
            pa.array(hexed(edited_keys, edited_counts)),
            pa.array(jaccard(own, edited_keys, counts[:-1], edited_counts)),
            pa.array(jaccard(own, later, counts[:-1], counts[1:])),
        ]
        return pa.RecordBatch.from_arrays(arrays, names)

    for batch in blocks(batches):
        for guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("guest", "doc_id", "text")), strict=True):
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
            if guest or size > 1 << 21:
                if len(texts) > 1:
                    yield flush()
                ids, texts = ([], []) if guest else ([doc_id], [text])
                size = 0 if guest else len(text)


def compared(docs: DataFrame) -> DataFrame:
    """One row per row of docs: its fingerprint, and how alike those of its edited text and of the next document are.

    The edited text's last half comes from the document that follows by doc_id (after the last:
    the first). docs needs doc_id and text; other columns are ignored. One shuffle deals the texts
    by ranges of doc_id; a task streams its range in order. Rows of one doc_id follow each other by
    text; a lone row follows itself; no rows give none. Likeness is the Jaccard likeness of the sets
    of signatures that the fingerprints spell; two empty sets are alike.
    """
    return in_order(docs).mapInArrow(kernel(_compared), OUT)


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, likeness) between fingerprints with a Jaccard likeness of at least ``least``, a < b.

    Equal fingerprints count once; ``fingerprints`` says which documents hold them. Sets are
    partitioned by length: a pair's smaller set holds at least ``least`` of the larger, so a
    set meets only the sets of its own and neighbouring length ranges. Within those, a pair must
    share one of the rarest signatures of each (prefix filter), found by a join, and the exact
    likeness decides. The empty fingerprint has no partner. No pair is lost or capped.
    """
    sets = fingerprints(docs).where("n_signatures > 0").groupBy("fingerprint", "n_signatures").agg(F.count("*").alias("copies"))
    sets = sets.withColumn("sigs", F.regexp_extract_all("fingerprint", F.lit("(.{8})"), F.lit(1)))
    sigs = sets.select("fingerprint", "n_signatures", F.explode("sigs").alias("sig"))
    counts = sigs.groupBy("sig").agg(F.count("*").alias("spread"))
    ranked = sigs.join(counts, "sig").groupBy("fingerprint", "n_signatures").agg(F.array_sort(F.collect_list(F.struct("spread", "sig"))).alias("rare"))
    prefix = ranked.withColumn("rare", F.slice("rare", 1, (F.col("n_signatures") - F.ceil(F.col("n_signatures") * least - 1e-9) + 1).cast("int")))
    band = F.floor(F.log(F.col("n_signatures").cast("double")) / -float(np.log(least))).cast("int")
    keyed = prefix.withColumn("band", band).select("fingerprint", "n_signatures", "band", F.explode("rare.sig").alias("sig"))
    left = keyed.select(F.col("fingerprint").alias("a"), F.col("n_signatures").alias("na"), "sig", F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    right = keyed.select(F.col("fingerprint").alias("b"), F.col("n_signatures").alias("nb"), "sig", "band")
    fits = (F.col("na") >= F.col("nb") * least) & ((F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    found = left.join(right, ["sig", "band"]).where(fits).select("a", "b").distinct()
    split = lambda c: F.regexp_extract_all(c, F.lit("(.{8})"), F.lit(1))
    shared = F.size(F.array_intersect(split("a"), split("b")))
    likeness = shared / (F.length("a") / 8 + F.length("b") / 8 - shared)
    return found.withColumn("likeness", likeness).where(F.col("likeness") >= least).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")
