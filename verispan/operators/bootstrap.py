"""Response-cluster bootstrap: portable draws, replicates of AUCs, intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import is_finite
from .splits import in_total_order

#: Draws that one SHA-256 gives.
WORDS = 8
#: Replicates of a task at most, and (replicate, row) cells that it computes at once.
BLOCK = 63
CELLS = 1 << 19
#: Rows of a chunk of sorted rows, and parts that they are joined and sorted in.
RANGE_ROWS = 2048
RANGES = 96
#: Bytes of a task's drawn weights, words hashed at once, and rows of a batch that draws give.
WEIGHT_BYTES = 1 << 27
DRAWN = 1 << 17
OUT_ROWS = 1 << 16
#: Tasks that blocks of replicates are dealt to; given, so that they are not joined for being small.
TASKS = 64


def scope_seed(seed: int, scope: str) -> int:
    """The first eight bytes of SHA-256 of seed:scope as a little-endian number."""
    return int.from_bytes(hashlib.sha256(f"{seed}:{scope}".encode()).digest()[:8], "little")


def scope_seeds(seed: int, scope: Column) -> Column:
    """The same as a column, in decimal digits."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), scope), 256)
    return F.conv(F.concat(*[F.substring(digest, k, 2) for k in range(15, 0, -2)]), 16, 10)


def draws(clusters: DataFrame, by: list[str], replicates: int, seed: int, scope: Column) -> DataFrame:
    """(by..., rep, cluster_idx, w): how often each cluster is drawn in each replicate.

    clusters: by..., n_clusters, one row a group. Draw k of a replicate is word k % 8 of the SHA-256 of
    the scope's seed, replicate and k // 8, modulo the number of clusters, so any engine can repeat it, in any order.
    A task draws whole replicates, one after the other, so nothing but the replicates' numbers is shuffled, and
    a task holds one replicate's counts.
    """
    reps = clusters.select(*by, F.col("n_clusters").cast("long").alias("_size"), scope_seeds(seed, scope).alias("_seed"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    dealt = reps.where("_size > 0").repartitionById(TASKS, F.pmod("rep", F.lit(TASKS)).cast("int"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields if f.name in by)
    rows = OUT_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (size, own, rep) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("_size", "_seed", "rep")], strict=True)):
                counts = drawn_counts(own, rep, size)
                found = np.flatnonzero(counts)
                for low in range(0, len(found), rows):
                    at = found[low : low + rows]
                    one = pa.array(np.full(len(at), k))
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).take(one) for c in (*by, "rep")], pa.array(at), pa.array(counts[at].astype(np.int64))], [*by, "rep", "cluster_idx", "w"])

    return dealt.select(*by, "rep", "_size", "_seed").mapInArrow(run, f"{fields}, rep int, cluster_idx bigint, w bigint")


def _words(seed: int | str, rep: int, count: int) -> Iterator[np.ndarray]:
    """The first ``count`` words of a replicate, a bounded number at once."""
    head = f"{seed}:{rep}:".encode()
    for low in range(0, count, DRAWN):
        digests = b"".join([hashlib.sha256(b"%b%d" % (head, k)).digest() for k in range(low // WORDS, -(-min(count, low + DRAWN) // WORDS))])
        yield np.frombuffer(digests, ">u4")[: count - low].astype(np.int64)


def drawn(seed: int, scope: str, rep: int, count: int) -> np.ndarray:
    """The clusters that ``draws`` draws for a replicate, in order."""
    return np.concatenate([np.zeros(0, np.int64), *[words % count for words in _words(scope_seed(seed, scope), rep, count)]])


def drawn_counts(seed: int | str, rep: int, count: int) -> np.ndarray:
    """How often each cluster is drawn for a replicate; seed: the scope's."""
    counts = np.zeros(count, np.int32)
    for words in _words(seed, rep, count):
        np.add.at(counts, words % count, np.int32(1))
    return counts


def cluster_index(tokens: DataFrame, by: list[str], response: str) -> DataFrame:
    """(by..., response, cluster_idx, n_clusters): numbers from 0 in the order of response ids, without one task sorting a group."""
    numbered = in_total_order(tokens.select(*by, response).distinct(), [F.col(c) for c in (*by, response)], "_number")
    firsts = numbered.groupBy(*[F.col(c).alias(f"_of_{c}") for c in by]).agg(F.min("_number").alias("_first"), F.count("*").alias("n_clusters"))
    joined = numbered.join(firsts, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]))
    return joined.select(*by, response, (F.col("_number") - F.col("_first")).cast("bigint").alias("cluster_idx"), "n_clusters")


def interval(values: DataFrame, by: list[str], value: str, confidence: float = 0.95) -> DataFrame:
    """(by..., ci_low, ci_high, valid): the percentile interval, linear between values; nulls don't count."""
    tail = (1 - confidence) / 2
    both = F.percentile(value, F.array(F.lit(tail), F.lit(1 - tail)))
    return values.groupBy(*by).agg(both.alias("_ci"), F.count(value).alias("valid")).select(*by, F.col("_ci")[0].alias("ci_low"), F.col("_ci")[1].alias("ci_high"), "valid")


def intervals(values: DataFrame, named: dict[str, str], confidence: float) -> DataFrame:
    """(scope, and for each value its limits and count), as ``interval`` has them; ``named`` has the counts' names."""
    tail = (1 - confidence) / 2
    both = {v: F.percentile(v, F.array(F.lit(tail), F.lit(1 - tail))) for v in named}
    found = values.groupBy("scope").agg(*[both[v].alias(v) for v in named], *[F.count(v).alias(n) for v, n in named.items()])
    return found.select("scope", *[c for v, n in named.items() for c in (F.col(v)[0].alias(f"{v}_ci_low"), F.col(v)[1].alias(f"{v}_ci_high"), F.col(n))])


def bootstrap_auc(tokens: DataFrame, by: str, response: str, replicates: int, seed: int, label: str = "label", score: str = "score") -> DataFrame:
    """(by, rep, auc): the weighted AUC of each replicate of response clusters; ``by`` is also the scope of the draws."""
    index = cluster_index(tokens, [by], response)
    rows = tokens.select(by, response, label, score).repartition(RANGES, by, response).join(index, [by, response]).select(F.lit("").alias("kind"), F.col(by).alias("scope"), "cluster_idx", "n_clusters", F.col(label).alias("label"), F.col(score).alias("score"))
    return replicated_auc(rows, replicates, seed).select(F.col("scope").alias(by), "rep", "auc")


CHUNKS = "kind string, scope string, n_clusters bigint, first double, first_y int, last double, last_y int, codes binary, counts binary"


def replicated_auc(rows: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(kind, scope, rep, auc) of each replicate; rows: kind, scope, cluster_idx, n_clusters, label, score.

    The kinds of a scope share its draws. Rows with a null label or a score that isn't finite don't
    count; a replicate with one class has a null auc. Rows are sorted by score, by ranges, negatives
    first where scores are equal, and packed in chunks of four bytes a row; rows of one cluster, score and
    class are one with a count. Each block of replicates of a scope gets all its chunks in order: a task draws the
    block once, holds its weights of a byte each, at most WEIGHT_BYTES, and one batch of chunks, and adds up positives,
    negatives and wins while they go by. So hashes grow with clusters times replicates, cells with rows times
    replicates, and nothing is drawn twice.
    """
    finite = F.col("score").cast("double") + F.lit(0.0)  # no -0.0
    kept = rows.where(F.col("label").isNotNull()).select("kind", "scope", "n_clusters", finite.alias("_s"), (F.col("label") == 1).cast("int").alias("_y"), "cluster_idx").where(is_finite("_s"))
    order = ["scope", "kind", "_s", "_y", "cluster_idx"]
    size, cells = RANGE_ROWS, CELLS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, size):
                yield _packed(batch.slice(low, size))

    chunks = kept.repartitionByRange(RANGES, *order).sortWithinPartitions(*order).mapInArrow(pack, CHUNKS)
    reps = F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(F.lit(WEIGHT_BYTES) / F.col("n_clusters")))).cast("int")
    dealt = chunks.withColumn("reps", reps).withColumn("block", F.explode(F.sequence(F.lit(0), F.ceil(F.lit(replicates) / F.col("reps")).cast("int") - 1)))
    dealt = dealt.repartitionById(TASKS, F.pmod(F.pmod(F.hash("scope"), F.lit(TASKS)) + F.col("block"), F.lit(TASKS)).cast("int")).sortWithinPartitions("scope", "block", "kind", "first", "first_y", "last", "last_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn_of = weights = sums = None
        for batch in batches:
            names = ("kind", "scope", "n_clusters", "first", "last", "reps", "block")
            for k, (kind, scope, count, first, last, step, block) in enumerate(zip(*[batch.column(c).to_pylist() for c in names], strict=True)):
                if sums is not None and sums.of != (scope, block, kind):
                    yield sums.result()
                    sums = None
                if drawn_of != (scope, block):
                    weights = None  # before the next are made
                    low = block * step
                    weights, drawn_of = _drawn_weights(scope_seed(seed, scope), range(low, min(replicates, low + step)), count), (scope, block)
                if sums is None:
                    sums = _Sums((scope, block, kind), weights, block * step, cells)
                sums.add(first, last, *[batch.column(c)[k].as_buffer() for c in ("codes", "counts")])
        if sums is not None:
            yield sums.result()

    return dealt.select("kind", "scope", "n_clusters", "first", "last", "reps", "block", "codes", "counts").mapInArrow(run, "kind string, scope string, rep int, auc double")


def _packed(rows: pa.RecordBatch) -> pa.RecordBatch:
    """A chunk for each kind and scope of sorted rows: cluster * 4 + 2 where a score begins + class, and counts where any is over 1."""
    scope, kind = rows.column("scope"), rows.column("kind")
    score, y, cluster = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("_s", "_y", "cluster_idx"))
    of = np.ones(rows.num_rows, bool)
    of[1:] = pc.or_(pc.not_equal(scope[1:], scope[:-1]), pc.not_equal(kind[1:], kind[:-1])).to_numpy(zero_copy_only=False)
    begins = of.copy()
    begins[1:] |= score[1:] != score[:-1]
    new = begins.copy()
    new[1:] |= (y[1:] != y[:-1]) | (cluster[1:] != cluster[:-1])
    kept = np.flatnonzero(new)
    counts = np.diff(np.append(kept, len(new)))
    codes = cluster[kept] * 4 + begins[kept] * 2 + y[kept]
    edges = [*np.flatnonzero(of[kept]).tolist(), len(kept)]
    sizes, found = rows.column("n_clusters").to_pylist(), []
    for low, high in zip(edges, edges[1:], strict=False):
        first, last = kept[low], kept[high - 1]
        many = counts[low:high]
        code = codes[low:high].astype("<u4" if sizes[first] < 1 << 30 else "<u8")
        found.append((kind[first].as_py(), scope[first].as_py(), sizes[first], score[first], y[first], score[last], y[last], code.tobytes(), many.astype("<u4").tobytes() if many.max() > 1 else b""))
    types = [pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.int32(), pa.binary(), pa.binary()]
    names = [f.split()[0] for f in CHUNKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)


def _drawn_weights(seed: int, reps: range, count: int) -> np.ndarray:
    """(replicates, clusters): how often each cluster is drawn, a byte each."""
    weights = np.empty((len(reps), count), np.uint8)
    for k, rep in enumerate(reps):
        counts = drawn_counts(seed, rep, count)
        if counts.max() > 255:
            raise OverflowError(f"a cluster was drawn {counts.max()} times in a replicate")
        weights[k] = counts
    return weights


class _Sums:
    """Positives, negatives and wins of a block of replicates over chunks in the order of scores."""

    def __init__(self, of: tuple, weights: np.ndarray, first_rep: int, cells: int) -> None:
        self.of, self.weights, self.first_rep, self.cells = of, weights, first_rep, cells
        #: ``open``: negatives so far of the score that the last chunk ended with.
        self.p, self.n, self.u, self.open = (np.zeros(len(weights)) for _ in range(4))
        self.last = None

    def add(self, first: float, last: float, codes: pa.Buffer, counts: pa.Buffer) -> None:
        code = np.frombuffer(codes, "<u4" if self.weights.shape[1] < 1 << 30 else "<u8")
        cluster, y, begins = (code >> 2).astype(np.intp), (code & 1).astype(bool), (code & 2) > 0
        many = np.frombuffer(counts, "<u4").astype(np.float64) if counts.size else None
        goes_on = first == self.last
        begins[0] = not goes_on
        cut = begins.copy()
        cut[0] = True
        cut[1:] |= y[1:] != y[:-1]
        edge = np.flatnonzero(cut)
        positive = np.flatnonzero(y[edge])
        tied = positive[(positive > 0) & ~begins[edge[positive]]]  # the segment before has the same score's negatives
        step = max(1, self.cells // len(code))
        for low in range(0, len(self.weights), step):
            at = slice(low, low + step)
            w = self.weights[at].take(cluster, axis=1)
            w = w * many if many is not None else w
            sums = np.add.reduceat(w, edge, axis=1, dtype=np.float64) if len(edge) < len(code) else w.astype(np.float64)
            own = sums[:, positive]
            sums[:, positive] = 0
            below = np.cumsum(sums, axis=1) + self.n[at, None]
            if goes_on:
                sums[:, 0] += self.open[at]
            sums[:, tied] = sums[:, tied - 1]
            self.u[at] += (own * (below[:, positive] - sums[:, positive] / 2)).sum(axis=1)
            self.p[at] += own.sum(axis=1)
            self.n[at], self.open[at] = below[:, -1], sums[:, -1]
        self.last = last

    def result(self) -> pa.RecordBatch:
        scope, _, kind = self.of
        valid = (self.p > 0) & (self.n > 0)
        area = self.u / np.where(valid, self.p * self.n, 1)
        reps = np.arange(self.first_rep, self.first_rep + len(area), dtype=np.int32)
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(area), pa.string()), pa.array([scope] * len(area), pa.string()), pa.array(reps), pa.array(area, mask=~valid)], ["kind", "scope", "rep", "auc"])


def kernel_auc(labels: np.ndarray, scores: np.ndarray, weights: np.ndarray) -> float:
    """Weighted, tie-aware AUC of sorted arrays (scores ascending)."""
    positive, negative = weights * (labels == 1), weights * (labels == 0)
    if not positive.sum() or not negative.sum():
        return float("nan")
    edge = np.flatnonzero(np.concatenate([[True], scores[1:] != scores[:-1]]))
    p, n = np.add.reduceat(positive, edge), np.add.reduceat(negative, edge)
    below = np.cumsum(n) - n
    return float((p * (below + n / 2)).sum() / (p.sum() * n.sum()))
