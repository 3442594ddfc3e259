"""Quality by a sparse rule ensemble: tree paths as rules, lasso weights, Spark column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, kernel, text_buffers
from .sampling import labelled_sample
from .words import hash_of, hashed_words, mix

STATISTICS = [
    "n_bytes", "n_words", "n_lines", "upper", "digits", "symbols", "punctuation", "pipes", "exclamations", "spaces", "wide",
    "mean_word", "distinct_words", "function_words", "repeated_lines", "repeated_line_bytes", "mean_line", "shouted", "most_common", "repeated_pairs",
]
#: Training rows for each class.
PER_CLASS = 10000
FOLDS = 5
TREES = 40
DEPTH = 3
LEAST_ROWS = 8
#: Strength of the lasso, as a share of the smallest penalty that leaves no rule.
LASSO = 0.02
#: Common function words, whose share of a text is one of its statistics (fixed values).
FUNCTION_WORDS = (
    "the of and to in is that for it with as was on are by this be from at "
    "le la les de des et un une dans que qui pour pas sur avec est ou par au "
    "der die das und ist nicht ein eine mit den von zu auf für sich im dem des als "
    "el los las del y en un una que por para con no se su al lo como más"
).split()
_FUNCTION = np.unique(np.array([hash_of(w) for w in FUNCTION_WORDS], np.uint64))


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_CLASSES = {
    "upper": _class(bytes(range(65, 91))),
    "digits": _class(b"0123456789"),
    "symbols": _class(b"#$%&*+<=>@[]^_`{}~\\/"),
    "punctuation": _class(b".,;:!?'\"()-"),
    "pipes": _class(b"|"),
    "exclamations": _class(b"!"),
    "spaces": _class(b" \t\n\r\x0b\x0c"),
    "wide": _class(bytes(range(128, 256))),
}


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text; shares are of bytes, words or lines."""
    n = len(at) - 1
    out = {name: np.zeros(n) for name in STATISTICS}
    size = np.diff(at).astype(np.float64)
    most = np.maximum(size, 1)
    out["n_bytes"] = size
    for name, table in _CLASSES.items():
        out[name] = _sums(table[data], at) / most
    hashes, starts, cut = hashed_words(data, at)
    count = np.diff(cut).astype(np.float64)
    words = np.maximum(count, 1)
    owner = np.repeat(np.arange(n), np.diff(cut))
    out["n_words"] = count
    inside = size * (1 - out["spaces"] - out["punctuation"] - out["symbols"] - out["pipes"])
    out["mean_word"] = inside / words
    if len(hashes):
        spot = np.minimum(np.searchsorted(_FUNCTION, hashes), len(_FUNCTION) - 1)
        out["function_words"] = np.bincount(owner, _FUNCTION[spot] == hashes, n) / words
        out["shouted"] = np.bincount(owner, _CLASSES["upper"][data[starts]] & _CLASSES["upper"][data[np.minimum(starts + 1, len(data) - 1)]], n) / words
        key = owner.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24)
        distinct, times = np.unique(key, return_counts=True)
        of = (distinct >> np.uint64(40)).astype(np.int64)
        out["distinct_words"] = np.bincount(of, minlength=n) / words
        np.maximum.at(out["most_common"], of, times / words[of])
        pair = owner[:-1][owner[:-1] == owner[1:]].astype(np.uint64) << np.uint64(40) | mix(hashes[:-1] * np.uint64(3) + hashes[1:])[owner[:-1] == owner[1:]] >> np.uint64(24)
        distinct = np.unique(pair)
        pairs = np.maximum(count - 1, 1)
        out["repeated_pairs"] = np.maximum(0, count - 1 - np.bincount((distinct >> np.uint64(40)).astype(np.int64), minlength=n)) / pairs
    _lines(data, at, out)
    return np.stack([out[name] for name in STATISTICS], axis=1)


def _lines(data: np.ndarray, at: np.ndarray, out: dict[str, np.ndarray]) -> None:
    n = len(at) - 1
    begin = np.zeros(len(data) + 1, bool)
    begin[np.flatnonzero(data == 10) + 1] = True
    begin[at[:-1]] = True
    starts = np.flatnonzero(begin[: len(data)])
    if not len(starts):
        return
    length = np.diff(np.append(starts, len(data)))
    owner = np.searchsorted(at, starts, "right") - 1
    power = np.uint64(0x9E3779B97F4A7C15)
    place = np.arange(len(data)) - np.repeat(starts, length)
    weights = mix((place.astype(np.uint64) + np.uint64(1)) * power)
    content = np.where(data == 10, 0, data.astype(np.uint64) + np.uint64(1))
    key = owner.astype(np.uint64) << np.uint64(40) | mix(np.add.reduceat(content * weights, starts)) >> np.uint64(24)
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    again = first[inverse] != np.arange(len(starts))
    lines = np.maximum(np.bincount(owner, minlength=n), 1)
    out["n_lines"] = np.bincount(owner, minlength=n).astype(np.float64)
    out["repeated_lines"] = np.bincount(owner, again, n) / lines
    out["repeated_line_bytes"] = np.bincount(owner, again * length, n) / np.maximum(np.diff(at), 1)
    out["mean_line"] = np.diff(at) / lines


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        rows = statistics(*text_buffers(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(np.ascontiguousarray(rows[:, k])) for k in range(len(STATISTICS))]], ["doc_id", *STATISTICS])


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, statistics...) of each row's whole text; null counts as empty."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(kernel(_measure), "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, bound): the statistic is over the bound, or not."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        held = F.lit(True)
        for name, above, bound in self.terms:
            held = held & (F.col(name) > bound if above else F.col(name) <= bound)
        return held

    def mask(self, x: np.ndarray) -> np.ndarray:
        held = np.ones(len(x), bool)
        for name, above, bound in self.terms:
            held &= (x[:, STATISTICS.index(name)] > bound) == above
        return held


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[float, Rule]]

    def score(self) -> Column:
        """The probability of label 1 as an expression over the statistics."""
        z = F.lit(self.intercept)
        for weight, rule in self.rules:
            z = z + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _grow(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, depth: int, path: tuple, rules: set, out: np.ndarray) -> None:
    """Split rows to lower the loss most; every node below the root is a rule."""
    if path:
        rules.add(Rule(path))
    total_g, total_h = gradient[rows].sum(), hessian[rows].sum()
    best = (1e-6, -1, 0)
    if depth:
        for f in range(x.shape[1]):
            width = len(edges[f]) + 1
            if width < 2:
                continue
            g = np.cumsum(np.bincount(bins[rows, f], gradient[rows], width))[:-1]
            h = np.cumsum(np.bincount(bins[rows, f], hessian[rows], width))[:-1]
            c = np.cumsum(np.bincount(bins[rows, f], minlength=width))[:-1]
            gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
            gain[(c < LEAST_ROWS) | (len(rows) - c < LEAST_ROWS)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k)
    if best[1] < 0:
        out[rows] = -total_g / (total_h + 1)
        return
    _, f, k = best
    above = bins[rows, f] > k
    for side in (False, True):
        _grow(x, bins, edges, gradient, hessian, rows[above == side], depth - 1, (*path, (STATISTICS[f], side, float(edges[f][k]))), rules, out)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 5) -> RuleModel:
    """Boosted trees give rules; a lasso logistic regression gives most of them no weight.

    One class only gives a constant.
    """
    weight = weight / weight.mean() if len(weight) else weight
    prior = float(np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(prior / (1 - prior)))
    if len(set(y.tolist())) < 2:
        return RuleModel(base, [])
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    rng, z, found = np.random.default_rng(seed), np.full(len(y), base), set()
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        step, rules = np.zeros(len(y)), set()
        rows = np.sort(rng.choice(len(y), max(1, int(0.7 * len(y))), replace=False))
        _grow(x, bins, edges, weight * (p - y), weight * p * (1 - p), rows, DEPTH, (), rules, step)
        z += 0.3 * step
        found |= rules
    rules = sorted(found, key=lambda r: r.terms)
    masks = np.stack([r.mask(x) for r in rules], axis=1)
    _, keep = np.unique(masks, axis=1, return_index=True)
    rules = [rules[k] for k in np.sort(keep)]
    intercept, coefficients = _lasso(masks[:, np.sort(keep)].astype(np.float64), y, weight, base)
    return RuleModel(intercept, [(float(c), r) for c, r in zip(coefficients, rules, strict=True) if c])


def _lasso(m: np.ndarray, y: np.ndarray, weight: np.ndarray, base: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient on centred, scaled rules; the intercept carries no penalty."""
    mean, spread = m.mean(axis=0), np.maximum(m.std(axis=0), 0.02)
    m = (m - mean) / spread
    n = len(y)
    penalty = LASSO * np.abs(m.T @ (weight * (1 / (1 + np.exp(-base)) - y)) / n).max()
    probe = np.ones(m.shape[1])
    for _ in range(20):
        probe = m.T @ (m @ probe)
        probe /= np.linalg.norm(probe)
    speed = 1 / (0.25 * weight.max() * (np.linalg.norm(m @ probe) ** 2 / n + 1))
    b, w, previous, t = base, np.zeros(m.shape[1]), np.zeros(m.shape[1]), 1.0
    look, look_b, before_b = w, b, b
    for _ in range(rounds):
        error = weight * (1 / (1 + np.exp(-(m @ look + look_b))) - y)
        w = look - speed * (m.T @ error) / n
        w = np.sign(w) * np.maximum(np.abs(w) - speed * penalty, 0)
        b = look_b - speed * error.mean()
        fresh = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, look_b = w + (t - 1) / fresh * (w - previous), b + (t - 1) / fresh * (b - before_b)
        previous, before_b, t = w, b, fresh
    return float(b - (w / spread * mean).sum()), w / spread


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> RuleModel:
    """Rules learned from a bounded sample: about ``per_class`` labelled rows of each class.

    Rows of a class sampled more thinly weigh more, so scores keep the labels' shares. Only labels
    outside fold 0 are read. Null texts, labels and ids don't count; of repeated ids the larger label
    does, and repeated rows of a sampled document count each. Empty tables, and labels of one class,
    give a constant score. Other columns are ignored.
    """
    sample = labelled_sample(labels, label, per_class, FOLDS)
    rows = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null").join(F.broadcast(sample), "doc_id")
    found = measured(rows).join(F.broadcast(sample), "doc_id").toPandas().sort_values(["doc_id", *STATISTICS]).reset_index(drop=True)
    y = found["label"].to_numpy(np.float64)
    known = labels.where(F.col(label).isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0))
    prior = known.agg(F.avg(F.col(label).cast("double"))).first()[0]
    share = y.mean() if len(y) else 0.5
    weight = np.where(y == 1, (prior or share) / max(share, 1e-9), (1 - (prior if prior is not None else share)) / max(1 - share, 1e-9))
    return fit(found[STATISTICS].to_numpy(np.float64), y, weight)


def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """(doc_id, score, statistics...) of each row's whole text.

    Null and empty texts are scored by statistics of zero. Repeated rows repeat; no rows give
    none; other columns are ignored.
    """
    rows = measured(docs)
    return rows.select("doc_id", model.score().alias("score"), *STATISTICS)
