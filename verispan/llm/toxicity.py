"""Toxicity by a convolutional classifier over hashed words, thresholds calibrated by language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, kernel, text_buffers
from .convnet import ConvNet
from .sampling import fold, labelled_sample
from .words import hashed_words

HASHES = 20
WIDTHS = (1, 2, 3)
FILTERS = 8
EMBEDDING = 12
#: Training documents for each class, and those a hashed word must occur in.
PER_CLASS = 6000
LEAST_DOCS = 4
EPOCHS = 8
#: One blank training text for so many documents.
BLANKS = 20
FOLDS = 5
#: Longer training texts are left out of the sample, which bounds what reaches the driver.
MOST_WORDS = 4000
#: Training documents that a language must have, and toxic rows at which its own threshold weighs as much as the common one.
LEAST_SPOKEN = 20
SHRINK = 20


@dataclass
class ToxicModel:
    """What scoring needs: words' places, the net, and each language's threshold.

    A known word speaks for the language ``voices[place]`` with ``loudness[place]``; the last
    threshold is that of texts in which no language is heard.
    """

    table: np.ndarray
    net: ConvNet
    languages: list[str]
    voices: np.ndarray
    loudness: np.ndarray
    thresholds: np.ndarray


def learn_voices(sequences: list[np.ndarray], langs: list[str | None], table: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, voices, loudness): for each place of ``table``, the language whose documents hold the word most, and how telling it is.

    Learned from texts and their languages alone; languages with under LEAST_SPOKEN documents are left out.
    """
    places = int(table.max(initial=0)) + 1
    spoken = sorted({x for x in langs if x is not None})
    spoken = [x for x in spoken if langs.count(x) >= LEAST_SPOKEN]
    rates = np.zeros((len(spoken), places))
    for own, lang in zip(sequences, langs, strict=True):
        if lang in spoken:
            rates[spoken.index(lang), np.unique(table[own])] += 1
    if len(spoken) < 2:
        return spoken, np.zeros(places, np.int64), np.zeros(places)
    rates = (rates + 0.1) / (np.array([langs.count(x) for x in spoken])[:, None] + 0.2)
    ranked = np.sort(rates, axis=0)
    loudness = np.log(ranked[-1] / ranked[-2])
    loudness[0] = 0
    return spoken, rates.argmax(axis=0), loudness


def languages_of(model: ToxicModel, symbols: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Each text's language by its words, as a place in ``model.languages``; their number where none is heard."""
    n, k = len(cut) - 1, len(model.languages)
    if not k:
        return np.zeros(n, np.int64)
    owner = np.repeat(np.arange(n), np.diff(cut))
    votes = np.bincount(owner * k + model.voices[symbols], model.loudness[symbols], n * k).reshape(n, k)
    return np.where(votes.max(axis=1) > 0, votes.argmax(axis=1), k)


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - HASHES)).astype(np.int64)


def _training_words(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            hashes, _, cut = hashed_words(*text_buffers(batch.column("text")))
            found = _buckets(hashes).astype("<i4")
            words = [found[a:z].tobytes() for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            made = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), batch.column("lang"), pa.array(words, pa.binary())], ["doc_id", "label", "lang", "words"])
            yield made.filter(pa.array(np.diff(cut) <= most))

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, seed: int = 11, most_words: int = MOST_WORDS) -> ToxicModel:
    """A model learned from a bounded sample: about ``per_class`` labelled documents of each class, of up to ``most_words`` words.

    Only labels outside fold 0 are read, for the classes' shares too. The sampled ids are sent to the
    scan of docs; their number is bounded by the sample. A quarter of the sample calibrates the
    thresholds: the common one and each language's own, which gives way to the common one the fewer
    toxic rows it has. Languages are told by words, learned from the sample's texts and their lang
    (docs without that column have none). Null texts, labels and ids don't count; of repeated ids the
    larger label does, and repeated rows of a sampled document count each. Empty tables, and labels
    without both classes, give a model for which nothing is toxic. Other columns are ignored.
    """
    sample = labelled_sample(labels, label, per_class, FOLDS)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), "text", lang.alias("lang")).where("text is not null").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "lang", "text")
    rows = rows.mapInArrow(kernel(_training_words(most_words)), "doc_id long, label int, lang string, words binary").toPandas().sort_values(["doc_id", "words"]).reset_index(drop=True)
    table = np.zeros(1 << HASHES, np.int32)
    nothing = ToxicModel(table, ConvNet.fresh(1, EMBEDDING, WIDTHS, FILTERS, 2, seed), [], np.zeros(1, np.int64), np.zeros(1), np.full(1, np.inf))
    y = rows["label"].to_numpy(np.int64)
    if len(set(y.tolist())) < 2:
        return nothing
    sequences = [np.frombuffer(w, "<i4") for w in rows["words"]]
    calibrates = np.random.default_rng(seed).random(len(y)) < 0.25
    counts = np.zeros((2, 1 << HASHES), np.int32)
    for k in np.flatnonzero(~calibrates):
        counts[y[k], np.unique(sequences[k])] += 1
    held = np.flatnonzero(counts.sum(axis=0) >= LEAST_DOCS)
    table[held] = np.arange(1, len(held) + 1)
    net = ConvNet.fresh(len(held) + 1, EMBEDDING, WIDTHS, FILTERS, 2, seed)
    share = max(1e-6, float((y[~calibrates] == 1).mean()))
    one, both = counts[1, held], counts[:, held].sum(axis=0)
    tilt = (one - share * both) / np.sqrt(share * (1 - share) * both + 1)  # so that max pooling finds telling words from the start
    net.embedding[1:, 0] = np.clip(tilt, -4, 12) / 4
    for matrix in net.filters:
        matrix[0, :2] = 1.0
    net.dense[[0, 1, FILTERS, FILTERS + 1, 2 * FILTERS, 2 * FILTERS + 1]] = [-0.3, 0.3]
    mapped = [table[s] for s in sequences]
    learned = np.flatnonzero(~calibrates)
    unknown = max(8, len(learned) // BLANKS)  # texts of unknown words alone, which say nothing, are clean
    net.fit([mapped[k] for k in learned] + [table[:1] * 0] * unknown, np.append(y[learned], np.zeros(unknown, np.int64)), EPOCHS, 64, 2e-5, seed)
    open_labels = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != 0))
    prior = open_labels.agg(F.avg(F.col(label).cast("double"))).first()[0] or share
    z = _margins(net, mapped)
    weight = np.where(y == 1, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9))
    whole = _threshold(z[calibrates], y[calibrates], weight[calibrates])
    languages, voices, loudness = learn_voices(sequences, [None if x is None or x != x else x for x in rows["lang"]], table)
    model = ToxicModel(table, net, languages, voices, loudness, np.full(len(languages) + 1, whole))
    heard = languages_of(model, np.concatenate(mapped), np.concatenate([[0], np.cumsum([len(s) for s in mapped])]))
    for k in range(len(languages)):
        own = calibrates & (heard == k)
        toxic = int((y[own] == 1).sum())
        if toxic and (y[own] == 0).any():
            model.thresholds[k] += toxic / (toxic + SHRINK) * (_threshold(z[own], y[own], weight[own]) - whole)
    return model


def _threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The margin at which weighted F1 is largest, midway in its gap; ties go to the widest gap."""
    if not (y == 1).any():
        return float(z.max(initial=0.0)) + 1
    order = np.argsort(-z, kind="stable")
    z, y, weight = z[order], y[order], weight[order]
    hits, picked = np.cumsum(weight * (y == 1)), np.cumsum(weight)
    f1 = 2 * hits / (picked + hits[-1])
    gap = np.append(z[:-1] - z[1:], 1.0)
    f1[gap <= 0] = -1
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = int(best[gap[best].argmax()])
    return float(z[k] - gap[k] / 2)


def _margins(net: ConvNet, sequences: list[np.ndarray]) -> np.ndarray:
    out = []
    for a in range(0, len(sequences), 256):
        out.append(_margin(net, *_joined(net, sequences[a : a + 256])))
    return np.concatenate(out)


def _joined(net: ConvNet, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    gap = np.zeros(net.margin, np.int32)
    lengths = np.array([len(s) for s in sequences], np.int64)
    return np.concatenate([x for s in sequences for x in (s, gap)]), np.cumsum(lengths + net.margin) - lengths - net.margin, lengths


def _margin(net: ConvNet, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    z = net.logits(net.pooled(symbols, starts, lengths))
    return (z[:, 1] - z[:, 0]).astype(np.float64)


def _scores(model: ToxicModel, texts: pa.Array) -> np.ndarray:
    net = model.net
    hashes, _, cut = hashed_words(*text_buffers(texts))
    symbols = model.table[_buckets(hashes)]
    lengths = np.diff(cut)
    shift = np.arange(len(lengths)) * net.margin
    padded = np.zeros(len(symbols) + net.margin * max(1, len(lengths)), np.int32)
    padded[np.arange(len(symbols)) + np.repeat(shift, lengths)] = symbols
    z = _margin(net, padded, cut[:-1] + shift, lengths) - model.thresholds[languages_of(model, symbols, cut)]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """(doc_id, score) of each row's whole text; a score of 0.5 is the threshold of the text's language.

    The language comes from the text's words, never from a column. Null and empty texts
    are scored as texts without words. Repeated rows repeat; no rows give none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(model, batch.column("text")))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(kernel(run), "doc_id long, score double")


def without_toxic(docs: DataFrame, model: ToxicModel, least: float = 0.5) -> DataFrame:
    """The rows of docs whose texts score under ``least``, with all their columns, whatever their names.

    Each row is judged by its text alone: null and empty texts as texts without words, repeated rows
    alike; a score equal to ``least`` is rejected. No rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            yield batch.filter(pa.array(_scores(model, batch.column("text")) < least))

    return docs.mapInArrow(kernel(run), docs.schema)
