"""Language identification by a byte convolutional network over fixed-length windows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, kernel, lower_ascii, text_buffers
from .convnet import ConvNet
from .sampling import MOST_CLASSES, fold, thin

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: Training documents for each language, and windows of each document.
PER_LANGUAGE = 1000
WINDOWS = 3
EPOCHS = 4
_ASCII = re.compile(rb"[A-Za-z]")
_LETTER = regex.compile(r"\p{L}")


@dataclass
class LanguageModel:
    languages: list[str]
    net: ConvNet


def _symbols(data: np.ndarray) -> np.ndarray:
    """Bytes of lower-cased text as symbols 1 to 256."""
    return lower_ascii(data).astype(np.int32) + 1


def _training_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        data, at = text_buffers(batch.column("text"))
        langs, ids = batch.column("lang").to_pylist(), batch.column("doc_id").to_pylist()
        out_lang, out = [], []
        for i, (lang, doc_id) in enumerate(zip(langs, ids, strict=True)):
            own = data[at[i] : at[i + 1]]
            rng = np.random.default_rng((doc_id or 0) & 0xFFFFFFFF)
            for start in rng.integers(0, max(1, len(own) - WINDOW + 1), WINDOWS if len(own) > WINDOW else 1).tolist():
                out_lang.append(lang)
                out.append(own[start : start + WINDOW].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out_lang, pa.string()), pa.array(out, pa.binary())], ["lang", "window"])


def train(docs: DataFrame, folds: int = 3, held: int = 1, per_language: int = PER_LANGUAGE, seed: int = 7, most_languages: int = MOST_CLASSES) -> LanguageModel:
    """A model learned from a bounded sample: about ``per_language`` documents of each language.

    Only rows with text and lang whose fold isn't ``held`` count; windows come from anywhere in
    a text. Of more than ``most_languages`` languages the commonest are learned.
    """
    known = docs.select(F.col("doc_id").cast("long"), "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held))
    rows = thin(known, "lang", per_language, most_languages).mapInArrow(kernel(_training_windows), "lang string, window binary").toPandas()
    rows = rows.sort_values(["lang", "window"]).reset_index(drop=True)
    languages = sorted(set(rows["lang"]))
    net = ConvNet.fresh(257, EMBEDDING, WIDTHS, FILTERS, max(1, len(languages)), seed)
    if len(languages) > 1:
        labels = np.array([languages.index(x) for x in rows["lang"]])
        net.fit([_symbols(np.frombuffer(w, np.uint8)) for w in rows["window"]], labels, EPOCHS, 64, 1e-5, seed)
    return LanguageModel(languages, net)


def _predict(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, languages = model.net, np.array([*model.languages, "und"], object)
        for batch in blocks(batches):
            data, at = text_buffers(batch.column("text"))
            n = batch.num_rows
            texts = batch.column("text")
            size = np.diff(at)
            count = -(-size // WINDOW)  # windows of each text; the last may be shorter
            owner = np.repeat(np.arange(n), count)
            first = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            start = at[owner] + first * WINDOW
            length = np.minimum(WINDOW, at[owner + 1] - start)
            mean = np.zeros((n, max(1, len(model.languages))))
            if len(owner):
                margin = net.margin
                shift = np.arange(len(owner)) * margin
                symbols = np.zeros(len(data) + margin * len(owner), np.int32)
                symbols[np.arange(len(data)) + np.repeat(shift, length)] = _symbols(data)
                each = net.probabilities(net.pooled(symbols, start - at[0] + shift, length))
                np.add.at(mean, owner, each * length[:, None])
                mean /= np.maximum(size, 1)[:, None]
            best = mean.argmax(axis=1)
            score = np.clip(mean[np.arange(n), best], 0, 1)
            letters = np.array([bool(_ASCII.search(data[at[i] : at[i + 1]])) or bool(_LETTER.search(texts[i].as_py() or "")) for i in range(n)], bool)
            best[~letters] = len(model.languages)
            score[~letters] = 0.0
            if not model.languages:
                best[:] = 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(languages[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) of each row's whole text.

    A text is cut into windows of WINDOW bytes, all of them used; the score is the mean of the
    windows' softmax values, weighted by their bytes. Null texts and texts without letters are
    ``und`` with score 0, as is everything if no language was learned. Ties go to the first
    language by name. Repeated rows repeat; no rows give none; other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(kernel(_predict(model)), "doc_id long, lang_pred string, score double")


def held_out(results: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    return results.select("doc_id", (F.coalesce(fold("doc_id", folds), F.lit(-1)) == held).alias("held_out"), *[c for c in results.columns if c != "doc_id"])
