"""Bounded samples of labelled rows, and the held-out folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes that a sample may have, unless its caller says otherwise; it bounds the sample where a column holds stray values.
MOST_CLASSES = 200


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of doc_id as text, modulo ``folds``."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % folds


def labelled_sample(labels: DataFrame, label: str, per_class: int, folds: int) -> DataFrame:
    """(doc_id, label): about ``per_class`` rows of each class, outside fold 0, chosen by a hash of doc_id.

    Null labels and ids don't count; of repeated ids the larger label does. The expected
    number of rows is bounded by per_class times the number of classes, whatever the table's size.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    return thin(known, "label", per_class)


def thin(rows: DataFrame, label: str, per_class: int, most_classes: int = MOST_CLASSES) -> DataFrame:
    """About ``per_class`` rows of each class, by a hash of doc_id; of the ``most_classes`` commonest classes."""
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(most_classes).collect()}
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == value, min(1.0, per_class / n)).otherwise(share)
    return rows.where(place < share)
