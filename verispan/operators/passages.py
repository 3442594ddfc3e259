"""Exact occurrences of many passages in many texts, in one pass over the texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of passages that one pass over the texts holds; more passages take more passes.
PASS_CHARS = 8 << 20
FOUND = "item_id long, start int, end int, again int"


def _finder(passages: list[tuple[int, str]]):
    """A function from a text to the passages' occurrences: text of passage -> (first, second or -1)."""
    known = sorted({text for _, text in passages})
    machine = ahocorasick.Automaton()
    for p in known:
        machine.add_word(p, p)
    if known:
        machine.make_automaton()

    def find(text: str) -> dict[str, tuple[int, int]]:
        found: dict[str, tuple[int, int]] = {}
        for last, p in machine.iter(text) if known else ():
            start = last - len(p) + 1
            first, second = found.get(p, (start, -1))
            found[p] = (first, start if second < 0 and start != first else second)
        return found

    return find


def _search(key: str, passages: list[tuple[int, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, ids = _finder(passages), {}
        for item, text in passages:
            ids.setdefault(text, []).append(item)
        for batch in batches:
            keys, rows = batch.column(key).to_pylist(), []
            for k, text in enumerate(batch.column("text")):
                for p, (first, second) in find(text.as_py() or "").items():
                    rows += [(keys[k], item, first, first + len(p), second) for item in ids[p]]
            if rows:
                kinds = (batch.schema.field(key).type, pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [key, "item_id", "start", "end", "again"])

    return run


def locate_passages(texts: DataFrame, key: str, text: str, passages: DataFrame) -> DataFrame:
    """(key, item_id, start, end, again): where each passage first occurs in each text, in code points.

    ``again`` is the start of its second occurrence, which may overlap the first, or -1. passages
    (item_id, text) are a query set: they go to the scan in blocks of PASS_CHARS, a pass each, and
    the texts are not shuffled. The time of a pass doesn't grow with the number of its passages.
    Null and empty passages occur nowhere.
    """
    kind = texts.schema[key].dataType.simpleString()
    rows = texts.select(key, F.col(text).alias("text"))
    blocks, size = [[]], 0
    for item, passage in passages.select(F.col("item_id").cast("long"), "text").where("text <> ''").toLocalIterator():
        if size > PASS_CHARS:
            blocks.append([])
            size = 0
        blocks[-1].append((item, passage))
        size += len(passage)
    return reduce(DataFrame.unionByName, [rows.mapInArrow(_search(key, b), f"`{key}` {kind}, {FOUND}") for b in blocks])
