"""Character spans: validation, union, and labels of the tokens that they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.texts import pieces

SPAN = "struct<start:int,end:int,text:string,label_type:string,implicit_true:boolean,due_to_null:boolean>"


def bad_spans(response: Column | str, spans: Column | str) -> Column:
    """The spans that aren't 0 <= start < end <= length with the text that stands there."""
    response = F.col(response) if isinstance(response, str) else response
    size = F.length(response)

    def bad(s: Column) -> Column:
        bounds = s["start"].isNull() | s["end"].isNull() | (s["start"] < 0) | (s["start"] >= s["end"]) | (s["end"] > size)
        return bounds | ~F.substring(response, s["start"] + 1, s["end"] - s["start"]).eqNullSafe(s["text"])

    return F.filter(spans, bad)


def merge_spans(spans: DataFrame, key: str, response: str | None = None) -> DataFrame:
    """Unions of overlapping or adjacent spans, one row for each.

    spans: key, ordinal, start, end, label_type, implicit_true, due_to_null (and the response text).
    Label types join in order of appearance without repeats and empties; flags are or-ed; the
    text is cut again. One shuffle by key.
    """
    order = W.partitionBy(key).orderBy("start", "end", "ordinal")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    opened = spans.withColumn("opens", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    islands = opened.withColumn("island", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    item = F.struct("start", "end", "ordinal", "label_type")
    found = islands.groupBy(key, "island").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.array_sort(F.collect_list(item)).alias("items"),
        F.max("implicit_true").alias("implicit_true"),
        F.max("due_to_null").alias("due_to_null"),
        *([F.first(response).alias(response)] if response else []),
    )
    types = F.array_distinct(F.filter(F.transform("items", lambda x: x["label_type"]), lambda t: t.isNotNull() & (t != "")))
    text = [F.substring(F.col(response), F.col("start") + 1, F.col("end") - F.col("start")).alias("text")] if response else []
    return found.select(key, "start", "end", *text, F.array_join(types, " | ").alias("label_type"), "implicit_true", "due_to_null")


def merge_array(spans: Column | str) -> Column:
    """The same unions of an array<struct<start,end,...>>, as (start, end), folded without a shuffle."""
    spans = F.col(spans) if isinstance(spans, str) else spans
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (s["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), grown).otherwise(F.array_append(acc, s))

    return F.aggregate(ordered, none, step)


def touches(start: Column, end: Column, spans: Column | str) -> Column:
    """1 if any span overlaps [start, end), else 0; spans stay in the row, so nothing is shuffled."""
    return F.exists(spans, lambda s: (start < s["end"]) & (end > s["start"])).cast("int")


_NONE = "array<struct<start:int,end:int>>"


def labelled_pieces(rows: DataFrame, spans: DataFrame, key: str, text: str) -> DataFrame:
    """The pieces of rows' texts with ``token_label``: whether a span of the same key overlaps (char_start, char_end).

    Spans are gathered for each key and meet the texts, not their pieces; there is no range join to blow up.
    """
    gathered = spans.groupBy(key).agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))).alias("_spans"))
    taken = pieces(rows.select(key, text).join(gathered, key, "left"), key, text, ("_spans",))
    hit = touches(F.col("char_start"), F.col("char_end"), F.coalesce("_spans", F.array().cast(_NONE)))
    return taken.withColumn("token_label", hit).drop("_spans")
