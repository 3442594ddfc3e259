"""Response and source records in JSON lines: strict scans, contexts, and joined examples."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.texts import locate_unique
from ..operators.checks import duplicate_keys, missing_keys, require_none
from ..operators.spans import bad_spans, merge_array
from ..operators.splits import example_order

RESPONSE = "id string, source_id string, model string, split string, quality string, response string, labels array<struct<start:int,end:int,text:string,label_type:string,implicit_true:boolean,due_to_null:boolean>>"
TASKS = ("QA", "Data2txt", "Summary")
SPLITS = ("train", "test")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; blank lines don't count.

    A line that is no object of the schema raises with its file and number. Numbers are looked up only then.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select("value", parsed("value", schema).alias("row"))
    if rows.where(bad_line("value", "row")).select("value").limit(1).collect():
        raise ValueError(_where_bad(spark, path, schema))
    return rows.select("row.*").drop("_corrupt")


def parsed(line: str, schema: str) -> Column:
    return F.from_json(line, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})


def bad_line(line: str, row: str) -> Column:
    """Whether a line is no object of the schema. The whole row is looked at: Spark parses a lone
    _corrupt column by a schema cut down to it, which every line fails."""
    return F.get_json_object(F.to_json(row), "$._corrupt").isNotNull() | F.col(row).isNull() | ~F.ltrim(line).startswith("{")


def _where_bad(spark: SparkSession, path: str, schema: str) -> str:
    return _first_bad(spark, path, lambda rows: rows.withColumn("row", parsed("line", schema)).where(bad_line("line", "row")), "not a valid JSON object")


def _first_bad(spark: SparkSession, path: str, bad: Callable[[DataFrame], DataFrame], what: str) -> str:
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r\n|\n|\r")).alias("at", "line"))
    first = bad(files.where(F.trim("line") != "")).orderBy("file", "at").select("file", "at").first()
    return f"{first['file']}, line {first['at'] + 1}: {what}"


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """source_id, task_type, source, prompt, and the raw line, from which contexts are taken with their key order."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if lines.where(_bad_source("value")).limit(1).collect():
        raise ValueError(_first_bad(spark, path, lambda rows: rows.where(_bad_source("line")), "not a JSON object with a text prompt"))
    at = lambda name: F.get_json_object("value", f"$.{name}").alias(name)
    return lines.select(at("source_id"), at("task_type"), at("source"), at("prompt"), F.col("value").alias("raw"))


def _bad_source(line: str) -> Column:
    """Whether a line is no JSON object, or has a prompt that is neither missing nor a text."""
    held = F.try_parse_json(line)
    prompt = F.schema_of_variant(F.try_variant_get(held, "$.prompt", "variant"))
    return held.isNull() | ~F.ltrim(line).startswith("{") | ~F.coalesce(prompt, F.lit("VOID")).isin("STRING", "VOID")


def context_column(task: Column, raw: Column, field: str = "source_info") -> Column:
    """The context of Summary (a string) and QA (its passages) records; null for other tasks."""
    return F.when(task == "Summary", F.get_json_object(raw, f"$.{field}")).when(task == "QA", F.get_json_object(raw, f"$.{field}.passages"))


def with_contexts(sources: DataFrame) -> DataFrame:
    """sources with their context; Data2txt records as Python writes a dict, in their own key order."""
    @F.pandas_udf("string")
    def written(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for raw in batches:
            yield raw.map(lambda x: None if x is None else repr(json.loads(x)["source_info"]))

    plain = context_column(F.col("task_type"), F.col("raw"))
    record = written(F.when(F.col("task_type") == "Data2txt", F.col("raw")))
    return sources.withColumn("context", F.when(F.col("task_type") == "Data2txt", record).otherwise(plain))


def load_examples(
    spark: SparkSession, responses: str, sources: str, model: str, splits: tuple[str, ...] = SPLITS, tasks: tuple[str, ...] = TASKS, qualities: tuple[str, ...] | None = None, check_context: bool = True
) -> DataFrame:
    """Annotated examples: one model's responses joined with their sources, checked, spans merged, in order.

    Raises on duplicate or missing ids, missing sources, spans that don't fit, and contexts that aren't
    exactly once in their prompt. Filters on model, split and quality come first; the task filter
    comes after the checks of ids and sources.
    """
    if unknown := set(tasks) - set(TASKS):
        raise ValueError(f"unknown tasks: {sorted(unknown)}")
    source = read_sources(spark, sources)
    checks = {"sources without source_id": missing_keys(source, "source_id").select("task_type"), "duplicate source_id": duplicate_keys(source, "source_id")}
    held = source.groupBy("source_id").count().agg(F.count_if(F.col("source_id").isNull() | (F.col("source_id") == "")).alias("none"), F.count_if(F.col("count") > 1).alias("twice")).first()
    if held["none"] or held["twice"]:
        _explain(checks)
    rows = read_jsonl(spark, responses, RESPONSE).where((F.col("model") == model) & F.col("split").isin(*splits))
    if qualities is not None:
        rows = rows.where(F.col("quality").isin(*qualities))
    whole = rows.join(with_contexts(source).withColumn("_held", F.lit(True)), "source_id", "left")
    joined = whole.where(F.col("_held") & F.col("task_type").isin(*tasks)).drop("_held")
    once = joined.withColumn("at", locate_unique("prompt", "context"))
    bad = {
        "responses without id": (whole, F.col("id").isNull() | (F.col("id") == ""), ["source_id"]),
        "responses without a source": (whole, F.col("_held").isNull(), ["id", "source_id"]),
        "response, prompt and labels are required": (joined, F.col("response").isNull() | F.col("prompt").isNull() | F.col("labels").isNull(), ["id"]),
        "spans that don't match the response": (joined, F.size(bad_spans("response", "labels")) > 0, ["id"]),
        "empty context": (joined, F.coalesce("context", F.lit("")) == "", ["id", "task_type"]),
    }
    if check_context:
        bad["context must occur once in its prompt"] = (once, F.col("at.status") != "ok", ["id", "at.status"])
    # one pass over the joined rows tells whether anything is wrong; only then is it looked up
    wanted = F.col("_held").isNotNull() & F.col("task_type").isin(*tasks)
    flags = [F.coalesce(condition if frame is whole else wanted & condition, F.lit(False)).alias(f"f{k}") for k, (frame, condition, _) in enumerate(bad.values())]
    flagged = whole.withColumn("at", locate_unique("prompt", "context")).select("id", *flags)
    counted = flagged.groupBy("id").agg(F.count("*").alias("n"), *[F.max(f"f{k}").alias(f"f{k}") for k in range(len(bad))])
    found = counted.agg(F.count_if(F.col("n") > 1).alias("n"), *[F.coalesce(F.max(f"f{k}"), F.lit(False)).alias(f"f{k}") for k in range(len(bad))]).first()
    if any(found):
        named = {what: frame.where(condition).select(*columns) for what, (frame, condition, columns) in bad.items()}
        _explain({"responses without id": named.pop("responses without id"), "duplicate response id": duplicate_keys(rows, "id")} | named)
    named = joined.select(F.col("id").alias("response_id"), "source_id", F.col("model").alias("generator_model"), F.col("task_type").alias("task"), "quality", "source", "split", "prompt", "context", "response", "labels")
    return _merged(named).withColumn("response_label", (F.size("spans") > 0).cast("int")).orderBy(*example_order(list(SPLITS), list(TASKS)))


def _explain(checks: dict[str, DataFrame]) -> None:
    """Raise for the first check that finds rows."""
    for what, rows in checks.items():
        require_none(rows, what)


def _merged(rows: DataFrame) -> DataFrame:
    """rows with ``spans``: the unions of their labels, by a fold inside each row."""
    def describe(s: Column) -> Column:
        own = F.filter(_ordered("labels"), lambda x: (x["start"] < s["end"]) & (x["end"] > s["start"]))
        types = F.array_distinct(F.filter(F.transform(own, lambda x: x["label_type"]), lambda t: t.isNotNull() & (t != "")))
        flag = lambda name: F.exists(own, lambda x: F.coalesce(x[name], F.lit(False)))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(F.col("response"), s["start"] + 1, s["end"] - s["start"]).alias("text"), F.array_join(types, " | ").alias("label_type"), flag("implicit_true").alias("implicit_true"), flag("due_to_null").alias("due_to_null"))

    return rows.withColumn("spans", F.transform(merge_array("labels"), describe)).drop("labels")


def _ordered(spans: str) -> Column:
    """Spans by start and end, ties in input order."""
    keyed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), i.alias("i"), s["label_type"].alias("label_type"), s["implicit_true"].alias("implicit_true"), s["due_to_null"].alias("due_to_null")))
    return F.array_sort(keyed)
