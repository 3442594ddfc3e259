"""Adapters from the driver's tables to the engine's data model, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

#: Tasks that evaluations list; other event types count only in Overall.
EVENT_TASKS = ["click", "purchase", "view"]
FEATURE_TASKS = ["QA", "Data2txt", "Summary"]
SIZE = 64
HEADS = [f"ecs_l{k // 8}_h{k % 8}" for k in range(32)]
LAYERS = [f"pks_standard_l{k}" for k in range(32)]


class Catalogue:
    """Named queries and the SQL that says the same."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def register(f: Query) -> Query:
            name = f.__name__.rstrip("_")
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql.strip()
            return f

        return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def responses(spark: SparkSession, d: str) -> DataFrame:
    """documents as annotated responses: task is the language, the label is toxic, poor quality is truncated."""
    labels = table(spark, d, "labels")
    docs = table(spark, d, "documents").join(labels, "doc_id", "left")
    return docs.select(
        "doc_id", F.col("doc_id").cast("string").alias("response_id"), F.col("lang").alias("task"), F.col("source").alias("model"), F.col("text").alias("response"),
        F.when(F.col("doc_id") % 10 < 2, "test").otherwise("train").alias("split"), F.when(F.coalesce("quality", F.lit(1)) == 1, "good").otherwise("truncated").alias("quality"), F.col("toxic").alias("label"),
    )


RESPONSES = """responses AS (SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS response_id, d.lang AS task, d.source AS model, d.text AS response,
  CASE WHEN d.doc_id % 10 < 2 THEN 'test' ELSE 'train' END AS split,
  CASE WHEN coalesce(l.quality, 1) = 1 THEN 'good' ELSE 'truncated' END AS quality, l.toxic AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def spans(spark: SparkSession, d: str) -> DataFrame:
    """events as spans of users' responses: overlapping, adjacent and apart."""
    start = F.floor(F.col("value") * 10).cast("int")
    return table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("response_id"), F.col("event_id").alias("ordinal"), start.alias("start"), (start + 1 + (F.col("event_id") % 4).cast("int")).alias("end"),
        F.when(F.col("event_id") % 7 == 0, "").otherwise(F.col("event_type")).alias("label_type"), (F.col("event_id") % 5 == 0).alias("implicit_true"), (F.col("event_id") % 11 == 0).alias("due_to_null"),
    )


SPANS = """spans AS (SELECT CAST(user_id AS VARCHAR) AS response_id, event_id AS ordinal, CAST(floor(value * 10) AS INT) AS s,
  CAST(floor(value * 10) AS INT) + 1 + CAST(event_id % 4 AS INT) AS e, CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END AS label_type,
  event_id % 5 = 0 AS implicit_true, event_id % 11 = 0 AS due_to_null FROM events)"""


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """events as scored tokens: task is the event type, the response is the user."""
    return table(spark, d, "events").select(
        F.col("event_type").alias("task"), F.col("user_id").cast("string").alias("response_id"), F.col("event_id").alias("token_index"), F.col("value").alias("score"),
        (F.col("event_id") % 3 == 0).cast("int").alias("label"), (F.col("user_id") % 2).cast("int").alias("response_label"), (F.lit(1.0) + F.col("event_id") % 4).alias("weight"),
        (F.col("value") * ((F.col("event_id") * 7) % 11 + 1)).alias("score_b"), F.when(F.col("user_id") % 4 == 0, "truncated").otherwise("good").alias("quality"),
    )


TOKENS = """tokens AS (SELECT event_type AS task, CAST(user_id AS VARCHAR) AS response_id, event_id AS token_index, value AS score,
  CAST(event_id % 3 = 0 AS INT) AS label, CAST(user_id % 2 AS INT) AS response_label, CAST(1 + event_id % 4 AS DOUBLE) AS weight,
  value * ((event_id * 7) % 11 + 1) AS score_b, CASE WHEN user_id % 4 = 0 THEN 'truncated' ELSE 'good' END AS quality FROM events)"""


def features(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as a wide feature table: 32 head features and 32 layer features a token."""
    task = F.element_at(F.array(*[F.lit(t) for t in FEATURE_TASKS]), (F.col("vec_id") % 3 + 1).cast("int"))
    split = F.when(F.col("vec_id") % 5 == 0, "dev").when(F.col("vec_id") % 5 == 1, "test").otherwise("calibration_train")
    wide = [F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(HEADS + LAYERS)]
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("response_id"), "vec_id", task.alias("task"), split.alias("eval_split"), (F.col("label") % 2).cast("int").alias("token_label"), *wide)


FEATURES = """feats AS (SELECT vec_id, CAST(vec_id AS VARCHAR) AS response_id, ['QA', 'Data2txt', 'Summary'][CAST(vec_id % 3 + 1 AS INT)] AS task,
  CASE WHEN vec_id % 5 = 0 THEN 'dev' WHEN vec_id % 5 = 1 THEN 'test' ELSE 'calibration_train' END AS eval_split,
  CAST(label % 2 AS INT) AS token_label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""


def sequences(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as hidden states: a label's vectors are one response, in the order of their ids."""
    from pyspark.sql import Window as W

    position = (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).cast("int")
    return table(spark, d, "embeddings").select(F.col("label").alias("response"), position.alias("position"), "vec_id", "embedding")


SEQUENCES = """seqs AS (SELECT label AS response, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS position, vec_id,
  CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""


def auc_sql(rows: str, by: str, label: str = "label", score: str = "score", weight: str = "1.0") -> str:
    """SQL of the tie-aware weighted AUC of a relation, by a list of columns."""
    head, part, group = (f"{by}, ", f"PARTITION BY {by} ", f" GROUP BY {by}") if by else ("", "", "")
    return f"""SELECT {head}CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p * (below + n / 2)) / (sum(p) * sum(n)) END AS auc, sum(p) AS n_positive, sum(n) AS n_negative
  FROM (SELECT *, coalesce(sum(n) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
    FROM (SELECT {head}CAST({score} AS DOUBLE) AS s, sum(CASE WHEN {label} = 1 THEN CAST({weight} AS DOUBLE) ELSE 0 END) AS p,
      sum(CASE WHEN {label} = 1 THEN 0 ELSE CAST({weight} AS DOUBLE) END) AS n FROM {rows} WHERE {label} IS NOT NULL AND {score} IS NOT NULL AND {weight} > 0
      GROUP BY {head}CAST({score} AS DOUBLE))){group}"""


def in_list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)
