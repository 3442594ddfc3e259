"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, tokenization.

Every stage takes the table that its predecessor wrote and, but for the last, returns its columns, whatever
else the table holds and however those columns are named. Rows are told apart by doc_id and a hash of
their text, so rows without an id, or of one id, are judged one by one. An empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verispan.llm import bpe, decontaminate, lines, shingles, toxicity
from verispan.llm.common import WRITTEN, documents, materialize, release

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labels of these documents, but those held out.

    Null and empty texts are scored as texts without words; repeated rows share their fate; a score at the
    threshold is rejected. Without labels of both classes nothing is rejected.
    """
    return toxicity.without_toxic(docs, toxicity.train(docs, documents(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines, whole blocks of them too; n_chars follows the text where it was cut.

    Null texts stay null, emptied ones are empty, null sources are one site; repeated rows are cut alike.
    """
    kept = lines.strip_boilerplate(docs, counts=("_line_count", "_lines_cut"))
    if "n_chars" in docs.columns:
        size = F.when(F.col("_lines_cut") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", size)
    return kept.select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash candidates with a likeness of 0.8 or more in five-word shingles.

    That of the smallest doc_id stays, null ids last, ties and whole repeats by a hash of the text. Null,
    empty and wordless texts are one group.
    """
    return shingles.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage, judged row by row; null and empty texts stay."""
    return decontaminate.decontaminate(docs, documents(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's number of tokens, and digests of its ids and of what they decode to; a null text counts as empty, repeated rows repeat."""
    decoded = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS)
    return decoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("benchmark_decontamination", drop_benchmark),
    ("byte_level_bpe", tokenize),
]
#: A trained classifier and tokenization can't be said in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again.

    What a stage wrote on its way, and its predecessor's result, go once its own is there.
    """
    docs, first = documents(spark, sf_dir), len(WRITTEN)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        release(spark, first)
    return STAGES[-1][1](spark, docs, sf_dir)
