"""Queries of record scans, manifests, checks of arguments and columns, limits and renders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts, vectors
from ..operators import attention, calibration, checks, evaluation, splits
from ..sources import artifacts, ragjson
from .registry import RESPONSES, SEQUENCES, SIZE, Catalogue, responses, sequences, table

catalogue = Catalogue()
query = catalogue.add


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'blank' WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 THEN 'bad' ELSE 'ok' END AS status,
  CASE WHEN doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0 THEN CAST(doc_id AS VARCHAR) END AS id FROM documents""")
def jsonl_scan(spark, d):
    """Documents as JSON lines, some blank, some no object, some cut off: what the strict scan makes of each."""
    whole = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("source_id"), F.col("text").alias("response")))
    line = F.when(F.col("doc_id") % 7 == 0, "  ").when(F.col("doc_id") % 11 == 0, "[1]").when(F.col("doc_id") % 13 == 0, F.expr("substring(line, 1, length(line) - 3)")).otherwise(F.col("line"))
    rows = table(spark, d, "documents").select("doc_id", whole.alias("line")).select("doc_id", line.alias("value"))
    rows = rows.withColumn("row", ragjson.parsed("value", ragjson.RESPONSE)).withColumn("bad", ragjson.bad_line("value", "row"))
    status = F.when(F.trim("value") == "", "blank").when(F.col("bad"), "bad").otherwise("ok")
    return rows.select("doc_id", status.alias("status"), F.when(status == "ok", F.col("row.id")).alias("id"))


@query("""SELECT n_nationkey, '{''name'': ''' || n_name || ''', ''region'': ' || n_regionkey || ', ''open'': ' || CASE WHEN n_nationkey % 2 = 0 THEN 'True' ELSE 'False' END
  || ', ''hours'': None, ''tags'': [''a b'', 1.5]}' AS context FROM nation""")
def record_context(spark, d):
    """The context of structured records, written as Python writes a dict, in the order of the line's keys."""
    flag = F.when(F.col("n_nationkey") % 2 == 0, "true").otherwise("false")
    info = F.concat(F.lit('{"name": "'), "n_name", F.lit('", "region": '), F.col("n_regionkey").cast("string"), F.lit(', "open": '), flag, F.lit(', "hours": null, "tags": ["a b", 1.5]}'))
    lines = table(spark, d, "nation").select("n_nationkey", F.lit("Data2txt").alias("task_type"), F.concat(F.lit('{"source_info": '), info, F.lit("}")).alias("raw"))
    return ragjson.with_contexts(lines).select("n_nationkey", "context")


@query("""SELECT n_nationkey, sha256('{"name":"' || n_name || '","rows":{"region":' || n_regionkey || ',"tags":["x",null]}}') AS manifest_sha256, true AS sound, false AS tampered_sound FROM nation""")
def manifest_seals(spark, d):
    """A self-hashed manifest for each nation, checked as it is and after a change. Twenty-five rows, in the driver as manifests are."""

    def sound(manifest: dict) -> bool:
        try:
            return bool(artifacts.check_seal(manifest))
        except artifacts.IntegrityError:
            return False

    out = []
    for r in table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect():
        held = artifacts.sealed({"name": r["n_name"], "rows": {"tags": ("x", float("nan")), "region": r["n_regionkey"]}})
        out.append((r["n_nationkey"], held[artifacts.HASH], sound(held), sound(held | {"name": "other"})))
    return spark.createDataFrame(out, "n_nationkey int, manifest_sha256 string, sound boolean, tampered_sound boolean")


@query("SELECT 'wanted_' || i AS missing FROM range(1, 3) t(i)")
def required_columns(spark, d):
    """Required columns that the orders table lacks."""
    gone = checks.missing_columns(table(spark, d, "orders"), ["o_orderkey", "wanted_1", "o_custkey", "wanted_2"])
    return spark.createDataFrame([(c,) for c in gone], "missing string")


@query("SELECT CAST(i AS INT) AS place, CAST(v AS INT) AS value FROM (VALUES (0, 3), (1, 1), (2, 2)) t(i, v)")
def checked_grid(spark, d):
    """A grid without repeats, in order."""
    return spark.createDataFrame(list(enumerate(calibration.checked_grid([3, 1, 3, 2, 1], 32, "heads"))), "place int, value int")


@query(f"WITH {RESPONSES} SELECT response_id FROM responses WHERE label IS NULL ORDER BY doc_id LIMIT 40")
def pending_limit(spark, d):
    """The first pending examples in natural order, as many as an extraction run may take."""
    rows = responses(spark, d)
    return checks.orphans(rows.select("response_id"), rows.where("label is not null"), "response_id").orderBy(*splits.natural_key("response_id")).limit(40)


@query("SELECT DISTINCT lang FROM documents WHERE lang NOT IN ('en', 'de')")
def unknown_tasks(spark, d):
    return checks.unknown_values(table(spark, d, "documents"), "lang", ["en", "de"])


@query('SELECT a.source AS "first", b.source AS "second" FROM (SELECT DISTINCT source FROM documents) a JOIN (SELECT DISTINCT source FROM documents) b ON a.source < b.source')
def model_pairs(spark, d):
    return evaluation.model_pairs(table(spark, d, "documents"), "source")


@query("SELECT doc_id, true AS shares_prefix, length(text) + 8 AS n_after FROM documents")
def legacy_render(spark, d):
    """The legacy render of each response begins with the exact one's prompt; what follows is the response and its end."""
    docs = table(spark, d, "documents")
    head = texts.render_chat("source", "lang", F.lit(""))
    legacy = texts.render_legacy("source", "lang", "text")
    return docs.select("doc_id", F.startswith(legacy, head).alias("shares_prefix"), (F.length(legacy) - F.length(head)).cast("bigint").alias("n_after"))


_TURN = "position / power(10000, CAST((k - 1) % 32 AS DOUBLE) / 32)"


@query(f"""WITH {SEQUENCES} SELECT vec_id, CAST(k - 1 AS INT) AS k, round(v[k] * cos({_TURN}) + CASE WHEN k <= 32 THEN -v[k + 32] ELSE v[k - 32] END * sin({_TURN}), 7) AS value FROM seqs, range(1, 65) r(k)""")
def rotary(spark, d):
    """Hidden states with rotary positions."""
    return sequences(spark, d).select("vec_id", F.posexplode(vectors.rotary("embedding", "position")).alias("k", "value")).withColumn("value", F.round("value", 7))


@query(f"WITH {SEQUENCES} SELECT q.response, q.position AS query, count(*) AS n_keys, CAST(sum(k.position) AS BIGINT) AS key_sum FROM seqs q JOIN seqs k ON q.response = k.response AND k.position <= q.position GROUP BY q.response, q.position")
def causal_whole(spark, d):
    """Every key that a query may see, without a window; the pairs of a response are counted as they are met."""
    pairs = attention.causal_pairs(sequences(spark, d), "response", "position")
    return pairs.groupBy("response", "query").agg(F.count("*").alias("n_keys"), F.sum("key_position").cast("bigint").alias("key_sum"))


@query(f"""WITH {SEQUENCES}, traces AS (SELECT response, abs(sum(v[position + 1])) AS absolute_trace FROM seqs WHERE position < {SIZE} GROUP BY response)
  SELECT response, CAST(row_number() OVER (ORDER BY absolute_trace DESC, response) AS INT) AS place FROM traces ORDER BY absolute_trace DESC, response LIMIT 5""")
def head_limit(spark, d):
    """The first five heads by their trace: the candidates' limit is the feature."""
    own = sequences(spark, d).where(F.col("position") < SIZE).groupBy("response").agg(F.abs(F.sum(F.element_at("embedding", F.col("position") + 1).cast("double"))).alias("absolute_trace"))
    ranked = splits.in_total_order(own, [F.col("absolute_trace").desc(), F.col("response")], "place")
    return ranked.orderBy("place").limit(5).select("response", F.col("place").cast("int").alias("place"))
