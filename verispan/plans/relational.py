"""Queries of loading, joining, checking and counting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.texts import safe_name
from ..operators import checks, evaluation, splits
from ..operators.passages import locate_passages
from .registry import RESPONSES, TOKENS, Catalogue, responses, table, tokens

catalogue = Catalogue()
query = catalogue.add
TASKS = ["en", "de", "fr", "es"]
DEV, SEED = 20, 2024


@query(f"""WITH {RESPONSES} SELECT response_id, task, model, split, quality, coalesce(label, -1) AS label FROM responses
  WHERE model IN ('src0', 'src1', 'src2') AND split IN ('train', 'test') AND quality = 'good' AND task IN ('en', 'de')""")
def filter_examples(spark, d):
    rows = responses(spark, d).where(F.col("model").isin("src0", "src1", "src2") & F.col("split").isin("train", "test") & (F.col("quality") == "good") & F.col("task").isin("en", "de"))
    return rows.select("response_id", "task", "model", "split", "quality", F.coalesce("label", F.lit(-1)).alias("label"))


@query("""SELECT o.o_orderkey AS order_id, c.c_custkey AS source_id, c.c_mktsegment AS task, o.o_orderpriority AS quality, o.o_totalprice AS total
  FROM orders o JOIN customer c ON CAST(o.o_custkey AS VARCHAR) = CAST(c.c_custkey AS VARCHAR)""")
def join_sources(spark, d):
    """Responses join their sources on the key as text, many to one."""
    left = table(spark, d, "orders").withColumn("key", F.col("o_custkey").cast("string"))
    right = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), "c_custkey", "c_mktsegment")
    return left.join(right, "key").select(F.col("o_orderkey").alias("order_id"), F.col("c_custkey").alias("source_id"), F.col("c_mktsegment").alias("task"), F.col("o_orderpriority").alias("quality"), F.col("o_totalprice").alias("total"))


@query(f"""WITH {RESPONSES} SELECT r.response_id, r.task, r.split, r.quality, CAST(coalesce(r.label, 0) AS INT) AS response_label, b.item_id AS source_id,
  instr(r.response, b.text) - 1 AS context_start, instr(r.response, b.text) - 1 + length(b.text) AS context_end
  FROM responses r JOIN benchmark b ON r.task IN ('en', 'de', 'fr', 'es') AND instr(r.response, b.text) > 0""")
def load_examples(spark, d):
    """Annotated examples: responses with the source passages that they quote, located in the text."""
    rows = responses(spark, d).where(F.col("task").isin(TASKS))
    found = locate_passages(rows, "doc_id", "response", table(spark, d, "benchmark"))
    named = found.join(rows.select("doc_id", "response_id", "task", "split", "quality", "label"), "doc_id")
    return named.select("response_id", "task", "split", "quality", F.coalesce("label", F.lit(0)).cast("int").alias("response_label"), F.col("item_id").alias("source_id"), F.col("start").cast("bigint").alias("context_start"), F.col("end").cast("bigint").alias("context_end"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return checks.duplicate_keys(table(spark, d, "events"), "user_id", "event_type")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_responses(spark, d):
    return checks.orphans(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")


@query(f"""WITH {RESPONSES} SELECT count(*) AS n_missing, array_to_string(list_sort(list(response_id ORDER BY response_id))[1:5], ', ') AS first_missing
  FROM responses WHERE split = 'test' AND label IS NULL""")
def missing_shards(spark, d):
    """Expected test shards that are not complete: how many, and the first five."""
    expected = responses(spark, d).where("split = 'test'").select("response_id")
    done = responses(spark, d).where("label is not null").select("response_id")
    gone = checks.orphans(expected, done, "response_id")
    first = gone.orderBy("response_id").limit(5).agg(F.array_join(F.array_sort(F.collect_list("response_id")), ", ").alias("first_missing"))
    return gone.agg(F.count("*").alias("n_missing")).crossJoin(first)


@query(f"WITH {RESPONSES} SELECT response_id, split FROM responses WHERE label IS NULL OR quality <> 'good'")
def pending(spark, d):
    """Examples without a complete, compatible shard."""
    rows = responses(spark, d)
    complete = rows.where("label is not null and quality = 'good'")
    return checks.orphans(rows.select("response_id", "split"), complete, "response_id")


@query(f"""WITH {RESPONSES} SELECT split, count(*) FILTER (WHERE task = 'en') AS en, count(*) FILTER (WHERE task = 'de') AS de,
  count(*) FILTER (WHERE task = 'fr') AS fr, count(*) FILTER (WHERE task = 'es') AS es FROM responses GROUP BY split""")
def counts_pivot(spark, d):
    return responses(spark, d).groupBy("split").pivot("task", TASKS).count().na.fill(0)


@query(f"""WITH {RESPONSES} SELECT s.split, t.task, count(r.response_id) AS n_responses, CAST(coalesce(sum(r.label), 0) AS BIGINT) AS n_positive,
  count(r.response_id) FILTER (WHERE r.quality <> 'good') AS n_truncated
  FROM (VALUES ('train'), ('test')) s(split) CROSS JOIN (VALUES ('en'), ('de'), ('fr'), ('es')) t(task)
  LEFT JOIN responses r ON r.split = s.split AND r.task = t.task GROUP BY s.split, t.task""")
def audit_stats(spark, d):
    """Counts of each split and task, with zeros for those that have no rows."""
    found = responses(spark, d).groupBy("split", "task").agg(F.count("*").alias("n_responses"), F.sum("label").alias("n_positive"), F.count_if(F.col("quality") != "good").alias("n_truncated"))
    cells = spark.createDataFrame([(s, t) for s in ("train", "test") for t in TASKS], "split string, task string")
    return cells.join(found, ["split", "task"], "left").na.fill(0)


_RANKED = f"""{RESPONSES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY sha256('{SEED}' || chr(0) || task || chr(0) || response_id), doc_id) AS rk
  FROM responses WHERE split = 'train')"""


@query(f"WITH {_RANKED} SELECT sha256(string_agg(response_id, chr(10) ORDER BY response_id)) AS digest, count(*) AS n FROM ranked WHERE rk <= {DEV}")
def dev_ids_digest(spark, d):
    """The digest of the dev ids in order; a fixed number of them for each task, by design."""
    dev = splits.dev_split(responses(spark, d).where("split = 'train'"), DEV, SEED).where("is_dev = 1")
    return dev.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("response_id")), "\n"), 256).alias("digest"), F.count("*").alias("n"))


@query(f"""WITH {_RANKED} SELECT (SELECT count(*) FROM responses) AS n_responses, (SELECT count(*) FROM responses WHERE split = 'test') AS n_test,
  (SELECT count(*) FROM ranked WHERE rk <= {DEV}) AS n_dev, (SELECT count(*) FROM ranked WHERE rk > {DEV}) AS n_calibration_train,
  (SELECT CAST(sum(label) AS BIGINT) FROM responses) AS n_positive, (SELECT count(*) FROM responses WHERE quality <> 'good') AS n_truncated""")
def audit(spark, d):
    """The audit's sizes in one pass over the partitioned examples."""
    rows = splits.partitions(responses(spark, d), DEV, SEED)
    of = lambda name: F.count_if(F.col("eval_split") == name).alias(f"n_{name}")
    return rows.agg(F.count("*").alias("n_responses"), of("test"), of("dev"), of("calibration_train"), F.sum("label").alias("n_positive"), F.count_if(F.col("quality") != "good").alias("n_truncated"))


@query("SELECT 'customer' AS shard, c_custkey AS id, c_acctbal AS value FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier UNION ALL SELECT 'part', p_partkey, p_retailprice FROM part")
def union_shards(spark, d):
    one = lambda name, key, value: table(spark, d, name).select(F.lit(name).alias("shard"), F.col(key).alias("id"), F.col(value).alias("value"))
    return one("customer", "c_custkey", "c_acctbal").unionByName(one("supplier", "s_suppkey", "s_acctbal")).unionByName(one("part", "p_partkey", "p_retailprice"))


@query(f"""WITH {TOKENS} SELECT 'all' AS subset, task, count(*) AS n, round(avg(score), 9) AS mean FROM tokens GROUP BY task
  UNION ALL SELECT 'quality_good', task, count(*), round(avg(score), 9) FROM tokens WHERE quality = 'good' GROUP BY task""")
def union_results(spark, d):
    rows = tokens(spark, d)
    summary = lambda x: x.groupBy("task").agg(F.count("*").alias("n"), F.round(F.avg("score"), 9).alias("mean"))
    return evaluation.tag(summary(rows), subset="all").unionByName(evaluation.tag(summary(rows.where("quality = 'good'")), subset="quality_good"))


@query("SELECT 'all' AS subset, 'standard' AS mode, n_nationkey, n_name FROM nation")
def tag_subset(spark, d):
    return evaluation.tag(table(spark, d, "nation").select("n_nationkey", "n_name"), subset="all", mode="standard")


@query(f"WITH {RESPONSES} SELECT response_id, task FROM responses WHERE quality = 'good'")
def quality_good(spark, d):
    return responses(spark, d).where("quality = 'good'").select("response_id", "task")


@query(f"WITH {TOKENS} SELECT token_index, task, score FROM tokens WHERE task IN ('click', 'view')")
def filter_task(spark, d):
    return tokens(spark, d).where(F.col("task").cast("string").isin("click", "view")).select("token_index", "task", "score")


@query(f"WITH {RESPONSES} SELECT response_id, task, quality FROM responses WHERE split = 'test'")
def filter_split(spark, d):
    return responses(spark, d).where("split = 'test'").select("response_id", "task", "quality")


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def metadata_projection(spark, d):
    """Metadata only: the texts are never read from the file."""
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")


@query(f"WITH {TOKENS} SELECT count(DISTINCT (task, response_id)) AS n_responses FROM tokens")
def response_count(spark, d):
    return tokens(spark, d).agg(F.count_distinct("task", "response_id").alias("n_responses"))


@query(f"""WITH {TOKENS} SELECT task, response_id FROM tokens WHERE label = 1 AND score > 100 INTERSECT SELECT task, response_id FROM tokens WHERE label = 0 AND score > 100""")
def leakage_intersect(spark, d):
    rows = tokens(spark, d).where("score > 100")
    return checks.shared_keys(rows.where("label = 1"), rows.where("label = 0"), "task", "response_id")


@query(f"""WITH {RESPONSES} SELECT 'label' AS "column", count(*) FILTER (WHERE label IS NULL OR label NOT IN (0, 1)) AS bad FROM responses
  UNION ALL SELECT 'doc_id', count(*) FILTER (WHERE doc_id IS NULL OR doc_id NOT IN (0, 1)) FROM responses""")
def check_binary(spark, d):
    return checks.bad_binary(responses(spark, d), "label", "doc_id")


@query("""SELECT 'ratio' AS "column", count(*) FILTER (WHERE l_discount = 0) AS bad FROM lineitem UNION ALL SELECT 'l_tax', count(*) FILTER (WHERE l_tax IS NULL) FROM lineitem""")
def check_finite(spark, d):
    rows = table(spark, d, "lineitem").select(F.try_divide("l_extendedprice", "l_discount").alias("ratio"), "l_tax")
    return checks.bad_finite(rows, "ratio", "l_tax")


@query(f"""WITH {RESPONSES} SELECT 'split' AS "column", count(*) FILTER (WHERE lower(split) = 'test') AS n FROM responses
  UNION ALL SELECT 'source_split', count(*) FILTER (WHERE lower(model) = 'test') FROM responses""")
def check_no_test(spark, d):
    return checks.test_rows(responses(spark, d).withColumn("source_split", F.upper("model")))


@query(f"WITH {TOKENS} SELECT task, response_id, min(label) AS low, max(label) AS high FROM tokens GROUP BY task, response_id HAVING min(label) <> max(label)")
def check_label_consistency(spark, d):
    return checks.label_conflicts(tokens(spark, d), ["task", "response_id"], "label")


@query(f"""WITH {TOKENS}, a AS (SELECT task, response_id, max(label) AS label_a FROM tokens WHERE score > 100 GROUP BY ALL),
  b AS (SELECT task, response_id, max(label) AS label_b FROM tokens WHERE score <= 100 GROUP BY ALL)
  SELECT task, response_id, label_a, label_b FROM a JOIN b USING (task, response_id) WHERE label_a <> label_b""")
def check_label_agreement(spark, d):
    rows = tokens(spark, d)
    return checks.label_disagreements(rows.where("score > 100"), rows.where("score <= 100"), ["task", "response_id"], "label")


@query("""SELECT doc_id, 'lang' AS path, lang AS expected FROM documents WHERE lang <> 'en' UNION ALL SELECT doc_id, 'source', source FROM documents WHERE source = 'src1'""")
def manifest_subset(spark, d):
    """Expected manifest entries (path, value) that the actual manifests lack."""
    docs = table(spark, d, "documents")
    entries = lambda df: df.select("doc_id", F.inline(F.array(*[F.struct(F.lit(c).alias("path"), F.col(c).alias("expected")) for c in ("lang", "source")])))
    actual = docs.select("doc_id", F.lit("en").alias("lang"), F.when(F.col("source") != "src1", F.col("source")).alias("source"))
    return entries(docs).join(entries(actual), ["doc_id", "path", "expected"], "left_anti")


@query(f"""WITH {RESPONSES} SELECT task, split, count(*) AS n_rows, CAST(7 AS BIGINT) AS n_columns, CAST(sum(length(response)) AS BIGINT) AS n_chars,
  sha256(string_agg(response_id, chr(10) ORDER BY doc_id)) AS ids_sha256 FROM responses GROUP BY task, split""")
def shard_manifest(spark, d):
    """A manifest row a shard: rows, columns, size, and a digest over its ids in order."""
    rows = responses(spark, d)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "response_id"))), lambda x: x["response_id"])
    return rows.groupBy("task", "split").agg(F.count("*").alias("n_rows"), F.lit(7).cast("bigint").alias("n_columns"), F.sum(F.length("response")).alias("n_chars"), F.sha2(F.array_join(ids, "\n"), 256).alias("ids_sha256"))


@query(f"""WITH {RESPONSES} SELECT response_id, task, sha256(response) AS response_sha256, length(response) AS n_chars FROM responses""")
def shard_roundtrip(spark, d):
    """Each response's digest, as a shard's reader checks it against the manifest."""
    return responses(spark, d).select("response_id", "task", F.sha2("response", 256).alias("response_sha256"), F.length("response").cast("bigint").alias("n_chars"))


@query(f"""WITH {RESPONSES} SELECT response_id, task, split, CASE WHEN split = 'test' THEN 'test' WHEN rk <= {DEV} THEN 'dev' ELSE 'calibration_train' END AS eval_split
  FROM (SELECT *, row_number() OVER (PARTITION BY split, task ORDER BY sha256('{SEED}' || chr(0) || task || chr(0) || response_id), doc_id) AS rk FROM responses)""")
def partitions(spark, d):
    return splits.partitions(responses(spark, d), DEV, SEED).select("response_id", "task", "split", "eval_split")


@query(f"WITH {_RANKED} SELECT response_id, task, CAST(rk <= {DEV} AS INT) AS is_dev FROM ranked")
def dev_split(spark, d):
    return splits.dev_split(responses(spark, d).where("split = 'train'"), DEV, SEED).select("response_id", "task", "is_dev")


@query(f"""WITH {RESPONSES} SELECT response_id, ordinal FROM (SELECT response_id, row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'test' THEN 1 ELSE 2 END,
  CASE task WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 WHEN 'es' THEN 3 ELSE 4 END, doc_id) - 1 AS ordinal FROM responses) WHERE ordinal % 4 = 1""")
def work_shard(spark, d):
    order = splits.example_order(["train", "test"], TASKS)
    return splits.work_shard(responses(spark, d).select("response_id", "split", "task"), 4, 1, order).select("response_id", F.col("ordinal").cast("bigint").alias("ordinal"))


@query(f"""WITH {RESPONSES} SELECT response_id, row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'test' THEN 1 ELSE 2 END,
  CASE task WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 WHEN 'es' THEN 3 ELSE 4 END, doc_id) AS place FROM responses""")
def ordered_examples(spark, d):
    order = splits.example_order(["train", "test"], TASKS)
    return splits.in_total_order(responses(spark, d).select("response_id", "split", "task"), order, "place").select("response_id", F.col("place").cast("bigint").alias("place"))


@query("""SELECT id, row_number() OVER (ORDER BY CASE WHEN regexp_matches(id, '^[0-9]+$') THEN 0 ELSE 1 END, CASE WHEN regexp_matches(id, '^[0-9]+$') THEN CAST(id AS BIGINT) END, id) AS place
  FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN source || '-' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS id FROM documents)""")
def natural_order(spark, d):
    from ..functions.texts import natural_key

    ids = table(spark, d, "documents").select(F.when(F.col("doc_id") % 3 == 0, F.concat_ws("-", "source", "doc_id")).otherwise(F.col("doc_id").cast("string")).alias("id"))
    return splits.in_total_order(ids, natural_key("id"), "place").select("id", F.col("place").cast("bigint").alias("place"))


@query("""SELECT url, CASE WHEN base = url THEN base ELSE base || '-' || substr(sha256(url), 1, 10) END AS shard FROM
  (SELECT url, regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS base FROM pages)""")
def safe_shard_name(spark, d):
    return table(spark, d, "pages").select("url", safe_name("url").alias("shard"))


@query("""SELECT 'left' AS side, doc_id, lang FROM (SELECT doc_id, lang FROM documents EXCEPT ALL SELECT doc_id, 'en' FROM documents)
  UNION ALL SELECT 'right', doc_id, lang FROM (SELECT doc_id, 'en' AS lang FROM documents EXCEPT ALL SELECT doc_id, lang FROM documents)""")
def frame_equal(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return checks.frame_difference(docs, docs.withColumn("lang", F.lit("en")))
