"""Queries of vectors: products, divergences, attention, context scores, copy heads."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import attention
from .registry import SEQUENCES, SIZE, Catalogue, sequences, table

catalogue = Catalogue()
query = catalogue.add
NEXT = f"""{SEQUENCES}, pairs AS (SELECT a.response, a.position, a.vec_id, a.v AS a, b.v AS b FROM seqs a JOIN seqs b ON a.response = b.response AND b.position = a.position + 1)"""


def neighbours(spark, d):
    """Each vector with the one after it in its response: the states before and after a layer."""
    rows = sequences(spark, d)
    return rows.withColumn("b", F.lead("embedding").over(W.partitionBy("response").orderBy("position"))).where("b is not null").withColumnRenamed("embedding", "a")


@query(f"WITH {NEXT} SELECT vec_id, round(list_inner_product(a, b), 9) AS value FROM pairs")
def dot(spark, d):
    return neighbours(spark, d).select("vec_id", F.round(vectors.dot("a", "b"), 9).alias("value"))


@query(f"WITH {NEXT} SELECT vec_id, round(list_cosine_similarity(a, b), 9) AS value FROM pairs")
def cosine(spark, d):
    return neighbours(spark, d).select("vec_id", F.round(vectors.cosine("a", "b"), 9).alias("value"))


@query(f"WITH {SEQUENCES}, m AS (SELECT response, i, avg(v[i]) AS x FROM seqs, range(1, {SIZE + 1}) r(i) GROUP BY response, i) SELECT response, CAST(i - 1 AS INT) AS i, round(x, 9) AS value FROM m")
def mean_pool(spark, d):
    found = attention.mean_vectors(sequences(spark, d), ["response"], "embedding", SIZE)
    return found.select("response", F.posexplode("mean").alias("i", "value")).withColumn("value", F.round("value", 9))


@query(f"WITH {SEQUENCES} SELECT vec_id, round(v[1] / sqrt(list_inner_product(v, v) / {SIZE} + 1e-6), 9) AS first, round(v[{SIZE}] / sqrt(list_inner_product(v, v) / {SIZE} + 1e-6), 9) AS last FROM seqs")
def rms_norm(spark, d):
    return sequences(spark, d).select("vec_id", vectors.rms_norm("embedding").alias("n")).select("vec_id", F.round(F.col("n")[0], 9).alias("first"), F.round(F.col("n")[SIZE - 1], 9).alias("last"))


@query(f"WITH {SEQUENCES}, z AS (SELECT vec_id, max(v[i]) AS top, ln(sum(exp(v[i]))) AS lse, max(v[1]) AS x FROM seqs, range(1, {SIZE + 1}) r(i) GROUP BY vec_id) SELECT vec_id, round(x - lse, 9) AS first, round(top - lse, 9) AS best FROM z")
def log_softmax(spark, d):
    return sequences(spark, d).select("vec_id", vectors.log_softmax("embedding").alias("p")).select("vec_id", F.round(F.col("p")[0], 9).alias("first"), F.round(F.array_max("p"), 9).alias("best"))


_JSD = f"""{NEXT}, long AS (SELECT vec_id, response, position, exp(4 * a[i]) / sum(exp(4 * a[i])) OVER (PARTITION BY vec_id) AS p, exp(4 * b[i]) / sum(exp(4 * b[i])) OVER (PARTITION BY vec_id) AS q FROM pairs, range(1, {SIZE + 1}) r(i)),
  divergence AS (SELECT response, position, vec_id, sum((p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2) AS standard,
  avg(((p + q) / 2 * ln((p + q) / 2 / p) + (p + q) / 2 * ln((p + q) / 2 / q)) / 2) * 1e6 AS legacy FROM long GROUP BY ALL)"""


def logits(spark, d):
    scaled = lambda c: F.transform(c, lambda v: v.cast("double") * 4)
    return neighbours(spark, d).withColumns({"a": scaled("a"), "b": scaled("b")})


@query(f"WITH {_JSD} SELECT vec_id, round(least(greatest(standard, 0), ln(2)), 9) AS value FROM divergence")
def jsd_standard(spark, d):
    return logits(spark, d).select("vec_id", F.round(vectors.jsd_standard("a", "b"), 9).alias("value"))


@query(f"WITH {_JSD} SELECT vec_id, round(greatest(legacy, 0), 5) AS value FROM divergence")
def jsd_legacy(spark, d):
    return logits(spark, d).select("vec_id", F.round(vectors.jsd_legacy("a", "b"), 5).alias("value"))


@query(f"WITH {_JSD} SELECT vec_id, round(standard, 9) AS value FROM divergence")
def jsd_blocked(spark, d):
    """The divergence by vocabulary blocks: partition functions first, then sums, as partial aggregates."""
    rows = logits(spark, d).select("vec_id", F.posexplode(F.arrays_zip("a", "b")).alias("i", "x")).select("vec_id", F.floor(F.col("i") / 16).alias("block"), F.col("x.a").alias("a"), F.col("x.b").alias("b"))
    top = rows.groupBy("vec_id", "block").agg(F.max("a").alias("ta"), F.max("b").alias("tb")).groupBy("vec_id").agg(F.max("ta").alias("ta"), F.max("tb").alias("tb"))
    shifted = rows.join(top, "vec_id")
    whole = shifted.groupBy("vec_id").agg(F.sum(F.exp(F.col("a") - F.col("ta"))).alias("za"), F.sum(F.exp(F.col("b") - F.col("tb"))).alias("zb"))
    both = shifted.join(whole, "vec_id").withColumns({"p": F.exp(F.col("a") - F.col("ta")) / F.col("za"), "q": F.exp(F.col("b") - F.col("tb")) / F.col("zb")})
    m = (F.col("p") + F.col("q")) / 2
    return both.groupBy("vec_id").agg(F.round(F.sum((F.col("p") * F.log(F.col("p") / m) + F.col("q") * F.log(F.col("q") / m)) / 2), 9).alias("value"))


@query(f"WITH {_JSD} SELECT response, position, 'pks_standard_l' || response AS feature, round(least(greatest(standard, 0), ln(2)), 9) AS standard, round(greatest(legacy, 0), 5) AS legacy FROM divergence")
def pks(spark, d):
    """The parametric knowledge score of each layer (response) and position, in both modes."""
    rows = logits(spark, d)
    return rows.select("response", "position", F.format_string("pks_standard_l%d", "response").alias("feature"), F.round(vectors.jsd_standard("a", "b"), 9).alias("standard"), F.round(vectors.jsd_legacy("a", "b"), 5).alias("legacy"))


_CAUSAL = f"{SEQUENCES}, causal AS (SELECT q.response, q.position AS query, k.position AS key_position, q.v AS qv, k.v AS kv FROM seqs q JOIN seqs k ON q.response = k.response AND k.position <= q.position AND k.position > q.position - 8)"


def _causal(spark, d):
    return attention.causal_pairs(sequences(spark, d), "response", "position", 8, ("embedding",))


@query(f"WITH {SEQUENCES} SELECT q.response, q.position AS query, k.position AS key_position FROM seqs q JOIN seqs k ON q.response = k.response AND k.position <= q.position AND k.position > q.position - 8")
def causal_pairs(spark, d):
    return attention.causal_pairs(sequences(spark, d), "response", "position", 8)


@query(f"""WITH {SEQUENCES}, held AS (SELECT response, position, vec_id, row_number() OVER (PARTITION BY response ORDER BY position) - 1 AS place FROM seqs)
  SELECT h.response, h.position, h.vec_id, h.place FROM held h JOIN seqs w ON w.response = h.response AND h.position = w.position WHERE w.position % 2 = 0""")
def gather_positions(spark, d):
    rows = sequences(spark, d)
    return attention.gather(rows.where("position % 2 = 0").select("response", "position"), rows, ["response"], "position", "vec_id").withColumn("place", F.col("place").cast("bigint"))


_WEIGHTS = f"{_CAUSAL}, weighted AS (SELECT *, list_inner_product(qv, kv) / 8 AS logit FROM causal), soft AS (SELECT *, exp(logit) / sum(exp(logit)) OVER (PARTITION BY response, query) AS weight FROM weighted)"


def _soft(spark, d):
    return attention.attention(_causal(spark, d), ["response", "query"], "q_embedding", "k_embedding", 1 / 8)


@query(f"WITH {_WEIGHTS} SELECT response, query, key_position, round(weight, 9) AS weight FROM soft")
def attention_scores(spark, d):
    return _soft(spark, d).select("response", "query", "key_position", F.round("weight", 9).alias("weight"))


_TOP = f"{_WEIGHTS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY response, query ORDER BY round(weight, 12) DESC, key_position) AS rk, count(*) OVER (PARTITION BY response, query) AS n FROM soft), best AS (SELECT * FROM ranked WHERE rk <= greatest(1, floor(n * CAST(0.4 AS DOUBLE))))"


@query(f"WITH {_TOP} SELECT response, query, key_position, CAST(rk AS INT) AS rank FROM best")
def top_fraction(spark, d):
    rows = _soft(spark, d).withColumn("weight", F.round("weight", 12))
    return attention.top_fraction(rows, ["response", "query"], "weight", "key_position", 0.4).select("response", "query", "key_position", "rank")


@query(f"WITH {_TOP}, pooled AS (SELECT response, query, any_value(qv) AS qv, i, avg(kv[i]) AS m FROM best, range(1, {SIZE + 1}) r(i) GROUP BY response, query, i) SELECT response, query, round(sum(qv[i] * m) / (sqrt(sum(qv[i] * qv[i])) * sqrt(sum(m * m))), 9) AS ecs FROM pooled GROUP BY response, query")
def ecs(spark, d):
    rows = _soft(spark, d).withColumn("weight", F.round("weight", 12))
    found = attention.external_context_score(rows, ["response", "query"], "weight", "key_position", "q_embedding", "k_embedding", SIZE, 0.4)
    return found.withColumn("ecs", F.round("ecs", 9))


@query("SELECT vec_id, label AS head, CAST(label // 4 AS INT) AS kv_head FROM embeddings")
def gqa_map(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("label").alias("head"), attention.kv_head("label", 4).alias("kv_head"))


_GRAM = f"{NEXT}, g AS (SELECT CAST(i - 1 AS INT) AS i, CAST(j - 1 AS INT) AS j, sum(a[i] * b[j]) AS value FROM pairs, range(1, {SIZE + 1}) x(i), range(1, {SIZE + 1}) y(j) GROUP BY i, j)"


@query(f"WITH {_GRAM} SELECT i, j, round(value, 8) AS value FROM g")
def gram(spark, d):
    return attention.gram(neighbours(spark, d), "a", "b", SIZE).withColumn("value", F.round("value", 8))


@query(f"WITH {_GRAM} SELECT round(sum(x.value * y.value), 6) AS trace FROM g x JOIN g y ON x.i = y.j AND x.j = y.i")
def trace_gram(spark, d):
    g = attention.gram(neighbours(spark, d), "a", "b", SIZE)
    return attention.trace_of_product(g, g).select(F.round("trace", 6).alias("trace"))


#: A matrix of thrice the sampled size.
SCALE = 3.0
_CELLS = f"{SEQUENCES}, cells AS (SELECT response, CAST(position % {SIZE} AS INT) AS i, CAST(k - 1 AS INT) AS j, sum(v[k]) AS value FROM seqs, range(1, {SIZE} + 1) r(k) GROUP BY ALL)"
_DISKS = f"""{_CELLS}, disks AS (SELECT response, i, max(value) FILTER (WHERE i = j) AS center, sum(abs(value)) FILTER (WHERE i <> j) * {SCALE} AS radius FROM cells GROUP BY response, i),
  points AS (SELECT response, radius, unnest([center - radius, center + radius]) AS point FROM disks),
  fences AS (SELECT response, quantile_cont(point, 0.25) AS q1, quantile_cont(point, 0.75) AS q3, avg(radius) AS mean_radius, max(radius) AS max_radius FROM points GROUP BY response),
  found AS (SELECT response, q1, q3, mean_radius, max_radius, count(*) FILTER (WHERE point < q1 - 1.5 * (q3 - q1) OR point > q3 + 1.5 * (q3 - q1)) AS n_outliers FROM points JOIN fences USING (response) GROUP BY ALL)"""


def _cells(spark, d):
    """Small matrices by response: sums of the states' elements by position modulo their size."""
    rows = sequences(spark, d).select("response", (F.col("position") % SIZE).alias("i"), F.posexplode("embedding").alias("j", "x"))
    return rows.groupBy("response", "i", "j").agg(F.sum(F.col("x").cast("double")).alias("value"))


@query(f"WITH {_DISKS} SELECT response, round(q1, 8) AS q1, round(q3, 8) AS q3, round(mean_radius, 8) AS mean_radius, round(max_radius, 8) AS max_radius, n_outliers FROM found")
def gershgorin(spark, d):
    found = attention.gershgorin(_cells(spark, d), ["response"], F.lit(SCALE))
    return found.select("response", *[F.round(c, 8).alias(c) for c in ("q1", "q3", "mean_radius", "max_radius")], "n_outliers")


@query(f"""WITH {_DISKS}, heads AS (SELECT c.response // 5 AS layer, c.response % 5 AS head, abs(sum(value) FILTER (WHERE i = j)) AS absolute_trace, max(n_outliers) AS n_outliers FROM cells c JOIN found USING (response) GROUP BY c.response),
  ranks AS (SELECT *, row_number() OVER (ORDER BY absolute_trace DESC, layer, head) AS tr, row_number() OVER (ORDER BY n_outliers, layer, head) AS orank FROM heads)
  SELECT CAST(layer AS INT) AS layer, CAST(head AS INT) AS head, round(absolute_trace, 8) AS absolute_trace, n_outliers, CAST(tr AS INT) AS trace_rank, CAST(orank AS INT) AS outlier_rank, CAST(tr + orank AS INT) AS rank_sum,
  CAST(row_number() OVER (ORDER BY tr + orank, absolute_trace DESC, n_outliers, layer, head) AS INT) AS copying_rank FROM ranks""")
def copy_head_rank(spark, d):
    cells = _cells(spark, d)
    traces = cells.groupBy("response").agg(F.abs(F.sum(F.when(F.col("i") == F.col("j"), F.col("value")))).alias("absolute_trace"))
    heads = traces.join(attention.gershgorin(cells, ["response"], F.lit(SCALE)).select("response", "n_outliers"), "response")
    ranked = attention.rank_copy_heads(heads.select(F.floor(F.col("response") / 5).cast("int").alias("layer"), (F.col("response") % 5).cast("int").alias("head"), "absolute_trace", "n_outliers"))
    return ranked.withColumn("absolute_trace", F.round("absolute_trace", 8))


@query(f"WITH {SEQUENCES} SELECT response, count(DISTINCT position) = count(*) AND min(position) >= 0 AND max(position) < 10000000 AS ok, count(*) AS n FROM seqs GROUP BY response")
def positions_valid(spark, d):
    rows = sequences(spark, d).groupBy("response").agg(F.count_distinct("position").alias("k"), F.count("*").alias("n"), F.min("position").alias("low"), F.max("position").alias("high"))
    return rows.select("response", ((F.col("k") == F.col("n")) & (F.col("low") >= 0) & (F.col("high") < 10000000)).alias("ok"), "n")


_NAMES = "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'ecs_l' || (vec_id % 12) || '_h' || label WHEN vec_id % 3 = 1 THEN 'pks_standard_l' || (vec_id % 12) ELSE 'other' || vec_id END AS feature FROM embeddings"


@query("SELECT vec_id, 'ecs_l' || (vec_id % 12) || '_h' || label AS ecs, 'pks_legacy_l' || (vec_id % 12) AS pks FROM embeddings")
def feature_names(spark, d):
    from ..operators.calibration import head_feature, layer_feature

    layer = F.col("vec_id") % 12
    return table(spark, d, "embeddings").select("vec_id", head_feature(layer, F.col("label")).alias("ecs"), layer_feature(layer, "pks_legacy").alias("pks"))


@query(f"WITH names AS ({_NAMES}) SELECT feature, CAST(regexp_extract(feature, '_l([0-9]+)', 1) AS INT) AS layer, CASE WHEN feature LIKE 'ecs%' THEN CAST(regexp_extract(feature, '_h([0-9]+)', 1) AS INT) ELSE -1 END AS head, count(*) AS n FROM names WHERE regexp_full_match(feature, 'ecs_l[0-9]+_h[0-9]+|pks_standard_l[0-9]+') GROUP BY ALL")
def discover_columns(spark, d):
    """Feature names that match the grammar, with their layer and head as numbers."""
    from ..operators.calibration import GRAMMAR, head_feature, layer_feature

    heads, layers = GRAMMAR["standard"]
    at = F.col("vec_id") % 12
    name = F.when(F.col("vec_id") % 3 == 0, head_feature(at, F.col("label"))).when(F.col("vec_id") % 3 == 1, layer_feature(at)).otherwise(F.concat(F.lit("other"), "vec_id"))
    rows = table(spark, d, "embeddings").select(name.alias("feature")).where(F.col("feature").rlike(f"^({heads}|{layers})$"))
    layer = F.regexp_extract("feature", r"_l(\d+)", 1).cast("int")
    head = F.when(F.col("feature").startswith("ecs"), F.regexp_extract("feature", r"_h(\d+)", 1).cast("int")).otherwise(-1)
    return rows.groupBy("feature", layer.alias("layer"), head.alias("head")).agg(F.count("*").alias("n"))
