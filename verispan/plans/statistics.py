"""Queries of AUC, bootstrap, calibration and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import minmax
from ..operators import auc, bootstrap, calibration, evaluation
from .registry import EVENT_TASKS, FEATURE_TASKS, FEATURES, HEADS, LAYERS, TOKENS, Catalogue, auc_sql, features, in_list, table, tokens

catalogue = Catalogue()
query = catalogue.add
REPS, SEED = 1000, 42
LISTED = in_list(EVENT_TASKS)


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


def nudged(df, *columns):
    """Rounded, with ties of small fractions made to go up whatever the engine's order of operations."""
    return df.withColumns({c: F.round(F.col(c) + 1e-12, 9) for c in columns})


def nudge(sql: str) -> str:
    return sql.replace(", 9)", " + 1e-12, 9)")


_R = "round(auc, 9) AS auc"


@query(f"WITH {TOKENS} SELECT task, {_R}, round(n_positive, 6) AS n_positive, round(n_negative, 6) AS n_negative FROM ({auc_sql('tokens', 'task', weight='weight')})")
def auc_weighted(spark, d):
    return rounded(auc.roc_auc(tokens(spark, d), ["task"], weight="weight"), "auc", "n_positive", "n_negative")


@query(f"WITH {TOKENS} SELECT task, {_R} FROM ({auc_sql('tokens', 'task')})")
def auc_by_task(spark, d):
    return rounded(auc.roc_auc(tokens(spark, d), ["task"]), "auc").select("task", "auc")


@query(f"WITH {TOKENS} SELECT CASE WHEN count(auc) = 3 THEN round(avg(auc), 9) END AS macro_auc, count(*) AS n_tasks FROM ({auc_sql('(SELECT * FROM tokens WHERE task IN (' + LISTED + '))', 'task')})")
def auc_macro(spark, d):
    found = auc.roc_auc(tokens(spark, d).where(F.col("task").isin(EVENT_TASKS)), ["task"])
    return found.agg(F.round(auc.strict_mean("auc", len(EVENT_TASKS)), 9).alias("macro_auc"), F.count("*").alias("n_tasks"))


_MEANS = "means AS (SELECT task, response_id, avg(score) AS mean_score, max(response_label) AS response_label, count(*) AS n_tokens, CAST(sum(label) AS BIGINT) AS n_positive_tokens FROM tokens GROUP BY task, response_id)"


@query(f"WITH {TOKENS}, {_MEANS} SELECT task, response_id, round(mean_score, 9) AS mean_score, response_label, n_tokens, n_positive_tokens FROM means")
def response_mean_score(spark, d):
    return rounded(evaluation.response_means(tokens(spark, d)), "mean_score")


_COUNTS = f"""{_MEANS}, scoped AS (SELECT task AS scope, * FROM means WHERE task IN ({LISTED}) UNION ALL SELECT 'Overall', * FROM means),
  counts AS (SELECT scope, count(*) AS n_responses, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, CAST(sum(n_positive_tokens) AS BIGINT) AS n_positive_tokens,
  CAST(sum(n_tokens) - sum(n_positive_tokens) AS BIGINT) AS n_negative_tokens, CAST(sum(response_label) AS BIGINT) AS n_positive_responses, CAST(count(*) - sum(response_label) AS BIGINT) AS n_negative_responses FROM scoped GROUP BY scope),
  all_counts AS (SELECT * FROM counts UNION ALL SELECT 'TaskMacro', CAST(sum(n_responses) AS BIGINT), CAST(sum(n_tokens) AS BIGINT), CAST(sum(n_positive_tokens) AS BIGINT), CAST(sum(n_negative_tokens) AS BIGINT),
  CAST(sum(n_positive_responses) AS BIGINT), CAST(sum(n_negative_responses) AS BIGINT) FROM counts WHERE scope <> 'Overall')"""


@query(f"WITH {TOKENS}, {_COUNTS} SELECT * FROM all_counts")
def scope_counts(spark, d):
    return evaluation.scope_counts(tokens(spark, d), EVENT_TASKS)


@query(f"WITH {TOKENS} SELECT task, response_id, row_number() OVER (PARTITION BY task ORDER BY response_id) - 1 AS cluster_idx FROM (SELECT DISTINCT task, response_id FROM tokens)")
def cluster_index(spark, d):
    return bootstrap.cluster_index(tokens(spark, d), ["task"], "response_id").drop("n_clusters")


def seed_sql(scope: str, seed: int = SEED) -> str:
    """SQL of a scope's seed, in decimal digits."""
    pairs = " || ".join(f"substr(sha256('{seed}:' || {scope}), {k}, 2)" for k in range(15, 0, -2))
    return f"CAST(CAST('0x' || {pairs} AS UBIGINT) AS VARCHAR)"


@query(f"WITH {TOKENS} SELECT task, {seed_sql('task')} AS seed FROM (SELECT DISTINCT task FROM tokens)")
def scope_seeds(spark, d):
    return tokens(spark, d).select("task").distinct().select("task", bootstrap.scope_seeds(SEED, F.col("task")).alias("seed"))


def draws_sql(sizes: str, reps: int = REPS, seed: int = SEED) -> str:
    """SQL of draws for a relation (scope, n_clusters)."""
    return f"""SELECT scope, rep, cluster_idx, count(*) AS w FROM (SELECT scope, rep, CAST('0x' || substr(hash, 1 + 8 * CAST(word AS BIGINT), 8) AS BIGINT) % n_clusters AS cluster_idx
  FROM (SELECT *, unnest(range(0, least(8, n_clusters - 8 * pos))) AS word FROM (SELECT *, sha256(seed || ':' || rep || ':' || pos) AS hash
  FROM (SELECT *, unnest(range(0, (n_clusters + 7) // 8)) AS pos FROM (SELECT *, {seed_sql("scope", seed)} AS seed, unnest(range(0, {reps})) AS rep FROM {sizes}))))) GROUP BY scope, rep, cluster_idx"""


_SIZES = "sizes AS (SELECT task AS scope, count(DISTINCT response_id) AS n_clusters FROM tokens GROUP BY task)"


@query(f"WITH {TOKENS}, {_SIZES} SELECT scope AS task, CAST(rep AS INT) AS rep, cluster_idx, w FROM ({draws_sql('sizes')})")
def bootstrap_weights(spark, d):
    sizes = tokens(spark, d).groupBy("task").agg(F.count_distinct("response_id").alias("n_clusters"))
    return bootstrap.draws(sizes, ["task"], REPS, SEED, F.col("task"))


_BOOT = f"""{_SIZES}, idx AS (SELECT task AS scope, response_id, row_number() OVER (PARTITION BY task ORDER BY response_id) - 1 AS cluster_idx FROM (SELECT DISTINCT task, response_id FROM tokens)),
  drawn AS MATERIALIZED ({draws_sql('sizes')}), weighted AS MATERIALIZED (SELECT t.task, d.rep, t.label, t.score, d.w FROM tokens t JOIN idx i ON i.scope = t.task AND i.response_id = t.response_id JOIN drawn d ON d.scope = i.scope AND d.cluster_idx = i.cluster_idx),
  boot AS MATERIALIZED ({auc_sql('weighted', 'task, rep', weight='w')})"""


@query(nudge(f"WITH {TOKENS}, {_BOOT} SELECT task, CAST(rep AS INT) AS rep, {_R} FROM boot"))
def bootstrap_auc(spark, d):
    return nudged(bootstrap.bootstrap_auc(tokens(spark, d), "task", "response_id", REPS, SEED), "auc")


@query(nudge(f"WITH {TOKENS}, {_BOOT} SELECT task, round(quantile_cont(auc, 0.025), 9) AS ci_low, round(quantile_cont(auc, 0.975), 9) AS ci_high, count(auc) AS valid FROM boot GROUP BY task"))
def bootstrap_ci(spark, d):
    reps = bootstrap.bootstrap_auc(tokens(spark, d), "task", "response_id", REPS, SEED)
    return nudged(bootstrap.interval(reps, ["task"], "auc", 0.95), "ci_low", "ci_high")


_SCOPED = f"""keyed AS (SELECT *, task || chr(0) || response_id AS key FROM tokens),
  scoped_t AS (SELECT task AS scope, key, label, score, score_b FROM keyed WHERE task IN ({LISTED}) UNION ALL SELECT 'Overall', key, label, score, score_b FROM keyed),
  keys AS (SELECT scope, key, row_number() OVER (PARTITION BY scope ORDER BY key) - 1 AS cluster_idx FROM (SELECT DISTINCT scope, key FROM scoped_t)),
  ksizes AS (SELECT scope, count(*) AS n_clusters FROM keys GROUP BY scope), kdrawn AS MATERIALIZED ({draws_sql('ksizes')}),
  kweighted AS MATERIALIZED (SELECT t.scope, d.rep, t.label, t.score, t.score_b, d.w FROM scoped_t t JOIN keys k ON k.scope = t.scope AND k.key = t.key JOIN kdrawn d ON d.scope = k.scope AND d.cluster_idx = k.cluster_idx)"""


def with_macro_sql(rows: str, by: str = "rep", value: str = "auc") -> str:
    group = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    return f"SELECT scope, {group}{value} FROM {rows} UNION ALL SELECT 'TaskMacro', {group}CASE WHEN count({value}) = {len(EVENT_TASKS)} THEN avg({value}) END FROM {rows} WHERE scope IN ({LISTED}){tail}"


_MACRO = f"{_SCOPED}, tok AS MATERIALIZED ({auc_sql('kweighted', 'scope, rep', weight='w')}), tokm AS MATERIALIZED ({with_macro_sql('tok')})"


@query(nudge(f"WITH {TOKENS}, {_MACRO} SELECT CAST(rep AS INT) AS rep, {_R} FROM tokm WHERE scope = 'TaskMacro'"))
def macro_bootstrap(spark, d):
    reps = evaluation.replicate_aucs(tokens(spark, d), EVENT_TASKS, REPS, SEED, ("token",), overall=False)
    return reps.where(F.col("scope") == evaluation.MACRO).select("rep", F.round(F.col("token_auc") + 1e-12, 9).alias("auc"))


_PAIRED = f"{_MACRO}, other AS MATERIALIZED ({auc_sql('kweighted', 'scope, rep', score='score_b', weight='w')}), otherm AS MATERIALIZED ({with_macro_sql('other')})"


def _sides(spark, d):
    rows = tokens(spark, d)
    return rows, rows.drop("score").withColumnRenamed("score_b", "score")


@query(nudge(f"WITH {TOKENS}, {_PAIRED} SELECT a.scope, CAST(a.rep AS INT) AS rep, round(a.auc, 9) AS first_auc, round(b.auc, 9) AS second_auc, round(a.auc - b.auc, 9) AS difference FROM tokm a JOIN otherm b ON a.scope = b.scope AND a.rep = b.rep WHERE a.scope <> 'TaskMacro'"))
def paired_bootstrap(spark, d):
    first, second = _sides(spark, d)
    reps = evaluation.paired_replicates(first, second, EVENT_TASKS, REPS, SEED, ("token",)).where(F.col("scope") != evaluation.MACRO)
    reps = reps.select("scope", "rep", F.col("first_token_auc").alias("first_auc"), F.col("second_token_auc").alias("second_auc"), F.col("token_difference").alias("difference"))
    return nudged(reps, "first_auc", "second_auc", "difference")


@query(nudge(f"WITH {TOKENS}, {_PAIRED} SELECT round(quantile_cont(a.auc - b.auc, 0.025), 9) AS ci_low, round(quantile_cont(a.auc - b.auc, 0.975), 9) AS ci_high, count(*) AS valid FROM tokm a JOIN otherm b ON a.scope = b.scope AND a.rep = b.rep WHERE a.scope = 'TaskMacro'"))
def paired_macro_bootstrap(spark, d):
    first, second = _sides(spark, d)
    reps = evaluation.paired_replicates(first, second, EVENT_TASKS, REPS, SEED, ("token",), overall=False).where(F.col("scope") == evaluation.MACRO)
    return nudged(bootstrap.interval(reps, ["scope"], "token_difference", 0.95), "ci_low", "ci_high").drop("scope")


@query(f"WITH {TOKENS}, a AS (SELECT DISTINCT task, response_id FROM tokens WHERE score > 100), b AS (SELECT DISTINCT task, response_id FROM tokens WHERE score <= 20) SELECT task, response_id FROM a JOIN b USING (task, response_id)")
def paired_join(spark, d):
    rows = tokens(spark, d)
    return evaluation.common_responses(rows.where("score > 100"), rows.where("score <= 20"))


_POINT = f"""{_SCOPED}, {_COUNTS}, pt AS ({auc_sql('scoped_t', 'scope')}), ptm AS ({with_macro_sql('pt', '')}),
  pr AS ({auc_sql('scoped', 'scope', 'response_label', 'mean_score')}), prm AS ({with_macro_sql('pr', '')})"""


def _evaluate_sql(subset: str | None = None) -> str:
    tag = f"'{subset}' AS subset, " if subset else ""
    return f"""SELECT {tag}'events' AS model, 'standard' AS mode, c.scope AS task, c.n_responses, c.n_tokens, c.n_positive_tokens, c.n_negative_tokens, c.n_positive_responses, c.n_negative_responses,
  round(t.auc, 9) AS token_auc, round(r.auc, 9) AS response_auc, b.low AS token_auc_ci_low, b.high AS token_auc_ci_high, b.valid AS token_bootstrap_valid,
  s.low AS response_auc_ci_low, s.high AS response_auc_ci_high, s.valid AS response_bootstrap_valid, {REPS} AS bootstrap_samples, CAST(0.95 AS DOUBLE) AS confidence
  FROM all_counts c LEFT JOIN ptm t ON t.scope = c.scope LEFT JOIN prm r ON r.scope = c.scope
  LEFT JOIN (SELECT scope, round(quantile_cont(auc, 0.025), 9) AS low, round(quantile_cont(auc, 0.975), 9) AS high, count(auc) AS valid FROM tokm GROUP BY scope) b ON b.scope = c.scope
  LEFT JOIN (SELECT scope, round(quantile_cont(auc, 0.025), 9) AS low, round(quantile_cont(auc, 0.975), 9) AS high, count(auc) AS valid FROM resm GROUP BY scope) s ON s.scope = c.scope"""


_RESP_BOOT = f"""rkeyed AS (SELECT scope, task || chr(0) || response_id AS key, response_label, mean_score FROM scoped),
  rweighted AS MATERIALIZED (SELECT t.scope, d.rep, t.response_label, t.mean_score, d.w FROM rkeyed t JOIN keys k ON k.scope = t.scope AND k.key = t.key JOIN kdrawn d ON d.scope = k.scope AND d.cluster_idx = k.cluster_idx),
  res AS MATERIALIZED ({auc_sql('rweighted', 'scope, rep', 'response_label', 'mean_score', 'w')}), resm AS MATERIALIZED ({with_macro_sql('res')})"""
_EVALUATE = f"{_POINT}, tok AS MATERIALIZED ({auc_sql('kweighted', 'scope, rep', weight='w')}), tokm AS MATERIALIZED ({with_macro_sql('tok')}), {_RESP_BOOT}"
_CI = ("token_auc", "response_auc", "token_auc_ci_low", "token_auc_ci_high", "response_auc_ci_low", "response_auc_ci_high")


@query(nudge(f"WITH {TOKENS}, {_EVALUATE} {_evaluate_sql()}"))
def evaluate(spark, d):
    return nudged(evaluation.evaluate(tokens(spark, d), EVENT_TASKS, "events", "standard", REPS, SEED), *_CI)


@query(nudge(
    f"""SELECT * FROM (WITH {TOKENS}, {_EVALUATE} {_evaluate_sql('all')}) UNION ALL
  SELECT * FROM (WITH {TOKENS.replace(' FROM events)', ' FROM events WHERE user_id % 4 <> 0)')}, {_EVALUATE} {_evaluate_sql('quality_good')})"""
))
def evaluate_subsets(spark, d):
    return nudged(evaluation.evaluate_subsets(tokens(spark, d), EVENT_TASKS, "events", "standard", replicates=REPS, seed=SEED), *_CI)


_OTHER = """bmeans AS (SELECT task, response_id, avg(score_b) AS mean_score, max(response_label) AS response_label FROM tokens GROUP BY task, response_id),
  bscoped AS (SELECT task AS scope, * FROM bmeans WHERE task IN ({LISTED}) UNION ALL SELECT 'Overall', * FROM bmeans),
  bkeyed AS (SELECT scope, task || chr(0) || response_id AS key, response_label, mean_score FROM bscoped),
  bweighted AS MATERIALIZED (SELECT t.scope, d.rep, t.response_label, t.mean_score, d.w FROM bkeyed t JOIN keys k ON k.scope = t.scope AND k.key = t.key JOIN kdrawn d ON d.scope = k.scope AND d.cluster_idx = k.cluster_idx)""".replace("{LISTED}", LISTED)


def _difference_sql(first: str, second: str) -> str:
    return f"SELECT a.scope, round(quantile_cont(a.auc - b.auc, 0.025), 9) AS low, round(quantile_cont(a.auc - b.auc, 0.975), 9) AS high, count(a.auc - b.auc) AS valid FROM {first} a JOIN {second} b ON a.scope = b.scope AND a.rep = b.rep GROUP BY a.scope"


@query(nudge(f"""WITH {TOKENS}, {_EVALUATE}, {_OTHER},
  other AS MATERIALIZED ({auc_sql('kweighted', 'scope, rep', score='score_b', weight='w')}), otherm AS MATERIALIZED ({with_macro_sql('other')}),
  bres AS MATERIALIZED ({auc_sql('bweighted', 'scope, rep', 'response_label', 'mean_score', 'w')}), bresm AS MATERIALIZED ({with_macro_sql('bres')}),
  qt AS ({auc_sql('scoped_t', 'scope', score='score_b')}), qtm AS ({with_macro_sql('qt', '')}),
  qr AS ({auc_sql('bscoped', 'scope', 'response_label', 'mean_score')}), qrm AS ({with_macro_sql('qr', '')}),
  ci AS ({_difference_sql('tokm', 'otherm')}), rci AS ({_difference_sql('resm', 'bresm')})
  SELECT 'value' AS first_model, 'scaled' AS second_model, c.scope AS task, c.n_responses AS n_common_responses,
  round(a.auc, 9) AS first_token_auc, round(b.auc, 9) AS second_token_auc, round(a.auc - b.auc, 9) AS token_difference,
  round(r.auc, 9) AS first_response_auc, round(s.auc, 9) AS second_response_auc, round(r.auc - s.auc, 9) AS response_difference,
  ci.low AS token_difference_ci_low, ci.high AS token_difference_ci_high, ci.valid AS token_bootstrap_valid,
  rci.low AS response_difference_ci_low, rci.high AS response_difference_ci_high, rci.valid AS response_bootstrap_valid
  FROM all_counts c JOIN ptm a ON a.scope = c.scope JOIN qtm b ON b.scope = c.scope JOIN prm r ON r.scope = c.scope JOIN qrm s ON s.scope = c.scope
  JOIN ci ON ci.scope = c.scope JOIN rci ON rci.scope = c.scope"""))
def compare(spark, d):
    first, second = _sides(spark, d)
    found = evaluation.compare(first, second, EVENT_TASKS, ("value", "scaled"), REPS, SEED)
    return nudged(found, *[n for n in found.columns if "auc" in n or "difference" in n])


@query("SELECT task, low, high, CASE WHEN high = low THEN 0 ELSE round((v - low) / (high - low), 9) END AS scaled, id FROM (SELECT lang AS task, doc_id AS id, n_chars AS v, min(n_chars) OVER (PARTITION BY lang) AS low, max(n_chars) OVER (PARTITION BY lang) AS high FROM documents)")
def minmax_transform(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    bounds = docs.groupBy("lang").agg(F.min("n_chars").alias("low"), F.max("n_chars").alias("high"))
    return docs.join(bounds, "lang").select(F.col("lang").alias("task"), "low", "high", F.round(minmax("n_chars", F.col("low"), F.col("high")), 9).alias("scaled"), F.col("doc_id").alias("id"))


@query(f"WITH {FEATURES} SELECT round(min(v[1] + v[2]), 9) AS head_low, round(max(v[1] + v[2]), 9) AS head_high, round(min(v[33]), 9) AS layer_low, round(max(v[33]), 9) AS layer_high FROM feats WHERE eval_split = 'calibration_train'")
def minmax_fit(spark, d):
    train = features(spark, d).where("eval_split = 'calibration_train'")
    heads, layers = calibration.sum_of(HEADS[:2]), calibration.sum_of(LAYERS[:1])
    return train.agg(F.round(F.min(heads), 9).alias("head_low"), F.round(F.max(heads), 9).alias("head_high"), F.round(F.min(layers), 9).alias("layer_low"), F.round(F.max(layers), 9).alias("layer_high"))


@query("""SELECT lang AS task, q1, q3, count(*) FILTER (WHERE n_chars < q1 - 1.5 * (q3 - q1) OR n_chars > q3 + 1.5 * (q3 - q1)) AS n_outliers
  FROM documents JOIN (SELECT lang AS l, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3 FROM documents GROUP BY lang) ON l = lang GROUP BY lang, q1, q3""")
def iqr_outliers(spark, d):
    from ..operators.attention import outliers

    docs = table(spark, d, "documents").select(F.col("lang").alias("task"), "n_chars")
    fences = docs.groupBy("task").agg(F.percentile("n_chars", F.array(F.lit(0.25), F.lit(0.75))).alias("q")).select("task", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    return outliers(docs.join(fences, "task"), ["task"], "n_chars").select("task", "q1", "q3", "n_outliers")


@query("SELECT CAST(i AS INT) AS i, round(0.1 + i * 0.1, 12)::DOUBLE AS beta FROM range(0, 19) t(i)")
def beta_grid(spark, d):
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(b) for b in calibration.float_grid(0.1, 1.9, 0.1)])).alias("i", "beta"))


@query("SELECT CAST(h AS INT) AS k_heads, CAST(l AS INT) AS k_layers, round(0.1 * b, 12)::DOUBLE AS beta FROM range(1, 33) x(h), range(1, 33) y(l), range(1, 20) z(b)")
def grid(spark, d):
    return calibration.grid(list(range(1, 33)), list(range(1, 33)), list(calibration.BETAS), spark)


@query(f"WITH {FEATURES} SELECT response_id, CAST(k AS INT) AS k, round(list_sum(v[1:k]), 9) AS total FROM feats, range(1, 33) r(k)")
def prefix_sums(spark, d):
    return rounded(calibration.prefix_sums(features(spark, d), ["response_id"], HEADS), "total")


_LONG = f"{FEATURES}, long AS (SELECT token_label, eval_split, i - 1 AS input_order, -v[i] AS value FROM feats, range(1, 33) r(i))"


@query(f"WITH {_LONG} SELECT CAST(row_number() OVER (ORDER BY auc DESC NULLS LAST, input_order) AS INT) AS rank, 'ecs_l' || CAST(input_order // 8 AS INT) || '_h' || CAST(input_order % 8 AS INT) AS feature, {_R} FROM ({auc_sql('long', 'input_order', 'token_label', 'value')})")
def rank_features(spark, d):
    return rounded(auc.rank_features(features(spark, d), HEADS, "token_label", inverse=True), "auc")


#: A frozen state for the scoring queries (fixed values).
STATE = calibration.Calibration("embeddings", "standard", tuple(HEADS[:3]), tuple(LAYERS[:2]), 1.0, 0.4, calibration.Scale(-0.5, 0.5), calibration.Scale(-0.3, 0.3), 0.5, tuple(FEATURE_TASKS))
_SCORED = f"{FEATURES}, parts AS (SELECT *, (v[1] + v[2] + v[3] + 0.5) / 1.0 AS ecs_scaled, (v[33] + v[34] + 0.3) / 0.6 AS pks_scaled FROM feats)"


@query(f"WITH {_SCORED} SELECT response_id, round(ecs_scaled, 9) AS ecs_scaled, round(pks_scaled, 9) AS pks_scaled, round(pks_scaled - CAST(0.4 AS DOUBLE) * ecs_scaled, 9) AS score FROM parts")
def score(spark, d):
    return rounded(calibration.apply_calibration(features(spark, d), STATE).select("response_id", "ecs_scaled", "pks_scaled", "score"), "ecs_scaled", "pks_scaled", "score")


@query(f"WITH {_SCORED} SELECT task, count(*) AS n, round(avg(pks_scaled - CAST(0.4 AS DOUBLE) * ecs_scaled), 9) AS mean_score FROM parts WHERE eval_split = 'test' GROUP BY task")
def score_test(spark, d):
    test = calibration.apply_calibration(features(spark, d).where("eval_split = 'test'"), STATE, components=False)
    return test.groupBy("task").agg(F.count("*").alias("n"), F.round(F.avg("score"), 9).alias("mean_score"))


_KS, _BETAS = [1, 2, 3, 4], [0.1, 1.0, 1.9]


def _side_sql(name: str, low: int, sign: str, size: int = 4) -> str:
    return f"""{name}_long AS (SELECT vec_id, task, token_label, eval_split, i, v[i] AS x, {sign}v[i] AS value FROM feats, range({low}, {low + size}) r(i)),
  {name}_auc AS ({auc_sql(f"(SELECT * FROM {name}_long WHERE eval_split = 'calibration_train')", 'i', 'token_label', 'value')}),
  {name}_rank AS (SELECT i, row_number() OVER (ORDER BY auc DESC NULLS LAST, i) AS k FROM {name}_auc),
  {name}_sum AS (SELECT vec_id, task, token_label, eval_split, k, sum(x) OVER (PARTITION BY vec_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS total FROM {name}_long JOIN {name}_rank USING (i)),
  {name}_bound AS (SELECT k, min(total) AS low, max(total) AS high FROM {name}_sum WHERE eval_split = 'calibration_train' GROUP BY k),
  {name} AS (SELECT vec_id, task, token_label, k, CASE WHEN high = low THEN 0 ELSE (total - low) / (high - low) END AS value FROM {name}_sum JOIN {name}_bound USING (k) WHERE eval_split = 'dev')"""


def _trace_sql(size: int, betas: list[float]) -> str:
    return f"""{FEATURES}, {_side_sql('heads', 1, '-', size)}, {_side_sql('layers', 33, '', size)},
  points AS (SELECT h.k AS k_heads, l.k AS k_layers, CAST(beta AS DOUBLE) AS beta, h.task, h.token_label, round(l.value - CAST(beta AS DOUBLE) * h.value, 12) AS value FROM heads h JOIN layers l USING (vec_id), (VALUES {', '.join(f'({b})' for b in betas)}) b(beta)),
  areas AS ({auc_sql('points', 'k_heads, k_layers, beta, task', 'token_label', 'value')}),
  trace AS (SELECT CAST(k_heads AS INT) AS k_heads, CAST(k_layers AS INT) AS k_layers, beta, CASE WHEN count(auc) = 3 THEN round(avg(auc), 9) END AS objective FROM areas GROUP BY k_heads, k_layers, beta)"""


_TRACE = _trace_sql(4, _BETAS)


def _trace(spark, d):
    rows = features(spark, d)
    train, dev = rows.where("eval_split = 'calibration_train'"), rows.where("eval_split = 'dev'")
    ranked = lambda names, inverse: [r["feature"] for r in auc.rank_features(train, names, "token_label", inverse).orderBy("rank").collect()]
    heads, layers = ranked(HEADS[:4], True), ranked(LAYERS[:4], False)
    found = calibration.search_trace(train, dev, heads, layers, FEATURE_TASKS, _KS, _KS, _BETAS, 1.0, ["response_id"], "task", "token_label")
    return rounded(found, "objective")


@query(f"WITH {_TRACE} SELECT * FROM trace")
def calibrate_small(spark, d):
    """The trace of a 4 x 4 x 3 grid: rank, prefix sums, scaling on train, macro AUC on dev."""
    return _trace(spark, d)


@query(f"WITH {_TRACE} SELECT k_heads, k_layers, beta, objective FROM trace WHERE objective IS NOT NULL ORDER BY objective DESC, k_heads + k_layers, k_heads, k_layers, beta LIMIT 1")
def grid_argmax(spark, d):
    return calibration.best_of_grid(_trace(spark, d))


@query(f"WITH {_trace_sql(32, list(calibration.BETAS))} SELECT * FROM trace")
def calibrate_full(spark, d):
    """The whole search: 32 heads, 32 layers and 19 betas, after the integrity checks, by the parallel kernel."""
    rows = features(spark, d)
    train, dev = rows.where("eval_split = 'calibration_train'"), rows.where("eval_split = 'dev'")
    _, trace = calibration.search_calibration(train, dev, "embeddings", "standard", FEATURE_TASKS, list(range(1, 33)), list(range(1, 33)), columns=(HEADS, LAYERS))
    return rounded(trace, "objective")
