"""AUC, bootstrap, calibration and evaluation: brute force, invariances, and both physical forms."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verispan.functions import vectors
from verispan.operators import attention, auc, bootstrap, calibration, evaluation
from verispan.scoring import decoder as dec

TASKS = ["QA", "Data2txt", "Summary"]


def plain_auc(rows):
    u = p = n = 0.0
    for y, s, w in rows:
        for y2, s2, w2 in rows:
            if y == 1 and y2 == 0:
                u += w * w2 * ((s > s2) + (s == s2) / 2)
        p, n = p + w * (y == 1), n + w * (y == 0)
    return u / (p * n) if p and n else None


@pytest.mark.parametrize("ranges", [1, 2, 32])
def test_auc(spark, ranges):
    rng = random.Random(7)
    rows = [(g, rng.randrange(2), float(rng.randrange(9)), float(rng.randrange(1, 4))) for g in "ab" for _ in range(60)] + [("one", 1, 1.0, 1.0)]
    bad = [("a", None, 1.0, 1.0), ("a", 1, float("nan"), 1.0), ("a", 1, float("inf"), 1.0), ("a", 0, 1.0, 0.0), ("a", 0, 1.0, -1.0), ("a", 1, None, 1.0)]
    df = spark.createDataFrame(rows + bad, "g string, label int, score double, weight double")
    got = {r.g: r.auc for r in auc.roc_auc(df, ["g"], weight="weight", ranges=ranges).collect()}
    assert got["one"] is None
    for g in "ab":
        assert got[g] == pytest.approx(plain_auc([r[1:] for r in rows if r[0] == g]))
    shifted = {r.g: r.auc for r in auc.roc_auc(df.withColumn("score", F.exp("score")), ["g"], weight="weight", ranges=ranges).collect()}
    flipped = {r.g: r.auc for r in auc.roc_auc(df.withColumn("score", -F.col("score")), ["g"], weight="weight", ranges=ranges).collect()}
    assert shifted["a"] == pytest.approx(got["a"]) and flipped["a"] == pytest.approx(1 - got["a"])
    assert auc.roc_auc(df.where("g = 'a'"), [], weight="weight", ranges=ranges).first().auc == pytest.approx(got["a"])


def tokens(spark, scale=1.0, extra=0):
    rows = []
    for t in TASKS:
        for k, y in enumerate((0, 1, 0, 1)):
            for j in range(2 + extra):
                rows.append((t, f"{t}-{k}", j, int(y and j == 1), y, scale * y, "good"))
    return spark.createDataFrame(rows, "task string, response_id string, token_index int, label int, response_label int, score double, quality string")


def test_evaluate(spark):
    found = {r.task: r for r in evaluation.evaluate(tokens(spark), TASKS, "m", "standard", 20, 42).collect()}
    assert set(found) == {*TASKS, "Overall", "TaskMacro"}
    qa = found["QA"]
    assert (qa.n_responses, qa.n_tokens, qa.n_positive_tokens, qa.n_negative_tokens, qa.n_positive_responses) == (4, 8, 2, 6, 2)
    assert qa.response_auc == 1 and qa.response_auc_ci_low == 1 and qa.response_bootstrap_valid <= 20
    assert found["TaskMacro"].n_tokens == 24
    one = evaluation.evaluate(tokens(spark).where("task <> 'QA' or response_label = 0"), TASKS, "m", "standard", 5, 1)
    got = {r.task: r for r in one.collect()}
    assert got["QA"].token_auc is None and got["TaskMacro"].token_auc is None and got["QA"].token_bootstrap_valid == 0
    with pytest.raises(ValueError, match="two labels"):
        evaluation.evaluate(tokens(spark).withColumn("response_label", F.col("token_index")), TASKS, "m", "s", 0)


def test_compare(spark):
    good, bad = tokens(spark), tokens(spark, -1.0, extra=1)
    got = {r.task: r for r in evaluation.compare(good, bad, TASKS, ("a", "b"), 20).collect()}
    assert got["QA"].response_difference == 1 and got["QA"].response_difference_ci_low == 1 and got["Overall"].n_common_responses == 12
    with pytest.raises(ValueError):
        evaluation.compare(good, bad, TASKS, ("a", "a"))
    with pytest.raises(ValueError, match="differ"):
        evaluation.compare(good, bad.withColumn("response_label", 1 - F.col("response_label")), TASKS, ("a", "b"))


@pytest.mark.parametrize(("range_rows", "block", "cells"), [(1 << 20, 125, 1 << 19), (15, 5, 1)])
def test_replicates_follow_the_draws(spark, monkeypatch, range_rows, block, cells):
    for name, value in (("RANGE_ROWS", range_rows), ("BLOCK", block), ("CELLS", cells)):
        monkeypatch.setattr(bootstrap, name, value)
    rng = np.random.default_rng(3)
    rows = [(g, f"r{i // 5:03}", int(rng.integers(2)), float(rng.integers(20))) for g in ("all", "b") for i in range(200 if g == "all" else 9)] + [("one", "r", 1, 2.0)]
    bad = [("b", "r000", None, 3.0), ("b", "r001", 1, float("nan"))]
    df = spark.createDataFrame(rows + bad, "scope string, response string, label int, score double")
    got = {(r.scope, r.rep): r.auc for r in bootstrap.bootstrap_auc(df, "scope", "response", 12, 5).collect()}
    sizes = spark.createDataFrame([("all", 40), ("b", 2), ("one", 1)], "scope string, n_clusters long")
    weights = {(r.scope, r.rep, r.cluster_idx): r.w for r in bootstrap.draws(sizes, ["scope"], 12, 5, F.col("scope")).collect()}
    assert sum(weights.values()) == 12 * 43 and len(got) == 36
    assert {r.scope: int(r.s) for r in sizes.select("scope", bootstrap.scope_seeds(5, F.col("scope")).alias("s")).collect()} == {x: bootstrap.scope_seed(5, x) for x in ("all", "b", "one")}
    for (scope, rep), area in got.items():
        assert np.bincount(bootstrap.drawn(5, scope, rep, {"all": 40, "b": 2, "one": 1}[scope])).tolist()[0] == weights.get((scope, rep, 0), 0)
        want = plain_auc([(y, s, weights.get((scope, rep, int(r[1:] or 0)), 0)) for g, r, y, s in rows if g == scope])
        assert area == (want if want is None else pytest.approx(want))


def frame(spark, split, scale=1.0):
    rows = []
    for t in TASKS:
        for n, y in enumerate((0, 1, 0, 1)):
            rows.append((f"{split}-{t}-{n}", t, "train", split, 0, y, y, 1.0 - y, float(y), scale * y, 1.0 - y, 1.0 - y, float(y)))
    return spark.createDataFrame(rows, "response_id string, task string, original_split string, eval_split string, token_index int, token_label int, response_label int, ecs_l0_h0 double, ecs_l0_h1 double, pks_standard_l0 double, pks_standard_l1 double, ecs_whole_l0_h0 double, pks_legacy_l0 double")


OPTIONS = {"model": "m", "mode": "paper", "tasks": TASKS, "heads": [1, 2, 2], "layers": [1, 2], "betas": [0.1, 1.0]}


def test_calibration(spark):
    train, dev = frame(spark, "calibration_train"), frame(spark, "dev", 100.0)
    state, trace = calibration.search_calibration(train, dev, **OPTIONS)
    assert (state.heads, state.layers, state.beta, state.objective) == (("ecs_l0_h0",), ("pks_standard_l0",), 0.1, 1.0)
    assert (state.layer_scale.low, state.layer_scale.high) == (0, 1) and trace.count() == 8
    assert calibration.Calibration.from_dict(state.to_dict()) == state
    scored = calibration.apply_calibration(dev, state)
    assert scored.agg(F.max("pks_scaled")).first()[0] == 100
    sql = calibration.search_trace(train, dev, ["ecs_l0_h0", "ecs_l0_h1"], ["pks_standard_l0", "pks_standard_l1"], TASKS, [1, 2], [1, 2], [0.1, 1.0], 1.0, ["response_id"], "task", "token_label")
    key = lambda df: sorted((r.k_heads, r.k_layers, r.beta, round(r.objective, 9)) for r in df.collect())
    assert key(sql) == key(trace)


@pytest.mark.parametrize(
    "change, message",
    [
        (lambda t, d: (t, t.withColumn("eval_split", F.lit("dev"))), "both"),
        (lambda t, d: (t.withColumn("original_split", F.lit("TEST")), d), "test rows"),
        (lambda t, d: (t, d.where("task <> 'QA'")), "objective"),
        (lambda t, d: (t.withColumn("token_label", F.lit(2)), d), "0 or 1"),
        (lambda t, d: (t.withColumn("ecs_l0_h0", F.lit(float("nan"))), d), "finite"),
        (lambda t, d: (t.drop("token_label"), d), "missing columns"),
        (lambda t, d: (t.limit(0), d), "empty"),
    ],
)
def test_calibration_refuses(spark, change, message):
    with pytest.raises(ValueError, match=message):
        calibration.search_calibration(*change(frame(spark, "calibration_train"), frame(spark, "dev")), **OPTIONS)


def test_columns_and_grids():
    assert calibration.discover_columns(["ecs_l10_h2", "ecs_l2_h11", "x", "ecs_l2_h3", "pks_standard_l1", "ecs_whole_l0_h0"], "standard") == (["ecs_l2_h3", "ecs_l2_h11", "ecs_l10_h2"], ["pks_standard_l1"])
    assert calibration.float_grid(0.1, 1.9, 0.1) == list(calibration.BETAS)
    with pytest.raises(ValueError):
        calibration.checked_grid([0], 3, "heads")
    with pytest.raises(ValueError):
        calibration.normalize_mode("x")


def test_divergences(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 3, (6, 50)), rng.normal(0, 3, (6, 50))
    standard, legacy = dec.divergences(a, b)
    for block in (3, 7, 50):
        s, l = dec.divergences(a, b, block)
        assert np.allclose(s, standard) and np.allclose(l, legacy, rtol=1e-9)
    assert np.allclose(standard, dec.divergences(b, a)[0]) and (standard <= np.log(2)).all() and np.allclose(dec.divergences(a, a)[0], 0)
    df = spark.createDataFrame([(i, a[i].tolist(), b[i].tolist()) for i in range(6)], "i int, a array<double>, b array<double>")
    got = df.orderBy("i").select(vectors.jsd_standard("a", "b"), vectors.jsd_legacy("a", "b"), vectors.cosine("a", "b"), vectors.logsumexp("a")).collect()
    assert np.allclose([r[0] for r in got], standard) and np.allclose([r[1] for r in got], legacy)
    assert np.allclose([r[3] for r in got], np.log(np.exp(a).sum(axis=1)))


def test_context_scores_agree(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(9, 4))
    rows = spark.createDataFrame([("r", i, x[i].tolist()) for i in range(9)], "key string, position int, v array<double>")
    pairs = attention.attention(attention.causal_pairs(rows, "key", "position", None, ("v",)), ["key", "query"], "q_v", "k_v", 0.5)
    got = {r.query: r.ecs for r in attention.external_context_score(pairs, ["key", "query"], "weight", "key_position", "q_v", "k_v", 4, 0.5).collect()}
    seen = np.tril(np.ones((9, 9), bool))
    want = dec.context_scores(dec.softmax(np.where(seen, x @ x.T * 0.5, -np.inf)), x, x, seen, 0.5)
    assert np.allclose([got[i] for i in range(9)], want)
    windowed = attention.causal_pairs(rows, "key", "position", 3).collect()
    assert {(r.query, r.key_position) for r in windowed} == {(q, k) for q in range(9) for k in range(max(0, q - 2), q + 1)}


def test_draws_are_dealt_to_many_tasks(spark, monkeypatch):
    """Nothing but replicates' numbers may meet in one task, however small the table of groups; words come in pieces."""
    monkeypatch.setattr(bootstrap, "OUT_ROWS", 7, raising=False)
    sizes = spark.createDataFrame([("a", 41), (None, 3), ("one", 1)], "scope string, n_clusters long").groupBy("scope").agg(F.max("n_clusters").alias("n_clusters"))
    found = bootstrap.draws(sizes, ["scope"], 40, 5, F.col("scope")).withColumn("task", F.spark_partition_id())
    rows = found.collect()
    assert len({r.task for r in rows}) == 40 and len({(r.scope, r.rep, r.cluster_idx) for r in rows}) == len(rows)
    assert {n: sum(r.w for r in rows if r.scope == n) for n in ("a", None, "one")} == {"a": 1640, None: 120, "one": 40}
    got = {(r.rep, r.cluster_idx): r.w for r in rows if r.scope == "a"}
    for rep in range(40):
        assert [got.get((rep, k), 0) for k in range(41)] == np.bincount(bootstrap.drawn(5, "a", rep, 41), minlength=41).tolist()
    monkeypatch.setattr(bootstrap, "DRAWN", 16)
    pieces = bootstrap.drawn_counts(bootstrap.scope_seed(5, "a"), 3, 41)
    assert pieces.tolist() == [got.get((3, k), 0) for k in range(41)]


@pytest.mark.parametrize("weight_bytes", [1 << 27, 50])
def test_replicates_over_small_chunks(spark, monkeypatch, weight_bytes):
    """Ties that go on over many chunks, repeated rows, both zeros, two kinds and blocks cut by their weights' size."""
    for name, value in (("RANGE_ROWS", 3), ("BLOCK", 4), ("CELLS", 5), ("WEIGHT_BYTES", weight_bytes)):
        monkeypatch.setattr(bootstrap, name, value, raising=False)
    rng = np.random.default_rng(4)
    rows = [(k, s, int(c), 20, int(rng.integers(2)), float(rng.integers(3))) for k in ("a", "b") for s in ("x", "y") for c in rng.integers(0, 20, 70)]
    rows = [(*r[:5], -0.0 if r[5] == 0 and r[2] % 2 else r[5]) for r in rows]
    df = spark.createDataFrame(rows, "kind string, scope string, cluster_idx long, n_clusters long, label int, score double")
    got = {(r.kind, r.scope, r.rep): r.auc for r in bootstrap.replicated_auc(df, 9, 5).collect()}
    assert len(got) == 36
    for (kind, scope, rep), area in got.items():
        w = np.bincount(bootstrap.drawn(5, scope, rep, 20), minlength=20)
        assert area == pytest.approx(plain_auc([(y, s, w[c]) for k, g, c, _, y, s in rows if (k, g) == (kind, scope)]))


def test_replicates_are_computed_once(spark):
    """TaskMacro, both levels and all ranges of scores take one pass over the replicates, and none draws again."""
    first = tokens(spark)
    for found in (evaluation.replicate_aucs(first, TASKS, 20, 42), evaluation.paired_replicates(first, tokens(spark, -1.0), TASKS, 20, 42).where("scope = 'TaskMacro'")):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert sum("run(" in line for line in plan.splitlines()) == 1


def test_only_what_is_asked_for_is_replicated(spark):
    """TaskMacro of tokens alone, without Overall and responses, as with them."""
    first, second = tokens(spark), tokens(spark, -1.0, extra=1)
    key = lambda df: sorted(map(tuple, df.where("scope = 'TaskMacro'").select("rep", "token").collect()))
    less = evaluation.replicate_aucs(first, TASKS, 9, 1, ("token",), overall=False)
    assert less.columns == ["scope", "rep", "token_auc"] and {r.scope for r in less.select("scope").collect()} == {*TASKS, "TaskMacro"}
    assert key(less.withColumnRenamed("token_auc", "token")) == key(evaluation.replicate_aucs(first, TASKS, 9, 1).withColumnRenamed("token_auc", "token"))
    pair = [evaluation.paired_replicates(first, second, TASKS, 9, 1, *more) for more in ((("token",), False), ())]
    assert key(pair[0].withColumnRenamed("token_difference", "token")) == key(pair[1].withColumnRenamed("token_difference", "token"))


def test_joins_of_replicates_are_in_fixed_parts(spark):
    """What one task joins and sorts doesn't hang on the session's number of partitions."""
    df = spark.createDataFrame([("a", "r", 1, 1.0)], "scope string, response string, label int, score double")
    for found in (bootstrap.bootstrap_auc(df, "scope", "response", 3, 5), evaluation.replicate_aucs(tokens(spark), TASKS, 3, 42)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert sum(f", {bootstrap.RANGES})" in line and "hashpartitioning(" in line for line in plan.splitlines()) and f"{bootstrap.RANGES}), REPARTITION_BY_NUM" in plan
