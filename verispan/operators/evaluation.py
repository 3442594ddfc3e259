"""Evaluation and paired comparison: tasks, Overall and TaskMacro, with bootstrap intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .auc import roc_auc, strict_mean
from .bootstrap import RANGES, cluster_index, intervals, replicated_auc
from .checks import label_conflicts, label_disagreements, require_none

OVERALL, MACRO = "Overall", "TaskMacro"


def response_means(tokens: DataFrame, response: str = "response_id", task: str = "task") -> DataFrame:
    """One row a response: mean score, label, tokens and positive tokens."""
    return tokens.groupBy(task, response).agg(F.avg("score").alias("mean_score"), F.max("response_label").alias("response_label"), F.count("*").alias("n_tokens"), F.sum("label").alias("n_positive_tokens"))


def scoped(rows: DataFrame, tasks: list[str], task: str = "task", overall: bool = True) -> DataFrame:
    """rows with ``scope``: each row once under its task, if listed, and once under Overall, if that is asked for."""
    own = F.when(F.col(task).isin(tasks), F.col(task))
    return rows.withColumn("scope", F.explode(F.filter(F.array(own, *([F.lit(OVERALL)] if overall else [])), lambda s: s.isNotNull())))


def scope_counts(tokens: DataFrame, tasks: list[str]) -> DataFrame:
    """(scope, counts...): responses and tokens, by class, of each task, Overall and TaskMacro."""
    means = scoped(response_means(tokens), tasks)
    names = ["n_responses", "n_tokens", "n_positive_tokens", "n_negative_tokens", "n_positive_responses", "n_negative_responses"]
    positive = F.sum("response_label")
    counts = means.groupBy("scope").agg(
        F.count("*").alias("n_responses"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_positive_tokens").alias("n_positive_tokens"),
        (F.sum("n_tokens") - F.sum("n_positive_tokens")).alias("n_negative_tokens"), positive.alias("n_positive_responses"), (F.count("*") - positive).alias("n_negative_responses"),
    )
    macro = counts.where(F.col("scope") != OVERALL).agg(*[F.sum(n).alias(n) for n in names]).select(F.lit(MACRO).alias("scope"), *names)
    return counts.unionByName(macro.where("n_responses is not null"))


def _with_macro(values: DataFrame, tasks: list[str], by: list[str], value: str = "auc") -> DataFrame:
    macro = values.where(F.col("scope").isin(tasks)).groupBy(*by).agg(strict_mean(value, len(tasks)).alias(value)).select(F.lit(MACRO).alias("scope"), *by, value)
    return values.select("scope", *by, value).unionByName(macro)


def point_aucs(tokens: DataFrame, tasks: list[str]) -> DataFrame:
    """(scope, token_auc, response_auc)."""
    token = roc_auc(scoped(tokens, tasks), ["scope"], "label", "score").select("scope", "auc")
    response = roc_auc(scoped(response_means(tokens), tasks), ["scope"], "response_label", "mean_score").select("scope", "auc")
    both = _with_macro(token, tasks, []).withColumnRenamed("auc", "token_auc").join(_with_macro(response, tasks, []).withColumnRenamed("auc", "response_auc"), "scope", "full")
    return both


def _keyed(rows: DataFrame, tasks: list[str], label: str, score: str, overall: bool = True) -> DataFrame:
    """(scope, response_key, label, score)."""
    key = F.concat_ws("\0", "task", "response_id")
    return scoped(rows.withColumn("response_key", key), tasks, overall=overall).select("scope", "response_key", F.col(label).alias("label"), F.col(score).alias("score"))


def _replicates(sides: dict[str, DataFrame], index: DataFrame, tasks: list[str], replicates: int, seed: int) -> DataFrame:
    """(scope, rep, a column of aucs a side), TaskMacro too: one draw of each scope's responses serves all sides."""
    rows = [rows.select(F.lit(name).alias("kind"), "*") for name, rows in sides.items()]
    rows = reduce(DataFrame.unionByName, rows).repartition(RANGES, "scope", "response_key").join(index, ["scope", "response_key"])
    also = F.explode(F.filter(F.array("scope", F.when(F.col("scope").isin(tasks), F.lit(MACRO))), lambda s: s.isNotNull()))  # one pass over the replicates serves TaskMacro too
    found = replicated_auc(rows, replicates, seed).withColumn("scope", also).groupBy("scope", "kind", "rep")
    found = found.agg(F.when(F.col("scope") == MACRO, strict_mean("auc", len(tasks))).otherwise(F.max("auc")).alias("auc"))
    return found.groupBy("scope", "rep").agg(*[F.max(F.when(F.col("kind") == name, F.col("auc"))).alias(name) for name in sides])


LEVELS = ("token", "response")


def _levels(tokens: DataFrame, tasks: list[str], levels: tuple[str, ...], overall: bool) -> tuple[dict[str, DataFrame], DataFrame]:
    """The rows of each level, and the responses, by scope."""
    means = _keyed(response_means(tokens), tasks, "response_label", "mean_score", overall)
    found = {"token": _keyed(tokens, tasks, "label", "score", overall), "response": means}
    return {level: found[level] for level in levels}, means


def replicate_aucs(tokens: DataFrame, tasks: list[str], replicates: int, seed: int, levels: tuple[str, ...] = LEVELS, overall: bool = True) -> DataFrame:
    """(scope, rep, token_auc, response_auc): each scope's clusters are drawn on their own; TaskMacro
    averages the tasks' replicates. Only the levels asked for are computed, and Overall only if it is."""
    rows, means = _levels(tokens, tasks, levels, overall)
    return _replicates({f"{level}_auc": x for level, x in rows.items()}, cluster_index(means, ["scope"], "response_key"), tasks, replicates, seed)


def check_bootstrap(replicates: int, confidence: float) -> None:
    if replicates < 0 or not 0 < confidence < 1:
        raise ValueError("replicates must not be negative, and confidence must be in (0, 1)")


def evaluate(tokens: DataFrame, tasks: list[str], model: str, mode: str, replicates: int = 1000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """The metric table of one scorer, a row a scope.

    tokens: task, response_id, label, response_label, score. Overall counts tasks that aren't listed
    too, TaskMacro listed ones only.
    """
    check_bootstrap(replicates, confidence)
    require_none(label_conflicts(tokens, ["task", "response_id"], "response_label"), "responses with two labels")
    found = scope_counts(tokens, tasks).join(point_aucs(tokens, tasks), "scope", "left")
    if replicates:
        found = found.join(intervals(replicate_aucs(tokens, tasks, replicates, seed), {f"{x}_auc": f"{x}_bootstrap_valid" for x in ("token", "response")}, confidence), "scope", "left")
    return found.select(F.lit(model).alias("model"), F.lit(mode).alias("mode"), F.col("scope").alias("task"), *[c for c in found.columns if c != "scope"], F.lit(replicates).alias("bootstrap_samples"), F.lit(confidence).alias("confidence"))


def model_pairs(rows: DataFrame, model: str = "model") -> DataFrame:
    """(first, second): all unordered pairs of the models in rows; one row a pair of names, not of rows."""
    names = rows.select(model).distinct()
    one, two = names.select(F.col(model).alias("first")), names.select(F.col(model).alias("second"))
    return one.join(two, F.col("first") < F.col("second"))


def common_responses(first: DataFrame, second: DataFrame) -> DataFrame:
    """(task, response_id) that both scorers have; token counts may differ."""
    return first.select("task", "response_id").distinct().join(second.select("task", "response_id").distinct(), ["task", "response_id"])


def paired_replicates(first: DataFrame, second: DataFrame, tasks: list[str], replicates: int, seed: int, levels: tuple[str, ...] = LEVELS, overall: bool = True) -> DataFrame:
    """(scope, rep, and for token and response first, second and difference): one draw of responses serves
    both scorers; a replicate counts only where both are defined. Levels and Overall as in ``replicate_aucs``."""
    (rows, means), (others, _) = (_levels(x, tasks, levels, overall) for x in (first, second))
    sides = {f"{name}_{level}_auc": x for level in levels for name, x in (("first", rows[level]), ("second", others[level]))}
    both = _replicates(sides, cluster_index(means, ["scope"], "response_key"), tasks, replicates, seed)
    found = []
    for level in levels:
        names = [f"{name}_{level}_auc" for name in ("first", "second")]
        whole = F.col(names[0]).isNotNull() & F.col(names[1]).isNotNull()
        found += [F.when(whole, F.col(c)).alias(c) for c in names] + [F.when(whole, F.col(names[0]) - F.col(names[1])).alias(f"{level}_difference")]
    return both.select("scope", "rep", *found)


def compare(first: DataFrame, second: DataFrame, tasks: list[str], names: tuple[str, str], replicates: int = 1000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """The paired metric table of two scorers on their common responses, a row a scope."""
    if names[0] == names[1]:
        raise ValueError("a scorer can't be compared with itself")
    check_bootstrap(replicates, confidence)
    require_none(label_disagreements(first, second, ["task", "response_id"], "response_label"), "responses whose labels differ")
    common = common_responses(first, second)
    first, second = (x.join(common, ["task", "response_id"], "left_semi") for x in (first, second))
    points = point_aucs(first, tasks).toDF("scope", "first_token_auc", "first_response_auc").join(point_aucs(second, tasks).toDF("scope", "second_token_auc", "second_response_auc"), "scope")
    points = points.withColumns({"token_difference": F.col("first_token_auc") - F.col("second_token_auc"), "response_difference": F.col("first_response_auc") - F.col("second_response_auc")})
    counts = scope_counts(first, tasks).select("scope", F.col("n_responses").alias("n_common_responses"))
    found = counts.join(points, "scope")
    if replicates:
        found = found.join(intervals(paired_replicates(first, second, tasks, replicates, seed), {f"{x}_difference": f"{x}_bootstrap_valid" for x in ("token", "response")}, confidence), "scope", "left")
    return found.select(F.lit(names[0]).alias("first_model"), F.lit(names[1]).alias("second_model"), F.col("scope").alias("task"), *[c for c in found.columns if c != "scope"])


def tag(rows: DataFrame, **literals: str) -> DataFrame:
    """rows with literal columns in front."""
    return rows.select(*[F.lit(v).alias(k) for k, v in literals.items()], "*")


def evaluate_subsets(tokens: DataFrame, tasks: list[str], model: str, mode: str, quality: Column | str = "quality", **options) -> DataFrame:
    """``evaluate`` of all rows and of good-quality rows, tagged by subset."""
    good = tokens.where(F.col(quality) == "good" if isinstance(quality, str) else quality)
    return tag(evaluate(tokens, tasks, model, mode, **options), subset="all").unionByName(tag(evaluate(good, tasks, model, mode, **options), subset="quality_good"))
