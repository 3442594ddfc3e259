"""Calibration: discover and rank features, search a three-parameter score, freeze and apply it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import minmax
from .auc import rank_features, roc_auc, strict_mean
from .bootstrap import kernel_auc
from .checks import bad_binary, bad_finite, require_columns, require_none, shared_keys, test_rows

#: The grammar of feature columns, by mode: (head features, layer features). Fixed values.
GRAMMAR = {
    "standard": (r"ecs_l(\d+)_h(\d+)", r"pks_standard_l(\d+)"),
    "legacy": (r"ecs_whole_l(\d+)_h(\d+)", r"pks_legacy(?:_[a-z]+)?_l(\d+)"),
}
ALIASES = {"paper": "standard"}
BETAS = tuple(round(0.1 * k, 12) for k in range(1, 20))
SCORES = ("score", "ecs_sum", "pks_sum", "ecs_scaled", "pks_scaled")


def normalize_mode(mode: str) -> str:
    """The name of a mode; ``legacy`` may carry a suffix, as may its columns."""
    found = ALIASES.get(mode, "legacy" if mode.startswith("legacy_") else mode)
    if found not in GRAMMAR:
        raise ValueError(f"unknown mode {mode!r}")
    return found


def float_grid(start: float, stop: float, step: float) -> list[float]:
    """start, start + step, ... up to stop (inclusive within a billionth), rounded to 12 digits."""
    count = int(np.floor((stop - start) / step + 1e-9)) + 1
    return [round(start + k * step, 12) for k in range(count)]


def head_feature(layer: Column | str, head: Column | str, family: str = "ecs") -> Column:
    return F.format_string(f"{family}_l%d_h%d", layer, head)


def layer_feature(layer: Column | str, family: str = "pks_standard") -> Column:
    return F.format_string(f"{family}_l%d", layer)


def discover_columns(columns: list[str], mode: str) -> tuple[list[str], list[str]]:
    """(head features, layer features) among the columns, in numeric order."""
    out = []
    for pattern in GRAMMAR[normalize_mode(mode)]:
        found = [(tuple(map(int, m.groups())), c) for c in columns if (m := re.fullmatch(pattern, c))]
        out.append([c for _, c in sorted(found)])
    if not all(out):
        raise ValueError(f"no feature columns of mode {mode!r}")
    return out[0], out[1]


def checked_grid(values: list, upper: int, name: str) -> list[int]:
    kept = list(dict.fromkeys(int(v) for v in values))
    if not kept or any(v < 1 or v > upper for v in kept):
        raise ValueError(f"{name} must be within 1..{upper}")
    return kept


@dataclass(frozen=True)
class Scale:
    low: float
    high: float

    def __call__(self, value: Column) -> Column:
        return minmax(value, F.lit(self.low), F.lit(self.high))


@dataclass(frozen=True)
class Calibration:
    """Frozen state of a score alpha * scaled layers - beta * scaled heads."""

    model: str
    mode: str
    heads: tuple[str, ...]
    layers: tuple[str, ...]
    alpha: float
    beta: float
    head_scale: Scale
    layer_scale: Scale
    objective: float
    tasks: tuple[str, ...]

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, held: dict) -> Calibration:
        held = dict(held) | {k: Scale(**held[k]) for k in ("head_scale", "layer_scale")} | {k: tuple(held[k]) for k in ("heads", "layers", "tasks")}
        return cls(**held)


def sum_of(columns: list[str] | tuple[str, ...]) -> Column:
    found = F.lit(0.0)
    for c in columns:
        found = found + F.col(c).cast("double")
    return found


def apply_calibration(rows: DataFrame, state: Calibration, score: str = "score", components: bool = True) -> DataFrame:
    """rows with the score, and its parts: a narrow projection, no shuffle."""
    require_columns(rows, [*state.heads, *state.layers])
    parts = rows.withColumns({"ecs_sum": sum_of(state.heads), "pks_sum": sum_of(state.layers)})
    parts = parts.withColumns({"ecs_scaled": state.head_scale(F.col("ecs_sum")), "pks_scaled": state.layer_scale(F.col("pks_sum"))})
    parts = parts.withColumn(score, state.alpha * F.col("pks_scaled") - state.beta * F.col("ecs_scaled"))
    return parts if components else parts.drop(*SCORES[1:])


def prefix_sums(rows: DataFrame, key: list[str], ranked: list[str]) -> DataFrame:
    """(key..., k, total): sums of the first k ranked columns, folded in the row without a shuffle."""
    values = F.array(*[F.col(c).cast("double") for c in ranked])
    none = F.array().cast("array<struct<k:int,total:double>>")

    def step(acc: Column, v: Column) -> Column:
        return F.array_append(acc, F.struct((F.size(acc) + 1).alias("k"), (F.coalesce(F.try_element_at(acc, F.lit(-1))["total"], F.lit(0.0)) + v).alias("total")))

    return rows.select(*key, F.inline(F.aggregate(values, none, step)))


def grid(heads: list[int], layers: list[int], betas: list[float], spark) -> DataFrame:
    """The hyper-parameter grid, (k_heads, k_layers, beta)."""
    one = spark.range(1)
    at = lambda name, values, kind: F.explode(F.array(*[F.lit(v).cast(kind) for v in values])).alias(name)
    return one.select(at("k_heads", heads, "int")).crossJoin(one.select(at("k_layers", layers, "int"))).crossJoin(one.select(at("beta", betas, "double")))


def best_of_grid(trace: DataFrame) -> DataFrame:
    """The grid row with the largest objective; ties to fewer features, then fewer heads and layers, then the smaller beta."""
    order = F.struct("objective", -(F.col("k_heads") + F.col("k_layers")), -F.col("k_heads"), -F.col("k_layers"), -F.col("beta"))
    whole = F.struct(*[F.col(c) for c in trace.columns])
    return trace.where(F.col("objective").isNotNull()).agg(F.max_by(whole, order).alias("best")).where("best is not null").select("best.*")


def search_trace(train: DataFrame, dev: DataFrame, head_rank: list[str], layer_rank: list[str], tasks: list[str], heads: list[int], layers: list[int], betas: list[float], alpha: float, key: list[str], task: str, label: str) -> DataFrame:
    """(k_heads, k_layers, beta, objective) in SQL alone; for small grids, and to check ``search_kernel``."""
    def scaled(ranked: list[str], ks: list[int], name: str) -> DataFrame:
        bounds = prefix_sums(train, [], ranked).where(F.col("k").isin(ks)).groupBy("k").agg(F.min("total").alias("low"), F.max("total").alias("high"))
        sums = prefix_sums(dev, [*key, task, label], ranked).where(F.col("k").isin(ks)).join(F.broadcast(bounds), "k")
        return sums.select(*key, task, label, F.col("k").alias(f"k_{name}"), minmax("total", F.col("low"), F.col("high")).alias(name))

    points = scaled(head_rank, heads, "heads").join(scaled(layer_rank, layers, "layers"), [*key, task, label])
    points = points.withColumn("beta", F.explode(F.array(*[F.lit(b) for b in betas])))
    points = points.withColumn("value", F.round(alpha * F.col("layers") - F.col("beta") * F.col("heads"), 12))
    found = roc_auc(points, ["k_heads", "k_layers", "beta", task], label, "value", ranges=1).where(F.col(task).isin(tasks))
    return found.groupBy("k_heads", "k_layers", "beta").agg(strict_mean("auc", len(tasks)).alias("objective"))


def search_kernel(train: DataFrame, dev: DataFrame, head_rank: list[str], layer_rank: list[str], tasks: list[str], heads: list[int], layers: list[int], betas: list[float], alpha: float, task: str, label: str) -> DataFrame:
    """The same table by numpy over (k_heads, k_layers) pairs in parallel.

    The dev set goes to all tasks once; it is a fixed number of responses for each task by design
    (``dev_split``), whatever the corpus holds. Bounds come from train by one aggregation.
    """
    spark = train.sparkSession
    bounds = {}
    for name, ranked in (("heads", head_rank), ("layers", layer_rank)):
        rows = prefix_sums(train, [], ranked).groupBy("k").agg(F.min("total").alias("low"), F.max("total").alias("high")).collect()
        bounds[name] = {r["k"]: (r["low"], r["high"]) for r in rows}
    held = dev.where(F.col(task).isin(tasks)).select(task, label, *[F.col(c).cast("double") for c in [*head_rank, *layer_rank]]).toPandas()
    matrices = {}
    for name, ranked in (("heads", head_rank), ("layers", layer_rank)):
        sums = np.cumsum(held[ranked].to_numpy(float), axis=1)
        low, high = (np.array([bounds[name][k + 1][j] for k in range(len(ranked))]) for j in (0, 1))
        spread = np.where(high == low, 1.0, high - low)
        matrices[name] = np.where(high == low, 0.0, (sums - low) / spread)
    of, y = held[task].to_numpy(), held[label].to_numpy(int)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for kh, kl in zip(batch["k_heads"], batch["k_layers"], strict=True):
                for beta in betas:
                    s = np.round(alpha * matrices["layers"][:, kl - 1] - beta * matrices["heads"][:, kh - 1], 12)
                    aucs = []
                    for t in tasks:
                        own = of == t
                        order = np.argsort(s[own], kind="stable")
                        aucs.append(kernel_auc(y[own][order], s[own][order], np.ones(own.sum())) if own.any() else float("nan"))
                    mean = float(np.mean(aucs))
                    out.append((kh, kl, beta, None if np.isnan(mean) else mean))
            yield pd.DataFrame(out, columns=["k_heads", "k_layers", "beta", "objective"])

    pairs = grid(heads, layers, [0.0], spark).drop("beta").repartition(min(len(heads) * len(layers), spark.sparkContext.defaultParallelism * 2))
    return pairs.mapInPandas(run, "k_heads int, k_layers int, beta double, objective double")


def search_calibration(
    train: DataFrame, dev: DataFrame, model: str, mode: str, tasks: list[str], heads: list[int], layers: list[int], betas: list[float] = BETAS, alpha: float = 1.0,
    label: str = "token_label", task: str = "task", response: str = "response_id", columns: tuple[list[str], list[str]] | None = None,
) -> tuple[Calibration, DataFrame]:
    """(frozen state, grid trace): features ranked and scaled on train, the grid judged on dev by macro AUC.

    Raises if test rows, shared responses, bad labels or bad features are found, or if no grid point
    has a defined objective.
    """
    mode = normalize_mode(mode)
    head_columns, layer_columns = columns or discover_columns(train.columns, mode)
    for name, part in (("train", train), ("dev", dev)):
        require_columns(part, [task, response, label, *head_columns, *layer_columns])
        if part.isEmpty():
            raise ValueError(f"{name} is empty")
        require_none(test_rows(part).where("n > 0"), f"{name} holds test rows")
        require_none(bad_binary(part, label).where("bad > 0"), f"{name} labels must be 0 or 1")
        require_none(bad_finite(part, *head_columns, *layer_columns).where("bad > 0"), f"{name} features must be finite")
    require_none(shared_keys(train, dev, task, response), "responses in both train and dev")
    heads, layers = checked_grid(heads, len(head_columns), "heads"), checked_grid(layers, len(layer_columns), "layers")
    ranked = lambda names, inverse: [r["feature"] for r in rank_features(train, names, label, inverse).orderBy("rank").collect()]
    head_rank, layer_rank = ranked(head_columns, True)[: max(heads)], ranked(layer_columns, False)[: max(layers)]
    trace = search_kernel(train, dev, head_rank, layer_rank, list(tasks), heads, layers, list(betas), alpha, task, label)
    best = best_of_grid(trace).first()
    if best is None:
        raise ValueError("no grid point has a defined objective: a task is missing or has one class")
    chosen = {"heads": head_rank[: best["k_heads"]], "layers": layer_rank[: best["k_layers"]]}
    row = train.agg(*[f(sum_of(c)).alias(f"{n}_{m}") for n, c in chosen.items() for m, f in (("low", F.min), ("high", F.max))]).first()
    scale = {n: Scale(row[f"{n}_low"], row[f"{n}_high"]) for n in chosen}
    state = Calibration(model, mode, tuple(chosen["heads"]), tuple(chosen["layers"]), alpha, best["beta"], scale["heads"], scale["layers"], best["objective"], tuple(tasks))
    return state, trace
