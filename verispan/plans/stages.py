"""The experiment's stages: audit, head discovery, extraction, calibration, evaluation, comparison."""

from __future__ import annotations

import functools
import itertools
import json
import pathlib
from collections.abc import Callable, Iterator, Mapping
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..doctor import commit, versions
from ..operators import evaluation, splits
from ..operators.attention import rank_copy_heads
from ..operators.calibration import Calibration, apply_calibration, float_grid, search_calibration
from ..scoring.decoder import Decoder, Shape, sample_ids
from ..scoring.protocol import PieceTokenizer, Tokenizer, align
from ..sources.artifacts import VERSION, FeatureTable, IntegrityError, Store, canonical_digest, canonical_newlines, file_digest, json_digest, safe_name, write_results
from ..sources.config import Experiment
from ..sources.ragjson import load_examples

EVAL_SPLITS = ("calibration_train", "dev", "test")
#: Responses of each split and task of the official set (fixed values).
OFFICIAL = {"train": {"QA": 839, "Data2txt": 883, "Summary": 793}, "test": {"QA": 150, "Data2txt": 150, "Summary": 150}}
METADATA = (
    "response_id string, source_id string, generator_model string, task string, quality string, source_split string, original_split string, eval_split string, response_label int, "
    "token_index int, token_id int, token_position int, predictor_position int, char_start int, char_end int, token_label int"
)


class Run:
    """One experiment: its configuration, its store, and how to make tokenizers and scorers.

    Each model key has a tokenizer and a scorer of its own, made once a Python worker, so a real model
    loads once an executor core. ``tokenizers`` and ``decoders`` map keys to their makers; a decoder's maker
    takes what ``_scorer`` passes. A key without one gets the plain tokenizer, or a numpy decoder seeded by
    its configured path.
    """

    def __init__(self, spark: SparkSession, config: Experiment, tokenizers: Mapping[str, Callable[[], Tokenizer]] | None = None, decoders: Mapping[str, Callable[..., Decoder]] | None = None):
        self.spark, self.config, self.tokenizers, self.decoders = spark, config, dict(tokenizers or {}), dict(decoders or {})
        self.store = Store(spark, config.output_dir)
        self._digests: dict[tuple, str] = {}

    def decoder(self, key: str) -> Callable[..., Decoder]:
        model = self.config.model(key)
        return self.decoders.get(key) or functools.partial(Decoder, Shape(), int(json_digest([key, model.path])[:8], 16))

    def tokenizer(self, key: str) -> Callable[[], Tokenizer]:
        self.config.model(key)
        return self.tokenizers.get(key, PieceTokenizer)

    def folder(self, key: str) -> str:
        return f"{safe_name(self.config.name)}/{safe_name(key)}"

    def examples(self) -> DataFrame:
        d = self.config.dataset
        rows = load_examples(self.spark, d.response_path, d.source_path, d.generator_model, tasks=d.tasks)
        return rows if d.include_truncated_test else rows.where("split <> 'test' or quality = 'good'")

    def partitioned(self) -> DataFrame:
        return splits.partitions(self.examples(), self.config.dataset.dev_per_task, self.config.dataset.split_seed)

    def dataset_digest(self) -> str:
        """A digest of both input files, byte by byte, but the same for LF and CRLF copies; read once for each state of the files."""
        d = self.config.dataset
        jvm, found = self.spark._jvm.org.apache.hadoop.fs, []
        for path in (d.response_path, d.source_path):
            where = jvm.Path(path)
            at = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(where)
            state = (path, at.getLen(), at.getModificationTime())
            if state not in self._digests:
                self._digests[state] = canonical_digest(self.spark, path)
            found.append(self._digests[state])
        return json_digest(found)

    def depends(self, key: str, heads: list | None = None) -> dict:
        held = {"version": VERSION, "implementation": implementation(), "dataset": self.dataset_digest(), "files": self._model_files(key), "extraction": asdict(self.config.extraction), "system_prompt": self.config.dataset.system_prompt, "model": asdict(self.config.model(key))}
        return held | ({"heads": json_digest(heads)} if heads is not None else {})

    def _model_files(self, key: str) -> dict[str, str]:
        """SHA-256 of a scorer's checkpoint and tokenizer files, read once for each state of the files; none where a path doesn't exist."""
        jvm, found = self.spark._jvm.org.apache.hadoop.fs, {}
        model = self.config.model(key)
        for path in sorted({model.path, model.tokenizer_path or model.path}):
            where = jvm.Path(path)
            files = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for at in files.listStatus(where) if files.exists(where) else ():
                state = (at.getPath().toString(), at.getLen(), at.getModificationTime())
                if at.isFile():
                    if state not in self._digests:
                        self._digests[state] = file_digest(self.spark, state[0])
                    found[state[0]] = self._digests[state]
        return found

    # Stages

    def audit(self, strict: bool = True) -> dict:
        """Counts by split and task, partition sizes and the digest of the dev ids."""
        rows = self.partitioned()
        stats = rows.groupBy("split", "task").agg(F.count("*").alias("responses"), F.sum("response_label").alias("positive"), F.sum(F.size("spans")).alias("spans"), F.count_if(F.col("quality") != "good").alias("truncated")).collect()
        found = {s: {t: {"responses": 0, "positive": 0, "spans": 0, "truncated": 0} for t in self.config.dataset.tasks} for s in OFFICIAL}
        for r in stats:
            found.setdefault(r["split"], {})[r["task"]] = {k: r[k] for k in ("responses", "positive", "spans", "truncated")}
        if strict and (got := {s: {t: v["responses"] for t, v in of.items()} for s, of in found.items()}) != OFFICIAL:
            raise ValueError(f"the counts aren't the official ones: {got}")
        dev = rows.where("eval_split = 'dev'").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("response_id")), "\n"), 256).alias("d")).first()["d"]
        sizes = {r["eval_split"]: r["count"] for r in rows.groupBy("eval_split").count().collect()}
        return {"counts": found, "partitions": {s: sizes.get(s, 0) for s in EVAL_SPLITS}, "dev_ids_sha256": dev, "dataset_sha256": self.dataset_digest(), "config_sha256": self.config.digest()}

    def discover_heads(self, key: str, force: bool = False) -> list[tuple[int, int]]:
        """The candidate copy heads of a scorer; ranked by Spark, kept as JSON and Parquet."""
        name, x = f"{self.folder(key)}/copy_heads.json", self.config.extraction
        depends = self.depends(key)
        if not force and self.store.exists(name):
            held = self.store.read_manifest(name)
            if held["depends"] == json.loads(json.dumps(depends)):
                return [tuple(h) for h in held["heads"]]
        model = self.decoder(key)()
        size = model.shape.vocabulary
        rows = rank_copy_heads(self.spark.createDataFrame(pd.DataFrame(model.discover_copy_heads(min(x.copying_vocab_sample_size, size), x.copying_seed)))).orderBy("copying_rank")
        rows.write.mode("overwrite").parquet(self.store.at(f"{self.folder(key)}/copy_heads.parquet"))
        heads = [(r["layer"], r["head"]) for r in rows.limit(x.copying_candidate_count).collect()]
        sample = sample_ids(size, min(x.copying_vocab_sample_size, size), x.copying_seed)
        self.store.write_manifest(name, {"depends": depends, "heads": heads, "sample_sha256": json_digest(sample), "vocabulary": size})
        return heads

    def features(self, key: str) -> FeatureTable:
        heads = self.discover_heads(key)
        return FeatureTable(self.store, f"{self.folder(key)}/features", self.depends(key, heads))

    def extract(self, key: str, split: str, force: bool = False, limit: int | None = None, shards: int = 1, shard: int = 0) -> int:
        """Extract the features of a split's pending responses in one job; the number of their rows."""
        if split not in EVAL_SPLITS:
            raise ValueError(f"split must be one of {EVAL_SPLITS}")
        heads, table = self.discover_heads(key), self.features(key)
        whole = rows = self.partitioned().where(F.col("eval_split") == split)
        if shards > 1:
            rows = splits.work_shard(rows, shards, shard, splits.example_order(["train", "test"], list(self.config.dataset.tasks))).drop("ordinal")
        if force:
            for name in self.store.names(table.folder):
                if name.startswith(f"{split}-") and name.endswith(".manifest.json"):
                    self.store.delete(f"{table.folder}/{name}")
        rows = table.pending(rows, split)
        if limit is not None:
            rows = rows.orderBy(*splits.natural_key("response_id")).limit(limit)
        done = table.append(extract_features(rows, self.tokenizer(key), self._scorer(key, heads), self.config.dataset.system_prompt, self.config.model(key).max_length), split)
        if table.pending(whole.select("response_id"), split).isEmpty():
            self.store.write_manifest(f"{table.folder}/{split}.split.json", {"split": split, "responses": whole.count(), "depends": table.depends, "features": table.fingerprint(split)})
        return done["artifact"]["rows"] if done else 0

    def _scorer(self, key: str, heads: list[tuple[int, int]]) -> Callable[[], Decoder]:
        x = self.config.extraction
        return functools.partial(
            self.decoder(key), copy_heads=heads, fraction=x.context_top_fraction, modes=x.jsd_modes, whole_prefix=x.include_legacy_whole_prefix_ecs,
            token_chunk=x.token_chunk_size, vocab_chunk=x.vocab_chunk_size,
        )

    def _grids(self, heads: int, layers: int) -> dict:
        c = self.config.calibration
        return {"heads": list(range(c.head_k_min, min(c.head_k_max, heads) + 1)), "layers": list(range(c.layer_k_min, min(c.layer_k_max, layers) + 1)), "betas": float_grid(c.beta_min, c.beta_max, c.beta_step), "alpha": c.alpha}

    def calibrate(self, key: str) -> dict[str, Calibration]:
        """Search, freeze and store each mode's calibration; the primary mode's also under its own name."""
        from ..operators.calibration import discover_columns

        table, examples = self.features(key), self.partitioned()
        parts = {s: table.require(examples.where(F.col("eval_split") == s), s) for s in EVAL_SPLITS[:2]}
        out = {}
        for mode in self.config.modes():
            head_columns, layer_columns = discover_columns(parts["dev"].columns, mode)
            state, trace = search_calibration(parts["calibration_train"], parts["dev"], key, mode, list(self.config.dataset.tasks), columns=(head_columns, layer_columns), **self._grids(len(head_columns), len(layer_columns)))
            trace.write.mode("overwrite").parquet(self.store.at(f"{self.folder(key)}/calibration/{mode}_grid.parquet"))
            held = {"config": self.config.digest(), "features": table.fingerprint(*EVAL_SPLITS[:2]), "state": state.to_dict()}
            self.store.write_manifest(f"{self.folder(key)}/calibration/{mode}.json", held)
            if mode == self.config.extraction.primary_jsd_mode:
                self.store.write_manifest(f"{self.folder(key)}/calibration/primary.json", held)
            out[mode] = state
        return out

    def scored_test(self, key: str, mode: str) -> DataFrame:
        """The test split's tokens with the frozen score, after checks that the state belongs to it."""
        table, examples = self.features(key), self.partitioned()
        held = self.store.read_manifest(f"{self.folder(key)}/calibration/{mode}.json")
        if held["config"] != self.config.digest() or held["state"]["mode"] != mode or held["features"] != table.fingerprint(*EVAL_SPLITS[:2]):
            raise IntegrityError("the calibration belongs to another configuration, mode or feature set")
        test = table.require(examples.where("eval_split = 'test'"), "test")
        return apply_calibration(test, Calibration.from_dict(held["state"])).withColumn("label", F.col("token_label"))

    def _options(self) -> dict:
        e = self.config.evaluation
        return {"replicates": e.bootstrap_samples, "seed": e.bootstrap_seed, "confidence": e.confidence_level}

    def evaluate(self, key: str) -> DataFrame:
        """Metrics of each mode on all test rows and, as a sensitivity check, on those of good quality."""
        frames, tasks = [], list(self.config.dataset.tasks)
        for mode in self.config.modes():
            rows = self.scored_test(key, mode)
            made = evaluation.evaluate_subsets(rows, tasks, key, mode, **self._options())
            frames.append(made if self.config.evaluation.include_quality_good_sensitivity else made.where("subset = 'all'"))
        metrics = self._kept(frames, f"{self.folder(key)}/evaluation")
        write_results(self.store, f"{self.folder(key)}/evaluation", metrics, self._metadata(models=[key]), f"Evaluation of {key}")
        return metrics

    def _metadata(self, models: list[str]) -> dict:
        """What results depend on: configuration, data, features and environment."""
        held = {m: FeatureTable(self.store, f"{self.folder(m)}/features", self.depends(m, self.discover_heads(m))).fingerprint(*EVAL_SPLITS) for m in models}
        return {"config": self.config.digest(), "dataset": self.dataset_digest(), "models": models, "features": held, "environment": versions(self), "commit": commit()}

    def _kept(self, frames: list[DataFrame], folder: str) -> DataFrame:
        whole = frames[0]
        for other in frames[1:]:
            whole = whole.unionByName(other)
        path = self.store.at(f"{folder}/computed.parquet")
        whole.write.mode("overwrite").parquet(path)  # bootstraps are not computed again for each report
        return self.spark.read.parquet(path)

    def compare(self, first: str, second: str) -> DataFrame:
        """Paired metrics of two scorers, by mode and subset."""
        if first == second:
            raise ValueError("two different scorers are needed")
        frames, tasks = [], list(self.config.dataset.tasks)
        for mode in self.config.modes():
            a, b = self.scored_test(first, mode), self.scored_test(second, mode)
            for subset, keep in (("all", F.lit(True)), ("quality_good", F.col("quality") == "good")):
                made = evaluation.compare(a.where(keep), b.where(keep), tasks, (first, second), **self._options())
                frames.append(evaluation.tag(made, subset=subset, mode=mode))
        folder = f"{safe_name(self.config.name)}/comparisons/{safe_name(f'{first}_vs_{second}')}"
        metrics = self._kept(frames, folder)
        write_results(self.store, folder, metrics, self._metadata(models=[first, second]), f"{first} against {second}")
        return metrics

    def run_all(self, models: list[str] | None = None, force: bool = False) -> dict:
        """All stages of all models, then all pairs of models."""
        keys = list(models or self.config.models)
        report: dict = {"audit": self.audit(strict=False), "rows": {}}
        for key in keys:
            self.discover_heads(key, force)
            report["rows"][key] = {s: self.extract(key, s, force) for s in EVAL_SPLITS}
            self.calibrate(key)
            self.evaluate(key)
        for a, b in itertools.combinations(keys, 2):
            self.compare(a, b)
        return report


def extract_features(examples: DataFrame, tokenizer: Callable[[], Tokenizer], scorer: Callable[[], Decoder], system: str, max_length: int | None = None) -> DataFrame:
    """A row a response token: metadata and the scorer's columns, sorted by name.

    ``examples`` come from ``Run.partitioned``. Responses are dealt evenly over tasks; each worker makes its
    tokenizer and scorer once and streams its responses.
    """
    names = sorted(_probe(tokenizer, scorer, system))
    clash = set(names) & {c.split()[0] for c in METADATA.split(", ")}
    if clash:
        raise ValueError(f"feature columns clash with metadata: {sorted(clash)}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = None
        for batch in batches:
            made = made or (tokenizer(), scorer())
            for x in batch.itertuples(index=False):
                spans = [(s["start"], s["end"]) for s in x.spans]
                got = align(made[0], system, x.prompt, x.context, x.response, spans, max_length)
                scores = made[1].score(got.ids, got.predictors, got.context, got.prefix)
                if sorted(scores) != names or any(len(v) != len(got.positions) for v in scores.values()):
                    raise ValueError(f"response {x.response_id}: the scorer's columns don't fit")
                n = len(got.positions)
                rows = {
                    "response_id": x.response_id, "source_id": x.source_id, "generator_model": x.generator_model, "task": x.task, "quality": x.quality, "source_split": x.split,
                    "original_split": x.split, "eval_split": x.eval_split, "response_label": x.response_label, "token_index": range(n), "token_id": got.ids[got.positions], "token_position": got.positions,
                    "predictor_position": got.predictors, "char_start": [a for a, _ in got.offsets], "char_end": [z for _, z in got.offsets], "token_label": got.labels,
                }
                yield pd.DataFrame(rows | {k: scores[k].astype(float) for k in names})

    schema = METADATA + "".join(f", `{n}` double" for n in names)
    width = max(1, examples.sparkSession.sparkContext.defaultParallelism)
    return examples.repartition(width, "response_id").mapInPandas(run, schema)


def _probe(tokenizer: Callable[[], Tokenizer], scorer: Callable[[], Decoder], system: str) -> list[str]:
    got = align(tokenizer(), system, "read this", "this", "a b", [])
    return list(scorer().score(got.ids, got.predictors, got.context, got.prefix))


@functools.cache
def implementation() -> str:
    """A digest of the code that makes features."""
    folder = pathlib.Path(__file__).resolve().parents[1]
    files = [folder / "plans/stages.py", *sorted((folder / "scoring").glob("*.py"))]
    return json_digest({str(f.relative_to(folder)): canonical_newlines(f.read_bytes()) for f in files})


def decoder_of(shape: Shape, seed: int) -> Callable[..., Decoder]:
    """A maker of seeded decoders for ``Run``."""
    return functools.partial(Decoder, shape, seed)
