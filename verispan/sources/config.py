"""Experiment configuration: YAML to frozen records, checked by a table of rules."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

import yaml

from .artifacts import json_digest

JSD_MODES = ("standard", "legacy")
PAIRED = {"standard": "context_only", "legacy": "whole_prefix"}


@dataclass(frozen=True)
class Dataset:
    response_path: str
    source_path: str
    generator_model: str = "llama-2-7b-chat"
    tasks: tuple[str, ...] = ("QA", "Data2txt", "Summary")
    include_truncated_test: bool = True
    dev_per_task: int = 50
    split_seed: int = 2024
    system_prompt: str = "You are a helpful assistant."


@dataclass(frozen=True)
class Model:
    name: str
    path: str
    family: str
    tokenizer_path: str = ""
    enable_thinking: bool = False
    max_length: int | None = None


@dataclass(frozen=True)
class Extraction:
    context_top_fraction: float = 0.10
    copying_candidate_count: int = 32
    copying_vocab_sample_size: int = 1024
    copying_seed: int = 2024
    token_chunk_size: int = 16
    vocab_chunk_size: int = 262144
    jsd_modes: tuple[str, ...] = JSD_MODES
    primary_jsd_mode: str = "standard"
    primary_ecs_mode: str = "context_only"
    include_legacy_whole_prefix_ecs: bool = True


@dataclass(frozen=True)
class CalibrationSettings:
    alpha: float = 1.0
    head_k_min: int = 1
    head_k_max: int = 32
    layer_k_min: int = 1
    layer_k_max: int = 32
    beta_min: float = 0.1
    beta_max: float = 1.9
    beta_step: float = 0.1
    selection_metric: str = "task_macro_token_auc"


@dataclass(frozen=True)
class Evaluation:
    bootstrap_samples: int = 1000
    bootstrap_seed: int = 42
    confidence_level: float = 0.95
    include_quality_good_sensitivity: bool = True


@dataclass(frozen=True)
class Experiment:
    name: str
    output_dir: str
    seed: int
    dataset: Dataset
    models: dict[str, Model]
    extraction: Extraction = field(default_factory=Extraction)
    calibration: CalibrationSettings = field(default_factory=CalibrationSettings)
    evaluation: Evaluation = field(default_factory=Evaluation)

    def digest(self) -> str:
        return json_digest(asdict(self))

    def modes(self) -> list[str]:
        """Calibration modes that the features allow, the primary one first."""
        known = [m for m in self.extraction.jsd_modes if m == "standard" or self.extraction.include_legacy_whole_prefix_ecs]
        return sorted(known, key=lambda m: m != self.extraction.primary_jsd_mode)

    def model(self, key: str) -> Model:
        if key not in self.models:
            raise ValueError(f"unknown model {key!r}; known: {', '.join(self.models)}")
        return self.models[key]


#: What must hold of an experiment, and what is said if it doesn't.
RULES: list[tuple[Callable[[Experiment], bool], str]] = [
    (lambda x: bool(x.models), "at least one model is needed"),
    (lambda x: x.dataset.dev_per_task >= 1, "dataset.dev_per_task must be positive"),
    (lambda x: bool(x.dataset.system_prompt.strip()), "dataset.system_prompt must not be empty"),
    (lambda x: len(set(x.dataset.tasks)) == len(x.dataset.tasks) > 0, "dataset.tasks must be unique and not empty"),
    (lambda x: all(m.family in ("llama", "qwen3") for m in x.models.values()), "models.family must be llama or qwen3"),
    (lambda x: not any(m.family == "qwen3" and m.enable_thinking for m in x.models.values()), "thinking must be off"),
    (lambda x: all(m.max_length is None or m.max_length > 0 for m in x.models.values()), "models.max_length must be positive"),
    (lambda x: 0 < x.extraction.context_top_fraction <= 1, "extraction.context_top_fraction must be in (0, 1]"),
    (lambda x: x.extraction.copying_candidate_count >= 1, "extraction.copying_candidate_count must be positive"),
    (lambda x: x.extraction.copying_vocab_sample_size >= 2, "extraction.copying_vocab_sample_size must be two or more"),
    (lambda x: x.extraction.token_chunk_size >= 1, "extraction.token_chunk_size must be positive"),
    (lambda x: x.extraction.vocab_chunk_size >= 1, "extraction.vocab_chunk_size must be positive"),
    (lambda x: set(x.extraction.jsd_modes) <= set(JSD_MODES), "extraction.jsd_modes has an unknown mode"),
    (lambda x: x.extraction.primary_jsd_mode in x.extraction.jsd_modes, "extraction.primary_jsd_mode must be one of jsd_modes"),
    (lambda x: x.extraction.primary_ecs_mode in PAIRED.values(), "extraction.primary_ecs_mode is unknown"),
    (lambda x: PAIRED.get(x.extraction.primary_jsd_mode) == x.extraction.primary_ecs_mode, "extraction.primary_jsd_mode and primary_ecs_mode don't go together"),
    (lambda x: x.extraction.primary_jsd_mode == "standard" or x.extraction.include_legacy_whole_prefix_ecs, "the legacy mode needs whole-prefix features"),
    (lambda x: min(x.calibration.head_k_min, x.calibration.layer_k_min) >= 1, "calibration k bounds must be positive"),
    (lambda x: x.calibration.head_k_max >= x.calibration.head_k_min, "calibration.head_k_max is below head_k_min"),
    (lambda x: x.calibration.layer_k_max >= x.calibration.layer_k_min, "calibration.layer_k_max is below layer_k_min"),
    (lambda x: x.calibration.head_k_max <= x.extraction.copying_candidate_count, "calibration.head_k_max exceeds the candidate heads"),
    (lambda x: 0 < x.calibration.beta_min <= x.calibration.beta_max, "calibration beta bounds must be 0 < beta_min <= beta_max"),
    (lambda x: x.calibration.beta_step > 0, "calibration.beta_step must be positive"),
    (lambda x: x.calibration.alpha > 0, "calibration.alpha must be positive"),
    (lambda x: x.calibration.selection_metric == "task_macro_token_auc", "calibration.selection_metric must be task_macro_token_auc"),
    (lambda x: x.evaluation.bootstrap_samples >= 0, "evaluation.bootstrap_samples must not be negative"),
    (lambda x: 0 < x.evaluation.confidence_level < 1, "evaluation.confidence_level must be in (0, 1)"),
]


def validate(config: Experiment) -> None:
    if broken := [text for holds, text in RULES if not holds(config)]:
        raise ValueError("; ".join(broken))


def _path(value: str, base: Path) -> str:
    """value with ~ and variables expanded, relative to the configuration file; URIs stay."""
    held = os.path.expandvars(os.path.expanduser(str(value)))
    return held if "://" in held or os.path.isabs(held) else str((base / held).resolve())


def _section(raw: dict, name: str, needed: bool = False) -> dict:
    found = raw.get(name, {})
    if not isinstance(found, dict) or needed and not found:
        raise ValueError(f"{name} must be a mapping")
    return found


def _record(kind: type, values: dict, strict: bool) -> object:
    """A record of the known keys; unknown ones are an error if ``strict``, else left out."""
    known = {f.name for f in fields(kind)}
    if strict and (unknown := sorted(set(values) - known)):
        raise ValueError(f"unknown keys for {kind.__name__}: {', '.join(unknown)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known})


def load_config(path: str) -> Experiment:
    at = Path(path).expanduser().resolve()
    raw = yaml.safe_load(at.read_text(encoding="utf-8"))
    if not isinstance(raw, dict):
        raise ValueError("the configuration must be a mapping")
    data = _section(raw, "dataset", True)
    models = {}
    for key, item in _section(raw, "models", True).items():
        if not isinstance(item, dict):
            raise ValueError(f"models.{key} must be a mapping")
        own = {"name": key, **item, "path": _path(item["path"], at.parent)}
        own["tokenizer_path"] = _path(item.get("tokenizer_path", item["path"]), at.parent)
        models[str(key)] = _record(Model, own, False)
    extraction = _section(raw, "extraction")
    short = lambda mode: "legacy" if str(mode).startswith("legacy_") else mode
    extraction |= {k: [short(m) for m in extraction[k]] for k in ("jsd_modes",) if k in extraction}
    extraction |= {k: short(extraction[k]) for k in ("primary_jsd_mode",) if k in extraction}
    config = Experiment(
        str(raw.get("name", at.stem)), _path(raw.get("output_dir", "outputs"), at.parent), int(raw.get("seed", 2024)),
        _record(Dataset, data | {k: _path(data[k], at.parent) for k in ("response_path", "source_path")}, False), models,
        _record(Extraction, extraction, True), _record(CalibrationSettings, _section(raw, "calibration"), True), _record(Evaluation, _section(raw, "evaluation"), True),
    )
    validate(config)
    return config
