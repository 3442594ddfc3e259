"""Scoring, artifacts, configuration, stages, command line and streaming."""

import json

import numpy as np
import pytest
import yaml
from pyspark.sql import functions as F

from verispan import cli
from verispan.operators.calibration import Calibration, Scale
from verispan.plans.stages import Run, decoder_of
from verispan.scoring.decoder import Decoder, Shape, disks, sample_ids
from verispan.scoring.protocol import PieceTokenizer, align, flatten, shared_prefix
from verispan.sources import artifacts
from verispan.sources.config import RULES, load_config
from verispan.streaming.scores import scored_stream, write_scores


def test_alignment():
    tokenizer = PieceTokenizer()
    got = align(tokenizer, "sys", "Question\nCTX here\noutput:", "CTX here", "A BC DE", [(2, 4)])
    assert got.offsets == [(0, 1), (1, 2), (2, 4), (4, 5), (5, 7)] and got.labels.tolist() == [0, 0, 1, 0, 0]
    assert (got.positions - got.predictors == 1).all() and len(got.context) == 3 and got.prefix == got.positions[0]
    for prompt, context, response, message in [("p CTX", "CTX", "", "empty"), ("p CTX CTX", "CTX", "a", "more than once"), ("p", "CTX", "a", "does not occur")]:
        with pytest.raises(ValueError, match=message):
            align(tokenizer, "s", prompt, context, response, [])
    with pytest.raises(ValueError, match="limit"):
        align(tokenizer, "s", "p CTX", "CTX", "a", [], max_length=3)


def test_flattening_and_renders():
    assert flatten([[3, 4]], [[(0, 2), (2, 5)]]) == flatten([3, 4], [[0, 2], [2, 5]]) == ([3, 4], [(0, 2), (2, 5)])
    for ids, offsets in (([[1], [2]], [[(0, 1)], [(1, 2)]]), ([1], [(0, 1), (1, 2)]), ([1, 2], [(3, 4), (0, 1)]), ([1], [(2, 1)])):
        with pytest.raises((ValueError, TypeError)):
            flatten(ids, offsets)
    tokenizer = PieceTokenizer()
    assert shared_prefix(tokenizer, "s y", "ask < this", "an answer") == len(tokenizer(tokenizer.render("s y", "ask < this")))
    tokenizer.render_legacy = lambda system, prompt, response: prompt + response
    with pytest.raises(ValueError, match="legacy"):
        shared_prefix(tokenizer, "s", "p", "r")


@pytest.mark.parametrize("window", [None, 3])
def test_attention_parity(window):
    """Recomputed attention of chosen heads and positions equals that of the whole sequence."""
    model = Decoder(Shape(window=window))
    ids = np.arange(11) * 37
    inside = model.forward(ids)["inputs"][1]
    at = np.arange(11)
    whole = model.attention(1, inside, inside, at, at)
    assert np.allclose(whole.sum(axis=-1), 1) and np.allclose(np.triu(whole[0], 1), 0)
    assert np.allclose(model.attention(1, inside[4:7], inside, at[4:7], at, [3, 0]), whole[[3, 0], 4:7])
    if window:
        assert np.allclose(whole[0][8, :6], 0)
    with pytest.raises(ValueError):
        model.attention(1, inside[:1], inside[5:], at[:1], at[5:])
    with pytest.raises(ValueError):
        Shape(heads=3, kv_heads=2)


def test_copy_head_figures():
    shape = Shape(vocabulary=40, hidden=6, layers=1, heads=4, kv_heads=2, head_size=2, mlp=4)
    model = Decoder(shape, 3)
    found = model.discover_copy_heads(40, 1)
    for row in found:
        h, w = row["head"], model.layers[0]
        circuit = model.embedding @ w["v"][:, (h // 2) * 2 : (h // 2) * 2 + 2] @ w["o"][h * 2 : h * 2 + 2] @ model.unembedding
        assert row["trace"] == pytest.approx(np.trace(circuit))
        assert row["n_outliers"] == disks(circuit, 1.0)["n_outliers"]
    assert sample_ids(50, 10, 2024) == sample_ids(50, 10, 2024) and len(set(sample_ids(50, 10, 2024))) == 10


def test_chunks_change_nothing():
    ids, at = np.arange(40) * 13, np.arange(20, 39)
    whole = Decoder(token_chunk=1000).score(ids, at, np.arange(5, 15), 20)
    parts = Decoder(token_chunk=4, vocab_chunk=100).score(ids, at, np.arange(5, 15), 20)
    assert whole.keys() == parts.keys() and all(np.allclose(whole[k], parts[k]) for k in whole)


def test_json_forms():
    assert artifacts.plain({"a": {3, 1}, "b": np.float64("nan"), "c": np.arange(2), "d": (1, None)}) == {"a": [1, 3], "b": None, "c": [0, 1], "d": [1, None]}
    held = artifacts.sealed({"x": 1})
    assert artifacts.check_seal(json.loads(json.dumps(held))) == held
    with pytest.raises(artifacts.IntegrityError):
        artifacts.check_seal(held | {"x": 2})
    assert artifacts.is_subset({"a": {"b": 1}}, {"a": {"b": 1, "c": 2}}) and not artifacts.is_subset({"a": 2}, {"a": 1})
    assert artifacts.canonical_newlines(b'{"a":1}\r\n{}\r\n') == artifacts.canonical_newlines(b'{"a":1}\n{}\n') != artifacts.canonical_newlines(b'{"a":1}\r{}\n')
    assert artifacts.markdown([{"a": "x|y\nz", "b": None}], ["a", "b"]) == "| a | b |\n| --- | --- |\n| x\\|y z |  |\n"


def test_file_digests(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.bin").write_bytes(b"one")
    import hashlib

    assert artifacts.file_digests(spark, str(tmp_path), [str(tmp_path / "a/x.bin")]) == {"a/x.bin": hashlib.sha256(b"one").hexdigest()}
    with pytest.raises(ValueError):
        artifacts.file_digests(spark, str(tmp_path / "b"), [str(tmp_path / "a/x.bin")])


def test_feature_table(spark, tmp_path):
    store = artifacts.Store(spark, str(tmp_path))
    table = artifacts.FeatureTable(store, "features", {"v": 1})
    rows = spark.createDataFrame([(str(i), 0, float(i)) for i in range(4)], "response_id string, token_index int, score double")
    assert table.read("test") is None and table.append(rows.limit(0), "test") is None
    table.append(rows.where("response_id < '2'"), "test")
    assert sorted(r.response_id for r in table.pending(rows, "test").collect()) == ["2", "3"]
    with pytest.raises(artifacts.IntegrityError, match="2 responses"):
        table.require(rows, "test")
    table.append(rows.where("response_id >= '2'"), "test")
    assert table.require(rows, "test").count() == 4 and table.read("test", verify=True).count() == 4
    rows.write.parquet(store.at("features/test-orphan"))
    assert table.read("test").count() == 4  # a batch without a manifest doesn't count
    other = artifacts.FeatureTable(store, "features", {"v": 2})
    assert other.read("test") is None
    assert len(artifacts.migrate(store, "features", {"v": 2})) == 2 and other.read("test") is None
    artifacts.migrate(store, "features", {"v": 2}, apply=True)
    assert other.read("test").count() == 4 and artifacts.migrate(store, "features", {"v": 2}, apply=True) == []
    name = next(n for n in store.names("features") if n.endswith(".manifest.json"))
    store.write(f"features/{name}", store.read(f"features/{name}").replace(b'"rows": 2', b'"rows": 3'))
    assert other.read("test").count() == 2  # a manifest that was changed doesn't count


def test_changed_rows_are_refused(spark, tmp_path):
    store = artifacts.Store(spark, str(tmp_path))
    table = artifacts.FeatureTable(store, "features", {"v": 1})
    rows = spark.createDataFrame([(str(i), 0, float(i)) for i in range(4)], "response_id string, token_index int, score double")
    table.append(rows, "test")
    assert table.read("test").count() == 4
    batch = next(n for n in store.names("features") if not n.endswith(".json"))
    rows.withColumn("score", F.col("score") + 1).write.mode("overwrite").parquet(store.at(f"features/{batch}"))
    fresh = artifacts.FeatureTable(artifacts.Store(spark, str(tmp_path)), "features", {"v": 1})
    for use in (lambda: fresh.read("test"), lambda: fresh.pending(rows, "test"), lambda: fresh.require(rows, "test")):
        with pytest.raises(artifacts.IntegrityError, match="manifest"):
            use()


def test_adoption_needs_equal_rows(spark, tmp_path):
    store = artifacts.Store(spark, str(tmp_path))
    rows = spark.createDataFrame([(str(i), 0, float(i)) for i in range(4)], "response_id string, token_index int, score double")
    artifacts.FeatureTable(store, "features", {"v": 1}).append(rows, "test")
    equal, other = artifacts.FeatureTable(store, "equal", {"v": 2}), artifacts.FeatureTable(store, "other", {"v": 2})
    equal.append(rows.where("response_id = '1'"), "test")
    other.append(rows.where("response_id = '1'").withColumn("score", F.lit(9.0)), "test")
    with pytest.raises(ValueError, match="rows differ"):
        artifacts.migrate(store, "features", {"v": 2}, apply=True, proof=other)
    assert len(artifacts.migrate(store, "features", {"v": 2}, apply=True, proof=equal)) == 1


def test_publishing_replaces_whole_files(spark, tmp_path):
    store = artifacts.Store(spark, str(tmp_path))
    for data in (b"one", b"two"):
        store.write("a/x.json", data)
        assert store.read("a/x.json") == data and [n for n in store.names("a") if not n.endswith(".crc")] == ["x.json"]


def test_canonical_digest_of_files(spark, tmp_path, monkeypatch):
    import hashlib

    monkeypatch.setattr(artifacts, "PIECE", 3)
    data = b"a\r\nbc\r\n\rd \r\n  e\r"
    for name, raw in (("x", data), ("y", data.replace(b"\r\n", b"\n")), ("z", data[::-1])):
        (tmp_path / name).write_bytes(raw)
    assert artifacts.canonical_digest(spark, str(tmp_path / "x")) == artifacts.canonical_digest(spark, str(tmp_path / "y")) == hashlib.sha256(data.replace(b"\r\n", b"\n")).hexdigest()
    assert artifacts.canonical_digest(spark, str(tmp_path / "z")) != artifacts.canonical_digest(spark, str(tmp_path / "x"))


def test_dataset_digest_sees_order_and_blanks(spark, tmp_path):
    path = experiment(tmp_path)
    first = Run(spark, load_config(path)).dataset_digest()
    lines = (tmp_path / "r.jsonl").read_text().splitlines(True)
    seen = {first}
    for text in ("".join(lines[::-1]), "".join(lines)[:-1] + " \n", "".join(lines).replace("\n", "\r\n")):
        (tmp_path / "r.jsonl").write_bytes(text.encode())
        seen.add(Run(spark, load_config(path)).dataset_digest())
    assert len(seen) == 3  # CRLF is the same


def experiment(tmp_path, **more):
    tasks = {"QA": {"question": "q", "passages": "red fox ran"}, "Data2txt": {"name": "A", "open": True}, "Summary": "red fox ran"}
    contexts = {"QA": "red fox ran", "Data2txt": repr(tasks["Data2txt"]), "Summary": "red fox ran"}
    sources = [{"source_id": t, "task_type": t, "source": "x", "source_info": info, "prompt": f"do {contexts[t]} output:"} for t, info in tasks.items()]
    responses = []
    for t in tasks:
        for split, n in (("train", 6), ("test", 4)):
            for i in range(n):
                text, labels = f"the fox number {i} slept", []
                if i % 2:
                    labels = [{"start": 4, "end": 7, "text": "fox", "label_type": "x", "implicit_true": False, "due_to_null": False}]
                responses.append({"id": f"{t}-{split}-{i}", "source_id": t, "model": "llama-2-7b-chat", "split": split, "quality": "good" if i else "truncated", "response": text, "labels": labels})
    for name, rows in (("r", responses), ("s", sources)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps(x) + "\n" for x in rows))
    config = {"name": "try", "output_dir": "out", "dataset": {"response_path": "r.jsonl", "source_path": "s.jsonl", "dev_per_task": 2}, "models": {k: {"family": "llama", "path": "none"} for k in ("a", "b")}}
    config |= {"extraction": {"copying_candidate_count": 4, "copying_vocab_sample_size": 50}, "calibration": {"head_k_max": 2, "layer_k_max": 2, "beta_step": 0.9}, "evaluation": {"bootstrap_samples": 3}}
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(config | more))
    return str(tmp_path / "c.yaml")


def test_stages(spark, tmp_path, capsys):
    path = experiment(tmp_path)
    say = lambda *args: (cli.main(["--config", path, *args], spark), capsys.readouterr())
    code, out = say("audit-data")
    assert code == 2 and "official" in out.err
    code, out = say("audit-data", "--no-strict")
    report = json.loads(out.out)
    assert code == 0 and report["partitions"] == {"calibration_train": 12, "dev": 6, "test": 12} and report["counts"]["test"]["QA"]["positive"] == 2
    code, out = say("doctor")
    assert code == 0 and json.loads(out.out)["ok"]
    code, out = say("discover-heads", "--model", "a")
    assert len(json.loads(out.out)["heads"]) == 4
    assert json.loads(say("extract", "--model", "a", "--split", "test", "--limit", "2")[1].out)["rows"] > 0
    shards = [json.loads(say("extract", "--model", "a", "--split", "dev", "--num-shards", "2", "--shard-index", str(k))[1].out)["rows"] for k in (0, 1)]
    assert all(shards)
    code, out = say("calibrate", "--model", "a")
    assert code == 2 and "no features" in out.err
    for split in ("calibration_train", "dev", "test"):
        say("extract", "--model", "a", "--split", split)
        assert json.loads(say("extract", "--model", "a", "--split", split)[1].out)["rows"] == 0  # all done
    code, out = say("calibrate", "--model", "a")
    assert code == 0 and set(json.loads(out.out)) == {"standard", "legacy"}
    code, out = say("evaluate", "--model", "a")
    metrics = json.loads(out.out)["metrics"]
    assert code == 0 and len(metrics) == 2 * 2 * 5 and {m["subset"] for m in metrics} == {"all", "quality_good"}
    assert (tmp_path / "out/try/a/evaluation/report.md").exists()
    run = Run(spark, load_config(path))
    assert run.store.read_manifest("try/a/features/test.split.json")["responses"] == 12
    features = run.features("a").read("test")
    assert [c for c in features.columns if c.startswith("pks_standard")] == ["pks_standard_l0", "pks_standard_l1"] and features.columns[:2] == ["response_id", "source_id"]
    assert say("extract", "--model", "zzz", "--split", "dev")[0] == 2
    assert say("compare", "--first", "a", "--second", "a")[0] == 2


def test_compare_stage(spark, tmp_path):
    run = Run(spark, load_config(experiment(tmp_path, extraction={"copying_candidate_count": 2, "copying_vocab_sample_size": 20, "jsd_modes": ["standard"]})))
    report = run.run_all()
    assert set(report["rows"]) == {"a", "b"}
    rows = spark.read.parquet(run.store.at("try/comparisons/a_vs_b/metrics.parquet"))
    assert rows.count() == 10 and rows.where("abs(token_difference) > 1e-12").count() > 0  # each key has a scorer of its own
    assert json.loads(run.store.read("try/comparisons/a_vs_b/metrics.json"))["metadata"].keys() >= {"config", "dataset", "features", "environment", "commit"}
    same = {k: decoder_of(Shape(), 3) for k in "ab"}
    run = Run(spark, load_config(experiment(tmp_path, name="same", extraction={"copying_candidate_count": 2, "copying_vocab_sample_size": 20, "jsd_modes": ["standard"]})), decoders=same)
    run.run_all()
    assert spark.read.parquet(run.store.at("same/comparisons/a_vs_b/metrics.parquet")).where("abs(token_difference) > 1e-12").count() == 0


@pytest.mark.parametrize(
    "change",
    [
        {"models": {"q": {"family": "qwen3", "path": "x", "enable_thinking": True}}}, {"models": {"q": {"family": "other", "path": "x"}}}, {"extraction": {"context_top_fraction": 0}}, {"extraction": {"primary_jsd_mode": "legacy"}},
        {"calibration": {"head_k_max": 99}}, {"calibration": {"beta_min": 0}}, {"evaluation": {"confidence_level": 1}}, {"evaluation": {"unknown": 1}}, {"extraction": {"jsd_modes": ["x"]}},
    ],
)
def test_bad_configurations(tmp_path, change):
    with pytest.raises(ValueError):
        load_config(experiment(tmp_path, **change))


def test_configuration(tmp_path):
    config = load_config(experiment(tmp_path))
    assert config.output_dir == str(tmp_path / "out") and config.digest() == load_config(experiment(tmp_path)).digest() and config.modes() == ["standard", "legacy"]
    assert all(holds(config) for holds, _ in RULES) and len(RULES) == 27


def test_streaming_scores_equal_batch(spark, tmp_path):
    state = Calibration("m", "standard", ("ecs_l0_h0",), ("pks_standard_l0",), 1.0, 0.5, Scale(0, 1), Scale(0, 2), 1.0, ("QA",))
    rows = spark.range(20).select(F.col("id").cast("string").alias("response_id"), (F.col("id") / 20).alias("ecs_l0_h0"), F.col("id").cast("double").alias("pks_standard_l0"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    write_scores(scored_stream(spark, f"{tmp_path}/in", rows.schema, state), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = sorted((r.response_id, r.score) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted((str(i), i / 2 - 0.5 * i / 20) for i in range(20))
