"""Language ID, toxicity and quality: held-out accuracy, odd rows, and parts against brute force."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verispan.llm import langid, quality, queries, toxicity
from verispan.llm.common import text_buffers
from verispan.llm.convnet import ConvNet
from verispan.llm.sampling import fold
from verispan.llm.words import hashed_words

DATA = "/root/testdata/sf0.1"
SMALL = "/root/testdata/sf0.01"
ODD = [(1, None, "en"), (2, "", "en"), (3, " \n", None), (4, "12 34 !!", "fr"), (5, "é", "fr"), (6, "the house of the " * 40000, "en"), (None, "der Hund und die Katze", "de"), (7, "x", "en"), (7, "x", "en")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0.5, 1) for r in ODD], "doc_id long, text string, lang string, score double, predicted int")


def test_language(spark, odd):
    got = queries.op2_langid(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(x).encode()) % 3 == 1 for x in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.98
    assert got["score"].between(0, 1).all()


def test_language_odd_rows(spark, odd):
    model = langid.train(spark.read.parquet(f"{DATA}/documents.parquet"), per_language=60)
    got = langid.identify(odd, model).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (1, 2, 3, 4)] == ["und"] * 4
    assert by[5].lang_pred in model.languages and by[6].lang_pred == "en" and by[None].lang_pred in model.languages
    empty = langid.train(odd.limit(0))
    assert {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}


def held_out_scores(spark, query, label):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", label)
    got = query(spark, DATA).join(labels, "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(x).encode()) % 5 == 0 for x in got["doc_id"]]).all()
    assert got["score"].between(0, 1).all()
    return got[got["held_out"]]


def test_toxicity(spark, odd):
    held = held_out_scores(spark, queries.op7_toxicity, "toxic")
    assert (held["predicted"] == held["toxic"]).mean() > 0.96
    hits = ((held["predicted"] == 1) & (held["toxic"] == 1)).sum()
    assert hits / held["toxic"].sum() > 0.8 and hits / held["predicted"].sum() > 0.8
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    got = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert all(v < 0.5 for v in got.values()), got


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(k, ("the fool of all " if k % 2 else "the friend of all ") * 3 + f"w{k}") for k in range(400)], "doc_id long, text string")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert len(got) == len(ODD) - 1 and all(v < 0.5 for k, v in got.items() if k != 6), got
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert got[11] > 0.5 and got[12] < 0.5
    nothing = toxicity.train(docs, labels.limit(0))
    assert all(r.score < 0.5 for r in toxicity.score(odd, nothing).collect())


def test_toxicity_language():
    said = {"en": "the cat and the dog sat", "de": "der Hund und die Katze", "fr": "le chat dans les arbres"}
    texts = [said[k] for k in said for _ in range(30)]
    langs = [k for k in said for _ in range(30)]
    hashes, _, cut = hashed_words(*text_buffers(pa.array(texts)))
    table = np.zeros(1 << toxicity.HASHES, np.int32)
    known = np.unique(toxicity._buckets(hashes))
    table[known] = np.arange(1, len(known) + 1)
    own = [toxicity._buckets(hashes[a:z]) for a, z in zip(cut[:-1], cut[1:], strict=True)]
    languages, voices, loudness = toxicity.learn_voices(own, langs, table)
    model = toxicity.ToxicModel(table, None, languages, voices, loudness, np.zeros(4))
    hashes, _, cut = hashed_words(*text_buffers(pa.array(["the dog", "die Katze", "xyz", None, "dans les bois"])))
    got = toxicity.languages_of(model, table[toxicity._buckets(hashes)], cut)
    assert languages == ["de", "en", "fr"] and got.tolist() == [1, 0, 3, 3, 2]


@pytest.mark.parametrize(("label", "train", "score"), [("toxic", toxicity.train, toxicity.score), ("quality", quality.train, quality.score)])
def test_held_out_labels_change_nothing(spark, label, train, score):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    flipped = labels.withColumn(label, F.when(fold("doc_id", 5) == 0, 1 - F.col(label)).otherwise(F.col(label)))
    assert labels.exceptAll(flipped).count() > 5
    first, second = ({r.doc_id: r.score for r in score(docs, train(docs, x)).select("doc_id", "score").collect()} for x in (labels, flipped))
    assert first == second


def test_held_out_languages_change_nothing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    other = docs.withColumn("lang", F.when(fold("doc_id", 3) == 1, F.lit("xx")).otherwise(F.col("lang")))
    first, second = ({r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, langid.train(x)).collect()} for x in (docs, other))
    assert first == second


def test_quality(spark, odd):
    held = held_out_scores(spark, queries.op4_quality, "quality")
    assert ((held["score"] >= 0.3) == (held["predicted"] == 1)).all()
    assert (held["predicted"] == held["quality"]).mean() > 0.97


def test_quality_odd_rows(spark, odd):
    model = quality.fit(np.zeros((0, len(quality.STATISTICS))), np.zeros(0), np.zeros(0))
    assert len(quality.score(odd, model).collect()) == len(ODD)
    assert quality.score(odd.limit(0), model).collect() == []


def test_rules_match_their_columns(spark):
    rng = np.random.default_rng(0)
    x = rng.random((500, len(quality.STATISTICS)))
    y = ((x[:, 3] > 0.5) & (x[:, 5] <= 0.6)).astype(float)
    model = quality.fit(x, y, np.ones(500))
    assert 0 < len(model.rules) < 100
    z = model.intercept + sum(w * rule.mask(x) for w, rule in model.rules)
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], quality.STATISTICS)
    got = np.array([r[0] for r in frame.select(model.score()).collect()])
    assert np.allclose(got, 1 / (1 + np.exp(-z)), atol=1e-9)
    assert ((got > 0.5) == (y == 1)).mean() > 0.98


def test_statistics_by_hand():
    import pyarrow as pa

    from verispan.llm.common import text_buffers

    rows = quality.statistics(*text_buffers(pa.array(["THE cat. THE cat.\nx|y\nx|y", None, "a1!"])))
    by = [dict(zip(quality.STATISTICS, r, strict=True)) for r in rows]
    assert by[0]["n_words"] == 8 and by[0]["n_lines"] == 3 and by[0]["repeated_lines"] == pytest.approx(1 / 3)
    assert by[0]["shouted"] == 2 / 8 and by[0]["function_words"] == 4 / 8 and by[0]["pipes"] == 2 / 25
    assert by[1]["n_bytes"] == 0 and by[2]["digits"] == pytest.approx(1 / 3)


def test_convnet_pools_every_position():
    net = ConvNet.fresh(50, 4, (1, 2, 3), 5, 2, 1)
    rng = np.random.default_rng(2)
    seqs = [rng.integers(1, 50, n).astype(np.int32) for n in (0, 1, 2, 7, 40000, 3)]
    gap = np.zeros(net.margin, np.int32)
    symbols = np.concatenate([x for s in seqs for x in (s, gap)])
    lengths = np.array([len(s) for s in seqs])
    starts = np.cumsum(lengths + net.margin) - lengths - net.margin
    got = net.pooled(symbols, starts, lengths)
    for k, s in enumerate(seqs):
        if len(s):
            want = np.maximum(net.responses(np.concatenate([s, gap])).max(axis=0) + net.bias, 0)
            assert np.allclose(got[k], want, atol=1e-5)
        else:
            assert np.allclose(got[k], np.maximum(net.bias, 0))
