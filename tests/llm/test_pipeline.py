"""The pipeline: each stage on its own input, and all of them on planted documents."""

import base64
import hashlib
from collections import defaultdict

import corpus_pipeline as pipeline
import numpy as np
import public_tokenizers
import tiktoken
from test_decontaminate import plain
from test_shingles import plain_groups, plain_set
from verispan.llm import lines
from verispan.llm.toxicity import score, train

SF = "/root/testdata/sf0.001"


def plain_lines(rows):
    """doc_id -> text without boilerplate lines, by sets of sites."""
    cut = {r.doc_id: [x.strip(" ") for x in r.text.split("\n")] for r in rows}
    site = {r.doc_id: r.source for r in rows}

    def held_by(ids):
        sites = defaultdict(set)
        for k in ids:
            for x in cut[k]:
                if len(x) >= lines.LEAST_CHARS:
                    sites[x].add(site[k])
        return {x for x, own in sites.items() if len(own) >= lines.SITES}

    wide = held_by(cut)
    votes = [k for k, own in cut.items() if 20 * sum(len(x) for x in own if x in wide) < 19 * sum(map(len, own))]
    gone = wide & held_by(votes)
    return {r.doc_id: "\n".join(x for x in r.text.split("\n") if x.strip(" ") not in gone) for r in rows}


def encoding():
    raw = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    held = {}
    for name, stage in pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = held[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "byte_level_bpe":
            assert docs.columns == columns
        if name == "toxicity":
            scores = {r.doc_id: r.score for r in score(before, train(before, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
            assert {r.doc_id for r in docs.collect()} == {k for k, v in scores.items() if v < 0.5}
        if name == "line_dedup":
            want = plain_lines(before.collect())
            assert {r.doc_id: r.text for r in docs.collect()} == want and all(r.n_chars == len(r.text) for r in docs.collect())
        if name == "simhash_near_dedup":
            groups = plain_groups({r.doc_id: plain_set(r.text) for r in before.collect()})
            assert {r.doc_id for r in docs.collect()} == set(groups.values())
        if name == "benchmark_decontamination":
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            left = {r.doc_id for r in docs.collect()}
            for r in before.collect():
                if r.doc_id not in left:
                    assert max(plain(r.text, i)[0] for i in items) >= 0.8
                else:
                    assert not any(i in r.text for i in items)
        if name == "byte_level_bpe":
            whole = encoding()
            ids = {r.doc_id: np.array(whole.encode_ordinary(r.text), "<u4") for r in before.collect()}
            digest = lambda x: hashlib.sha256(x).hexdigest()
            want = {r.doc_id: (len(ids[r.doc_id]), digest(ids[r.doc_id].tobytes()), digest(r.text.encode())) for r in before.collect()}
            assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in docs.collect()} == want
    assert docs.count() == held["benchmark_decontamination"].count()
    run = pipeline.run(spark, SF)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, docs.collect()))


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "x y z", None, None, 5), (3, "word " * 9, "en", "b", 45), (3, "word " * 9, "en", "b", 45), (4, "Word  " * 9, None, "c", 54)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for data in (docs, docs.limit(0)):
        frame = data
        for name, stage in pipeline.STAGES:
            path = f"{tmp_path}/{name}{data.count()}"
            stage(spark, frame, SF).write.parquet(path)
            frame = spark.read.parquet(path)
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in frame.collect())
        assert [g[:2] for g in got] == ([(False, 1), (False, 3), (True, 0)] if data.count() else [])
