"""Near-duplicates by shingle sets, the pipeline's stage: against brute-force Jaccard."""

import random

import corpus_pipeline as pipeline
import pytest

from verispan.llm import shingles

SF = "/root/testdata/sf0.001"


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_groups(sets):
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {k: find(k) for k in sets}


def test_stage_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    groups = plain_groups({r.doc_id: plain_set(r.text) for r in docs.collect()})
    assert groups[177] == 1 and groups[145] == 6  # edited copies that fingerprints of 64 bits tell apart by 7 and 11
    got = [r.doc_id for r in pipeline.dedup_documents(spark, docs, SF).collect()]
    assert sorted(got) == sorted(set(groups.values()))


@pytest.mark.parametrize("piece", [8, shingles.PIECE])
def test_planted(spark, monkeypatch, piece):
    monkeypatch.setattr(shingles, "PIECE", piece)
    rng = random.Random(4)
    passage = [f"p{k}" for k in range(30)]
    texts = [None, "", " \n", "One two", "one\ttwo", "one two three", "a b c d e " * 9]
    for size in (12, 60, 60, 300):
        base = [f"v{rng.randrange(5000)}" for _ in range(size)]
        for _ in range(25):
            edited = list(base)
            for _ in range(rng.randrange(1 + size // 30 + 1)):
                edited[rng.randrange(size)] = f"edit{rng.random()}"
            texts.append(" ".join(edited))
    texts += [" ".join(passage + [f"own{rng.random()}" for _ in range(40)]) for _ in range(30)]
    rows = list(enumerate(texts, 10))
    frame = spark.createDataFrame([(*r, "x") for r in rows] + [(10, None, "x")], "doc_id long, text string, node string")
    want = plain_groups({k: plain_set(t) for k, t in rows})
    got = shingles.deduplicate(frame).collect()
    assert sorted(r.doc_id for r in got) == sorted(set(want.values()))
    assert 30 < len(got) < len(texts)
    assert shingles.deduplicate(frame.limit(0)).collect() == []
