"""SimHash: against brute force on sf0.001 and on planted groups."""

import random

import numpy as np
import pytest
import xxhash

from verispan.llm import simhash

DATA = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    prints = {k: v for k, v in prints.items()}
    root = {k: k for k in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {k: find(k) for k in prints}


def test_matches_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    groups = plain_components(want)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {k: (f"{v:016x}", groups[k]) for k, v in want.items()}


def test_odd_rows(spark):
    rows = [(3, None, "x"), (1, "", "x"), (2, " \n\t", "x"), (7, "One two", "x"), (7, "One two", "x"), (8, "one\x0btwo", "x"), (9, "a b c d " * 40000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("key", docs_col())
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert [g[2] for g in got] == [1, 1, 1, 7, 7, 7, 9]
    assert got[0][1] == "0" * 16
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def docs_col():
    from pyspark.sql import functions as F

    return F.lit("clash")


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_pairs(radius):
    rng = random.Random(5)
    keys, fps = [], []
    for key, size in enumerate([1, 2, 3, 70, 200, 1, 65]):
        base = rng.getrandbits(64)
        for _ in range(size):
            x = base
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            keys.append(key)
            fps.append(x)
    i, j, d = simhash.near_pairs(np.array(keys), np.array(fps, np.uint64), radius)
    want = {(a, b, (fps[a] ^ fps[b]).bit_count()) for a in range(len(fps)) for b in range(a + 1, len(fps)) if keys[a] == keys[b] and (fps[a] ^ fps[b]).bit_count() <= radius}
    assert set(zip(i.tolist(), j.tolist(), d.tolist(), strict=True)) == want


def test_bit_sliced_pairs_of_wide_fingerprints(monkeypatch):
    monkeypatch.setattr(simhash, "STRIP", 50)
    rng = np.random.default_rng(1)
    keys = np.repeat([3, 5, 9], [150, 1, 90])
    base = rng.integers(0, 1 << 63, (241, 2), dtype=np.uint64)
    base[rng.random(241) < 0.7] = base[0]
    fps = base ^ (rng.integers(0, 1 << 63, (241, 2), dtype=np.uint64) & rng.integers(0, 1 << 63, (241, 2), dtype=np.uint64) & rng.integers(0, 1 << 63, (241, 2), dtype=np.uint64))
    i, j, d = simhash.near_pairs(keys, fps, 30)
    far = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2).astype(int)
    want = {(a, b, far[a, b]) for a in range(241) for b in range(a + 1, 241) if keys[a] == keys[b] and far[a, b] <= 30}
    assert 100 < len(want) < 10000 and set(zip(i.tolist(), j.tolist(), d.tolist(), strict=True)) == want
    chosen = simhash.nearest_forest(241, i, j, d)
    whole, part = simhash.forest(241, i, j), simhash.forest(241, i[chosen], j[chosen])
    assert (whole == part).all() and len(chosen) == 241 - len(set(whole.tolist()))
    weights, root = 0, list(range(241))
    for x in np.argsort(d, kind="stable").tolist():
        a, b = root[i[x]], root[j[x]]
        if a != b:
            weights += d[x]
            root = [a if r == b else r for r in root]
    assert weights == d[chosen].sum()


def test_hot_bucket_is_split(spark, monkeypatch):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 300:
        x = rng.choice(sorted(fps))
        fps.add(x ^ 1 << rng.randrange(64) ^ (1 << rng.randrange(64)) * rng.randrange(2))
    monkeypatch.setattr(simhash, "BUCKET", 20)
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    from verispan.llm.components import connected_components

    got = connected_components(simhash.links(frame)).collect()
    want = plain_components(dict(enumerate(sorted(fps))))
    sizes = lambda groups: sorted(n for n in __import__("collections").Counter(groups).values() if n > 1)
    assert sizes([r.root for r in got]) == sizes(want.values())
