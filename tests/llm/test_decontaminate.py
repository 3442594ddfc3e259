"""Decontamination: against brute force, with planted copies."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from verispan.llm import decontaminate, queries

WORDS = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def grams(words):
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def words_of(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, item):
    """(similarity, start) of the best window of the item's size."""
    doc, want = grams(words_of(text)), Counter(grams(words_of(item)))
    size = sum(want.values())
    length = min(size, len(doc))
    best = (0.0, 0)
    for start in range(len(doc) - length + 1) if length > 0 else []:
        own = Counter(doc[start : start + length])
        shared = sum((own & want).values())
        best = max(best, (shared / (length + size - shared), -start))
    return best[0], -best[1]


def check(docs, items, got):
    want = {}
    for doc_id, text in docs:
        for item_id, item in items:
            alike, start = plain(text, item)
            if alike >= 0.8:
                want[doc_id, item_id] = (round(alike, 12), start)
    assert {(r.doc_id, r.item_id): (round(r.similarity, 12), r.start) for r in got} == want
    return want


def test_documents(spark):
    where = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{where}/documents.parquet")
    items = spark.read.parquet(f"{where}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in queries.op6_decontaminate(spark, where).collect()}
    for d in docs.collect():
        for i in items.collect():
            if i.text in d.text:
                assert (d.doc_id, i.item_id) in found
    held = {d for d, _ in found}
    some = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in held or r.doc_id % 10 == 0]
    assert {(k) for k in check(some, [(r.item_id, r.text) for r in items.collect()], [r for r in queries.op6_decontaminate(spark, where).collect()])} == found


def test_planted(spark):
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(60)] + ["the", "of", "and"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate([5, 6, 12, 30, 30, 60, 80, 4, 0])] + [(20, None), (21, "a b c d e " * 8), (22, text(3))]
    docs = []
    for k, (_, item) in enumerate(items):
        own = (item or "x").split()
        docs.append((len(docs), text(40) + " " + " ".join(own) + " " + text(30)))
        docs.append((len(docs), " ".join(own).upper().replace(" ", ", ") + "."))
        if len(own) > 20:
            for at in (len(own) // 2, len(own) - 2):
                docs.append((len(docs), text(9) + " " + " ".join(own[:at] + ["changed"] + own[at + 1 :]) + " " + text(5)))
                docs.append((len(docs), text(9) + " " + " ".join(own[:at] + own[at + 1 :]) + " " + text(5)))
            docs.append((len(docs), " ".join(own[:-3])))
            docs.append((len(docs), " ".join(own * 3)))
    docs += [(900, None), (901, ""), (902, "one two"), (903, "a b c d e " * 20000)]
    frame = spark.createDataFrame([(*d, 3) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    got = decontaminate.contaminated(frame, bench).collect()
    want = check([d for d in docs if d[0] != 903], items, [r for r in got if r.doc_id != 903])
    assert len(want) > 20
    assert [(r.item_id, r.start) for r in got if r.doc_id == 903] == [(21, 0)]
    left = {r.doc_id for r in decontaminate.decontaminate(frame, bench).collect()}
    assert left == {d[0] for d in docs} - {d for d, _ in want} - {903}
    assert decontaminate.contaminated(frame.limit(0), bench).collect() == []
    assert decontaminate.contaminated(frame, bench.limit(0)).collect() == []


def test_large_benchmarks_are_joined(spark, monkeypatch):
    where = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(None, None), (None, "")], "doc_id long, text string"))
    items = spark.read.parquet(f"{where}/benchmark.parquet")
    first = items.where("item_id = 33").select("item_id", "text")
    items = items.select("item_id", "text").unionByName(first).unionByName(first.withColumn("item_id", F.lit(None).cast("long")))
    docs = docs.unionByName(docs.join(first.select("text"), F.contains(docs["text"], first["text"]), "left_semi").withColumn("doc_id", F.lit(None).cast("long")))
    key = lambda r: tuple(str(x) for x in r)
    sent = sorted(decontaminate.contaminated(docs, items).collect(), key=key)
    left = sorted(decontaminate.decontaminate(docs, items).collect(), key=key)
    monkeypatch.setattr(decontaminate, "SENT_BYTES", -1)
    assert len(sent) > 5 and sorted(decontaminate.contaminated(docs, items).collect(), key=key) == sent
    assert sorted(decontaminate.decontaminate(docs, items).collect(), key=key) == left
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == docs.count()


@pytest.mark.parametrize("sent", [decontaminate.SENT_BYTES, -1])
def test_rows_are_judged_one_by_one(spark, monkeypatch, sent):
    monkeypatch.setattr(decontaminate, "SENT_BYTES", sent)
    item = " ".join(f"w{k}" for k in range(20))
    rows = [(None, f"a {item} b"), (7, f"c {item}"), (None, "clean one"), (None, "clean two"), (7, "clean three"), (None, None), (7, f"c {item}"), (None, "clean one")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, _benchmark_hit string")
    items = spark.createDataFrame([(1, item), (None, item), (2, None)], "item_id long, text string")
    got = decontaminate.decontaminate(docs, items)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted((str(d), str(t)) for d, t in rows if item not in (t or ""))


@pytest.mark.parametrize("seed", range(5))
def test_overlaps(seed):
    rng = np.random.default_rng(seed)
    part, item = rng.integers(0, 6, 40).astype(np.uint64), rng.integers(0, 8, 12).astype(np.uint64)
    want = [sum((Counter(part[s : s + 12].tolist()) & Counter(item.tolist())).values()) for s in range(29)]
    assert decontaminate.overlaps(part, item, 12).tolist() == want


def test_a_block_is_near_within_the_radius():
    rng = np.random.default_rng(3)
    a = rng.random((2000, decontaminate.BITS)) < 0.5
    b = a.copy()
    for row in b:
        row[rng.choice(decontaminate.BITS, decontaminate.RADIUS, replace=False)] ^= True
    far = np.bitwise_count(decontaminate._packed(a) ^ decontaminate._packed(b))
    assert (far.sum(axis=1) == decontaminate.RADIUS).all() and (far.min(axis=1) <= decontaminate.BLOCK_RADIUS).all()
    other = np.bitwise_count(decontaminate._packed(a) ^ decontaminate._packed(a[::-1]))
    assert (other.min(axis=1) <= decontaminate.BLOCK_RADIUS).mean() < 0.1  # what the blocks leave of unrelated pairs


@pytest.mark.parametrize(("size", "replaced"), [(9, 1), (20, 2), (45, 5), (90, 10), (300, 33)])
def test_no_match_is_lost_to_the_radius(size, replaced):
    rng = np.random.default_rng(size)
    item = rng.integers(0, 1 << 63, size, dtype=np.uint64)
    windows = np.stack([np.where(np.isin(np.arange(size), rng.choice(size, replaced, replace=False)), rng.integers(0, 1 << 63, size, dtype=np.uint64), item) for _ in range(2000)])
    assert (size - replaced) / (size + replaced) >= 0.8
    theirs = decontaminate._packed(decontaminate.window_bits(item, size))
    far = np.array([np.bitwise_count(decontaminate._packed(decontaminate.window_bits(w, size)) ^ theirs).sum() for w in windows])
    assert (far <= decontaminate.RADIUS).all()


def test_repeated_shingles_are_not_lost(spark):
    rng = random.Random(5)
    common = [f"w{k}" for k in range(94)]
    item = " ".join(common + ["x"] * 14)
    text = " ".join([f"a{rng.random()}" for _ in range(9)] + common + ["y"] * 14)
    docs = [(1, text), (2, " ".join(common))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontaminate.contaminated(frame, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert len(check(docs, [(1, item)], got)) == 1


@pytest.mark.parametrize("length", [1, 3, 12])
def test_repeating(length):
    x = np.random.default_rng(length).integers(0, 60, 50).astype(np.uint64)
    assert decontaminate.repeating(x, length).tolist() == [len(set(x[s : s + length].tolist())) < length for s in range(51 - length)]
