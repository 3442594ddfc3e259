"""Substring dedup: against brute force, with planted repeats."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from verispan.llm import queries, suffix


def plain(texts, span=400):
    """(n_bytes, n_removed, n_spans, kept, n_repeated) of each text, by a table of all strings."""
    least = [x[1] for x in plain(texts, suffix.LEAST)] if span == suffix.SPAN else [None] * len(texts)
    raw = [(t or "").encode() for t in texts]
    strings = Counter(hash(b[i : i + span]) for b in raw for i in range(len(b) - span + 1))
    out = []
    for b, more in zip(raw, least, strict=True):
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - span + 1):
            if strings[hash(b[i : i + span])] > 1:
                gone[i] += 1
                gone[i + span] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~mask].tobytes()
        out.append((len(b), int(mask.sum()), int((mask & ~np.append(False, mask[:-1])).sum()) if len(b) else 0, kept, more))
    return out


def test_documents(spark):
    where = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{where}/documents.parquet").collect()
    want = {r.doc_id: p for r, p in zip(rows, plain([r.text for r in rows]), strict=True)}
    got = queries.op9_suffix(spark, where).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_repeated) for r in got} == {k: (*v[:3], hashlib.sha256(v[3]).hexdigest(), v[4]) for k, v in want.items()}
    assert sum(v[1] for v in want.values()) > 0


@pytest.mark.parametrize("crowd", [2048, 3])
def test_planted(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix, "CROWD", crowd)
    monkeypatch.setattr(suffix, "SHARD_BYTES", 5000)
    monkeypatch.setattr(suffix, "MERGED", 500)
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    passage = [text(n) for n in (500, 395, 1500, 700, 270, 250)]
    texts = [None, "", "x", "z" * 399, "z" * 400, "y" * 1200, "ab" * 700, text(900)]
    for p in passage:
        for k in range(12):
            texts.append(text(rng.randrange(300)) + p + text(rng.randrange(300)))
        texts.append(text(100) + p[: len(p) // 2] + "!" + p[len(p) // 2 :])
    copy = text(2500)
    texts += [copy] * 4 + [copy[:1000] + "#" + copy[1001:], copy[:450], copy[-400:], copy[-401:-1] + "~"]
    texts.append(passage[2] + text(50) + passage[2])
    texts += [copy[300:700] + text(20)] * 3
    rows = [(k if k != 9 else None, t) for k, t in enumerate(texts)] + [(len(texts) - 1, texts[-1])] * 3 + [(None, texts[-5])] * 4
    docs = spark.createDataFrame([(*r, 2) for r in rows], "doc_id long, text string, first int").repartition(3)
    got = suffix.remove_repeats(docs).collect()
    want = sorted((-1 if k is None else k, *p) for (k, _), p in zip(rows, plain([t for _, t in rows]), strict=True))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept), r.n_repeated) for r in got) == want
    assert sum(w[2] > 0 for w in want) > 50
    assert suffix.remove_repeats(docs.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array_and_prefixes(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(97, 97 + (2, 3, 26, 2)[seed], 3000).astype(np.uint8)
    text[1000:1600] = text[200:800]
    order = suffix.suffix_array(text, 4096)
    raw = text.tobytes()
    assert order.tolist() == sorted(range(len(raw)), key=lambda p: raw[p:])
    prefixes = suffix.common_prefixes(text, order)
    for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
        n = 0
        while max(a, b) + n < len(raw) and raw[a + n] == raw[b + n]:
            n += 1
        assert prefixes[b] == n


@pytest.mark.parametrize("seed", range(4))
def test_suffixes_at_some_places(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(97, 100, 700).astype(np.uint8)
    text = np.concatenate([np.append(np.where(rng.random(700) < (0, 0.002, 0.01, 0.1)[seed], 98, base), 255) for _ in range(6)]).astype(np.uint8)
    only = np.flatnonzero(rng.random(len(text)) < 0.2)
    raw = text.tobytes()
    order = suffix.suffix_array(text, suffix.SPAN, only)
    cut = [raw[p : p + suffix.SPAN] for p in order.tolist()]
    assert cut == sorted(raw[p : p + suffix.SPAN] for p in only.tolist())
    prefixes = suffix.common_prefixes(text, order, 1000)
    for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
        n = 0
        while n < suffix.SPAN and max(a, b) + n < len(raw) and raw[a + n] == raw[b + n]:
            n += 1
        assert min(prefixes[b], suffix.SPAN) == n


def test_long_texts_are_anchored_in_segments(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 9000).astype(np.uint8)
    whole = suffix.regions(data, np.array([0, 9000]))
    monkeypatch.setattr(suffix, "SEGMENT", 1000)
    parts = suffix.regions(data, np.array([0, 9000]))
    spread = lambda r: [(int(h), int(f) + k) for h, f, n in zip(r[0], r[2], r[3], strict=True) for k in range(n)]
    assert spread(whole) == spread(parts) and len(spread(whole)) == 9001 - suffix.LEAST
