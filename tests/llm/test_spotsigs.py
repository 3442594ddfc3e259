"""SpotSigs: signatures, the order of documents, and pruned pairs against brute force."""

import hashlib
import re
from itertools import islice

import numpy as np

from verispan.llm import spotsigs
from verispan.llm.words import hash_of, hashed_words, mix


def plain(text):
    """The set of signatures as tuples of words."""
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    spots = set()
    for i, w in [(-1, None), *enumerate(words)] if words else []:
        if w is None or w in spotsigs.ANCHORS:
            spots.add((w, *islice((words[j] for j in range(i + 1, len(words)) if words[j] not in spotsigs.ANCHORS), spotsigs.CHAIN)))
    return spots


def spelled(spots):
    """The fingerprint that the signatures make."""
    out = []
    for anchor, *chain in spots:
        x = np.array([spotsigs._START if anchor is None else hash_of(anchor)], np.uint64)
        for w in chain:
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(hash_of(w)))
        out.append(f"{int(mix(x)[0]) >> 32:08x}")
    return "".join(sorted(set(out)))


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_hashes_do_not_depend_on_the_block():
    texts = [b"One two", b"", b"THREE\xc3\xa9", b"one", b"..", b"x" * 9000]
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.cumsum([0, *map(len, texts)])
    hashes, _, cut = hashed_words(data, at)
    assert cut.tolist() == [0, 2, 2, 3, 4, 4, 5]
    assert hashes[0] == hashes[3] == hash_of("ONE")
    assert hashes[2] == hash_of("threeé")


def check(docs, got):
    rows = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.edited_sha256))
    want = []
    for i, (doc_id, text) in enumerate(rows):
        t, u = text or "", rows[(i + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        want.append((doc_id, len(t), hashlib.sha256(edited.encode()).hexdigest(), likeness(plain(t), plain(edited)), likeness(plain(t), plain(u)), spelled(plain(t)), spelled(plain(edited))))
    want.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    assert [(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.fingerprint, r.edited_fingerprint) for r in got] == want


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    check([(r.doc_id, r.text) for r in docs.collect()], spotsigs.compared(docs).collect())


def test_odd_rows(spark, monkeypatch):
    rows = [(5, None), (1, ""), (None, "The cat sat"), (9, "naïve 😀 of it" * 9), (9, "naïve 😀 of it" * 9), (2, "word and other " * 30000), (7, "x")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, bucket int")
    check(rows, spotsigs.compared(docs).collect())
    monkeypatch.setattr(spotsigs, "RANGE_BYTES", 1000)
    assert spotsigs.in_order(docs).select("bucket").distinct().count() > 2
    check(rows, spotsigs.compared(docs).collect())
    check(rows[:1], spotsigs.compared(docs.limit(1)).collect()) if docs.limit(1).first().doc_id == 5 else None
    assert spotsigs.compared(docs.limit(0)).collect() == []


def test_pairs(spark):
    base = [f"the {w}a {w}b of {w}c {w}d" for w in "qwertyuiopsdfghjklzxcvbnm"]
    texts = [" . ".join(base[k:] + base[: k // 3]) for k in range(0, 12)] + [" . ".join(base[:20] + [f"the new{k} word{k}"]) for k in range(5)] + ["", None, "of"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = {r.doc_id: r.fingerprint for r in spotsigs.fingerprints(docs).collect()}
    split = lambda s: {s[i : i + 8] for i in range(0, len(s), 8)}
    sets = sorted({p for p in prints.values() if p})
    want = {(a, b) for a in sets for b in sets if a < b and likeness(split(a), split(b)) >= 0.8}
    assert {(r.a, r.b) for r in spotsigs.near_duplicates(docs).collect()} == want and want
