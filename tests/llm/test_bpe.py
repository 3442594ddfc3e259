"""BPE: against the tiktoken library, and the round trip."""

import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken

from verispan.llm import bpe

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(blob):
    return [int.from_bytes(blob[i : i + 4], "little") for i in range(0, len(blob), 4)]


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: r.text for r in docs.collect()}
    got = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS).collect()
    assert len(got) == len(want)
    for r in got:
        assert ids(r.ids) == library.encode_ordinary(want[r.doc_id])
        assert hashlib.sha256(r.decoded).digest() == hashlib.sha256(want[r.doc_id].encode()).digest()


def test_odd_rows(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 40)
    texts = [None, "", " ", "  \n\n  x", "I'll don't 12,345 <|endoftext|>", "naïve Straße 😀👩‍🚀 日本語 x\x1c\x85", "a" * 3000, "word " * 20000, "same", "same"]
    rows = [(None if i == 4 else i, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    got = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN, buckets=5), RANKS).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i == 4, 0 if i == 4 else i) for i in range(len(texts)))
    for r in got:
        text = texts[4 if r.doc_id is None else r.doc_id] or ""
        assert ids(r.ids) == library.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()
    assert bpe.decode(bpe.encode(docs.limit(0), RANKS, P.PATTERN), RANKS).collect() == []
