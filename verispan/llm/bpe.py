"""Byte-level BPE: each distinct word is encoded once, after one global shuffle of words.

1. Pre-tokens. Documents are packed into chunks of about CHUNK_BYTES of text. A chunk's
   texts are split by the pattern, each on its own; its distinct words are numbered by
   frequency, and each pre-token, exploded with its position, becomes such a number. Words
   leave in one blob for each of ``buckets`` hash buckets, positions in one packed row.
2. Words. The rows are shuffled by bucket. A task meets all chunks' words of its bucket,
   encodes each distinct word once and answers every blob with the ids.
3. Positions. The rows are shuffled by chunk; ids are joined back to the numbers and put
   in order. Packing keeps a frequent word to one entry a chunk, so no key is hot.

Decoding joins ids with the token-byte table, whose size is the vocabulary's.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, kernel, pack, spread, text_buffers, unpack

CHUNK_BYTES = 16 << 20
#: Tokens that a kernel puts in order at once.
STEP = 1 << 18
ROWS = "chunk long, bucket int, home int, payload binary"
POSITIONS = -1


@functools.lru_cache(2)
def _ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


@functools.lru_cache(2)
def encoder(raw: bytes, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=_ranks(raw), special_tokens={})


def _planes(numbers: np.ndarray) -> list[np.ndarray]:
    """The four byte planes of the numbers; the upper ones pack to almost nothing."""
    return [(numbers >> np.uint32(8 * k)).astype(np.uint8) for k in range(4)]


def _joined(planes: list[bytes]) -> np.ndarray:
    return sum(np.frombuffer(p, np.uint8).astype(np.uint32) << np.uint32(8 * k) for k, p in enumerate(planes))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    chunk, bucket, home, payload = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(bucket, pa.int32()), pa.array(home, pa.int32()), binary_column(list(payload))], ["chunk", "bucket", "home", "payload"])


def _pretokens(pattern: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split = regex.compile(pattern).findall
        task = TaskContext.get().partitionId()
        serial, size = 0, 0
        ids: list[int | None] = []
        counts: list[int] = []
        numbers: list[np.ndarray] = []
        words: dict[str, int] = {}

        def close() -> Iterator[pa.RecordBatch]:
            chunk = (task << 32) + serial
            seq = np.concatenate(numbers) if numbers else np.zeros(0, np.uint32)
            numbers.clear()
            order = np.argsort(-np.bincount(seq, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            spelled = list(words)
            words.clear()  # the words' own memory is most of a chunk's
            spelled = [spelled[k].encode() for k in order.tolist()]
            place = np.fromiter((zlib.crc32(w) % buckets for w in spelled), np.uint16, len(spelled))
            known = np.array([x is not None for x in ids], np.uint8)
            head = pack(np.array([x or 0 for x in ids], "<i8"), known, np.array(counts, "<i8"), place, *_planes(rank[seq]))
            yield _rows([(chunk, POSITIONS, zlib.crc32(str(chunk).encode()) % buckets, head)])
            del head, seq, rank
            by = np.argsort(place, kind="stable")
            at = np.searchsorted(place[by], np.arange(buckets + 1))
            out = []
            for b in range(buckets):
                if own := [spelled[k] for k in by[at[b] : at[b + 1]].tolist()]:
                    out.append((chunk, b, b, pack(np.fromiter(map(len, own), "<u4", len(own)), b"".join(own))))
            if out:
                yield _rows(out)

        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for i, doc_id in enumerate(doc_ids):
                text = texts[i].as_py() or ""
                found = split(text)
                ids.append(doc_id)
                counts.append(len(found))
                numbers.append(np.fromiter((words.setdefault(w, len(words)) for w in found), np.uint32, len(found)))
                size += len(text) + 8 * len(found)
                if size >= 3 * CHUNK_BYTES:
                    yield from close()
                    serial, size = serial + 1, 0
                    ids, counts, numbers, words = [], [], [], {}
        if ids:
            yield from close()

    return run


def _encode_words(raw: bytes, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(raw, pattern)._encode_single_piece
        bucket, known = None, {}
        for batch in batches:
            cols = [batch.column(c) for c in ("chunk", "bucket", "home", "payload")]
            for i in range(batch.num_rows):
                chunk, b, home, payload = (c[i].as_py() for c in cols)
                if b == POSITIONS:
                    yield _rows([(chunk, b, home, payload)])
                    continue
                if b != bucket:
                    bucket, known = b, {}
                lengths, spelled = unpack(payload)
                at = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, "<u4"), dtype=np.int64)]).tolist()
                answers = []
                for a, z in zip(at[:-1], at[1:], strict=True):
                    word = spelled[a:z]
                    got = known.get(word)
                    if got is None:
                        got = known[word] = np.array(encode(word), "<u4")
                    answers.append(got)
                ids = np.concatenate(answers)
                yield _rows([(chunk, b, home, pack(np.fromiter(map(len, answers), "<u4", len(answers)), *_planes(ids)))])

    return run


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk, head, answers = None, None, []
    for batch in batches:
        cols = [batch.column(c) for c in ("chunk", "bucket", "payload")]
        for i in range(batch.num_rows):
            c, b, payload = (col[i].as_py() for col in cols)
            if b == POSITIONS:
                if chunk is not None:
                    yield from _in_order(head, answers)
                chunk, head, answers = c, payload, []
            else:
                assert c == chunk, "a chunk's positions come first"
                answers.append(payload)
    if chunk is not None:
        yield from _in_order(head, answers)


def _in_order(head: bytes, answers: list[bytes]) -> Iterator[pa.RecordBatch]:
    ids, known, counts, place, *planes = unpack(head)
    ids, known, counts = np.frombuffer(ids, "<i8"), np.frombuffer(known, np.uint8), np.frombuffer(counts, "<i8")
    place, seq = np.frombuffer(place, np.uint16), _joined(planes)
    lengths, flat = [np.zeros(0, "<u4")], [np.zeros(0, np.uint32)]
    for blob in answers:  # in the order of their buckets
        n, *own = unpack(blob)
        lengths.append(np.frombuffer(n, "<u4"))
        flat.append(_joined(own))
    by = np.argsort(place, kind="stable")
    size, start = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    answered = np.concatenate(lengths).astype(np.int64)
    assert len(answered) == len(place), "every distinct word is answered once"
    size[by], start[by] = answered, np.cumsum(answered) - answered
    flat = np.concatenate(flat).astype("<u4")
    at = np.concatenate([[0], np.cumsum(counts)])
    first = 0
    while first < len(counts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + STEP, "right")) - 1)
        own = seq[at[first] : at[last]]
        gathered, ends = _gather(flat, start[own], size[own])
        cut = np.concatenate([[0], ends])[at[first : last + 1] - at[first]]
        blob = gathered.tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[first:last], pa.int64(), mask=known[first:last] == 0), binary_column([blob[4 * a : 4 * z] for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)])], ["doc_id", "ids"]
        )
        first = last


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces flat[start:start + size], one after the other, and where each ends."""
    ends = np.cumsum(size)
    if not len(size) or not ends[-1]:
        return flat[:0], ends
    return flat[np.repeat(start - (ends - size), size) + np.arange(ends[-1])], ends


def encode(docs: DataFrame, ranks_path: str, pattern: str, buckets: int = 64) -> DataFrame:
    """(doc_id, ids): the ids of each row's whole text as little-endian unsigned 32-bit integers.

    docs needs doc_id and text; other columns are ignored. A null text counts as empty and an
    empty one has no ids; null doc_ids and repeated rows stay, each with its own result; no
    rows give none. ``buckets`` bounds a task's distinct words: to its share of all of them.
    """
    with open(ranks_path, "rb") as file:
        raw = file.read()
    buckets = min(1 << 16, max(buckets, spread(docs)))
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(kernel(_pretokens(pattern, buckets)), ROWS)
    answered = rows.repartition(buckets, "home").sortWithinPartitions("bucket").mapInArrow(kernel(_encode_words(raw, pattern)), ROWS)
    return answered.repartition(spread(docs), "chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(kernel(_assemble), "doc_id long, ids binary")


def _decode(raw: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sorted((rank, token) for token, rank in _ranks(raw).items())
        length = np.zeros(table[-1][0] + 1, np.int64)
        length[[r for r, _ in table]] = [len(t) for _, t in table]
        start = np.cumsum(length) - length
        flat = np.frombuffer(b"".join(t for _, t in table), np.uint8)
        for batch in batches:
            data, at = text_buffers(batch.column("ids"))
            ids = np.frombuffer(data.tobytes(), "<u4")
            at = at // 4
            out, first = [], 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(at, at[first] + STEP, "right")) - 1)
                own = ids[at[first] : at[last]]
                gathered, ends = _gather(flat, start[own], length[own])
                cut = np.concatenate([[0], ends])[at[first : last + 1] - at[first]].tolist()
                blob = gathered.tobytes()
                out += [blob[a:z] for a, z in zip(cut[:-1], cut[1:], strict=True)]
                first = last
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), binary_column(out)], ["doc_id", "ids", "decoded"])

    return run


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes of each row's ids, by a join with the token-byte table.

    The table is sent to every task; its size is the vocabulary's, whatever the documents are.
    """
    with open(ranks_path, "rb") as file:
        raw = file.read()
    return encoded.select("doc_id", "ids").mapInArrow(kernel(_decode(raw)), "doc_id long, ids binary, decoded binary")
