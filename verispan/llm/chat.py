"""Chat formatting in budgeted windows with loss masks."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import kernel, spread

#: Tokens of a window, of the history it may repeat, and of a turn's frame.
BUDGET = 1024
HISTORY = 256
FRAME = 4
TARGET = "assistant"
SYSTEM = "system"
_TOKEN = re.compile(r"\w+|[^\w\s]")
_CONTROL = re.compile(r"[\\#<]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<]|\\.)*) </turn>\n", re.DOTALL)
FORMATTED = "conv_id long, window long, repeated int, formatted string, loss array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    """text with a backslash before every backslash, # and <, so that no control string occurs in it."""
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted turns, and where each one's escaped text is."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"### {escape(role).replace(':', chr(92) + ':')}: ", escape(text)
        out.append(f"{head}{body} </turn>\n")
        spans.append((at + len(head), at + len(head) + len(body)))
        at += len(out[-1])
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"not a formatted turn at {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def plain_tokens(text: str) -> int:
    """Words and marks of a text."""
    return sum(1 for _ in _TOKEN.finditer(text))


class _Conversation:
    """Windows of one conversation, made as its turns arrive.

    It holds the first system turn, the last turns that may be repeated, and the turns of the open
    window, with prefix sums of their tokens; so its memory is that of a window, however many turns
    there are.
    """

    def __init__(self, conv_id: int | None, budget: int, history: int, count: Callable[[str], int]):
        self.conv_id, self.budget, self.limit, self.count = conv_id, budget, history, count
        self.system: tuple[str, str] | None = None
        self.cost = 0
        self.turns: list[tuple[str, str]] = []  # of the past, then from self.fresh on the window's own
        self.sums = [0]  # sums[k]: tokens of the first k turns held
        self.fresh = self.seen = self.window = 0
        self.room = budget  # what the turns from self.first on may take
        self.first = 0
        self.headed = False

    def add(self, role: str, text: str) -> Iterator[tuple]:
        size = FRAME + self.count(text)
        if len(self.turns) > self.fresh and self.sums[-1] + size - self.sums[self.first] > self.room:
            yield self.close()
        if not self.seen and role == SYSTEM:
            self.system, self.cost = (role, text), size
        elif len(self.turns) == self.fresh:
            self._open(size)
        self.seen += 1
        self.turns.append((role, text))
        self.sums.append(self.sums[-1] + size)

    def _open(self, size: int) -> None:
        """Choose what the window whose own first turn has ``size`` tokens repeats."""
        self.headed = self.system is not None and self.window > 0 and self.cost + size <= self.budget
        self.room = self.budget - (self.cost if self.headed else 0)
        past = min(self.limit, self.room - size)
        self.first = min(self.fresh, bisect_left(self.sums, self.sums[self.fresh] - past)) if past >= 0 else self.fresh

    def close(self) -> tuple:
        head = [self.system] if self.headed else []
        held = head + self.turns[self.first :]
        repeated = len(head) + self.fresh - self.first
        formatted, spans = render(held)
        loss = [{"start": a, "end": z} for (role, _), (a, z) in list(zip(held, spans, strict=True))[repeated:] if role == TARGET]
        row = (self.conv_id, self.window, repeated, formatted, loss)
        start = 1 if self.system is not None and not self.window else 0  # the system turn is no history
        keep = max(start, bisect_left(self.sums, self.sums[-1] - self.limit))
        self.turns, self.sums = self.turns[keep:], [x - self.sums[keep] for x in self.sums[keep:]]
        self.fresh, self.window, self.headed = len(self.turns), self.window + 1, False
        self.first, self.room = self.fresh, self.budget
        return row


def _windows(budget: int, history: int, raw: bytes | None, pattern: str | None):
    schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("repeated", pa.int32()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Conversation | None = None
        count = plain_tokens if raw is None else lambda text: len(encoder(raw, pattern).encode_ordinary(text))
        for batch in batches:
            rows: list[tuple] = []
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if held is None or held.conv_id != conv_id:
                    if held is not None:
                        rows.append(held.close())
                    held = _Conversation(conv_id, budget, history, count)
                rows += held.add(role or "", text or "")
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(held.close(), schema, strict=True)], schema=schema)

    return run


def format_conversations(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(conv_id, window, repeated, formatted, loss): windows of whole turns within ``budget`` tokens.

    turns needs conv_id, turn, role and text; other columns are ignored. A turn's tokens are FRAME and
    those of its text: of the byte-level BPE whose ranks and pattern are given, else words and marks.
    Prefix sums of turn tokens choose where windows begin and end; a turn over the budget gets a
    window of its own and stays whole, and no other window is over it. Every window but the first starts
    with the conversation's first turn if that is a system turn, which gives way only where it and the
    window's first own turn don't fit together. Then come the last turns before that fit both ``history``
    and the room that the first own turn leaves; these ``repeated`` turns are masked. ``loss`` has the
    code-point spans of the other assistant texts in ``formatted``, so each is trained on once. Control
    strings in texts are escaped and come back by ``parse``. Null roles and texts count as empty;
    rows with a null conv_id are one conversation; equal turns go by role and text; repeated rows
    stay; no rows give none. Rows stay sorted by window within a partition that holds the whole
    conversation. A task streams its conversations, whose turns need not fit memory.
    """
    raw = None
    if ranks_path is not None:
        with open(ranks_path, "rb") as file:
            raw = file.read()
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition(spread(turns), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(kernel(_windows(budget, history, raw, pattern)), FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in DIGEST.split(", ")]
    current, turns, loss, counts = None, None, None, [0, 0, 0]

    def row() -> tuple:
        return current[0], counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]

    for batch in batches:
        rows = []
        for conv_id, repeated, formatted, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "repeated", "formatted", "loss")), strict=True):
            if current is None or current[0] != conv_id:
                if current is not None:
                    rows.append(row())
                current, turns, loss, counts = (conv_id,), hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
            for role, text in parse(formatted)[repeated:]:
                turns.update(f"{role}\n{text}\n".encode())
                counts[0] += 1
            for span in spans:
                text = unescape(formatted[span["start"] : span["end"]])
                loss.update(text.encode())
                counts[1] += len(text)
            counts[2] += len(formatted)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
    if current is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c]) if c is not None else pa.array([None], pa.int64()) for c in row()], names)


def digests(windows: DataFrame) -> DataFrame:
    """Each conversation's turns and trained texts, read back from the windows of ``format_conversations``.

    It must get that operator's rows in their own order and partitions.
    """
    return windows.mapInArrow(kernel(_digests), DIGEST)


ORACLE_SQL = r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256
FROM turns GROUP BY conv_id
"""
