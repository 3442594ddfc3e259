"""Text functions as Catalyst expressions. Offsets count code points, from 0, half-open."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def find(text: Column | str, part: Column | str, start: int | Column = 1) -> Column:
    """1-based place of part in text from ``start`` on; 0 if absent."""
    return F.call_function("locate", _col(part), _col(text), F.lit(start) if isinstance(start, int) else start)


def locate_unique(text: Column | str, part: Column | str) -> Column:
    """struct(start, end, status): where part occurs; status is ok, missing or ambiguous.

    A second occurrence counts even if it overlaps the first.
    """
    first = find(text, part)
    again = find(text, part, first + 1)
    status = F.when(first == 0, "missing").when(again > 0, "ambiguous").otherwise("ok")
    ok = status == "ok"
    return F.struct(F.when(ok, first - 1).alias("start"), F.when(ok, first - 1 + F.length(_col(part))).alias("end"), status.alias("status"))


def outer_whitespace(text: Column | str) -> Column:
    """Whether the text starts or ends with (Unicode) white space."""
    return _col(text).rlike(r"^[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]$")


def canonical_newline_hash(text: Column | str) -> Column:
    """SHA-256 of the text with CRLF as LF; a lone CR stays."""
    return F.sha2(F.replace(_col(text), F.lit("\r\n"), F.lit("\n")), 256)


def safe_name(name: Column | str) -> Column:
    """A file-system-safe name: other characters become _, outer dots and underscores go, and a
    changed name gets ten hex digits of its SHA-256."""
    name = _col(name)
    base = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9_.-]", "_"), "^[._]+|[._]+$", "")
    return F.when(base == name, base).otherwise(F.concat(base, F.lit("-"), F.substring(F.sha2(name, 256), 1, 10)))


def natural_key(value: Column | str) -> list[Column]:
    """Sort keys that put numbers first, by value, then other texts. Numbers may have any number of digits."""
    value = _col(value)
    number = value.rlike("^[0-9]+$")
    digits = F.when(number, F.regexp_replace(value, "^0+", ""))
    return [F.when(number, 0).otherwise(1), F.length(digits), digits, value]


#: Bytes of text whose pieces make one batch, but for a longer text.
PIECE_BYTES = 1 << 18


def pieces(df: DataFrame, key: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep..., token_index, char_start, char_end, piece): runs of white space and of other characters.

    All pieces together are the text; null and empty texts have none. White space is space, line feed
    and tab; no tokenizer is needed. Boundaries and code points are counted over whole batches at once,
    columns to ``keep`` go along, and nothing is shuffled.
    """
    rows = df.select(key, *keep, F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    names = [key, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, size = batch.column("_text").fill_null(""), 0
            cuts = [0]
            for k, n in enumerate(pc.binary_length(whole).to_pylist()):
                if size and size + n > PIECE_BYTES:
                    cuts.append(k)
                    size = 0
                size += n
            for low, high in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                owner, index, first, last, piece = _taken_apart(whole.slice(low, high - low))
                columns = [batch.column(c).slice(low, high - low).take(pa.array(owner)) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x.astype(np.int32)) for x in (index, first, last)], piece], [*names, "token_index", "char_start", "char_end", "piece"])

    return rows.mapInArrow(run, f"{fields}, token_index int, char_start int, char_end int, piece string")


def _taken_apart(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """For each piece of each text: its text, its number there, its first and last code point, and itself."""
    texts = texts.cast(pa.large_string())
    offsets, data = texts.buffers()[1:]
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    blank = (raw == 32) | (raw == 10) | (raw == 9)
    opens = np.ones(len(raw), bool)
    opens[1:] = blank[1:] != blank[:-1]
    opens[at[:-1][at[:-1] < len(raw)]] = True
    start = np.flatnonzero(opens)
    owner = np.searchsorted(at, start, "right") - 1
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    end = np.append(start[1:], len(raw))
    index = np.arange(len(start)) - np.searchsorted(start, at[:-1])[owner]
    ends = np.append(start, len(raw)).astype(np.int32)
    piece = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())])
    return owner, index, points[start] - points[at[owner]], points[end] - points[at[owner]], piece


def render_chat(system: Column | str, prompt: Column | str, response: Column | str, template: dict[str, str] | None = None) -> Column:
    """System and user turns by a declared template, the generation header, and the response verbatim."""
    t = TEMPLATE | (template or {})
    return F.concat(F.lit(t["system"]), _col(system), F.lit(t["end"]), F.lit(t["user"]), _col(prompt), F.lit(t["end"]), F.lit(t["assistant"]), _col(response))


def render_legacy(system: Column | str, prompt: Column | str, response: Column | str, template: dict[str, str] | None = None) -> Column:
    """The older render: the response as a turn of its own, closed like the others."""
    return F.concat(render_chat(system, prompt, response, template), F.lit((TEMPLATE | (template or {}))["end"]))


TEMPLATE = {"system": "<|system|>\n", "user": "<|user|>\n", "assistant": "<|assistant|>\n", "end": "<|end|>\n"}


def markdown_cell(value: Column | str) -> Column:
    """A value in a Markdown table: pipes escaped, line feeds as spaces, null empty."""
    text = F.coalesce(_col(value).cast("string"), F.lit(""))
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def markdown_row(*values: Column | str) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(v) for v in values]), F.lit(" |"))
