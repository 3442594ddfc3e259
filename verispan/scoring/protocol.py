"""What a tokenizer and a token scorer must offer, and the exact alignment of tokens with spans."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Protocol

import numpy as np

from ..functions.texts import TEMPLATE


@dataclass(frozen=True)
class Piece:
    token_id: int
    start: int
    end: int
    special: bool = False
    attended: bool = True


class Tokenizer(Protocol):
    def __call__(self, text: str) -> list[Piece]: ...

    def render(self, system: str, prompt: str) -> str: ...

    def render_legacy(self, system: str, prompt: str, response: str) -> str: ...


class TokenScorer(Protocol):
    def score(self, ids: np.ndarray, predictors: np.ndarray, context: np.ndarray, prefix: int) -> dict[str, np.ndarray]:
        """One value a predictor position for each feature column."""


class PieceTokenizer:
    """Runs of white space and of other characters, with ids by hash; control strings are special."""

    def __init__(self, vocabulary: int = 997):
        self.vocabulary = vocabulary
        control = "|".join(re.escape(v.strip("\n")) for v in TEMPLATE.values())
        self._pattern = re.compile(f"({control})|[^ \\n\\t<]+|<|[ \\n\\t]+")

    def __call__(self, text: str) -> list[Piece]:
        out = []
        for m in self._pattern.finditer(text):
            number = 0
            for c in m.group():
                number = (number * 31 + ord(c)) % self.vocabulary
            out.append(Piece(number, m.start(), m.end(), m.group(1) is not None))
        return out

    def render(self, system: str, prompt: str) -> str:
        t = TEMPLATE
        return f"{t['system']}{system}{t['end']}{t['user']}{prompt}{t['end']}{t['assistant']}"


    def render_legacy(self, system: str, prompt: str, response: str) -> str:
        return self.render(system, prompt) + response + TEMPLATE["end"]


def flatten(ids: list, offsets: list) -> tuple[list[int], list[tuple[int, int]]]:
    """Ids and offsets of one text from a tokenizer's output, batched or not; offsets are pairs that don't fall."""
    if len(ids) == 1 and isinstance(ids[0], (list, tuple, np.ndarray)):
        ids, offsets = ids[0], offsets[0] if len(offsets) == 1 else offsets
    pairs = [tuple(int(x) for x in pair) for pair in offsets]
    if any(isinstance(i, (list, tuple)) for i in ids) or len(ids) != len(pairs) or any(len(p) != 2 for p in pairs):
        raise ValueError("a tokenizer must give one text's ids and as many pairs of offsets")
    if any(a > z for a, z in pairs) or any(x[0] > y[0] for x, y in zip(pairs[:-1], pairs[1:], strict=True)):
        raise ValueError("token offsets must not fall")
    return [int(i) for i in ids], pairs


def shared_prefix(tokenizer: Tokenizer, system: str, prompt: str, response: str) -> int:
    """Tokens before the response that the exact and the legacy render share; an error if they differ there."""
    head = tokenizer.render(system, prompt)
    legacy = tokenizer.render_legacy(system, prompt, response)
    if not legacy.startswith(head + response):
        raise ValueError("the legacy render doesn't begin with the prompt and the response")
    one, two = tokenizer(head + response), tokenizer(legacy)
    count = sum(p.end <= len(head) for p in one)
    if one[:count] != two[:count]:
        raise ValueError("the renders differ before the response")
    return count


@dataclass
class Aligned:
    """A response's tokens in the rendered sequence, with labels; the arrays of a response run parallel."""

    ids: np.ndarray
    positions: np.ndarray
    predictors: np.ndarray
    offsets: list[tuple[int, int]]
    labels: np.ndarray
    context: np.ndarray
    prefix: int


def locate(text: str, part: str, what: str) -> int:
    at = text.find(part)
    if at < 0:
        raise ValueError(f"{what} does not occur")
    if text.find(part, at + 1) >= 0:
        raise ValueError(f"{what} occurs more than once")
    return at


def align(tokenizer: Tokenizer, system: str, prompt: str, context: str, response: str, spans: list[tuple[int, int]], max_length: int | None = None) -> Aligned:
    """Tokenize the rendered sequence once and map its tokens to the response and its spans.

    The response stands verbatim at the end; a usable token is attended, not special and not
    empty; its predictor is the position before it; it is positive if it overlaps a span.
    """
    if not response:
        raise ValueError("the response is empty")
    head = tokenizer.render(system, prompt)
    at = locate(head, prompt, "the prompt") + locate(prompt, context, "the context")
    pieces = tokenizer(head + response)
    if max_length is not None and len(pieces) > max_length:
        raise ValueError(f"{len(pieces)} tokens exceed the limit of {max_length}")
    if any(a.start > b.start for a, b in zip(pieces[:-1], pieces[1:], strict=True)):
        raise ValueError("token offsets must not fall")
    usable = [k for k, p in enumerate(pieces) if p.attended and not p.special and p.end > p.start]
    own = [k for k in usable if pieces[k].end > len(head)]
    inside = [k for k in usable if pieces[k].start < at + len(context) and pieces[k].end > at]
    if not own or not inside:
        raise ValueError("no response tokens" if not own else "no context tokens")
    if own[0] == 0:
        raise ValueError("the first token has no predictor")
    offsets = [(max(pieces[k].start, len(head)) - len(head), pieces[k].end - len(head)) for k in own]
    labels = [int(any(a < z2 and z > a2 for a2, z2 in spans)) for a, z in offsets]
    array = lambda values: np.array(values, np.int64)
    return Aligned(array([p.token_id for p in pieces]), array(own), array(own) - 1, offsets, array(labels), array(inside), own[0])
