"""Vector functions over array columns, as Catalyst expressions (no Python at run time)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = math.log(2.0)


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once; in a lambda, a plain expression would be again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(x: Column | str) -> Column:
    return F.transform(_col(x), lambda v: v.cast("double"))


def total(x: Column | str) -> Column:
    """Sum of an array, from the first element on."""
    return F.aggregate(_col(x), F.lit(0.0), lambda acc, v: acc + v.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str, eps: float = 1e-8) -> Column:
    """Cosine similarity; either norm counts as ``eps`` at least."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def rms_norm(a: Column | str, eps: float = 1e-6) -> Column:
    def scaled(x: Column) -> Column:
        return let(F.sqrt(dot(x, x) / F.size(x) + eps), lambda scale: F.transform(x, lambda v: v / scale))

    return let(doubles(a), scaled)


def logsumexp(a: Column | str) -> Column:
    return let(doubles(a), lambda x: let(F.array_max(x), lambda top: top + F.log(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v - top)))))


def log_softmax(a: Column | str) -> Column:
    return let(doubles(a), lambda x: let(logsumexp(x), lambda whole: F.transform(x, lambda v: v - whole)))


def softmax(a: Column | str) -> Column:
    return F.transform(log_softmax(a), F.exp)


def jsd_standard(before: Column | str, after: Column | str) -> Column:
    """Jensen-Shannon divergence of two logit vectors, between 0 and ln 2."""

    def term(x: Column, y: Column) -> Column:
        m = F.log((F.exp(x) + F.exp(y)) / 2)
        return (F.exp(x) * (x - m) + F.exp(y) * (y - m)) / 2

    return F.least(F.greatest(total(F.zip_with(log_softmax(before), log_softmax(after), term)), F.lit(0.0)), F.lit(LN2))


#: Scale of the legacy score.
LEGACY_SCALE = 1e6


def jsd_legacy(before: Column | str, after: Column | str) -> Column:
    """The legacy score: the mean over the vocabulary of KL from the mixture to both sides, scaled."""

    def term(x: Column, y: Column) -> Column:
        m = (F.exp(x) + F.exp(y)) / 2
        return (m * (F.log(m) - x) + m * (F.log(m) - y)) / 2

    parts = F.zip_with(log_softmax(before), log_softmax(after), term)
    return F.greatest(total(parts) / F.size(_col(before)) * LEGACY_SCALE, F.lit(0.0))


def rotate_half(a: Column | str) -> Column:
    a = _col(a)
    half = (F.size(a) / 2).cast("int")
    return F.concat(F.transform(F.slice(a, half + 1, half), lambda v: -v), F.slice(a, F.lit(1), half))


def rotary(a: Column | str, position: Column | str, base: float = 10000.0) -> Column:
    """The vector with rotary positions: each pair (k, k + half) turned by position / base ** (k / half)."""
    a = _col(a)
    half = (F.size(a) / 2).cast("int")
    at = lambda k: _col(position).cast("double") / F.pow(F.lit(base), (k % half).cast("double") / half)
    return F.zip_with(F.transform(a, lambda x, k: x.cast("double") * F.cos(at(k))), F.transform(rotate_half(a), lambda x, k: x.cast("double") * F.sin(at(k))), lambda x, y: x + y)


def minmax(value: Column | str, low: Column, high: Column) -> Column:
    """(value - low) / (high - low) without clipping; 0 where the range is empty."""
    return F.when(high == low, F.lit(0.0)).otherwise((_col(value) - low) / (high - low))


def is_finite(x: Column | str) -> Column:
    x = _col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
