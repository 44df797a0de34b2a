"""Scalar expressions. All of them stay inside whole-stage code generation."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite_or_null(c: str | Column) -> Column:
    """NaN and both infinities become NULL, the only missing-value marker used downstream."""
    c = _col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def mid_price(bid: str | Column, ask: str | Column) -> Column:
    return (_col(bid) + _col(ask)) / 2


def relative_spread(bid: str | Column, ask: str | Column) -> Column:
    return F.abs(_col(ask) / _col(bid) - 1)


def rounded(c: str | Column, digits: int = 9) -> Column:
    return F.round(_col(c), digits)


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b on doubles with the IEEE result for b = 0, where strict SQL mode would fail the job."""
    a, b = _col(a), _col(b)
    at_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).when(a == 0, F.lit(float("nan")))
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def relu(c: str | Column) -> Column:
    return F.greatest(_col(c), F.lit(0.0))


def softplus(c: str | Column, shift: float = 0.0) -> Column:
    """log(1 + e^x) in the form that does not overflow."""
    c = _col(c)
    return F.greatest(c, F.lit(0.0)) + F.log1p(F.exp(-F.abs(c))) + F.lit(shift)


HEADS = {
    "none": lambda c: _col(c),
    "relu": relu,
    "softplus": softplus,
    "softplus_shift": lambda c: softplus(c, 1e-6),
}


def squared_error(y: str | Column, f: str | Column) -> Column:
    return F.pow(_col(y) - _col(f), F.lit(2.0))


def qlike_term(y: str | Column, f: str | Column, eps_true: float = 0.0, eps_pred: float = 0.0,
               mode: str = "floor", offset: float = 1.0) -> Column:
    """One observation's quasi-likelihood loss r - ln r - offset with r = y / f.

    `mode` says how the epsilons protect the ratio: ``floor`` lifts values below epsilon to it,
    ``add`` adds epsilon to every value. NULL on either side gives NULL, which `avg` skips.
    """
    y, f = _col(y), _col(f)
    if mode == "add":
        y, f = y + F.lit(eps_true), f + F.lit(eps_pred)
    elif mode == "floor":
        y = F.when(y.isNotNull(), F.greatest(y, F.lit(eps_true))) if eps_true else y
        f = F.when(f.isNotNull(), F.greatest(f, F.lit(eps_pred))) if eps_pred else f
    else:
        raise ValueError(f"mode must be 'floor' or 'add', found {mode!r}")
    r = ratio(y, f)
    # A zero or negative value on either side shows as infinity or NaN; it is not silently skipped.
    return (F.when(r > 0, r - F.log(r) - F.lit(offset)).when(r == 0, F.lit(float("inf")))
            .when(r.isNotNull(), F.lit(float("nan"))))


def keyed_uniform(*parts: str | Column | int) -> Column:
    """Uniform in (0, 1) fixed by its key: the same row draws the same number on any executor.

    32 bits of md5 over the key's parts, centred in their cell so that 0 and 1 never occur.
    """
    cols = [F.lit(p) if isinstance(p, int) else _col(p) for p in parts]
    digest = F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(float(2 ** 32))


def keyed_normal(*parts: str | Column | int) -> Column:
    """Standard normal by Box-Muller from two keyed uniforms."""
    u = keyed_uniform(F.lit("u"), *parts)
    v = keyed_uniform(F.lit("v"), *parts)
    return F.sqrt(-2 * F.log(u)) * F.cos(F.lit(2 * pi) * v)
