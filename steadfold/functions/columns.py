"""Column builders for what Spark has no function for, each with the same formula as SQL text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The coefficients of Acklam's published rational approximation of the inverse normal distribution.
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
TAIL = 0.02425


def r6(c: Column | str) -> Column:
    """Rounded to six digits; a negative zero becomes zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0.0))


def hash_uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) that depends on the parts alone: the first 13 hex digits of the MD5 of the parts joined by |.
    The same row gets the same draw in every plan, partitioning and engine."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def _poly(coefficients, x: Column, last: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out if last is None else out * x + last


def probit_parts(p: Column) -> tuple[Column, Column]:
    """What probit() names many times: the square of the distance from the middle, and the tail's argument (nulls are zero)."""
    q = p - 0.5
    return q * q, F.coalesce(F.sqrt(-2 * F.ln(F.least(p, 1 - p))), F.lit(0.0))


def probit(p: Column, parts: tuple[Column, Column] | None = None) -> Column:
    """The inverse of the standard normal distribution, to about 1e-9, for 0 < p < 1. parts: columns that hold probit_parts(),
    for several of these in one projection: with the parts written out, generated code is too long to be compiled."""
    q, (square, t) = p - 0.5, parts or probit_parts(p)
    middle = _poly(ACKLAM_A, square, None) * q / _poly(ACKLAM_B, square, F.lit(1.0))
    # One tail stands for both.
    tail = _poly(ACKLAM_C, t, None) / _poly(ACKLAM_D, t, F.lit(1.0))
    return F.when(p.isNull(), F.lit(None).cast("double")).when(F.least(p, 1 - p) >= TAIL, middle).otherwise(F.when(q < 0, F.lit(1.0)).otherwise(F.lit(-1.0)) * tail)


def hash_uniform_sql(expression: str) -> str:
    """The same draw, as SQL of an engine with unsigned hexadecimal casts; expression: the joined text."""
    return f"(cast(concat('0x', substr(md5({expression}), 1, 13)) AS UBIGINT)::DOUBLE / 4503599627370496.0)"


def probit_sql(p: str) -> str:
    def poly(cs, x, last=None):
        out = repr(cs[0])
        for c in cs[1:]:
            out = f"({out} * {x} + {c!r})"
        return out if last is None else f"({out} * {x} + {last})"

    q = f"({p} - 0.5)"
    tail = lambda t: f"({poly(ACKLAM_C, t)} / {poly(ACKLAM_D, t, '1.0')})"
    low, high = tail(f"sqrt(-2 * ln({p}))"), tail(f"sqrt(-2 * ln(1 - {p}))")
    return f"(CASE WHEN {p} < {TAIL} THEN {low} WHEN {p} > {1 - TAIL} THEN -{high} ELSE {poly(ACKLAM_A, f'({q}*{q})')} * {q} / {poly(ACKLAM_B, f'({q}*{q})', '1.0')} END)"
