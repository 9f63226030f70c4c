"""No data is NULL everywhere: what turns other forms into it, and IEEE arithmetic that ANSI SQL refuses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def as_column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def let(value: Column, body) -> Column:
    """body(value) with the value made once, as a lambda's variable, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def nd(c: Column) -> Column:
    """NULL where c is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < INF), c)


def known(c: Column) -> Column:
    """NULL where c is NaN; infinities stay (inside an expression they are values)."""
    return F.nanvl(c, F.lit(None).cast("double"))


def decode(raw: Column, fill: float | None = None, scale: float = 1.0, offset: float = 0.0) -> Column:
    """The physical value of a stored one: the fill value and non-finite values are NULL, tested before scale and offset."""
    value = nd(raw.cast("double"))
    if fill is not None:
        value = F.when(value != F.lit(float(fill)), value)
    if scale != 1.0:
        value = value * F.lit(float(scale))
    return value + F.lit(float(offset)) if offset else value


def complex_part(i: Column, q: Column, part: str, scale: float = 1.0, offset: float = 0.0) -> Column:
    """Amp, Phase, I or Q of a complex value; scale and offset don't act on Amp and Phase."""
    i, q = i.cast("double"), q.cast("double")
    if part == "Amp":
        return nd(F.hypot(i, q))
    if part == "Phase":
        return nd(F.atan2(q, i))
    if part in ("I", "Real", "Q"):
        return nd((q if part == "Q" else i) * F.lit(scale) + F.lit(offset))
    raise ValueError(f"no part {part!r} of a complex value: Amp, Phase, I, Q")


def divide(a: Column, b: Column) -> Column:
    """IEEE a / b: x / 0 is infinite, 0 / 0 is NaN (the sign of a zero is not looked at)."""
    over_zero = F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF)).when(a.isNotNull(), F.lit(float("nan")))
    return F.when(b == 0, over_zero).otherwise(a / F.when(b != 0, b))


def power(a: Column, b: Column) -> Column:
    """IEEE pow: x^0 and 1^x are 1 whatever x is."""
    return F.when(b == 0, F.lit(1.0)).when(a == 1, F.lit(1.0)).otherwise(F.pow(a, b))


def logarithm(x: Column, base_ten: bool = False) -> Column:
    """ln or log10: -inf at zero, NaN below."""
    log = F.log10 if base_ten else F.ln
    return F.when(x > 0, log(x)).when(x == 0, F.lit(-INF)).when(x < 0, F.lit(float("nan")))


def clamp(x: Column, a: Column, b: Column) -> Column:
    """x held between a and b in either order; NULL if x is; x if both bounds are."""
    x = known(x)
    low, high = F.least(known(a), known(b)), F.greatest(known(a), known(b))
    return F.when(x.isNotNull(), F.coalesce(F.least(F.greatest(x, low), high), x))


def mask(x: Column, c: Column) -> Column:
    """x where c is 0; NULL elsewhere and where c is unknown."""
    return F.when(c == 0, x)


def db(v: Column) -> Column:
    """20 log10 of the absolute value, from 1e-10 on."""
    return F.when(v.isNotNull(), F.log10(F.greatest(F.abs(v), F.lit(1e-10))) * 20)


def stretch(v: Column, lo: float, hi: float, gamma: float = 1.0) -> Column:
    """0 at lo to 1 at hi, clamped, to the power gamma."""
    unit = F.greatest(F.least((v - F.lit(float(lo))) / F.lit(float(hi - lo) or 1.0), F.lit(1.0)), F.lit(0.0))
    return F.when(v.isNotNull(), F.pow(unit, F.lit(float(gamma))))
