"""Math functions with IEEE results where SQL's would be null or an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def ln(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x < 0, F.lit(NAN)).when(x == 0, F.lit(-INF)).otherwise(F.ln(F.when(x > 0, x)))


def log10(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x < 0, F.lit(NAN)).when(x == 0, F.lit(-INF)).otherwise(F.log10(F.when(x > 0, x)))


def log(value: Column, base: Column) -> Column:
    """The value comes first. To base 1: infinities, and NaN for 1."""
    return divide(ln(value), ln(base))


def divide(a: Column, b: Column, integral: bool = False) -> Column:
    """Integers: the quotient towards zero, an error for 0. Floating point: infinities and NaN for 0."""
    if integral:
        return F.call_function("div", a, b)
    a, b = a.cast("double"), b.cast("double")
    at_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, F.when(a.isNotNull(), at_zero)).otherwise(a / F.nullif(b, F.lit(0.0)))


def rdiv(a: Column, b: Column) -> Column:
    """Real division."""
    return divide(a, b)


def pi() -> Column:
    return F.pi()


def e() -> Column:
    return F.e()


def ceil(x: Column, exact: bool = False) -> Column:
    """exact: x is a decimal, and so is the result."""
    if exact:
        return F.ceil(x)
    d = x.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) >= 2.0**53), d).otherwise(F.ceil(F.when(~F.isnan(d) & (F.abs(d) < 2.0**53), d)).cast("double"))


def floor(x: Column, exact: bool = False) -> Column:
    if exact:
        return F.floor(x)
    d = x.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) >= 2.0**53), d).otherwise(F.floor(F.when(~F.isnan(d) & (F.abs(d) < 2.0**53), d)).cast("double"))


def round_(x: Column, digits: int = 0) -> Column:
    """Halves go away from zero."""
    return F.round(x, digits)


def trunc(x: Column, digits: int = 0, exact: bool = False) -> Column:
    """Towards zero, digits after the point (negative: before it), in decimal digits: 0.29 has 29 hundredths.

    exact: x is a decimal, and so is the result. Doubles beyond 2**52 have nothing to take off after the point, and digits over 15 neither.
    """
    if exact:
        return F.when(x >= 0, F.floor(x, F.lit(digits))).otherwise(F.ceil(x, F.lit(digits)))
    d = x.cast("double")
    big = F.isnan(d) | (F.abs(d) >= 2.0**52) | F.lit(digits > 15)
    if digits == 0:
        return F.when(big, d).otherwise(F.signum(d) * floor(F.abs(d)))
    whole = d
    if digits < 0:  # the text of a large double, as 1.25E16, is cut
        finite = F.when(big & (F.abs(d) < INF), d)
        text = F.abs(finite).cast("string")
        power = F.substring_index(text, "E", -1).cast("int")
        cut = F.concat(F.substring(text, F.lit(1), F.least(power + digits + 2, F.instr(text, "E") - 1)), F.lit("E"), power.cast("string"))
        whole = F.when(finite.isNull(), d).when(power + digits < 0, F.lit(0.0)).otherwise(F.signum(finite) * cut.try_cast("double"))
    n = F.when(~big, d).cast("decimal(38,17)")
    return F.when(big, whole).otherwise(F.when(n >= 0, F.floor(n, F.lit(digits))).otherwise(F.ceil(n, F.lit(digits))).cast("double"))


def cot(x: Column) -> Column:
    return F.cot(x)


def sign(x: Column) -> Column:
    return F.signum(x)


def atan2(y: Column, x: Column) -> Column:
    return F.atan2(y, x)
