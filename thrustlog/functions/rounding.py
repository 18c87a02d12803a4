"""Step rounding and text formats."""

from pyspark.sql import functions as F


def roundup(x, mod):
    rest = F.pmod(x, F.lit(mod))
    return F.when(rest == 0, x).otherwise(x + F.lit(mod) - rest)


def rounddown(x, mod):
    """Step down as the logger does it: one step too low for most values between steps."""
    return F.when(F.pmod(x, F.lit(mod)) == 0, x).otherwise(
        (x + F.lit(1)) - F.lit(mod) - F.pmod(x + F.lit(1), F.lit(mod))
    )


def fixed(value, places):
    """Fixed-point text of a double by its exact binary value, ties to even; up to 3 places.

    ``format_string`` rounds the shortest decimal form instead and so differs on near ties.
    """
    scale, unit = 10**places, 2**52
    size = F.abs(value)
    units = F.floor(size).cast("long")
    fine = (size - units) * F.lit(float(unit))
    parts = F.floor(fine).cast("long")
    product = parts * F.lit(scale)
    quotient = F.call_function("div", product, F.lit(unit))
    rest = product - quotient * F.lit(unit)
    odd_or_more = (fine != parts) | (quotient % 2 == 1)
    up = (rest > unit // 2) | ((rest == unit // 2) & odd_or_more)
    digits = quotient + up.cast("long")
    carried = F.when(digits == scale, units + 1).otherwise(units)
    return F.concat(
        F.when(value < 0, "-").otherwise(""),
        carried.cast("string"),
        F.lit("."),
        F.lpad((digits % scale).cast("string"), places, "0"),
    )


def whole(value):
    """Truncate towards zero."""
    return value.cast("long")
