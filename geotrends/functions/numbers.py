"""Number functions: display text, ratios, growth and exact sums."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from geotrends.fixed_values import NUMBER_UNITS, SEGMENT_GROWTH, SEGMENT_VOLUME

# 2^27 + 1 cuts a double into two halves whose products are exact.
_SPLIT = float(2**27 + 1)
_LONG = 2.0**63


def _seldom(c: Column, text: Callable[[Column], Column]) -> Column:
    """``text(c)`` for rare values, kept out of the generated code.

    A method of generated code may have 64 KB; the rare forms of two columns
    alone would pass that and switch code generation off for the whole stage. As
    the body of a lambda they are evaluated for the rows that need them only.
    """
    return F.element_at(F.transform(F.array(c), text), 1)


def _two_decimals(q: Column) -> Column:
    """Text of a positive ``q`` with two decimals, rounded by its exact binary value.

    ``format_string`` rounds the shortest decimal text half up, which differs
    on ties. Only when ``q * 100`` ends in exactly .5 can the rounded product
    hide on which side the true product lies; its error term then decides.
    """
    product = q * 100
    carry = q * _SPLIT
    high = carry - (carry - q)
    error = (high * 100 - product) + (q - high) * 100
    nudge = F.when(product - F.floor(product) == 0.5, F.signum(error) * 0.25).otherwise(0.0)
    hundredths = F.rint(product + nudge).cast("bigint").cast("decimal(18,0)")
    short = (hundredths * F.lit("0.01").cast("decimal(2,2)")).cast("string")
    # Beyond 2^46 the hundredths are not exact.
    return F.when(q < 2.0**46, short).otherwise(_seldom(q, _large_with_decimals))


def _large_with_decimals(q: Column) -> Column:
    # Whole part and fraction are exact by themselves.
    whole = F.when(q < _LONG, q).cast("bigint")
    cents = F.rint((q - whole) * 100).cast("int").cast("string")
    long = F.concat(whole.cast("string"), F.lit("."), F.lpad(cents, 2, "0"))
    # From 2^63 on there is no fraction: the upper and lower bits are whole numbers.
    upper = F.floor(F.when(q < _LONG * 2.0**53, q) / _LONG)
    lower = (q - upper * _LONG).cast("bigint").cast("decimal(20,0)")
    bits = (upper.cast("decimal(16,0)") * F.lit(str(2**63)).cast("decimal(19,0)") + lower).cast("decimal(38,0)")
    huge = F.concat(bits.cast("string"), F.lit(".00"))
    return F.when(q < _LONG, long).otherwise(F.coalesce(huge, F.format_string("%.2f", q)))


def _plain_text(c: Column) -> Column:
    """Text of a number: a plain decimal, and with an exponent below 1e-4 and from 1e16 on."""
    text = c.cast("string")
    usual = (F.abs(c) < 1e7) & ((F.abs(c) >= 1e-3) | (c == 0))
    return F.when(usual, text).otherwise(_seldom(c, _long_text))


def _long_text(c: Column) -> Column:
    text = F.replace(c.cast("string"), F.lit("Infinity"), F.lit("inf"))
    digits = F.rtrim(text.try_cast("decimal(38,20)").cast("string"), F.lit("0"))
    plain = F.regexp_replace(digits, r"\.$", ".0")
    with_power = _with_power(text, c)
    inside = (F.abs(c) >= 1e-4) & (F.abs(c) < 1e16)
    return F.when(text.contains("E"), F.when(inside, plain).otherwise(with_power)).otherwise(text)


def _with_power(text: Column, c: Column) -> Column:
    """The exponent form from Java's: ``1.0E-5`` is ``1e-05``.

    Not every Java prints the shortest digits that give the number back, so
    those of a rounding are taken that does.
    """
    digits, power = F.substring_index(text, "E", 1), F.substring_index(text, "E", -1).try_cast("int")
    forms = []
    for places in (14, 15):
        rounded = F.round(digits.try_cast("decimal(20,18)"), places)
        full = F.abs(rounded) >= 10
        shown = F.when(full, F.signum(rounded).cast("int").cast("string")).otherwise(rounded.cast("string"))
        forms.append((F.when(shown.contains("."), F.rtrim(shown, F.lit("0"))).otherwise(shown), power + full.cast("int")))
    mantissa, exponent = digits, power
    for shown, moved in reversed(forms):
        same = F.concat(shown, F.lit("E"), moved.cast("string")).try_cast("double") == c
        mantissa, exponent = F.when(same, shown).otherwise(mantissa), F.when(same, moved).otherwise(exponent)
    size = F.abs(exponent).cast("string")
    padded = F.when(F.length(size) > 2, size).otherwise(F.lpad(size, 2, "0"))
    sign = F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+"))
    return F.concat(F.regexp_replace(mantissa, r"\.0*$", ""), sign, padded)


def number_scale(c: Column) -> Column:
    """Bound and unit name of a number's text, null for small and negative numbers."""
    scale = None
    for size, name in NUMBER_UNITS:
        pair = F.struct(F.lit(size).alias("size"), F.lit(name).alias("unit"))
        scale = F.when(c > size, pair) if scale is None else scale.when(c > size, pair)
    return scale


def number_text(c: Column, scale: Column, scaled: Column) -> Column:
    """Text of ``c`` given its :func:`number_scale` and ``c`` divided by the size of that."""
    return (
        F.when(scale.isNull(), _plain_text(c))
        .when(F.isnan(scaled), F.lit("nan"))
        .when(scaled == float("inf"), F.lit(f"inf {NUMBER_UNITS[0][1]}"))
        .otherwise(F.concat(_two_decimals(scaled), F.lit(" "), scale["unit"]))
    )


def human_number(c: Column) -> Column:
    """Short text of a number: ``1.50 M``, ``12.00 Cr``; small or negative ones in full.

    Two decimals, units from ``NUMBER_UNITS`` with strict bounds. Null stays null.
    Whole-number columns print without a decimal point, doubles with one.
    """
    scale = number_scale(c)
    return number_text(c, scale, c / scale["size"])


# Limbs of 28 bits from 2^-84 up to 2^112: a 64-bit sum of one holds 6 x 10^10 rows at its largest.
_LIMB = 28
_LIMBS = range(-3, 4)
_LEAST, _MOST = 2.0 ** (_LIMB * _LIMBS[0]), 2.0 ** (_LIMB * (_LIMBS[-1] + 1))


def money_sum(c: Column) -> Column:
    """Sum of doubles that does not depend on the order of the rows.

    Adding doubles gives a result that does, which a shuffle does not fix. A
    number below 2^43 that is the double next to a whole number of cents counts as
    those cents, and their sum is that of decimals. Every other number counts by its
    binary value, cut into signed 28-bit limbs from 2^112 down to 2^-84, each
    summed exactly in 64 bits; the sums are added at the end, from the lowest up, so the
    result lies within a unit of its last place. Only what is outside (numbers
    from 2^112 on, bits below 2^-84) is added as doubles. NaN does not count;
    infinite values make the sum infinite or NaN.
    """
    x = c.cast("double")
    cents, size = F.rint(x * 100), F.abs(x)
    is_money = (size < 2.0**43) & (cents / 100 == x)
    high = F.floor(cents / 1e6)
    high_sum = F.sum(F.when(is_money, high)).cast("decimal(20,0)") * F.lit(10000).cast("decimal(5,0)")
    low_sum = F.sum(F.when(is_money, (cents - high * 1e6).cast("bigint"))).cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)")
    money = (high_sum + low_sum).cast("double")
    other = ~is_money & (size < _MOST)
    base, above = F.lit(2.0**_LIMB), None
    outside = F.when(other, x - F.rint(x / _LEAST) * _LEAST).when(~is_money & ~F.isnan(x), x)
    binary = F.sum(F.when(outside != 0, outside))
    for k in reversed(_LIMBS):
        # What rounding to the limb above leaves, as a whole number.
        own = F.rint(x * 2.0 ** (-_LIMB * k))
        limb = F.sum(F.when(other, (own if above is None else own - above * base).cast("bigint")))
        above = own
        parts = [limb] if k == _LIMBS[-1] else [*parts, limb]
    total = None
    for k, limb in zip(_LIMBS, reversed(parts)):
        part = limb * F.lit(2.0 ** (_LIMB * k))
        total = part if total is None else total + part
    others = F.when(total.isNull(), binary).otherwise(total + F.coalesce(binary, F.lit(0.0)))
    return F.when(others.isNull(), money).otherwise(F.coalesce(money, F.lit(0.0)) + others)


def safe_ratio(a: Column, b: Column) -> Column:
    """``a / b``, null when ``b`` is zero."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def round2(c: Column) -> Column:
    """Two decimals, half away from zero."""
    return F.round(c, 2)


def pct_change(current: Column, previous: Column) -> Column:
    """Change in percent.

    From zero to something is infinite growth; zero to zero is unknown (null).
    """
    now, before = current.cast("double"), previous.cast("double")
    change = now - before
    return (
        F.when(before != 0, change / F.nullif(before, F.lit(0.0)) * 100)
        .when(change > 0, F.lit(float("inf")))
        .when(change < 0, F.lit(float("-inf")))
    )


def segment(
    growth: Column, volume: Column, min_growth: float = SEGMENT_GROWTH, min_volume: float = SEGMENT_VOLUME
) -> Column:
    """Segment by growth and volume.

    A volume exactly on the bound, a small one with low growth, and an unknown
    growth all count as idle.
    """
    large, small = volume > min_volume, volume < min_volume
    fast, slow = growth > min_growth, growth <= min_growth
    return (
        F.when(large & fast, F.lit("Best"))
        .when(large & slow, F.lit("Saturated"))
        .when(small & fast, F.lit("Rising"))
        .otherwise(F.lit("Idle"))
    )


def truncate_int(c: Column) -> Column:
    """Whole part of a number, towards zero."""
    return c.cast("bigint")
