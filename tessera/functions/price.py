"""Money as integer minor units: an approximate form for markup, an exact one for adapters."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_EXPONENT = 2
REPRESENTATIONS = ("minor_int", "major_decimal", "minor_int_with_exponent")
PLAIN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"
MAX_EXPONENT = 18


def approximate_minor(price: Column) -> Column:
    """Twice-decimal minor units through a double, half away from zero; null for other texts, NaN and infinity."""
    value = price.try_cast("double")
    sound = F.when(~F.isnan(value) & (F.abs(value) < 9e16), value)
    return F.round(sound * 100).cast("decimal(20,0)").try_cast("bigint")


def scaled(text: Column, exponent: Column) -> Column:
    """A plain decimal times 10^exponent as a bigint, half away from zero by the first dropped digit; null if that can't be."""
    t = F.trim(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    sound = F.when(t.rlike(PLAIN) & exponent.between(0, MAX_EXPONENT), t)
    sign = F.when(sound.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(sound, "^[+-]", "")
    whole = F.regexp_extract(digits, r"^([0-9]*)", 1)
    part = F.rpad(F.regexp_extract(digits, r"\.([0-9]*)$", 1), MAX_EXPONENT + 1, "0")
    kept = F.concat(whole, F.substring(part, F.lit(1), exponent))
    significant = F.regexp_replace(kept, "^0+", "")
    value = F.when(F.length(significant) <= 19, F.when(significant == "", F.lit("0")).otherwise(significant).cast("decimal(38,0)"))
    up = (F.substring(part, exponent + 1, F.lit(1)) >= "5").cast("int")
    return ((value + up) * sign).cast("decimal(38,0)").try_cast("bigint")


def power_of_ten(exponent: Column) -> Column:
    """As a decimal: power() would give a double."""
    table = F.create_map(*(x for i in range(MAX_EXPONENT + 1) for x in (F.lit(i), F.lit(Decimal(10) ** i).cast("decimal(38,0)"))))
    return F.try_element_at(table, exponent.cast("int"))


def rescale(value: Column, have: Column, want: Column) -> Column:
    """Minor units at one exponent as units at another, half away from zero; null if out of range."""
    v = value.cast("decimal(20,0)")
    up = F.try_multiply(v, power_of_ten(want - have))
    unit = power_of_ten(have - want)
    # whole division: a decimal quotient is cut to six digits behind the point, so remainders decide
    left = F.abs(v) % unit
    whole = ((F.abs(v) - left) / unit).cast("decimal(20,0)") + (left * 2 >= unit).cast("int")
    down = F.signum(v).cast("int") * whole
    return F.when(want >= have, up).otherwise(down).try_cast("bigint")


def exponent_of(currency: Column, table: dict[str, int]) -> tuple[Column, Column]:
    """The exponent declared for a currency (null if none), and the one to use (2 by default)."""
    pairs = [x for k, v in table.items() for x in (F.lit(k.upper()), F.lit(v))]
    declared = F.try_element_at(F.create_map(*pairs), F.upper(currency)) if pairs else F.lit(None).cast("int")
    return declared, F.coalesce(declared, F.lit(DEFAULT_EXPONENT))


def minor_units(text: Column, representation: str, currency: Column, table: dict[str, int], stated: Column | None = None) -> Column:
    """Exact minor units of a price text in one of the three representations."""
    declared, used = exponent_of(currency, table)
    if representation == "minor_int":
        return scaled(text, F.lit(0))
    if representation == "major_decimal":
        return scaled(text, used)
    if representation != "minor_int_with_exponent" or stated is None:
        raise ValueError(f"representation must be one of {REPRESENTATIONS}, with an exponent for the last")
    plain = scaled(text, F.lit(0))
    return F.when(stated.isNotNull(), F.when(declared.isNull() | (declared == stated), plain).otherwise(rescale(plain, stated, declared)))
