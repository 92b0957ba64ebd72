"""Column helpers that keep the semantics of the original rules: falsy defaults, rounding, word boundaries, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII word boundaries. Java's \b is Unicode-aware, the rules' is not.
B0, B1 = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def words(*alternatives: str) -> str:
    """A pattern for any of the alternatives as whole words."""
    return f"{B0}(?:{'|'.join(alternatives)}){B1}"


def js_or(c: Column, default) -> Column:
    """`c || default` for numbers: null, 0 and NaN give the default."""
    return F.when(c.isNull() | F.isnan(c.cast("double")) | (c == 0), F.lit(default)).otherwise(c)


def js_or_str(c: Column, default) -> Column:
    """`c || default` for strings: null and '' give the default."""
    return F.when(c.isNull() | (c == ""), F.lit(default)).otherwise(c)


def js_round(c: Column, digits: int = 0) -> Column:
    """Half up towards plus infinity."""
    return F.floor(c * 10**digits + F.lit(0.5)) / F.lit(10**digits) if digits else F.floor(c + F.lit(0.5))


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, rounded half up, 0 for an empty whole."""
    return F.when(whole > 0, F.floor(part * 100.0 / whole + 0.5)).otherwise(F.lit(0)).cast("bigint")


def poly_hash(text: Column, seed: int, factor: int) -> Column:
    """hash = hash * factor + code, modulo 2**32, over the letters of text."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    return F.aggregate(codes, F.lit(seed).cast("bigint"), lambda h, c: (h * F.lit(factor) + c).bitwiseAND(F.lit(4294967295)))


def djb2(text: Column) -> Column:
    """Eight hex digits."""
    return F.lpad(F.lower(F.hex(poly_hash(text, 5381, 33))), 8, "0")


def signed_base36(h: Column) -> Column:
    """A 32-bit pattern as a signed number in base 36."""
    signed = F.when(h >= 2147483648, h - 4294967296).otherwise(h)
    digits = F.lower(F.conv(F.abs(signed).cast("string"), 10, 36))
    return F.when(signed < 0, F.concat(F.lit("-"), digits)).otherwise(digits)
