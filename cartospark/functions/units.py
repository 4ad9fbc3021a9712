"""Quantities in tag values, and text helpers, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MPH = 1.60934


def number(text: Column) -> Column:
    """A whole text as a double; null if it is none."""
    return F.trim(text).try_cast("double")


def speed_int(value: Column) -> Column:
    """km/h as an int: mph converted and truncated, km/h and kmh stripped; null otherwise."""
    v = F.lower(F.trim(value))
    plain = number(F.regexp_replace(v, "km/h|kmh", ""))
    return F.when(v.contains("mph"), (number(F.replace(v, F.lit("mph"), F.lit(""))) * MPH).cast("int")).otherwise(plain.cast("int"))


def speed_leading(value: Column) -> Column:
    """km/h of the leading number, mph converted; null for none, signals, variable and walk."""
    v = F.lower(F.trim(value))
    n = F.nullif(F.regexp_extract(v, r"^([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("double")
    return F.when(v.isin("none", "signals", "variable", "walk"), None).when(v.contains("mph"), n * MPH).otherwise(n)


def height(value: Column) -> Column:
    """Metres of "12", "12 m", "40ft"."""
    v = F.lower(F.trim(value))
    return F.when(v.endswith("ft"), number(F.regexp_replace(v, "ft$", "")) * 0.3048).when(v.endswith("m"), number(F.regexp_replace(v, "m$", ""))).otherwise(number(v))


def truthy(value: Column, *values: str) -> Column:
    return F.coalesce(F.lower(value).isin(*values), F.lit(False))


def is_oneway(v: Column) -> Column:
    return truthy(v, "yes", "1", "true", "-1")


def is_lit(v: Column) -> Column:
    return truthy(v, "yes", "24/7", "automatic", "limited")


def has_sidewalk(v: Column) -> Column:
    return truthy(v, "yes", "both", "left", "right", "separate")


def split_values(value: Column, sep: str = ";") -> Column:
    """The parts of a multi-valued tag, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(value, sep), lambda x: F.trim(x)), lambda x: x != "")


def grade(score: Column, grades) -> tuple[Column, Column]:
    """(letter, words) of a score by descending bounds."""
    letter, words = F.lit(grades[-1][1]), F.lit(grades[-1][2])
    for bound, a, b in reversed(grades[:-1]):
        letter, words = F.when(score >= bound, a).otherwise(letter), F.when(score >= bound, b).otherwise(words)
    return letter, words


def turn(angle: Column) -> Column:
    """What to do at a change of bearing, in degrees between -180 and 180."""
    side = F.when(angle > 0, "right").otherwise("left")
    a = F.abs(angle)
    return F.when(a < 20, F.lit("Continue straight")).when(a > 150, F.lit("Make a U-turn")).when(a > 70, F.concat(F.lit("Turn "), side)).otherwise(F.concat(F.lit("Bear "), side))


def xml_escaped(v: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        v = F.replace(v, F.lit(a), F.lit(b))
    return v


def metres(text: str) -> float:
    """"500m", "1km" or a bare number of metres."""
    t = text.strip().lower()
    return float(t[:-2]) * 1000 if t.endswith("km") else float(t[:-1]) if t.endswith("m") else float(t)


def degrees(text: str) -> float:
    """A tolerance: "10m" or "1km" as degrees of latitude, a bare number as degrees."""
    from ..constants import M_PER_DEG

    t = text.strip().lower()
    return metres(t) / M_PER_DEG if t.endswith("m") else float(t)


def file_size(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TB"


def round_half_even(c: Column, digits: int = 0) -> Column:
    """``c`` rounded on its exact binary value, ties to the even digit, where Spark's round() goes by the decimal text, ties up.

    For up to 7 digits and values below 2^52 / 10^digits; others are left to
    Spark's bround(). Twice the scaled value is split in two products without an
    error, so that its side of a tie is known for certain.
    """
    if not 0 <= digits <= 7:
        raise ValueError("0 to 7 digits")
    x, k = c.cast("double"), float(2 * 10**digits)
    big = x * 134217729.0  # 2^27 + 1: the upper half of the binary digits
    high = big - (big - x)
    low = x - high
    down = F.floor(x * (k / 2))
    side = (high * k - (2 * down + 1).cast("double")) + low * k
    whole = down + F.when((side > 0) | ((side == 0) & (F.pmod(down, F.lit(2)) == 1)), 1).otherwise(0)
    return F.when(F.abs(x) < 2.0**52 / 10**digits, whole.cast("double") / float(10**digits)).otherwise(F.bround(x, digits))
