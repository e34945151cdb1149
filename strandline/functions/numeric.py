"""Column helpers for numbers that may be missing, NaN or infinite."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """True for a real number; false for NULL, NaN and both infinities (NaN sorts above infinity)."""
    return F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False))


def clean(c: Column) -> Column:
    """The value as a double where finite, else NULL."""
    return F.when(finite(c), c.cast("double"))


def number(c: Column) -> Column:
    """Text to double; text that is no number gives NULL instead of an error."""
    return c.cast("string").try_cast("double")


def text_flag(c: Column) -> Column:
    """true/false/1/0 in any case; anything else is NULL."""
    text = F.lower(c.cast("string"))
    return F.when(text.isin("true", "1"), F.lit(True)).when(text.isin("false", "0"), F.lit(False))


def outside(c: Column, low: float, high: float) -> Column:
    """Finite and not within the closed range."""
    return finite(c) & ((c < F.lit(low)) | (c > F.lit(high)))


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in flags], F.lit(False))


def all_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(f, F.lit(False)) for f in flags], F.lit(True))


def count_true(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def sig_text(c: Column) -> Column:
    """Six significant digits, plain between 1e-4 and 1e6 and scientific outside, zeros trimmed."""
    scientific = F.format_string("%.5e", c)
    six = scientific.try_cast("double")
    plain = F.regexp_replace(F.format_string("%.10f", six), r"\.?0+$", "")
    compact = F.regexp_replace(scientific, r"\.?0+e", "e")
    return F.when(c == 0, F.lit("0")).when((F.abs(six) >= 1e-4) & (F.abs(six) < 1e6), plain).otherwise(compact)


def seconds(c: Column) -> Column:
    """Integer microseconds to seconds."""
    return c / F.lit(1_000_000.0)
