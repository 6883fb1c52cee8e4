"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from platewise.schema import PRICE_LABELS, UNKNOWN

# A token is a run of two or more word characters (letters, digits, '_').
# Written with Unicode classes: Java's \w is ASCII-only.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: str | Column, default: float | None = None) -> Column:
    """B2: tolerant number parse; text that is not a number becomes null
    (or ``default``).  ``try_cast`` never raises, also under ANSI mode."""
    parsed = col_of(c).try_cast("double")
    return parsed if default is None else F.coalesce(parsed, F.lit(float(default)))


def yes_no_flag(c: str | Column) -> Column:
    """B3: 'yes' in any letter case -> 1, anything else (also null) -> 0."""
    return F.when(F.lower(col_of(c)) == "yes", F.lit(1)).otherwise(F.lit(0))


def main_cuisine(c: str | Column, missing: str | None = UNKNOWN) -> Column:
    """First item of a comma-separated list, trimmed."""
    src = col_of(c) if missing is None else F.coalesce(col_of(c), F.lit(missing))
    return F.trim(F.split_part(src, F.lit(","), F.lit(1)))


def cuisine_items(c: str | Column) -> Column:
    """Items of a comma-separated list, trimmed (array<string>)."""
    return F.transform(F.split(col_of(c), ","), lambda x: F.trim(x))


def word_tokens(c: str | Column) -> Column:
    """Lower-cased word tokens of a text (array<string>)."""
    return F.regexp_extract_all(F.lower(col_of(c)), F.lit(TOKEN_PATTERN), 0)


def round6(c: str | Column) -> Column:
    return F.round(col_of(c), 6)


def clamp(c: str | Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col_of(c)))


def rating_band(c: str | Column) -> Column:
    """Marker colour band of a rating."""
    r = col_of(c)
    return (
        F.when(r >= 4.5, "Excellent")
        .when(r >= 4.0, "Good")
        .when(r >= 3.5, "Average")
        .otherwise("Below Average")
    )


def density_band(c: str | Column) -> Column:
    """Locality density by venue count."""
    n = col_of(c)
    return F.when(n > 50, "High").when(n > 20, "Medium").otherwise("Low")


def score_band(c: str | Column) -> Column:
    """Colour band of a 0..100 score."""
    s = col_of(c)
    return (
        F.when(s >= 80, "green")
        .when(s >= 60, "blue")
        .when(s >= 40, "amber")
        .otherwise("red")
    )


def price_label(c: str | Column) -> Column:
    """Price range 1..4 as a label, else 'Unknown'."""
    p = col_of(c)
    expr = None
    for value, label in PRICE_LABELS.items():
        expr = F.when(p == value, label) if expr is None else expr.when(p == value, label)
    return expr.otherwise(UNKNOWN)
