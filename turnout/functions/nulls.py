"""Column helpers for the null rules of the published tables.

Membership and pattern tests treat null as "not in the set", so their negations keep nulls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING_TEXT = "NA"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def not_in(c, values) -> Column:
    """True unless the value is one of ``values``; a null value is kept."""
    return ~F.coalesce(column(c).isin(list(values)), F.lit(False))


def not_matching(c, pattern: str) -> Column:
    """True unless the text matches ``pattern``; a null text is kept."""
    return ~F.coalesce(column(c).rlike(pattern), F.lit(False))


def not_containing(c, text: str) -> Column:
    return ~F.coalesce(column(c).contains(text), F.lit(False))


def is_known(c) -> Column:
    """False (or null) for a null and for the text ``NA``."""
    return column(c) != MISSING_TEXT


def paste(*cols, sep: str = " ") -> Column:
    """Join texts; a null part is written as ``NA``."""
    parts = [F.coalesce(column(c).cast("string"), F.lit(MISSING_TEXT)) for c in cols]
    return F.concat_ws(sep, *parts)


def starts_with_year(c) -> Column:
    return column(c).rlike(r"^\d{4}")
