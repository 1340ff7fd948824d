"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caselens.functions.text import _col


def parse_date(c: Column | str, fmt: str | None = None, strict: bool = False) -> Column:
    """Text to timestamp. Bad text gives null, or an error when ``strict``."""
    args = (_col(c),) if fmt is None else (_col(c), F.lit(fmt))
    return F.to_timestamp(_col(c), fmt) if strict else F.try_to_timestamp(*args)


def month_of(c: Column | str) -> Column:
    """First day of the month, as a date without time zone."""
    return F.trunc(_col(c), "MM")


def month_label(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy-MM")
