"""Place expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caselens.functions.text import _col, trim_ws


def zip5(c: Column | str) -> Column:
    """Postal code with leading zeros restored; longer codes are kept whole."""
    z = trim_ws(_col(c).cast("string"))
    return F.when(F.length(z) < 5, F.lpad(z, 5, "0")).otherwise(z)


def city_state(city: Column | str, state: Column | str) -> Column:
    """``City, ST``; null where either part is."""
    return F.concat(_col(city), F.lit(", "), _col(state))
