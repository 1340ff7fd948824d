"""Places: postal codes to cities and states, top places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.functions import rules
from caselens.functions.places import city_state, zip5
from caselens.operators.joins import map_values, salted_lookup
from caselens.operators.trends import top_n
from caselens.runtime import materialize, small_enough


def attach_place(
    cases: DataFrame, places: DataFrame, *, zip_code: str, case_id: str, max_broadcast: int = 200_000,
) -> DataFrame:
    """City and state by postal code; cases without a match keep nulls.

    ``places`` has ``zip, city, state_id``; a repeated code counts once (least
    city), so it cannot multiply cases. Beyond ``max_broadcast`` rows the join
    is shuffled with hot codes split.
    """
    dim = (places.select(zip5("zip").alias("zip5"), "city", "state_id")
           .groupBy("zip5").agg(F.min(F.struct("city", "state_id")).alias("p"))
           .select("zip5", "p.city", "p.state_id"))
    keyed = cases.withColumn("zip5", zip5(zip_code))
    if small_enough(places, max_broadcast):
        joined = keyed.join(F.broadcast(dim), "zip5", "left")
    else:
        joined = salted_lookup(keyed, dim, key="zip5", spread_by=[case_id], how="left")
    return joined.withColumn("city_state", city_state("city", "state_id"))


def attach_state_name(df: DataFrame, *, state: str = "state_id", output: str = "state_name") -> DataFrame:
    return map_values(df, rules.STATE_NAMES, key=state, output=output)


def restrict_to_top(
    df: DataFrame, *, by: Sequence[str], n: int = 20, value: str | None = None,
) -> DataFrame:
    """Rows of the n most frequent keys. The key list has n rows, so it is broadcast.

    On counts, ``value`` names the count: the keys are then ranked by its sum.
    The counts are written once, so that ranking them does not count again.
    """
    if value is None:
        best = top_n(df, by=by, n=n)
    else:
        df = materialize(df, "counts")
        total = df.na.drop(subset=list(by)).groupBy(*by).agg(F.sum(value).alias("_total"))
        best = total.orderBy(F.desc("_total"), *by).limit(n)
    return df.join(F.broadcast(best.select(*by)), list(by), "left_semi")
