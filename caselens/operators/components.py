"""Connected components that are kept up to date while links arrive.

A store holds two things. ``members`` is append-only: every node once, with the
component it had when it came. ``moves`` says which components have since become
part of others; it has a row per component that was ever merged away, not per
node, and each load writes it anew. So a load costs its own links, one lookup of
their ends in the store and the merged components, not a run over all links.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.operators.graph import components
from caselens.runtime import broadcast_if_small, materialize


class ComponentStore:
    """Components under ``path``, a folder on shared storage.

    Loads are numbered by the caller, upwards. A load becomes visible with its
    ``moves`` and is written over when it is repeated, so a run that died can
    simply be repeated. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, *, id_type: str = "bigint"):
        self.spark, self.path, self.id_type = spark, path.rstrip("/"), id_type

    def _table(self, name: str, columns: str) -> DataFrame:
        schema = f"{columns}, load int"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _moves(self) -> DataFrame:
        return self._table("moves", f"component {self.id_type}, root {self.id_type}")

    def last_load(self, before: int | None = None) -> int:
        """Number of the last finished load (before ``before``), -1 if there is none."""
        moves = self._moves()
        if before is not None:
            moves = moves.where(F.col("load") < before)
        return moves.agg(F.coalesce(F.max("load"), F.lit(-1))).first()[0]

    def _at(self, load: int) -> tuple[DataFrame, DataFrame]:
        members = self._table("members", f"id {self.id_type}, component {self.id_type}")
        # Members of a load that never finished do not count: every finished one has its row of nulls.
        finished = self._moves().where(F.col("component").isNull() & (F.col("load") <= load)).select("load")
        moves = self._moves().where(F.col("component").isNotNull() & (F.col("load") == load))
        return members.join(broadcast_if_small(finished), "load", "left_semi").drop("load"), moves.drop("load")

    def read(self) -> DataFrame:
        """``(id, component)`` of every node with an edge in any load; the component is its least id."""
        return self._resolved(*self._at(self.last_load()))

    @staticmethod
    def _resolved(members: DataFrame, moves: DataFrame) -> DataFrame:
        found = members.join(broadcast_if_small(moves), "component", "left")
        return found.select("id", F.coalesce("root", "component").alias("component"))

    def append(self, links: DataFrame, *, load: int, src: str = "src", dst: str = "dst") -> None:
        """Add the links of one load. Links with a null end and links of a node to itself say nothing."""
        before = self.last_load(load)
        if self.last_load() > load:
            raise ValueError(f"load {load} was followed by others")
        members, moves = self._at(before)
        links = materialize(
            links.select(F.col(src).cast(self.id_type).alias("a"), F.col(dst).cast(self.id_type).alias("b"))
            .where("a <> b").distinct(), "links")
        ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        # The stored nodes stay where they are if the ends are few.
        met = members.join(broadcast_if_small(ends), "id")
        known = materialize(self._resolved(met, moves), "ends")
        lookup = broadcast_if_small(known)
        roots = (links.join(lookup.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left")
                 .join(lookup.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
                 .select(F.coalesce("ca", "a").alias("src"), F.coalesce("cb", "b").alias("dst")))
        merged = materialize(components(roots), "merged")
        # Ids of ``merged`` are stored components and new nodes; a new node is no stored component.
        new = ends.join(lookup, "id", "left_anti").join(broadcast_if_small(merged), "id", "left").select(
            "id", F.coalesce("component", "id").alias("component"))
        new.write.mode("overwrite").parquet(f"{self.path}/members/load={load}")
        became = merged.where("id <> component").select(F.col("id").alias("component"), F.col("component").alias("root"))
        became = broadcast_if_small(known.select("component").distinct()).join(became, "component")
        became = materialize(became, "became")
        onward = broadcast_if_small(became.select(F.col("component").alias("root"), F.col("root").alias("next")))
        older = moves.join(onward, "root", "left").select("component", F.coalesce("next", "root").alias("root"))
        # The row of nulls marks a load without moves as finished.
        mark = self.spark.range(1).select(F.lit(None).cast(self.id_type).alias("component"), F.lit(None).cast(self.id_type).alias("root"))
        (older.unionByName(became).unionByName(mark)
         .write.mode("overwrite").parquet(f"{self.path}/moves/load={load}"))
