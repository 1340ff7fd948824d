from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.llm import mixing
from caselens.llm.registry import SQL, query, table

#: Quality as a weight: labelled good and labelled bad; 1 where there is no label.
GOOD, BAD = 2.0, 0.5


def quality_weights(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.when(F.col("quality") == 1, GOOD).when(F.col("quality") == 0, BAD).alias("weight"))


SQL["op1_mix_sources"] = r"""
WITH RECURSIVE k AS (
  SELECT d.doc_id, d.source, CAST(coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
    / CASE q.quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS key
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) q USING (doc_id)),
rws AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY key, doc_id, size) AS place FROM k),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM rws GROUP BY 1),
num AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1.0::DOUBLE AS w,
  row_number() OVER (ORDER BY source NULLS LAST) AS i FROM src),
rm AS (SELECT *, source_size * 3.0::DOUBLE / w AS most FROM num),
lv AS (SELECT *, (sum(source_size) OVER () * 1.0::DOUBLE - coalesce(sum(source_size) OVER
    (ORDER BY most, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 3.0::DOUBLE)
  / sum(w) OVER (ORDER BY most, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM rm),
tg AS (SELECT source, source_size, coalesce(least(source_size * 3.0::DOUBLE,
    (SELECT max(level) FROM lv WHERE level <= most) * w), source_size * 3.0::DOUBLE) AS target FROM lv),
pl AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM tg),
ro AS (SELECT *, greatest(target - epochs * source_size, 0) AS room FROM pl),
turns(source, gap, after, until) AS (
  SELECT source, room, 0::BIGINT, 0::BIGINT FROM ro
  UNION ALL
  SELECT source, gap - coalesce(max(run) FILTER (run <= gap), 0), after, min(place) FILTER (run > gap)
  FROM (SELECT t.source, t.gap, t.until AS after, r.place, sum(r.size) OVER (PARTITION BY t.source ORDER BY r.place) AS run
    FROM turns t JOIN rws r ON r.source IS NOT DISTINCT FROM t.source AND r.place > t.until AND r.size > 0 AND r.size <= t.gap)
  GROUP BY source, gap, after),
asked AS (SELECT source, after, until, lag(gap) OVER (PARTITION BY source ORDER BY after, until NULLS LAST) AS gap FROM turns),
extra AS (SELECT DISTINCT r.source, r.place FROM rws r JOIN asked a ON r.source IS NOT DISTINCT FROM a.source AND r.place > a.after
  AND (a.until IS NULL OR r.place < a.until) AND r.size > 0 AND r.size <= a.gap)
SELECT doc_id, rws.source, size, source_size, target, CAST(epochs + (e.place IS NOT NULL)::INTEGER AS INTEGER) AS times,
  CAST(size * (epochs + (e.place IS NOT NULL)::INTEGER) AS BIGINT) AS taken
FROM rws JOIN ro ON rws.source IS NOT DISTINCT FROM ro.source
  LEFT JOIN extra e ON rws.source IS NOT DISTINCT FROM e.source AND rws.place = e.place"""


@query("op1_mix_sources")
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=quality_weights(table(spark, sf_dir, "labels")))
