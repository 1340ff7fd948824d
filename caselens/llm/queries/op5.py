from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caselens.llm import lines
from caselens.llm.registry import query, table


@query("op5_line_dedup", r"""
WITH d AS (SELECT doc_id, string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, list_sort(list_distinct(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+'))) AS w
  FROM d, unnest(range(1, coalesce(len(ls), 0) + 1)) t(i)),
ok AS (SELECT * FROM l WHERE len(w) > 0),
c AS (SELECT w, min((doc_id, i)) AS ref, row_number() OVER (ORDER BY min((doc_id, i))) AS k FROM ok GROUP BY w),
t AS (SELECT k, len(w) AS n, unnest(w) AS x FROM c),
f AS (SELECT x, count(*) AS df FROM t GROUP BY x),
p AS (SELECT k, n, x FROM t JOIN f USING (x)
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY df, x) <= n - ceil(n * 4 / 5.0) + 1),
pairs AS (SELECT DISTINCT a.k AS k1, b.k AS k2 FROM p a JOIN p b ON a.x = b.x AND a.k < b.k AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
sim AS (SELECT DISTINCT k2 FROM pairs JOIN c a ON a.k = k1 JOIN c b ON b.k = k2
  WHERE 9 * len(list_intersect(a.w, b.w)) >= 4 * (len(a.w) + len(b.w))),
gone AS (SELECT ok.doc_id, ok.i FROM ok JOIN c USING (w) WHERE (ok.doc_id, ok.i) <> c.ref OR c.k IN (SELECT k2 FROM sim)),
g AS (SELECT doc_id, count(*) AS n, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS removed FROM gone GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM ok GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_lines, coalesce(g.n, 0) AS n_removed, coalesce(g.removed, '') AS removed
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)""")
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))
