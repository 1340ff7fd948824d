"""Cleaning, masks, personal data, duplicates and the data profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.functions import rules
from caselens.functions.dates import month_label, parse_date
from caselens.operators import clean, dedup, joins, profile as profiles
from caselens.operators.sampling import first_rows
from caselens.plans.registry import query, table
from caselens.runtime import new_path, spread
from caselens.sources.tables import append_table

# The test texts hold no masks: they are planted around every text, and every
# fiftieth text consists of masks only.
_MASKED = """
masked AS (
  SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'XXXX XX'
    ELSE concat('XXXX  ', text, ' On XX/XX/XXXX, axxb  Xxx paid XXABC // XX/XX/2020 ') END AS narrative
  FROM documents)"""


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    around = F.concat(
        F.lit("XXXX  "), "text", F.lit(" On XX/XX/XXXX, axxb  Xxx paid XXABC // XX/XX/2020 "))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.when(F.col("doc_id") % 50 == 0, "XXXX XX").otherwise(around).alias("narrative"))


@query("clean_mask_token", f"""
WITH {_MASKED}
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(
         narrative, '\\bX{{2,}}\\b', '', 'gi'), ' +', ' ', 'g'), '\\A\\s+|\\s+\\z', '', 'g') AS narrative
FROM masked""")
def clean_mask_token(spark, sf_dir):
    return clean.remove_mask_tokens(masked(spark, sf_dir), text="narrative")


@query("clean_mask_anywhere", f"""
WITH {_MASKED}, cleaned AS (
  SELECT doc_id, narrative, trim(regexp_replace(regexp_replace(regexp_replace(
    narrative, 'X{{2,}}/X{{2,}}/X{{2,}}', '', 'g'), 'X{{2,}}', '', 'g'), '\\s+', ' ', 'g')) AS c
  FROM masked)
SELECT doc_id, CASE WHEN length(c) > 0 THEN c ELSE narrative END AS narrative FROM cleaned""")
def clean_mask_anywhere(spark, sf_dir):
    return clean.remove_masks_anywhere(masked(spark, sf_dir), text="narrative")


@query("blank_rows", """
WITH t AS (
  SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' || chr(9) || ' ' WHEN 2 THEN '' ELSE text END AS text
  FROM documents)
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(text) AS BIGINT) AS n_with_text,
  CAST(count(*) FILTER (WHERE regexp_matches(text, '[^\\s]')) AS BIGINT) AS n_not_blank,
  CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars_filled
FROM t""")
def blank_rows(spark, sf_dir):
    kind = F.col("doc_id") % 5
    t = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(kind == 0, None).when(kind == 1, " \t ").when(kind == 2, "").otherwise(F.col("text")).alias("text"))
    with_text = clean.with_text(t, text="text").agg(F.count("*")).scalar()
    not_blank = clean.without_blank(t, text="text").agg(F.count("*")).scalar()
    filled = clean.fill_text(t, columns=["text"])
    return filled.agg(
        F.count("*").alias("n_rows"), with_text.alias("n_with_text"), not_blank.alias("n_not_blank"),
        F.sum(F.length("text")).alias("n_chars_filled"))


_PII = [(k, p.replace("'", "''"), r) for k, p, r, _ in rules.PII_RULES]


def _pii_sql() -> str:
    parts, source = [], "documents"
    for i, (kind, pattern, placeholder) in enumerate(_PII):
        parts.append(
            f"s{i} AS (SELECT * EXCLUDE (text), regexp_replace(text, '{pattern}', '{placeholder}', 'g') AS text, "
            f"CAST(len(regexp_extract_all(text, '{pattern}')) AS BIGINT) AS n_{kind} FROM {source})")
        source = f"s{i}"
    return "WITH " + ",\n".join(parts)


@query("pii_scrub", f"""{_pii_sql()}
SELECT doc_id, text, {', '.join(f'n_{k}' for k, _, _ in _PII)} FROM s{len(_PII) - 1}""")
def pii_scrub(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return _long_counts(clean.scrub_pii(docs, text="text"))


def _long_counts(df: DataFrame) -> DataFrame:
    return df.withColumns({f"n_{k}": F.col(f"n_{k}").cast("bigint") for k, *_ in rules.PII_RULES})


@query("pii_counts", f"""{_pii_sql()}
SELECT source, {', '.join(f'CAST(sum(n_{k}) AS BIGINT) AS n_{k}' for k, _, _ in _PII)},
  CAST(count(*) AS BIGINT) AS n_rows
FROM s{len(_PII) - 1} GROUP BY source""")
def pii_counts(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("source", "text"))
    found = _long_counts(clean.scrub_pii(docs, text="text"))
    return found.groupBy("source").agg(
        *[F.sum(f"n_{k}").alias(f"n_{k}") for k, *_ in rules.PII_RULES], F.count("*").alias("n_rows"))


@query("stamped_rows", """
SELECT doc_id, n_chars, '2024-12-31' AS snapshot_date, 'rules-1' AS model_version FROM documents""")
def stamped_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return clean.stamp(docs, snapshot_date="2024-12-31", model_version="rules-1")


@query("filter_subset", """
SELECT o_orderkey, o_totalprice FROM orders
WHERE year(o_orderdate) = 1997 AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'""")
def filter_subset(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    in_year = orders.where((F.col("o_orderdate") >= "1997-01-01") & (F.col("o_orderdate") < "1998-01-01"))
    return clean.equals_all(in_year, o_orderpriority="1-URGENT", o_orderstatus="F").select("o_orderkey", "o_totalprice")


@query("first_rows", "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 50")
def first_fifty(spark, sf_dir):
    return first_rows(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), case_id="doc_id", n=50)


@query("parsed_dates", """
SELECT o_orderpriority,
  CAST(count(*) AS BIGINT) AS n_rows,
  CAST(count(*) FILTER (WHERE o_orderkey % 7 <> 0) AS BIGINT) AS n_parsed,
  min(strftime(o_orderdate, '%Y-%m')) FILTER (WHERE o_orderkey % 7 <> 0) AS first_month
FROM orders GROUP BY o_orderpriority""")
def parsed_dates(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").select(
        "o_orderpriority",
        F.when(F.col("o_orderkey") % 7 == 0, "no date").otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("received"))
    ts = raw.withColumn("ts", parse_date("received", "MM/dd/yyyy"))
    return ts.groupBy("o_orderpriority").agg(
        F.count("*").alias("n_rows"), F.count("ts").alias("n_parsed"), F.min(month_label("ts")).alias("first_month"))


@query("dedup_exact", """
SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text""")
def dedup_exact(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup.dedup_exact(docs, text="text", case_id="doc_id")


@query("dedup_chunked", """
SELECT doc_id, chunk_id, text FROM (
  SELECT doc_id, doc_id // 100 AS chunk_id, text, min(doc_id // 100) OVER (PARTITION BY text) AS first_chunk FROM documents)
WHERE chunk_id = first_chunk""")
def dedup_chunked(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.floor(F.col("doc_id") / 100).alias("chunk_id"), "text")
    return dedup.dedup_chunked(docs, text="text", chunk="chunk_id")


@query("dedup_stats", """
SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_null, count(*) AS n_distinct,
  CAST(sum(n - 1) AS BIGINT) AS n_dropped, count(*) FILTER (WHERE n > 1) AS n_repeated_texts
FROM (SELECT text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text)""")
def dedup_stats(spark, sf_dir):
    return dedup.dedup_stats(table(spark, sf_dir, "documents"), text="text")


@query("dedup_after_cleaning", """
WITH masked AS (
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('XXXX ', text) ELSE text END AS t FROM documents),
cleaned AS (
  SELECT doc_id, trim(regexp_replace(regexp_replace(t, 'X{2,}', '', 'g'), '\\s+', ' ', 'g')) AS text FROM masked)
SELECT min(doc_id) AS doc_id, text FROM cleaned GROUP BY text""")
def dedup_after_cleaning(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    half = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("XXXX "), "text")).otherwise(F.col("text")))
    return dedup.dedup_exact(clean.remove_masks_anywhere(half, text="text"), text="text", case_id="doc_id")


@query("dedup_near", """
WITH RECURSIVE texts AS (SELECT text, min(doc_id) AS rep FROM documents GROUP BY text),
w AS (SELECT rep, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS ws FROM texts),
sh AS (
  SELECT DISTINCT rep, s FROM (
    SELECT rep, unnest(CASE WHEN len(ws) >= 3
      THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' '))
      ELSE [array_to_string(ws, ' ')] END) AS s FROM w)),
sizes AS (SELECT rep, count(*) AS n FROM sh GROUP BY rep),
common AS (SELECT a.rep AS ra, b.rep AS rb, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.rep <> b.rep GROUP BY 1, 2),
links AS (
  SELECT ra, rb FROM common JOIN sizes sa ON ra = sa.rep JOIN sizes sb ON rb = sb.rep
  WHERE c / (sa.n + sb.n - c) >= 0.8),
reach(id, root) AS (
  SELECT rep, rep FROM texts UNION SELECT links.rb, reach.root FROM reach JOIN links ON reach.id = links.ra),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT doc_id, root AS group_id FROM documents JOIN texts USING (text) JOIN roots ON texts.rep = roots.id""")
def dedup_near(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup.near_dup_groups(docs, case_id="doc_id", text="text", threshold=0.8)


_PROFILED = ["lang", "source", "text", "n_chars"]

#: Documents with texts lost, blank or of white space only.
_HOLED = """(SELECT doc_id, lang, n_chars, source, CASE doc_id % 50 WHEN 0 THEN chr(9) || chr(10) WHEN 1 THEN '' WHEN 2 THEN ' ' WHEN 3 THEN NULL
  ELSE text END AS text FROM documents)"""


def holed(spark, sf_dir):
    rest = F.col("doc_id") % 50
    text = (F.when(rest == 0, "\t\n").when(rest == 1, "").when(rest == 2, " ").when(rest == 3, None).otherwise(F.col("text")))
    return table(spark, sf_dir, "documents").withColumn("text", text)


@query("profile", "\nUNION ALL\n".join(f"""
SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null,
  count(*) FILTER (WHERE regexp_full_match(CAST({c} AS VARCHAR), '[ \\t\\n\\r]*')) AS n_blank, count(DISTINCT {c}) AS n_distinct,
  (SELECT count(*) FROM (SELECT {c} FROM {_HOLED} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1)) AS n_repeated
FROM {_HOLED}""" for c in _PROFILED))
def profile(spark, sf_dir):
    return profiles.profile(holed(spark, sf_dir), columns=_PROFILED, exact=True)


@query("profile_estimated", "\nUNION ALL\n".join(f"""
SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null,
  count(*) FILTER (WHERE regexp_full_match(CAST({c} AS VARCHAR), '[ \\t\\n\\r]*')) AS n_blank, true AS near FROM {_HOLED}""" for c in _PROFILED))
def profile_estimated(spark, sf_dir):
    """Nulls and blanks are exact, the distinct values within four standard errors of the estimate."""
    docs = holed(spark, sf_dir)
    true = profiles.profile(docs, columns=_PROFILED, exact=True).select("column_name", F.col("n_distinct").alias("true"))
    found = profiles.profile(docs, columns=_PROFILED).join(F.broadcast(true), "column_name")
    near = F.abs(F.col("n_distinct") - F.col("true")) <= 0.2 * F.col("true")
    return found.select("column_name", "n_rows", "n_null", "n_blank", near.alias("near"))


@query("profile_merged", "\nUNION ALL\n".join(f"""
SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null,
  count(*) FILTER (WHERE regexp_full_match(CAST({c} AS VARCHAR), '[ \\t\\n\\r]*')) AS n_blank, true AS near, true AS half FROM {_HOLED}""" for c in _PROFILED))
def profile_merged(spark, sf_dir):
    """Sketches of two loads, stored one behind the other and merged: distinct values and the median within their errors."""
    docs = holed(spark, sf_dir)
    path = new_path(spark, "sketches")
    for load in (0, 1):
        rows = docs.where(F.col("doc_id") % 2 == load).withColumn("load", F.lit(load))
        append_table(profiles.sketch_profile(rows, by=["load"], columns=_PROFILED), path)
    merged = profiles.merged_profile(spark.read.parquet(path), quantiles=[0.5])
    true = profiles.profile(docs, columns=_PROFILED, exact=True).select("column_name", F.col("n_distinct").alias("true"))
    median = F.col("quantiles")[0]
    ranked = docs.select("n_chars").join(
        F.broadcast(merged.where("column_name = 'n_chars'").select(median.alias("m"))), F.lit(True)).agg(
        ((F.count_if(F.col("n_chars") < F.col("m")) <= 0.54 * F.count("n_chars"))
         & (F.count_if(F.col("n_chars") <= F.col("m")) >= 0.46 * F.count("n_chars"))).alias("half"))
    near = F.abs(F.col("n_distinct") - F.col("true")) <= 0.07 * F.col("true") + 1
    half = F.when(F.col("column_name") == "n_chars", F.col("half")).otherwise(F.col("quantiles").isNull())
    return (merged.join(F.broadcast(true), "column_name").join(F.broadcast(ranked), F.lit(True))
            .select("column_name", "n_rows", "n_null", "n_blank", near.alias("near"), half.alias("half")))


@query("parity", """
SELECT (SELECT count(*) FROM documents) AS left_rows, (SELECT count(*) FROM labels) AS right_rows,
  (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS only_left,
  (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS only_right,
  CAST(0 AS BIGINT) AS repeated_left,
  (SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY doc_id HAVING count(*) > 1)) AS repeated_right""")
def parity(spark, sf_dir):
    return joins.parity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), key="doc_id")
