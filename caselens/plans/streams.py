"""Streams over the test tables, drained to the end and compared with the batch result."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from caselens.functions.dates import month_label
from caselens.operators import tags
from caselens.plans.labelling import _ASKED, INSTRUCTION, first_words_model
from caselens.operators.infer import render_prompt
from caselens.plans.registry import query, table
from caselens.runtime import new_path
from caselens.sources import tables
from caselens.streaming import streams


def arriving(spark: SparkSession, sf_dir: str, name: str):
    schema = table(spark, sf_dir, name).schema
    # The pattern matches a single file as well as a folder of files.
    return streams.read_stream(spark, f"{sf_dir}/{name}.parque[t]", schema=schema)


@query("stream_dedup", "SELECT min(doc_id) AS doc_id, sha256(text) AS digest, length(text) AS n FROM documents GROUP BY text")
def stream_dedup(spark, sf_dir):
    path = new_path(spark, "stream")
    docs = arriving(spark, sf_dir, "documents").withColumn("n", F.length("text").cast("bigint"))
    unique = streams.stream_dedup(docs, text="text", case_id="doc_id", columns=["n"])
    kept = unique.select("doc_id", F.lower(F.hex("digest")).alias("digest"), "n")
    streams.drain_totals(kept, path=f"{path}/out", checkpoint=f"{path}/state")
    return spark.read.schema(kept.schema).parquet(f"{path}/out")


@query("stream_topic_months", """
SELECT strftime(l_shipdate, '%Y-%m') AS month, tag, count(*) AS n_tags
FROM lineitem JOIN part ON l_partkey = p_partkey, unnest(string_split(p_name, ' ')) u(tag)
WHERE l_shipdate IS NOT NULL GROUP BY 1, 2""")
def stream_topic_months(spark, sf_dir):
    path = new_path(spark, "stream")
    parts = tags.split_tags(table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.replace("p_name", F.lit(" "), F.lit(",")).alias("tags")), tags="tags")
    items = arriving(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate").join(parts, "l_partkey")
    counts = streams.stream_topic_counts(
        items.withColumn("tag", F.explode("tag_list")), tag="tag", time="l_shipdate", case_id="l_orderkey")
    streams.drain_totals(counts, path=f"{path}/out", checkpoint=f"{path}/state")
    return spark.read.schema(counts.schema).parquet(f"{path}/out").select(
        month_label("month").alias("month"), "tag", "n_tags")


@query("stream_daily_windows", """
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, event_type, count(*) AS n_tags FROM events
WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY
GROUP BY 1, 2""")
def stream_daily_windows(spark, sf_dir):
    """Days that closed behind the watermark; the last days are still open."""
    path = new_path(spark, "stream")
    events = arriving(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    windows = streams.stream_topic_counts(
        events, tag="event_type", time="ts", case_id="event_id", window="1 day", lateness="1 day")
    streams.drain(windows, path=f"{path}/out", checkpoint=f"{path}/state")
    return spark.read.schema(windows.schema).parquet(f"{path}/out").select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n_tags")


@query("stream_generate", f"""
WITH {_ASKED}
SELECT doc_id, CASE WHEN status = 'ok' THEN words ELSE '' END AS output, status FROM answered""")
def stream_generate(spark, sf_dir):
    path = new_path(spark, "stream")
    key = F.col("doc_id")
    text = (F.when(key % 40 == 0, "  \n ").when(key % 30 == 7, F.concat(F.lit("FAILING "), "text"))
            .when(key % 30 == 8, F.concat(F.lit("MUTE "), "text")).otherwise(F.col("text")))
    cases = arriving(spark, sf_dir, "documents").select("doc_id", text.alias("narrative")).withColumn(
        "prompt", render_prompt(INSTRUCTION, "narrative", "Theme Label:"))
    streams.stream_generate(
        cases, path=f"{path}/out", checkpoint=f"{path}/state", case_id="doc_id", prompt="prompt",
        subject="narrative", factory=first_words_model(fail_on="FAILING", blank_on="MUTE"),
        max_attempts=1).awaitTermination()
    return tables.read_results(
        spark, f"{path}/out", schema="doc_id bigint, output string, status string").select("doc_id", "output", "status")


@query("csv_round_trip", "SELECT doc_id, lang, text, n_chars FROM documents")
def csv_round_trip(spark, sf_dir):
    """Texts with quotes, commas and newlines through a delimited file."""
    path = new_path(spark, "csv")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", "n_chars")
    tables.write_table(docs, path, fmt="csv")
    return tables.read_cases(spark, path, schema=docs.schema)


@query("append_round_trip", """
SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_ids FROM events GROUP BY 1""")
def append_round_trip(spark, sf_dir):
    """One half replaces what was there, the other one is appended."""
    path = new_path(spark, "appended")
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    tables.write_table(events, path)
    tables.write_table(events.where("event_id % 2 = 0"), path)
    tables.append_table(events.where("event_id % 2 = 1"), path)
    return spark.read.parquet(path).groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_distinct("event_id").alias("n_ids"))


@query("series_scan", """
SELECT event_type AS series, count(*) AS n, round(avg(value), 6) AS value FROM events
WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1""")
def series_scan(spark, sf_dir):
    path = new_path(spark, "series")
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), "ts", "value")
    tables.write_table(events, path)
    found = tables.read_series(spark, path, start="2024-01-05", end="2024-01-20")
    return found.groupBy("series").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("value"))


@query("places_file", """
SELECT lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS zip, concat('Port "', c_name, '", ', c_custkey) AS city,
  CASE WHEN c_nationkey > 0 THEN CAST(c_nationkey AS VARCHAR) END AS state_id FROM customer""")
def places_file(spark, sf_dir):
    """A file of places: codes keep their leading zeros, names their quotes and commas, missing states are null."""
    path = new_path(spark, "places")
    state = F.when(F.col("c_nationkey") > 0, F.col("c_nationkey").cast("string")).otherwise("N/A")
    places = table(spark, sf_dir, "customer").select(
        F.lpad(F.col("c_custkey").cast("string"), 5, "0").alias("zip"),
        F.concat(F.lit('Port "'), "c_name", F.lit('", '), "c_custkey").alias("city"), state.alias("state_id"))
    tables.write_table(places, path, fmt="csv")
    return tables.read_places(spark, path)


@query("whole_texts", """
SELECT source, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars,
  CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS n_lines FROM documents GROUP BY source""")
def whole_texts(spark, sf_dir):
    """All texts in a few files per source, each read as one document."""
    path = new_path(spark, "texts")
    table(spark, sf_dir, "documents").select("source", F.col("text").alias("value")).write.partitionBy("source").text(path)
    files = tables.read_text_files(spark, path).select(
        F.regexp_extract("source", "source=([^/]+)", 1).alias("source"), F.length("content").alias("chars"),
        (F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))).alias("lines"))
    return files.groupBy("source").agg(F.sum("chars").alias("n_chars"), F.sum("lines").alias("n_lines"))


@query("stream_first_of_session", """
WITH e AS (SELECT event_id, ts, concat(user_id, ' ', event_type) AS t FROM events),
g AS (SELECT *, coalesce(ts - lag(ts) OVER w <= INTERVAL 6 HOUR, false) AS again FROM e WINDOW w AS (PARTITION BY t ORDER BY ts, event_id)),
s AS (SELECT *, count(*) FILTER (WHERE NOT again) OVER (PARTITION BY t ORDER BY ts, event_id) AS no FROM g)
SELECT t, min(event_id) FILTER (WHERE NOT again) AS event_id, count(*) AS n_copies FROM s GROUP BY t, no
HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def stream_first_of_session(spark, sf_dir):
    """The first of the events of a user and type that follow each other within six hours; the last sessions are still open."""
    path = new_path(spark, "stream")
    events = arriving(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat_ws(" ", "user_id", "event_type").alias("t"))
    firsts = streams.first_of_session(events, text="t", time="ts", case_id="event_id", gap="6 hours", columns=["t"])
    streams.drain(firsts, path=f"{path}/out", checkpoint=f"{path}/state")
    return spark.read.schema(firsts.schema).parquet(f"{path}/out").select("t", "event_id", "n_copies")
