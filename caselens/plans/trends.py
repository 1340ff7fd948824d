"""Trends of tags over time and places, and of counts beside indicators.

Tagged cases are line items: the words of the part's name are the tags, the
ship date is the date, the customer's nation gives postal code, city and state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.functions import rules
from caselens.functions.dates import month_label
from caselens.functions.places import zip5
from caselens.operators import geo, tags, trends
from caselens.operators.joins import map_values
from caselens.plans.registry import query, table

STEM = "widget"
MONTHS = [f"{y}-{m:02d}" for y in range(1995, 2002) for m in range(1, 13)]

_TAGGED = f"""
topic AS (
  SELECT l_orderkey AS case_id, l_shipdate AS ts, tag
  FROM lineitem JOIN part ON l_partkey = p_partkey, unnest(string_split(p_name, ' ')) u(tag)
  WHERE tag LIKE '%{STEM}%')"""
_PLACED = _TAGGED + """,
placed AS (
  SELECT topic.*, lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS zip5, n_name AS city, r_name AS state_id,
    n_name || ', ' || r_name AS city_state, strftime(ts, '%Y-%m') AS month
  FROM topic JOIN orders ON case_id = o_orderkey JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    parts = tags.split_tags(
        table(spark, sf_dir, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit(", ")).alias("tags")),
        tags="tags")
    return (items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .select(F.col("l_orderkey").alias("case_id"), F.col("l_shipdate").alias("ts"), "tag_list"))


def on_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.topic_rows(tagged(spark, sf_dir), tags="tag_list", stem=STEM).drop("tag_list")


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic rows with their place. The topic filter runs before the joins."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), "o_custkey")
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("string").alias("zip_code"))
    places = (table(spark, sf_dir, "nation")
              .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
              .select(F.col("n_nationkey").cast("string").alias("zip"), F.col("n_name").alias("city"),
                      F.col("r_name").alias("state_id")))
    cases = on_topic(spark, sf_dir).join(orders, "case_id").join(customers, "o_custkey")
    return geo.attach_place(cases, places, zip_code="zip_code", case_id="case_id")


def placed_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir).withColumn("month", month_label("ts"))


@query("topic_monthly", f"""
WITH {_TAGGED}, counts AS (
  SELECT date_trunc('month', ts) AS m, count(*) AS n_tags, count(DISTINCT case_id) AS n_cases FROM topic GROUP BY 1),
calendar AS (SELECT unnest(generate_series((SELECT min(m) FROM counts), (SELECT max(m) FROM counts), INTERVAL 1 MONTH)) AS m)
SELECT strftime(calendar.m, '%Y-%m') AS month, coalesce(n_tags, 0) AS n_tags, coalesce(n_cases, 0) AS n_cases
FROM calendar LEFT JOIN counts ON calendar.m = counts.m""")
def topic_monthly(spark, sf_dir):
    series = trends.monthly_series(on_topic(spark, sf_dir), date="ts", case_id="case_id")
    return series.withColumn("month", month_label("month"))


@query("topic_monthly_by_state", f"""
WITH {_PLACED}, counts AS (
  SELECT state_id, month, count(*) AS n_tags, count(DISTINCT case_id) AS n_cases FROM placed GROUP BY 1, 2),
bounds AS (SELECT min(date_trunc('month', ts)) AS a, max(date_trunc('month', ts)) AS b FROM topic),
months AS (SELECT strftime(unnest(generate_series(a, b, INTERVAL 1 MONTH)), '%Y-%m') AS month FROM bounds)
SELECT s.state_id, m.month, coalesce(n_tags, 0) AS n_tags, coalesce(n_cases, 0) AS n_cases
FROM (SELECT DISTINCT state_id FROM counts) s CROSS JOIN months m
LEFT JOIN counts c ON c.state_id = s.state_id AND c.month = m.month""")
def topic_monthly_by_state(spark, sf_dir):
    series = trends.monthly_series(placed(spark, sf_dir), date="ts", case_id="case_id", by=["state_id"])
    return series.withColumn("month", month_label("month"))


@query("split_tags", """
SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: lower(x)), '|') AS tag_list FROM part""")
def split_tags(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    # Half as plain text, half as a list that was saved as text.
    words = F.split("p_name", " ")
    plain = F.array_join(F.transform(words, F.upper), " , ")
    saved = F.concat(F.lit("['"), F.array_join(words, "', '"), F.lit("', '']"))
    text = parts.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, plain).otherwise(saved).alias("tags"))
    return (tags.split_tags(text, tags="tags")
            .select("p_partkey", F.array_join("tag_list", "|").alias("tag_list")))


def _top(column: str) -> str:
    return f"""
WITH {_PLACED}
SELECT {column}, count(*) AS n FROM placed WHERE {column} IS NOT NULL
GROUP BY {column} ORDER BY n DESC, {column} LIMIT 20"""


@query("top_tags", f"""
WITH {_TAGGED} SELECT tag, count(*) AS n FROM topic GROUP BY tag ORDER BY n DESC, tag LIMIT 20""")
def top_tags(spark, sf_dir):
    return trends.top_n(on_topic(spark, sf_dir), by=["tag"])


@query("top_states", _top("state_id"))
def top_states(spark, sf_dir):
    return trends.top_n(placed(spark, sf_dir), by=["state_id"])


@query("top_zips", _top("zip5"))
def top_zips(spark, sf_dir):
    return trends.top_n(placed(spark, sf_dir), by=["zip5"])


@query("top_cities", _top("city"))
def top_cities(spark, sf_dir):
    return trends.top_n(placed(spark, sf_dir), by=["city"])


@query("top_city_states", _top("city_state"))
def top_city_states(spark, sf_dir):
    return trends.top_n(placed(spark, sf_dir), by=["city_state"])


_TOP_PLACED = _PLACED + """,
best AS (SELECT city_state FROM placed GROUP BY 1 ORDER BY count(*) DESC, city_state LIMIT 20),
kept AS (SELECT * FROM placed WHERE city_state IN (SELECT city_state FROM best))"""


def top_placed(spark, sf_dir):
    """Counts per month and place, for the top places."""
    counts = trends.count_by(placed_months(spark, sf_dir), by=["month", "city_state", "state_id"])
    return geo.restrict_to_top(counts, by=["city_state"], n=20, value="n")


@query("month_city_counts", f"""
WITH {_TOP_PLACED} SELECT month, city_state, count(*) AS n FROM kept GROUP BY month, city_state""")
def month_city_counts(spark, sf_dir):
    return top_placed(spark, sf_dir).drop("state_id")


@query("top_city_rows", f"""
WITH {_TOP_PLACED} SELECT city_state, count(*) AS n, count(DISTINCT case_id) AS n_cases FROM kept GROUP BY city_state""")
def top_city_rows(spark, sf_dir):
    rows = geo.restrict_to_top(placed(spark, sf_dir), by=["city_state"], n=20)
    per_case = rows.groupBy("city_state", "case_id").agg(F.count("*").alias("n"))
    return per_case.groupBy("city_state").agg(F.sum("n").alias("n"), F.count("*").alias("n_cases"))


@query("geo_month_pivot", f"""
WITH {_TOP_PLACED}
SELECT city_state, {', '.join(f"count(*) FILTER (WHERE month = '{m}') AS " + '"' + m + '"' for m in MONTHS)}
FROM kept GROUP BY city_state""")
def geo_month_pivot(spark, sf_dir):
    return trends.pivot_counts(
        top_placed(spark, sf_dir), rows="city_state", columns="month", values=MONTHS, value="n")


_STATES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("month_geo_pivot", f"""
WITH {_TOP_PLACED}
SELECT month, {', '.join(f"count(*) FILTER (WHERE state_id = '{s}') AS " + '"' + s + '"' for s in _STATES)}
FROM kept GROUP BY month""")
def month_geo_pivot(spark, sf_dir):
    return trends.pivot_counts(
        top_placed(spark, sf_dir), rows="month", columns="state_id", values=_STATES, value="n")


@query("geo_month_share", f"""
WITH {_TOP_PLACED}, c AS (SELECT month, city_state, count(*) AS n FROM kept GROUP BY 1, 2)
SELECT month, city_state, n, round(n / sum(n) OVER (PARTITION BY month), 6) AS share,
  CAST(dense_rank() OVER (PARTITION BY month ORDER BY n DESC) AS INTEGER) AS rank
FROM c""")
def geo_month_share(spark, sf_dir):
    shares = trends.share_and_rank(top_placed(spark, sf_dir).drop("state_id"), part="month")
    return shares.withColumn("share", F.round("share", 6))


@query("top_state_per_month", f"""
WITH {_PLACED}, c AS (SELECT month, state_id, count(*) AS n FROM placed GROUP BY 1, 2),
r AS (SELECT *, dense_rank() OVER (PARTITION BY month ORDER BY n DESC) AS r FROM c)
SELECT month, state_id, n FROM r WHERE r = 1""")
def top_state_per_month(spark, sf_dir):
    """Which state leads a month: the part of a question that needs no model."""
    counts = trends.count_by(placed_months(spark, sf_dir), by=["month", "state_id"])
    return trends.share_and_rank(counts, part="month").where("rank = 1").select("month", "state_id", "n")


_CODES = list(rules.STATE_NAMES)[:20] + ["PR", "GU", "VI", "AS", "MP"]


@query("month_state_names", f"""
WITH {_TAGGED}, codes(k, state_id) AS (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(_CODES))}),
names(state_id, state_name) AS (VALUES {', '.join(f"('{c}', '{n}')" for c, n in rules.STATE_NAMES.items())}),
m AS (
  SELECT strftime(ts, '%Y-%m') AS month, state_id, count(*) AS n
  FROM topic JOIN orders ON case_id = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN codes ON c_nationkey = k
  GROUP BY 1, 2)
SELECT m.*, state_name FROM m LEFT JOIN names USING (state_id)""")
def month_state_names(spark, sf_dir):
    return geo.attach_state_name(_month_states(spark, sf_dir)).select("month", "state_id", "n", "state_name")


def _month_states(spark, sf_dir):
    coded = map_values(
        placed_months(spark, sf_dir), {f"{i:05d}": c for i, c in enumerate(_CODES)}, key="zip5", output="code")
    on = trends.topic_filter(coded, text="tag", stem=STEM.upper(), ignore_case=True)
    return trends.count_by(on, by=["month", "code"]).withColumnRenamed("code", "state_id")


@query("summary_sentences", f"""
WITH {_TAGGED}, codes(k, state_id) AS (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(_CODES))}),
names(state_id, state_name) AS (VALUES {', '.join(f"('{c}', '{n}')" for c, n in rules.STATE_NAMES.items())}),
m AS (
  SELECT strftime(ts, '%Y-%m') AS month, state_id, count(*) AS n
  FROM topic JOIN orders ON case_id = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN codes ON c_nationkey = k
  GROUP BY 1, 2)
SELECT month, state_id, printf('%s: %s (%s) has %d cases about {STEM}.',
    month, state_name, state_id, n) AS content, 'complaint_summary' AS source
FROM m JOIN names USING (state_id)""")
def summary_sentences(spark, sf_dir):
    return month_state_docs(spark, sf_dir)


def month_state_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sentence per month and state."""
    named = geo.attach_state_name(_month_states(spark, sf_dir)).na.drop(subset=["state_name"])
    docs = trends.summary_sentences(
        named.withColumn("topic", F.lit(STEM)), template=rules.SUMMARY_TEMPLATE,
        columns=["month", "state_name", "state_id", "n", "topic"], source=rules.SUMMARY_SOURCE)
    return docs.select("month", "state_id", "content", F.col("metadata")["source"].alias("source"))


@query("topic_word_freq", f"""
WITH {_TAGGED},
w AS (SELECT tag AS word FROM topic),
c AS (SELECT word, count(*) AS n FROM w GROUP BY word)
SELECT word, n, round(n / (SELECT max(n) FROM c), 6) AS weight FROM c""")
def topic_word_freq(spark, sf_dir):
    return trends.word_freq(on_topic(spark, sf_dir), text="tag").withColumn("weight", F.round("weight", 6))


@query("year_counts", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1""")
def year_counts(spark, sf_dir):
    return trends.count_by(trends.with_year(table(spark, sf_dir, "orders"), date="o_orderdate"), by=["year"]).orderBy("year")


@query("month_counts", """
SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1""")
def month_counts(spark, sf_dir):
    counts = trends.count_by(trends.with_month(table(spark, sf_dir, "orders"), date="o_orderdate"), by=["month"])
    return counts.withColumn("month", month_label("month"))


@query("zip_normalize", """
SELECT c_custkey, CASE WHEN length(CAST(c_custkey * 37 AS VARCHAR)) < 5 THEN lpad(CAST(c_custkey * 37 AS VARCHAR), 5, '0')
  ELSE CAST(c_custkey * 37 AS VARCHAR) END AS zip5 FROM customer""")
def zip_normalize(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", zip5(F.col("c_custkey") * 37).alias("zip5"))


@query("spikes", """
WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2),
s AS (
  SELECT *, n - lag(n) OVER w AS change, count(n) OVER t AS k, avg(n) OVER t AS m, stddev_samp(n) OVER t AS sd
  FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day),
    t AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, CASE WHEN k = 7 AND sd > 0 THEN (n - m) / sd END AS z_score FROM s)
SELECT event_type, strftime(day, '%Y-%m-%d') AS day, n, CAST(change AS DOUBLE) AS change, round(z_score, 6) AS z_score,
  CAST(coalesce(z_score > 2, FALSE) AS INTEGER) AS is_spike FROM z""")
def spikes(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    daily = trends.zero_fill(
        trends.count_by(events, by=["event_type", "day"]), month="day", values=["n"], by=["event_type"], step="day")
    return trends.spikes(daily, time="day", by=["event_type"]).select(
        "event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", F.col("change").cast("double").alias("change"),
        F.round("z_score", 6).alias("z_score"), F.col("is_spike").cast("int").alias("is_spike"))


_SERIES = ["quantity", "discount", "price"]
_SERIES_SQL = """
series AS (
  SELECT 'quantity' AS series, l_shipdate AS ts, l_quantity AS value FROM lineitem
  UNION ALL SELECT 'discount', l_shipdate, l_discount FROM lineitem
  UNION ALL SELECT 'price', o_orderdate, o_totalprice FROM orders WHERE year(o_orderdate) <> 1998)"""


def indicator_series(spark, sf_dir):
    """Three series in long form; one of them has a year without values."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))
    long = items.unpivot("ts", ["quantity", "discount"], "series", "value").select("series", "ts", "value")
    orders = table(spark, sf_dir, "orders").where(F.year("o_orderdate") != 1998)
    return long.unionByName(orders.select(
        F.lit("price").alias("series"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value")))


@query("series_monthly", f"""
WITH {_SERIES_SQL}
SELECT series, strftime(ts, '%Y-%m') AS month, round(avg(value), 4) AS value FROM series GROUP BY 1, 2""")
def series_monthly(spark, sf_dir):
    return trends.monthly_mean(indicator_series(spark, sf_dir)).select(
        "series", month_label("month").alias("month"), F.round("value", 4).alias("value"))


@query("series_aligned", f"""
WITH {_SERIES_SQL}
SELECT strftime(ts, '%Y-%m') AS month,
  {', '.join(f"round(avg(value) FILTER (WHERE series = '{s}'), 4) AS {s}" for s in _SERIES)}
FROM series GROUP BY 1""")
def series_aligned(spark, sf_dir):
    wide = trends.align_series(indicator_series(spark, sf_dir), _SERIES)
    return wide.select(month_label("month").alias("month"), *[F.round(s, 4).alias(s) for s in _SERIES])


@query("macro_join", f"""
WITH {_SERIES_SQL}, wide AS (
  SELECT date_trunc('month', ts) AS m,
    {', '.join(f"round(avg(value) FILTER (WHERE series = '{s}'), 4) AS {s}" for s in _SERIES)}
  FROM series GROUP BY 1),
counts AS (SELECT date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1)
SELECT strftime(m, '%Y-%m') AS month, n, {', '.join(_SERIES)} FROM counts JOIN wide USING (m)""")
def macro_join(spark, sf_dir):
    counts = trends.count_by(trends.with_month(table(spark, sf_dir, "orders"), date="o_orderdate"), by=["month"])
    joined = trends.join_indicators(counts, trends.align_series(indicator_series(spark, sf_dir), _SERIES))
    return joined.select(month_label("month").alias("month"), "n", *[F.round(s, 4).alias(s) for s in _SERIES])


