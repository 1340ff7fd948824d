import datetime

import pytest
from pyspark.sql import functions as F

from caselens.functions import rules
from caselens.operators import geo, sampling, trends

CASES = [
    (1, "2024-01-05", ["human trafficking", "trafficking victim", "debt"], "139", "MA"),
    (2, "2024-01-20", ["trafficking victim"], "02139", "MA"),
    (3, "2024-04-01", ["sex trafficking"], "99999", None),
    (4, "2024-02-01", ["debt"], None, "TX"),
    (5, None, ["human trafficking"], "10001", "NY"),
    (6, "2024-05-01", None, "10001", "NY"),
]


@pytest.fixture(scope="module")
def cases(spark):
    df = spark.createDataFrame(CASES, "case_id bigint, d string, tags array<string>, zip_code string, state string")
    return df.withColumn("ts", F.to_timestamp("d"))


@pytest.fixture(scope="module")
def topic(cases):
    return trends.topic_rows(cases, tags="tags", stem="traffick")


def test_topic_rows(cases, topic):
    assert topic.count() == 5
    assert trends.topic_rows(cases, tags="tags", stem="^(human|sex)", regex=True).count() == 3
    assert trends.topic_filter(topic, text="tag", stem="TRAFFICK", ignore_case=True).count() == 5
    assert trends.topic_filter(topic, text="tag", stem="TRAFFICK").count() == 0


def test_series_with_empty_months(topic):
    got = {str(r.month): (r.n_tags, r.n_cases) for r in trends.monthly_series(topic, date="ts", case_id="case_id").collect()}
    assert got == {"2024-01-01": (3, 2), "2024-02-01": (0, 0), "2024-03-01": (0, 0), "2024-04-01": (1, 1)}


def test_series_by_key(topic):
    rows = trends.monthly_series(topic.na.fill("?", ["state"]), date="ts", case_id="case_id", by=["state"]).collect()
    assert {(r.state, str(r.month)): r.n_tags for r in rows} == {
        (s, f"2024-0{m}-01"): n for s, counts in {"MA": (3, 0, 0, 0), "?": (0, 0, 0, 1)}.items()
        for m, n in enumerate(counts, 1)}


def test_days_are_filled_too(spark):
    df = spark.createDataFrame([(datetime.date(2024, 2, 28), 1), (datetime.date(2024, 3, 1), 2)], "day date, n bigint")
    got = trends.zero_fill(df, month="day", values=["n"], step="day").collect()
    assert sorted((str(r.day), r.n) for r in got) == [("2024-02-28", 1), ("2024-02-29", 0), ("2024-03-01", 2)]
    one = trends.zero_fill(df.limit(0), month="day", values=["n"], step="day")
    assert one.count() == 0


def test_top_n_breaks_ties_by_key(topic):
    got = [tuple(r) for r in trends.top_n(topic, by=["tag"], n=2).collect()]
    assert got == [("human trafficking", 2), ("trafficking victim", 2)]
    assert trends.count_by(topic, by=["state"]).count() == 2


def test_pivot_keeps_the_total(topic):
    counts = trends.count_by(topic.na.fill("?", ["state"]), by=["state", "tag"])
    names = ["human trafficking", "trafficking victim", "sex trafficking"]
    for wide in (trends.pivot_counts(topic.na.fill("?", ["state"]), rows="state", columns="tag"),
                 trends.pivot_counts(counts, rows="state", columns="tag", values=names, value="n")):
        assert sum(r[n] for r in wide.collect() for n in names) == 5
        assert {r.state: r["sex trafficking"] for r in wide.collect()} == {"MA": 0, "?": 1, "NY": 0}


def test_places(spark, cases):
    dim = spark.createDataFrame(
        [("2139", "Cambridge", "MA"), ("2139", "Boston", "MA"), ("10001", "New York", "NY")],
        "zip string, city string, state_id string")
    for limit in (100, 1):
        got = geo.attach_place(cases, dim, zip_code="zip_code", case_id="case_id", max_broadcast=limit)
        assert got.count() == 6
        assert {r.case_id: r.city_state for r in got.collect()} == {
            1: None, 2: "Boston, MA", 3: None, 4: None, 5: "New York, NY", 6: "New York, NY"}


def test_restriction_to_the_top(spark, topic):
    kept = geo.restrict_to_top(topic, by=["tag"], n=1)
    assert {r.tag for r in kept.collect()} == {"human trafficking"} and kept.count() == 2
    counts = spark.createDataFrame([("a", 1, 5), ("a", 2, 1), ("b", 1, 4), ("c", 1, 4)], "k string, m int, n bigint")
    assert {r.k for r in geo.restrict_to_top(counts, by=["k"], n=2, value="n").collect()} == {"a", "b"}


def test_state_names(spark):
    df = spark.createDataFrame([("TX",), ("PR",), (None,)], "state_id string")
    assert {r.state_id: r.state_name for r in geo.attach_state_name(df).collect()} == {"TX": "Texas", "PR": None, None: None}


def test_shares(spark):
    df = spark.createDataFrame([("m", "a", 3), ("m", "b", 1), ("m", "c", 1)], "month string, k string, n bigint")
    got = {r.k: (r.share, r["rank"]) for r in trends.share_and_rank(df, part="month").collect()}
    assert got == {"a": (0.6, 1), "b": (0.2, 2), "c": (0.2, 2)}


def test_spikes(spark):
    values = [5, 5, 5, 4, 6, 30, 5]
    df = spark.createDataFrame(list(enumerate(values)), "t int, n bigint")
    rows = trends.spikes(df, time="t", window=3).orderBy("t").collect()
    assert [r.change for r in rows] == [None, 0, 0, -1, 2, 24, -25]
    assert [r.z_score is None for r in rows] == [True, True, True, True, False, False, False]
    assert [r.t for r in rows if r.is_spike] == [4, 5]


def test_word_weights(spark):
    df = spark.createDataFrame([("a b",), ("a",), (None,)], "t string")
    assert {r.word: (r.n, r.weight) for r in trends.word_freq(df, text="t").collect()} == {"a": (2, 1.0), "b": (1, 0.5)}


def test_indicators_meet_the_counts(spark):
    """Counts dated at the month's start meet weekly and month-end values."""
    series = spark.createDataFrame(
        [("cpi", "2024-01-31", 1.0), ("rate", "2024-01-04", 2.0), ("rate", "2024-01-11", 4.0), ("rate", "2024-02-01", 5.0)],
        "series string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    monthly = {(r.series, str(r.month)): r.value for r in trends.monthly_mean(series).collect()}
    assert monthly[("rate", "2024-01-01")] == 3.0
    wide = trends.align_series(series, ["cpi", "rate"])
    counts = spark.createDataFrame([(datetime.date(2024, 1, 1), 7), (datetime.date(2024, 3, 1), 1)], "month date, n bigint")
    got = trends.join_indicators(counts, wide).collect()
    assert [(str(r.month), r.n, r.cpi, r.rate) for r in got] == [("2024-01-01", 7, 1.0, 3.0)]
    assert {str(r.month): r.cpi for r in wide.collect()}["2024-02-01"] is None


def test_sentences(spark):
    df = spark.createDataFrame([("2024-07", "Virginia", "VA", 3, "trafficking")], "m string, s string, i string, n bigint, t string")
    row = trends.summary_sentences(df, template=rules.SUMMARY_TEMPLATE, columns=["m", "s", "i", "n", "t"], source="x").first()
    assert row.content == "2024-07: Virginia (VA) has 3 cases about trafficking."
    assert row.metadata == {"source": "x"}


def test_samples_are_bounded_and_repeatable(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, 1).when(F.col("id") < 903, 2).alias("g"))
    first = sampling.sample_per_group(df, by="g", case_id="id", n=5, seed="a")
    assert {(r.g, r["count"]) for r in first.groupBy("g").count().collect()} == {(1, 5), (2, 3)}
    again = sampling.sample_per_group(df.repartition(7), by="g", case_id="id", n=5, seed="a")
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect()))
    other = sampling.sample_per_group(df, by="g", case_id="id", n=5, seed="b")
    assert sorted(map(str, first.collect())) != sorted(map(str, other.collect()))
    assert [r.id for r in sampling.first_rows(df, case_id="id", n=3).collect()] == [0, 1, 2]
