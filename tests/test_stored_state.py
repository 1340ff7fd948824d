"""Components, profiles and sessions that grow load by load, against one run over everything."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from caselens import runtime
from caselens.operators import graph, joins, profile
from caselens.operators.components import ComponentStore
from caselens.runtime import new_path
from caselens.sources import tables
from caselens.streaming import streams


def as_dict(df):
    return {r.id: r.component for r in df.collect()}


def test_components_after_every_load(spark):
    rng = random.Random(5)
    loads = [[(rng.randrange(60), rng.randrange(60)) for _ in range(n)] for n in (12, 0, 14, 10)]
    loads[2] += [(7, 7), (None, 3), (59, 0)]
    store = ComponentStore(spark, new_path(spark, "store"))
    assert store.read().count() == 0
    seen = []
    for number, rows in enumerate(loads):
        seen += rows
        df = spark.createDataFrame(rows, "src bigint, dst bigint")
        store.append(df, load=number)
        assert as_dict(store.read()) == as_dict(graph.components(spark.createDataFrame(seen, "src bigint, dst bigint")))
    store.append(spark.createDataFrame(loads[-1], "src bigint, dst bigint"), load=len(loads) - 1)  # repeated
    assert as_dict(store.read()) == as_dict(graph.components(spark.createDataFrame(seen, "src bigint, dst bigint")))
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([(1, 2)], "src bigint, dst bigint"), load=0)


def test_a_load_that_died_is_not_seen(spark):
    path = new_path(spark, "store")
    store = ComponentStore(spark, path)
    store.append(spark.createDataFrame([(4, 5)], "src bigint, dst bigint"), load=0)
    spark.createDataFrame([(8, 8), (9, 8)], "id bigint, component bigint").write.parquet(f"{path}/members/load=1")
    assert as_dict(store.read()) == {4: 4, 5: 4}
    store.append(spark.createDataFrame([(3, 5), (9, 9)], "src bigint, dst bigint"), load=2)
    assert as_dict(store.read()) == {3: 3, 4: 3, 5: 3}


def test_few_links_in_one_task(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(str(rng.randrange(80)), str(rng.randrange(80))) for _ in range(60)], "src string, dst string")
    assert as_dict(graph.components(df)) == as_dict(graph.components(df, one_task=0))


def test_merged_profiles(spark):
    df = spark.range(20_000).select(
        (F.col("id") % 7).alias("load"), (F.col("id") % 3_000).alias("few"), F.col("id").alias("n"),
        F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 10 == 1, " ").otherwise(F.col("id").cast("string")).alias("t"),
        F.lit(None).cast("double").alias("none"))
    stored = profile.sketch_profile(df, by=["load"])
    assert stored.count() == 7 * 4
    merged = {r.column_name: r for r in profile.merged_profile(stored, quantiles=[0.1, 0.5]).collect()}
    once = {r.column_name: r for r in profile.merged_profile(profile.sketch_profile(df.drop("load"))).collect()}
    for name, true in {"few": 3_000, "n": 20_000, "t": 16_001, "none": 0}.items():
        assert abs(merged[name].n_distinct - true) <= 0.07 * true and abs(once[name].n_distinct - true) <= 0.07 * true
    assert (merged["t"].n_rows, merged["t"].n_null, merged["t"].n_blank) == (20_000, 2_000, 2_000)
    low, half = merged["n"].quantiles
    assert abs(low - 2_000) <= 600 and abs(half - 10_000) <= 600
    assert merged["t"].quantiles is None and merged["none"].quantiles is None and merged["none"].n_null == 20_000
    by_load = profile.merged_profile(stored, by=["load"]).where("column_name = 'n'").collect()
    assert len(by_load) == 7 and sum(r.n_rows for r in by_load) == 20_000
    assert profile.merged_profile(stored.limit(0)).count() == 0


def test_variants(spark):
    rows = [(1, '{"a": 1, "b": "x"}'), (2, '{"a": "2", "b": {"c": 1}}'), (3, '{"a": "two"}'), (4, "Theme: x"), (5, None), (6, "[1]"),
            (7, '{"a": null}')]
    df = tables.parse_variants(spark.createDataFrame(rows, "id int, r string"), reply="r")
    got = {r.id: r for r in tables.variant_fields(df, fields={"a": "int", "b": "string"}).drop("value").collect()}
    assert [got[i].a for i in range(1, 8)] == [1, 2, None, None, None, None, None]
    assert got[3].misfits == {"a": '"two"'} and got[1].misfits == {} == got[4].misfits and got[7].misfits == {}
    assert got[1].b == "x" and got[2].b == '{"c":1}'
    assert "a: " in tables.variant_schema(df.where("id < 4")) and "VARIANT" in tables.variant_schema(df.where("id < 4"))
    with pytest.raises(ValueError):
        tables.variant_fields(df, fields={'a"': "int"})


def test_sessions_of_a_stream_equal_those_of_the_table(spark):
    start, rng = datetime.datetime(2024, 1, 1), random.Random(8)
    rows = [(i, start + datetime.timedelta(minutes=rng.randrange(3_000)), rng.choice("abc")) for i in range(150)]
    rows += [(900, start + datetime.timedelta(days=30), "z"), (901, None, "a"), (902, start, None)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, t string")
    how = dict(text="t", time="ts", case_id="id", gap="30 minutes", lateness="3 days", columns=["t"])
    batch = {(r.t, r.id, r.n_copies) for r in streams.first_of_session(df, **how).collect() if r.t != "z"}
    path, out = new_path(spark, "landed"), new_path(spark, "out")
    df.where("id <> 900").repartition(4).write.parquet(path)
    df.where("id = 900").write.mode("append").parquet(path)  # comes last, and closes what is open
    found = streams.first_of_session(streams.read_stream(spark, path, schema=df.schema, max_files=1), **how)
    streams.drain(found, path=f"{out}/t", checkpoint=f"{out}/c")
    assert {(r.t, r.id, r.n_copies) for r in spark.read.parquet(f"{out}/t").collect()} == batch
    # By hand: a session ends where the next row of the text is half an hour away or more.
    want = set()
    for text in "abc":
        mine = sorted((ts, i) for i, ts, t in rows if t == text and ts)
        group = []
        for ts, i in mine + [(start + datetime.timedelta(days=99), None)]:
            if group and ts - group[-1][0] > datetime.timedelta(minutes=30):
                want.add((text, group[0][1], len(group)))
                group = []
            group.append((ts, i))
    assert batch == want


def test_series_range_reaches_the_scan(spark):
    path = new_path(spark, "series")
    spark.range(5).select(F.lit("a").alias("series"), F.timestamp_seconds(F.col("id") * 86_400).alias("ts"), F.col("id").alias("value")).write.parquet(path)
    found = tables.read_series(spark, path, start="1970-01-02", end="1970-01-03")
    assert sorted(r.value for r in found.collect()) == [1, 2]
    assert "GreaterThanOrEqual(ts" in found._jdf.queryExecution().toString() and "LessThan(ts" in found._jdf.queryExecution().toString()


def test_large_loads_need_no_rounds(spark, monkeypatch, tmp_path):
    """Loads above what one task joins are cut down by ranges: no round, and no lookup table of a round, is sent about."""
    monkeypatch.setattr(graph, "_large_star", lambda *_, **__: pytest.fail("a round of stars"))
    store = ComponentStore(spark, str(tmp_path / "store"))
    links = spark.range(140_000).select(F.col("id").alias("src"), (F.col("id") + 2).alias("dst"))
    for load in range(2):
        store.append(links.where(F.pmod(F.floor(F.col("src") / 2), F.lit(2)) == load), load=load)
    assert sorted(map(tuple, store.read().groupBy("component").count().collect())) == [(0, 70_001), (1, 70_001)]


def test_growing_sides_are_not_sent_through_the_driver(spark):
    """Spark holds both tables for small enough to be sent; the rows say otherwise, or the caller."""
    left, right = spark.range(100).withColumn("x", F.col("id")), spark.range(0, 100, 2)
    for n_facts in (None, 100):
        for joined in (left.join(runtime.broadcast_if_small(right, 10), "id"),
                       joins.salted_lookup(left, right, key="id", spread_by=["x"], n_facts=n_facts, grows=True)):
            assert joined.count() == 50
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "BroadcastHashJoin [id" not in plan.split("SortMergeJoin")[0]
    assert "BroadcastHashJoin" in left.join(runtime.broadcast_if_small(right, 100), "id")._jdf.queryExecution().executedPlan().toString()
