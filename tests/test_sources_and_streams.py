import datetime

import pytest

from pyspark.sql import functions as F

from caselens.operators import dedup, infer, vectors
from caselens.runtime import materialize, new_path, shared_dir, small_enough, spread
from caselens.sources import tables
from caselens.streaming import streams
from pyspark.ml.clustering import KMeansModel


def test_delimited_cases(spark, tmp_path):
    path = tmp_path / "cases.csv"
    path.write_text(
        "case_id,date_received,product,issue,narrative,state,zip_code,tags\n"
        '1,2024-01-02,Card,Fees,"He said ""no"",\nthen left",NA,02139,"a, b"\n'
        "2,2024-01-03,Card,N/A,,TX,,none\n")
    rows = tables.read_cases(spark, str(path)).orderBy("case_id").collect()
    assert rows[0].narrative == 'He said "no",\nthen left' and rows[0].zip_code == "02139" and rows[0].state is None
    assert rows[1].issue is None and rows[1].narrative is None and rows[1].zip_code is None and rows[1].tags == "none"


def test_csv_keeps_texts(spark):
    df = spark.createDataFrame([(1, 'a "b", c\nd'), (2, None), (3, 'x\\"y')], "id int, t string")
    path = new_path(spark, "csv")
    tables.write_table(df, path, fmt="csv")
    assert sorted(tables.read_cases(spark, path, schema=df.schema).collect()) == sorted(df.collect())


def test_lookup_series_and_texts(spark, tmp_path):
    (tmp_path / "zips.csv").write_text("zip,city,state_id\n00501,Holtsville,NY\n")
    assert tables.read_places(spark, str(tmp_path / "zips.csv")).first().zip == "00501"
    (tmp_path / "law.txt").write_text("line one\nline two")
    text = tables.read_text_files(spark, str(tmp_path / "law.txt")).first()
    assert text.content == "line one\nline two" and text.source.endswith("law.txt")
    series = spark.createDataFrame(
        [("a", datetime.datetime(2024, 1, 31, 23), 1.0), ("a", datetime.datetime(2024, 2, 1), 2.0)], "series string, ts timestamp, value double")
    path = new_path(spark, "series")
    tables.write_table(series, path, partition_by=["series"])
    assert tables.read_series(spark, path, start="2024-01-01", end="2024-01-31").count() == 1


def test_json_replies(spark):
    df = spark.createDataFrame([('{"theme": "Fees", "tags": ["a"]}',), ("Theme: x",)], "r string")
    rows = tables.parse_replies(df, reply="r", schema="theme string, tags array<string>").collect()
    assert rows[0].parsed.theme == "Fees" and rows[0].parsed.tags == ["a"] and rows[1].parsed.theme is None


def test_saved_model(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    df = spark.createDataFrame([([0.0],), ([1.0],)], "v array<double>").select(array_to_vector("v").alias("features"))
    path = new_path(spark, "model")
    for _ in range(2):
        tables.save_model(KMeans(k=2, seed=1).fit(df), path)
    assert len(KMeansModel.load(path).clusterCenters()) == 2 and vectors


def test_runtime(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert materialize(spark.range(5)).count() == 5
    assert small_enough(spark.range(5), 5) and not small_enough(spark.range(6), 5)
    assert spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 100, 1, 50)).rdd.getNumPartitions() == 50


def landed(spark, df, files):
    path = new_path(spark, "landed")
    df.repartition(files).write.parquet(path)
    return path


def test_stream_dedup_equals_batch(spark):
    texts = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), (F.col("id") % 50).cast("string")))
    df = spark.range(500).select("id", F.when(F.col("id") != 7, texts).alias("t"))
    path = landed(spark, df, 6)
    out = new_path(spark, "out")
    unique = streams.stream_dedup(streams.read_stream(spark, path, schema=df.schema, max_files=2), text="t", case_id="id", columns=["t"])
    streams.drain_totals(unique, path=f"{out}/t", checkpoint=f"{out}/c")
    got = spark.read.parquet(f"{out}/t")
    batch = dedup.dedup_exact(df, text="t", case_id="id")
    assert sorted((r.id, r.t) for r in got.collect()) == sorted((r.id, r.t) for r in batch.collect())


def test_stream_dedup_with_watermark(spark):
    start = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, start + datetime.timedelta(minutes=i), "same") for i in range(20)], "id int, ts timestamp, t string")
    path, out = landed(spark, df, 2), new_path(spark, "out")
    unique = streams.stream_dedup_within(streams.read_stream(spark, path, schema=df.schema), text="t", time="ts", within="1 hour")
    streams.drain(unique, path=f"{out}/t", checkpoint=f"{out}/c")
    assert spark.read.parquet(f"{out}/t").count() == 1


def test_stream_generate_equals_batch(spark):
    df = spark.range(60).select("id", F.when(F.col("id") == 3, None).otherwise(F.concat(F.lit("case "), F.col("id").cast("string"))).alias("p"))

    def factory():
        return lambda prompts: [p[::-1] for p in prompts]

    path, out = landed(spark, df, 5), new_path(spark, "out")
    for _ in range(2):  # the second run finds nothing new
        streams.stream_generate(
            streams.read_stream(spark, path, schema=df.schema, max_files=1), path=f"{out}/t", checkpoint=f"{out}/c",
            case_id="id", prompt="p", factory=factory).awaitTermination()
    got = spark.read.parquet(f"{out}/t").select("id", "output", "status")
    batch = infer.generate(df, case_id="id", prompt="p", factory=factory).select("id", "output", "status")
    assert sorted(got.collect()) == sorted(batch.collect())


def test_stream_counts(spark):
    start = datetime.datetime(2024, 1, 30, 12)
    rows = [(i, start + datetime.timedelta(hours=6 * i), "ab"[i % 2]) for i in range(24)]
    df = spark.createDataFrame(rows, "id bigint, ts timestamp, tag string")
    path, out = landed(spark, df, 3), new_path(spark, "out")
    months = streams.stream_topic_counts(
        streams.read_stream(spark, path, schema=df.schema, max_files=1), tag="tag", time="ts", case_id="id")
    streams.drain_totals(months, path=f"{out}/t", checkpoint=f"{out}/c")
    want = df.groupBy(F.trunc("ts", "MM").alias("month"), "tag").count()
    got = spark.read.parquet(f"{out}/t").select("month", "tag", "n_tags")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    windows = streams.stream_topic_counts(
        streams.read_stream(spark, path, schema=df.schema), tag="tag", time="ts", case_id="id",
        window="2 days", slide="1 day", lateness="1 hour")
    streams.drain(windows, path=f"{out}/w", checkpoint=f"{out}/d")
    spans = spark.read.parquet(f"{out}/w")
    assert {r.n_tags for r in spans.collect()} <= {1, 2, 3, 4} and spans.count() > 4


def test_malformed_rows_are_seen(spark, tmp_path):
    path = str(tmp_path / "cases.csv")
    with open(path, "w") as f:
        f.write('case_id,narrative\n1,"a, b"\nabc,text\n3\n4,"two\nlines"\n')
    schema = "case_id bigint, narrative string"
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_cases(spark, path, schema=schema).collect()
    kept = {r.narrative: (r.case_id, r._malformed) for r in tables.read_cases(spark, path, schema=schema, malformed="keep").collect()}
    assert kept["a, b"] == (1, None) and kept["two\nlines"] == (4, None)
    assert sum(bad is not None for _, bad in kept.values()) == 2
    with pytest.raises(Exception):
        tables.store_cases(spark, path, str(tmp_path / "out"), schema=schema)
    with open(path, "w") as f:
        f.write("case_id,narrative\n1,x\n1,y\n")
    with pytest.raises(ValueError, match="repeat"):
        tables.store_cases(spark, path, str(tmp_path / "out"), schema=schema)


def test_model_is_saved_and_loaded(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b c"), (2, "c d")], "id bigint, t string")
    model = vectors.fit_text_encoder(df, text="t", dims=32)
    tables.save_model(model, str(tmp_path / "model"))
    again = tables.load_model(str(tmp_path / "model"))
    want, got = ([r.embedding for r in vectors.encode_text(m, df, text="t").orderBy("id").collect()] for m in (model, again))
    assert want == got
