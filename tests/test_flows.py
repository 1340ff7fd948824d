import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselens.operators import retrieval, vectors
from caselens.plans import flows
from caselens.runtime import new_path

TEXTS = [
    "XXXX I saw human trafficking on XX/XX/2020 in XXXX", "identity theft and fraud", "identity theft and fraud",
    "debt under the FCRA", None, "a scam", "trafficking near me", "XXXX",
]


@pytest.fixture(scope="module")
def prepared(spark):
    rows = [(i, f"2024-0{i % 3 + 1}-05", "Card", "Fees" if i else "Other", t, "TX", ["75001", "501", None][i % 3], None)
            for i, t in enumerate(TEXTS)]
    raw = spark.createDataFrame(
        rows, "case_id bigint, date_received string, product string, issue string, narrative string, state string, "
        "zip_code string, tags string")
    return flows.prepare(raw, date_format="yyyy-MM-dd")


def model():
    def reply(prompt):
        text = prompt.split("1. ")[-1] if "1. " in prompt else prompt
        if "theft" in text:
            return "echo 1. nothing Tags: 1. Identity Theft, fraud\n2. other"
        if "Theme Label:" in prompt:
            return prompt + " **Bad experience here**. More"
        return "Tags:"
    return lambda prompts: [reply(p) for p in prompts]


def test_preparation(prepared):
    got = {r.case_id: r for r in prepared.collect()}
    assert sorted(got) == [0, 1, 3, 5, 6, 7]
    assert got[0].narrative == "I saw human trafficking on //2020 in"
    # Text that is a mask only survives the first cleaner, not the second.
    assert got[7].narrative == ""
    assert str(got[1].ts) == "2024-02-05 00:00:00"
    assert flows.select_cases(prepared, year=2024, product="Card", issue="Fees").count() == 5
    assert flows.select_cases(prepared, year=2023, product="Card", issue="Fees").count() == 0


def test_tags_themes_and_report(spark, prepared):
    tagged = flows.label_tags(prepared, path=new_path(spark, "tags"), factory=model)
    got = {r.case_id: r.tag_list for r in tagged.collect()}
    assert got[0] == ["trafficking"] and got[1] == ["Identity Theft", "fraud"]
    assert got[3] == ["FCRA", "FCRA violation", "debt collection"] and got[5] == ["scam"] and got[7] == []
    themed = flows.label_themes(prepared, path=new_path(spark, "themes"), factory=model)
    assert {r.case_id: r.theme for r in themed.collect()}[3] == "Bad experience here"

    places = spark.createDataFrame([("75001", "Addison", "TX"), ("00501", "Holtsville", "NY")], "zip string, city string, state_id string")
    report = flows.TopicReport.of(tagged, places, stem="traffick")
    assert [tuple(r) for r in report.top("city_state").collect()] == [("Addison, TX", 2)]
    assert [(str(r.month), r.n_tags, r.n_cases) for r in report.monthly().collect()] == [("2024-01-01", 2, 2)]
    assert report.city_by_month().first()["2024-01"] == 2 and report.month_by_city().first()["Addison, TX"] == 2
    assert report.words().first().word == "trafficking" and report.spikes().count() == 1
    facts = report.facts("trafficking")
    assert facts.first().content == "2024-01: Texas (TX) has 2 cases about trafficking."

    docs = retrieval.as_documents(facts, doc_id="month", content="content", source="x")
    encoder = vectors.fit_text_encoder(docs, text="content", dims=64)
    retrieval.store_documents(encoder, docs, path := new_path(spark, "facts"))
    question = spark.createDataFrame([(1, "Which state had complaints?")], "q int, t string")
    answer = retrieval.answer(
        encoder, question, spark.read.parquet(path), question_id="q", question="t",
        factory=lambda: (lambda prompts: ["Texas" if "Texas" in p else "?" for p in prompts]))
    assert answer.first().output == "Texas"


def test_clusters_and_indicators(spark):
    rng = np.random.default_rng(4)
    rows = [(i, f"case {i}", [float(x) for x in rng.normal(5.0 * (i % 2), 0.05, 6)], datetime.datetime(2024, 1 + i % 2, 3))
            for i in range(80)]
    embedded = spark.createDataFrame(rows, "case_id bigint, narrative string, embedding array<double>, ts timestamp")
    clustered = flows.cluster_cases(embedded, dims=2)
    assert flows.cluster_cases(embedded, cell=1.0, dims=2).where("cluster >= 0").count() > 70
    named = flows.name_case_clusters(clustered, factory=lambda: (lambda ps: ["Theme: Late fees" for _ in ps]))
    assert {r.label for r in named.collect()} <= {"Late fees", "Noise/Outlier"} and named.count() == 80
    assert named.where("cluster >= 0").select("cluster").distinct().count() == 2
    series = spark.createDataFrame([("cpi", datetime.datetime(2024, 1, 31), 3.0)], "series string, ts timestamp, value double")
    got = flows.trend_beside_indicators(clustered, series, ["cpi"]).select(F.date_format("month", "yyyy-MM"), "n", "cpi")
    assert [tuple(r) for r in got.collect()] == [("2024-01", 40, 3.0)]
