import os

import pytest
from pyspark.sql import functions as F

from caselens.functions.themes import accept_theme
from caselens.operators import infer, joins
from caselens.runtime import new_path
from caselens.sources.tables import read_results


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(i, f"text {i} of a case") for i in range(40)] + [(40, None), (41, "  \n"), (42, "")]
    return spark.createDataFrame(rows, "case_id bigint, narrative string").withColumn(
        "prompt", infer.render_prompt("Label this.", "narrative", "Label:"))


def ask(cases, factory, **options):
    options = {"max_attempts": 3, "batch_size": 4, **options}
    rows = infer.generate(cases, case_id="case_id", prompt="prompt", subject="narrative", factory=factory, **options).collect()
    assert sorted(r.case_id for r in rows) == list(range(43))
    return {r.case_id: r for r in rows}


def upper():
    return lambda prompts: [p.upper() for p in prompts]


def silent():
    return lambda prompts: ["" for _ in prompts]


def failing():
    def reply(prompts):
        if any("text 7 " in p or "text 13 " in p for p in prompts):
            raise RuntimeError("no")
        return ["Good theme" for _ in prompts]
    return reply


def third_time():
    seen = {}

    def reply(prompts):
        out = []
        for p in prompts:
            seen[p] = seen.get(p, 0) + 1
            out.append("Third reply" if seen[p] == 3 else "Note: no")
        return out
    return reply


def wrong_length():
    return lambda prompts: ["Good theme"] * (1 if len(prompts) == 1 else len(prompts) + 1)


def test_prompts(spark, cases):
    assert cases.where("case_id = 1").first().prompt == "Label this.\n\ntext 1 of a case\n\nLabel:"
    df = spark.createDataFrame([(["a ", "b"],)], "t array<string>")
    assert df.select(infer.render_numbered("Do.", "t", "Tags:")).first()[0] == "Do.\n\n1. a\n2. b\n\nTags:"


def test_every_case_once(cases):
    got = ask(cases, upper)
    assert {got[i].status for i in range(40)} == {"ok"} and {got[i].status for i in (40, 41, 42)} == {"blank"}
    assert got[3].output.startswith("LABEL THIS") and got[3].attempts == 1 and got[40].attempts == 0
    assert ask(cases, upper, concurrency=3)[5].status == "ok"


def test_a_bad_row_fails_alone(cases):
    got = ask(cases, failing)
    assert {i for i in got if got[i].status == "error"} == {7, 13}
    assert got[7].error == "RuntimeError: no" and got[7].output == "" and got[7].attempts == 3
    assert got[6].output == "Good theme"


def test_empty_and_repeated_replies(cases):
    assert {ask(cases, silent)[i].status for i in range(40)} == {"empty"}
    got = ask(cases, third_time, accept=accept_theme())
    assert {(got[i].output, got[i].attempts) for i in range(40)} == {("Third reply", 3)}
    got = ask(cases, third_time, accept=accept_theme(), max_attempts=2)
    assert {(got[i].output, got[i].status) for i in range(40)} == {("", "empty")}


def test_the_last_model_is_asked_at_the_end(cases):
    got = ask(cases, failing, last_factory=lambda: (lambda prompts: ["Last word" for _ in prompts]), max_attempts=2)
    assert (got[7].output, got[7].status, got[7].attempts) == ("Last word", "ok", 3)
    assert (got[6].output, got[6].attempts, got[41].status) == ("Good theme", 1, "blank")


def test_wrong_number_of_replies(cases):
    assert {ask(cases, wrong_length)[i].output for i in range(40)} == {"Good theme"}


def test_resume(spark, cases, tmp_path):
    path = new_path(spark, "resume")
    common = dict(case_id="case_id", prompt="prompt", subject="narrative", path=path, max_attempts=1)
    first = infer.generate_resumable(cases, factory=failing, slices=3, **common)
    assert {r.case_id for r in first.where("status = 'error'").collect()} == {7, 13}
    calls = str(tmp_path)

    def counting():
        def reply(prompts):
            for p in prompts:
                open(os.path.join(calls, p.split()[3]), "w").close()
            return ["Second run" for _ in prompts]
        return reply

    second = infer.generate_resumable(cases, factory=counting, **common)
    assert sorted(os.listdir(calls)) == ["13", "7"]
    rows = {r.case_id: r for r in second.collect()}
    assert len(rows) == second.count() == 43
    assert rows[7].output == "Second run" and rows[6].output == "Good theme"
    assert read_results(spark, path).count() == 45

    done = second.select("case_id", "status")
    assert joins.pending(cases, done, case_id="case_id").count() == 0
    assert joins.attach(cases, second, case_id="case_id").count() == 43


def test_no_results_yet(spark):
    assert read_results(spark, new_path(spark, "nothing")).count() == 0


def test_dead_endpoint_stops_the_run(spark):
    def dead():
        def call(prompts):
            raise OSError("no route")
        return call

    df = spark.range(500).select("id", F.lit("p").alias("p")).coalesce(1)
    with pytest.raises(Exception, match="calls in a row failed"):
        infer.generate(df, case_id="id", prompt="p", factory=dead, max_attempts=1).collect()
    rows = infer.generate(df.limit(20), case_id="id", prompt="p", factory=dead, max_attempts=1).collect()
    assert {r.status for r in rows} == {"error"} and len(rows) == 20
