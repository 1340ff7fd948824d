"""Short codes against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselens.operators import codes, vectors


def frame(spark, x, extra=()):
    rows = [(i, v.tolist(), "clash", 1) for i, v in enumerate(x)] + [(i, v, "clash", 1) for i, v in extra]
    return spark.createDataFrame(rows, "key long, emb array<double>, id string, cell int").repartition(3)


@pytest.mark.parametrize("spread", [0.0, 3.0])
def test_recall_is_reached_and_few_rows_are_read(spark, spread):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((2_000, 30)) + spread * rng.standard_normal((12, 30))[rng.integers(0, 12, 2_000)]
    df = frame(spark, x, [(5_000, None), (5_001, [float("nan")] * 30)])
    model = codes.fit(df, case_id="key", vector="emb", cells=16, levels=64)
    index = codes.build(df, model, case_id="key", vector="emb").cache()
    assert index.count() == 2_000
    model = codes.calibrate(df.where("key % 50 = 25"), index, model, query_id="key", vector="emb", exclude_self=True)
    asked = df.where("key % 50 = 0")
    found = codes.search(asked, index, model, query_id="key", vector="emb", exclude_self=True, query_rows=16, block_rows=700)
    good = df.where("key < 2000")
    exact = vectors.top_k(asked.where("key < 2000"), good, query_id="key", base_id="key", vector="emb", exclude_self=True)
    row = vectors.recall(exact, found).first()
    assert row.n_exact == 200 and row.recall >= 0.9
    assert model.shortlist < 500 and found.where("query_id = base_id").count() == 0
    if spread:
        assert model.probes < 16
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert all(abs(r.score - unit[r.query_id] @ unit[r.base_id]) < 1e-9 for r in found.collect())


def test_few_equal_and_zero_vectors(spark):
    df = frame(spark, np.array([[1.0, 0.0, 0.0]] * 5 + [[0.0, 0.0, 0.0], [0.0, 2.0, 0.0]]))
    model = codes.fit(df, case_id="key", vector="emb", cells=4, parts=2, levels=4)
    index = codes.build(df, model, case_id="key", vector="emb")
    found = codes.search(df.where("key in (0, 6)"), index, model, query_id="key", vector="emb", k=3)
    got = {(r.query_id, r["rank"]): (r.base_id, r.score) for r in found.collect()}
    assert got[0, 1] == (0, 1.0) and got[0, 3] == (2, 1.0) and got[6, 1] == (6, 1.0) and got[6, 2] == (0, 0.0)
    assert codes.fit(df.where(F.lit(False)), case_id="key", vector="emb") is None


def test_lists_are_picked_once_and_stay_bounded(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3_000, 16))
    df = frame(spark, x)
    model = codes.fit(df, case_id="key", vector="emb", cells=8, parts=4, levels=16)
    index = codes.build(df, model, case_id="key", vector="emb").cache()
    queries = df.where("key < 300").select(F.col("key").alias("query_id"), F.col("emb").alias("v")).toArrow()
    rows = index.select("id", "cell", "code").toArrow()
    # Sorting all that was kept so far, step by step, took a task hours.
    monkeypatch.setattr(np, "lexsort", lambda *_: pytest.fail("lists are sorted again"))
    monkeypatch.setattr(codes, "GUESSES", 50_000)
    got = codes._listed(model, 40)(queries, rows).to_pandas()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cell, code = model.encode(unit)
    whole = -np.sort(-model.scores(unit[:300], cell, code), axis=1)[:, :40]
    assert (got.groupby("query_id").size() == 40).all() and len(got) == 300 * 40
    best = np.stack([-np.sort(-g.to_numpy()) for _, g in got.groupby("query_id")["guess"]])
    assert np.allclose(best, whole)
    few, many = (codes.search(df.where("key < 300"), index, model, query_id="key", vector="emb", listed_rows=n, block_rows=1_000) for n in (500, 1 << 20))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
