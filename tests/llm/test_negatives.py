"""Hard negatives against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselens.llm import negatives


def brute(rows, is_anchor, positives=5, count=5, share=(80, 100)):
    """``rows`` are id, label, vector; all distinct."""
    whole = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows
             if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    wide = max((len(v) for *_, v in whole), default=0)
    whole = sorted({(i, y, tuple(v + [0] * (wide - len(v)))) for i, y, v in whole})
    table = np.array([v for *_, v in whole], np.int64).reshape(len(whole), wide)
    out = []
    for at, (i, y, _) in enumerate(whole):
        if not is_anchor(i):
            continue
        scores = (table @ table[at]).tolist()
        ranked = sorted((-s, j, z) for k, (s, (j, z, _)) in enumerate(zip(scores, whole, strict=True)) if k != at)
        for s, j, _ in [r for r in ranked if r[2] == y][:positives]:
            fit = [r for r in ranked if r[2] != y and share[0] * -s <= share[1] * -r[0] <= share[1] * -s][:count]
            out += [(i, j, n, m, -s, -t) for n, (t, m, _) in enumerate(fit, 1)]
    return sorted(out)


def frame(spark, rows, partitions=3):
    made = spark.createDataFrame([(i, v, y, "clash", 1, 2) for i, y, v in rows],
                                 "vec_id long, embedding array<float>, label int, anchor string, w int, score int")
    return made.repartition(partitions) if rows else made


def mine(df, every=10, **how):
    return sorted(tuple(r) for r in negatives.mine(df, anchors=F.col("vec_id") % every == 0, **how).collect())


def drawn(n, wide=24, labels=6, seed=3, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((labels, wide)) * spread
    out = []
    for i in range(n):
        y = int(rng.integers(0, labels))
        v = rng.standard_normal(wide) + centres[y] * float(rng.random() < 0.7)
        out.append((i, y, [float(np.float32(x)) for x in v / np.linalg.norm(v)]))
    return out


@pytest.mark.parametrize("spread", [0.0, 0.7, 3.0])
def test_mine(spark, spread):
    rows = drawn(900, spread=spread)
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 50
    assert mine(frame(spark, rows)) == want


def test_blocks_and_raised_thresholds(spark, monkeypatch):
    for name, size in (("ANCHOR_BLOCK", 20), ("ROW_BLOCK", 70), ("LEAST_BLOCK", 30), ("STEP", 5), ("PAIRS", 50)):
        monkeypatch.setattr(negatives, name, size)
    rows = drawn(800, labels=3)
    assert mine(frame(spark, rows), every=7, hot_rows=50) == brute(rows, lambda i: i % 7 == 0)


def test_one_vector_many_times(spark):
    """A third of the rows, anchors among them, hold one vector, under one label and under several."""
    rows = drawn(400)
    rows += [(1_000 + i, 2, rows[5][2]) for i in range(150)] + [(2_000 + i, i % 4, rows[7][2]) for i in range(150)]
    assert mine(frame(spark, rows)) == brute(rows, lambda i: i % 10 == 0)


def test_norms_that_differ_and_scores_below_zero(spark):
    rng = np.random.default_rng(8)
    rows = [(i, y, [x * float(10 ** rng.uniform(-2, 2)) for x in v]) for i, y, v in drawn(300, wide=5)]
    rows += [(1_000 + i, 9, [-1.0 if i % 2 else 1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(6)]  # few of a label, some opposite
    rows += [(2_000, 30, [0.0] * 5), (2_010, 30, [0.0] * 5), (2_001, 31, [0.0] * 5)]  # scores of 0
    want = brute(rows, lambda i: i % 10 == 0)
    assert any(r[4] == 0 for r in want)
    assert mine(frame(spark, rows)) == want


def test_rows_that_take_no_part(spark):
    rows = drawn(200, wide=4)
    rows[20], rows[30], rows[41] = (20, None, rows[20][2]), (30, 1, None), (41, 1, [math.nan, 0.0, 0.0, 0.0])
    rows += [(None, 1, rows[3][2]), (500, 1, [None, 1.0, 0.0, 0.0]), (510, 2, [0.5, 0.25]), (520, 2, []), (530, 1, [math.inf] * 4), rows[50], rows[50]]
    assert mine(frame(spark, rows)) == brute(rows, lambda i: i % 10 == 0)


def test_few_or_no_rows(spark):
    assert mine(frame(spark, [])) == []
    assert mine(frame(spark, [(1, 1, [1.0]), (2, 1, [1.0])])) == []  # no anchors
    assert mine(frame(spark, [(10, 1, [1.0]), (2, 2, [1.0])])) == []  # no positives
    assert mine(frame(spark, [(10, 1, [1.0]), (2, 1, [1.0]), (3, 0, [0.8]), (4, 0, [0.9])])) == [
        (10, 2, 1, 4, 65_536, 256 * 230)]


def test_large_scores_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 2)), [float(x) for x in rng.integers(1, 30_000, 3)]) for i in range(80)]
    assert mine(frame(spark, rows)) == brute(rows, lambda i: i % 10 == 0)


def test_candidates_never_lose_a_pair():
    rng = np.random.default_rng(0)
    x, y = rng.integers(-9, 9, (30, 20)), rng.integers(-9, 9, (200, 20)) * rng.integers(0, 3, (200, 1))
    edges = [0, 6, 12, 18, 20]
    least = rng.integers(50, 500, 30)
    i, j = negatives._candidates(x.astype(float), y.astype(float), negatives._rest(x, edges), negatives._rest(y, edges), least, edges)
    found = set(zip(i.tolist(), j.tolist(), strict=True))
    assert len(found) == len(i) < 30 * 200
    assert {(a, b) for a, b in np.argwhere(x @ y.T >= least[:, None]).tolist()} <= found
