"""Components by divide and conquer, and whitening, against numpy."""

import math

import numpy as np
import pytest

from caselens.llm import dense, qdwh, whitening
from caselens.llm.queries import QUERIES


@pytest.mark.parametrize("values", [
    [1], [2, 1], [3, 2, 2, 2, 1, 1], [1, 1, 1, 1], [0, 0, 0], [5, 0, 0, 0], [1, 1 - 1e-9, 1 - 2e-9, 0.5], [1e8, 3, 1, 1e-6],
    list(np.linspace(1, 1.1, 40)), [10.0 ** -k for k in range(12)], [3, 1, -1, -3]])
def test_eigen(values):
    rng = np.random.default_rng(len(values))
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    found, vectors = qdwh.eigen(a)
    scale = max(np.abs(values).max(), 1e-300)
    assert np.abs(found - np.sort(values)[::-1]).max() <= 1e-13 * scale
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
    assert np.linalg.norm(a @ vectors - vectors * found) <= 1e-13 * scale * len(values)


def test_polar_of_a_nearly_singular_matrix():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.standard_normal((20, 20)))
    signs = np.where(np.arange(20) % 3, 1.0, -1.0)
    a = q @ np.diag(signs * 10.0 ** -np.linspace(0, 12, 20)) @ q.T
    u = qdwh.polar((a + a.T) / 2)
    assert np.abs(u @ u - np.eye(20)).max() < 1e-12
    assert np.abs(u - q @ np.diag(signs) @ q.T).max() < 1e-3


def brute(rows, components=16):
    """Integer vectors by id, and what the report says of them."""
    whole = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows]
    fit = np.array(sorted({tuple(x) for _, x in whole}), dtype=object)
    n, total = len(fit), fit.sum(axis=0)
    off = (fit * n - total).astype(np.float64) / n
    cov = off.T @ off / n
    values, parts = np.linalg.eigh(cov)
    values, parts = values[::-1][:components], parts[:, ::-1][:, :components]
    out = []
    for i, x in whole:
        d = [n * a - s for a, s in zip(x, total, strict=True)]
        w = np.array([y / n for y in d]) @ parts / np.sqrt(values)
        out.append((i, n, sum(y * y for y in d), w, values / np.trace(cov)))
    return out


def check(got, want, k):
    """Rows by id in both, each component of one sign throughout."""
    table = {}
    for r in got:
        table.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    assert len(got) == len(want) * k
    mine = np.array([[table[i, d][c].whitened for c in range(1, k + 1)] for i, _, d, _, _ in want])
    theirs = np.array([w[:k] for *_, w, _ in want])
    assert np.abs(mine - theirs * np.sign((mine * theirs).sum(axis=0))).max() < 1e-8
    for i, n, d, _, explained in want:
        for c in range(1, k + 1):
            row = table[i, d][c]
            assert row.n == n and abs(row.explained / explained[c - 1] - 1) < 1e-9 and 0 <= row.identity_error < 1e-9


def vectors(spark, rows, partitions=3):
    shape = "vec_id long, embedding array<float>, label int, component string, x int, n string"
    frame = spark.createDataFrame([(i, v, 1, "clash", 2, "clash") for i, v in rows], shape)
    return frame.repartition(partitions) if rows else frame


def drawn(n, wide, seed=1):
    rng = np.random.default_rng(seed)
    rows = rng.standard_normal((n, wide)) * np.linspace(1, 3, wide) + 50
    return [(i, [float(np.float32(x)) for x in row]) for i, row in enumerate(rows)]


def test_report(spark):
    rows = drawn(700, 20)
    rows += [(1_000 + i, rows[3][1]) for i in range(400)]  # one vector many times
    rows += [(5, rows[9][1]), (None, rows[10][1])]
    check(whitening.report(vectors(spark, rows)).collect(), brute(rows), 16)


def test_rows_that_are_left_out_and_short_vectors(spark):
    rows = drawn(200, 6)
    bad = [(300, None), (301, [1.0, None, 2.0, 1.0, 1.0, 1.0]), (302, [math.nan] * 6), (303, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0])]
    short = [(400, [1.0, 2.0]), (401, [])]
    got = whitening.report(vectors(spark, rows + bad + short)).collect()
    check(got, brute(rows + [(i, v + [0.0] * (6 - len(v))) for i, v in short]), 6)


def test_few_or_no_rows(spark):
    assert whitening.report(vectors(spark, [])).collect() == []
    assert whitening.report(vectors(spark, [(1, None), (2, [])])).collect() == []
    assert whitening.report(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    one = whitening.report(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 4.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in one) == [
        (1, 1, 2, 128 ** 2, 1.0, 1.0), (2, 1, 2, 128 ** 2, 1.0, 1.0)]


def test_large_entries(spark):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(np.random.default_rng(4).integers(-50_000, 50_000, (60, 3)))]
    got = whitening.report(vectors(spark, rows)).collect()
    check(got, brute(rows), 3)
    off = whitening.Whitening(1 << 20, np.zeros(1, np.int64), np.zeros(1, np.int64), np.eye(1), np.ones(1), 1.0)
    assert off.deviation(np.array([[1 << 28], [3]])) == [None, 9 << 40]


def test_packed_rows():
    rows = np.array([[1, -2], [1 << 20, 5], [0, 0], [-(1 << 15), 1], [(1 << 15) - 1, 1]], np.int32)
    packed = dense.pack(rows)
    assert (dense.unpack(packed, 2) == rows).all() and [len(x.as_py()) for x in packed] == [4, 8, 4, 8, 4]
    assert dense.unpack(packed[:0], 2).shape == (0, 2)


def test_query_on_the_given_embeddings(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(QUERIES["op12_whiten"](spark, folder).collect(), brute(rows), 16)
