"""Positive-unlabelled quality classifier: held-out accuracy on planted junk, and odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from caselens.llm import quality


@pytest.fixture(scope="module")
def planted():
    import random

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(2, 8))) for _ in range(800)]

    def good():
        return "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(5, 20))).capitalize() + "." for _ in range(rng.randint(1, 12)))

    junk = [lambda: " ".join(rng.choice(words).upper() + "!!" for _ in range(rng.randint(20, 120))),
            lambda: " | ".join(rng.choice(words) for _ in range(rng.randint(20, 120))),
            lambda: " ".join([rng.choice(words)] * rng.randint(30, 200))]
    rows, labels = [], []
    for i in range(2_400):
        bad = rng.random() < 0.2
        rows.append((i, rng.choice(junk)() if bad else good()))
        if rng.random() < 0.5:
            labels.append((i, int(not bad)))
    return rows, labels, {i: int(not t.isupper() and "|" not in t and len(set(t.split())) > 2) for i, t in rows}


def test_held_out_documents(spark, documents, planted):
    rows, labels, truth = planted
    got = quality.report(documents(rows), spark.createDataFrame(labels, "doc_id long, quality int"), sample=5_000).collect()
    assert {r.doc_id: r.held_out for r in got} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _ in rows}
    held = [r for r in got if r.held_out]
    good = [r for r in held if truth[r.doc_id]]
    bad = [r for r in held if not truth[r.doc_id]]
    assert np.mean([r.predicted for r in good]) > 0.98 and np.mean([r.predicted for r in bad]) < 0.1
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_labels_of_the_held_out_fold_do_not_matter(spark, documents, planted):
    rows, labels, _ = planted
    held = [(i, 1 - q) if zlib.crc32(str(i).encode()) % 3 == 1 else (i, q) for i, q in labels]
    one, two = (quality.train(*quality.trusted(documents(rows), spark.createDataFrame(x, "doc_id long, quality int"))) for x in (labels, held))
    assert (one.weights == two.weights).all() and one.prior == two.prior
    assert one.prior == pytest.approx(0.8, abs=0.06)


def test_odd_rows(spark, documents):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    rows = [(1, "Fine words here."), (2, None), (3, ""), (None, "x " * 50_000), (4, " \n"), (4, " \n")]
    got = quality.report(documents(rows), labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3, 4)}) == 1
    assert quality.report(documents([]), labels).collect() == []
    assert all(r.score == 0.5 for r in quality.report(documents(rows), labels.limit(0)).collect())


def test_prior_estimate():
    rng = np.random.default_rng(1)
    for prior in (0.3, 0.6, 0.9):
        good = rng.normal(2, 1, 4_000)
        mixed = np.concatenate([rng.normal(2, 1, int(6_000 * prior)), rng.normal(-2, 1, int(6_000 * (1 - prior)))])
        assert quality.estimate_prior(good, mixed) == pytest.approx(prior, abs=0.05)


def test_measures_do_not_depend_on_slices(monkeypatch, vocabulary, rng):
    texts = pa.array([" ".join(vocabulary(rng.randint(0, 50))) + rng.choice(["", "\n| A", "É!"]) for _ in range(60)] + [None])
    whole = quality.measures(texts)
    monkeypatch.setattr(quality.W, "slices", lambda offsets: [(i, i + 1) for i in range(len(offsets) - 1)])
    assert np.allclose(whole, quality.measures(texts))
