"""Exact de-duplication and its filters."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselens.llm import exact, fuse


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    out = []
    for i, t in rows:
        known = [x for x in groups[normal(t)] if x is not None]
        keep = min(known) if known else None
        out.append((i, keep, len(groups[normal(t)]), i == keep, hashlib.sha256(normal(t).encode()).hexdigest()))
    return sorted(out, key=str)


def run(docs, batches, **how):
    got = exact.dedup(docs, batches, **how).collect()
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got], key=str)


@pytest.mark.parametrize("batches", [[], ["doc_id <= 60"], ["doc_id % 3 = 0", "doc_id % 3 = 1"]])
def test_equals_brute_force(documents, rng, batches):
    pool = ["", " ", "a b", "a\tb", "a  b ", "a b ", "é x", None, *(f"text {k}" for k in range(40))]
    rows = [(i, rng.choice(pool)) for i in range(150)] + [(i, "the hot text") for i in range(150, 260)] + [(None, "a b"), (None, "lone"), (3, "a b")]
    rng.shuffle(rows)
    assert run(documents(rows, 5), [F.expr(b) for b in batches], shard_keys=7, hot_rows=20) == brute(rows)


def test_empty_and_long(documents, rng):
    assert run(documents([]), [F.col("doc_id") < 0]) == []
    long = "word " * 200_000
    rows = [(1, long), (2, long + " "), (3, long.replace(" ", "\n"))]
    assert run(documents(rows), [F.col("doc_id") < 2]) == brute(rows)


def test_collisions_do_not_merge_texts(documents, monkeypatch):
    """Digests that all collide only make more texts be compared."""
    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: F.lit(5).cast("long"))
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "c")]
    docs = documents(rows)
    marked = exact.digests(docs)
    assert marked.select("digest").distinct().count() == 1
    monkeypatch.undo()
    assert run(docs, [F.col("doc_id") < 3]) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 5_000, 60_000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    blob = fuse.build(keys)
    assert fuse.contains(blob, keys).all()
    others = np.setdiff1d(rng.integers(0, 2**63, 100_000).astype(np.uint64), keys)
    assert fuse.contains(blob, others).mean() < 0.001
    if n >= 5_000:
        assert 8 * len(blob) / len(keys) < 24


def test_snapshot_screens(spark):
    known = spark.range(1_000).select(F.xxhash64("id").alias("digest"))
    snapshot = exact.Snapshot.build(known.union(known), shard_keys=100)
    incoming = spark.range(500, 3_000).select(F.xxhash64("id").alias("digest"))
    positives = snapshot.screen(incoming)
    assert 500 <= positives.count() < 510
    assert snapshot.bucket(positives).count() == 500
