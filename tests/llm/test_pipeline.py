"""The pipeline against its parts done by hand."""

import re
import zlib

import pytest

import corpus_pipeline
from tests.llm import test_decontam, test_jaccard, test_mixing, test_tokens

pytest.importorskip("public_tokenizers")


@pytest.fixture
def folder(spark, tmp_path, rng, vocabulary, documents):
    items = [(i, " ".join(vocabulary(20))) for i in range(5)]
    rows, labels = [], []
    for i in range(400):
        kind = rng.random()
        text = "\n".join(" ".join(vocabulary(rng.randint(5, 25))).capitalize() + "." for _ in range(rng.randint(2, 8)))
        if kind < 0.15:
            text = " | ".join(vocabulary(rng.randint(30, 80))).upper()
        elif kind < 0.3 and rows:
            text = rows[rng.randrange(len(rows))][1]
        elif kind < 0.35:
            text += " " + items[i % 5][1]
        rows.append((i, text))
        if rng.random() < 0.6:
            labels.append((i, int("|" not in text), 0))
    rows += [(900, None), (901, "")]
    documents(rows, 3, source=[rng.choice(["a", "b", None]) for _ in rows]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), items


def test_stages(spark, folder):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, path), name)
        seen.append(docs.collect())
        assert name == "tokens" or docs.columns == columns
    quality, near, clean, mixed, tokens = seen
    assert not any("|" in (r.text or "") and len(r.text) > 200 for r in quality)
    assert sum("|" not in (r.text or "") for r in quality) > 300
    groups = test_jaccard.brute([(r.doc_id, r.text) for r in quality])
    assert sorted(r.doc_id for r in near) == sorted(i for i, (_, c) in groups.items() if i == c)
    report = test_decontam.brute([(r.doc_id, r.text) for r in near], items)
    assert sorted(r.doc_id for r in clean) == sorted(r[0] for r in report if not r[5])
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in clean}
    sizes = {}
    for r in clean:
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = test_mixing.loop_targets(sizes)
    for s, n in want.items():
        taken = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in mixed if r.source == s)
        assert n - 250 <= taken <= n + 1
    coded = test_tokens.brute([(r.doc_id, r.text) for r in mixed])
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens) == [(at, i, n, crc) for i, at, n, crc, _ in coded]


def test_run_is_the_stages(spark, folder):
    path, _ = folder
    rows = corpus_pipeline.run(spark, path).collect()
    assert len(rows) > 100 and len({r.start for r in rows}) == len(rows)
    assert all(r.ids_crc32 == r.ids_crc32 & 0xFFFFFFFF for r in rows) and zlib.crc32(b"") == 0


def test_texts_travel_in_small_batches(spark, folder):
    path, _ = folder
    most = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(most, None)
    try:
        spark.conf.unset(most)
        docs = spark.read.parquet(f"{path}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            if name != "mix":
                spark.conf.unset(most)
                stage(spark, docs, path)
                assert int(spark.conf.get(most)) == 8 << 20
        long = docs.limit(1).crossJoin(spark.range(0, 400, 1, 1)).selectExpr("repeat('x', 100000) AS text")
        sizes = long.mapInArrow(lambda rows: (r.from_pydict({"n": [r.nbytes]}) for r in rows), "n long").collect()
        assert len(sizes) > 3 and max(r.n for r in sizes) < 9 << 20
        spark.conf.set(most, "4m")
        corpus_pipeline.drop_near_copies(spark, docs, path)
        assert spark.conf.get(most) == "4m"
    finally:
        spark.conf.unset(most) if before is None else spark.conf.set(most, before)
