import random
import uuid

import pytest
from pyspark.sql import functions as F

from caselens.operators import retrieval, vectors
from caselens.plans.retrieval import letters_encoder
from caselens.runtime import new_path


def test_windows(spark):
    lengths = [0, 1, 200, 201, 1000, 1001, 1800, 1801]
    df = spark.createDataFrame([(n, "é" * n) for n in lengths], "id bigint, t string")
    got = {}
    for r in retrieval.chunk_windows(df, case_id="id", text="t").orderBy("id", "chunk_no").collect():
        got.setdefault(r.id, []).append(len(r.content))
    assert got == {1: [1], 200: [200], 201: [201], 1000: [1000], 1001: [1000, 201], 1800: [1000, 1000], 1801: [1000, 1000, 201]}


def test_windows_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(2345))
    rows = retrieval.chunk_windows(spark.createDataFrame([(1, text)], "id bigint, t string"), case_id="id", text="t", size=100, overlap=30)
    parts = [r.content for r in rows.orderBy("chunk_no").collect()]
    assert parts[0] + "".join(p[30:] for p in parts[1:]) == text


def packed(text, size, overlap):
    """Pieces by their running length, in plain words."""
    pieces, at = [], 0
    while at < len(text):
        end = text.find("\n", at, at + overlap)
        if end >= 0:
            end += 1
        elif len(text) - at <= overlap and "\n" not in text[at:]:
            end = len(text)
        else:
            line = text.find("\n", at)
            stop = at + overlap if line < 0 else min(at + overlap, line)
            end = text.rfind(" ", at, stop) + 1 or stop
        pieces.append((at, text[at:end]))
        at = end
    stretch = size - 2 * overlap
    out = []
    for k in range(pieces[-1][0] // stretch + 1 if pieces else 0):
        first = min(s for s, _ in pieces if s // stretch == k)
        chunk = "".join(p for s, p in pieces if s // stretch == k or first - overlap <= s < first).strip()
        out += [chunk] if chunk else []
    return out


def test_separator_chunks(spark):
    rng = random.Random(5)
    texts = ["", "one line", "x" * 95, "\n\n \n", "é " * 80, "a\n" * 70, "word " * 60 + "\n" + "y" * 60, " " * 50 + "z"]
    texts += ["".join(rng.choice("aé  \n") if rng.random() < 0.4 else "b" for _ in range(rng.randint(1, 300))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(999, None)], "id bigint, t string")
    for size, overlap in ((40, 10), (64, 20), (31, 7)):
        got = {}
        for r in retrieval.chunk_at_separators(df, case_id="id", text="t", size=size, overlap=overlap).orderBy("id", "chunk_no").collect():
            assert r.chunk_no == len(got.setdefault(r.id, [])) and 0 < len(r.content) <= size
            got[r.id].append(r.content)
        assert got == {i: packed(t, size, overlap) for i, t in enumerate(texts) if t.strip()}
    plan = retrieval.chunk_at_separators(df, case_id="id", text="t")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.split("== Physical Plan ==")[1]
    with pytest.raises(ValueError):
        retrieval.chunk_at_separators(df, case_id="id", text="t", size=30, overlap=10)


def letters():
    return lambda texts: [[float(t.count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]


def test_own_encoder_and_cells(spark):
    docs = spark.createDataFrame([(i, chr(97 + i % 26) * 5 + chr(97 + i // 26)) for i in range(200)], "id bigint, t string")
    path = new_path(spark, "index")
    rows = retrieval.as_documents(docs, doc_id="id", content="t", source="x")
    centres = retrieval.store_documents(letters, rows.where("doc_id < '5'"), path, cells=5)
    retrieval.store_documents(letters, rows.where("doc_id >= '5'"), path, append=True, centres=centres)
    index = spark.read.parquet(path)
    assert index.count() == 200 and 1 < index.select("cell").distinct().count() <= 5
    questions = spark.createDataFrame([(1, "aaaaac"), (2, "zzz"), (3, None)], "q bigint, t string")
    ask = lambda **how: sorted((r.query_id, r["rank"], r.base_id) for r in retrieval.retrieve(
        letters, questions, index, question_id="q", question="t", k=3, **how).collect())
    exact = ask()
    assert (1, 1, "52") in exact and ask(centres=centres, probes=5) == exact
    near = ask(centres=centres, probes=3)
    assert len(near) == 9 and len(set(near) & set(exact)) >= 0.4 * len(exact)
    replies = retrieval.answer(letters, questions, index, question_id="q", question="t", k=1, centres=centres, probes=5,
                               factory=lambda: (lambda prompts: [p.split("Context:\n")[1].split("\n")[0] for p in prompts]))
    assert {r.q: r.output for r in replies.collect()}[1] == "aaaaac"


def test_context_and_answers(spark):
    docs = spark.createDataFrame(
        [(1, "trafficking victims protection act"), (2, "late fee on a card"), (3, "identity theft report")], "id bigint, t string")
    model = vectors.fit_text_encoder(docs, text="t", dims=128)
    path = new_path(spark, "index")
    retrieval.store_documents(model, retrieval.as_documents(docs, doc_id="id", content="t", source="law"), path)
    more = spark.createDataFrame([(9, "Texas reported 3 trafficking complaints")], "id bigint, t string")
    retrieval.store_documents(
        model, retrieval.as_documents(more, doc_id="id", content="t", source="summary"), path, append=True)
    index = spark.read.parquet(path)
    questions = spark.createDataFrame([(1, "which act protects trafficking victims"), (2, "a card fee")], "q bigint, t string")
    hits = retrieval.retrieve(model, questions, index, question_id="q", question="t", k=2).collect()
    assert {(r.query_id, r["rank"]): r.base_id for r in hits}[(1, 1)] == "1"
    assert {(r.query_id, r["rank"]): r.base_id for r in hits}[(2, 1)] == "2"
    context = {r.query_id: r.context for r in retrieval.assemble_context(
        retrieval.retrieve(model, questions, index, question_id="q", question="t", k=2)).collect()}
    assert context[1].split("\n\n")[0] == "trafficking victims protection act"
    replies = retrieval.answer(
        model, questions, index, question_id="q", question="t", k=2,
        factory=lambda: (lambda prompts: [p.split("Context:\n")[1].split("\n")[0] for p in prompts]))
    assert {r.q: r.output for r in replies.collect()} == {1: "trafficking victims protection act", 2: "late fee on a card"}


def test_registered_probes_reach_the_recall(spark):
    from caselens.plans.retrieval import topk_recall

    assert topk_recall(spark, "/root/testdata/sf0.01").first()["recall"] >= 0.9


def test_context_stays_within_its_length(spark):
    hits = spark.createDataFrame(
        [(1, 1, "aaaa"), (1, 2, "bbb"), (1, 3, "c"), (2, 1, "dddddddddddddd"), (2, 2, "e"), (3, 2, "gg"), (3, 1, "ff")],
        "query_id int, rank int, content string")
    ask = lambda n: {r.query_id: r.context for r in retrieval.assemble_context(hits, max_chars=n).collect()}
    assert ask(9) == {1: "aaaa\n\nbbb", 2: "ddddddddd", 3: "ff\n\ngg"}
    # The second one does not fit; nothing behind it is taken either.
    assert ask(8) == {1: "aaaa", 2: "dddddddd", 3: "ff\n\ngg"}
    assert ask(100)[1] == "aaaa\n\nbbb\n\nc" and ask(5)[3] == "ff"


def test_probes_are_measured(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(600)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    index, centres = vectors.coarse_cells(df, vector="v", cells=12)
    index = index.cache()
    sample, names = df.where("id % 10 = 0"), dict(query_id="id", base_id="id", vector="v", k=5)
    probes = vectors.calibrate_probes(sample, index, centres, recall=0.9, **names)
    exact = vectors.top_k(sample, df, **names)
    reached = lambda p: vectors.recall(exact, vectors.top_k_probed(sample, index, centres, probes=p, **names)).first().recall
    assert reached(probes) >= 0.9 and (probes == 1 or reached(probes - 1) < 0.9)
    default = vectors.top_k_probed(sample, index, vectors.Cells(centres, probes), **names)
    assert vectors.recall(exact, default).first().recall == reached(probes)
    assert vectors.recall(exact, vectors.top_k_probed(sample, index, centres, **names)).first().recall == 1.0


def test_texts_are_embedded_once_for_cells(spark, tmp_path):
    """Centres are found on the vectors as written: the encoder sees every document once."""
    seen = tmp_path / "seen"
    seen.mkdir()

    def encoder():
        def run(texts):
            (seen / uuid.uuid4().hex).write_text(str(len(texts)))
            return [[float(len(t)), float(t.count("a"))] for t in texts]
        return run

    docs = spark.range(300).select(F.col("id").cast("string").alias("doc_id"), F.repeat(F.lit("ab"), (F.col("id") % 17).cast("int")).alias("content"),
                                   F.create_map(F.lit("source"), F.lit("s")).alias("metadata"))
    retrieval.store_documents(encoder, docs, str(tmp_path / "index"), cells=4)
    assert sum(int(f.read_text()) for f in seen.iterdir()) == 300


def test_long_batches_are_encoded_in_parts(spark):
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(most)
    docs = spark.range(0, 3_000, numPartitions=1).select("id", F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("t"))
    spark.conf.set(most, 10_000)
    try:
        rows = vectors.encode_with(lambda: lambda texts: [[float(t or -1), float(len(texts))] for t in texts], docs, text="t", output="v").collect()
    finally:
        spark.conf.set(most, before)
    assert {r.id: r.v[0] for r in rows} == {i: float(i if i % 7 else -1) for i in range(3_000)}
    assert {r.id: r.t for r in rows} == {i: str(i) if i % 7 else None for i in range(3_000)} and max(r.v[1] for r in rows) == 64


def test_letter_pairs():
    def plain(text):
        out = [0.0] * 64
        for a, b in zip(text.lower(), text.lower()[1:]):
            out[(ord(a) * 31 + ord(b)) % 64] += 1.0
        return out

    texts = ["", "a", "Ab", "ÄßİK", "\U0001f600x\ny", "the same same words"]
    assert [v.tolist() for v in letters_encoder()(texts)] == [plain(t) for t in texts]
