import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselens.operators import clusters, evaluate, hierarchy, joins, profile, vectors


def frame(spark, matrix, start=0):
    rows = [(start + i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "id bigint, v array<double>")


def brute_top(q, b, k):
    qn = q / np.linalg.norm(q, axis=1, keepdims=True)
    bn = b / np.linalg.norm(b, axis=1, keepdims=True)
    scores = np.round(qn @ bn.T, 9)
    return {i: sorted(range(len(b)), key=lambda j: (-scores[i, j], j))[:k] for i in range(len(q))}


@pytest.fixture(scope="module")
def cloud():
    m = np.random.default_rng(5).normal(size=(300, 8))
    m[10:20] = m[0]  # equal vectors: ties go to the lesser key
    return m


def ranked(hits):
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.base_id)
    return got


def test_top_k_both_ways(spark, cloud):
    base, queries = frame(spark, cloud).repartition(5), frame(spark, cloud[:40])
    want = brute_top(cloud[:40], cloud, 7)
    args = dict(query_id="id", base_id="id", vector="v", k=7)
    assert ranked(vectors.top_k(queries, base, **args)) == want
    assert ranked(vectors.top_k(queries, base, max_queries=5, block_rows=30, **args)) == want
    assert vectors.top_k(queries.limit(0), base, **args).count() == 0


def test_blocks_are_not_sent_to_every_small_block(spark):
    """Rows of a side go to a few tiles of the other, however small the blocks that are scored together."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1_500, 8))
    df, base = (frame(spark, x).select(F.col("id").alias(name), "v", F.lit(0).alias("cell")) for name in ("query_id", "base_id"))
    partial = vectors._blocks(df, base, 3, 10, "query_id long, base_id long, score double")
    assert partial.count() <= 1_500 * 3 * vectors.TILE_PARTS
    got = ranked(vectors._merged(partial, 3))
    whole = vectors.top_k(df, base, query_id="query_id", base_id="base_id", vector="v", k=3)
    assert got == ranked(whole)


def test_scores_held_at_once_are_bounded():
    rng = np.random.default_rng(2)
    q, b = (vectors._unit(list(rng.standard_normal((n, 8)))) for n in (vectors.TILE_QUERIES, 20_000))
    best = vectors._Best(np.arange(len(q)), q, 5)
    tracemalloc.start()
    best.add(np.arange(len(b)), b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6 and len(best.result()) == 5 * len(q)


def test_probing(spark, cloud):
    base, queries = frame(spark, cloud), frame(spark, cloud[:40])
    index, centres = vectors.coarse_cells(base, vector="v", cells=6)
    args = dict(query_id="id", base_id="id", vector="v", k=5)
    exact = vectors.top_k(queries, base, **args)
    assert ranked(vectors.top_k_probed(queries, index, centres, probes=6, **args)) == ranked(exact)
    some = vectors.recall(exact, vectors.top_k_probed(queries, index, centres, probes=2, **args)).first()
    assert some.n_exact == 200 and 0.3 < some.recall <= 1.0
    # Too many queries for one matrix: block by block, the same rows.
    for probes in (2, 6):
        one, many = (vectors.top_k_probed(queries, index, centres, probes=probes, max_queries=m, block_rows=15, **args)
                     for m in (1000, 3))
        assert ranked(one) == ranked(many)
    assert vectors.top_k_probed(queries.limit(0), index, centres, **args).count() == 0


def test_encoders(spark):
    df = spark.createDataFrame([(1, "late fee charged"), (2, "late fee charged"), (3, "identity theft"), (4, None)], "id bigint, t string")
    own = vectors.encode(df, case_id="id", text="t", factory=lambda: (lambda texts: [[len(t), 1] for t in texts]))
    assert {r.id: r.embedding for r in own.collect()} == {1: [16.0, 1.0], 2: [16.0, 1.0], 3: [14.0, 1.0]}
    model = vectors.fit_text_encoder(df, text="t", dims=64)
    got = {r.id: np.array(r.embedding) for r in vectors.encode_text(model, df, text="t").collect()}
    assert np.allclose(got[1], got[2]) and np.isclose(np.linalg.norm(got[1]), 1, atol=1e-5)
    assert got[1] @ got[3] < 0.5 and not got[4].any()


def planted(seed=9):
    rng = np.random.default_rng(seed)
    a = rng.normal(0.0, 0.05, (200, 3))
    b = rng.normal(3.0, 0.05, (120, 3))
    tiny = rng.normal(-3.0, 0.02, (12, 3))
    noise = rng.uniform(-9, 9, (40, 3)) + 20
    return np.vstack([a, b, tiny, noise]), [0] * 200 + [1] * 120 + [-1] * 52


def test_density_finds_planted_blobs(spark):
    points, truth = planted()
    df = frame(spark, points).repartition(6)
    for hot_rows in (1_000_000, 20):
        got = clusters.density_clusters(
            df, case_id="id", vector="v", cell=0.2, dims=3, min_pts=3, min_size=30, hot_rows=hot_rows)
        labels = {r.id: r.cluster for r in got.collect()}
        assert len(labels) == len(truth)
        wrong = sum(labels[i] != t for i, t in enumerate(truth))
        assert wrong <= 10 and {0, 1, -1} == set(labels.values())
    joined = got.join(df, "id")
    assert clusters.cluster_count(joined).first().n_clusters == 2
    report = clusters.noise_report(joined, case_id="id", examples=3).first()
    assert report.n_rows == 372 and report.n_noise >= 52 and len(report.examples) == 3


def test_density_without_dense_cubes(spark):
    df = frame(spark, np.eye(3) * 10)
    got = clusters.density_clusters(df, case_id="id", vector="v", cell=1.0, dims=3, min_pts=2, min_size=2)
    assert {r.cluster for r in got.collect()} == {-1} and got.count() == 3


def test_reduction_and_kmeans(spark):
    points, truth = planted()
    rng = np.random.default_rng(1)
    wide = np.hstack([points[:320], rng.normal(0, 0.001, (320, 5))])
    reduced = vectors.reduce_dims(frame(spark, wide), vector="v", k=2)
    assert {len(r.reduced) for r in reduced.collect()} == {2}
    found = vectors.kmeans(reduced, vector="reduced", k=2)
    both = found.withColumn("truth", (F.col("id") >= 200).cast("int"))
    assert clusters.stability(both, first="cluster", second="truth").first().adjusted_rand == 1.0


def test_stability_of_independent_labels(spark):
    df = spark.range(10_000).select((F.col("id") % 7).alias("a"), (F.xxhash64("id") % 5).alias("b"))
    assert abs(clusters.stability(df, first="a", second="b").first().adjusted_rand) < 0.01
    same = df.select("a", (F.col("a") + 10).alias("b"))
    assert clusters.stability(same, first="a", second="b").first().adjusted_rand == 1.0


def test_names_and_labels(spark):
    rows = [(i, c, f"case {i}") for i, c in enumerate([0] * 8 + [1] * 2 + [-1] * 3)] + [(50, 2, None)]
    df = spark.createDataFrame(rows, "id bigint, cluster int, t string")

    def factory():
        def reply(prompts):
            if any("case 8" in p for p in prompts):
                raise RuntimeError("no")
            return [f"echo Theme: {p.count('case')} samples " for p in prompts]
        return reply

    names = clusters.name_clusters(df, case_id="id", cluster="cluster", text="t", factory=factory, n_samples=5)
    assert {r.cluster: r.label for r in names.collect()} == {0: "5 samples", 1: "Unknown", 2: "Unknown"}
    full = clusters.label_clusters(df, names)
    assert {r.cluster: r.label for r in full.collect()}[-1] == "Noise/Outlier" and full.count() == 14


def test_class_terms(spark):
    df = spark.createDataFrame([("a", "fee fee late the"), ("b", "theft theft the the"), (None, "x")], "c string, t string")
    top = {(r.c, r["rank"]): r.term for r in clusters.class_terms(df, by="c", text="t", k=2).collect()}
    assert top[("a", 1)] == "fee" and top[("b", 1)] == "theft"


def test_reports(spark):
    df = spark.createDataFrame(
        [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")] + [("b", None)], "actual string, predicted string")
    got = {r.label: r for r in evaluate.class_report(evaluate.confusion(df, actual="actual", predicted="predicted")).collect()}
    assert (got["a"].precision, got["a"].recall) == (0.75, 0.75)
    assert (got["b"].support, got["b"].n_predicted, got["b"].n_hit) == (3, 3, 2)
    assert got["c"].precision is None and got["c"].recall == 0.0 and got["c"].f1 == 0.0
    assert evaluate.errors(df, actual="actual", predicted="predicted").count() == 3


def test_classifier_and_topics(spark):
    words = {"fees": "late fee charge card", "theft": "identity stolen account fraud"}
    rows = [(i, " ".join(np.random.default_rng(i).choice(words[c].split(), 6)), c)
            for i, c in enumerate(["fees", "theft"] * 60)]
    df = spark.createDataFrame(rows, "id bigint, t string, label string")
    train, test = evaluate.hash_split(df, case_id="id")
    assert train.count() + test.count() == 120 and train.join(test, "id").count() == 0
    model = evaluate.fit_classifier(train, text="t", label="label", dims=256)
    scored = evaluate.classify(model, test.drop("label"), text="t").join(df.select("id", "label"), "id")
    assert evaluate.errors(scored, actual="label", predicted="predicted").count() == 0
    topics = evaluate.fit_topics(df, text="t", k=2, min_docs=1, max_docs=0.99, max_iter=20)
    assert evaluate.topic_terms(topics, 3).count() == 6
    assert evaluate.topic_of(topics, df, text="t").where("size(topic_weights) = 2").count() == 120


def test_topics_hold_no_words_to_count_cases(spark, monkeypatch):
    given, real = [], evaluate.CountVectorizer
    monkeypatch.setattr(evaluate, "CountVectorizer", lambda **how: given.append((how["minDF"], how["maxDF"])) or real(**how))
    df = spark.range(40).select(F.concat(F.lit("all "), F.when(F.col("id") < 20, "half ").otherwise("other "), F.when(F.col("id") < 4, "few")).alias("t"),
                                "id").select(F.coalesce("t", F.lit("all other")).alias("t"))
    model = evaluate.fit_topics(df, text="t", k=2, max_iter=1, min_docs=0.1, max_docs=0.5)
    assert given == [(4.0, 20.0)]
    want = real(inputCol="w", outputCol="c", minDF=0.1, maxDF=0.5).fit(df.select(F.split("t", " ").alias("w"))).vocabulary
    assert sorted(model.stages[0].vocabulary) == sorted(w for w in want if w)


def test_profile(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (" ", None), (None, 4)], "s string, n int")
    exact = {r.column_name: r for r in profile.profile(df, exact=True).collect()}
    assert tuple(exact["s"])[1:] == (4, 1, 1, 2, 1) and tuple(exact["n"])[1:] == (4, 1, 0, 3, 0)
    rough = {r.column_name: r for r in profile.profile(df).collect()}
    assert tuple(rough["s"])[1:5] == (4, 1, 1, 2) and rough["s"].n_repeated is None


def varied(seed=11):
    """Blobs of different density and two close ones; the last two need a finer grid."""
    rng = np.random.default_rng(seed)
    blobs = [(0.0, 0.6, 400), (12.0, 0.1, 150), (20.0, 0.02, 100), (20.4, 0.02, 100)]
    parts = [rng.normal(c, s, (n, 2)) for c, s, n in blobs]
    noise = rng.uniform(-5, 25, (25, 2))
    truth = [i for i, b in enumerate(blobs) for _ in range(b[2])] + [-1] * 25
    return np.vstack([*parts, noise]), truth


def test_hierarchy_finds_blobs_of_any_density(spark):
    points, truth = varied()
    df = frame(spark, points).repartition(5)
    got = clusters_of(hierarchy.density_hierarchy(df, case_id="id", vector="v", dims=2, min_size=30, min_pts=4))
    assert len(got) == len(truth) and set(got.values()) == {-1, 0, 1, 2, 3}
    named = {}
    for i, t in enumerate(truth):
        named.setdefault(t, []).append(got[i])
    tops = {t: max(set(v), key=v.count) for t, v in named.items()}
    assert len({tops[t] for t in range(4)}) == 4 and tops[0] == 0 and -1 not in {tops[t] for t in range(4)}
    assert sum(got[i] == tops[t] for i, t in enumerate(truth) if t >= 0) > 0.85 * 750


def clusters_of(df):
    return {r.id: r.cluster for r in df.collect()}


def test_hierarchy_without_structure_is_noise(spark):
    flat = frame(spark, np.random.default_rng(2).uniform(0, 1, (400, 2)))
    options = dict(case_id="id", vector="v", dims=2, min_size=60, min_pts=4, max_levels=5)
    assert set(clusters_of(hierarchy.density_hierarchy(flat, **options)).values()) == {-1}
    one = clusters_of(hierarchy.density_hierarchy(flat, allow_single=True, hot_rows=20, **options))
    assert list(one.values()).count(0) > 350
    same = frame(spark, np.ones((50, 2)))
    assert set(clusters_of(hierarchy.density_hierarchy(same, allow_single=True, **options | {"min_size": 30})).values()) == {0}


def test_one_far_point_does_not_hide_the_clusters(spark):
    rng = np.random.default_rng(7)
    blobs = np.vstack([rng.normal(c, 0.5, (200, 2)) for c in (0.0, 10.0, 20.0)])
    options = dict(case_id="id", vector="v", dims=2, min_size=30, min_pts=4)
    near = clusters_of(hierarchy.density_hierarchy(frame(spark, blobs), **options))
    far = clusters_of(hierarchy.density_hierarchy(frame(spark, np.vstack([blobs, [[1e4, 1e4]]])), **options))
    for got in (near, far):
        tops = [max(set(part), key=part.count) for part in ([got[i] for i in range(k, k + 200)] for k in (0, 200, 400))]
        assert sorted(tops) == [0, 1, 2]
        assert sum(got[i] == tops[i // 200] for i in range(600)) > 560
    assert far[600] == -1


def test_numbers_without_one_task(spark):
    df = spark.range(1000).select("id", F.pmod(F.xxhash64("id"), F.lit(50)).alias("size"))
    out = joins.numbered(df, F.desc("size"), F.col("id"), output="n").orderBy("n").collect()
    assert [r.n for r in out] == list(range(1000))
    assert [(-r.size, r.id) for r in out] == sorted((-r.size, r.id) for r in out)
    assert joins.numbered(df.limit(0), F.col("id"), output="n").count() == 0
