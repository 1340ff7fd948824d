"""One-permutation MinHash against brute force."""

import numpy as np

from caselens.llm import minhash
from caselens.llm.jaccard import Limit, Sets, sketches
from caselens.llm.queries import QUERIES
from tests.llm.test_jaccard import brute, changed, shingles


def run(docs, **how):
    found = minhash.near_duplicates(docs, **how).collect()
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in found)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in found}


def brute3(rows):
    return brute([(i, t) for i, t in rows], n=3)


def sets_of(*rows):
    return Sets(np.concatenate([np.sort(r) for r in rows]), np.concatenate([[0], np.cumsum([len(r) for r in rows])]))


def test_bins_agree_like_similarity():
    """Also where nearly all bins are empty and filled from others."""
    rng = np.random.default_rng(5)
    for size, common in ((2_000, 1_600), (40, 30), (8, 7)):
        agree = []
        for _ in range(60):
            pool = rng.integers(0, 1 << 63, 2 * size - common).astype(np.uint64)
            sign = minhash.signatures(sets_of(pool[:size], pool[size - common:]), 160)
            agree.append((sign[0] == sign[1]).mean())
        assert abs(np.mean(agree) - common / (2 * size - common)) < 0.03


def test_signatures_of_tiny_and_empty_sets():
    one = np.array([77], np.uint64)
    sign = minhash.signatures(sets_of(np.zeros(0, np.uint64), one, one, np.array([77, 78], np.uint64)), 160)
    assert not sign[0].any() and (sign[1] == sign[2]).all() and len(np.unique(sign[1])) == 1
    assert len(np.unique(sign[3])) == 2 and 0.2 < (sign[3] == sign[1]).mean() < 0.8


def test_bands_miss_next_to_nothing():
    assert minhash.NARROW.miss(0.85) < 1e-7 and minhash.WIDE.miss(0.85) < 1e-5


def test_families_and_chains(documents, rng, vocabulary):
    texts = []
    for _ in range(12):
        base = vocabulary(rng.randint(4, 260))
        for _ in range(rng.randint(1, 25)):
            texts.append(" ".join(changed(rng, base, rng.choice([0, 0.005, 0.01, 0.03, 0.05]), vocabulary)))
    for _ in range(3):  # each a little further from the one before
        words = vocabulary(200)
        for _ in range(15):
            words = changed(rng, words, 0.015, vocabulary)
            texts.append(" ".join(words))
    texts += [texts[3]] * 5 + ["  \t".join(texts[4].split(" ")).upper()]
    rng.shuffle(texts)
    want = brute3(list(enumerate(texts)))
    assert len({c for _, c in want.values()}) < len(texts) - 40
    assert run(documents(texts)) == want
    assert run(documents(texts, partitions=9), hot_rows=20) == want


def test_stars_do_not_lose_links_under_a_common_passage(documents, rng, vocabulary, monkeypatch):
    """Letters that share most words but are too far apart, a few that are near enough, and small blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "GROUP_ROWS", 200)
    form = vocabulary(150)
    texts = []
    for _ in range(120):
        words = list(form)
        for at in rng.sample(range(150), 7):
            words[at] = vocabulary(1)[0] + "x"
        texts.append(" ".join(words))
    texts += [" ".join(changed(rng, texts[i].split(" "), 0.01, vocabulary)) for i in range(0, 40, 4)]
    want = brute3(list(enumerate(texts)))
    assert 100 < len({c for _, c in want.values()}) < 130
    assert run(documents(texts)) == want


def test_blocks_compare_every_pair(spark, rng, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "GROUP_ROWS", 500)
    grams = [sorted(rng.sample(range(1, 1 << 60), rng.randint(50, 70))) for _ in range(300)]
    want = set()
    for a in range(200, 280, 2):
        grams[a + 1] = sorted([*grams[a][:-2], *grams[a + 1][:2]])
        want.add((a, a + 1))
    sign = sketches(sets_of(*[np.array(g, np.uint64) for g in grams])).view(np.int64)
    sets = spark.createDataFrame([(i, len(g), sign[i].tolist(), g) for i, g in enumerate(grams)], "id long, n long, sketch array<long>, grams array<long>")
    joined = minhash._Components(sets, Limit(85, 100), 1_000_000)
    rows, state, n_rows, pairs = joined.unsettled(spark.range(300).selectExpr("1L AS key", "id"))
    assert (n_rows, pairs) == (300, 300 * 299 / 2)
    joined.compare(rows, state)
    assert {(r.component, r.id) for r in joined.part.where("id <> component").collect()} == want


def test_small_sets(documents):
    texts = ["a", "A", "a b", "a  b", "b a", "a b c", "a b c d", "a b c d e", "", None, " \t\n", "a b c d", "x y z w v u t s r",
             "x y z w v u t s r q", "\x0bq", "q"]
    want = brute3(list(enumerate(texts)))
    assert run(documents(texts)) == want
    assert want[8] == (0, 8) and want[9] == (0, 9)


def test_nulls_ties_and_long_texts(spark, documents, vocabulary):
    long = " ".join(vocabulary(30_000))
    rows = [(5, long), (3, long + " end"), (None, long), (7, "one two three four"), (7, "one two three four"), (9, None),
            (11, "p q r s"), (12, "k l m n"), (11, "k l m n")]
    got = minhash.near_duplicates(documents(rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [
        (3, 3), (5, 3), (7, 7), (7, 7), (9, 9), (11, 11), (11, 11), (12, 11)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, False)]
    assert minhash.near_duplicates(documents([])).collect() == []


def test_query_on_the_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op11_minhash"](spark, folder).collect()}
    assert got == brute3(texts)
    assert all(n == len(shingles(t, 3)) for (_, t), (n, _) in zip(texts, [got[i] for i, _ in texts], strict=True))
