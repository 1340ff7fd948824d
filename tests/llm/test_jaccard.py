"""N-gram Jaccard join against brute force."""

import re

import numpy as np
import pytest

from caselens.llm import jaccard
from caselens.llm.jaccard import Limit, Scheme

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(w) < n:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1))


def brute(rows, num=85, den=100, n=4):
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            common = len(x & y)
            if common and den * common >= num * (len(x) + len(y) - common):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    least = {}
    for i in sorted(parent):
        least.setdefault(find(i), i)
    return {i: (len(s), least[find(i)]) for i, s in sets}


def run(docs, **how):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, **how).collect()}


def changed(rng, words, share, sentence):
    return [sentence(1)[0] if rng.random() < share else w for w in words]


def test_families_and_chains(documents, rng, vocabulary):
    texts = []
    for _ in range(12):
        base = vocabulary(rng.randint(5, 260))
        for _ in range(rng.randint(1, 25)):
            texts.append(" ".join(changed(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.05]), vocabulary)))
    for _ in range(3):  # each a little further from the one before
        words = vocabulary(200)
        for _ in range(15):
            words = changed(rng, words, 0.012, vocabulary)
            texts.append(" ".join(words))
    texts += [texts[3]] * 5 + ["  \t".join(texts[4].split(" ")).upper()]
    rng.shuffle(texts)
    want = brute(list(enumerate(texts)))
    assert len({c for _, c in want.values()}) < len(texts) - 40
    assert run(documents(texts)) == want
    assert run(documents(texts, partitions=9), bucket_keys=64, hot_rows=20) == want


def test_form_letters_below_the_limit(documents, rng, vocabulary):
    """Letters that share most words but are too far apart, and a few that are near enough."""
    form = vocabulary(150)
    texts = []
    for _ in range(120):
        words = list(form)
        for at in rng.sample(range(150), 9):
            words[at] = vocabulary(1)[0] + "x"
        texts.append(" ".join(words))
    texts += [" ".join(changed(rng, texts[i].split(" "), 0.01, vocabulary)) for i in range(0, 40, 4)]
    assert run(documents(texts)) == brute(list(enumerate(texts)))


def test_shared_passages(documents, rng, vocabulary):
    passage = vocabulary(60)
    texts = [" ".join(vocabulary(rng.randint(20, 90)) + passage + vocabulary(rng.randint(0, 60))) for _ in range(150)]
    texts += [" ".join(changed(rng, t.split(" "), 0.01, vocabulary)) for t in texts[:20]]
    assert run(documents(texts)) == brute(list(enumerate(texts)))


def test_small_sets(documents):
    texts = ["a", "A", "a b", "a  b", "b a", "a b c", "a b c d", "a b c d e", "", None, " \t\n", "a b c d", "x y z w v u t s r",
             "x y z w v u t s r q", "\x0bq", "q"]
    want = brute(list(enumerate(texts)))
    assert run(documents(texts)) == want
    assert want[8] == (0, 8) and want[9] == (0, 9)


def test_nulls_ties_and_long_texts(spark, documents, vocabulary):
    long = " ".join(vocabulary(30_000))
    rows = [(5, long), (3, long + " end"), (None, long), (7, "one two three four"), (7, "one two three four"), (9, None)]
    got = jaccard.near_duplicates(documents(rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(3, 3), (5, 3), (7, 7), (7, 7), (9, 9)]
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard.near_duplicates(documents([])).collect() == []


@pytest.mark.parametrize("num,den", [(85, 100), (4, 5), (1, 2)])
def test_difference_bound(num, den):
    limit = Limit(num, den)
    for a in range(1, 60):
        for b in range(a, 60):
            for common in range(1, a + 1):
                if limit.linked(common, a, b):
                    assert a + b - 2 * common <= limit.differences(a + b)
                    assert limit.smallest(b) <= a and b <= limit.largest(a)


@pytest.mark.parametrize("exact,near", [(14, 0), (20, 0), (6, 4), (0, 7), (1, 6)])
def test_every_allocation_finds_all_links(exact, near):
    """Sets with at most 12 differences always share a key, whatever is rare."""
    rng = np.random.default_rng(3)
    limit = Limit(85, 100)
    plan = [Scheme(12, 64, 80, None, limit.differences(160), exact, near)]
    assert plan[0].most == 12
    for _ in range(200):
        base = rng.integers(0, 2**63, 80).astype(np.uint64)
        other = base.copy()
        k = int(rng.integers(0, 7))
        other[:k] = rng.integers(0, 2**63, k).astype(np.uint64)
        drop = int(rng.integers(0, 13 - 2 * k)) if k < 6 else 0
        a, b = np.sort(base), np.sort(other[: 80 - min(drop, 12 - 2 * k)])
        hot = np.sort(rng.choice(base, 40, replace=False))
        if not limit.linked(len(np.intersect1d(a, b)), len(a), len(b)):
            continue
        sets = jaccard.Sets(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        keys, docs = jaccard.keys_of(sets, plan, hot, limit)
        assert np.intersect1d(keys[docs == 0], keys[docs == 1]).size


def test_last_groups_are_sized_by_the_rows_they_get(spark, rng, tmp_path, monkeypatch):
    """A key of many unlinked members: every group of the last step stays near GROUP_ROWS, and the few links are found."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "GROUP_ROWS", 500)
    real, log = jaccard._across, str(tmp_path / "rows")

    def across(limit):
        run = real(limit)

        def logged(group):
            with open(log, "a") as file:
                file.write(f"{len(group)}\n")
            return run(group)
        return logged

    monkeypatch.setattr(jaccard, "_across", across)
    grams = [sorted(rng.sample(range(1, 1 << 60), 60)) for _ in range(400)]
    want = {(2 * k + 1, 2 * k + 2) for k in range(100, 140)}
    for a, b in want:
        grams[b] = sorted([*grams[a][:58], *grams[b][:2]])
    flat = np.array([g for one in grams for g in one], np.uint64)
    sketch = jaccard.sketches(jaccard.Sets(flat, np.arange(0, len(flat) + 1, 60))).view(np.int64).reshape(400, -1)
    sets = spark.createDataFrame([(i, 60, sketch[i].tolist(), grams[i]) for i in range(400)], "id long, n long, sketch array<long>, grams array<long>")
    found = spark.createDataFrame([(1, i) for i in range(400)], "key long, id long")
    linked, part = jaccard._connect(found, sets, Limit(85, 100), 1_000_000)
    assert {(r.src, r.dst) for r in linked.collect()} == want
    sizes = [int(n) for n in open(log)]
    assert sum(sizes) >= 400 * 20 and max(sizes) <= 1_000


def test_one_of_each_with_clashing_names(spark):
    text = "a b c d e f g h"
    docs = spark.createDataFrame([(2, text, 1, 2, 3, 4, 5), (1, text, 6, 7, 8, 9, 0), (3, "x", 1, 1, 1, 1, 1)],
                                 "doc_id long, text string, _gone int, gone int, row int, own int, again int")
    out = jaccard.one_of_each(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]
