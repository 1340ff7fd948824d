"""Class-based language model: counts and base by hand, classes by likelihood, probabilities that sum to one."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from caselens.llm import brown

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), "\0"]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


@pytest.fixture
def rows(rng, vocabulary):
    """Two languages: words of one follow words of the same only."""
    out = []
    for i in range(300):
        mark = "o" if i % 2 else "x"
        out.append((i, " ".join(w + mark for w in vocabulary(rng.randint(0, 60)) + vocabulary(3) * 5)))
    return out + [(400, None), (401, ""), (402, "Ä ß b B"), (None, "no id"), (7, "again"), (403, " ".join(vocabulary(20_000)))]


@pytest.mark.parametrize("shipped", [1 << 18, 40])
def test_base_and_counts(documents, rows, shipped):
    counts = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    got = brown.report(documents(rows), shipped=shipped, types=30, tails=20, classes=6).collect()
    want = sorted((i is None, i or 0, len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), total, held(i),
                   sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in tokens(t))) for i, t in rows)
    have = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, r.held_out, r.base_score) for r in got)
    assert [x[:6] for x in have] == [x[:6] for x in want]
    assert np.allclose([x[6] for x in have], [x[6] for x in want], rtol=1e-10)


def test_score_does_not_depend_on_what_is_shipped_and_beats_the_base(documents, rows):
    docs = documents(rows)
    wide, narrow = ({(r.doc_id, r.n_tokens): (r.held_out, r.base_score, r.score) for r in brown.report(docs, types=300, tails=60, classes=8, **how).collect()}
                    for how in ({}, {"shipped": 400}))
    own = [k for k in wide if wide[k][0]]
    assert sum(wide[k][2] for k in own) > sum(wide[k][1] for k in own)
    assert np.mean([narrow[k][2] - wide[k][2] for k in wide]) == pytest.approx(0, abs=2)


def hashes_of(texts):
    import pyarrow as pa

    found = brown.W.words(*brown.W.texts_buffer(pa.array(texts, pa.large_string())))
    return found, found.hashes()


def test_probabilities_sum_to_one(documents, rows):
    model, counts = brown.train(documents(rows).where("doc_id is not null"), types=50, tails=20, classes=5)
    assert np.allclose((10**model.transition).sum(1), 1)
    words = {r.word: r.n for r in counts.collect()}
    place = model.classes.types.lookup.find(np.array(list(words), np.int64).view(np.uint64))
    assert (place >= 0).all()
    klass, n = model.classes.of_word[place], np.array(list(words.values()))
    for c in range(5):
        known = (n[klass == c] - model.discount).sum() / 10**model.log_size[c]
        unseen = model.unseen * (klass == c).sum() / model.words * 10**(model.log_unseen - model.log_size[c])
        if (klass == c).any():
            assert known + unseen == pytest.approx(1)
    assert model.unseen >= model.words


@pytest.mark.parametrize("shipped", [1 << 18, 60])
def test_scores_equal_brute_force(documents, rows, shipped):
    """Class bigrams, discounts and unknown words by hand, from the class of each word."""
    docs = documents(rows)
    train = [t for i, t in rows if not held(i)]
    model, counts = brown.train(docs.where("crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 7 <> 2"), types=30, tails=20, classes=6, shipped=shipped)
    found = brown.score(docs, model, counts).collect()
    every = sorted({w for _, t in rows for w in tokens(t)[:-1]})
    listed, hashes = hashes_of(every)
    klass = dict(zip(every, model.classes.of(listed, hashes)[0].tolist(), strict=True)) | {"\0": 6}
    n = Counter(t for text in train for t in tokens(text))
    pairs = np.zeros((7, 7))
    for text in train:
        for a, b in zip(["\0", *tokens(text)], tokens(text), strict=False):
            pairs[klass[a], klass[b]] += 1
    once, twice = (sum(v == x for w, v in n.items() if w != "\0") for x in (1, 2))
    discount = min(0.95, max(0.05, once / (once + 2 * twice)))
    unseen = max(once * (once - 1) / (2 * (twice + 1)), len(n))
    alone, kinds = (pairs.sum(0) + 1) / (pairs.sum() + 7), np.maximum((pairs > 0).sum(1), 1)

    def by_hand(text):
        out = 0.0
        for a, b in zip(["\0", *tokens(text)], tokens(text), strict=False):
            c, d = klass[a], klass[b]
            out += math.log10((pairs[c, d] + kinds[c] * alone[d]) / (pairs[c].sum() + kinds[c]))
            out += math.log10((n[b] - discount if n[b] else discount * len(n) / unseen) / max(pairs[:, d].sum(), 1))
        return out

    assert np.allclose(sorted(r.score for r in found), sorted(by_hand(t) for _, t in rows), rtol=1e-9)


def test_best_class_is_the_one_of_the_greatest_likelihood():
    rng = np.random.default_rng(5)
    pairs = rng.poisson(0.6, (31, 31)).astype(float)
    pairs[30, 30] = 0
    at = np.append(rng.integers(0, 4, 30), 4)

    def both(classes):
        one = np.eye(5)[classes]
        return one.T @ pairs @ one

    one = np.eye(5)[at]
    got = brown.best_classes(both(at), at[:30], (pairs @ one)[:30], (one.T @ pairs).T[:30], np.diagonal(pairs)[:30])
    for w in range(30):
        tried = [brown.likelihood(both(np.concatenate([at[:w], [c], at[w + 1:]]))) for c in range(4)]
        assert tried[got[w]] == pytest.approx(max(tried))


def test_words_beyond_the_first_are_clustered(documents, rng):
    """Two kinds of words alternate; endings say nothing, and only ten words are settled one after another."""
    kinds = [[f"{a}{i}q" for i in range(60)] for a in "xy"]
    rows = [(i, " ".join(rng.choice(kinds[k % 2]) for k in range(40))) for i in range(200)]
    docs = documents(rows)
    gains = []
    for rounds in (0, 2):
        model, counts = brown.train(docs, types=10, tails=5, classes=4, rounds=rounds)
        gains.append(sum(r.score for r in brown.score(docs, model, counts).collect()))
    listed, hashes = hashes_of(kinds[0] + kinds[1])
    klass = model.classes.of(listed, hashes)[0]
    assert gains[1] > gains[0] and not set(klass[:60]) & set(klass[60:])


def test_exchange_finds_the_classes():
    rng = np.random.default_rng(2)
    truth = np.arange(60) % 3
    follows = np.array([[0.9, 0.05, 0.05], [0.05, 0.9, 0.05], [0.05, 0.05, 0.9]])
    pairs = np.zeros((61, 61))
    for a in range(60):
        for b in range(60):
            pairs[a, b] = rng.poisson(4 * follows[truth[a], truth[b]])
    pairs[60, :60] = pairs[:60, 60] = 1

    def likelihood(at):
        one = np.eye(4)[at]
        both = one.T @ pairs @ one
        return brown._f(both).sum() - brown._f(both.sum(0)).sum() - brown._f(both.sum(1)).sum()

    # Start of exchange: by rank, in turn.
    at = brown.exchange(pairs, 3)
    assert at[60] == 3 and likelihood(at) >= likelihood(np.append(truth, 3)) - 1e-6
    assert all(len(set(at[:60][truth == k])) == 1 for k in range(3))


def test_no_documents(spark, documents):
    assert brown.report(documents([])).collect() == []
