"""Line join against brute force."""

import re

import numpy as np
import pyarrow as pa
import pytest

from caselens.llm import lines

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    own = []
    for i, text in rows:
        for n, line in enumerate((text or "").split("\n"), 1):
            words = frozenset(re.findall(r"[^\x20\x09-\x0D]+", line.translate(LOWER)))
            if words:
                own.append((i, n, words))
    own.sort(key=lambda x: x[:2])
    gone = {(i, n) for k, (i, n, a) in enumerate(own) if any(
        5 * len(a & b) >= 4 * len(a | b) for j, m, b in own[:k] if (j, m) != (i, n))}
    return {i: (sum(j == i for j, _, _ in own), sum(j == i for j, _ in gone), ",".join(str(n) for n in sorted(n for j, n in gone if j == i)))
            for i, _ in rows}


def run(docs, **how):
    return {r.doc_id: (r.n_lines, r.n_removed, r.removed) for r in lines.report(docs, **how).collect()}


def family(rng, sentence, n, size):
    base = sentence(size)
    for _ in range(n):
        words = list(base)
        for at in rng.sample(range(size), rng.choice([0, 1, 2, size // 6])):
            words[at] = sentence(1)[0]
        rng.shuffle(words)
        yield " ".join(words)


@pytest.fixture
def texts(rng, vocabulary):
    pool = [line for _ in range(12) for line in family(rng, vocabulary, rng.randint(3, 30), rng.randint(3, 60))]
    pool += [" ".join(vocabulary(rng.randint(1, 40))) for _ in range(200)] + ["a b c d", "a b c d e", "the", "THE", "the  the", "", " \t"] * 3
    rng.shuffle(pool)
    return ["\n".join(pool[i:i + 5]) for i in range(0, len(pool), 5)]


def test_equals_brute_force(documents, texts):
    want = brute(list(enumerate(texts)))
    assert sum(w[1] for w in want.values()) > 60
    assert run(documents(texts)) == want


def test_few_first_candidates_many_buckets(documents, texts):
    """Most lines then need the comparison with all others."""
    assert run(documents(texts, 7), first=1, all_up_to=1, bucket_entries=50, shipped=20) == brute(list(enumerate(texts)))


def test_parts_of_frequent_words():
    """Entries of a word that are dealt into parts still meet, each pair of lines at least once."""
    texts = pa.array(["\n".join(["one two", "two one", "one two three"] * 20)], pa.large_string())
    known = lines._batch_lines(pa.array(["one two three"]), None).value
    order = lines.Order(known, np.array([3, 3, 3]) * lines.PART_ROWS)
    own = lines._batch_lines(texts, order)
    _, entries = lines._entries(own, np.arange(60), np.arange(60, dtype=np.uint64) << np.uint64(32), order, 4, 5)
    assert (order.parts(known) == 4).all() and len(entries) == 4 * 60
    early, late, _ = lines.candidates(entries, 4, 5, None)
    assert len(early) == 0
    entries["at"] |= lines._SLOW
    early, late, _ = lines.candidates(entries, 4, 5, None)
    pairs = set(zip(early["doc"].tolist(), late["doc"].tolist(), strict=True))
    assert pairs == {(i, j) for i in range(60) for j in range(i + 1, 60) if (i % 3 == 2) == (j % 3 == 2)}


def test_order_is_by_id_not_by_arrival(documents):
    rows = [(9, "one two three four five"), (2, "one two three four five six"), (5, "one two three four five")]
    assert run(documents(rows)) == {9: (1, 1, "1"), 2: (1, 0, ""), 5: (1, 1, "1")}


def test_nulls_ties_and_long_lines(documents, vocabulary):
    long = " ".join(vocabulary(20_000))
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, long), (5, "x y\n" + long + " z"), (None, long), (7, "q r"), (7, "q r")]
    got = lines.report(documents(rows)).collect()
    found = {r.doc_id: (r.n_lines, r.removed) for r in got}
    assert found[1] == found[2] == found[3] == (0, "") and found[4] == (1, "") and found[5] == (2, "2")
    assert found[None] == (None, None) and [r.removed for r in got if r.doc_id == 7] == ["", ""]
    assert lines.report(documents([])).collect() == []


def test_clean_keeps_columns(documents):
    docs = documents([(1, "same line here\nown words"), (2, "other\nsame line here\n"), (3, None)])
    out = {r.doc_id: r.text for r in lines.clean(docs).collect()}
    assert out == {1: "same line here\nown words", 2: "other\n", 3: None}
    assert lines.clean(docs).columns == docs.columns


def test_clean_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e\nf g h i j", 5, 6, 7), (2, "a b c d e\nk", 5, 6, 7)],
                                 "doc_id long, text string, _gone int, gone int, row int")
    out = lines.clean(docs)
    assert out.columns == docs.columns and {r.doc_id: r.text for r in out.collect()} == {1: "a b c d e\nf g h i j", 2: "k"}


def test_only_lines_asked_for_are_looked_at(monkeypatch):
    """Of a long text whose lines 2 and 4 are asked for, no other line is cut into words."""
    seen = []
    own_words = lines.W.words

    def words(data, *how, **more):
        seen.append(len(data))
        return own_words(data, *how, **more)

    monkeypatch.setattr(lines.W, "words", words)
    texts = ["x y\n" * 5_000, "a b\n\u00e9 B\n" + "c " * 5_000 + "\nlast One", "", None, "one\n", "end"]
    asked = [[], [4, 2, 2], [1], [1], [2, 1, 7], [1]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts), pa.array(asked, pa.list_(pa.int32()))], ["doc", "text", "lines"])
    own = lines._asked(batch, None)
    assert sum(seen) < 100
    assert list(zip(own.text.tolist(), own.number.tolist(), strict=True)) == [(1, 2), (1, 4), (4, 1), (5, 1)]
    whole = lines._batch_lines(pa.array(texts), None)
    want = {(t, n): whole.value[a:b].tolist() for t, n, a, b in zip(whole.text.tolist(), whole.number.tolist(), whole.start[:-1], whole.start[1:], strict=True)}
    got = {(t, n): own.value[a:b].tolist() for t, n, a, b in zip(own.text.tolist(), own.number.tolist(), own.start[:-1], own.start[1:], strict=True)}
    assert got == {at: want[at] for at in got}


def test_lines_that_meet_by_several_words_are_one_pair():
    texts = pa.array(["a b c d e f g h i j k l", "a b c d e f g h i j k m"])
    own = lines._batch_lines(texts, None)
    _, entries = lines._entries(own, np.arange(2), np.arange(2, dtype=np.uint64) << np.uint64(32), lines.Order(own.value[:0], np.zeros(0, np.int64)), 4, 5)
    early, late, more = lines.candidates(entries, 4, 5, 6)
    assert early["doc"].tolist() == [0] and late["doc"].tolist() == [1] and not len(more)


def test_words_that_occur_once_are_counted_together(documents):
    docs = documents(["a b c", "a a d", None, ""])
    counts = lines.word_counts(docs, "text", ends=False, singly=False, buckets=1).collect()
    assert sorted((r.word is None, r.n) for r in counts) == [(False, 3), (True, 3)]
    assert sorted(r.n for r in lines.word_counts(docs, "text").collect()) == [1, 1, 1, 3]
