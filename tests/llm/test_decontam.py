"""Suffix automaton decontamination against a search for every window."""

import hashlib
import re

import pytest

from caselens.llm import decontam

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(rows, items, window=13):
    windows = {}
    for name, text in items:
        w = words(text)
        size = min(len(w), window)
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add(str(name))
    sizes = {len(w) for w in windows}
    out = []
    for i, text in rows:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                names = windows.get(tuple(w[k:k + n]))
                if names:
                    hit |= set(range(k, k + n))
                    found |= names
        ids = ",".join(sorted(found))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(docs, bench, **how):
    rows = decontam.report(docs, bench, **how).collect()
    return sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows], key=str)


@pytest.fixture
def case(spark, rng, vocabulary):
    items = [(i, " ".join(vocabulary(rng.choice([1, 2, 3, 5, 12, 13, 14, 20, 40])))) for i in range(30)]
    items += [(30, None), (31, "--- !"), (32, items[5][1]), (33, "a a a a a a a a a a a a a a a"), (34, "x y"), (35, items[-1][1])]
    rows = []
    for i in range(150):
        parts = [" ".join(vocabulary(rng.randint(0, 80)))]
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items)[1] or "").split(" ")
            a = rng.randint(0, max(0, len(w) - 13))
            parts += [rng.choice(["", ", ", "\n"]).join(["", " ".join(w[a:a + rng.choice([4, 12, 13, 30])]).upper(), ""]), " ".join(vocabulary(rng.randint(0, 60)))]
        rows.append((i, " ".join(parts)))
    rows += [(500, None), (501, ""), (502, " . "), (503, "a " * 40), (504, "X-y"), (None, items[3][1]), (7, items[3][1])]
    return rows, items, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, spans int")


def test_equals_brute_force(documents, case):
    rows, items, bench = case
    want = brute(rows, items)
    assert sum(w[2] > 0 for w in want) > 40 and sum(w[5] for w in want) > 10
    docs = documents(rows)
    assert run(docs, bench) == want
    assert run(docs, bench, automaton_words=60) == want  # several automata, one after the other


def test_no_items_no_documents(spark, documents, case):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = [(1, "some words"), (2, None)]
    assert run(documents(rows), none) == brute(rows, [])
    assert run(documents([]), case[2]) == []


def test_spans_are_cut(spark, documents, vocabulary):
    passage, rest = vocabulary(80), [vocabulary(400), vocabulary(600)]
    bench = spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string")
    dirty = " ".join(rest[0][:200] + passage[:30] + rest[0][200:])          # 7 % hit: goes
    short = " ".join(rest[1] + passage[:13])                                # 2 % hit, short: stays as it is
    long = "é " + " ".join(rest[1] + rest[0]) + " \n " + " ".join(passage[:52]) + "! " + " ".join(["end"] * 400)  # 3.6 %, long
    docs = documents([(1, dirty), (2, short), (3, long), (4, None), (5, "clean words")])
    out = decontam.decontaminate(docs, bench)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {2: short, 3: "é " + " ".join(rest[1] + rest[0]) + " \n ! " + " ".join(["end"] * 400), 4: None, 5: "clean words"}


def test_automaton_tells_longest_matches(rng):
    items = [(str(i), [rng.choice("abc") for _ in range(rng.randint(1, 30))]) for i in range(40)]
    machine = decontam.Automaton(items, window=4)
    stretches = {tuple(w[i:j]) for _, w in items for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    run = [rng.choice("abcd") for _ in range(400)]
    ends = {(end, size) for end, size, _ in machine.stream(run)}
    for end in range(1, len(run) + 1):
        hit = end >= 4 and tuple(run[end - 4:end]) in stretches
        assert ((end, 4) in ends) == hit
    assert len(machine.link) <= 2 * sum(len(w) for _, w in items) + 1
