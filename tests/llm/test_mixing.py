"""Mix of sources: targets against a loop, draws against their rules."""

import hashlib
import math
import re
from collections import defaultdict

import pytest

from caselens.llm import mixing
from caselens.llm.queries import QUERIES


def loop_targets(sizes, share=1.0, most=3.0):
    """Reshare the excess by weight until no source is above its room."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: float(i % 3 + 1) for i, s in enumerate(order)}
    total, open_ones, target = share * sum(sizes.values()), set(order), {}
    while open_ones:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_ones)
        over = {s for s in open_ones if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_ones}
        target |= {s: most * sizes[s] for s in over}
        open_ones -= over
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(docs, rows, sources, **how):
    got = mixing.mix(docs, **how).collect()
    sizes = defaultdict(int)
    for (_, text), s in zip(rows, sources, strict=True):
        sizes[s] += words(text)
    want = loop_targets(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.size * r.times and 0 <= r.times <= 3
        epochs = int(r.target // r.source_size) if r.source_size else 0
        assert epochs <= r.times <= epochs + 1
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert want[s] - largest[s] <= taken[s] <= want[s] + 1e-6
    return {(r.doc_id, r.size): r.times for r in got}, got, taken, want


@pytest.mark.parametrize("spread", [(1, 1), (1, 400)])
def test_targets_and_draw(documents, rng, spread):
    rows, sources = [], []
    for i in range(600):
        s = rng.choice(["a", "b", "ä", "Z", "z", None, "", "tiny"] + ["big"] * 8)
        if s == "tiny" and rng.random() < 0.9:
            s = "big"
        rows.append((i, " ".join(["w"] * rng.randint(*spread))))
        sources.append(s)
    docs = documents(rows, 5, source=sources)
    first, got, taken, want = check(docs, rows, sources)
    again, _, _, _ = check(documents(rows[::-1], 2, source=sources[::-1]), rows, sources)
    assert first == again
    small, _, _, _ = check(docs, rows, sources, cell_rows=40)
    assert sum(small.values()) > 0
    # With many small documents the gap is small.
    assert taken["big"] == pytest.approx(want["big"], rel=0.02)


def test_sources_that_stop_pass_their_excess_on(documents):
    sizes = {"a": 9_000, "b": 10, "c": 5}
    rows, sources = [], []
    for s, n in sizes.items():
        for k in range(n):
            rows.append((len(rows), "w"))
            sources.append(s)
    got = mixing.mix(documents(rows, 3, source=sources)).collect()
    target = {r.source: r.target for r in got}
    assert target["b"] == 30 and target["c"] == 15 and target["a"] == pytest.approx(9_015 - 45)


def test_weights_draw_first(spark, documents):
    rows = [(i, "w w") for i in range(4_000)]
    sources = ["a"] * 2_000 + ["b"] * 2_000
    good = spark.range(0, 4_000, 2).selectExpr("id as doc_id", "4.0D as weight")
    got = mixing.mix(documents(rows, 4, source=sources), weights=good).where("source = 'a'").collect()
    drawn = [r.doc_id % 2 == 0 for r in got if r.times]
    assert len(drawn) == pytest.approx(1_333, abs=2)
    assert 850 < sum(drawn) < 950  # of 1,000 each: as the chances of the weights 4 and 1 are
    never = good.selectExpr("doc_id", "-1.0D as weight")
    got = mixing.mix(documents(rows, 4, source=sources), weights=never).where("source = 'a'").collect()
    assert sum(r.times for r in got if r.doc_id % 2) == 1_000


def test_empty_null_and_repeated(documents):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a b"), (4, "a b"), (None, "c d e")]
    got = mixing.mix(documents(rows, 2, source=["s"] * 5 + [None])).collect()
    assert {r.doc_id: r.size for r in got} == {1: 0, 2: 0, 3: 0, 4: 2, None: 3}
    assert len(got) == 6 and sum(r.taken for r in got) <= 7
    assert mixing.mix(documents([])).collect() == []
    zero = mixing.mix(documents([(1, None), (2, "")], 1, source=["a", "b"])).collect()
    assert [(r.target, r.taken) for r in zero] == [(0.0, 0), (0.0, 0)]


def test_repeated_rows_are_written_out(documents):
    rows = [(i, "w " * (i + 1)) for i in range(30)]
    docs = documents(rows, 2, source=["a", "b", "c"] * 10)
    mixed = mixing.mix(docs)
    out = mixing.repeated(docs, mixed)
    assert out.columns == docs.columns
    times = {r.doc_id: r.times for r in mixed.collect() if r.times}
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == times


@pytest.mark.parametrize("large", [1_500, 3_000])
def test_later_rows_fill_the_gap_behind_a_long_document(documents, large):
    """The draw is the one of going through a source's rows in order and taking each that still fits."""
    def key(i):
        return -math.log((int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16) + 0.5) / 2**48)

    size = {i: 1 + i % 7 for i in range(1_200)}
    order = sorted(size, key=lambda i: (key(i), i))
    for at in (400, 500, 560):
        size[order[at]] = large
    rows, sources = [(i, " ".join(["w"] * n)) for i, n in size.items()], ["ab"[i % 2] for i in size]
    got = mixing.mix(documents(rows, 4, source=sources), share=0.5, cell_rows=80).collect()
    times = {r.doc_id: r.times for r in got}
    for s in "ab":
        members = [i for i in order if "ab"[i % 2] == s]
        r = next(r for r in got if r.source == s)
        epochs = int(r.target // r.source_size)
        gap = r.target - epochs * r.source_size
        for i in members:
            extra = size[i] <= gap
            gap -= extra * size[i]
            assert times[i] == epochs + extra, (s, i)
        assert gap < 1


def test_query_meets_the_target_beside_one_huge_document(spark, documents, tmp_path):
    rows = [(i, " ".join(["w"] * 10)) for i in range(3_000)] + [(9_000, " ".join(["w"] * 20_000))]
    documents(rows, 4, source=["abc"[i % 3] for i, _ in rows]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = QUERIES["op1_mix_sources"](spark, str(tmp_path)).collect()
    for s in "abc":
        own = [r for r in got if r.source == s]
        assert 0 <= own[0].target - sum(r.taken for r in own) < 10


def test_rows_without_words_are_taken_in_whole_epochs_only(documents):
    rows = [(i, "w " * 100 if i < 200 else None if i % 2 else " ") for i in range(400)]
    sources = ["a" if i < 100 else "c" if i >= 300 else "b" for i in range(400)]
    rows += [(500, "w"), (501, "")]
    got = mixing.mix(documents(rows, 3, source=sources + ["c", "c"])).collect()
    assert max(r.times for r in got) == 3 and {r.times for r in got if r.source == "c"} == {3}


def test_repeated_with_clashing_names(spark):
    names = "doc_id text source id times row own _id _times _copy size gap".split()
    docs = spark.createDataFrame([(i, "w " * (1 + i), "ab"[i % 2], *range(9)) for i in range(10)], names)
    mixed = mixing.mix(docs)
    out = mixing.repeated(docs, mixed)
    times = {r.doc_id: r.times for r in mixed.collect()}
    assert out.columns == names and sorted(tuple(r) for r in out.collect()) == sorted(
        tuple(r) for r in docs.collect() for _ in range(times[r.doc_id]))
