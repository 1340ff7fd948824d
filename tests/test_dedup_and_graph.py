import itertools
import random

import pytest
from pyspark.sql import functions as F

from caselens.operators import dedup, graph, joins


def test_exact_and_chunked(spark):
    rows = [(1, "a", 0), (2, "a", 0), (3, "b", 0), (4, "a", 1), (5, "c", 1), (6, None, 1), (7, "", 2), (8, "c", 2)]
    df = spark.createDataFrame(rows, "id bigint, t string, chunk int")
    first = dedup.dedup_exact(df, text="t", case_id="id")
    assert sorted(r.id for r in first.collect()) == [1, 3, 5, 7]
    assert sorted(r.id for r in dedup.dedup_exact(first, text="t", case_id="id").collect()) == [1, 3, 5, 7]
    assert sorted(r.id for r in dedup.dedup_chunked(df, text="t", chunk="chunk").collect()) == [1, 2, 3, 5, 7]
    s = dedup.dedup_stats(df, text="t").first()
    assert (s.n_rows, s.n_null, s.n_distinct, s.n_dropped, s.n_repeated_texts) == (8, 1, 4, 3, 2)


def test_hot_texts_are_cut_before_the_shuffle(spark):
    df = spark.range(100).select("id", F.concat(F.lit("text "), F.col("id") % 3).alias("t"))
    plan = dedup.dedup_exact(df, text="t", case_id="id")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def near_copies(seed: int = 1) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    rows, key = [], 0
    for copies in (40, 12, 5, 1, 1, 1, 1, 3):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 120))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((key, " ".join(text)))
            key += 1
    rows += [(key, "one two"), (key + 1, "One  Two"), (key + 2, "alone"), (key + 3, ""), (key + 4, rows[0][1])]
    return rows


def brute_groups(rows, threshold):
    def shingles(text):
        w = text.lower().split()
        return {tuple(w[i:i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)}

    sets = {k: shingles(t) for k, t in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: find(k) for k in sets}


def test_near_duplicates_against_brute_force(spark):
    rows = near_copies()
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows + [(999, None)], "id bigint, t string")
    for hot_rows in (1_000_000, 10):
        got = dedup.near_dup_groups(df, case_id="id", text="t", threshold=0.6, hot_rows=hot_rows)
        assert {r.id: r.group_id for r in got.collect()} == brute_groups(rows, 0.6)


def changed(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"x{rng.random()}"
    return words


def test_chains_and_neighbours_apart(spark):
    """x is near A and y, y is not near A: all three are one group, whatever the order of the keys."""
    rng = random.Random(5)
    rows = []
    for _ in range(25):
        base = [f"v{rng.random()}" for _ in range(100)]
        near = changed(rng, base, 3)
        rows += [" ".join(base), " ".join(near), " ".join(changed(rng, near, 4)), " ".join(changed(rng, base, 12))]
    form = [f"f{i}" for i in range(150)]
    rows += [" ".join(changed(rng, form, rng.choice([2, 5, 6, 7, 9]))) for _ in range(60)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "id bigint, t string")
    want = brute_groups(rows, 0.8)
    for how in ({}, {"hot_rows": 7}, {"max_star_rounds": 0}):
        got = dedup.near_dup_groups(df, case_id="id", text="t", threshold=0.8, **how)
        assert {r.id: r.group_id for r in got.collect()} == want


def test_form_letters_are_not_compared_pair_by_pair(spark, monkeypatch):
    rng = random.Random(6)
    form = [f"f{i}" for i in range(200)]
    rows = [(i, " ".join(changed(rng, form, 8))) for i in range(5_000)]
    compared = []
    similar = dedup._similar

    def counted(pairs, *args):
        compared.append(pairs.count())
        return similar(pairs, *args)

    monkeypatch.setattr(dedup, "_similar", counted)
    got = dedup.near_dup_groups(spark.createDataFrame(rows, "id bigint, t string"), case_id="id", text="t", threshold=0.8)
    assert got.select("group_id").distinct().count() > 4_900
    assert sum(compared) <= 3 * len(rows)


def test_components(spark):
    rng = random.Random(3)
    ids = rng.sample(range(10_000, 99_999), 1300)
    chain, hub, cliques = ids[:1000], ids[1000:1200], [ids[1200:1210], ids[1210:1215]]
    edges = list(zip(chain, chain[1:])) + [(hub[0], h) for h in hub[1:]]
    for c in cliques:
        edges += list(itertools.combinations(c, 2))
    edges += [(5, 5)]
    rng.shuffle(edges)
    want = {k: min(g) for g in (chain, hub, *cliques) for k in g}
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    for hot_rows in (1_000_000, 50):
        got = graph.components(df, hot_rows=hot_rows)
        assert {r.id: r.component for r in got.collect()} == want
    assert graph.components(df.where("src = 5")).count() == 0


def test_components_by_ranges(spark):
    """Tasks join ranges of links: chains, hubs, rings and random links, of numbers and of texts."""
    rng = random.Random(8)
    ids = rng.sample(range(10_000, 99_999), 900)
    chain, hub, ring, loose = ids[:300], ids[300:500], ids[500:600], ids[600:]
    edges = list(zip(chain, chain[1:])) + [(max(hub), h) for h in hub] + list(zip(ring, ring[1:] + ring[:1]))
    edges += [tuple(rng.sample(loose, 2)) for _ in range(180)]
    rng.shuffle(edges)
    least = {}
    for a, b in edges:
        group = {k for k in least if least[k] in (least.get(a, a), least.get(b, b))} | {a, b}
        least |= dict.fromkeys(group, min(group))
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    for one_task, task_rows in ((0, 40), (0, 10_000), (100, 40)):
        got = graph.components(df, one_task=one_task, task_rows=task_rows, hot_rows=100)
        assert sorted(map(tuple, got.collect())) == sorted(least.items())
    got = graph.components(df.select(F.col("src").cast("string"), F.col("dst").cast("string")), one_task=0, task_rows=40)
    assert sorted(map(tuple, got.collect())) == sorted((str(k), str(v)) for k, v in least.items())


def test_long_chains_need_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph, "_large_star", lambda *_, **__: pytest.fail("a round of stars"))
    links = spark.range(40_000).select(F.col("id").alias("src"), (F.col("id") + 4).alias("dst"))
    got = graph.components(links, one_task=5_000).groupBy("component").count()
    assert sorted(map(tuple, got.collect())) == [(i, 10_001) for i in range(4)]


def test_salted_lookup_equals_the_plain_join(spark):
    facts = spark.range(1000).select(
        "id", F.when(F.col("id") % 10 < 7, F.lit(1)).when(F.col("id") % 10 == 7, F.lit(None)).otherwise(F.col("id")).alias("k"))
    dim = spark.createDataFrame([(1, "hot"), (8, "x"), (9, "y"), (5000, "z")], "k bigint, v string")
    for how in ("inner", "left"):
        got = joins.salted_lookup(facts, dim, key="k", spread_by=["id"], how=how, hot_rows=100)
        want = facts.join(dim, "k", how)
        assert sorted(map(str, got.select("k", "id", "v").collect())) == sorted(map(str, want.select("k", "id", "v").collect()))


def test_parity_and_values(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    b = spark.createDataFrame([(2,), (3,)], "id int")
    assert tuple(joins.parity(a, b, key="id").first()) == (3, 2, 1, 1, 1, 0)
    got = joins.map_values(spark.createDataFrame([("TX",), ("PR",)], "s string"), {"TX": "Texas"}, key="s", output="n", default="?")
    assert {r.s: r.n for r in got.collect()} == {"TX": "Texas", "PR": "?"}


@pytest.mark.parametrize("window", [10, 0])
def test_few_sets_and_shingles_are_moved(spark, monkeypatch, window):
    """Only sets of texts in pairs are joined, and shingles are counted once: where they lie, or, of more texts, by a join that reads the counts."""
    written, looked_up, plain, lookup = [], [], dedup.materialize, dedup.salted_lookup

    def kept(df, name="stage"):
        out = plain(df, name)
        written.append((name, out.count()))
        return out

    def seen(facts, dim, **how):
        looked_up.append(how)
        return lookup(facts, dim, **how)

    monkeypatch.setattr(dedup, "WINDOW", window)
    monkeypatch.setattr(dedup, "materialize", kept)
    monkeypatch.setattr(dedup, "salted_lookup", seen)
    words = [" ".join(f"w{i}.{j}" for j in range(40)) for i in range(60)]
    rows = [*enumerate(words), (100, words[7] + " more"), (101, "two of " + words[9])]
    groups = dedup.near_dup_groups(spark.createDataFrame(rows, "k long, t string"), case_id="k", text="t").collect()
    assert {r.k: r.group_id for r in groups} == {**{k: k for k, _ in rows}, 100: 7, 101: 9}
    asked = [n for name, n in written if name == "asked"]
    assert asked and max(asked) <= 4 and ("shingles", 62) in written
    assert any(name == "counts" for name, _ in written) == (not window)
    assert any(how.get("counted") for how in looked_up) == (not window)


def test_counted_lookup_cuts_hot_keys(spark):
    facts = spark.range(1_000).select(F.col("id").alias("f"), F.when(F.col("id") < 900, 0).otherwise(F.col("id")).alias("k"))
    dim = facts.groupBy("k").agg(F.count("*").alias("n"))
    found = joins.salted_lookup(facts, dim, key="k", spread_by=["f"], hot_rows=50, counted="n")
    assert sorted(map(tuple, found.select("f", "n").collect())) == [(i, 900 if i < 900 else 1) for i in range(1_000)]
