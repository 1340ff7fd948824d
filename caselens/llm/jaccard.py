"""Exact Jaccard self-join of documents over word n-grams.

Partition and pigeonhole (Deng et al., "An efficient partition based method for
exact set similarity joins", 2015), as a self-join without an index to probe:

* Sizes are cut into bands ``[2^k, 2^(k+1))``. Documents of one band meet in the
  band's scheme, those of neighbouring bands in the scheme of the edge between
  them, which only sizes near the edge take part in.
* Sets of sizes a and b with a Jaccard similarity of ``threshold`` or more differ
  in at most H(a, b) elements. A scheme deals the universe of n-grams into
  segments; an n-gram's segment is a hash of it.
* In ``exact`` segments the subset itself is a key. Of m such segments at least
  m - H agree. Each document leaves out the t = m - H - 1 segments that cost
  most, those with the fewest rare n-grams, in an order that only depends on
  the subset; the cheapest of the agreeing segments is then left out by neither.
* In ``near`` segments the subset and its one-deletion neighbourhood are keys;
  such a segment is only missed if it holds two differences, so it stands for
  two of the others.
* How many segments of each kind a scheme has is chosen per band by estimated
  cost: keys sent, and documents that share a key by chance because a subset
  holds no rare n-gram.

Documents with a common key are candidates. A sketch of each set (the parity of
its n-grams over 1,024 cells) bounds the difference of two sets from below; what
passes is verified on the n-gram sets. Equal sets are one class, of which one
document stands for all. Within a key, candidates are compared with one leader
first; documents found connected need no comparison any more; at last the
sketches of all members of a key that are still in different components are
compared, in blocks. Every link between different components is therefore
found, and no pair within one is asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.llm import words as W
from caselens.operators.graph import components
from caselens.operators.joins import salted_lookup
from caselens.runtime import broadcast_if_small, materialize

#: Keys in one bucket of the exchange, on average.
BUCKET_KEYS = 1 << 20
#: An n-gram in more than this share of the documents is not rare.
HOT_SHARE = 0.001
#: Cost of one candidate, in keys sent.
CANDIDATE_COST = 20.0
#: 64-bit words of a sketch; members of a key that are compared in one block; rows of a group of blocks.
SKETCH, BLOCK, GROUP_ROWS = 16, 2_048, 50_000


def _u64(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Limit:
    """Similarity of at least ``num / den``."""

    num: int
    den: int

    def differences(self, total: int) -> int:
        """Most elements in one set only, for sets with ``total`` elements together."""
        return (self.den - self.num) * total // (self.den + self.num)

    def largest(self, size: int) -> int:
        """Largest set that can be linked with one of ``size``."""
        return size * self.den // self.num

    def smallest(self, size: int) -> int:
        return -(-size * self.num // self.den)

    def linked(self, common: int, a: int, b: int) -> bool:
        return common > 0 and self.den * common >= self.num * (a + b - common)


@dataclass(frozen=True)
class Scheme:
    """Sizes ``low..high``; pairs differ in at most ``most`` elements; ``exact`` and ``near`` segments."""

    number: int
    low: int
    high: int
    edge: int | None  # the size from which on a document is on the upper side of the edge
    most: int
    exact: int
    near: int

    def own_most(self, size: int, limit: Limit) -> int:
        """Most differences of a set of ``size`` to any partner in the scheme."""
        top = min(self.high, limit.largest(size))
        if self.edge is not None and size >= self.edge:
            top = self.edge - 1
        return limit.differences(size + top)


def _blunt(load: float, skipped: float) -> float:
    """Share of the segments whose subset is kept and shared by chance, one without a rare n-gram counted as one.

    Rare n-grams fall on segments as ``load`` on average, and the poorest ``skipped`` of the segments are left out.
    """
    none, one = math.exp(-load), load * math.exp(-load)
    return max(0.0, none - skipped) + 0.02 * max(0.0, min(one, none + one - skipped))


def allocate(most: int, size: int, rare_share: float, docs: int) -> tuple[int, int]:
    """``(exact, near)`` segments of least estimated cost for sets of up to ``size`` elements.

    ``docs`` documents are in the scheme, and ``rare_share`` of their n-grams
    are rare; documents with half that share, and of half the size, count as much.
    """
    best, choice = math.inf, (most + 1, 0)
    weight = CANDIDATE_COST * min(1.0, math.log1p(docs) / 10)
    for near in sorted({0, 1, 2, (most + 1) // 4, (most + 1) // 2}):
        rest = most - 2 * near + 1  # keys of exact segments
        for spare in (0.1, 0.25, 0.5, 1.0, 2.0) if rest > 0 else (0.0,):
            exact = rest + math.ceil(rest * spare) if rest > 0 else 0
            cost = 0.0
            for part in (1.0, 0.5):  # of the size; the differences fall with it
                own = max(rest, 0) if part == 1 else max(0, most // 2 - 2 * near + 1)
                load = part * size / (exact + near)
                cost += near * (1 + load) + own
                for share in (rare_share, rare_share / 2):
                    rare = load * share
                    sparse = math.exp(-rare) * (1 + load * (1 + rare))  # a subset or a neighbour of it without a rare n-gram
                    cost += weight / 2 * (exact * _blunt(rare, 1 - own / exact if exact else 0.0) + near * sparse)
            if cost < best:
                best, choice = cost, (exact, near)
    return choice


def schemes(limit: Limit, bands: dict[int, tuple[int, float]]) -> list[Scheme]:
    """Schemes for the bands that occur: ``band -> (documents, share of rare n-grams)``.

    Sizes that can only be linked with equal sets need none.
    """
    out = []
    for k in sorted(bands):
        low, high = 1 << k, (1 << (k + 1)) - 1
        while low <= high and limit.largest(low) == low:
            low += 1
        docs, rare = bands[k]
        if low <= high:
            most = limit.differences(high + high)
            out.append(Scheme(2 * k, low, high, None, most, *allocate(most, high, rare, docs)))
        if k - 1 in bands:
            start = 1 << k
            low, high = limit.smallest(start), limit.largest(start - 1)
            if low < start <= high:
                most = limit.differences(start - 1 + high)
                both = docs + bands[k - 1][0]
                out.append(Scheme(2 * k + 1, low, high, start, most, *allocate(most, high, min(rare, bands[k - 1][1]), both)))
    return out


# --- sets of n-grams, as arrays ---------------------------------------------------------------------------------------

@dataclass
class Sets:
    """Sorted distinct n-grams of consecutive documents."""

    values: np.ndarray
    offsets: np.ndarray

    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.sizes())


def ngram_sets(words: W.Words, n: int) -> Sets:
    """Distinct ``n``-grams; of a text with fewer words the whole sequence, of one without words nothing."""
    hashes, counts = words.hashes(), words.counts()
    docs = len(counts)
    ok = W.within(words.offsets, n)
    owner = np.repeat(np.arange(docs), counts)
    values, owners = [W.windows(hashes, n, salt=n)[ok]], [owner[:len(ok)][ok]]
    for size in range(1, n):
        short = np.flatnonzero(counts == size)
        if len(short):
            every = W.windows(hashes, size, salt=size)
            values.append(every[words.offsets[short]])
            owners.append(short)
    value, of = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(value)
    order = order[np.argsort(of[order].astype(np.uint16 if docs < 1 << 16 else np.int64), kind="stable")]
    value, of = value[order], of[order]
    if len(value):
        first = np.concatenate([[True], (value[1:] != value[:-1]) | (of[1:] != of[:-1])])
        value, of = value[first], of[first]
    return Sets(value, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=docs))]))


def set_ids(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers that tell sets apart."""
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.zeros(len(sets.offsets) - 1, np.uint64)
        np.add.at(total, sets.owner(), W.mix(sets.values ^ _u64(salt)))
        out.append(W.mix(total + sets.sizes().astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def text_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, int, Sets]]:
    for a, b, words in W.batches(texts):
        yield a, b, ngram_sets(words, n)


def keys_of(sets: Sets, plan: list[Scheme], hot: np.ndarray, limit: Limit) -> tuple[np.ndarray, np.ndarray]:
    """``(key, document)`` of all documents in all their schemes."""
    sizes = sets.sizes()
    keys: list[np.ndarray] = []
    docs: list[np.ndarray] = []
    rare = np.ones(len(sets.values), np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, sets.values), len(hot) - 1)
        rare[hot[at] == sets.values] = 0
    for s in plan:
        own = np.flatnonzero((sizes >= s.low) & (sizes <= s.high))
        if not len(own):
            continue
        count = sizes[own]
        local = np.repeat(np.arange(len(own)), count)
        at = np.repeat(sets.offsets[own] - (np.cumsum(count) - count), count) + np.arange(len(local))
        value = sets.values[at]
        salt = _u64(0x9E3779B97F4A7C15 * (2 * s.number + 1))
        spread = W.mix(value ^ salt)
        segments = s.exact + s.near
        segment = ((spread >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
        cell = local * segments + segment
        weight = W.mix(spread + _u64(0xD1B54A32D192ED03))
        total = np.zeros(len(own) * segments, np.uint64)
        np.add.at(total, cell, weight)
        rares = np.bincount(cell, rare[at], minlength=len(total)).astype(np.int64)
        which = np.tile(np.arange(segments, dtype=np.uint64), len(own))
        key = W.mix(total + W.mix(which + salt))
        holder = np.repeat(np.arange(len(own)), segments)
        most = np.array([s.own_most(int(x), limit) for x in count]) - 2 * s.near
        if s.exact:
            exact = np.flatnonzero(which < s.exact)
            # The dearest first: fewest rare n-grams, then by key, so equal subsets rank alike everywhere.
            order = exact[np.lexsort((key[exact], rares[exact], holder[exact]))]
            rank = np.arange(len(order)) - np.repeat(np.arange(len(own)) * s.exact, s.exact)
            kept = order[rank >= (s.exact - most - 1)[holder[order]]]
            keys.append(key[kept])
            docs.append(own[holder[kept]])
        if s.near:
            whole = np.flatnonzero(which >= s.exact)
            keys.append(key[whole])
            docs.append(own[holder[whole]])
            member = np.flatnonzero(segment >= s.exact)
            less = total[cell[member]] - weight[member]
            keys.append(W.mix(less + W.mix(segment[member].astype(np.uint64) + salt)))
            docs.append(own[local[member]])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(docs)


# --- the join ---------------------------------------------------------------------------------------------------------

def _signatures(n: int):
    """Size and identity of every set; per batch the n-grams that many of its distinct sets hold."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.smaller(rows):
            seen: set[tuple[int, int]] = set()
            values: list[np.ndarray] = []
            out = []
            for a, b, sets in text_sets(batch.column(1), n):
                one, two = set_ids(sets)
                sizes = sets.sizes()
                new = np.zeros(b - a, bool)
                for i, pair in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
                    if pair not in seen:
                        seen.add(pair)
                        new[i] = True
                values.append(sets.values[np.repeat(new, sizes)])
                out.append((batch.column(0).slice(a, b - a), sizes, one, two))
            at_least = max(8, math.ceil(len(seen) * HOT_SHARE / 2))
            every = np.sort(np.concatenate(values)) if values else np.zeros(0, np.uint64)
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
            count = np.diff(np.append(first, len(every)))
            many = count >= at_least
            for i, (ids, sizes, one, two) in enumerate(out):
                hot, times = ([every[first[many]].view(np.int64).tolist()], [count[many].tolist()]) if i == 0 else ([None], [None])
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(sizes), pa.array(one), pa.array(two),
                     pa.array(hot + [None] * (len(ids) - 1), pa.list_(pa.int64())),
                     pa.array(times + [None] * (len(ids) - 1), pa.list_(pa.int64()))],
                    ["doc_id", "n", "one", "two", "hot", "times"])
    return run


def _pack(bucket: np.ndarray, keys: np.ndarray, ids: np.ndarray, shared: bool) -> Iterator[pa.RecordBatch]:
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, keys, ids = bucket[order], keys[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    end = np.append(first[1:], len(bucket))
    yield pa.RecordBatch.from_arrays(
        [pa.array(bucket[first].astype(np.int32)), pa.array([shared] * len(first), pa.bool_()),
         pa.array([keys[a:b].tobytes() for a, b in zip(first, end, strict=True)], pa.binary()),
         pa.array([ids[a:b].tobytes() for a, b in zip(first, end, strict=True)], pa.binary())],
        ["bucket", "shared", "keys", "ids"])


def _emit(n: int, plan: list[Scheme], hot: np.ndarray, limit: Limit, buckets: int):
    """Keys of a batch. Where documents of the batch share one, they are listed here and one of them goes on."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in W.smaller(rows):
            if len(seen) > 200_000:
                seen.clear()
            all_keys, all_ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            names = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, sets in text_sets(batch.column(1), n):
                one, two = set_ids(sets)
                fresh = np.zeros(b - a, bool)
                for i, pair in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
                    if pair not in seen:
                        seen.add(pair)
                        fresh[i] = True
                sizes = sets.sizes()
                kept = Sets(sets.values[np.repeat(fresh, sizes)], np.concatenate([[0], np.cumsum(sizes[fresh])]))
                keys, docs = keys_of(kept, plan, hot, limit)
                all_keys.append(keys)
                all_ids.append(names[a:b][fresh][docs].astype(np.int64))
            keys, ids = np.concatenate(all_keys), np.concatenate(all_ids)
            order = np.lexsort((ids, keys))
            keys, ids = keys[order], ids[order]
            if not len(keys):
                continue
            first = np.concatenate([[True], keys[1:] != keys[:-1]])
            group = np.cumsum(first) - 1
            several = (np.bincount(group) > 1)[group]
            yield from _pack((keys[first] >> np.uint64(44)).astype(np.int64) % buckets, keys[first], ids[first], False)
            # Listed rows go anywhere, so that a key that many documents share is in no bucket as a whole.
            anywhere = (W.mix(ids[several].view(np.uint64) ^ keys[several]) % np.uint64(buckets)).astype(np.int64)
            yield from _pack(anywhere, keys[several], ids[several], True)
    return run


def _meet(group: pa.Table) -> pa.Table:
    """The keys of a bucket that came from several batches, and the rows listed before."""
    def joined(name: str, rows: pa.Table, kind) -> np.ndarray:
        return np.concatenate([np.zeros(0, kind)] + [np.frombuffer(x.as_buffer(), kind) for x in rows[name]])

    shared = group["shared"].to_numpy()
    listed, single = group.filter(pa.array(shared)), group.filter(pa.array(~shared))
    keys, ids = joined("keys", single, np.uint64), joined("ids", single, np.int64)
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    same = keys[1:] == keys[:-1]
    several = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(keys) else np.zeros(0, bool)
    keys = np.concatenate([keys[several], joined("keys", listed, np.uint64)])
    ids = np.concatenate([ids[several], joined("ids", listed, np.int64)])
    return pa.table({"key": keys.view(np.int64), "id": ids})


def sketches(sets: Sets) -> np.ndarray:
    """Parity of the number of n-grams in each of ``64 * SKETCH`` cells, one row of words per set.

    Two sets differ in at least as many elements as their sketches differ in bits.
    """
    cells = 64 * SKETCH
    cell = (W.mix(sets.values ^ _u64(0xA4093822299F31D0)) % _u64(cells)).astype(np.int64)
    odd = np.bincount(sets.owner() * cells + cell, minlength=(len(sets.offsets) - 1) * cells) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, cells), axis=1).view(np.uint64)


def links(pairs: DataFrame, sets: DataFrame, limit: Limit) -> DataFrame:
    """The pairs ``src, dst`` whose sets (``id, n, sketch, grams``) are similar enough."""
    left = sets.select(F.col("id").alias("src"), F.col("n").alias("n_a"), F.col("sketch").alias("a"))
    right = sets.select(F.col("id").alias("dst"), F.col("n").alias("n_b"), F.col("sketch").alias("b"))
    apart = F.aggregate(F.zip_with("a", "b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    near = apart * (limit.den + limit.num) <= (F.col("n_a") + F.col("n_b")) * (limit.den - limit.num)
    close = materialize(pairs.join(left, "src").join(right, "dst").where(near).select("src", "dst").distinct(), "close")
    left = sets.select(F.col("id").alias("src"), F.col("grams").alias("a"))
    right = sets.select(F.col("id").alias("dst"), F.col("grams").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    return (close.join(left, "src").join(right, "dst")
            .where((common > 0) & (common * limit.den >= (F.size("a") + F.size("b") - common) * limit.num))
            .select("src", "dst").distinct())


def _across(limit: Limit):
    """Pairs of a block in different components whose sketches are near enough; with sides, only pairs across them."""
    def run(group: pa.Table) -> pa.Table:
        key, ident, part = group["block"].to_numpy(), group["id"].to_numpy(), group["component"].to_numpy()
        order = np.argsort(key, kind="stable")
        key, ident, part = key[order], ident[order], part[order]
        size, side = group["n"].to_numpy()[order], group["side"].to_numpy()[order]
        words = group["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH)[order]
        n = len(key)
        count = np.searchsorted(key, key, "right") - np.arange(n) - 1
        total = np.concatenate([[0], np.cumsum(count)])
        out: list[np.ndarray] = []
        done = 0
        while done < n:
            end = max(done + 1, int(np.searchsorted(total, total[done] + 500_000, "right")) - 1)
            i = np.repeat(np.arange(done, end), count[done:end])
            j = i + 1 + np.arange(len(i)) - (total[i] - total[done])
            done = end
            other = (part[i] != part[j]) & ((side[i] < 0) | (side[i] != side[j]))
            i, j = i[other], j[other]
            for k in range(0, len(i), 100_000):
                x, y = i[k:k + 100_000], j[k:k + 100_000]
                apart = np.bitwise_count(words[x] ^ words[y]).sum(1, dtype=np.int64)
                near = apart * (limit.den + limit.num) <= (size[x] + size[y]) * (limit.den - limit.num)
                pair = np.sort(np.stack([ident[x[near]], ident[y[near]]], 1), axis=1)
                out.append(np.unique(pair, axis=0))
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pa.table({"src": pairs[:, 0], "dst": pairs[:, 1]})
    return run


def near_duplicates(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    n: int = 4,
    threshold: tuple[int, int] = (85, 100),
    bucket_keys: int = BUCKET_KEYS,
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; a component is its least id.

    A document's set holds its distinct ``n``-grams of words (runs without
    ASCII white space, A-Z in lower case), or its whole word sequence if it has
    fewer words. Two documents are linked if the sets' common part is at least
    ``threshold`` of their union. Null, empty and blank texts have no words and
    are linked with nothing. Ids are integers; rows that repeat an id are one
    document with several texts, and a null id gives a null component. Other
    columns are not looked at. No rows give no rows.
    """
    spark = docs.sparkSession
    limit = Limit(*threshold)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = materialize(rows.mapInArrow(
        W.lean(_signatures(n)), "doc_id long, n long, one long, two long, hot array<long>, times array<long>"), "signatures")

    # Not rare: held by HOT_SHARE of the documents. Their number is at most 2 / HOT_SHARE times the mean size.
    total, n_rows = signed.agg(F.sum("n"), F.count("*")).first()
    listed = signed.where("hot is not null").select(F.explode(F.arrays_zip("hot", "times")).alias("h"))
    hot_rows_found = (listed.groupBy(F.col("h.hot").alias("gram")).agg(F.sum("h.times").alias("times"))
                      .where(F.col("times") >= max(8, n_rows * HOT_SHARE / 2)).select("gram").toArrow())
    hot = np.sort(hot_rows_found["gram"].to_numpy().view(np.uint64))
    # The share of rare n-grams is taken over all documents, as it only steers the allocation.
    held = listed.agg(F.sum("h.times")).first()[0] or 0
    rare = max(0.02, 1 - held / max(total or 0, 1))
    bands = {r["band"]: (r["docs"], rare) for r in signed.where("n > 0").groupBy(
        F.floor(F.log2("n") + 1e-9).cast("int").alias("band")).agg(F.count("*").alias("docs")).collect()}
    plan = schemes(limit, bands)
    buckets = 1
    while buckets * bucket_keys < 0.3 * (total or 0):
        buckets *= 2

    # Equal sets are one class, known by its least id.
    sized = signed.select("doc_id", "n", F.struct("one", "two").alias("set"))
    least = sized.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("rep"))
    nodes = salted_lookup(sized, least, key="set", spread_by=["doc_id"], how="left", hot_rows=hot_rows)
    nodes = materialize(nodes.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("rep")).otherwise(F.col("doc_id")).alias("rep")), "classes")

    found = materialize(
        rows.where("doc_id is not null").mapInArrow(W.lean(_emit(n, plan, hot, limit, buckets)), "bucket int, shared boolean, keys binary, ids binary")
        .groupBy("bucket").applyInArrow(W.lean_group(_meet), "key long, id long"), "keys")
    ids = found.select(F.col("id").alias("doc_id")).distinct()
    named = nodes.join(broadcast_if_small(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("rep").alias("rep"))
    found = materialize(
        found.join(broadcast_if_small(named), found["id"] == named["doc_id"]).select("key", F.col("rep").alias("id")).distinct(), "keys")

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.smaller(batches):
            for a, b, sets in text_sets(batch.column(1), n):
                grams = pa.ListArray.from_arrays(pa.array(sets.offsets.astype(np.int32)), pa.array(sets.values.view(np.int64)))
                words = sketches(sets)
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(0, words.size + 1, SKETCH, dtype=np.int32)), pa.array(words.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sets.sizes()), sketch, grams], ["id", "n", "sketch", "grams"])

    wanted = found.select(F.col("id").alias("doc_id")).distinct()
    grams = materialize(rows.join(broadcast_if_small(wanted), "doc_id", "left_semi").mapInArrow(W.lean(as_sets), "id long, n long, sketch array<long>, grams array<long>"), "sets")

    linked, part = _connect(found, grams, limit, hot_rows)
    if part is None:
        return nodes.select("doc_id", F.col("n").alias("n_shingles"), F.col("rep").alias("component_id"))
    out = salted_lookup(nodes, part.select(F.col("id").alias("rep"), "component"), key="rep", spread_by=["doc_id"],
                        how="left", hot_rows=hot_rows)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def _connect(found: DataFrame, grams: DataFrame, limit: Limit, hot_rows: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Links between the documents that share a key (``key, id``), and the components (``id, component``)."""
    linked = part = None
    open_rows, last = found, None
    for turn in range(100):
        if part is None:
            at = open_rows.withColumn("component", F.col("id"))
        else:
            at = open_rows.join(part, "id", "left").withColumn("component", F.coalesce("component", "id"))
        at = materialize(at.select("key", "id", "component"), "open")
        sizes = at.groupBy("key", "component").agg(F.count("*").alias("c"))
        state = materialize(
            sizes.groupBy("key").agg(F.sum("c").alias("size"), F.sum(F.col("c") * F.col("c")).alias("inside"),
                                     F.count("*").alias("parts"))
            .where("parts > 1"), "open-keys")
        n_rows, pairs = state.agg(F.sum("size"), F.sum((F.col("size") * F.col("size") - F.col("inside")) / 2)).first()
        if not n_rows:
            break
        open_rows = salted_lookup(at, state.select("key"), key="key", spread_by=["id"], hot_rows=hot_rows)
        few = pairs <= 2 * n_rows
        stuck = last is not None and pairs > last / 2
        if few or stuck:
            # What is left: all members of a key in different components. A large key is dealt into parts, and every
            # two parts meet in a block of their own.
            parts = F.ceil(F.col("size") / BLOCK)
            dealt = state.agg(F.sum(F.col("size") * parts)).first()[0]  # rows: each one goes to a block for every part
            rows = salted_lookup(open_rows, state.select("key", parts.alias("parts")), key="key", spread_by=["id"], hot_rows=hot_rows)
            rows = rows.withColumn("p", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
            block = F.xxhash64("key", F.least("p", "q"), F.greatest("p", "q"))
            side = F.when(F.col("p") == F.col("q"), -1).otherwise((F.col("p") > F.col("q")).cast("int"))
            groups = max(1, int(dealt // GROUP_ROWS))
            rows = (rows.join(grams.select("id", "n", "sketch"), "id").select(block.alias("block"), side.alias("side"), "id", "component", "n", "sketch")
                    .withColumn("group", F.pmod("block", F.lit(groups))))
            edges = rows.groupBy("group").applyInArrow(W.lean_group(_across(limit)), "src long, dst long").distinct()
        else:
            rank = F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))
            lead = open_rows.groupBy("key").agg(
                F.min(F.struct(rank.alias("rank"), F.col("id").alias("lead"), F.col("component").alias("other"))).alias("first"))
            edges = salted_lookup(open_rows, lead.select("key", "first.lead", "first.other"), key="key", spread_by=["id"], hot_rows=hot_rows)
            edges = (edges.where("component <> other")
                     .select(F.least("id", "lead").alias("src"), F.greatest("id", "lead").alias("dst")).distinct())
        new = materialize(links(edges, grams, limit), "links")
        linked = new if linked is None else linked.unionByName(new)
        if new.limit(1).count():
            part = components(linked, hot_rows=hot_rows)
        if few or stuck:
            break
        last, open_rows = pairs, open_rows.select("key", "id")
    return linked, part


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` without near duplicates: of each component the document with the least id stays, columns as they are.

    Rows without an id, and rows whose texts have no words, stay. Rows that
    repeat an id that stays are one document if their texts are equal; one of
    them stays.
    """
    found = near_duplicates(docs, doc_id=doc_id, text=text, **how)
    gone = materialize(found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    # Rows travel as one column, so that no name of theirs can clash.
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("own"), F.col(text).alias("body"))
    kept = rows.join(broadcast_if_small(gone), F.col("own") == F.col("gone"), "left_anti")
    again = materialize(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("again")).count().where("count > 1").select("again"), "again")
    if again.limit(1).count():
        repeated = broadcast_if_small(again)
        same = F.col("own") == F.col("again")
        kept = kept.join(repeated, same, "left_anti").unionByName(
            kept.join(repeated, same, "left_semi").dropDuplicates(["own", "body"]))
    return kept.select("row.*")
