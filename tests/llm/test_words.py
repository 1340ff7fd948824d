"""Words as arrays against patterns."""

import re

import numpy as np
import pyarrow as pa

from caselens.llm import words as W

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_words_equal_patterns(rng):
    letters = "aB1 \t\n\x0b\x0c\r\x1c é中-_.\x7f"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(3_000)] + [None, "", " "]
    for member, pattern in ((W.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (W.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        seen = {}
        for a, b, own in W.batches(pa.array(texts), member):
            hashes = own.hashes()
            for i, text in enumerate(texts[a:b]):
                want = re.findall(pattern, (text or "").translate(LOWER))
                at = range(own.offsets[i], own.offsets[i + 1])
                assert [own.word(k) for k in at] == want
                for k, w in zip(at, want, strict=True):
                    assert seen.setdefault(w, hashes[k]) == hashes[k]
        assert len(set(seen.values())) == len(seen)


def test_slices_and_lookup():
    offsets = np.array([0, 5, 5, 30, 31, 40])
    assert list(W.slices(offsets, 10)) == [(0, 2), (2, 3), (3, 5)]
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 5_000).astype(np.uint64))
    rng.shuffle(keys)
    found = W.Lookup(keys)
    assert (found.find(keys) == np.arange(len(keys))).all()
    assert (found.find(np.setdiff1d(rng.integers(0, 2**63, 5_000).astype(np.uint64), keys)) == -1).all()
    assert (W.Lookup(keys[:0]).find(keys) == -1).all()


def test_long_texts_are_hashed_in_blocks(rng):
    long = "".join(rng.choice("abcdefgh ") for _ in range(3 * W.BLOCK_BYTES)) + " " + "x" * (2 * W.BLOCK_BYTES) + " y"
    text = long + " " + long
    own = W.words(*W.texts_buffer(pa.array([text])))
    hashes, n = own.hashes(), len(long.split())
    assert len(hashes) == 2 * n and (hashes[:n] == hashes[n:]).all()
    few = W.words(*W.texts_buffer(pa.array([" ".join(long.split()[:50])])))
    assert (few.hashes() == hashes[:50]).all()
    assert all(len(t) <= W.BLOCK_BYTES + 1 for pair in W._POWERS.values() for t in pair)


def test_a_task_drops_what_others_kept():
    gone = []
    W.keep("a", lambda: gone.append("a"))
    W.keep("b", lambda: gone.append("b"))
    assert list(W.lean(lambda rows: rows, keeps="b")(iter([1]))) == [1] and gone == ["a"]
    assert list(W.lean(lambda rows: rows)(iter([2]))) == [2] and gone == ["a", "b"]
    W.lean_group(lambda group: group)(None)
    assert gone == ["a", "b"]
