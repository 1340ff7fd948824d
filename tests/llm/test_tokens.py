"""Token files: codes, exact round trip, the encoder against the tokenizer itself."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from caselens.llm import huffman, tokens
from caselens.llm import words as W
from caselens.llm.queries.op6 import END_ID, VOCABULARY

tokenizers = pytest.importorskip("tokenizers")
PATH = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.mark.parametrize("n,v", [(0, 4), (1, 1), (9, 1), (500, 2), (500, 3), (60_000, 50_257), (5, 70_000), (300_000, 300)])
def test_codes_round_trip(n, v):
    rng = np.random.default_rng(n + v)
    ids = np.minimum((rng.pareto(0.8, n) * 3).astype(np.int64), v - 1)
    counts = np.bincount(ids, minlength=v)
    lengths = huffman.code_lengths(counts)
    assert lengths.max(initial=0) <= max(16, int(v - 1).bit_length())
    code = huffman.Code(lengths)
    payload, checkpoints, bits = code.pack(ids)
    assert len(payload) == -(-bits // 8) and (code.unpack(payload, checkpoints, n) == ids).all()
    if n > 1_000:
        p = counts[counts > 0] / n
        assert bits / n <= -(p * np.log2(p)).sum() + 0.6


def test_lengths_are_best_under_the_limit():
    counts = np.array([2**k for k in range(12)])
    free, tight = huffman.code_lengths(counts, 20), huffman.code_lengths(counts, 5)
    assert free.max() == 11 and tight.max() == 5
    assert sum(2.0 ** -int(x) for x in tight) <= 1
    # Every other assignment of lengths up to 5 in order of the counts costs as much or more.
    best, stack = [np.inf], [(0, 0.0, 0, 0)]
    order = counts[::-1]
    while stack:
        i, used, cost, last = stack.pop()
        if i == len(order):
            best.append(cost)
            continue
        for size in range(max(1, last), 6):
            if used + 2.0**-size + (len(order) - i - 1) * 2.0**-5 <= 1:
                stack.append((i + 1, used + 2.0**-size, cost + size * order[i], size))
    assert min(best) == (counts * tight).sum()


def test_pieces_equal_the_tokenizer(rng):
    whole = tokenizers.Tokenizer.from_file(PATH)
    encoder = tokens.PieceEncoder(PATH, END_ID, most_bytes=200_000)
    letters = ["a", "B", "é", "×", "ž", "s", "'s", "1", " ", " ", " ", "\n", "\n", ".", ",", "!", "'", "\t", "\r", "\x1c", " ", " ", "中",
               "\U0001F600", "<|endoftext|>"]
    texts = ["", " ", "a ", " a", "a  b", *("".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(20_000))]
    for k in range(0, len(texts), 4_000):
        part = texts[k:k + 4_000]
        ids, sizes = encoder(*W.texts_buffer(pa.array(part, pa.string())))
        want = [e.ids + [END_ID] for e in whole.encode_batch(part, add_special_tokens=False)]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_words_go_to_the_model(monkeypatch):
    encoder, asked = tokens.PieceEncoder(PATH, END_ID), []
    whole = encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda texts: asked.extend(texts) or whole(texts))
    texts = ["Words überall, and žý. So", " nine9 × ÷", "", "é", " ", "a×b çÇ"]
    ids, sizes = encoder(*W.texts_buffer(pa.array(texts)))
    want = [whole([t])[0] + [END_ID] for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]
    assert sorted(asked) == sorted({",", ".", " nine9", " ×", " ÷", " ", "a×b"})


def test_added_tokens_of_letters_are_found(tmp_path):
    whole = tokenizers.Tokenizer.from_file(PATH)
    whole.add_tokens(["foo"])
    whole.save(str(tmp_path / "t.json"))
    encoder = tokens.PieceEncoder(str(tmp_path / "t.json"), END_ID)
    assert not encoder.plain and tokens.PieceEncoder(PATH, END_ID).plain
    ids, _ = encoder(*W.texts_buffer(pa.array(["a xfooy"])))
    assert ids.tolist() == whole.encode("a xfooy").ids + [END_ID]


def brute(rows):
    whole = tokenizers.Tokenizer.from_file(PATH)
    out, at = [], 0
    coded = [(i, np.array(whole.encode(t or "", add_special_tokens=False).ids + [END_ID], "<u4")) for i, t in rows]
    for i, ids in sorted(coded, key=lambda x: (x[0] is not None, x[0] or 0, x[1].astype("<u2").tobytes())):
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        at += len(ids)
    return out


def run(spark, docs, tmp_path=None, **how):
    path = tokens.tokenize(docs, PATH, end_id=END_ID, vocabulary=VOCABULARY)
    got = tokens.read(spark, path, ids=True).collect()
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got), key=lambda r: r[1])


def test_files_round_trip(spark, documents, vocabulary, rng, monkeypatch):
    rows = [(i, " ".join(vocabulary(rng.randint(0, 200)))) for i in range(120)]
    rows += [(130, None), (131, ""), (132, " ".join(vocabulary(30_000))), (133, "  x \n\n y"), (5, "again"), (5, "again"), (None, "no id")]
    rng.shuffle(rows)
    assert run(spark, documents(rows, 4)) == brute(rows)


def test_blocks_and_parts(spark, documents, vocabulary, rng):
    rows = [(i, " ".join(vocabulary(rng.randint(0, 60)))) for i in range(200)]
    encoded = tokens.materialize(tokens.encode(documents(rows, 5), PATH, end_id=END_ID), "t")
    path = tokens.new_path(spark, "tokens")
    tokens.write(encoded, path, vocabulary=VOCABULARY, block_ids=300, part_ids=5_000)
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.count() > 30 and blocks.select("part").distinct().count() > 2
    got = sorted(tuple(r) for r in tokens.read(spark, path).select("start", "doc_id", "n_tokens", "ids_crc32").collect())
    assert got == [(at, i, n, crc) for i, at, n, crc, _ in brute(rows)]


def test_no_documents(spark, documents):
    assert run(spark, documents([])) == []
