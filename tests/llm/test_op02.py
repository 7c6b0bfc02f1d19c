"""Packing: exact round trip of every id, no gaps, little padding, neighbours along the curve."""

import base64
import itertools
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from quire.llm.op02_hilbert_packing import hilbert, pack, token_ids


def check(spark, rows, size=2048):
    df = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, length int").repartition(3)
    pieces = [tuple(r) for r in pack(df, size).collect()]
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in rows:
        ids = exact.encode(t or "", add_special_tokens=False).ids + [1]
        want.setdefault(i, []).append(ids)
    seqs, docs = {}, {}
    for d, start, length, crc, n, seq, off in pieces:
        assert 0 < length and 0 <= off and off + length <= size
        assert any(len(x) == n and zlib.crc32(np.array(x[start:start + length], "<u4").tobytes()) == crc for x in want[d])
        seqs.setdefault(seq, []).append((off, length))
        docs.setdefault(d, []).append((start, length))
    for d, p in docs.items():                      # every id in one piece (of each repeated row)
        ids = sorted(i for s, n in p for i in range(s, s + n))
        assert ids == sorted(i for x in want[d] for i in range(len(x)))
    assert set(docs) == set(want)
    for p in seqs.values():                        # gapless from 0
        at = 0
        for off, n in sorted(p):
            assert off == at
            at += n
    full = [sum(n for _, n in p) for p in seqs.values()]
    assert sum(f != size for f in full) <= 1 and sorted(seqs) == list(range(len(seqs)))
    return pieces


def test_round_trip(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["été", "word", "12", "x", "\n", "日本"]) for _ in range(r.choice([0, 1, 50, 4000]))))
            for i in range(60)]
    rows += [(100, None), (101, ""), (None, "no id"), (102, "again"), (102, "again"), (103, "a <|endoftext|> b")]
    check(spark, rows)
    check(spark, rows, 64)


def test_empty_table(spark):
    assert check(spark, []) == []


def test_equal_texts_divide(spark):
    check(spark, [(i, "the same text for all") for i in range(300)], 32)


def test_ids_are_those_of_the_vocabulary_file():
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 97 == 0)]
    for c in points:
        x = f"a{chr(c)}1 {chr(c)}{chr(c)} b{chr(c)}  {chr(c)}\n's"
        assert token_ids(x).tolist() == exact.encode(x, add_special_tokens=False).ids + [1], hex(c)


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_every_point_by_unit_steps(dims, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    key = hilbert(points, bits)
    assert sorted(key) == list(range(len(points)))
    step = np.abs(np.diff(points[np.argsort(key)], axis=0)).sum(1)
    assert (step == 1).all()


def test_neighbours_are_alike(spark):
    r = random.Random(5)
    vocab = [[f"{k}w{i}" for i in range(60)] for k in "abcd"]
    rows = [(i, " ".join(r.choice(vocab[i % 4]) for _ in range(40))) for i in range(200)]
    pieces = sorted(check(spark, rows, 256), key=lambda p: (p[5], p[6]))
    order = [p[0] for p in pieces if p[1] == 0]
    same = np.mean([a % 4 == b % 4 for a, b in zip(order, order[1:])])
    assert same > 0.45                             # a quarter by chance; four random axes keep about half
