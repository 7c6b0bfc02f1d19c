"""Hashed subword features of distinct words, shared by the word-level classifiers."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from quire.llm import _text as T

BUCKETS = 1 << 20


def fold(modulus: int):
    """crc32(doc_id as text) mod ``modulus``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


def lowered(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return T.raw(pc.utf8_lower(rows.column(rows.schema.get_field_index("text"))))


def word_features(buf: np.ndarray, start: np.ndarray, end: np.ndarray, grams: tuple[int, int],
                  affixes: int) -> tuple[np.ndarray, np.ndarray]:
    """(flat feature ids, offsets) of words given by their bytes: byte n-grams with word edges,
    prefixes and suffixes of up to ``affixes`` bytes, and the word itself."""
    n = end - start
    size = n + 2                                                 # an edge mark on both sides
    at = np.cumsum(size) - size
    total = int(size.sum())
    b = np.zeros(total, np.uint64)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    b[np.repeat(at + 1, n) + place] = T.BYTE[buf[np.repeat(start, n) + place]]
    owner = np.repeat(np.arange(len(n)), size)
    left = np.repeat(size, size) - (np.arange(total) - np.repeat(at, size))   # bytes from here to the end
    ids, own = [], []
    h = b.copy()
    for k in range(2, grams[1] + 1):                             # n-grams over edges and bytes
        h = h[:-1] * T.STEP + b[k - 1:]
        if k < grams[0]:
            continue
        ok = np.flatnonzero(left[: len(h)] >= k)
        ids.append(T.mix(h[ok] ^ np.uint64(k)) % np.uint64(BUCKETS))
        own.append(owner[ok])
    for k in range(1, affixes + 1):
        has = np.flatnonzero(n >= k)
        p = np.zeros(len(has), np.uint64)
        s = np.zeros(len(has), np.uint64)
        for j in range(k):
            p = p * T.STEP + T.BYTE[buf[start[has] + j]]
            s = s * T.STEP + T.BYTE[buf[end[has] - 1 - j]]
        for kind, x in ((11, p), (17, s)):
            ids.append(T.mix(x ^ np.uint64(kind * 100 + k)) % np.uint64(BUCKETS))
            own.append(has)
    ids.append(T.mix(T.word_hash(buf, start, end) ^ np.uint64(999)) % np.uint64(BUCKETS))
    own.append(np.arange(len(n)))
    own = np.concatenate(own)
    turn = np.argsort(own, kind="stable")
    return np.concatenate(ids)[turn].astype(np.int64), np.searchsorted(own[turn], np.arange(len(n)))


class Vocabulary(NamedTuple):
    flat: np.ndarray        # feature ids of the distinct words, one after another
    starts: np.ndarray      # where each distinct word's features begin
    back: np.ndarray        # distinct word of every word
    row: np.ndarray         # row of every word
    lettered: np.ndarray    # whether a distinct word holds anything but digits


def vocabulary(buf: np.ndarray, offs: np.ndarray, grams: tuple[int, int] = (2, 4), affixes: int = 4) -> Vocabulary:
    start, end, row = T.words(buf, offs, T.PUNCT)
    h = T.word_hash(buf, start, end)
    _, pick, back = np.unique(h, return_index=True, return_inverse=True)
    flat, at = word_features(buf, start[pick], end[pick], grams, affixes)
    n = end[pick] - start[pick]
    inside = np.repeat(start[pick], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    digit = (buf[inside] >= 48) & (buf[inside] <= 57)
    lettered = np.add.reduceat((~digit).astype(np.int64), np.cumsum(n) - n) > 0 if len(n) else n > 0
    return Vocabulary(flat, at, back, row, lettered)
