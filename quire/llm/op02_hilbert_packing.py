"""Packing along a space-filling curve.

Documents are packed into sequences of ``size`` tokens so that documents in a sequence are
alike: each text's hashed word vector is projected to ``DIMS`` dimensions, the place in that space
becomes a Hilbert key, documents are range-sorted by it and laid end to end along the
curve; the line is cut every ``size`` tokens. Every sequence but the last is full, so
padding is below one sequence in all.

How it runs:

1. One pass tokenizes the whole texts and projects them; ids go to a stage table as 16-bit binaries.
2. One aggregation over the projections gives their mean and spread (2 * DIMS numbers), from
   which a place on the curve follows. Its low bits are a hash of the document, so that thousands of
   equal texts, which share a place, still divide into ranges.
3. Quantiles of the key cut the curve into ranges of even size; a sum per range (one row
   each) gives the number of tokens before every range.
4. One shuffle brings each range to a task, which sorts it, and cuts it into sequences.

Ids are those of the ``tokenizers`` library for ``byte_bpe_50k.json`` without special
tokens added, then ``END``. They are computed by ``tiktoken`` over the same vocabulary and pattern, about
five times as fast (equal on every Unicode code point, see the tests); a text that spells out
the vocabulary's special token goes through ``tokenizers`` itself.

Cases: null and empty texts are documents of the one id ``END``. Null ids are packed like others and come
last among equal keys; repeated rows are packed once each. Empty table: no pieces.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm import _text as T
from quire.llm._subwords import lowered
from quire.llm._tables import parts_for, stored, tidied, tokenizer_path

DIMS, BITS = 4, 11
SIZE, END = 2048, 1
SPECIAL = "<|endoftext|>"
VECTOR = 256


@lru_cache(maxsize=2)
def encoders(folder: str | None):
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer
    place = (lambda n: f"{folder}/{n}") if folder else tokenizer_path
    with open(place("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return fast, Tokenizer.from_file(place("byte_bpe_50k.json"))


def token_ids(text: str | None, folder: str | None = None) -> np.ndarray:
    fast, exact = encoders(folder)
    text = text or ""
    ids = exact.encode(text, add_special_tokens=False).ids if SPECIAL in text else fast.encode_ordinary(text)
    return np.array(ids + [END], np.uint16)


def projections(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(rows, DIMS): the hashed word vector of each text, normalised, on fixed random axes."""
    start, end, row = T.words(buf, offs, T.PUNCT)
    rows = len(offs) - 1
    slot = (T.word_hash(buf, start, end) % np.uint64(VECTOR)).astype(np.int64)
    v = np.sqrt(np.bincount(row * VECTOR + slot, minlength=rows * VECTOR).reshape(rows, VECTOR))
    v /= np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)
    return v @ np.random.default_rng(31).normal(size=(VECTOR, DIMS))


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (n, d) with coordinates below 2**bits."""
    x = x.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:                                                 # undo the turns of the sub-cubes
        p = q - 1
        for i in range(d):
            turn = (x[i] & q) != 0
            swap = np.where(turn, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(turn, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[d - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _encode(folder: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in T.slices(batches):
            p = projections(*lowered(rows))
            ids = [token_ids(t, folder) for t in rows.column(1).to_pylist()]
            n = np.array([len(x) for x in ids], np.int64)
            crc = np.array([zlib.crc32(x.tobytes()) for x in ids], np.int64)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(n), pa.array(crc), pa.FixedSizeListArray.from_arrays(p.ravel(), DIMS).cast(
                    pa.list_(pa.float64())), pa.array([x.tobytes() for x in ids], pa.binary())],
                ["doc_id", "n", "crc", "place", "ids"])
    return run


def _keys(mean: np.ndarray, spread: np.ndarray):
    """Hilbert place and document hash: 44 + 16 bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index("place")
            if not b.num_rows:
                continue
            p = np.asarray(b.column(i).flatten()).reshape(-1, DIMS)
            z = np.clip((p - mean) / spread, -6, 6)
            u = 1 / (1 + np.exp(-1.702 * z))                     # spreads a bell evenly over the cube
            key = hilbert(np.minimum((u * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))
            key = (key << 16) | np.asarray(b.column(b.schema.get_field_index("tie"))).astype(np.int64)
            rest = [k for k in range(b.num_columns) if b.schema.names[k] not in ("place", "tie")]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in rest] + [pa.array(key)],
                                             [b.schema.names[k] for k in rest] + ["key"])
    return run


PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _cut(before: dict[int, int], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = None, 0
        for b in batches:
            out = [[] for _ in range(7)]
            parts, ns, ids = b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3)
            for doc, p, n, raw in zip(b.column(1).to_pylist(), parts, ns, ids):
                if p != part:
                    part, at = p, before[p]
                wide = np.frombuffer(raw.as_buffer(), np.uint16).astype("<u4")
                start = 0
                while start < n:
                    seq, off = divmod(at, size)
                    length = min(size - off, n - start)
                    for col, x in zip(out, (doc, start, length, zlib.crc32(wide[start: start + length].tobytes()), n, seq, off)):
                        col.append(x)
                    start += length
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out],
                                             [f.split()[0] for f in PIECES.split(", ")])
    return run


def pack(docs: DataFrame, size: int = SIZE, folder: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    rows = stored(docs.select("doc_id", "text").mapInArrow(
        tidied(_encode(folder)), "doc_id long, n long, crc long, place array<double>, ids binary"), "tokens")
    stats = rows.agg(F.count("*").alias("rows"), *[f(F.col("place")[i]).alias(f"{g}{i}") for i in range(DIMS)
                                                    for f, g in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
    if not stats["rows"]:
        return spark.createDataFrame([], PIECES)
    mean = np.array([stats[f"m{i}"] for i in range(DIMS)])
    spread = np.maximum([stats[f"s{i}"] for i in range(DIMS)], 1e-9)
    tie = F.pmod(F.xxhash64("doc_id", "crc", "n"), F.lit(1 << 16)).alias("tie")
    narrow = stored(rows.select("doc_id", "n", "crc", "place", tie).mapInArrow(
        tidied(_keys(mean, spread)), "doc_id long, n long, crc long, key long").select("n", "key"), "keys")
    ranges = parts_for(rows, 8)
    marks = narrow.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)] or [0.5],
                                           max(10_000, 20 * ranges)).alias("q")).first()["q"]
    marks = sorted(set(marks)) if ranges > 1 else []
    bounds = spark.sparkContext.broadcast(np.array(marks, np.int64))

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = np.searchsorted(bounds.value, np.asarray(b.column(b.schema.get_field_index("key"))), "left")
            yield pa.RecordBatch.from_arrays(list(b.columns) + [pa.array(part.astype(np.int64))], b.schema.names + ["part"])

    place = _keys(mean, spread)
    sums = narrow.mapInArrow(tidied(ranged), "n long, key long, part long").groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    before, total = {}, 0
    for r in sums:                                               # one number per range
        before[r["part"]] = total
        total += r["n"]
    keyed = rows.select("doc_id", "n", "crc", "ids", "place", tie)
    line = (keyed.mapInArrow(tidied(lambda batches: ranged(place(batches))),      # one worker for both steps
                             "doc_id long, n long, crc long, ids binary, key long, part long")
            .repartition(ranges, "part").sortWithinPartitions("part", "key", F.col("doc_id").asc_nulls_last(), "crc", "n", "ids")
            .select("part", "doc_id", "n", "ids"))
    return line.mapInArrow(tidied(_cut(before, size)), PIECES)
