"""Benchmark decontamination: size-partitioned MinHash containment search.

A document is contaminated by a test item when it holds at least 80 % of the item's distinct
5-word shingles (words are runs of letters and digits, A-Z lower-cased; an item of one to four words
is one shingle, matched only by a document of just these words).

A short item inside a long document has almost no Jaccard similarity with it, so the search
compares things of like size. Items are partitioned by shingle count, 2**k to 2**(k+1)-1.
For each size class a document is read in blocks of 2**(k+1) shingles, and every two
neighbouring blocks form a window: a passage of the item's size lies whole in one of them, with a
Jaccard similarity of 0.19 or more. Window and item are compared by MinHash values, one
row a band, as many as keep the chance of missing such a pair under ``miss``
(44 at 0.0001). Block minima of the larger classes come from those of the smaller ones.
Every candidate is then verified by exact shingle containment in the whole document.

The item table is the query set: it is cut into blocks of a bounded number of shingles
(``block``), and each block is broadcast and run against all documents in one pass
without a shuffle. Documents are never collected, and long ones are read whole.

Cases: null or empty texts, or texts without words, match nothing on either side. Null ids are kept as
they are; repeated rows each give their own result rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm import _text as T
from quire.llm._tables import stored, tidied

WORDS = 5
PERCENT = 80


def hash_count(miss: float, percent: int = PERCENT) -> int:
    """MinHash values needed for the least similarity of a class: percent of 2**k in 2**(k+2)."""
    t = percent / 100
    return int(np.ceil(np.log(miss) / np.log1p(-t / (4 + 1 - t))))


def seeds(m: int) -> np.ndarray:
    return np.random.default_rng(77).integers(1, 2**63, m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def permuted(h: np.ndarray, seed: np.uint64) -> np.ndarray:
    x = h * seed
    return x ^ (x >> np.uint64(32))


def shingle_rows(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) in text order."""
    start, end, row = T.words(buf, offs, T.PUNCT)
    h = T.word_hash(buf, start, end)
    at, s = T.windows(h, row, WORDS)
    where = row[at]
    n = np.bincount(row, minlength=len(offs) - 1)
    few = np.flatnonzero((n > 0) & (n < WORDS))
    if len(few):
        first = np.searchsorted(row, few)
        whole = np.zeros(len(few), np.uint64)
        for j in range(WORDS - 1):
            more = n[few] > j
            whole[more] = whole[more] * T.CHAIN + h[first[more] + j]
        s = np.concatenate((s, T.mix(whole ^ n[few].astype(np.uint64))))
        where = np.concatenate((where, few))
        turn = np.argsort(where, kind="stable")
        where, s = where[turn], s[turn]
    return where, s


class Index:
    """A block of items: shingle sets, and per size class the sorted MinHash values."""

    def __init__(self, ids: list, sets: list[np.ndarray], miss: float, percent: int):
        self.ids, self.sets, self.percent = ids, sets, percent
        self.seeds = seeds(hash_count(miss, percent))
        self.classes: dict[int, list] = {}
        size = np.array([len(s) for s in sets])
        for k in sorted({int(n).bit_length() - 1 for n in size if n}):
            own = np.flatnonzero((size >= 1 << k) & (size < 2 << k))
            tables = []
            for seed in self.seeds:
                low = np.array([permuted(sets[i], seed).min() for i in own], np.uint64)
                turn = np.argsort(low, kind="stable")
                tables.append((low[turn], own[turn]))
            self.classes[k] = tables

    def candidates(self, where: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Distinct (row, item) pairs, as row * number of items + item."""
        n_items, found = np.int64(len(self.sets)), []
        if not len(s) or not self.classes:
            return np.zeros(0, np.int64)
        local = np.arange(len(where)) - np.searchsorted(where, where)
        levels = []                                              # (class, starts in the level below, row of block)
        pos, rows = local, where
        size = 1
        for k in self.classes:
            block = 2 << k
            key = pos // (block // size)
            start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (rows[1:] != rows[:-1]))))
            pos, rows, size = key[start], rows[start], block
            levels.append((k, start, rows))
        for j, seed in enumerate(self.seeds):
            low = permuted(s, seed)
            for k, start, rows in levels:
                low = np.minimum.reduceat(low, start)
                win = low.copy()                                 # a block and the next one of its row
                win[:-1] = np.where(rows[1:] == rows[:-1], np.minimum(low[:-1], low[1:]), low[:-1])
                values, items = self.classes[k][j]
                a = np.searchsorted(values, win)
                hit = np.flatnonzero(values[np.minimum(a, len(values) - 1)] == win)
                if len(hit):
                    b = np.searchsorted(values, win[hit], "right")
                    n = b - a[hit]
                    turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a[hit], n)
                    found.append(np.unique(np.repeat(rows[hit], n) * n_items + items[turn]))
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def matches(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, shared shingles) of the verified pairs."""
        where, s = shingle_rows(buf, offs)
        pairs = self.candidates(where, s)
        row, item = np.divmod(pairs, max(1, len(self.sets)))
        shared = np.zeros(len(pairs), np.int64)
        last, own = -1, None
        for i, (r, q) in enumerate(zip(row, item)):
            if r != last:
                a, z = np.searchsorted(where, [r, r + 1])
                last, own = r, np.unique(s[a:z])
            mine = self.sets[q]
            at = np.minimum(np.searchsorted(own, mine), len(own) - 1)
            shared[i] = int((own[at] == mine).sum())
        size = np.array([len(x) for x in self.sets], np.int64)
        ok = 100 * shared >= self.percent * size[item] if len(pairs) else np.zeros(0, bool)
        return row[ok], item[ok], shared[ok]


def _item_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, buf, offs in T.slices(batches):
        where, s = shingle_rows(T.LOWER[buf], offs)
        cut = np.searchsorted(where, np.arange(rows.num_rows + 1))
        sets = [np.unique(s[cut[i]: cut[i + 1]]) for i in range(rows.num_rows)]
        yield pa.RecordBatch.from_arrays([rows.column(0), T.lists(sets)], ["item_id", "shingles"])


def item_blocks(items: DataFrame, block: int, miss: float, percent: int):
    """The item table as broadcast indexes of about ``block`` shingles each, one after another."""
    spark = items.sparkSession
    sets = stored(items.select("item_id", "text").mapInArrow(_item_sets, "item_id long, shingles array<long>")
                  .where(F.size("shingles") > 0), "items")
    total = sets.agg(F.sum(F.size("shingles").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // block))
    for b in range(blocks):
        rows = sets.where(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(blocks)) == b).orderBy("item_id").collect()
        yield spark.sparkContext.broadcast(Index(
            [r["item_id"] for r in rows], [np.array(r["shingles"], np.int64).view(np.uint64) for r in rows], miss, percent))


def _pairs(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for rows, buf, offs in T.slices(batches):
            r, q, shared = ix.matches(T.LOWER[buf], offs)
            size = np.array([len(ix.sets[i]) for i in q], np.int64)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(r)), pa.array([ix.ids[i] for i in q], pa.int64()), pa.array(size),
                 pa.array(shared), pa.array(shared / np.maximum(size, 1))],
                ["doc_id", "item_id", "n_item", "n_shared", "containment"])
    return run


def contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT, miss: float = 1e-4,
                 block: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every document and test item in it."""
    out = None
    for index in item_blocks(items, block, miss, percent):
        part = docs.select("doc_id", "text").mapInArrow(
            _pairs(index), "doc_id long, item_id long, n_item long, n_shared long, containment double")
        out = part if out is None else out.unionByName(part)
    return out


def _clean(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in T.slices(batches):
            keep = np.ones(rows.num_rows, bool)
            keep[index.value.matches(T.LOWER[buf], offs)[0]] = False
            yield rows.filter(pa.array(keep))
    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT, miss: float = 1e-4,
                      block: int = 2_000_000) -> DataFrame:
    """The rows of ``docs``, all columns, without those that hold a test item."""
    for index in item_blocks(items, block, miss, percent):
        docs = docs.mapInArrow(tidied(_clean(index)), docs.schema)
    return docs
