"""Hard negatives from an inverted multi-index, certified exact.

Method. A vector's components become floor(256 * x). Its two halves are coded by two k-means codebooks; a
pair of codes is a cell. For an anchor, a code's half-score bound is the inner product of the anchor's half
with the centre plus the half's norm times the code's radius (the largest distance of any row of the table
to its centre), so no row of a cell scores above the sum of its two bounds. A heap visits an anchor's cells
by falling sum (multi-sequence order). A search ends when the bound of the next cell lies below all that is
still wanted: below the fifth score found (ties need the cell, as a smaller vec_id wins), or below the
window. First the five best rows of the anchor's label are certified (the positives), then for each
positive the five best rows of other labels with 80 * positive <= 100 * negative <= 100 * positive.

How it runs. The codebooks are fitted on the driver, on a sample of at most SAMPLE vectors; every row is
indexed. Cells (at most CODES squared) are dealt to buckets of about BUCKET rows, a larger cell to several.
Anchors near each other form blocks. A round takes each open anchor's next cells, up to a number of rows
that grows eightfold a round, and meets blocks with the buckets they touch in tasks of one block and one
bucket; a task returns at most five rows an anchor and positive. Rounds and stage tables live in the shared
folder. What is broadcast are codebooks, radii and the cell directory, bounded by CODES.

Odd cases. Null labels or vectors, null or non-finite components: the row takes no part, nor does a row
without vec_id. A vec_id held by several rows stands for the one with the smallest label, then vector.
Shorter vectors count as filled up with zeros. Components beyond 32 bits stop there. Equal scores go by the
smaller vec_id. A negative positive score has an empty window. An empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quire.llm._tables import stored, tidied

SAMPLE = 16_384          # vectors the codebooks are fitted on
CODES = 256              # most codes of a half
CELL = 64                # rows a cell aims at, until CODES is reached
BUCKET = 2_048           # rows of a bucket
BLOCK_BUCKETS = 32       # buckets whose anchors form a block
FIRST = 16_384           # rows an anchor visits in the first round
GROWTH = 8
PARTNERS = 5
ANCHOR_EVERY, MOVED_EVERY, LABELS = 100, 7, 10
LOW, HIGH = 80, 100
INT_MAX = 2**31 - 1


class Index(NamedTuple):
    """Codebooks, radii of their codes, and the directory of cells: rows, first bucket and buckets of each."""
    dims: int
    centres: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    count: np.ndarray
    first: np.ndarray
    parts: np.ndarray


def points(vectors: DataFrame) -> DataFrame:
    """vec_id, label and the integer vector of the rows that take part, one row a vec_id."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    whole = F.transform(x, lambda v: F.floor(F.least(F.greatest(v.cast("double") * 256, F.lit(-INT_MAX - 1.0)), F.lit(float(INT_MAX)))).cast("int"))
    label = F.when(F.col("vec_id") % MOVED_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).cast("long")
    return (vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~bad)
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(label.alias("label"), whole.alias("q")).alias("p"))
            .groupBy("vec_id").agg(F.min("p").alias("p")).select("vec_id", "p.label", "p.q"))


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    """A list<int32> column as a matrix, short rows filled up with zeros."""
    out = np.zeros((len(col), dims), np.int32)
    offs = col.offsets.to_numpy()
    flat = col.values.to_numpy(zero_copy_only=False)
    n = np.diff(offs)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(np.arange(len(col)), n), place] = flat[offs[0]: offs[-1]]
    return out


def _halves(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = q.shape[1] // 2
    return q[:, :cut].astype(np.float64), q[:, cut:].astype(np.float64)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres ** 2).sum(1) - 2 * (x @ centres.T), axis=1)


def codebook(x: np.ndarray, codes: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """k-means centres of ``x``, seeded."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(codes, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def fitted(pts: DataFrame, rows: int, sample: int = SAMPLE, codes: int = CODES) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
    """(dimensions, codebooks) from the ``sample`` rows whose vec_id hashes smallest."""
    dims = pts.agg(F.max(F.size("q"))).first()[0]
    drawn = pts.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("q").toArrow().column(0).combine_chunks()
    k = int(min(codes, max(1, np.ceil(np.sqrt(rows / CELL)))))
    a, b = _halves(_matrix(drawn, dims))
    return dims, (codebook(a, k), codebook(b, k))


def coded(pts: DataFrame, dims: int, centres: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """vec_id, label, vec (little-endian int32), cell, and the distance of each half to its centre."""
    held = pts.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column(2), dims)
            codes, far = [], []
            for x, c in zip(_halves(q), held.value):
                at = _nearest(x, c)
                codes.append(at)
                far.append(np.sqrt(((x - c[at]) ** 2).sum(1)) * (1 + 1e-9) + 1e-9)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([v.astype("<i4").tobytes() for v in q], pa.binary()),
                 pa.array((codes[0] * len(held.value[1]) + codes[1]).astype(np.int32)), pa.array(far[0]), pa.array(far[1])],
                names=["vec_id", "label", "vec", "cell", "far1", "far2"])

    return pts.select("vec_id", "label", "q").mapInArrow(tidied(run), "vec_id long, label long, vec binary, cell int, far1 double, far2 double")


def directory(rows: DataFrame, dims: int, centres: tuple[np.ndarray, np.ndarray]) -> Index:
    """Radii and buckets from one aggregate over the cells (at most CODES squared rows)."""
    k1, k2 = len(centres[0]), len(centres[1])
    count, radii = np.zeros(k1 * k2, np.int64), (np.zeros(k1), np.zeros(k2))
    for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far1").alias("a"), F.max("far2").alias("b")).collect():
        count[r.cell] = r.n
        radii[0][r.cell // k2] = max(radii[0][r.cell // k2], r.a)
        radii[1][r.cell % k2] = max(radii[1][r.cell % k2], r.b)
    first, parts = np.zeros(k1 * k2, np.int64), np.ones(k1 * k2, np.int64)
    bucket, held = 0, 0
    for c in np.flatnonzero(count):
        if held and held + count[c] > BUCKET:
            bucket, held = bucket + 1, 0
        first[c], parts[c] = bucket, max(1, -(-int(count[c]) // BUCKET))
        held += int(count[c])
        if parts[c] > 1:
            bucket, held = bucket + int(parts[c]), 0
    return Index(dims, centres, radii, count, first, parts)


def in_buckets(rows: DataFrame, index: Index) -> DataFrame:
    """``rows`` with their bucket; the rows of a large cell are dealt by a hash of vec_id."""
    held = rows.sparkSession.sparkContext.broadcast((index.first, index.parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, parts = held.value
        for batch in batches:
            cell = batch.column(3).to_numpy()
            salt = batch.column(4).to_numpy()
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], pa.array(first[cell] + salt % parts[cell])],
                                             names=["vec_id", "label", "vec", "cell", "bucket"])

    return (rows.select("vec_id", "label", "vec", "cell", F.expr("xxhash64(vec_id) & 9223372036854775807L").alias("salt"))
            .mapInArrow(tidied(run), "vec_id long, label long, vec binary, cell int, bucket long"))


def visits(q: np.ndarray, index: Index, skip: int, rows: int, need: float) -> tuple[list[int], int, float]:
    """(cells, cells seen so far, bound of the next cell) of an anchor: the cells after the first ``skip`` of
    its multi-sequence order, until they hold ``rows`` rows or no cell can reach ``need``."""
    bounds = []
    cut = index.dims // 2
    for x, c, r in zip((q[:cut], q[cut:]), index.centres, index.radii):
        b = c @ x + np.sqrt(x @ x) * r
        bounds.append(b + 1e-6 * (1 + np.abs(b)))
    order = [np.argsort(-b, kind="stable") for b in bounds]
    b1, b2 = bounds[0][order[0]], bounds[1][order[1]]
    heap = [(-(b1[0] + b2[0]), 0, 0)]
    seen, held, cells = 0, 0, []
    while heap:
        bound = -heap[0][0]
        if seen >= skip and (held >= rows or bound < need):
            return cells, seen, bound
        _, i, j = heapq.heappop(heap)
        if j + 1 < len(b2):
            heapq.heappush(heap, (-(b1[i] + b2[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(b1):
            heapq.heappush(heap, (-(b1[i + 1] + b2[0]), i + 1, 0))
        if seen >= skip:
            c = int(order[0][i]) * len(b2) + int(order[1][j])
            if index.count[c]:
                cells.append(c)
                held += int(index.count[c])
        seen += 1
    return cells, seen, -np.inf


PROBE = ("vec_id long, label long, vec binary, wants array<long>, block long, seen int, need double, "
         "bucket long, cells array<int>, bound double")


def planned(open_anchors: DataFrame, index: Index, rows: int) -> DataFrame:
    """One probe per anchor and bucket of its next cells, and one row with bucket null for its new state."""
    held = open_anchors.sparkSession.sparkContext.broadcast(index)
    cols = ["vec_id", "label", "vec", "wants", "block", "seen", "need"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = held.value
        for batch in batches:
            for r in batch.to_pylist():
                cells, seen, bound = visits(np.frombuffer(r["vec"], "<i4").astype(np.float64), ix, r["seen"], rows, r["need"])
                by: dict[int, list[int]] = {}
                for c in cells:
                    for b in range(int(ix.first[c]), int(ix.first[c] + ix.parts[c])):
                        by.setdefault(b, []).append(c)
                made = [{**r, "seen": seen, "bucket": b, "cells": by.get(b), "bound": bound} for b in [None, *by]]
                yield pa.RecordBatch.from_pylist(made, schema=pa.schema([
                    ("vec_id", pa.int64()), ("label", pa.int64()), ("vec", pa.binary()), ("wants", pa.list_(pa.int64())), ("block", pa.int64()),
                    ("seen", pa.int32()), ("need", pa.float64()), ("bucket", pa.int64()), ("cells", pa.list_(pa.int32())), ("bound", pa.float64())]))

    return open_anchors.select(*cols).mapInArrow(tidied(run), PROBE)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles while these are exact, else in 64 bits."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def met(probes: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """The best rows of one bucket for each anchor of one block: vec_id, want (0: of the same label, else the
    number of the positive), other_id, score; at most five each."""
    found: list[tuple] = []
    if len(probes) and len(rows):
        rows = rows.sort_values("vec_id", kind="stable")
        ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        r = np.frombuffer(b"".join(rows["vec"]), "<i4").reshape(len(rows), -1)
        cells, cell_of = np.unique(rows["cell"].to_numpy(), return_inverse=True)
        for at in range(0, len(probes), 256):
            part = probes.iloc[at: at + 256]
            scores = _products(np.frombuffer(b"".join(part["vec"]), "<i4").reshape(len(part), -1), r)
            for s, own, label, wants, visited in zip(scores, part["vec_id"], part["label"], part["wants"], part["cells"]):
                there = np.isin(cells, visited)[cell_of]
                if wants is None:
                    windows = [(0, there & (labels == label) & (ids != own))]
                else:
                    other = there & (labels != label)
                    windows = [(i + 1, other & (LOW * p <= HIGH * s) & (s <= p)) for i, p in enumerate(wants) if p >= 0]
                for want, inside in windows:
                    idx = np.flatnonzero(inside)
                    if len(idx) > PARTNERS:
                        idx = idx[s[idx] >= np.partition(s[idx], -PARTNERS)[-PARTNERS]]
                    for i in idx[np.argsort(-s[idx], kind="stable")][:PARTNERS]:      # ties: smaller vec_id first
                        found.append((own, want, ids[i], s[i]))
    return pd.DataFrame(found, columns=["vec_id", "want", "other_id", "score"]).astype("int64")


def search(rows: DataFrame, anchors: DataFrame, index: Index, first: int = FIRST) -> DataFrame:
    """vec_id, want, rank, other_id, score: the certified best of every anchor and want.

    ``anchors`` has vec_id, label, vec, block and wants: null to search rows of the own label, else the
    positive scores whose windows rows of other labels must meet."""
    wants = F.coalesce(F.col("wants"), F.array(F.lit(None).cast("long")))
    low = F.when(F.col("top").isNull(), F.lit(float("-inf"))).otherwise(F.col("top") * (LOW / HIGH) * (1 - 1e-9))
    best_first = Window.partitionBy("vec_id", "want").orderBy(F.col("score").desc(), "other_id")

    def needs(state: DataFrame, best: DataFrame | None) -> DataFrame:
        """vec_id, need: no row below it is wanted any more."""
        windows = (state.select("vec_id", F.col("wants").isNull().alias("own"), F.posexplode(wants).alias("i", "top"))
                   .where(F.col("own") | (F.col("top") >= 0))
                   .select("vec_id", F.when(F.col("own"), 0).otherwise(F.col("i") + 1).cast("long").alias("want"), low.alias("low")))
        if best is not None:
            full = best.groupBy("vec_id", "want").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("fifth"))
            windows = windows.join(full, ["vec_id", "want"], "left").withColumn(
                "low", F.when(F.col("n") >= PARTNERS, F.greatest("low", F.col("fifth").cast("double"))).otherwise(F.col("low")))
        return windows.groupBy("vec_id").agg(F.min("low").alias("need"))

    start = anchors.select("vec_id", "label", "vec", "wants", "block", F.lit(0).alias("seen"))
    alive = stored(start.join(needs(start, None), "vec_id"), "open")
    best = None
    while not alive.isEmpty():
        plan = stored(planned(alive, index, first), "probes")
        probes = plan.where(F.col("bucket").isNotNull())
        touched = probes.select(F.col("block").alias("row_block"), F.col("bucket").alias("row_bucket")).distinct()
        tagged = rows.join(touched, rows["bucket"] == touched["row_bucket"])
        hits = (probes.select("block", "bucket", "vec_id", "label", "vec", "wants", "cells").groupBy("block", "bucket")
                .cogroup(tagged.select("row_block", "row_bucket", "vec_id", "label", "vec", "cell").groupBy("row_block", "row_bucket"))
                .applyInPandas(met, "vec_id long, want long, other_id long, score long"))
        found = hits if best is None else hits.unionByName(best.drop("rank"))
        best = stored(found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= PARTNERS), "best")
        state = plan.where(F.col("bucket").isNull()).drop("bucket", "cells", "need")
        alive = stored(state.join(needs(state, best), "vec_id").where(
            (F.col("bound") > float("-inf")) & (F.col("bound") >= F.col("need"))).drop("bound"), "open")
        first *= GROWTH
    return best if best is not None else rows.sparkSession.createDataFrame([], "vec_id long, want long, other_id long, score long, rank int")


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    pts = stored(points(vectors), "points")
    n = pts.count()
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    dims, centres = fitted(pts, n)
    codes = stored(coded(pts, dims, centres), "codes")
    index = directory(codes, dims, centres)
    rows = stored(in_buckets(codes, index), "rows")
    anchors = rows.where(F.col("vec_id") % ANCHOR_EVERY == 0).select(
        "vec_id", "label", "vec", F.expr(f"bucket div {BLOCK_BUCKETS}").alias("block"))
    positives = search(rows, anchors.withColumn("wants", F.lit(None).cast("array<long>")), index)
    ranked = positives.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("p"))   # at most five
    negatives = search(rows, anchors.join(ranked.select("vec_id", F.col("p.score").alias("wants")), "vec_id"), index)
    pairs = positives.select(F.col("vec_id").alias("anchor_id"), F.col("rank").cast("long").alias("want"),
                             F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (negatives.select(F.col("vec_id").alias("anchor_id"), "want", "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(pairs, ["anchor_id", "want"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
