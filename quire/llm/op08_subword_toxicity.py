"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its character n-grams (3 to 6 bytes with word edges) and of
itself (hashed), so a misspelling or ending never seen shares most of its vectors with the words learned.
The vectors of all words of a text are averaged and go into a linear softmax of two classes: a score
depends on the shares of words, not on the length of a text, and clean texts joined stay clean.
Embeddings and softmax are trained together in numpy.

Training reads labelled rows the caller allows: at most ``toxic`` and ``clean`` of each
label by hash of the id, of texts up to ``longest`` characters (a bounded sample, trained on the
driver). At prediction the softmax of an average is an average of scalars, so the model is one
number per subword; all whole texts are scored in one pass without a shuffle. Labels, language,
source and id are no input of a score.

Cases: null or empty texts and texts without words get the score of an empty average. No
labelled rows: every score is 0 (below 1e-200). Null ids are never trained on (held_out false) and scored like
others; repeated rows each get their score; a label row that repeats counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quire.llm import _text as T
from quire.llm._subwords import BUCKETS, fold, lowered, vocabulary
from quire.llm._tables import release, tidied

DIM = 8
#: Averages are multiplied by this before the softmax, so that weights of about 1 suffice.
SCALE = 240.0
GRAMS = (3, 6)


def averages(logit: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The mean of the words' numbers of each row; 0 for a row without words."""
    n = np.bincount(row, minlength=rows)
    return np.bincount(row, logit, rows) / np.maximum(n, 1)


class Bag:
    """The trained model for scoring: log odds of a subword, and of an empty text. The softmax of an
    average of vectors is an average of scalars, so one number a subword is the whole model."""

    def __init__(self, odds: np.ndarray, bias: float):
        self.odds, self.bias = odds, bias

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        rows = len(offs) - 1
        v = vocabulary(buf, offs, GRAMS, 0)
        if not len(v.row):
            return sigmoid(np.full(rows, self.bias))
        n = np.diff(np.append(v.starts, len(v.flat)))
        word = np.add.reduceat(self.odds[v.flat].astype(np.float64), v.starts) / n
        return sigmoid(averages(word[v.back], v.row, rows) + self.bias)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(texts: list[str], y: np.ndarray, epochs: int = 16, batch: int = 256, rate: float = 0.1, seed: int = 11, least: int = 5,
        rare: float = 0.01, common: float = 0.3, heavier: float = 4.0,
        shrink: float = 0.3) -> Bag:
    """Joint training of embeddings and softmax by Adam on mini-batches; the epoch with the best held-back
    loss is kept. Subwords of fewer than ``least`` texts keep the zero vector, as do those of common words
    (``common`` of the texts). A toxic text weighs up to ``heavier`` times a clean one, where they are fewer."""
    buf, offs = T.raw(pc.utf8_lower(pa.array(texts, pa.large_string())))
    v = vocabulary(buf, offs, GRAMS, 0)
    rng = np.random.default_rng(seed)
    if not len(v.row):
        return Bag(np.zeros(BUCKETS, np.float32), -1000.0)
    n = np.diff(np.append(v.starts, len(v.flat)))
    pair, times = np.unique(v.row * np.int64(len(n)) + v.back, return_counts=True)
    pair_row, pair_word = pair // len(n), pair % len(n)
    texts_of = np.bincount(pair_word, minlength=len(n))
    most = np.bincount(v.flat, np.repeat(texts_of, n), BUCKETS)  # texts a subword may be in, and is in at least
    sure = np.zeros(BUCKETS, np.int64)
    np.maximum.at(sure, v.flat, np.repeat(texts_of, n))
    least = max(least, round(rare * len(texts)))
    known = (most[v.flat] >= least) & (sure[v.flat] <= max(least, common * len(texts)))
    used, sub = np.unique(v.flat[known], return_inverse=True)
    if not len(used):
        return Bag(np.zeros(BUCKETS, np.float32), -1000.0)
    cut = np.concatenate(([0], np.cumsum(known)))                # the trained subwords of each word, one after another
    lo, hi = cut[v.starts], cut[np.append(v.starts[1:], len(v.flat))]
    size = hi - lo
    # the averages are linear: a text is its share of every subword, laid out once as (row, subword, share)
    words = np.bincount(v.row, minlength=len(texts))
    value_of, col_of, row_of = [], [], []
    first_pair = np.searchsorted(pair_row, np.arange(0, len(texts) + 64, 64))
    for a, z in zip(first_pair[:-1], first_pair[1:]):            # 64 texts at a time: no step holds all occurrences
        w, r = pair_word[a:z], pair_row[a:z]
        deal = np.repeat(np.arange(a, z), size[w])
        inside = np.arange(len(deal)) - np.repeat(np.cumsum(size[w]) - size[w], size[w])
        share = (times[a:z] / words[r] / n[w])[deal - a]
        key, at = np.unique(pair_row[deal] * np.int64(len(used)) + sub[lo[pair_word[deal]] + inside], return_inverse=True)
        value_of.append((SCALE * np.bincount(at, share, len(key))).astype(np.float32))
        col_of.append((key % len(used)).astype(np.int32))
        row_of.append((key // len(used)).astype(np.int32))
    value, col, row = np.concatenate(value_of), np.concatenate(col_of), np.concatenate(row_of)
    row_cut = np.searchsorted(row, np.arange(len(texts) + 1))

    emb = np.zeros((len(used), DIM), np.float32)                  # the softmax's random start breaks the tie
    soft = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.array([1.0, -1.0], np.float32)
    params = [emb, soft, bias]
    first, second = [np.zeros_like(q) for q in params], [np.zeros_like(q) for q in params]
    weight = np.where(y == 1, min(heavier, max(1.0, (len(y) - y.sum()) / max(y.sum(), 1))), 1.0)
    held = rng.random(len(texts)) < 0.15
    train = np.flatnonzero(~held)

    def mean_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = row_cut[rows + 1] - row_cut[rows]
        owner = np.repeat(np.arange(len(rows)), size)
        pick = np.repeat(row_cut[rows] - (np.cumsum(size) - size), size) + np.arange(len(owner))
        mean = np.zeros((len(rows), DIM), np.float32)
        full = size > 0
        if full.any():
            mean[full] = np.add.reduceat(emb[col[pick]] * value[pick, None], (np.cumsum(size) - size)[full], axis=0)
        return mean, owner, pick

    def odds_of(mean: np.ndarray) -> np.ndarray:
        z = mean @ soft + bias
        return (z[:, 1] - z[:, 0]).astype(np.float64)

    best, kept, step = np.inf, [q.copy() for q in params], 0
    for _ in range(epochs):
        rng.shuffle(train)
        for at in range(0, len(train), batch):
            rows = train[at: at + batch]
            mean, owner, pick = mean_of(rows)
            g = weight[rows] * (sigmoid(odds_of(mean)) - y[rows]) / len(rows)
            gz = np.stack((-g, g), 1).astype(np.float32)
            pull = (gz @ soft.T)[owner] * value[pick, None]
            gemb = np.stack([np.bincount(col[pick], pull[:, k], len(used)) for k in range(DIM)], 1)
            step += 1
            for q, m, s, d in zip(params, first, second, (gemb, mean.T @ gz, gz.sum(0))):
                m += 0.1 * (d - m)
                s += 0.001 * (d * d - s)
                q -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-7)
            # group lasso: a subword whose texts do not pull together falls back to zero
            emb *= np.maximum(0, 1 - rate * shrink / np.maximum(np.sqrt((emb * emb).sum(1, keepdims=True)), 1e-12))
        if held.any():
            rows = np.flatnonzero(held)
            p = sigmoid(odds_of(mean_of(rows)[0]))
            loss = (weight[rows] * -np.log(np.clip(np.where(y[rows] == 1, p, 1 - p), 1e-12, 1))).sum() / weight[rows].sum()
            if loss >= best:
                continue
            best = loss
        kept = [q.copy() for q in params]
    emb, soft, bias = kept
    odds = np.zeros(BUCKETS, np.float32)
    odds[used] = SCALE * (emb @ (soft[:, 1] - soft[:, 0]))
    return Bag(odds, float(bias[1] - bias[0]))


def sample(docs: DataFrame, labels: DataFrame, allowed, toxic: int = 1500, clean: int = 2500,
           longest: int = 10_000) -> list:
    """Labelled texts for training: bounded, the smallest hashes of each label."""
    marked = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & allowed)
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    ids = (docs.where(F.col("doc_id").isNotNull() & (F.length("text") <= longest)).select("doc_id").distinct()
           .join(marked, "doc_id"))
    ranked = [ids.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "toxic")
              for label, most in ((1, toxic), (0, clean))]       # each task keeps its first ones, so no label is one task
    picked = ranked[0].unionByName(ranked[1])
    return (docs.where(F.length("text") <= longest).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
            .orderBy("doc_id").select("text", "toxic").collect())


def train(docs: DataFrame, labels: DataFrame, allowed, **bounds) -> Bag:
    rows = sample(docs, labels, allowed, **bounds)
    y = np.array([r["toxic"] for r in rows], np.int64)
    if len(rows) == 0 or not y.any():
        return Bag(np.zeros(BUCKETS, np.float32), -1000.0)
    return fit([r["text"] for r in rows], y)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in T.slices(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(model.value.scores(*lowered(rows)))],
                                             ["doc_id", "score"])
    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): learned from the labels whose fold of 5 is not 0."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, fold(5) != 0))
    release()
    scored = docs.select("doc_id", "text").mapInArrow(tidied(_score(model)), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
