"""Target-distribution importance resampling (hashed n-gram weights, Gumbel top-k draw).

Method. A-Z are lower-cased, every run of separators becomes one space, and one overlapped regex scan
visits every word: at each word start it captures the spans of the 1-, 2- and 3-word runs that begin
there (a look-behind holds the start to a word boundary, possessive words hold the end). The bytes of a
span are a feature; its bucket is their CRC-32 modulo 10,000. Bucket counts of the corpus (s, S) and of
the target texts (t, T) give each bucket a gain; a document's weight is the sum of the gains of its
features, and its score adds Gumbel noise from a hash of seed and doc_id. The floor(5 * N / 100) highest
scores of the N documents with at least 20 words are drawn.

How it runs. The scan is done once: a document's buckets are written as 2-byte numbers to a stage table
(about the size of the text). Counting reads that table, each task sums its own rows into 10,000 numbers,
and those are added up; what reaches the driver are 10,000 sums, whatever the input. The gains go back as
one array of 10,000. The draw ranks (score, doc_id) by range partitions and offsets, never in one task.

Odd cases. Null or empty text, or one without words: 0 features, weight 0, never drawn. A text of any
length is scanned in runs of 4,096 words. Equal scores go by the smaller doc_id (null first). Repeated
rows count each time, in the sums and in N. A null doc_id hashes as the empty text. An empty target or
an empty table gives the plain formula with T = 0 or S = 0. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from quire.llm._tables import stored, tidied
from quire.operators.ordering import positions

BUCKETS = 10_000
SEED = 42
LEAST_WORDS = 20
PERCENT = 5
RUN = 1 << 12                       # words of one text that are held at a time

#: a-z, 0-9 and all bytes of other scripts are word bytes; A-Z become a-z, the rest a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = rb"[^ ]++"
#: At a word start: group 3 is the word, 2 the run of up to two words, 1 of up to three.
_RUNS = regex.compile(rb"(?<![^ ])(((%b)(?: %b)?+)(?: %b)?+)" % (_WORD, _WORD, _WORD))


def collapsed(text: str | None) -> bytes:
    """The folded words of a text, parted by single spaces."""
    return b" ".join((text or "").encode().translate(_FOLD).split())


def bucket_array(line: bytes, n_buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """(words, bucket of every 1- to 3-word run) of a collapsed text."""
    crc, parts, words = zlib.crc32, [], 0
    scan = _RUNS.finditer(line, overlapped=True)
    while run := [m.group(1, 2, 3) for m in islice(scan, RUN)]:
        threes, twos, ones = zip(*run)
        n = len(ones)
        words += n
        # near the end of the text the longer runs stop early and repeat the shorter one's span
        n_twos = n - (twos[-1] == ones[-1])
        n_threes = n - (threes[-1] == twos[-1]) - (n > 1 and threes[-2] == twos[-2])
        parts += [np.fromiter(map(crc, spans[:k]), np.uint32, k) for spans, k in ((ones, n), (twos, n_twos), (threes, n_threes))]
    if not parts:
        return 0, np.zeros(0, np.uint16)
    return words, (np.concatenate(parts) % np.uint32(n_buckets)).astype(np.uint16)


def features(texts: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and n_words, n_features, buckets (little-endian 2-byte numbers) of every row."""
    schema = T.StructType([texts.schema[c] for c in keep] + [
        T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()), T.StructField("buckets", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [bucket_array(collapsed(t)) for t in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(keep))]
                    + [pa.array([w for w, _ in found], pa.int64()), pa.array([len(b) for _, b in found], pa.int64()),
                       pa.array([b.astype("<u2").tobytes() for _, b in found], pa.binary())],
                    names=[*keep, "n_words", "n_features", "buckets"])

    return texts.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), schema)


def bucket_counts(feats: DataFrame, n_buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows: one row per bucket and task is shuffled, n_buckets rows returned."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for b in batch.column(0):
                total += np.bincount(np.frombuffer(b.as_buffer(), "<u2"), minlength=n_buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(n_buckets, np.int64)
    sums = feats.select("buckets").mapInArrow(tidied(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in sums.collect():                                   # at most n_buckets rows
        out[r.bucket] = r.n
    return out


def gain_array(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(((t + 1) * (S + buckets)) / ((s + 1) * (T + buckets)))) of every bucket, in doubles."""
    n = float(len(corpus))
    top = (target + 1.0) * (float(corpus.sum()) + n)
    low = (corpus + 1.0) * (float(target.sum()) + n)
    return np.floor(1000.0 * np.log(top / low)).astype(np.int64)


def weighted(feats: DataFrame, gains: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep``, n_words, n_features and weight, the sum of the gains of a row's features."""
    spark = feats.sparkSession
    held = spark.sparkContext.broadcast(gains)
    cols = [*keep, "n_words", "n_features"]
    schema = T.StructType([feats.schema[c] for c in cols] + [T.StructField("weight", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = held.value
        for batch in batches:
            sums = [int(g[np.frombuffer(b.as_buffer(), "<u2")].sum()) for b in batch.column(len(cols))]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(cols))] + [pa.array(sums, pa.int64())],
                                             names=[*cols, "weight"])

    return feats.select(*cols, "buckets").mapInArrow(tidied(run), schema)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 * ln(-ln((h + 0.5) / 2^32))) of h, the first 8 hex digits of sha256('seed:doc_id')."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of every document."""
    feats = stored(features(docs, ["doc_id"]), "features")
    gains = gain_array(bucket_counts(feats), bucket_counts(features(target, [])))
    scored = stored(weighted(feats, gains, ["doc_id"]).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    enough = F.col("n_words") >= least_words
    drawn = percent * scored.where(enough).count() // 100
    ranked = positions(scored.where(enough), by=[], order=[F.col("score").desc(), F.col("doc_id"), F.col("weight"), F.col("n_features")],
                       name="rank", start=1)
    out = ["doc_id", "n_features", "weight", "score"]
    return (ranked.select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
            .unionByName(scored.where(~enough).select(*out, F.lit(None).cast("long").alias("rank"))))
