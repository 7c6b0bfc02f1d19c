"""Substring dedup by fixed-block anchors.

Contract: words are runs of non-white-space (ASCII white space), unchanged. A word goes if
a window of 20 consecutive words covers it whose word sequence also starts earlier (in a smaller
doc_id, or earlier in the same document). Windows are judged on the input.

How it runs:

1. The texts are packed once into compressed slices of about 2 MB, stored in the shared
   folder. A slice is the unit that later steps send words, hits and removals to.
2. *Anchors.* Every document is cut into reference blocks of 10 words at 0, 10, 20, ...; any
   window of 20 words holds a whole block. All rolling windows of 10 words probe the block
   index: both go to a hash bucket as 5-byte keys, a slice sends no key more than twice. A key
   that is a block and occurs twice or more is a hit and returns to the slices that have it.
3. *Extension.* Around its hits a slice forms the 20-word windows (96-bit hash) and sends, for
   each distinct one, its first place. The bucket finds the first place of all; every other
   window is a repeat, and runs of them are the maximal exact repeats that came earlier.
4. Each slice drops the words that repeats cover.

A hash that a third of all windows share costs two keys a slice, never a row a window, and no
count, group or text is cut. Buckets grow in number with the input.

Cases: null or empty text: 0 words, kept text empty. Rows with a null doc_id have no
place in the order: nothing is removed from them and they are no one's earlier copy. Rows that repeat
a doc_id share its places, so equal starts of such rows do not remove each other. Only
doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from quire.llm import _text as T
from quire.llm._tables import parts_for, stored

BLOCK, WINDOW = 10, 20
KEY_BITS = 39


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=1)
    for rows, buf, offs in T.slices(batches):
        ids = rows.column(0)
        head = np.array([len(ids)], np.int64).tobytes()
        known = np.asarray(ids.is_valid())
        blob = head + known.tobytes() + np.asarray(ids.fill_null(0)).astype(np.int64).tobytes() + offs.astype(np.int64).tobytes() + buf.tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([z.compress(blob)], pa.binary())], ["blob"])


class Slice:
    """Ids, words and hashes of a packed slice."""

    def __init__(self, blob: bytes):
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        self.known = np.frombuffer(raw, bool, n, 8)
        self.ids = np.frombuffer(raw, np.int64, n, 8 + n)
        offs = np.frombuffer(raw, np.int64, n + 1, 8 + 9 * n)
        self.buf = np.frombuffer(raw, np.uint8, offset=8 + 9 * n + 8 * (n + 1))
        self.start, self.end, self.row = T.words(self.buf, offs)
        self.first = np.searchsorted(self.row, np.arange(n + 1))   # first word of each row

    def hashes(self) -> np.ndarray:
        return T.word_hash(self.buf, self.start, self.end)

    def judged(self, at: np.ndarray) -> np.ndarray:
        return at[self.known[self.row[at]]]


def _anchor_keys(s: Slice, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, key = T.windows(h, s.row, BLOCK)
    ok = s.known[s.row[at]]
    return at[ok], key[ok]


def _anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sid, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = Slice(blob.as_py())
                at, key = _anchor_keys(s, s.hashes())
                block = (at - s.first[s.row[at]]) % BLOCK == 0
                b, k = _split(key, buckets)
                v = np.sort((b << np.uint64(KEY_BITS + 1)) | (k << np.uint64(1)) | block.astype(np.uint64))
                keep = np.ones(len(v), bool)                     # no value more than twice
                keep[2:] = (v[2:] >> np.uint64(1) != v[:-2] >> np.uint64(1)) | (v[2:] != v[1:-1])
                v = v[keep]
                cut = np.searchsorted(v >> np.uint64(KEY_BITS + 1), np.arange(buckets + 1).astype(np.uint64))
                low = v.view(np.uint8).reshape(-1, 8)[:, :5]
                has = np.flatnonzero(cut[1:] > cut[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(has.astype(np.int32)), pa.array(np.full(len(has), sid, np.int64)),
                     pa.array([low[cut[i]: cut[i + 1]].tobytes() for i in has], pa.binary())], ["b", "sid", "keys"])
    return run


def _split(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return (key >> np.uint64(40)) % np.uint64(buckets), key & np.uint64((1 << KEY_BITS) - 1)


def _hits(group: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x.as_py(), np.uint8).reshape(-1, 5) for x in group["keys"]]
    n = np.array([len(p) for p in parts])
    wide = np.zeros((int(n.sum()), 8), np.uint8)
    wide[:, :5] = np.concatenate(parts)
    v = wide.view(np.uint64).ravel()
    key = v >> np.uint64(1)
    order = np.argsort(key, kind="stable")
    sk = key[order]
    begin = np.flatnonzero(np.concatenate(([True], sk[1:] != sk[:-1])))
    count = np.diff(np.append(begin, len(sk)))
    block = np.add.reduceat((v & np.uint64(1))[order].astype(np.int64), begin) > 0
    good = np.zeros(len(v), bool)
    good[order] = np.repeat(block & (count > 1), count)
    cut = np.concatenate(([0], np.cumsum(n)))
    base = np.uint64(group["b"][0].as_py()) << np.uint64(KEY_BITS)
    out = [np.unique(key[cut[i]: cut[i + 1]][good[cut[i]: cut[i + 1]]] | base).tobytes() for i in range(len(parts))]
    keep = [i for i, x in enumerate(out) if x]
    return pa.table({"sid": group["sid"].take(pa.array(keep, pa.int64())), "hits": pa.array([out[i] for i in keep], pa.binary())})


PLACES = "b int, sid long, h binary, g binary, d binary, p binary, i binary, own binary"


def _extend(buckets: int):
    names = [x.split()[0] for x in PLACES.split(",")]

    def run(packed: pa.Table, hits: pa.Table) -> pa.Table:
        none = pa.table({n: pa.array([], t) for n, t in zip(names, [pa.int32(), pa.int64()] + [pa.binary()] * 6)})
        if not packed.num_rows or not hits.num_rows:
            return none
        sid = packed["sid"][0].as_py()
        s = Slice(packed["blob"][0].as_py())
        h = s.hashes()
        at, key = _anchor_keys(s, h)
        b, k = _split(key, buckets)
        found = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in hits["hits"]])
        hit = at[np.isin((b << np.uint64(KEY_BITS)) | k, found)]
        n = len(h) + 1                                           # windows that hold a hit
        near = np.cumsum(np.bincount(np.maximum(hit - (WINDOW - BLOCK), 0), minlength=n)
                         - np.bincount(hit + 1, minlength=n)) > 0
        at, full = T.windows(h, s.row, WINDOW)
        ok = near[at] & s.known[s.row[at]]
        at, full = at[ok], full[ok]
        if not len(at):
            return none
        second = _second_hash(h, at)
        d = s.ids[s.row[at]]
        p = at - s.first[s.row[at]]
        order = np.lexsort((p, d, second, full))
        f, g = full[order], second[order]
        new = np.concatenate(([True], (f[1:] != f[:-1]) | (g[1:] != g[:-1])))
        # later places of a window in this slice are repeats whatever other slices hold
        lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        later = (d[order] != d[lead]) | (p[order] != p[lead])
        own = np.sort(at[order[later]]).astype(np.uint32)
        # rows that repeat a doc_id share the first place: all of them stay in the vote
        pick = order[~later]
        bucket = (full[pick] >> np.uint64(33)) % np.uint64(buckets)
        turn = np.argsort(bucket, kind="stable")
        pick, bucket = pick[turn], bucket[turn]
        cut = np.searchsorted(bucket, np.arange(buckets + 1).astype(np.uint64))
        has = np.flatnonzero(cut[1:] > cut[:-1])

        def column(x):
            return pa.array([x[pick[cut[i]: cut[i + 1]]].tobytes() for i in has] + ([b""] if len(own) else []), pa.binary())
        where, ids = [int(i) for i in has], len(has)
        if len(own):
            where.append(sid % buckets)
        return pa.table({"b": pa.array(where, pa.int32()), "sid": pa.array([sid] * len(where), pa.int64()),
                         "h": column(full), "g": column(second), "d": column(d),
                         "p": column(p.astype(np.uint32)), "i": column(at.astype(np.uint32)),
                         "own": pa.array([b""] * ids + ([own.tobytes()] if len(own) else []), pa.binary())})
    return run


def _second_hash(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """32 more hash bits of the windows at ``at``, independent of the first 64."""
    x = T.mix(h ^ T.STEP)
    s = x[at]
    for j in range(1, WINDOW):
        s = s * T.STEP + x[at + j]
    return (T.mix(s) >> np.uint64(32)).astype(np.uint32)


def _repeats(group: pa.Table) -> pa.Table:
    """Per slice the windows (word index in the slice) that also start earlier."""
    def cat(name, kind):
        parts = [np.frombuffer(x.as_py(), kind) for x in group[name]]
        return parts, np.concatenate(parts)
    hs, h = cat("h", np.uint64)
    g, d, p, i = (cat(n, k)[1] for n, k in (("g", np.uint32), ("d", np.int64), ("p", np.uint32), ("i", np.uint32)))
    order = np.lexsort((p, d, g, h))
    f, s = h[order], g[order]
    new = np.concatenate(([True], (f[1:] != f[:-1]) | (s[1:] != s[:-1]))) if len(f) else np.zeros(0, bool)
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(f) else order
    later = np.zeros(len(h), bool)
    later[order] = (d[order] != d[lead]) | (p[order] != p[lead])
    cut = np.concatenate(([0], np.cumsum([len(x) for x in hs])))
    out = []
    for k, own in enumerate(group["own"]):
        sl = slice(cut[k], cut[k + 1])
        out.append(own.as_py() + i[sl][later[sl]].tobytes())
    keep = [k for k, x in enumerate(out) if x]
    return pa.table({"sid": group["sid"].take(pa.array(keep, pa.int64())), "at": pa.array([out[k] for k in keep], pa.binary())})


def _covered(s: Slice, windows: list[bytes]) -> np.ndarray:
    at = np.concatenate([np.frombuffer(x, np.uint32) for x in windows]).astype(np.int64) if windows else np.zeros(0, np.int64)
    n = len(s.start)
    edge = np.bincount(at, minlength=n + 1)[: n + 1] - np.bincount(at + WINDOW, minlength=n + 1)[: n + 1]
    return np.cumsum(edge)[:n] > 0


DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"
SPANS = "doc_id long, start long, n_words long"


def _kept(packed: pa.Table, windows: pa.Table) -> pa.Table:
    if not packed.num_rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()),
                         "n_removed": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string())})
    s = Slice(packed["blob"][0].as_py())
    gone = _covered(s, [x.as_py() for x in windows["at"]] if windows.num_rows else [])
    data, sha, cut = s.buf.tobytes(), [], s.first
    total = np.concatenate(([0], np.cumsum(gone)))
    for r in range(len(s.ids)):
        a, z = cut[r], cut[r + 1]
        text = data[s.start[a]: s.end[z - 1]] if z > a else b""
        w = text.split()
        if total[z] > total[a]:
            w = [x for x, g in zip(w, gone[a:z].tolist()) if not g]
        sha.append(hashlib.sha256(b" ".join(w)).hexdigest())
    return pa.table({"doc_id": pa.array(s.ids, mask=~s.known), "n_words": pa.array(np.diff(cut)),
                     "n_removed": pa.array(total[cut[1:]] - total[cut[:-1]]), "kept_sha256": pa.array(sha)})


def _spans(packed: pa.Table, windows: pa.Table) -> pa.Table:
    s = Slice(packed["blob"][0].as_py()) if packed.num_rows and windows.num_rows else None
    if s is None:
        return pa.table({n: pa.array([], pa.int64()) for n in ("doc_id", "start", "n_words")})
    gone = _covered(s, [x.as_py() for x in windows["at"]])
    edge = gone.copy()
    edge[1:] &= ~gone[:-1] | (s.row[1:] != s.row[:-1])
    start = np.flatnonzero(edge)
    n = np.add.reduceat(gone.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
    return pa.table({"doc_id": pa.array(s.ids[s.row[start]]), "start": pa.array(start - s.first[s.row[start]]),
                     "n_words": pa.array(n)})


def _run(docs: DataFrame, finish, schema: str) -> DataFrame:
    packed = docs.select("doc_id", "text").mapInArrow(_pack, "blob binary")
    packed = stored(packed.select(F.monotonically_increasing_id().alias("sid"), "blob"), "slices")
    buckets = parts_for(packed, 5)
    keys = packed.mapInArrow(_anchors(buckets), "b int, sid long, keys binary")
    hits = stored(keys.groupBy("b").applyInArrow(_hits, "sid long, hits binary"), "hits")
    places = packed.groupBy("sid").cogroup(hits.groupBy("sid")).applyInArrow(_extend(buckets), PLACES)
    windows = stored(places.groupBy("b").applyInArrow(_repeats, "sid long, at binary"), "repeats")
    return packed.groupBy("sid").cogroup(windows.groupBy("sid")).applyInArrow(finish, schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row per input row."""
    return _run(docs, _kept, DIGEST)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start, n_words): the maximal runs of words that repeats cover."""
    return _run(docs, _spans, SPANS)
