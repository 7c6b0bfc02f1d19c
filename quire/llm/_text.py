"""Words, word hashes and shingles of whole Arrow text columns, as numpy arrays.

A batch is cut into slices of a few MB, so memory does not depend on how many or how long
the rows of a batch are (one row is never cut). All functions work on the UTF-8 bytes:
the white space of the word pattern ``[^\\x20\\x09-\\x0D]+`` is ASCII, so byte runs are words.
Hashes are 64-bit and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_RNG = np.random.default_rng(20240607)
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U(1)      # value of a byte
STEP = U(0x9E3779B97F4A7C15)                                     # odd multiplier of a place
CHAIN = U(0xC2B2AE3D27D4EB4F)                                    # odd multiplier of a word in a sequence

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII characters that are neither letter nor digit part words here; other scripts stay whole.
PUNCT = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64)[col.offset: col.offset + len(col) + 1] if off else np.zeros(1, np.int64)
    if data is None or not len(offs) or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0]: offs[-1]], offs - offs[0]


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", size: int = 2 << 20) -> Iterator[tuple]:
    """(rows, bytes, offsets) for runs of whole rows of about ``size`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buf, offs = raw(batch.column(batch.schema.get_field_index(text)))
        at, n = 0, batch.num_rows
        while at < n:
            to = int(np.searchsorted(offs, offs[at] + size, "right")) - 1
            to = min(n, max(to, at + 1))
            yield batch.slice(at, to - at), buf[offs[at]: offs[to]], offs[at: to + 1] - offs[at]
            at = to


def words(buf: np.ndarray, offs: np.ndarray, parts: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word: a run of bytes outside ``parts`` within one row."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~parts[buf]
    edge = offs[(offs > 0) & (offs < len(buf))]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def word_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    n = end - start
    first = np.cumsum(n) - n
    total = int(n.sum())
    place = np.arange(total) - np.repeat(first, n)
    b = buf[place + np.repeat(start, n)]
    power = np.multiply.accumulate(np.full(int(n.max()), STEP))
    return mix(np.add.reduceat(BYTE[b] * power[place], first) + n.astype(np.uint64))


def windows(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of k words within one row."""
    if len(h) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(row[k - 1:] == row[: len(row) - k + 1])
    m = len(h) - k + 1
    s = h[:m].copy()
    for j in range(1, k):
        s *= CHAIN
        s += h[j: j + m]
    return at, mix(s[at])


def shingle_sets(h: np.ndarray, row: np.ndarray, rows: int, k: int) -> list[np.ndarray]:
    """Per row the sorted distinct k-word shingles; rows of 1 to k-1 words have one, the whole sequence."""
    at, s = windows(h, row, k)
    where = row[at]
    cut = np.searchsorted(where, np.arange(rows + 1))
    first = np.searchsorted(row, np.arange(rows + 1))
    none = np.zeros(0, np.uint64)
    out = []
    for i in range(rows):
        if cut[i + 1] > cut[i]:
            out.append(np.unique(s[cut[i]: cut[i + 1]]))
        elif first[i + 1] > first[i]:
            whole = U(first[i + 1] - first[i])
            with np.errstate(over="ignore"):
                for w in h[first[i]: first[i + 1]]:
                    whole = whole * CHAIN + w
            out.append(mix(np.array([whole ^ U(0xA5A5A5A5)])))
        else:
            out.append(none)
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def lists(parts: list[np.ndarray], kind=None) -> pa.Array:
    """A list<int64> column from one array per row."""
    n = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    offs = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
    flat = np.concatenate(parts) if parts and offs[-1] else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat, kind))
