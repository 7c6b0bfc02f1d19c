"""Secret scans: a linear-chain conditional random field over tokens, beside the base patterns.

Every whole text is cut into tokens (runs of letters, digits and ``+/_.-``), each tagged as outside
(O), begin (B) or inside (I) of a secret by Viterbi decoding. Features: the token's shape
(length, shares of digits, capitals and marks, changes of class, spread of characters, known
prefixes), its key word, the words around it, the marks between them, and the file (share of
symbols and of digits in the text). Runs B I* are spans of kind ``crf``.

Base spans of the contract are found by their patterns and always stay: ``assign``, ``access``
and ``hex``, whole matches, leftmost non-overlapping per kind, failing matches dropped after
matching. A ``crf`` span that meets a base span adds nothing and is left out.

Training: there are no gold tags, so the field learns from a bounded, documented sample:
``sample`` documents by hash of the id, of each the ``words`` words around a hashed place, tagged
by the base patterns (values, not key words), with secrets of other formats written into every
third one by fixed rules (prefixed tokens, bearer headers, base64 values after key words, passwords after
"pw:"), and as many look-alikes that are none (numbers, dates, e-mail, versions, paths, long words).

Cases: null and empty texts have no spans: zeros, the digest of the empty string. Null ids and
repeated rows are scanned like others. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm import _text as T
from quire.llm._chain import Crf, Group, viterbi
from quire.llm._tables import release, tidied

KINDS = ("assign", "access", "hex", "crf")
#: The contract's patterns (fixed values) and the least length of what must be long.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(?-i:([A-Za-z0-9+/_.=-]+))""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HINT = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
LONG_HEX = re.compile(r"[0-9a-f]{16,}")

FEATURES = 1 << 14
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
TOKEN = np.array([not (chr(c).isalnum() and c < 128 or c >= 128 or chr(c) in "+/_.-") for c in range(256)])
#: Words that announce a value, and prefixes of well-known tokens (fixed values).
KEYS = ("password", "passwd", "pwd", "pw", "pass", "secret", "token", "key", "apikey", "api_key", "api-key", "bearer",
        "authorization", "auth", "credential", "credentials", "private", "access")
PREFIXES = ("ghp_", "gho_", "glpat-", "sk-", "sk_", "pk_", "xoxb-", "xoxp-", "AKIA", "ASIA", "eyJ", "AIza", "npm_", "dop_")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the contract's spans, in order."""
    out = []
    if HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]   # a whole run of 16 or more, as greedy matching gives
    return sorted(out)


def line(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def _shape(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids (tokens, 10) of distinct tokens as themselves, and (tokens, 2) as neighbours."""
    n = end - start
    first = np.cumsum(n) - n
    b = buf[np.repeat(start, n) + np.arange(int(n.sum())) - np.repeat(first, n)]
    share = lambda mask: np.add.reduceat(mask.astype(np.int64), first)
    digit, upper = (b >= 48) & (b <= 57), (b >= 65) & (b <= 90)
    lower, mark = (b >= 97) & (b <= 122) | (b >= 128), ~((b >= 48) & (b <= 57) | (b >= 65) & (b <= 90) | (b >= 97))
    kind = digit * 1 + upper * 2 + lower * 3
    change = np.concatenate(([False], kind[1:] != kind[:-1]))
    change[first] = False
    distinct = np.bitwise_count(np.bitwise_or.reduceat(np.uint64(1) << (b & 63).astype(np.uint64), first)).astype(np.int64)
    d, u, lo, m, c = share(digit), share(upper), share(lower), share(mark), share(change)
    size = np.searchsorted([2, 4, 6, 8, 10, 12, 16, 20, 24, 32, 40, 64], n, "right")
    tenth = lambda x: x * 5 // n
    hexa = share((b >= 48) & (b <= 57) | (b >= 97) & (b <= 102)) == n
    word = np.where((lo == n), 0, np.where((lo + 1 == n) & (u == 1), 1, np.where(d == n, 2, np.where(u == n, 3, np.where(hexa, 4, 5)))))
    mixed = (d > 0).astype(int) + 2 * (u > 0) + 4 * (lo > 0) + 8 * (m > 0)
    announce = np.isin(T.word_hash(T.LOWER[buf], start, end), KEY_HASHES).astype(np.int64)
    known = np.zeros(len(n), np.int64)
    for i in np.flatnonzero((n >= 10) & (mixed != 4) & (mixed != 6)):
        t = buf[start[i]: min(end[i], start[i] + 6)].tobytes()
        known[i] = next((k + 1 for k, p in enumerate(PREFIXES) if t.startswith(p.encode())), 0)
    cols = [word * 16 + size, 200 + mixed * 16 + size, 500 + tenth(d) * 8 + tenth(u), 600 + np.minimum(c, 15) * 16 + size,
            900 + (distinct * 5 // np.minimum(n, 40)) * 16 + size, 1100 + known, 1200 + announce,
            1300 + hexa * 16 + size, 1400 + tenth(m) * 16 + size, 1500 + mixed]
    near = [np.where(announce > 0, 1, 2 + word), 16 + mixed]
    return np.stack(cols, 1), np.stack(near, 1)


_KEY_BYTES, _KEY_AT = T.raw(pa.array(KEYS, pa.large_string()))
KEY_HASHES = T.word_hash(_KEY_BYTES, _KEY_AT[:-1], _KEY_AT[1:])


class Tokens:
    """Tokens of a slice and their feature groups."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.start, self.end, self.row = T.words(buf, offs, TOKEN)
        n = len(self.start)
        self.first = np.concatenate(([True], self.row[1:] != self.row[:-1])) if n else np.zeros(0, bool)
        if not n:
            self.groups = []
            return
        h = T.word_hash(buf, self.start, self.end)
        _, pick, back = np.unique(h, return_index=True, return_inverse=True)
        own, near = _shape(buf, self.start[pick], self.end[pick])
        table = lambda ids: (ids.ravel(), np.arange(len(ids)) * ids.shape[1])
        at = np.arange(n)
        before, after = at - 1, at + 1
        before[self.first] = -1                                  # no neighbour beyond the text
        after[np.append(self.first[1:], True)] = -1
        two = np.where((before < 0) | self.first[before], -1, before - 1)
        hop = lambda i: np.where(i < 0, -1, back[i])
        gap = np.where(before < 0, 0, self._gap(buf, self.end[before], self.start))
        gap_after = np.where(after < 0, 0, self._gap(buf, self.end, self.start[np.minimum(after, n - 1)]))
        # the file: shares of digits and of other ASCII marks in the text, in steps
        size = np.maximum(np.diff(offs), 1)
        csum = lambda mask: np.concatenate(([0], np.cumsum(mask)))
        per = lambda mask: (lambda c: c[offs[1:]] - c[offs[:-1]])(csum(mask))
        steps = lambda x: np.searchsorted([0.001, 0.01, 0.05, 0.2], x / size)
        file = 4000 + steps(per((buf >= 48) & (buf <= 57))) * 8 + steps(per(T.PUNCT[buf] & ~T.SPACE[buf]))
        one = lambda ids: (ids.ravel(), np.arange(len(ids)))
        self.groups = [Group(*table(own), back), Group(*table(2000 + near), hop(before)), Group(*table(2200 + near), hop(two)),
                       Group(*table(2400 + near), hop(after)), Group(*one(np.arange(3000, 3064)), gap),
                       Group(*one(np.arange(3100, 3164)), gap_after), Group(*one(file), self.row)]

    @staticmethod
    def _gap(buf: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Class of the marks between two tokens: its first and last byte's class and whether it is one byte."""
        cls = GAP[buf[np.minimum(a, len(buf) - 1)]] * 7 + GAP[buf[np.maximum(z, 1) - 1]]
        return np.where(z > a, 1 + cls, 0)


GAP = np.zeros(256, np.int64)
for _i, _chars in enumerate((" ", "\n\r\t", "=", ":", "\"'`", "()[]{}<>")):
    for _c in _chars:
        GAP[ord(_c)] = _i + 1


class Model:
    def __init__(self, crf: Crf | None):
        self.crf = crf

    def spans(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first byte, end byte) of the tagged runs."""
        t = Tokens(buf, offs)
        none = np.zeros(0, np.int64)
        if self.crf is None or not len(t.start):
            return none, none, none
        tag = viterbi(self.crf.emissions(t.groups, len(t.start)), t.first, self.crf.trans, self.crf.start)
        inside = tag != OUTSIDE
        opens = inside & ((tag == BEGIN) | t.first | np.concatenate(([True], ~inside[:-1])))
        at = np.flatnonzero(opens)
        last = np.append(at[1:], len(tag)) - 1
        last = np.array([a + int(np.argmin(np.append(inside[a: z + 1] & ((np.arange(a, z + 1) == a) | (tag[a: z + 1] == INSIDE)), False))) - 1
                         for a, z in zip(at, last)], np.int64)
        return t.row[at], t.start[at], t.end[last]


def _written(rng: np.random.Generator, n: int) -> tuple[list[str], str, int]:
    """A made phrase: words before, the value, and whether it is a secret."""
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    draw = lambda chars, k: "".join(chars[i] for i in rng.integers(0, len(chars), k))
    k = n % 14
    if k < 2:
        return ["token"], PREFIXES[rng.integers(0, len(PREFIXES))] + draw(low + up + dig, int(rng.integers(20, 44))), 1
    if k == 2:
        return ["Authorization:", "Bearer"], draw(low + up + dig + "-_", int(rng.integers(24, 60))), 1
    if k == 3:
        return [["secret:", "key:", "credentials:", "access key ="][rng.integers(0, 4)]], draw(low + up + dig + "+/", int(rng.integers(20, 50))), 1
    if k == 4:
        return [["pw:", "pwd=", "pass:", "passwd ="][rng.integers(0, 4)]], draw(low + up + dig, int(rng.integers(9, 16))), 1
    if k == 5:
        return [], PREFIXES[rng.integers(0, len(PREFIXES))] + draw(low + up + dig, int(rng.integers(16, 40))), 1
    if k == 6:
        return [], draw(dig, int(rng.integers(4, 13))), 0
    if k == 7:
        return [], f"{draw(low, 6)}.{draw(dig, 2)}@mail{draw(dig, 1)}.example.com", 0
    if k == 8:
        return ["version"], ".".join(draw(dig, int(rng.integers(1, 4))) for _ in range(4)), 0
    if k == 9:
        return [], "/".join(draw(low, int(rng.integers(3, 9))) for _ in range(4)), 0
    if k == 10:
        return ["the", "token", "of"], draw(low, int(rng.integers(5, 20))), 0
    if k == 11:
        return ["password"], ["is", "was", "reset", "policy"][rng.integers(0, 4)], 0
    if k == 12:
        return [], draw(up, int(rng.integers(6, 24))) + "!!", 0
    return [], "-".join(draw(low, int(rng.integers(3, 9))) for _ in range(3)), 0


def fit(texts: list[str], seed: int = 3, rounds: int = 50) -> Model:
    """Train on texts tagged by the base patterns, with written-in phrases."""
    rng = np.random.default_rng(seed)
    made, gold = [], []
    for i, t in enumerate(texts):
        words, extra = t.split(" "), []
        for j in range(2 if i % 3 == 0 else 1 if i % 3 == 1 else 0):
            extra.append((int(rng.integers(0, len(words) + 1)), *_written(rng, i + 7 * j)))
        out, spans, at = [], [], 0
        for k in range(len(words) + 1):
            for where, before, value, secret in extra:
                if where == k:
                    for w in before:
                        out.append(w)
                        at += len(w) + 1
                    quote = ["", "", '"'][rng.integers(0, 3)]
                    if secret:
                        spans.append((at + len(quote), at + len(quote) + len(value)))
                    out.append(quote + value + quote)
                    at += len(out[-1]) + 1
            if k < len(words):
                out.append(words[k])
                at += len(words[k]) + 1
        text = " ".join(out)
        for a, kind, z in base_spans(text):
            if kind == 0:
                m = ASSIGN.match(text, a)
                a, z = m.span(2)
            spans.append((a, z))
        made.append(text)
        gold.append(spans)
    buf, offs = T.raw(pa.array(made, pa.large_string()))
    t = Tokens(buf, offs)
    if not len(t.start):
        return Model(None)
    mark = np.zeros(len(buf) + 1, np.int64)
    begin = np.zeros(len(buf) + 1, bool)
    for i, spans in enumerate(gold):
        for a, z in spans:
            a, z = (int(offs[i]) + len(made[i][:x].encode()) for x in (a, z))
            mark[a:z] = 1
            begin[a] = True
    inside = mark[t.start] > 0
    y = np.where(inside, np.where(begin[t.start] | ~np.concatenate(([False], inside[:-1])), BEGIN, INSIDE), OUTSIDE)
    return Model(Crf(FEATURES, 3).fit(t.groups, t.first, y, rounds=rounds, rate=0.3))


def train(docs: DataFrame, sample: int = 1500, words: int = 80, chars: int = 4000, seed: int = 3) -> Model:
    """Fit on at most ``sample`` documents of the smallest id hashes, ``words`` words and ``chars`` characters of each."""
    h = F.xxhash64("doc_id", F.lit(seed))
    ids = docs.where("doc_id is not null and text is not null").select("doc_id").distinct().orderBy(h, "doc_id").limit(sample)
    token = F.split("text", " ")
    run = F.slice(token, (F.lit(1) + F.pmod(h, F.greatest(F.size(token) - words, F.lit(1)).cast("long"))).cast("int"), words)
    rows = (docs.where("text is not null").join(F.broadcast(ids), "doc_id", "left_semi")
            .select("doc_id", F.substring(F.array_join(run, " "), 1, chars).alias("t")).distinct().orderBy("doc_id", "t").limit(sample).collect())
    return fit([r["t"] for r in rows], seed) if rows else Model(None)


def found(model: Model, texts: list, buf: np.ndarray, offs: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """All spans of each text in code points: base spans, and the field's where they meet none."""
    out = [base_spans(t) if t else [] for t in texts]
    fields: dict[int, list[tuple[int, int]]] = {}
    for r, a, z in zip(*model.spans(buf, offs)):
        fields.setdefault(int(r), []).append((int(a - offs[r]), int(z - offs[r])))
    for r, spans in fields.items():
        spans.sort()
        if not texts[r].isascii():                               # bytes to code points, in one run over the text
            raw, at, seen, place = buf[offs[r]: offs[r + 1]].tobytes(), 0, 0, {}
            for x in sorted({x for s in spans for x in s}):
                seen += len(raw[at:x].decode())
                place[x], at = seen, x
            spans = [(place[a], place[z]) for a, z in spans]
        base = sorted(out[r])
        starts, ends = [b[0] for b in base], list(accumulate((b[2] for b in base), max))
        free = []                                                # spans that no base span meets
        for a, z in spans:
            k = bisect_left(starts, z)
            if not k or ends[k - 1] <= a:
                free.append((a, 3, z))
        out[r] = sorted(base + free)
    return out


#: Bytes of text tagged at a time.
SLICE = 768 << 10
DIGEST = "doc_id long, n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans string"


def _scan(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in T.slices(batches, size=SLICE):
            every = found(model.value, rows.column(1).to_pylist(), buf, offs)
            count = [pa.array([sum(k == j for _, k, _ in s) for s in every], pa.int64()) for j in range(4)]
            sha = [hashlib.sha256(line([x for x in s if x[1] < 3]).encode()).hexdigest() for s in every]
            yield pa.RecordBatch.from_arrays([rows.column(0), *count, pa.array(sha), pa.array([line(s) for s in every])],
                                             [f.split()[0] for f in DIGEST.split(", ")])
    return run


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_crf, base_sha256, spans), one row per input row."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs))
    release()
    return docs.select("doc_id", "text").mapInArrow(tidied(_scan(model)), DIGEST)


MASK = "[SECRET]"


def _mask(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in T.slices(batches, size=SLICE):
            i = rows.schema.get_field_index("text")
            texts = rows.column(i).to_pylist()
            for r, spans in enumerate(found(model.value, texts, buf, offs)):
                if not spans:
                    continue
                out, at = [], 0
                for a, _, z in spans:
                    if a >= at:
                        out += [texts[r][at:a], MASK]
                    at = max(at, z)
                texts[r] = "".join(out) + texts[r][at:]
            cols = [rows.column(k) for k in range(rows.num_columns)]
            cols[i] = pa.array(texts, rows.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(cols, schema=rows.schema)
    return run


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by MASK; rows and other columns stay as they are."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs))
    release()
    return docs.mapInArrow(tidied(_mask(model)), docs.schema)
