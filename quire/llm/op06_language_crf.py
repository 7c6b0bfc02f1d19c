"""Language ID by a linear-chain conditional random field over words.

Every word of a text gets a posterior over languages by forward-backward, with learned
transitions, so single words take the language of their surroundings and a text may switch. A text's
language is the one with the largest sum of word posteriors; the score is its share.

Features of a word (lower-cased run of letters and digits): prefixes and suffixes of 1 to 4
bytes, byte n-grams of 2 to 4 with word edges, and the word itself (lexicon), hashed.

Training sees only rows the caller allows, with a non-null language: of each language at
most ``per_lang`` distinct ids (smallest hash), of each a run of ``words`` words from a
hashed place. The runs are cut and dealt into sequences that keep or change language, from
which transitions are learned. This bounded sample trains on the driver; prediction runs over
all whole texts in one pass without a shuffle. Languages, ids and sources are no input of it.

Cases: null text or text without a letter: ``und``, score 0. Nothing to learn from (empty table, no
language): every row ``und``. Null ids and repeated rows are predicted like others. Ties go
to the alphabetically first language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quire.llm import _text as T
from quire.llm._chain import Crf, Group, marginals
from quire.llm._subwords import BUCKETS, fold, lowered, vocabulary
from quire.llm._tables import release, tidied

#: Bytes of text labelled at a time.
SLICE = 512 << 10

LETTER = re.compile(r"[^\W\d_]")
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True


def stream(buf: np.ndarray, offs: np.ndarray) -> tuple[Group, np.ndarray, np.ndarray]:
    """(features of the distinct words, row of every word, whether it holds a letter)."""
    v = vocabulary(buf, offs)
    return Group(v.flat, v.starts, v.back), v.row, v.lettered[v.back]


class Model:
    def __init__(self, langs: list[str], crf: Crf | None):
        self.langs, self.crf = langs, crf

    def shares(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """(rows, languages): mean posterior of the words with a letter."""
        rows, k = len(offs) - 1, len(self.langs)
        out = np.zeros((rows, k))
        group, row, lettered = stream(buf, offs)
        if not len(row) or not k:
            return out
        first = np.concatenate(([True], row[1:] != row[:-1]))
        post = marginals(self.crf.emissions([group], len(row)), first, self.crf.trans, self.crf.start)
        for j in range(k):
            out[:, j] = np.bincount(row, post[:, j] * lettered, rows)
        return out / np.maximum(out.sum(1, keepdims=True), 1e-300)


def has_letter(col: pa.Array, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    count = np.concatenate(([0], np.cumsum(ASCII_LETTER[buf])))
    out = count[offs[1:]] > count[offs[:-1]]
    for i in np.flatnonzero(~out & (offs[1:] > offs[:-1])):
        out[i] = bool(LETTER.search(col[int(i)].as_py()))
    return out


def train(docs: DataFrame, allowed, per_lang: int = 300, words: int = 120, chars: int = 4000,
          seed: int = 5, rounds: int = 40) -> Model:
    """Fit on a bounded sample of the allowed rows of (doc_id, text, lang): per language ``per_lang`` runs of
    up to ``words`` words and ``chars`` characters (an unspaced script's word may be a whole text)."""
    pool = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & allowed)
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = (pool.select("lang", "doc_id").distinct().withColumn("r", F.row_number().over(w))
              .where(F.col("r") <= per_lang).select("lang", "doc_id"))
    token = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    run = F.slice(token, (F.lit(1) + F.pmod(F.xxhash64("doc_id", F.lit(seed)),
                                            F.greatest(F.size(token) - words, F.lit(1)).cast("long"))).cast("int"), words)
    rows = (pool.where(F.col("text").isNotNull()).join(F.broadcast(picked), ["lang", "doc_id"], "left_semi")
            .groupBy("lang", "doc_id").agg(F.min(F.substring(F.array_join(run, " "), 1, chars)).alias("text"))     # copies of an id are one
            .orderBy("lang", "doc_id").collect())
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return Model([], None)
    rng = np.random.default_rng(seed)
    pieces: dict[str, list] = {x: [] for x in langs}
    for r in rows:
        tok = r["text"].lower().split()
        for i in range(0, len(tok), 20):
            pieces[r["lang"]].append(" ".join(tok[i: i + 20]))
    every = [(lang, p) for lang in langs for p in pieces[lang] if p]
    texts, labels, at = [], [], []                               # sequences of pieces; a quarter of the joints change language
    order = rng.permutation(len(every))
    by = {x: [i for i in order if every[i][0] == x] for x in langs}
    left = {x: len(v) for x, v in by.items()}
    lang = None
    while any(left.values()):
        if lang is None or not left[lang] or rng.random() < 0.25:
            open_ = [x for x in langs if left[x]]
            lang = open_[rng.integers(len(open_))]
        left[lang] -= 1
        texts.append(every[by[lang][left[lang]]][1])
        labels.append(langs.index(lang))
        at.append(rng.random() < 0.3 or not at)
    buf, offs = T.raw(pa.array(texts, pa.large_string()))
    group, row, _ = stream(buf, offs)
    opens = np.concatenate(([True], row[1:] != row[:-1])) & np.array(at)[row] if len(row) else np.zeros(0, bool)
    if not len(row):
        return Model([], None)
    opens[0] = True
    crf = Crf(BUCKETS, len(langs)).fit([group], opens, np.array(labels)[row], rounds=rounds, rate=0.2)
    return Model(langs, crf)


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for rows, buf, offs in T.slices(batches, size=SLICE):
            col = rows.column(rows.schema.get_field_index("text"))
            share = m.shares(*lowered(rows))
            ok = has_letter(col, buf, offs) & (share.sum(1) > 0 if len(m.langs) else False)
            best = share.argmax(1) if len(m.langs) else np.zeros(rows.num_rows, np.int64)
            lang = [m.langs[b] if o else "und" for b, o in zip(best, ok)]
            score = np.where(ok, share[np.arange(rows.num_rows), best] if len(m.langs) else 0.0, 0.0)
            cols = [rows.column(i) for i in range(rows.num_columns)]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(lang, pa.string()), pa.array(score.clip(0, 1))],
                                             rows.schema.names + ["lang_pred", "score"])
    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score (replacing columns of these names); of the others only text is read."""
    from pyspark.sql.types import DoubleType, StringType, StructType
    shared = docs.sparkSession.sparkContext.broadcast(model)
    release()                                                    # what the training needed on the driver
    docs = docs.drop("lang_pred", "score")
    schema = StructType(list(docs.schema.fields)).add("lang_pred", StringType()).add("score", DoubleType())
    return docs.mapInArrow(tidied(_predict(shared)), schema)


def _lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, buf, offs in T.slices(batches):
        yield rows.filter(pa.array(has_letter(rows.column(rows.schema.get_field_index("text")), buf, offs)))


def with_letters(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds a letter."""
    return docs.mapInArrow(tidied(_lettered), docs.schema)


def language_of(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the rows whose fold of 3 is not 1."""
    model = train(docs, fold(3) != 1)
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
