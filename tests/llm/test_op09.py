"""Quality counts against plain Python, the estimate against numpy concentration steps, edge cases."""

import random
import re

import numpy as np
import pytest

from quire.llm.op09_mcd_quality import FLOOR, MEDIAN, TAIL, judged, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i:i + 3]), []).append(i)
    rep = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep), n < 50 or 100 * len(rep) > 50 * n)


def key(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_counts(spark):
    r = random.Random(1)
    texts = [None, "", " \n\t", "a b", "a b c a b c a b", "x y z", "  \x1c a", "é#|<é\r\né#|<é\r\n", "q" * 100000]
    texts += ["".join(r.choice(["a ", "b ", "c\n", "dd\t", "ü# ", "\n", "\x0b", "x|"]) for _ in range(r.choice([5, 60, 400]))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "en", "s", 7) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, d2 int")
    got = {x.doc_id: x for x in quality(df).collect()}
    for i, t in enumerate(texts):
        assert key(got[i]) == brute(t), repr(t)[:80]
        assert not (got[i].base_failed and got[i].kept)


def vectors(rows):
    n, c, s, d, rep = (np.array([r[k] for r in rows], float) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    lines = np.array([r["n_lines"] for r in rows], float)
    f = lambda a, b: np.arcsin(np.sqrt(np.minimum(a / b, 1)))
    return np.stack([np.log(c / n), f(s, n + s + 20), f(d, lines + 20), f(rep, n + 100)], 1)


def test_estimate_agrees_with_numpy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from quire.llm.op09_mcd_quality import counts
    lines = {r.doc_id: r.n_lines for r in counts(d).select("doc_id", "n_lines").collect()}
    rows = [dict(r.asDict(), n_lines=lines[r.doc_id]) for r in judged(d, least=1).where("not base_failed").collect()]
    groups = {}
    for r in rows:
        groups.setdefault((r["lang"], r["source"]), []).append(r)
    big = max(groups.values(), key=len)
    x = vectors(big)
    best = None
    for start in ("median", "mean"):
        if start == "median":
            m = np.median(x, 0)
            c = np.diag((1.4826 * np.median(np.abs(x - m), 0)) ** 2)
        else:
            m, c = x.mean(0), np.cov(x.T, bias=True)
        for _ in range(30):
            inv = np.linalg.inv(c + FLOOR * np.eye(4))
            d2 = np.einsum("ij,jk,ik->i", x - m, inv, x - m)
            core = x[d2 <= np.sort(d2)[int(np.ceil(0.75 * len(x))) - 1]]
            m, c = core.mean(0), np.cov(core.T, bias=True)
        det = np.linalg.slogdet(c + FLOOR * np.eye(4))[1]
        if best is None or det < best[0]:
            best = (det, m, c)
    _, m, c = best
    d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c + FLOOR * np.eye(4)), x - m)
    dist = np.sqrt(d2 / max(1.0, np.median(d2) / MEDIAN))
    got = np.array([r["distance"] for r in big])
    assert np.corrcoef(got, dist)[0, 1] > 0.97
    assert np.mean((got ** 2 <= TAIL) == (dist ** 2 <= TAIL)) > 0.97


def test_against_labels(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality")
    rows = quality(d).join(lab, "doc_id").where("not base_failed").select("kept", "quality").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.98


def test_nulls_ties_and_empty(spark):
    text = "word " * 30 + " ".join(f"w{i}" for i in range(60))
    rows = [(None, text, None, None)] * 80 + [(1, text, "en", "s")] * 3 + [(2, None, "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = quality(df).collect()
    assert len(got) == 84 and all(r.kept for r in got if r.n_words) and not [r for r in got if r.doc_id == 2][0].kept
    assert quality(df.limit(0)).count() == 0
