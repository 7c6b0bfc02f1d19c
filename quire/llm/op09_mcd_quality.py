"""Quality rules by robust multivariate outliers, in DataFrame functions only.

Every text gets counts (words, their code points, symbols, repeated lines, words in repeated
3-word windows) and from them a vector of four transformed statistics: log mean word length
and the variance-stabilised shares of symbols, repeated lines and repeated words (with a constant
added below, so that one repeated line in a short text does not count as a share). Per language and
source a minimum-covariance-determinant estimate describes the usual vectors: the mean and
covariance of the ``SUBSET`` share of rows with the smallest determinant, found by concentration
steps from two starts (median with MAD, and mean with covariance), the start with the smaller determinant
being kept for each group. A text is rejected when its Mahalanobis distance is over
the ``TAIL`` quantile of chi-square, after scaling distances to the chi-square median.

Base rule: texts of under 50 words, or with over half their words in repeated 3-word windows, fail and are no
part of the estimates. Groups of under ``LEAST`` such rows share their language's leftover rows,
then all leftover rows; under five rows a statistic reject nothing. Length is no statistic: long texts are kept.

Counts per text are array functions of its row, so a long text is one row's work and nothing is
exploded. A step is two grouped aggregations with partial aggregates (no group is gathered in a task) over a narrow
stage table. Covariances are factored by Cholesky in column arithmetic; a floor under the variances
keeps a constant statistic from making the matrix singular.

Cases: null or empty text: all counts 0, base_failed. Null language or source is a group of its own.
Null ids and repeated rows are judged like others. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.llm._tables import stored

DIM = 4
SUBSET = 0.75
LEAST = 60
FLOOR = 0.07 ** 2
#: Chi-square with 4 degrees of freedom: median, and the quantile at 1 - 1e-7.
MEDIAN, TAIL = 3.3567, 38.19
BLANK = "[ \\t\\n\\x0B\\f\\r]+"
BLANKS = " \t\n\x0b\f\r"


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", "lang", "source", F.array_remove(F.split(text, BLANK), "").alias("w"),
                    F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("lines"),
                    F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"))
    n = F.size("w")
    three = F.arrays_zip(F.slice("w", 1, F.greatest(n - 2, F.lit(0))).alias("a"),
                         F.slice("w", 2, F.greatest(n - 2, F.lit(0))).alias("b"),
                         F.slice("w", 3, F.greatest(n - 2, F.lit(0))).alias("c"))
    d = d.select("doc_id", "lang", "source", "n_symbols", n.cast("long").alias("n_words"),
                 F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
                 F.size("lines").cast("long").alias("n_lines"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.transform(three, lambda x: F.xxhash64(x["a"], x["b"], x["c"])).alias("h"))
    twice = F.size(F.array_distinct("h")) < F.size("h")
    d = d.withColumn("s", F.when(twice, F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    m = F.size("s")
    pairs = F.arrays_zip(F.slice("s", 1, m - 1).alias("x"), F.slice("s", 2, m - 1).alias("y"))
    met = F.filter(pairs, lambda p: p["x"]["h"] == p["y"]["h"])
    at = F.flatten(F.transform(met, lambda p: F.flatten(F.array(
        *[F.array(p[k]["i"], p[k]["i"] + 1, p[k]["i"] + 2) for k in ("x", "y")]))))
    return d.withColumn("n_repeat_words", F.when(F.col("s").isNull(), F.lit(0))
                        .otherwise(F.size(F.array_distinct(at))).cast("long")).drop("h", "s")


def _vector(d: DataFrame) -> DataFrame:
    words = F.greatest("n_words", F.lit(1))
    root = lambda a, b: F.asin(F.sqrt(F.least(F.col(a) / b, F.lit(1.0))))   # b > 0: one event in a short text is no share
    return (d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
            .withColumn("x0", F.log(F.greatest("word_chars", F.lit(1)) / words))
            .withColumn("x1", root("n_symbols", F.col("n_words") + F.col("n_symbols") + 20))
            .withColumn("x2", root("n_dup_lines", F.col("n_lines") + 20))
            .withColumn("x3", root("n_repeat_words", F.col("n_words") + 100)))


def _grouped(d: DataFrame, least: int) -> DataFrame:
    """Adds g: language and source, or the language's leftovers, or all leftovers."""
    lang, source = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("?")), F.coalesce(F.concat(F.lit("="), "source"), F.lit("?"))
    d = d.withColumn("l", lang).withColumn("ls", F.concat_ws("\x01", "l", source))
    fine = d.where("not base_failed")
    own = fine.groupBy("l", "ls").agg(F.count("*").alias("n"))
    rest = own.where(F.col("n") < least).groupBy("l").agg(F.sum("n").alias("n_rest"))
    own = own.join(rest, "l", "left").select(
        "ls", F.when(F.col("n") >= least, F.col("ls")).when(F.col("n_rest") >= least, F.col("l")).otherwise("*").alias("g"))
    return d.join(own, "ls", "left").withColumn("g", F.coalesce("g", F.lit("*"))).drop("l", "ls")


def _cholesky(cov) -> dict[str, Column]:
    """Columns c_ij of the lower factor from a function (i, j) -> covariance."""
    out: dict[tuple, Column] = {}
    for i in range(DIM):
        for j in range(i + 1):
            v = cov(i, j)
            for k in range(j):
                v = v - F.col(f"c{i}{k}") * F.col(f"c{j}{k}")
            out[i, j] = F.sqrt(F.greatest(v, F.lit(FLOOR / 10))) if i == j else v / F.col(f"c{j}{j}")
    return {f"c{i}{j}": v for (i, j), v in out.items()}


def _factored(moments: DataFrame) -> DataFrame:
    """Mean and Cholesky factor per group, with the log determinant."""
    d = moments
    for name, col in _cholesky(lambda i, j: F.col(f"v{min(i, j)}{max(i, j)}") + (F.lit(FLOOR) if i == j else F.lit(0.0))).items():
        d = d.withColumn(name, col)
    return d.select("g", "start", *[f"m{i}" for i in range(DIM)], *[f"c{i}{j}" for i in range(DIM) for j in range(i + 1)],
                    sum((2 * F.log(f"c{i}{i}") for i in range(DIM)), F.lit(0.0)).alias("logdet"))


def _moments(d: DataFrame) -> DataFrame:
    return d.groupBy("g", "start").agg(
        *[F.avg(f"x{i}").alias(f"m{i}") for i in range(DIM)],
        *[F.covar_pop(f"x{i}", f"x{j}").alias(f"v{i}{j}") for i in range(DIM) for j in range(i, DIM)])


def _distance(d: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    for i in range(DIM):
        z = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            z = z - F.col(f"c{i}{k}") * F.col(f"z{k}")
        d = d.withColumn(f"z{i}", z / F.col(f"c{i}{i}"))
    return d.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(DIM)), F.lit(0.0))).drop(
        *[f"z{i}" for i in range(DIM)])


def estimates(fine: DataFrame, subset: float) -> DataFrame:
    """Per group the minimum-covariance-determinant mean, factor and distance scale."""
    both = fine.select("g", *[f"x{i}" for i in range(DIM)])
    both = both.withColumn("start", F.explode(F.array(F.lit("median"), F.lit("mean"))))
    mid = both.groupBy("g", "start").agg(*[F.percentile_approx(f"x{i}", 0.5, 1000).alias(f"m{i}") for i in range(DIM)])
    mad = (both.join(mid, ["g", "start"]).groupBy("g", "start", *[f"m{i}" for i in range(DIM)])
           .agg(*[(1.4826 * F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5, 1000)).alias(f"a{i}") for i in range(DIM)]))
    mad = mad.where("start = 'median'").select("g", "start", *[f"m{i}" for i in range(DIM)], *[
        (F.col(f"a{i}") * F.col(f"a{i}") if i == j else F.lit(0.0)).alias(f"v{i}{j}") for i in range(DIM) for j in range(i, DIM)])
    now = stored(_factored(mad.unionByName(_moments(both.where("start = 'mean'")))), "start")
    last = None
    while True:                                                  # concentration steps: each lowers every determinant
        away = _distance(both.join(now, ["g", "start"]))
        cut = away.groupBy("g", "start").agg(F.percentile_approx("d2", subset, 1000).alias("cut"))
        core = away.join(cut, ["g", "start"]).where("d2 <= cut")
        now = stored(_factored(_moments(core)), "step")
        total = now.agg(F.sum("logdet").alias("t"), F.count("*").alias("n")).first()
        if not total["n"] or last is not None and last - total["t"] < 0.01 * total["n"]:
            break
        last = total["t"]
    best = now.groupBy("g").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
    now = now.join(best, ["g", "start"])
    scale = (_distance(both.join(now, ["g", "start"])).groupBy("g")
             .agg((F.greatest(F.percentile_approx("d2", 0.5, 1000), F.lit(1e-6)) / MEDIAN).alias("scale"), F.count("*").alias("n")))
    return now.drop("start", "logdet").join(scale, "g")


def judged(docs: DataFrame, subset: float = SUBSET, tail: float = TAIL, least: int = LEAST) -> DataFrame:
    """Counts, base_failed, distance (null where no estimate applies) and kept, one row per input row."""
    d = stored(_vector(counts(docs)), "counts")
    d = _grouped(d, least)
    fit = estimates(d.where("not base_failed"), subset).where(F.col("n") >= 5 * DIM)
    d = _distance(d.join(fit, "g", "left")).withColumn("distance", F.sqrt(F.col("d2") / F.greatest("scale", F.lit(1.0))))
    out = F.when(F.col("base_failed"), False).otherwise(F.coalesce(F.col("distance") * F.col("distance") <= tail, F.lit(True)))
    return d.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    F.when(~F.col("base_failed"), F.col("distance")).alias("distance"), out.alias("kept"))


def quality(docs: DataFrame) -> DataFrame:
    return judged(docs).drop("lang", "source")
