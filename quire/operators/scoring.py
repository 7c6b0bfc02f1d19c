"""Scoring and checks: theme relevancy (X4), category rules (X5), theme filter (F11),
future-only (F10), article checks (F12, K7), exact and near copies (X3, W6), best image
(W5), trailing request rate (W4), and the scorer hook (V1).

The model judgements of the reference become rule tables: small fixed lists turned
into plain CASE / regex expressions, so no join and no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.ordering import heavy_keys, running_count

# ---- fixed values ---------------------------------------------------------------------
# The ten themes news must match. The keywords of each theme are our rule; a theme
# matches when one of its keywords occurs in the lower-cased text.
THEMES = (
    ("Cyber-Physical Systems", ("cyber-physical", "cyber physical", "cyberphysical")),
    ("Digital-Physical Integration", ("digital-physical", "digital physical", "digital twin")),
    ("Robotics", ("robot",)),
    ("Human-Computer Interaction", ("human-computer", "human computer", "user interface", "interaction")),
    ("Artificial Intelligence", ("artificial intelligence", "machine learning", "neural network")),
    ("Automation", ("automat",)),
    ("Decentralized Technologies", ("decentralis", "decentraliz", "blockchain", "distributed ledger")),
    ("Ethics in Technology", ("ethic",)),
    ("Interdisciplinary Research", ("interdisciplin", "research")),
    ("Innovation and Design", ("innovat", "design")),
)
# Digest categories in rule order; the first rule with a keyword as a whole word (an
# optional plural "s" allowed) wins, else "Other".
CATEGORY_RULES = (
    ("Talks", ("talk", "lecture", "seminar", "keynote", "panel", "speaker")),
    ("Events", ("conference", "symposium", "expo", "fair", "meetup", "summit", "congress")),
    ("Workshops", ("workshop", "bootcamp", "hands-on", "tutorial", "course")),
    ("Opportunity", ("job", "internship", "fellowship", "grant", "scholarship", "competition", "hiring",
                     "call for papers")),
    ("News", ("announce", "announced", "award", "report", "partnership", "launch", "launched", "opens", "open")),
)
DEFAULT_CATEGORY = "Other"
DEFAULT_LOCATION = "Online"
CATEGORIES = ("News", "Talks", "Events", "Workshops", "Opportunity", "Other")
REQUIRED_ARTICLE_FIELDS = ("description", "title", "source", "location", "summary", "category", "link")
# ---------------------------------------------------------------------------------------


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def word_rule_regex(words) -> str:
    """A keyword as a whole word on lower-cased text (edges: not an ASCII letter)."""
    alts = "|".join(w.replace("-", "\\-") for w in words)
    return f"(^|[^a-z])({alts})s?([^a-z]|$)"


def _any_contains(lt: Column, words) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | lt.contains(w)
    return cond


def theme_matches(text: str | Column, themes=THEMES) -> Column:
    """Number of distinct themes with a keyword in the text (literal search, no regex)."""
    lt = F.lower(_c(text))
    return sum(F.coalesce(_any_contains(lt, kws), F.lit(False)).cast("int") for _, kws in themes)


def relevancy_score(text: str | Column, themes=THEMES) -> Column:
    """0-100, the share of themes matched."""
    return ((theme_matches(text, themes) * 100) / len(themes)).cast("int")


def theme_filter(text: str | Column, themes=THEMES) -> Column:
    """F11 predicate: at least one theme matches."""
    return theme_matches(text, themes) > 0


def classify(text: str | Column, rules=CATEGORY_RULES, default: str = DEFAULT_CATEGORY) -> Column:
    """The category of the first rule that matches. A literal search on the lower-cased
    text guards each regex, so the regex only runs where a keyword occurs at all."""
    lt = F.lower(_c(text))
    out = F.lit(default)
    for cat, words in reversed(rules):
        hit = _any_contains(lt, words) & lt.rlike(word_rule_regex(words))
        out = F.when(F.coalesce(hit, F.lit(False)), F.lit(cat)).otherwise(out)
    return out


def future_only(df: DataFrame, *, date: str, as_of) -> DataFrame:
    """items whose date is not before the as-of day (a parameter, never the clock)."""
    dtype = df.schema[date].dataType.simpleString()
    return df.where(F.col(date) >= F.lit(str(as_of)).cast("date").cast(dtype))


def check_articles(df: DataFrame, *, categories: Sequence[str] = CATEGORIES,
                   required: Sequence[str] = REQUIRED_ARTICLE_FIELDS) -> tuple[DataFrame, DataFrame]:
    """Split into (good, bad); bad rows carry ``error`` naming the first problem."""
    err = F.lit(None).cast("string")
    checks = [(F.col(f).isNull(), f"missing {f}") for f in required]
    checks.append((~F.col("category").isin(*categories), "unknown category"))
    for cond, msg in reversed(checks):
        err = F.when(cond, F.lit(msg)).otherwise(err)
    tagged = df.withColumn("error", err)
    return tagged.where(F.col("error").isNull()).drop("error"), tagged.where(F.col("error").isNotNull())


# ---- copies (X3, W6) -------------------------------------------------------------------------
def normalised(text: str | Column) -> Column:
    """Lower case, white-space runs as one space, no space at the ends."""
    return F.lower(F.trim(F.regexp_replace(_c(text), r"[\s\u00a0]+", " ")))


def exact_copies(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """X3 exact: rows with the same normalised text form a group; the smallest key keeps
    its score, the others are copies. Returns ``(key, dup_of, is_copy)``. One row per hash
    is joined back; it is written first, since AQE only splits a hot hash where both sides of
    the join come straight from an exchange, with no aggregate between."""
    from quire.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    # the (key, hash) table is narrow; written once, it feeds both the group and the join
    hashes = df.select(key, F.sha2(normalised(text), 256).alias("_h")).checkpoint(eager=True)
    keep = hashes.groupBy("_h").agg(F.min(key).alias("dup_of")).checkpoint(eager=True)
    return hashes.join(keep, "_h").select(key, "dup_of", (F.col(key) != F.col("dup_of")).alias("is_copy"))


def penalise_copies(df: DataFrame, *, score: str = "score", is_copy: str = "is_copy",
                    factor: int = 10) -> DataFrame:
    """Copies keep only a tenth of their score (integer division)."""
    s = F.coalesce(F.col(score), F.lit(0))
    return df.withColumn(score, F.when(F.col(is_copy), (s / factor).cast("int")).otherwise(s.cast("int")))


def _shingled(df: DataFrame, text: str, shingle: int) -> DataFrame:
    """``_s`` for ``text``: the sorted set of its ``shingle``-word shingles as 64-bit hashes; empty without words."""
    words = df.withColumn("_w", F.array_remove(F.split(normalised(text), " "), "")).drop(text)
    size = F.size("_w")
    runs = F.arrays_zip(*[F.slice("_w", i + 1, F.greatest(size - shingle + 1, F.lit(0))).alias(f"w{i}") for i in range(shingle)])
    return words.withColumn("_s", F.when(F.coalesce(size, F.lit(0)) <= 0, F.array().cast("array<bigint>"))
                            .when(size < shingle, F.array(F.xxhash64(F.lit("short"), F.array_join("_w", " "))))
                            .otherwise(F.array_sort(F.array_distinct(F.transform(
                                runs, lambda x: F.xxhash64(*[x[f"w{i}"] for i in range(shingle)])))))).drop("_w")


def near_copies(df: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 5,
                percent: int = 80) -> DataFrame:
    """X3 near: documents whose sets of ``shingle``-word shingles have a Jaccard similarity of
    at least ``percent`` / 100 are linked; a cluster is a connected component of links.

    Equal sets are one class from the start. Of every class only a sketch is stored and shuffled, the shingles that are
    smallest by hash, as many as any two linked sets must share a quota of: a class whose sketch shares fewer with the
    other sketches has no partner, and most classes end there. Whole sets are made again, from the texts, for the rest.
    Of these only the rarest shingles, as many as two linked sets must share one of, are indexed. A bucket links its
    members to its smallest one first (verified on the whole sets); after that only pairs of different components are
    compared. No link is lost and no group is cut. Keys are only compared, so any orderable type works.

    Returns ``(key, cluster, is_copy)``; ``cluster`` is the smallest key of the component. A text without
    words is its own cluster; a null key has a null cluster."""
    from quire.operators.components import connected_components
    from quire.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)

    def least(n: Column) -> Column:
        """Overlap of a set of n shingles with any set it links to, and size of that set, at least."""
        return F.ceil(n * percent / 100)

    def quota(n: Column) -> Column:
        return F.least(least(n), F.greatest(F.lit(24), F.floor(n / 20)))
    n = F.size("_s")
    # linked sets differ in at most n - least(n) shingles of one, so the first quota of their common ones are in both
    # sketches; a set that no set of one shingle more links to links to equal sets only
    sketch = F.slice("_s", 1, F.when(100 * n >= percent * (n + 1), n - least(n) + quota(n)).otherwise(0).cast("int"))
    docs = df.select(key, text)
    rows = (_shingled(docs, text, shingle).select(key, n.alias("n"), F.when((n > 0) & F.col(key).isNotNull(), F.xxhash64("_s")).alias("_f"), sketch.alias("_k"))
            .withColumn("_id", F.monotonically_increasing_id()).checkpoint())
    classes = rows.where("_f is not null").groupBy("_f").agg(F.min(F.struct(F.col(key).alias("k"), "_id")).alias("_m")).select("_f", F.col("_m.k").alias("_rep"), F.col("_m._id").alias("_id"))
    flat = (rows.where(F.size("_k") > 0).join(classes.select("_id"), "_id", "left_semi")
            .select(F.col(key).alias("c"), "n", F.explode("_k").alias("h")))
    left = (flat.withColumn("_df", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("_df > 1")
            .groupBy("c", "n").agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") >= quota(least(F.col("n"))))
            .select("c").distinct().checkpoint())
    picked = classes.select(F.col("_rep").alias("c"), "_f").join(left, "c")
    # where a key has several texts, only those of the class count; the test stands in the aggregate since the planner
    # would make a filter part of the join and cut all texts into shingles for it
    mine = F.max(F.when(F.xxhash64("_s") == F.col("_f"), F.col("_s")))
    one = (_shingled(docs.withColumnRenamed(key, "c").join(picked, "c"), text, shingle).groupBy("c", "_f").agg(mine.alias("_s"))
           .where("_s is not null").select("c", "_s", n.alias("n")).checkpoint())

    by_h, by_c = Window.partitionBy("h"), Window.partitionBy("c")
    need = F.ceil(F.col("n") * percent / 100)
    front = (one.select("c", "n", F.explode("_s").alias("h")).withColumn("_df", F.count(F.lit(1)).over(by_h)).where("_df > 1")
             .withColumn("_m", F.count(F.lit(1)).over(by_c)).where(F.col("_m") >= need)
             .withColumn("_r", F.row_number().over(by_c.orderBy("_df", "h")))
             .where(F.col("_r") <= F.col("_m") - need + 1).select("h", "c", "n").checkpoint())

    def linked(pairs: DataFrame) -> DataFrame:
        a = one.select(F.col("c").alias("a"), F.col("_s").alias("_sa"))
        b = one.select(F.col("c").alias("b"), F.col("_s").alias("_sb"))
        both = F.size(F.array_intersect("_sa", "_sb"))
        return (pairs.join(a, "a").join(b, "b")
                .where(100 * both >= percent * (F.size("_sa") + F.size("_sb") - both)).select("a", "b").checkpoint())

    like = 100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")
    star = (front.withColumn("_p", F.min(F.struct("c", "n")).over(by_h))
            .select("c", "n", F.col("_p.c").alias("a"), F.col("_p.n").alias("pn"))
            .where((F.col("a") != F.col("c")) & like).select("a", F.col("c").alias("b")).distinct())
    links = linked(star)
    part = connected_components(links).select(F.col("node").alias("c"), F.col("component").alias("k"))
    left = front.join(part, "c", "left").withColumn("k", F.coalesce("k", "c")).checkpoint()
    mixed = left.groupBy("h").agg(F.min("k").alias("_lo"), F.max("k").alias("_hi")).where("_lo <> _hi").select("h")
    left = left.join(mixed, "h", "left_semi")
    other = left.select("h", F.col("c").alias("b"), F.col("n").alias("pn"), F.col("k").alias("kb"))
    pairs = (left.withColumnRenamed("c", "a").join(other, "h")
             .where((F.col("a") < F.col("b")) & (F.col("k") != F.col("kb")) & like).select("a", "b").distinct())
    more = _linked_in_blocks(pairs, left, one, percent)
    part = connected_components(links.unionByName(more)).select(F.col("node").alias("_rep"), F.col("component").alias("_k"))
    named = classes.join(part, "_rep", "left").select("_f", F.coalesce("_k", "_rep").alias("cluster"))
    return (rows.select(key, "_f").join(named, "_f", "left").withColumn("cluster", F.coalesce("cluster", F.col(key)))
            .select(key, "cluster", (F.col(key) != F.col("cluster")).alias("is_copy")))


def _linked_in_blocks(pairs: DataFrame, members: DataFrame, one: DataFrame, percent: int, block: int = 32) -> DataFrame:
    """Of the candidate ``pairs`` (a, b), those that link. Pairs travel as keys only. Classes are dealt into blocks of
    about ``block`` by the smallest member of their buckets (h, c), so that the classes of one family stand together; two
    blocks meet in one row, to which each set they ask for goes once, not once a pair. Where a class stands
    changes what is moved, never which pairs are compared."""
    near = (members.withColumn("_g", F.min("c").over(Window.partitionBy("h"))).groupBy("c").agg(F.min("_g").alias("g")))
    blocks = near.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block).alias("_nb"))
    at = near.join(blocks, "g").select("c", F.struct("g", F.pmod(F.xxhash64("c"), F.col("_nb")).alias("s")).alias("at")).checkpoint()
    met = (pairs.join(at.select(F.col("c").alias("a"), F.col("at").alias("_x")), "a").join(at.select(F.col("c").alias("b"), F.col("at").alias("_y")), "b")
           .select("a", "b", F.least("_x", "_y").alias("_lo"), F.greatest("_x", "_y").alias("_hi")).checkpoint())
    asked = met.select("_lo", "_hi", F.col("a").alias("c")).unionByName(met.select("_lo", "_hi", F.col("b").alias("c"))).distinct()
    sets = asked.join(one.select("c", "_s"), "c").groupBy("_lo", "_hi").agg(F.collect_list(F.struct("c", "_s")).alias("_m"))
    cells = met.groupBy("_lo", "_hi").agg(F.collect_list(F.struct("a", "b")).alias("_p")).join(sets, ["_lo", "_hi"])

    def linked(p: Column) -> Column:
        # 100 * both >= percent * (size of a + size of b - both)
        return F.exists("_m", lambda x: (x["c"] == p["a"]) & F.exists("_m", lambda y: (y["c"] == p["b"]) & (
            (100 + percent) * F.size(F.array_intersect(x["_s"], y["_s"])) >= percent * (F.size(x["_s"]) + F.size(y["_s"])))))
    return cells.select(F.explode(F.filter("_p", linked)).alias("_l")).select("_l.a", "_l.b").checkpoint()


# ---- best image (W5), trailing rate (W4) -------------------------------------------------------
def best_image(images: DataFrame, *, by: str = "page_id", score: str = "score", pos: str = "idx") -> DataFrame:
    """At most one image per article: highest score, then the earliest."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(pos).asc())
    return images.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def trailing_rate(events: DataFrame, *, ts: str = "ts", by: str = "user_id", window_s: int = 60,
                  limit: int = 30) -> DataFrame:
    """Requests of the same key in the trailing window ``(t - window, t]`` and whether the
    limit is passed. Rows are split into (key, time bucket of one window) groups; each row
    is also copied into the next bucket as context, so every window sees all rows it needs.

    A key with more than a task's share of the rows may hold them all in one bucket. Its count is the difference of two
    prefix counts instead, up to ``t`` and up to ``t - window`` (``running_count``: range partitions with boundary
    carry), so it is spread however it lies in time. Rows without a time count among themselves."""
    w_us = window_s * 1_000_000
    heavy = heavy_keys(events, by)
    timed = events.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    if heavy.isEmpty():
        counted = _rate_in_buckets(timed, by, w_us)
    else:
        flagged = timed.join(F.broadcast(heavy), by, "left").withColumn("_hot", F.col("_copies").isNotNull() & F.col("_t").isNotNull())
        flagged = flagged.select(*timed.columns, "_hot")
        counted = _rate_in_buckets(flagged.where(~F.col("_hot")).drop("_hot"), by, w_us).unionByName(
            _rate_by_prefix(flagged.where("_hot").drop("_hot"), by, w_us))
    return (counted.select(*events.columns, F.col("n_in_window").cast("bigint").alias("n_in_window"))
            .withColumn("over_limit", F.col("n_in_window") > limit))


def _rate_in_buckets(base: DataFrame, by: str, w_us: int) -> DataFrame:
    base = base.withColumn("_b", F.floor(F.col("_t") / w_us))
    both = base.withColumn("_own", F.lit(True)).unionByName(
        base.where(F.col("_t").isNotNull()).withColumn("_b", F.col("_b") + 1).withColumn("_own", F.lit(False)))
    frame = Window.partitionBy(by, "_b").orderBy("_t").rangeBetween(-(w_us - 1), 0)
    return both.withColumn("n_in_window", F.count(F.lit(1)).over(frame)).where("_own").drop("_own", "_b")


def _rate_by_prefix(base: DataFrame, by: str, w_us: int) -> DataFrame:
    points = base.groupBy(by, "_t").agg(F.count(F.lit(1)).alias("_n"))
    line = points.select(by, "_t", F.explode(F.array(                              # the point, and the mark where its window begins
        F.struct(F.col("_t").alias("at"), F.lit(0).alias("kind"), F.col("_n").alias("n")),
        F.struct((F.col("_t") - w_us).alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("n")))).alias("_x")).select(by, "_t", "_x.*")
    upto = running_count(line, by=[by], order=["at", "kind"], of=F.col("n"), name="_upto")
    rate = upto.groupBy(by, "_t").agg(F.sum(F.when(F.col("kind") == 0, F.col("_upto")).otherwise(-F.col("_upto"))).alias("n_in_window"))
    return base.join(rate, [by, "_t"])


# ---- scorer hook (V1) -------------------------------------------------------------------------
def score_with(df: DataFrame, fn: Callable, *, schema: str) -> DataFrame:
    """V1: run a user-given, offline scorer over Arrow batches of each partition.

    ``fn(pandas.DataFrame) -> pandas.DataFrame`` must be vectorised and stateless."""
    def run(batches):
        for pdf in batches:
            yield fn(pdf)
    return df.mapInPandas(run, schema=schema)
