"""N-gram Jaccard join by prefix trees: link documents whose word 4-gram sets are alike.

Contract: two documents link when 100 * |A & B| >= 85 * |A | B| over their distinct 4-word
shingles (A-Z lower-cased, words split at ASCII white space; 1 to 3 words form one shingle).
The result has one row per input row with its set size and the smallest doc_id reachable.

How it runs:

1. One pass over the texts gives every row its set size, a 128-bit fingerprint of its set
   and its *sketch*: the part of the set that is smallest by hash. Rows with equal sets
   are one class from here on, however many copies there are.
2. Sketches are long enough that linked sets share at least ``quota`` sketch shingles.
   Shingles that one class alone has are dropped, and classes with too few left have no
   partner at all: for most texts the work ends here.
3. The remaining sketches are put in one global order, rarest shingle first, and only
   the front of each list is indexed (linked lists must meet there). Very common lines and passages
   stand at the back of every list, so they rarely make a bucket.
4. Buckets are first joined as stars around one member, and linked classes become
   components: a group of n near copies that all resemble one of them costs n comparisons. After
   that only pairs of *different* components are compared: in buckets of up to ``few``
   classes pair by pair, in larger ones block against block inside a task. That last step is
   quadratic in the classes of a group that resemble each other too little to link. No
   bucket, partner or round is capped.
5. Candidates are verified exactly: the candidate sets of a probe, or of a block of probes, are stored in
   a prefix tree (shared shingles first, so that branches share long paths), which is walked
   once: the overlap of a shared path is counted once, and a subtree ends as soon as the
   shingles left in it cannot reach the overlap needed.

Cases: null or empty text, or text without words: no shingle, linked with nothing, component_id is the
row's own doc_id. Rows with a null doc_id are returned with null component_id and link
nothing. Rows that repeat a doc_id are rows of their own. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quire.llm import _text as T
from quire.llm._tables import stored, tidied
from quire.operators.components import connected_components

SETS = "doc_id long, n long, f1 long, f2 long, sketch array<long>"


def need(n, percent: int):
    """Least overlap of a set of n shingles with any set it links to."""
    return -(-percent * n // 100)


def quota(n: int, percent: int) -> int:
    """Sketch shingles that two linked sets of n shingles must share."""
    return min(need(n, percent), max(24, n // 20))


def sketch_size(n: int, percent: int) -> int:
    """None if not even a set of one shingle more links; a set of one less asks for more."""
    return n - need(n, percent) + quota(n, percent) if 100 * n >= percent * (n + 1) else 0


def _shingled(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key column, sets, sizes, fingerprints) per slice of rows (key, text)."""
    for rows, buf, offs in T.slices(batches):
        buf = T.LOWER[buf]
        start, end, row = T.words(buf, offs)
        sets = T.shingle_sets(T.word_hash(buf, start, end), row, rows.num_rows, k)
        n = np.array([len(s) for s in sets], np.int64)
        f1 = np.array([T.mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
        f2 = np.array([T.mix(s ^ T.CHAIN).sum(dtype=np.uint64) for s in sets], np.uint64)
        yield rows.column(0), sets, n, pa.array(T.signed(f1)), pa.array(T.signed(f2))


def _sets(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, sets, n, f1, f2 in _shingled(k, batches):
            sk = [s[: sketch_size(len(s), percent)] for s in sets]
            yield pa.RecordBatch.from_arrays([key, pa.array(n), f1, f2, T.lists(sk)],
                                             ["doc_id", "n", "f1", "f2", "sketch"])
    return run


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, sets, n, f1, f2 in _shingled(k, batches):
            yield pa.RecordBatch.from_arrays([key, f1, f2, pa.array(n), T.lists(sets)],
                                             ["c", "f1", "f2", "n", "shingles"])
    return run


def tree_links(probes: list[np.ndarray], members: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(probe, member) of all pairs that link, by one walk of the members' prefix tree for all probes.

    The tree is kept as the members' lists sorted as words of a dictionary, each with the length of
    the path it shares with the list before it. Along the path the walk keeps every probe's overlap so far."""
    values, back, count = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)                       # one order for the whole tree, common first
    rank[np.lexsort((values, -count))] = np.arange(len(values))
    size = np.array([len(p) for p in probes])
    owner, every = np.repeat(np.arange(len(probes)), size), np.concatenate(probes)
    place = np.minimum(np.searchsorted(values, every), len(values) - 1)
    met = values[place] == every                                 # shingles that some member has
    met_ranks, column = np.unique(rank[place[met]], return_inverse=True)
    hit = np.zeros((len(met_ranks) + 1, len(probes)), np.int8)   # the last row: shingles of no probe
    hit[column, owner[met]] = 1
    row_of = np.full(len(values), len(met_ranks))
    row_of[met_ranks] = np.arange(len(met_ranks))
    cuts = np.cumsum([0] + [len(m) for m in members])
    ranked = rank[back]
    lists = [np.sort(ranked[cuts[i]: cuts[i + 1]]) for i in range(len(members))]
    order = sorted(range(len(lists)), key=lambda i: lists[i].astype(">i8").tobytes())
    longest = max(len(m) for m in members)
    found, last, upto, dead = [], None, None, -1
    for i in order:
        path = lists[i]
        m, shared = len(path), 0
        if last is not None:
            w = min(m, len(last))
            diff = np.flatnonzero(path[:w] != last[:w])
            shared = int(diff[0]) if len(diff) else w
        if 0 <= dead < shared:                                   # below a node that was given up
            continue
        dead = -1
        seen = np.empty((m, len(probes)), np.int32)              # overlap along the path; the shared part is known
        seen[:shared] = upto[:shared] if shared else 0
        np.cumsum(hit[row_of[path[shared:]]], axis=0, dtype=np.int32, out=seen[shared:])
        if shared:
            seen[shared:] += seen[shared - 1]
        total = seen[-1]
        linked = np.flatnonzero(100 * total >= percent * (size + m - total))
        if len(linked):
            found.append((linked, np.full(len(linked), i)))
        else:
            # a set below this node has at most the overlap so far and what is left of the probe or
            # of the longest path, and at least the path's shingles that the probe misses besides the probe
            depth = np.arange(1, m + 1)[:, None]
            most = np.minimum(size, seen + (longest - depth))
            over = np.flatnonzero((100 * most < percent * (size + depth - seen)).all(1))
            if len(over):
                dead = int(over[0])
        last, upto = path, seen
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _verify(percent: int):
    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        probe = group["c"] == key[0]
        members = group[~probe]
        links = np.zeros(0, np.int64)
        if probe.any() and len(members):
            links = tree_links([np.asarray(group["shingles"][probe].iloc[0])],
                               [np.asarray(s) for s in members["shingles"]], percent)[1]
        return pd.DataFrame({"a": np.full(len(links), key[0], np.int64),
                             "b": members["c"].to_numpy(np.int64)[links]})
    return run


def _verify_blocks(percent: int):
    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["blk"] == key[1]], group[group["blk"] == key[2]]
        x = y = np.zeros(0, np.int64)
        if len(left) and len(right):
            x, y = tree_links([np.asarray(s) for s in left["shingles"]], [np.asarray(s) for s in right["shingles"]], percent)
        apart = left["k"].to_numpy()[x] != right["k"].to_numpy()[y]
        a, b = left["c"].to_numpy(np.int64)[x[apart]], right["c"].to_numpy(np.int64)[y[apart]]
        # one link for each pair of components is all that a merge needs
        pair = pd.DataFrame({"a": a, "b": b, "ka": left["k"].to_numpy()[x[apart]], "kb": right["k"].to_numpy()[y[apart]]})
        return pair.drop_duplicates(["ka", "kb"])[["a", "b"]]
    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Of candidate pairs (a probe, b member), those that link. Members of one probe are dealt
    to blocks of about ``block`` sets, each with its own tree."""
    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = (pairs.join(size, "a")
             .withColumn("s", F.pmod(F.xxhash64("b"), F.col("blocks").cast("long")).cast("int")))
    # one row per member and one for the probe itself (c = a) in every block
    rows = dealt.select("a", "s", F.col("b").alias("c")).unionByName(
        dealt.select("a", "s").distinct().withColumn("c", F.col("a")))
    return (rows.join(sets, "c").select("a", "s", "c", "shingles").groupBy("a", "s")
            .applyInPandas(_verify(percent), "a long, b long"))


def _across(rows: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between components inside large buckets (h, c, k). Buckets with common members overlap
    almost wholly, so their classes are gathered once per cluster of buckets, dealt into blocks, and
    every two blocks meet in one task: rows and bytes moved are a ``block``-th of the pairs, which only the tree walk sees."""
    edges = rows.select(F.col("c").alias("a"), F.min("c").over(Window.partitionBy("h")).alias("b"))
    cluster = connected_components(edges)
    members = rows.select("c", "k").distinct().join(cluster.withColumnRenamed("node", "c"), "c")
    size = members.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("nb"))
    dealt = (members.join(size, "component")
             .withColumn("blk", F.pmod(F.xxhash64("c"), F.col("nb").cast("long")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
             .withColumn("lo", F.least("blk", "other")).withColumn("hi", F.greatest("blk", "other")))
    return (dealt.select("component", "lo", "hi", "c", "k", "blk").join(sets, "c").groupBy("component", "lo", "hi")
            .applyInPandas(_verify_blocks(percent), "a long, b long"))


def classes_and_components(docs: DataFrame, k: int = 4, percent: int = 85, block: int = 256, few: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per input row."""
    rows = stored(docs.select("doc_id", "text").mapInArrow(tidied(_sets(k, percent)), SETS), "sets")
    named = rows.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = stored(named.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep")), "classes")

    # a class is its smallest doc_id; where rows repeat a doc_id, its fingerprint tells them apart
    node = F.xxhash64("f1", "f2", "n")
    keys = ["doc_id", "f1", "f2", "n"]
    first = classes.withColumnRenamed("rep", "doc_id")
    reps = rows.where(F.size("sketch") > 0).join(first, keys, "left_semi").dropDuplicates(keys)
    flat = reps.select(node.alias("c"), "n", F.explode("sketch").alias("h"))
    by_h = Window.partitionBy("h")
    shared = stored(flat.withColumn("df", F.count("*").over(by_h)).where("df > 1"), "shared")

    low = F.ceil(F.col("n") * percent / 100)                     # size of the smallest partner
    q = F.least(F.ceil(low * percent / 100), F.greatest(F.lit(24), F.floor(low / 20))).cast("long")
    by_c = Window.partitionBy("c")
    front = (shared.withColumn("m", F.count("*").over(by_c)).where(F.col("m") >= q)
             .withColumn("r", F.row_number().over(by_c.orderBy("df", "h")))
             .where(F.col("r") <= F.col("m") - q + 1).select("h", "c", "n"))
    front = stored(front.withColumn("df", F.count("*").over(by_h)).where("df > 1").drop("df"), "front")

    # full sets of the classes left in the index, from their texts
    left = front.select("c").distinct().join(first.select(node.alias("c"), "doc_id"), "c")
    sets = stored(_sets_of(left, docs, k), "trees")

    fits = (100 * F.least("n", "pn") >= percent * F.greatest("n", "pn"))
    found = None
    for pick in (F.min, F.max):                                  # two stars per bucket
        star = (front.withColumn("p", pick(F.struct("c", "n")).over(by_h))
                .select("c", "n", F.col("p.c").alias("a"), F.col("p.n").alias("pn"))
                .where((F.col("a") != F.col("c")) & fits).select("a", F.col("c").alias("b")).distinct())
        if found is not None:
            star = star.join(found, ["a", "b"], "left_anti")
        got = stored(_links(star, sets, percent, block), "links")
        found = got if found is None else stored(found.unionByName(got), "links")
    comp = connected_components(found)

    # buckets that still hold different components: all pairs across them
    tagged = (front.join(comp.withColumnRenamed("node", "c"), "c", "left")
              .withColumn("k", F.coalesce("component", "c")).select("h", "c", "n", "k"))
    mixed = (tagged.groupBy("h").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("*").alias("size"))
             .where("lo <> hi").select("h", "size"))
    open_ = stored(tagged.join(mixed, "h"), "open")
    small = open_.where(F.col("size") <= few)
    right = small.select("h", F.col("c").alias("b"), F.col("n").alias("pn"), F.col("k").alias("kb"))
    pairs = (small.withColumnRenamed("c", "a").join(right, "h")
             .where((F.col("a") < F.col("b")) & (F.col("k") != F.col("kb")) & fits).select("a", "b").distinct())
    more = stored(_links(pairs, sets, percent, block).unionByName(
        _across(open_.where(F.col("size") > few), sets, percent, block)), "links")
    comp = connected_components(found.unionByName(more))

    # component of a class, named by the smallest doc_id in it
    of_class = (classes.withColumn("c", node).join(comp.withColumnRenamed("node", "c"), "c", "left")
                .withColumn("k", F.coalesce("component", "c")))
    small = of_class.groupBy("k").agg(F.min("rep").alias("component_id"))
    label = of_class.join(small, "k").select("f1", "f2", "n", "component_id")
    with_set = (named.select("doc_id", "n", "f1", "f2").join(label, ["f1", "f2", "n"])
                .select("doc_id", F.col("n").alias("n_shingles"), "component_id"))
    alone = (rows.where(F.col("doc_id").isNull() | (F.col("n") == 0))
             .select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return with_set.unionByName(alone)


def _sets_of(left: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(c, shingles) of the classes in ``left`` (c, doc_id). Rows of another class under the same doc_id drop out."""
    texts = docs.select("doc_id", "text").join(left, "doc_id").select("c", "text")
    sets = texts.mapInArrow(tidied(_full_sets(k)), "c long, f1 long, f2 long, n long, shingles array<long>")
    return sets.where(F.col("c") == F.xxhash64("f1", "f2", "n")).select("c", "shingles").dropDuplicates(["c"])
