"""Mixing sources to target weights by Sainte-Lague apportionment.

Method. Every source has a size (its words) and a weight (3, 1, 2, 3, 1, 2, ... in code-point order, null
last). The sources share 150 % of all words by weight; a target stops at twice its source's size and the
excess is shared again by weight until no target is above. A source's documents are laid in one line, in
the order of sha256('seed:doc_id'), and the line is cut into blocks of equal length (32 words, the last
one shorter). Seats, one block each, go to the sources by the highest quotients target / (2k + 1), then
within a source to its shards (runs of 16,384 blocks) by the highest quotients words / (2k + 1), which
gives an integer quota per shard. A block has at most two seats: quota // blocks whole rounds of the shard,
and the rest by the order of sha256('seed:source:block'). A document takes the words its blocks give it.

How it runs. Only (doc_id, source, size) is written after the one scan of the texts. The line is a sum
over (source, hash range) cells plus a window inside a cell, so a source with a third of all rows is many
cells. Quotients are never listed in full: seats that every threshold near the divisor grants are counted
in closed form, and at most about three contested quotients a contender are ranked, by range partitions.
Documents meet the shard they lie in, not their source. The driver gets totals only, one row a round of
sharing. Results depend on the rows alone, not on partitions, so reruns agree.

Odd cases. Null text: size 0. A null source is a source, placed last. Documents of size 0 take 0. A
source of only such documents has target 0. Repeated rows count each time and each has its own place in the
line. A null doc_id hashes as the empty text. An empty table gives no rows. A document over many shards
adds up their parts. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.llm._tables import stored
from quire.operators.ordering import positions

WORD = r"[^\x20\x09-\x0D]++"
WEIGHTS = (3, 1, 2)
SHARE = 1.5                  # of all words
MOST = 2                     # times a source, and a document, at most
BLOCK = 32                   # words
SHARD = 1 << 14              # blocks
SEED = 42
CELL_ROWS = 20_000           # documents a (source, hash range) cell aims at, over all sources


def sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size in words, and h, the place of the row in its source's line."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"),
                       F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long").alias("h"))


def with_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size) with place, weight and target. One aggregate a round of sharing."""
    placed = positions(sources, by=[], order=[F.col("source").asc_nulls_last()], name="place")
    turns = F.array(*[F.lit(w) for w in weights])
    placed = stored(placed.withColumn("weight", F.element_at(turns, (F.col("place") % len(weights) + 1).cast("int"))), "sources")
    goal = share * (placed.agg(F.sum("source_size")).first()[0] or 0)
    size, weight = F.col("source_size"), F.col("weight")
    rate, capped = 0.0, -1
    above = F.lit(False)
    while True:
        n, held, open_weight = placed.agg(F.count_if(above), F.sum(F.when(above, most * size)), F.sum(F.when(~above, weight))).first()
        if n == capped:
            break
        capped, rate = n, (goal - (held or 0)) / open_weight if open_weight else 0.0
        above = weight * F.lit(rate) > most * size
    return placed.withColumn("target", F.when(above, (most * size).cast("double")).otherwise(weight * F.lit(rate)))


def quotas(cells: DataFrame, *, by: list[str], keys: list[str], order: list[str]) -> DataFrame:
    """``cells`` with quota: seats by the highest quotients votes / (2k + 1) within each ``by`` group.

    A cell has votes, cap (its most seats), and its group's seats, all_votes and contenders. The j-th
    seats with x = votes * (seats -+ contenders / 2) / all_votes, rounded, surely win, or surely lose, so
    only the seats between are ranked: by quotient, then ``order``. Caps must hold for the plain shares, up
    to rounding (here targets stop before); where they bind by more, seats stay empty.
    """
    def rounded(half: Column) -> Column:
        x = F.when(F.col("all_votes") > 0, F.col("votes") * (F.col("seats") + half) / F.col("all_votes")).otherwise(0.0)
        return F.floor(F.greatest(x, F.lit(0.0)) + 0.5).cast("long")

    half = F.col("contenders") / 2.0
    sure = F.least(F.greatest(rounded(-half) - 1, F.lit(0)), F.col("cap"))
    cells = stored(cells.withColumn("sure", sure).withColumn("possible", F.when(
        (F.col("votes") > 0) & (F.col("seats") > 0), F.least(rounded(half) + 1, F.col("cap"))).otherwise(F.col("sure"))), "cells")
    contested = (cells.where(F.col("possible") > F.col("sure"))
                 .withColumn("k", F.explode(F.sequence("sure", F.col("possible") - 1)))
                 .select(*by, *keys, "k", *[c for c in order if c not in (*by, *keys)], (F.col("votes") / (2 * F.col("k") + 1)).alias("quotient")))
    ranked = positions(contested, by=by, order=[F.col("quotient").desc(), *order, "k"], name="rank")
    left = cells.groupBy(*by).agg((F.first("seats") - F.sum("sure")).alias("left")).select(*[F.col(c).alias(f"_{c}") for c in by], "left")
    on = F.lit(True)
    for c in by:
        on = on & ranked[c].eqNullSafe(left[f"_{c}"])
    won = (ranked.join(left, on).where(F.col("rank") < F.col("left")).groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("won"))
           .select(*[F.col(c).alias(f"_{c}") for c in (*by, *keys)], "won"))
    on = F.lit(True)
    for c in (*by, *keys):
        on = on & cells[c].eqNullSafe(won[f"_{c}"])
    return (cells.join(won, on, "left").withColumn("quota", F.col("sure") + F.coalesce("won", F.lit(0)))
            .drop("won", "sure", "possible", *[f"_{c}" for c in (*by, *keys)]))


def shard_quotas(sources: DataFrame, block: int = BLOCK, shard: int = SHARD, most: int = MOST,
                 share: float = SHARE) -> DataFrame:
    """source, shard, blocks, quota, source_size and target of every shard of every source."""
    n_blocks = F.ceil(F.col("source_size") / block).cast("long")
    total, contenders = sources.agg(F.sum("source_size"), F.count_if(F.col("target") > 0)).first()
    goal = share * (total or 0)                                # what all targets add up to
    voted = sources.select("source", "place", "source_size", "target", F.col("target").alias("votes"), (most * n_blocks).alias("cap"),
                           F.lit(0).alias("all"), F.lit(math.floor(goal / block + 0.5)).cast("long").alias("seats"),
                           F.lit(float(goal)).alias("all_votes"), F.lit(contenders).alias("contenders"))
    won = quotas(voted, by=["all"], keys=["source"], order=["place"])
    last = F.floor(F.greatest(n_blocks - 1, F.lit(0)) / shard).cast("long")
    runs = (won.select("source", "source_size", "target", F.col("quota").alias("seats"), last.alias("last"))
            .withColumn("run", F.explode(F.expr("sequence(0L, last div 4096)")))
            .withColumn("shard", F.explode(F.expr("sequence(run * 4096, least(last, run * 4096 + 4095))"))))
    words = F.greatest(F.least(F.lit(shard * block), F.col("source_size") - F.col("shard") * (shard * block)), F.lit(0)).cast("long")
    cells = runs.select("source", "shard", "source_size", "target", words.cast("double").alias("votes"),
                        F.ceil(words / block).cast("long").alias("blocks"), (most * F.ceil(words / block)).cast("long").alias("cap"),
                        "seats", F.col("source_size").cast("double").alias("all_votes"), (F.col("last") + 1).alias("contenders"))
    return quotas(cells, by=["source"], keys=["shard"], order=["shard"])


def chosen(shards: DataFrame, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """``shards`` with times: how often each of its blocks is taken."""
    first = F.col("shard") * shard
    name = lambda b: F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")), F.lit(":"), b.cast("string")), 256)
    hashed = F.when(F.col("blocks") > 0, F.transform(F.sequence(first, first + F.col("blocks") - 1), name)).otherwise(F.array().cast("array<string>"))
    rounds = F.expr("case when blocks > 0 then quota div blocks else 0 end")
    rest = F.expr("cast(case when blocks > 0 then quota % blocks else 0 end as int)")

    def times(hashes: Column) -> Column:
        last = F.when(rest > 0, F.element_at(F.sort_array(hashes), F.greatest(rest, F.lit(1)))).otherwise(F.lit(""))
        return F.transform(F.array(last), lambda most: F.transform(
            hashes, lambda h: (rounds + F.when(h <= most, 1).otherwise(0)).cast("tinyint")))[0]

    # one-element arrays bind the hashes and the last chosen one: each is worked out once a shard
    return shards.select("source", "shard", F.transform(F.array(hashed), times)[0].alias("times"), "source_size", "target")


def lines(sized: DataFrame, cells: DataFrame, slots: int) -> DataFrame:
    """``sized`` with start, the words before the row in its source's line."""
    before = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(F.col("source").alias("_source"), F.col("slot").alias("_slot"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "slot").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = _slotted(sized, slots).withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return (placed.join(offsets, placed["source"].eqNullSafe(offsets["_source"]) & (placed["slot"] == offsets["_slot"]))
            .select("doc_id", "source", "size", (F.col("offset") + F.col("ahead")).cast("long").alias("start")))


def _slotted(sized: DataFrame, slots: int) -> DataFrame:
    return sized.withColumn("slot", F.expr(f"cast(h * {slots}L div 4294967296L as int)"))


def mix(docs: DataFrame, *, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    spark = docs.sparkSession
    sized = stored(sizes(docs, seed), "sizes")
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sized.count() // CELL_ROWS))
    cells = stored(_slotted(sized, slots).groupBy("source", "slot").agg(F.sum("size").alias("n")), "cells")
    sources = stored(with_targets(cells.groupBy("source").agg(F.sum("n").alias("source_size"))), "targets")
    taken = stored(chosen(shard_quotas(sources, block, shard), shard, seed), "shards")

    words = shard * block
    placed = stored(lines(sized, cells, slots)
                    .withColumn("first", F.expr(f"case when size > 0 then start div {words} else greatest(start - 1, 0L) div {words} end"))
                    .withColumn("last", F.expr(f"case when size > 0 then (start + size - 1) div {words} else first end")), "line")
    single = _met(placed.where("first = last").withColumn("at", F.col("first")), taken, block, words)
    parts = _met(placed.where("first < last").withColumn("at", F.explode(F.sequence("first", "last"))), taken, block, words)
    whole = parts.groupBy("source", "start", "doc_id", "size", "source_size", "target").agg(F.sum("taken").alias("taken"))
    out = ["doc_id", "size", "source_size", "target", "taken"]
    return single.select(*out).unionByName(whole.select(*out))


def _met(rows: DataFrame, taken: DataFrame, block: int, words: int) -> DataFrame:
    """Words that the shard ``at`` gives each row: overlap with each of its blocks, times how often the block is taken."""
    shards = taken.withColumnsRenamed({"source": "_source"})
    met = rows.join(shards, rows["source"].eqNullSafe(shards["_source"]) & (rows["at"] == shards["shard"]))
    return (met.withColumn("a", F.expr(f"greatest(start - at * {words}, 0L)"))
            .withColumn("z", F.expr(f"least(start + size - at * {words}, {words}L)"))
            .withColumn("taken", F.expr(f"""
                case when size = 0 then 0L else aggregate(
                    slice(times, cast(a div {block} + 1 as int), cast((z - 1) div {block} - a div {block} + 1 as int)),
                    named_struct('b', a div {block}, 'n', 0L),
                    (x, t) -> named_struct('b', x.b + 1, 'n', x.n + t * (least(z, (x.b + 1) * {block}) - greatest(a, x.b * {block}))),
                    x -> x.n) end""")))
