"""Exact positions inside groups without putting a whole group into one task.

``row_number() OVER (PARTITION BY g ORDER BY o)`` sends every row of a group to one
task. When one group may hold a third of all rows that task is the whole job. Here
the rows are range-partitioned on ``(g, o)``, so a hot group is cut into many chunks;
each chunk counts its rows per group, a running sum over those (small) counts gives
the offset of every chunk inside its group, and offset + rank inside the chunk is the
exact position. The counts table has at most ``groups + chunks`` rows; AQE turns the
join back into a broadcast join when it is small at run time, else it is a balanced
shuffle join on ``(chunk, g)``.

The chunk tags (partition id, row id) must be the same for the counts and for the rows
they are joined back to. Two evaluations of a range exchange need not agree (its
bounds come from a sample), so the tagged rows are written once with a reliable
``checkpoint()`` to the cluster's checkpoint folder and both branches read that copy;
a lost executor then re-reads the files instead of re-deriving different tags.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import ensure_checkpoint_dir


def _cols(xs: Sequence[str | Column]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def positions(df: DataFrame, *, by: Sequence[str], order: Sequence[str | Column], name: str = "pos",
              start: int = 0, chunks: int | None = None, skew_safe: bool = True) -> DataFrame:
    """Add ``name`` = 0-based (plus ``start``) position of each row in its ``by`` group.

    ``order`` must be a total order inside a group (add a unique tie-break column).
    ``skew_safe=False`` gives the plain window form for groups known to be small.
    """
    by = list(by)
    order_cols = _cols(order)
    if not skew_safe:
        w = Window.partitionBy(*by).orderBy(*order_cols)
        return df.withColumn(name, (F.row_number().over(w) - 1 + start).cast("bigint"))

    spark = df.sparkSession
    n = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = (df.repartitionByRange(n, *_cols(by), *order_cols)
                .sortWithinPartitions(*_cols(by), *order_cols)
                .withColumn("_chunk", F.spark_partition_id())
                .withColumn("_row", F.monotonically_increasing_id()))
    ensure_checkpoint_dir(spark)
    tagged = tagged.checkpoint(eager=True)
    counts = tagged.groupBy("_chunk", *by).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    keys = [f"_k{i}" for i in range(len(by))]
    offsets = counts.select(F.col("_chunk").alias("_kc"), *[F.col(b).alias(k) for b, k in zip(by, keys)], "_first",
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # null-safe on the group key: a NULL group is a group too
    cond = [tagged["_chunk"] == offsets["_kc"]] + [tagged[b].eqNullSafe(offsets[k]) for b, k in zip(by, keys)]
    out = tagged.join(offsets, on=cond, how="inner")
    return (out.withColumn(name, (F.col("_offset") + F.col("_row") - F.col("_first") + start).cast("bigint"))
               .drop("_chunk", "_row", "_first", "_offset", "_kc", *keys))


def running_count(df: DataFrame, *, by: Sequence[str], order: Sequence[str | Column], of: Column, name: str = "n",
                  chunks: int | None = None) -> DataFrame:
    """Add ``name`` = the sum of ``of`` over a row's ``by`` group up to and with the row, in ``order`` (a total order).

    Prefix counts with boundary carry: the rows are range-partitioned on ``(by, order)``, each chunk sums its own part,
    and a group's earlier chunks are added from the small table of chunk sums. A hot group is many chunks, and a count
    over any stretch of a group is the difference of two such numbers."""
    by, order_cols = list(by), _cols(order)
    spark = df.sparkSession
    n = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ensure_checkpoint_dir(spark)
    tagged = (df.withColumn("_of", of.cast("bigint")).repartitionByRange(n, *_cols(by), *order_cols)
                .sortWithinPartitions(*_cols(by), *order_cols)
                .withColumn("_chunk", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
                .checkpoint(eager=True))                     # one copy for both branches, as above
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    keys = [f"_k{i}" for i in range(len(by))]
    sums = (tagged.groupBy("_chunk", *by).agg(F.sum("_of").alias("_s"))
            .select(F.col("_chunk").alias("_kc"), *[F.col(b).alias(k) for b, k in zip(by, keys)],
                    F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_carry")))
    inside = Window.partitionBy("_chunk", *by).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    cond = [tagged["_chunk"] == sums["_kc"]] + [tagged[b].eqNullSafe(sums[k]) for b, k in zip(by, keys)]
    out = tagged.withColumn("_in", F.sum("_of").over(inside)).join(sums, cond)
    return (out.withColumn(name, F.col("_carry") + F.col("_in"))
               .drop("_chunk", "_row", "_of", "_in", "_kc", "_carry", *keys))


def heavy_keys(rows: DataFrame, on: str) -> DataFrame:
    """``(on, _copies)`` of the keys that hold more than an even task's share of the rows, and over how many tasks such
    a key is to be spread. Counted exactly (a partial count per map task comes before the shuffle); at most as many rows
    as there are shuffle partitions, since every one holds more than its part of the total."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.where(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return (counts.where(F.col("_n") * tasks > total)
            .select(on, F.ceil(F.col("_n") * tasks / total).cast("int").alias("_copies")))
