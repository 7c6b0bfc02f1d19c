"""MIME side: header map (P1), leaves of the recursive payload (P3), body decode and
per-type concatenation (P4, P5).

A payload is a tree; StructType cannot recurse, so the payload is kept as JSON text
and walked level by level: each level explodes the ``parts`` of the previous one, a
node without children is a leaf. MIME depth is small, so the loop runs a handful of
narrow (shuffle-free) steps over checkpointed frontiers; the leaves are unioned with
their path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import body_decode


def header_map(headers: str | Column) -> Column:
    """``array<struct<name,value>>`` -> map keyed by lower-case name, last duplicate wins
    (needs ``spark.sql.mapKeyDedupPolicy=LAST_WIN``, set by the session)."""
    h = F.col(headers) if isinstance(headers, str) else headers
    return F.map_from_entries(F.transform(h, lambda x: F.struct(F.lower(x["name"]), x["value"])))


def mime_leaves(messages: DataFrame, *, payload: str = "payload", key: str = "message_id") -> DataFrame:
    """``(key, path array<int>, mime_type, data)`` for every leaf, depth first by ``path``.

    A node with a non-empty ``parts`` list is not a leaf; an empty list is. Each level's
    frontier (the nodes still to open) is written once with ``checkpoint()``, so level k
    reads level k-1 instead of re-deriving all earlier levels, and the walk stops at the
    first empty frontier, however deep the tree."""
    from quire.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(messages.sparkSession)
    node = messages.select(key, F.array().cast("array<int>").alias("path"), F.col(payload).alias("_node"))
    leaves = []
    while True:
        node = node.withColumn("_parts", F.from_json(F.get_json_object("_node", "$.parts"), "array<string>"))
        is_leaf = F.coalesce(F.size("_parts"), F.lit(0)) <= 0
        leaves.append(node.where(is_leaf).select(
            key, "path", F.get_json_object("_node", "$.mimeType").alias("mime_type"),
            F.get_json_object("_node", "$.body.data").alias("data")))
        node = (node.where(~is_leaf)
                    .select(key, "path", F.posexplode("_parts").alias("_i", "_node"))
                    .select(key, F.concat("path", F.array(F.col("_i").cast("int"))).alias("path"), "_node")
                    .checkpoint(eager=True))
        if node.isEmpty():
            break
    out = leaves[0]
    for part in leaves[1:]:
        out = out.unionByName(part)
    return out


def decode_leaves(leaves: DataFrame, *, data: str = "data") -> DataFrame:
    """P4 on every leaf; a leaf without data decodes to nothing."""
    return leaves.withColumn("text", F.when(F.col(data).isNotNull() & (F.col(data) != ""), body_decode(data)))


def bodies(leaves: DataFrame, *, key: str = "message_id", path: str = "path",
           mime: str = "mime_type", text: str = "text") -> DataFrame:
    """P5: per message, all text/plain leaves joined in path order, likewise text/html; '' when none.

    A message is bounded by the mail service's message size limit, so one group
    per message is one bounded task."""
    def part(kind):
        item = F.when((F.col(mime) == kind) & F.col(text).isNotNull(), F.struct(F.col(path).alias("p"),
                                                                                F.col(text).alias("t")))
        return F.coalesce(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), ""),
                          F.lit(""))
    return leaves.groupBy(key).agg(part("text/plain").alias("plain"), part("text/html").alias("html"))
