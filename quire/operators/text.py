"""Text operators: block split (X1, V2), conversation history (A7), turn context (V3).

Block split: blocks of at most N characters, each ending at the last full stop that fits,
or after N characters where none does; a rest of at most N characters is one block, and
'' is one empty block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 2_000_000


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def block_ends(text: str | Column, n: int) -> Column:
    """Where the blocks of a text end (characters from its start), in order.

    A text is a run of stretches that end in a full stop. Walking over the stretches' lengths
    alone, a stretch that no longer fits ends the block before it; one longer than N is
    cut every N characters. One path for any N and any character."""
    if n < 1:
        raise ValueError("a block holds at least one character")
    stretch = F.transform(F.regexp_extract_all(_c(text), F.lit(r"[^.]*+\.|[^.]++"), 0), lambda s: F.length(s))
    nothing = F.array().cast("array<int>")

    def step(acc, size):
        """acc: ends so far, where the open block begins, where the text read so far ends."""
        begin, at = acc["begin"], acc["at"]
        fits = at + size - begin <= n
        shut = F.when(fits | (at == begin), nothing).otherwise(F.array(at))
        start = F.when(fits, begin).otherwise(at)
        whole = F.floor((at + size - start - 1) / n).cast("int")
        hard = F.when(whole > 0, F.transform(F.sequence(F.lit(1), F.greatest(whole, F.lit(1))), lambda i: start + i * n)) \
                .otherwise(nothing)
        return F.struct(F.concat(acc["ends"], shut, hard).alias("ends"), (start + F.greatest(whole, F.lit(0)) * n).alias("begin"),
                        (at + size).alias("at"))

    first = F.struct(nothing.alias("ends"), F.lit(0).alias("begin"), F.lit(0).alias("at"))
    return F.aggregate(stretch, first, step, lambda acc: F.concat(acc["ends"], F.array(acc["at"])))


def text_blocks(df: DataFrame, *, col: str = "text", max_chars: int = DEFAULT_BLOCK,
                by: str | list[str] = "doc_id") -> DataFrame:
    """``(by, block_pos, block)`` in array functions of the row; a null text has no block."""
    keys = [by] if isinstance(by, str) else list(by)
    ends = df.select(*keys, F.col(col).alias("_t"), block_ends(col, max_chars).alias("_e"))
    cuts = F.arrays_zip(F.concat(F.array(F.lit(0)), F.slice("_e", 1, F.size("_e") - 1)).alias("a"), F.col("_e").alias("z"))
    return (ends.where(F.col("_t").isNotNull())
            .select(*keys, "_t", F.posexplode(cuts).alias("block_pos", "_c"))
            .select(*keys, F.col("block_pos").cast("bigint").alias("block_pos"),
                    F.substring(F.col("_t"), F.col("_c.a") + 1, F.col("_c.z") - F.col("_c.a")).alias("block")))


def model_role(role: str | Column) -> Column:
    """A7: 'user' stays, any other role becomes 'model'."""
    r = _c(role)
    return F.when(r == "user", F.lit("user")).otherwise(F.lit("model"))


def conversation_history(conv: DataFrame, *, by: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> DataFrame:
    """Turns in order as ``[{role, text}]`` JSON per conversation (a conversation is
    bounded by the model's context size, so one group is one bounded task)."""
    item = F.struct(F.col(turn).alias("t"), F.struct(model_role(role).alias("role"), F.col(text).alias("text"))
                    .alias("c"))
    hist = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["c"])
    return conv.groupBy(by).agg(F.count(F.lit(1)).alias("n_turns"), F.to_json(hist).alias("history"))


def turn_context(conv: DataFrame, *, by: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """V3: for each user turn, how many turns precede it and the model reply just before."""
    w = Window.partitionBy(by).orderBy(turn)
    out = conv.withColumn("n_prior", (F.row_number().over(w) - 1).cast("bigint")) \
              .withColumn("prev_role", F.lag(model_role(role)).over(w)) \
              .withColumn("prev_text", F.lag(text).over(w))
    return out.where(F.col(role) == "user").select(
        by, turn, "n_prior", F.when(F.col("prev_role") == "model", F.col("prev_text")).alias("prev_reply"))
