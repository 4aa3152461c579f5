"""Chat formatting after collapsing cumulative snapshots.

A service that logs the whole conversation after every turn stores each one many
times, as prefixes of its last state.  Rolling hashes of turn prefixes find the
logged conversations that begin a longer one; only maximal ones are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlake.llm.common import settled

#: Turns of a rendered part.  A conversation of any length is so many rows.
PART_TURNS = 256
#: Turns that one window numbers at a time.
CHUNK_TURNS = 1024


def _running(df: DataFrame, value, chunk_total, name: str) -> DataFrame:
    """Adds ``name``: the total of all earlier chunks of a conversation."""
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("conv", "chunk").agg(*[t.alias(n) for t, n in chunk_total])
    before = totals.select("conv", "chunk", *[value(n, earlier).alias(f"_before_{n}") for _, n in chunk_total])
    return df.join(before, [df["conv"].eqNullSafe(before["conv"]), df["chunk"].eqNullSafe(before["chunk"])]).drop(
        before["conv"], before["chunk"]
    )


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``turns`` (conv, turn, role, text, distinct) plus position ``at`` (from 0)
    and the rolling hashes ``h1``, ``h2`` of all turns up to it.

    A turn contributes the hash of its position, role and text; the rolling hash
    is the exclusive or of the contributions, so a long conversation is hashed in
    chunks of turn numbers that are combined afterwards, not in one task.
    """
    chunked = turns.withColumn("chunk", F.floor(F.coalesce("turn", F.lit(0)) / CHUNK_TURNS))
    placed = _running(
        chunked,
        lambda n, w: F.coalesce(F.sum(n).over(w), F.lit(0)),
        [(F.count(F.lit(1)), "n")],
        "n",
    )
    own = Window.partitionBy("conv", "chunk").orderBy(
        F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()
    )
    placed = placed.withColumn("at", F.col("_before_n") + F.row_number().over(own) - 1).drop("_before_n")
    marked = placed
    for name, seed in (("m1", 1), ("m2", 2)):
        marked = marked.withColumn(
            name,
            F.xxhash64(F.lit(seed), "at", F.coalesce("role", F.lit("")), F.col("role").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull()),
        )
    summed = _running(
        marked,
        lambda n, w: F.coalesce(F.bit_xor(n).over(w), F.lit(0)),
        [(F.bit_xor("m1"), "x1"), (F.bit_xor("m2"), "x2")],
        "x",
    )
    upto = Window.partitionBy("conv", "chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    for i in ("1", "2"):
        summed = summed.withColumn(f"h{i}", F.col(f"_before_x{i}").bitwiseXOR(F.bit_xor(f"m{i}").over(upto)))
    return summed.drop("chunk", "m1", "m2", "_before_x1", "_before_x2")


def maximal_conversations(
    conversations: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(turns with their hashes, maximal conversations (conv, n_turns)).

    A conversation goes if its turns begin a longer one; of equal ones the
    smallest id stays.  Turns are ordered by number, then role and text; repeated
    rows of a turn count once.  Null roles and texts are values of their own, a
    null turn number comes first, rows without a conversation id are left out
    (they belong to no conversation).
    """
    turns = conversations.select(
        F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    )
    turns = settled(prefix_hashes(turns.filter("conv is not null").distinct()), "chat-prefixes")
    last = turns.groupBy("conv").agg(F.max("at").alias("at"))
    finals = turns.join(last, ["conv", "at"], "left_semi").select("conv", "at", "h1", "h2")
    distinct = finals.groupBy("at", "h1", "h2").agg(F.min("conv").alias("conv"))
    inner = turns.select("conv", "at", "h1", "h2").join(last.withColumnRenamed("at", "last"), "conv").filter("at < last")
    inner = inner.select("at", "h1", "h2").distinct()
    kept = distinct.join(inner, ["at", "h1", "h2"], "left_anti").select("conv", (F.col("at") + 1).alias("n_turns"))
    return turns, kept


def rendered(conversations: DataFrame, id_col: str = "conv_id", **columns: str) -> DataFrame:
    """Maximal conversations as chat text: (id, part, n_turns, text).

    Every turn is ``<|role|>`` and its text on lines of their own.  A part holds
    ``PART_TURNS`` turns, so no row grows with a conversation's length; its parts
    joined in order are the whole.  Null roles and texts render as empty.
    """
    turns, kept = maximal_conversations(conversations, id_col, **columns)
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    lines = turns.join(kept, "conv").select(
        "conv", "n_turns", F.floor(F.col("at") / PART_TURNS).cast("int").alias("part"), F.struct("at", line.alias("line")).alias("l")
    )
    parts = lines.groupBy("conv", "n_turns", "part").agg(F.array_sort(F.collect_list("l")).alias("l"))
    return parts.select(F.col("conv").alias(id_col), "part", "n_turns", F.array_join("l.line", "").alias("text"))
