"""Chat formatting with collapse of cumulative snapshots; DataFrame functions only.

A log often holds a conversation again each time it grew. Every turn gets a rolling hash
of the turns up to it: the running sums of two 64-bit hashes of (place, role, text),
kept as four halves so that no sum overflows. A conversation is dropped if its last
rolling hash and length stand at an inner turn of another (it is a prefix of a longer
one, found by an anti-join) or, among equal conversations, if it has not the least
conv_id. What is left is rendered turn by turn.

Turns of a conversation are ordered by turn, role and text, nulls first; rows that repeat
are turns of their own. A null role renders as `unknown`, a null text as nothing; null and
empty are told apart when conversations are compared. Rows with a null conv_id form one
conversation, whose id sorts last. Other columns are ignored by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["n_turns", "h1", "h2", "h3", "h4"]


def rolling(conversations: DataFrame) -> DataFrame:
    """A row for each turn with its place, the rolling hash up to it and whether it is the last."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("n_turns", F.row_number().over(order).cast("long")).withColumn("last", F.lead(F.lit(1)).over(order).isNull())
    parts = [F.col("n_turns"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    upto = Window.partitionBy("conv_id").orderBy("n_turns").rowsBetween(Window.unboundedPreceding, 0)  # order has ties where turns repeat
    for k in (0, 1):
        rows = rows.withColumn("h", F.xxhash64(F.lit(k), *parts))
        rows = rows.withColumn(KEY[1 + 2 * k], F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))).over(upto)).withColumn(KEY[2 + 2 * k], F.sum(F.shiftright("h", 32)).over(upto))
    return rows.drop("h")


def maximal(turns: DataFrame) -> DataFrame:
    """conv_ids of conversations that no other has as a prefix; one of each group of equal ones."""
    prefixes = turns.where(~F.col("last")).select(KEY).distinct()
    whole = turns.where("last").groupBy(KEY).agg(F.min("conv_id").alias("conv_id"))
    return whole.join(prefixes, KEY, "left_anti").select("conv_id", "n_turns")


def render(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, n_turns, chat) of the maximal conversations."""
    turns = rolling(conversations)
    kept = maximal(turns).withColumnRenamed("n_turns", "turns").withColumnRenamed("conv_id", "kept")
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    own = turns.join(kept, F.col("conv_id").eqNullSafe(F.col("kept"))).select("conv_id", "n_turns", line.alias("line"))
    return own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_turns", "line"))), lambda x: x["line"]), "").alias("chat"))
