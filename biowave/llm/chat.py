"""Chat formatting with cumulative-snapshot collapse, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biowave.llm.common import materialize


def render_maximal(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per maximal conversation: id, n_turns, n_logged, text.

    A conversation that is logged anew after each turn leaves snapshots that are prefixes of the last one. Rolling hashes
    of the first k turns identify them: a conversation whose whole hash is the hash of a longer one's first turns goes
    by an anti-join; of equal ones the smallest id stays, and n_logged counts them. Turns are ordered by (turn, role,
    text); rows alike in all four columns count once. A null role is `user`, a null text empty; a null turn comes first; rows
    with a null id are one conversation. An empty table gives no rows, other columns are ignored.

    The hash of k turns is the exclusive or of the hashes of (place, role, text), 128 bits in all: a running window
    over one conversation. Equal wholes and equal prefixes are grouped before they are joined, so a first turn or a
    conversation that a third of the log shares is one row.
    """
    turn = conversations.select(
        F.col(id_col).alias("_id"), "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    order = Window.partitionBy("_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rolled = materialize(
        turn.withColumn("k", F.row_number().over(order))
        .withColumn("h1", F.expr("bit_xor(xxhash64(k, role, text))").over(so_far))
        .withColumn("h2", F.expr("bit_xor(xxhash64(text, k, role, 'second'))").over(so_far))
        .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("_id")))
    )
    whole = rolled.where("k = n").groupBy("n", "h1", "h2").agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("n_logged"))
    prefix = rolled.where("k < n").select(F.col("k").cast("bigint").alias("n"), "h1", "h2").distinct()
    maximal = whole.join(prefix, ["n", "h1", "h2"], "left_anti").select(F.col("_id").alias("_keep"), "n_logged")
    line = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>\n"))
    return (
        rolled.select("_id", "k", "n", line.alias("line"))
        .join(maximal, F.col("_id").eqNullSafe(F.col("_keep")))
        .groupBy("_id", "n", "n_logged")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "").alias("text"))
        .select(F.col("_id").alias(id_col), F.col("n").alias("n_turns"), "n_logged", "text")
    )
