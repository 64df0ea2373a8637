"""Input/output pair datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Turn numbers of a conversation that one window holds.
RANGE = 4096


def chat_pairs(turns: DataFrame) -> DataFrame:
    """Each user turn whose next turn, in the order of the turn numbers, is the assistant's.

    Numbers may have gaps; turns of one number are in the order of their roles and texts. A conversation
    is cut into ranges of ``RANGE`` turn numbers, each a window of its own, and only the first turn of
    each range is carried to the range before, so no task holds a long conversation.
    """
    order = F.struct("turn", "role", "text")
    # one key that is never NULL, so that the join keeps the partitioning of the window
    at = F.struct("conv_id", F.floor(F.col("turn") / RANGE).alias("range"))
    ranged = turns.select("conv_id", "turn", "role", "text", at.alias("_at"))
    within = Window.partitionBy("_at").orderBy("turn", "role", "text")
    firsts = ranged.groupBy("_at").agg(F.min(order).alias("_first"))
    after = firsts.select(
        "_at", F.lead("_first").over(Window.partitionBy("_at.conv_id").orderBy("_at.range")).alias("_carried")
    )
    return (
        ranged.withColumn("_follows", F.lead(order).over(within))
        .join(after, "_at")
        .withColumn("_next", F.coalesce("_follows", "_carried"))
        .where((F.col("role") == "user") & (F.col("_next.role") == "assistant"))
        .where(F.col("text").isNotNull() & F.col("_next.text").isNotNull())
        .select("conv_id", "turn", F.col("text").alias("input"), F.col("_next.text").alias("output"))
    )


def choose_splits(pairs: DataFrame, split: str = "split") -> DataFrame:
    """Training rows plus the evaluation rows: split ``test`` where it exists, else ``validation``."""
    has_test = pairs.where(F.col(split) == "test").limit(1).agg(F.count("*").alias("n")).scalar()
    chosen = F.when(has_test > 0, "test").otherwise("validation")
    return pairs.where((F.col(split) == "train") | (F.col(split) == chosen)).withColumn(
        split, F.when(F.col(split) == "train", "train").otherwise("eval")
    )
