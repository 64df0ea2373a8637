"""Documents to count models, their losses and the best of them."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lexiloom.functions.chat import is_chat
from lexiloom.operators.ngram import BYTES, Alphabet, own_loss, split_loss, tally_ngrams
from lexiloom.operators.order import first_in_order, split_tail
from lexiloom.operators.selection import best_model
from lexiloom.session import new_path, stored

CHAT_ROWS = 8
CHAT_BLOCK = 128
CHAT_RATE = 1e-3


@dataclass(frozen=True)
class Options:
    block: int = 16
    rate: float = 3e-3
    batch: int = 1

    def __post_init__(self) -> None:
        if self.block <= 0 or self.batch <= 0:
            raise ValueError("block and batch must be positive")
        if self.rate <= 0:
            raise ValueError("rate must be positive")

    def for_corpus(self, chat_or_tokens: bool) -> Options:
        """Chat and token corpora need long blocks and a small rate."""
        if not chat_or_tokens:
            return self
        return Options(max(self.block, CHAT_BLOCK), min(self.rate, CHAT_RATE), self.batch)


def looks_like_chat(docs: DataFrame, key: str, text: str, seed: int = 42) -> DataFrame:
    """Whether any of the first eight documents of the shuffle is a chat sample."""
    first = first_in_order(docs.select(key, text), key, CHAT_ROWS, seed)
    return first.agg(F.coalesce(F.bool_or(is_chat(F.col(text))), F.lit(False)).alias("looks_like_chat"))


def eval_log(
    docs: DataFrame, key: str, text: str, orders: list[int], alphabet: Alphabet = BYTES, seed: int = 42
) -> DataFrame:
    """(model_order, train_loss, val_loss): models of the training documents on both splits."""
    split = split_tail(docs.select(key, text), key, seed)
    train, val = split.where(F.col("split") == "train"), split.where(F.col("split") == "val")
    # the losses of both splits read the counts, which one pass over the texts gives
    counts = stored(tally_ngrams(train, text, orders, alphabet), "tallied")
    on_train = own_loss(counts)
    on_val = split_loss(val, text, counts.drop("w"), orders, alphabet)
    return on_train.select("model_order", F.col("loss").alias("train_loss")).join(
        on_val.select("model_order", F.col("loss").alias("val_loss")), "model_order", "left"
    )


MEASURED = "step int, n_examples bigint, n_targets bigint, n_entries bigint, seconds double, targets_per_sec double, train_loss double, val_loss double"


def measured_log(
    docs: DataFrame, key: str, text: str, orders: list[int], alphabet: Alphabet = BYTES, seed: int = 42
) -> DataFrame:
    """``eval_log`` with what each order took: one row of ``MEASURED`` per order, which is its step.

    Each model is counted and written by a job of its own. Examples, targets and entries are observed in that very
    job, on the rows that it writes, so that retried tasks add nothing; ``seconds`` is the time of the job.
    """
    split = split_tail(docs.select(key, text), key, seed)
    train, val = split.where(F.col("split") == "train"), split.where(F.col("split") == "val")
    spark, rows, models = docs.sparkSession, [], []
    for order in orders:
        seen = Observation(f"order-{order}")
        tallied = tally_ngrams(train, text, [order], alphabet).observe(
            seen,
            F.coalesce(F.round(F.sum("w")), F.lit(0)).cast("bigint").alias("n_examples"),
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_targets"),
            F.count("*").alias("n_entries"),
        )
        path = new_path(spark, "model")
        began = time.monotonic()
        tallied.write.parquet(path)
        seconds = time.monotonic() - began
        found = seen.get
        targets = found["n_targets"]
        rows.append((order, found["n_examples"], targets, found["n_entries"], seconds, targets / seconds))
        models.append(spark.read.schema(tallied.schema).parquet(path))
    counts = models[0]
    for model in models[1:]:
        counts = counts.unionByName(model)
    took = spark.createDataFrame(rows, MEASURED.partition(", train_loss")[0])
    on_train = own_loss(counts).select(F.col("model_order").alias("step"), F.col("loss").alias("train_loss"))
    on_val = split_loss(val, text, counts.drop("w"), orders, alphabet)
    on_val = on_val.select(F.col("model_order").alias("step"), F.col("loss").alias("val_loss"))
    return took.join(on_train, "step", "left").join(on_val, "step", "left")


def best_order(log: DataFrame) -> DataFrame:
    """The log row with the smallest validation loss, or training loss where there is none."""
    metric = F.coalesce("val_loss", "train_loss")
    return best_model(log.withColumn("metric", metric), "metric", "model_order").drop("metric")
