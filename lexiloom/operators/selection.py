"""Batches, evaluation steps and the best model of a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.order import range_bucket, running


def batch_loss(losses: DataFrame, draw_no: str, batch_size: int) -> DataFrame:
    """Mean loss of each batch of ``batch_size`` consecutive draws: (batch_id, loss)."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    batch = F.floor(F.col(draw_no) / batch_size).cast("bigint")
    return losses.groupBy(batch.alias("batch_id")).agg(F.avg("loss").alias("loss"))


def eval_steps(log: DataFrame, interval: int, step: str = "step") -> DataFrame:
    """Every ``interval``-th step and the last one."""
    if interval <= 0:
        raise ValueError("interval must be positive")
    last = log.agg(F.max(step).alias("last")).scalar()
    return log.where((F.col(step) % interval == 0) | (F.col(step) == last))


def selection_metric(train_loss: Column, val_loss: Column) -> Column:
    """Validation loss, or training loss where there is none; NaN counts as missing."""
    val = F.when(~F.isnan(val_loss), val_loss)
    return F.coalesce(val, F.when(~F.isnan(train_loss), train_loss))


def improvements(log: DataFrame, metric: str, step: str = "step") -> DataFrame:
    """Add ``best_before`` and ``improved``: strictly below everything earlier, so ties keep the first."""
    bucket = range_bucket(log, step)
    value = F.when(~F.isnan(metric), F.col(metric))
    return running(log, "min", value, bucket, [step], name="best_before").withColumn(
        "improved",
        F.coalesce(value < F.coalesce("best_before", F.lit(float("inf"))), F.lit(False)),
    )


def best_model(log: DataFrame, metric: str, step: str = "step") -> DataFrame:
    """The row with the smallest metric, the earliest of equals; none if every metric is NaN."""
    usable = log.where(F.col(metric).isNotNull() & ~F.isnan(metric))
    row = F.struct(*[F.col(c) for c in log.columns])
    return (
        usable.agg(F.min_by(row, F.struct(metric, step)).alias("r")).where("r is not null").select("r.*")
    )
