"""What several operators share: stored intermediate tables, dense row numbers and byte-bounded batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.session import new_path
from lexiloom.shipping import ship

ship(__name__)

#: Hash buckets of a dense numbering. A bucket is one window group, so its rows are sorted by one task.
BUCKETS = 1024
#: Copies of one row that one task makes when a count is expanded into rows again.
BLOCK = 1000
#: Text bytes that a kernel works on at once; a longer text is worked on alone.
SLICE_BYTES = 4 << 20


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends here."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def numbered(df: DataFrame, lead: list[str], name: str = "row_number") -> DataFrame:
    """Add the row's number from 0, gapless over the whole table, in the order of ``lead``.

    Within equal ``lead`` values, rows are in the order of a hash of all columns. Equal rows are counted
    before they are moved and expanded afterwards, so no number of copies makes a bucket large; only the
    totals of ``BUCKETS`` buckets per ``lead`` value, which must have few values, meet in one task.
    """
    keys = df.columns
    counted = (
        df.groupBy(*keys)
        .agg(F.count("*").alias("_copies"))
        .withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
    )
    counted = stored(counted, name)
    before = (*lead, "_bucket")
    totals = counted.groupBy(*before).agg(F.sum("_copies").alias("_total"))
    upto = Window.orderBy(*before).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*before, F.coalesce(F.sum("_total").over(upto), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*before).orderBy(F.xxhash64(*keys), *keys).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_base") + F.coalesce(F.sum("_copies").over(inside), F.lit(0))
    placed = counted.join(F.broadcast(bases), list(before)).withColumn("_first", first)
    blocks = placed.withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_copies - 1) div {BLOCK}")))
    ).repartition(*keys, "_block")
    last = F.least(F.col("_copies"), (F.col("_block") + 1) * BLOCK) - 1
    return blocks.withColumn("_copy", F.explode(F.sequence(F.col("_block") * BLOCK, last))).select(
        *keys, (F.col("_first") + F.col("_copy")).alias(name)
    )


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows end to end, without a copy, and the rows' offsets; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    data = column.cast(pa.large_string()).cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw = data.buffers()[2]
    values = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of a piece hold at most ``limit`` bytes, or one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(column))
        low = 0
        while low < batch.num_rows:
            high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
            high = min(max(high, low + 1), batch.num_rows)
            yield batch.slice(low, high - low)
            low = high
