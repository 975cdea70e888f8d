"""Epoch order and batches."""

from pyspark.sql import DataFrame, functions as F

from visitseq.constants import BATCH_SIZE
from visitseq.functions.keyed import uniform
from visitseq.operators.indexing import with_hash_index, with_row_index

# Slices of an epoch that are sorted side by side; their offsets are a table of
# as many rows.
SLICES = 16_384


def epoch_order(df: DataFrame, epoch: int, seed: int, key=("patid",),
                slices: int = SLICES) -> DataFrame:
    """`row_index` 0..n-1 in a random order that epoch and seed determine.

    `key` are the columns that identify a row: they make the draw and break its ties.
    """
    return with_hash_index(df, uniform(*map(F.col, key), epoch, seed), list(key), slices)


def assign_batches(df: DataFrame, batch_size: int = BATCH_SIZE, epoch: int | None = None,
                   seed: int = 0, key=("patid",)) -> DataFrame:
    """`batch_id` of consecutive rows, the last batch may be short.

    Rows are shuffled for an epoch, or in key order without one (test tables).
    """
    if epoch is None:
        indexed = with_row_index(df, list(key))
    else:
        indexed = epoch_order(df, epoch, seed, key)
    return indexed.withColumn("batch_id", F.floor(F.col("row_index") / batch_size).cast("bigint"))
