"""Dense row numbers without a window over all rows."""

from pyspark.sql import DataFrame, Window, functions as F

from visitseq.sources.scratch import materialize

# Position bits of monotonically_increasing_id; the partition number is above.
_POSITION_BITS = 33


def _offsets(sizes: DataFrame, key: str) -> DataFrame:
    """Rows before each slice. One row per slice, so the window is small."""
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))


def _sorted_slices(df: DataFrame, order_by) -> DataFrame:
    """The rows in sorted range partitions, written once with `_slice` and `_position`.

    The written table makes the partition bounds final, so a retry cannot number a row twice.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    ranged = (df.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("_id", F.monotonically_increasing_id()))
    return materialize(ranged, "index").withColumns({
        "_slice": F.shiftright("_id", _POSITION_BITS),
        "_position": F.col("_id").bitwiseAND((1 << _POSITION_BITS) - 1)})


def with_row_index(df: DataFrame, order_by, name: str = "row_index") -> DataFrame:
    """Number the rows 0..n-1 in the order of columns that identify a row."""
    stored = _sorted_slices(df, order_by)
    sizes = stored.groupBy("_slice").agg((F.max("_position") + 1).alias("_n"))
    # One row per partition of the range shuffle: safe to broadcast at any data size.
    offsets = F.broadcast(_offsets(sizes, "_slice"))
    return (stored.join(offsets, "_slice")
            .select(*df.columns, (F.col("_position") + F.col("_before")).alias(name)))


def with_running_sum(df: DataFrame, order_by, value: str, name: str) -> DataFrame:
    """The sum of `value` over all rows up to each row, in the order of columns that identify
    a row: a running sum in every sorted slice, and the sums of the slices before it."""
    stored = _sorted_slices(df, order_by)
    sizes = stored.groupBy("_slice").agg(F.sum(value).alias("_n"))
    offsets = F.broadcast(_offsets(sizes, "_slice"))
    within = (Window.partitionBy("_slice").orderBy("_position")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (stored.withColumn("_sum", F.sum(value).over(within)).join(offsets, "_slice")
            .select(*df.columns, (F.col("_sum") + F.col("_before")).alias(name)))


def with_hash_index(df: DataFrame, draw, key_cols, slices: int,
                    name: str = "row_index") -> DataFrame:
    """Number the rows 0..n-1 in the order of a uniform draw.

    Equal slices of [0, 1) are equally full, so the draw itself is the range
    partitioning: each slice is numbered on its own and shifted by the rows in
    the slices before it. Both passes compute the same slice from the key.
    """
    drawn = (df.withColumn("_u", draw)
             .withColumn("_slice", F.floor(F.col("_u") * slices).cast("int")))
    sizes = drawn.groupBy("_slice").agg(F.count("*").alias("_n"))
    # At most `slices` rows.
    offsets = F.broadcast(_offsets(sizes, "_slice"))
    within = Window.partitionBy("_slice").orderBy("_u", *key_cols)
    numbered = drawn.withColumn("_position", F.row_number().over(within) - 1)
    return (numbered.join(offsets, "_slice")
            .select(*df.columns, (F.col("_position") + F.col("_before")).alias(name)))
