"""Rows dealt into ordered buckets of about equal weight, however often a key repeats.

``repartitionByRange`` evaluates its input twice (once to sample it) and leaves open which
partition a row is in; here the bounds come from one pass over a stored key column and the
bucket is a column, so prefix sums per bucket are plain aggregates.
"""

import numpy as np
from pyspark.sql import DataFrame, functions as F

TIES = 1 << 31


def bounds_of(stored: DataFrame, key: str, buckets: int) -> np.ndarray:
    """At most ``buckets - 1`` quantiles of a bigint key; a frequent key is there repeatedly."""
    if buckets < 2:
        return np.zeros(0, np.int64)
    shares = [i / buckets for i in range(1, buckets)]
    found = stored.agg(F.percentile_approx(key, shares, max(10_000, 20 * buckets))).head()[0]
    return np.array(found if found is not None else [], np.int64)


def bucket_of(key: np.ndarray, tie: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The bucket of each row, rising with (key, tie).

    ``tie`` is below ``TIES`` and evenly spread; a key that fills several buckets is dealt
    over them by its ties.
    """
    low = np.searchsorted(bounds, key, "left")
    high = np.searchsorted(bounds, key, "right")
    return (low + ((high - low + 1) * tie.astype(np.int64) // TIES) * (high > low)).astype(np.int32)


def offsets_of(sizes: DataFrame, bucket: str = "bucket", size: str = "size") -> dict[int, int]:
    """Sum of ``size`` before each bucket; one small row a bucket reaches the driver."""
    rows = sorted(sizes.groupBy(bucket).agg(F.sum(size)).collect())
    ends = np.cumsum([0, *(int(r[1]) for r in rows)])
    return {r[0]: int(end) for r, end in zip(rows, ends)}
