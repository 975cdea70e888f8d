"""Shared working folder for tables that cut the lineage of a job."""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or that of setCheckpointDir().

    The library never chooses a folder: every executor and the driver must see it, and
    only the caller knows such a place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return root.rstrip("/")


_recorders: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str = "table") -> str:
    """A path nobody has used yet."""
    path = f"{shared_root(spark)}/visitseq-{name}-{uuid.uuid4().hex}"
    for paths in _recorders:
        paths.append(path)
    return path


@contextmanager
def recording() -> Iterator[list[str]]:
    """The paths given out inside the block, for a caller that removes them later."""
    paths: list[str] = []
    _recorders.append(paths)
    try:
        yield paths
    finally:
        _recorders.remove(paths)


def materialize(df: DataFrame, name: str = "table", path: str | None = None) -> DataFrame:
    """Write the rows once and go on from the written table.

    Values that depend on the partitioning are fixed by this, a lost executor
    costs a re-read and not the job, and later column pruning still works.
    ``path`` (from ``scratch_path``) lets the caller remove the table with ``drop_table``.
    """
    path = path or scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, key: str, name: str = "table", buckets: int | None = None
                   ) -> DataFrame:
    """Write the rows once, dealt by the hash of `key` into buckets, and go on from there.

    Windows, groups and joins by `key` (alone or with more columns) then find their rows in
    place: the one exchange is paid here and not by every reader. `buckets` is the parallelism of
    all these steps, by default the session's shuffle partitions; size it so that a bucket is a
    good task. Use it where a key's rows are bounded. The bucket layout is kept by the session's
    catalog (a table of a name nobody has used); the files are in the shared folder like others.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"visitseq_{uuid.uuid4().hex}"
    (df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key)
     .option("path", scratch_path(spark, name)).saveAsTable(table))
    return spark.table(table)


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table of ``scratch_path`` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
