"""Writers. All partitions write in parallel; none is merged into one file."""

from pyspark.sql import Column, DataFrame, functions as F

# Three digits number the files of a task, so that their names stay in order.
FILES_PER_TASK = 1000


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_vocab(vocab: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """`version` is kept where the vocabulary was extended."""
    names = [c for c in ("token", "token_id", "version") if c in vocab.columns]
    vocab.select(*names).write.mode(mode).parquet(path)


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header line plus one tab-separated line per row, without quoting."""
    (df.write.mode(mode).option("sep", "\t").option("header", True)
     .option("quote", "").option("emptyValue", "").csv(path))


def append_log(rows: DataFrame, path: str, key=("run", "epoch")) -> None:
    """Add rows to a tab-separated log, in the place of those with the same key.

    Every key has a folder of its own, which a later write for that key replaces as a whole: an
    epoch that is logged again, after a failure or by a retry, leaves its rows once. Other keys
    are not touched or read. `read_tsv` reads the log; the header stands in each file and is
    dropped there. The key stays in the lines.
    """
    folders = {f"by_{c}": F.col(c) for c in key}
    (rows.withColumns(folders).repartition(*key).write.mode("overwrite").partitionBy(*folders)
     .option("partitionOverwriteMode", "dynamic").option("sep", "\t").option("header", True)
     .option("quote", "").option("emptyValue", "").csv(path))


def write_epoch(batched: DataFrame, path: str, batches_per_file: int = 64,
                mode: str = "errorifexists") -> None:
    """Store an epoch so that its batches can be read in order and from any batch on.

    `batched` has `batch_id` and `row_index` (`assign_batches`). A file holds `batches_per_file`
    neighbouring batches in order, and file names are in the order of the batches. A task writes
    a run of files, so tasks follow the session's shuffle partitions and not the files. A
    small table beside them, one row a batch (batch_id, file, n_rows), is written after the rows:
    an epoch without it was not completed and is written again with mode="overwrite".
    """
    file_no = F.floor(F.col("batch_id") / batches_per_file).cast("int")
    spark = batched.sparkSession
    last, batch_size = _even_batches(batched, file_no)
    # without one batch size the files cannot be cut by rows: a task each
    tasks = last + 1 if batch_size is None else min(last + 1, max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), last // FILES_PER_TASK + 1))
    own = F.floor(file_no * F.lit(tasks).cast("bigint") / (last + 1)).cast("int")
    (batched.repartitionById(tasks, own).sortWithinPartitions("batch_id", "row_index")
     .write.mode(mode).option("maxRecordsPerFile", (batch_size or 0) * batches_per_file)
     .parquet(f"{path}/rows"))
    (spark.read.schema(batched.schema).parquet(f"{path}/rows")
     .groupBy("batch_id", F.col("_metadata.file_name").alias("file"))
     .agg(F.count("*").alias("n_rows")).write.mode(mode).parquet(f"{path}/index"))


def _even_batches(batched: DataFrame, file_no: Column) -> tuple[int, int | None]:
    """The last file, and the batch size where rows 0 .. n-1 are in batches of one size."""
    row, batch = F.col("row_index"), F.col("batch_id")
    facts = batched.agg(
        F.max(file_no).alias("last"), F.count("*").alias("n"), F.min(row).alias("low"),
        F.max(row).alias("high"), F.min(F.when(batch > 0, row / batch)).alias("least"),
        F.max((row + 1) / (batch + 1)).alias("size")).head()  # a few numbers
    if facts["n"] == 0:
        return 0, None
    # batch * size <= row < (batch + 1) * size for every row
    even = (facts["low"] == 0 and facts["high"] + 1 == facts["n"]
            and (facts["least"] is None or facts["size"] <= facts["least"]))
    return facts["last"], int(facts["size"]) if even else None
