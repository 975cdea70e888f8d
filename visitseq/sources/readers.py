"""Readers. Each returns a lazy DataFrame; nothing is held by the driver."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# An epoch's files are listed one by one up to so many.
FILES_BY_NAME = 100


def _header(spark: SparkSession, path: str) -> str:
    """The first line with text in the first file, by name, that holds anything."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0)
    first = files.agg(F.min("path")).head()[0]  # names and lengths only, no content
    line = first and spark.read.text(first).where(F.length("value") > 0).head()
    if not line:
        raise ValueError(f"no header line in {path}")
    return line["value"]


def read_tsv(spark: SparkSession, path: str, ragged: str = "raise") -> DataFrame:
    """Tab-separated text with a header; every column is a string.

    Every line equal to the header is dropped, wherever it stands, so parts
    with and without a header line mix. There is no quoting and an empty field
    stays an empty string, which the CSV reader cannot be told to do. A line with
    another number of fields than the header stops the job; with ragged="drop"
    such lines are left out.
    """
    if ragged not in ("raise", "drop"):
        raise ValueError(f"ragged must be raise or drop, not {ragged}")
    header = _header(spark, path)
    names = header.split("\t")
    fields = F.split("value", "\t", -1)
    fits = F.size(fields) == len(names)
    if ragged == "raise":
        message = F.concat(F.lit(f"not {len(names)} fields: "), F.substring("value", 1, 200))
        fits = F.when(fits, True).otherwise(F.raise_error(message).cast("boolean"))
    return (spark.read.text(path).where(F.col("value") != header).where(fits)
            .select(*[F.get(fields, F.lit(i)).alias(name) for i, name in enumerate(names)]))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated text with a header; every column is a string."""
    return spark.read.csv(path, header=True)


def _as_text(kind: T.DataType) -> T.DataType:
    """The type with every binary in it replaced by string."""
    if isinstance(kind, T.BinaryType):
        return T.StringType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_as_text(kind.elementType), kind.containsNull)
    if isinstance(kind, T.MapType):
        return T.MapType(_as_text(kind.keyType), _as_text(kind.valueType), kind.valueContainsNull)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _as_text(f.dataType), f.nullable)
                             for f in kind.fields])
    return kind


def read_parquet(spark: SparkSession, path: str, binary_as_string: bool = True) -> DataFrame:
    """Parquet; binary is read as text, also inside arrays, maps and structs, as old writers
    leave it."""
    df = spark.read.parquet(path)
    if not binary_as_string:
        return df
    return df.select(*[
        F.col(f"`{f.name}`").cast(_as_text(f.dataType)).alias(f.name)
        if _as_text(f.dataType) != f.dataType else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """A stored vocabulary: one row per token with its id."""
    stored = spark.read.parquet(path)
    more = [c for c in ("version",) if c in stored.columns]
    return stored.select("token", F.col("token_id").cast("int"), *more)


def read_epoch(spark: SparkSession, path: str, start: int = 0, stop: int | None = None
               ) -> DataFrame:
    """The batches from `start` on (below `stop`) of an epoch that `write_epoch` stored.

    Only the files that the index names for them are opened, and of these only the row groups
    with such batches are read. Rows of a file come in the order of the epoch. A few files are
    opened by name; more of them are a range of names, taken from one listing of the folder.
    """
    def wanted(df):
        kept = df.where(F.col("batch_id") >= start)
        return kept if stop is None else kept.where(F.col("batch_id") < stop)

    files = wanted(spark.read.parquet(f"{path}/index")).select("file")
    names = files.distinct().limit(FILES_BY_NAME + 1).collect()
    schema = spark.read.parquet(f"{path}/rows").schema
    if not names:
        return spark.createDataFrame([], schema)
    read = spark.read.schema(schema)
    if len(names) <= FILES_BY_NAME:
        return wanted(read.parquet(*[f"{path}/rows/{row.file}" for row in sorted(names)]))
    low, high = files.agg(F.min("file"), F.max("file")).head()
    name = F.col("_metadata.file_name")
    return wanted(read.parquet(f"{path}/rows").where(name.between(low, high)))


def read_batch(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """One batch of a stored epoch, in its order."""
    return read_epoch(spark, path, batch_id, batch_id + 1).orderBy("row_index")
