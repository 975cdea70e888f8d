"""The test tables read as event, demographic, scored and loss tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from visitseq.operators.indexing import with_row_index

GAPPED_SPECIALS = {"PAD": 70, "UNK": 120, "SEP": 20, "CLS": 210, "MASK": 90}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def diagnoses(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as visits of a customer, the brands ordered as codes."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    return (orders.join(items, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(parts, F.col("p_partkey") == F.col("l_partkey"))
            .select(F.col("o_custkey").alias("patid"),
                    F.col("o_orderdate").alias("eventdate"), F.col("p_brand").alias("code")))


def part_diagnoses(spark: SparkSession, sf: str) -> DataFrame:
    """The same visits with the part itself as code: a vocabulary that grows with the data."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    return (orders.join(items, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.col("o_custkey").alias("patid"), F.col("o_orderdate").alias("eventdate"),
                    F.col("l_partkey").cast("string").alias("code")))


def demographic(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("patid"),
        (F.lit(1930) + F.col("c_custkey") % 60).cast("int").alias("yob"))


def scored_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as logits of 64 classes; rounding makes ties."""
    logits = F.transform("embedding", lambda x: F.round(x.cast("double"), 1) + F.lit(0.0))
    target = F.transform("embedding", lambda x, k: F.when(
        (k == F.col("label")) | ((F.col("vec_id") * 7 + k * 13) % 5 == 0), 1).otherwise(0))
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("sample_id"), logits.alias("logits"), target.alias("target"))


def scored_masked(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as class logits of one position each, every seventh not masked."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("sample_id"),
        F.transform("embedding", lambda x: F.round(x.cast("double"), 2) + F.lit(0.0)).alias("logits"),
        F.when(F.col("vec_id") % 7 == 0, -1).otherwise(F.col("label")).alias("label"))


def batch_losses(spark: SparkSession, sf: str) -> DataFrame:
    """Line numbers as epochs, their lines as steps 0, 1, ... without a gap."""
    order = ["l_linenumber", "l_orderkey", "l_partkey", "l_suppkey"]
    lines = table(spark, sf, "lineitem").select(*order, "l_discount", "l_quantity")
    numbered = with_row_index(lines, order, "row")
    first = numbered.groupBy("l_linenumber").agg(F.min("row").alias("first"))
    return numbered.join(first, "l_linenumber").select(
        F.col("l_linenumber").cast("bigint").alias("epoch"),
        (F.col("row") - F.col("first")).alias("step"),
        F.col("l_discount").alias("loss"), F.col("l_quantity").alias("examples"))


def gapped_vocab(words: DataFrame) -> DataFrame:
    """The vocabulary with other ids: gaps between them, specials among the codes."""
    ids = F.create_map(*[F.lit(x) for pair in GAPPED_SPECIALS.items() for x in pair])
    return words.select("token", F.coalesce(
        F.element_at(ids, F.col("token")), F.col("token_id") * 10 + 3).cast("int").alias("token_id"))


def epoch_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as runs, line numbers as epochs."""
    return (table(spark, sf, "lineitem")
            .groupBy(F.col("l_suppkey").alias("run_id"),
                     F.col("l_linenumber").cast("bigint").alias("epoch"))
            .agg(F.round(F.avg("l_discount"), 6).alias("ap"),
                 F.round(F.avg("l_tax"), 6).alias("auc")))
