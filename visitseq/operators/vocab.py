"""Vocabularies as dimension tables: one row per token with its id."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from visitseq.constants import AGE_SYMBOLS, MAX_AGE, NOT_LABELS, SPECIALS
from visitseq.functions.ages import age_count
from visitseq.operators.indexing import with_row_index
from visitseq.sources.scratch import materialize


def build_vocab(codes: DataFrame, code_col: str = "code", min_count: int = 1) -> DataFrame:
    """Specials first, then the codes by falling count and, among equals, by name.

    A code counts once per row: `plans.visit_vocab` gives one row per visit and code. Counting
    combines map-side, so a very common code costs one row per task. The ids are fixed in the
    table that the row index writes.
    """
    counts = (codes.groupBy(F.col(code_col).cast("string").alias("token"))
              .agg(F.count("*").alias("n"))
              .where((F.col("n") >= min_count) & ~F.col("token").isin(*SPECIALS)))
    ranked = with_row_index(counts, [F.desc("n"), F.asc("token")], "rank")
    known = ranked.select("token", (F.col("rank") + len(SPECIALS)).cast("int").alias("token_id"))
    specials = codes.sparkSession.createDataFrame(
        [(t, i) for i, t in enumerate(SPECIALS)], "token string, token_id int")
    return specials.unionByName(known)


def extend_vocab(vocab: DataFrame, codes: DataFrame, code_col: str = "code", min_count: int = 1
                 ) -> DataFrame:
    """(token, token_id, version): the vocabulary with the codes it does not have yet.

    Old tokens keep their ids, so tables encoded with an older version stay valid. New ones get
    the ids after the largest, by falling count in `codes` and, among equals, by name, and a
    version one above the highest (0 for a vocabulary that has none). `min_count` looks at
    `codes` alone; null codes are none. Without a new code nothing changes.
    """
    if "version" not in vocab.columns:
        vocab = vocab.withColumn("version", F.lit(0))
    old = materialize(vocab.select("token", F.col("token_id").cast("int"), "version"), "vocab")
    last = old.agg(F.coalesce(F.max("token_id"), F.lit(-1)),
                   F.coalesce(F.max("version"), F.lit(-1))).head()
    counts = (codes.groupBy(F.col(code_col).cast("string").alias("token"))
              .agg(F.count("*").alias("n"))
              .where((F.col("n") >= min_count) & F.col("token").isNotNull())
              .join(old, "token", "left_anti"))
    ranked = with_row_index(counts, [F.desc("n"), F.asc("token")], "rank")
    return old.unionByName(ranked.select(
        "token", (F.col("rank") + last[0] + 1).cast("int").alias("token_id"),
        F.lit(last[1] + 1).alias("version")))


def label_vocab(vocab: DataFrame) -> DataFrame:
    """Tokens that can be a label, with dense ids in the order of the vocabulary, whatever the
    token ids are."""
    tokens = vocab.where(~F.col("token").isin(*NOT_LABELS)).select("token", "token_id")
    return with_row_index(tokens, ["token_id"], "label_id").select(
        "token", F.col("label_id").cast("int").alias("label_id"))


def label_of_token(vocab: DataFrame, label_vocab: DataFrame) -> DataFrame:
    """(token_id, label_id) of the tokens that can be a label."""
    return vocab.join(label_vocab, "token").select(
        F.col("token_id").cast("bigint"), F.col("label_id").cast("bigint"))


def age_vocab(spark: SparkSession, max_age: int = MAX_AGE, mon: int = 1,
              symbols=AGE_SYMBOLS) -> DataFrame:
    """Symbols, then one id per month (mon=1) or year (mon=12) of age.

    For lookups use `age_id`, which computes the same id without a join.
    """
    symbols = [str(s) for s in symbols]
    head = spark.createDataFrame([(s, i) for i, s in enumerate(symbols)], "age string, age_id int")
    ages = spark.range(age_count(max_age, mon)).select(
        F.col("id").cast("string").alias("age"),
        (F.col("id") + len(symbols)).cast("int").alias("age_id"))
    return head.unionByName(ages)


@dataclass(frozen=True)
class VocabFacts:
    """What expressions need to know about a vocabulary: a handful of numbers."""

    size: int
    n_bytes: int
    ids: dict
    dense: bool = True  # whether the ids are 0 .. size - 1


def vocab_facts(vocab: DataFrame, id_col: str = "token_id") -> VocabFacts:
    """Size and special ids, in one aggregate; only this row comes to the driver."""
    row = vocab.agg(
        F.count("*").alias("size"),
        F.coalesce(F.sum(F.octet_length("token")), F.lit(0)).alias("n_bytes"),
        F.min(id_col).alias("low"), F.max(id_col).alias("high"),
        *[F.max(F.when(F.col("token") == t, F.col(id_col))).alias(t) for t in SPECIALS]).head()
    return VocabFacts(row["size"], row["n_bytes"],
                      {t: row[t] for t in SPECIALS if row[t] is not None},
                      row["low"] == 0 and row["high"] == row["size"] - 1)
