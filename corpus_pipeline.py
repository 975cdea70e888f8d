"""From documents to packed training sequences: five stages, each written and read again.

A stage works on all rows that the one before kept. Rows are handled one by one, so repeated
rows, rows without doc_id and empty or null texts pass through like others: an empty text is
scored by the classifier, texts with equal words (all empty ones, too) leave one row, and every
row left is packed with its end id at least. Other columns of documents stay.

The working tables of a stage stay until the next stage for the same ``sf_dir`` begins, which
reads what was written of its predecessor: write a stage's result before calling the next. Those
of the last stage stay, as its result is read from them.
"""

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from visitseq.llm import decontaminate as leaks
from visitseq.llm import packing, quality as lines, secrets as tokens, similarity
from visitseq.sources import drop_table, materialize, recording

KEEP_FROM = 0.3
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_working: dict[tuple[str, str], list[str]] = {}


def _stage(function: Stage) -> Stage:
    """Drops the working tables of the stage before; notes those of this one."""
    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir)
        for path in _working.pop(key, []):
            drop_table(spark, path)
        with recording() as paths:
            out = function(spark, docs, sf_dir)
        if function.__name__ != STAGES[-1][1].__name__:
            _working[key] = paths
        return out
    return run


def _whole(docs: DataFrame) -> DataFrame:
    """The rows as one struct beside their text: nothing can clash with it."""
    return docs.select(F.struct(*docs.columns).alias("row"), "text")


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of at least KEEP_FROM stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = lines.learn(docs, labels.filter(~lines.held_out()))
    scored = lines.score(_whole(docs), model, key="row")
    return scored.filter(F.col("score") >= KEEP_FROM).select("row.*")


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts stays."""
    return similarity.deduplicate(docs)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of words with a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = leaks.decontaminate(_whole(docs), items, key="row")
    return found.filter(~F.col("contaminated")).select("row.*")


@_stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; n_chars of such documents is counted anew."""
    found = tokens.find_secrets(_whole(docs), ["row"])
    text = tokens.redact(F.col("row.text"), F.col("spans"))
    changed = {"text": text, "n_chars": F.when(F.size("spans") > 0, F.length(text)
                                               .cast(docs.schema["n_chars"].dataType))
               .otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {"text": text}
    return found.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences along the curve."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontaminate),
    ("secret scans", secrets),
    ("packing", pack),
]

ORACLE_SQL = None  # the classifier and the tokenizer are not SQL; see tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the pieces of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
