"""Producers of scored tables, in the place of a trained network."""

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from visitseq.constants import BATCH_SIZE
from visitseq.operators.indexing import with_running_sum
from visitseq.operators.lookup import join_vocab
from visitseq.operators.vocab import VocabFacts, label_of_token, vocab_facts
from visitseq.sources.scratch import materialize

# A (history code, label) pair counts from so many samples on, and for so many labels a code.
MIN_SUPPORT = 3
MAX_LABELS = 200
UNITS = 1_000_000


class HistoryModel(NamedTuple):
    """`labels`: label_id, if_new, least, above; `pairs`: token_id, label_id, weight. Logits and
    weights are whole millionths, so that their sums do not depend on the order."""

    labels: DataFrame
    pairs: DataFrame
    n_labels: int
    n_pairs: int


def _logit(part: Column, rest: Column) -> Column:
    return F.log((part + 0.5) / (rest + 0.5))


def _units(value: Column) -> Column:
    return F.round(value * UNITS).cast("bigint")


def _history(encoded: DataFrame, *keep) -> DataFrame:
    """One row per sample and token id of its history."""
    return encoded.select(*keep, F.explode(F.array_distinct("code")).alias("token_id"))


def _wanted() -> Column:
    return F.array_distinct(F.filter("label_ids", lambda i: i >= 0))


def _in_order(values: DataFrame) -> DataFrame:
    """(value, own) with `least`: the sum of own of all values at least as high."""
    return with_running_sum(values, [F.desc("value")], "own", "least")


def history_model(train: DataFrame, vocab: DataFrame, label_vocab: DataFrame,
                  min_support: int | None = MIN_SUPPORT, max_labels: int | None = MAX_LABELS,
                  broadcast_bytes: int | None = None) -> HistoryModel:
    """How much each code of a history speaks for each label: smoothed log-odds from train rows.

    A label has the log-odds to follow at all, `if_new`. A code c of the history adds the
    log-odds ratio of the label with and without c. Only pairs that `min_support` samples hold
    count, and of each code only the `max_labels` best supported ones (ties: smaller label id);
    None for both keeps every pair that occurs.

    Codes below the support are dropped before pairs are counted. A sample gives its distinct
    history codes (at most max_len) times its labels as rows, which are summed in the task, so
    what is shuffled is bounded by distinct pairs a task.
    """
    least = min_support or 1
    facts = vocab_facts(vocab)
    known = label_of_token(vocab, label_vocab).select("token_id")
    totals = _history(train).groupBy("token_id").agg(F.count("*").alias("n_code"))
    codes = materialize(totals.where(F.col("n_code") >= least)
                        .join(known, "token_id", "left_semi"), "codes")
    n = train.count()
    counts = train.select(F.explode(_wanted()).alias("label_id")).groupBy("label_id").agg(
        F.count("*").alias("n_label"))
    labels = materialize(label_vocab.select(F.col("label_id").cast("bigint")).join(
        counts, "label_id", "left").na.fill(0).withColumn("if_new", _units(
            _logit(F.col("n_label"), n - F.col("n_label")))), "label-counts")
    kept = join_vocab(_history(train, _wanted().alias("wanted")), codes, ["token_id"], facts,
                      broadcast_bytes=broadcast_bytes).where("n_code is not null")
    pairs = (kept.select("token_id", "n_code", F.explode("wanted").alias("label_id"))
             .groupBy("token_id", "n_code", "label_id").agg(F.count("*").alias("both"))
             .where(F.col("both") >= least))
    if max_labels is not None:
        best = Window.partitionBy("token_id").orderBy(F.desc("both"), "label_id")
        pairs = pairs.withColumn("_place", F.row_number().over(best)).where(
            F.col("_place") <= max_labels)
    both, n_code, n_label = F.col("both"), F.col("n_code"), F.col("n_label")
    weight = (_logit(both, n_code - both)
              - _logit(n_label - both, n - n_code - n_label + both))
    pairs = materialize(pairs.join(labels, "label_id").select(
        "token_id", "label_id", _units(weight).alias("weight")), "pairs")
    values = labels.groupBy(F.col("if_new").alias("value")).agg(F.count("*").alias("own"))
    ranks = _in_order(values).select(F.col("value").alias("if_new"), "least",
                                     (F.col("least") - F.col("own")).alias("above"))
    labels = materialize(labels.join(ranks, "if_new").select(
        "label_id", "if_new", "least", "above"), "labels")
    return HistoryModel(labels, pairs, labels.count(), pairs.count())


def next_code_scores(test: DataFrame, model: HistoryModel, key=("patid",),
                     broadcast_bytes: int | None = None) -> DataFrame:
    """Scores of encoded test rows, for the labels that a code of the history speaks for or
    that are to predict.

    (key, label_id, logit, target, if_new, least, above). Every other label of a sample has the
    logit `if_new` of the model and the target 0: rows grow with the histories, not with samples
    times labels. `least` and `above` count the labels whose `if_new` is at least, or above, the
    logit; `metrics.sparse_sample_metrics` works on these rows.
    """
    pair_facts = VocabFacts(model.n_pairs, 0, {})
    label_facts = VocabFacts(model.n_labels, 0, {})
    added = (join_vocab(_history(test, *key), model.pairs, ["token_id"], pair_facts,
                        broadcast_bytes=broadcast_bytes).where("weight is not null")
             .select(*key, "label_id", "weight", F.lit(0).alias("target")))
    wanted = test.select(*key, F.explode(_wanted()).alias("label_id"),
                         F.lit(0).cast("bigint").alias("weight"), F.lit(1).alias("target"))
    sums = added.unionByName(wanted).groupBy(*key, "label_id").agg(
        F.sum("weight").alias("weight"), F.max("target").alias("target"))
    rows = materialize(join_vocab(sums, model.labels, ["label_id"], label_facts,
                                  broadcast_bytes=broadcast_bytes).where("if_new is not null"),
                       "sums")
    # a logit with a weight is looked up among the defaults; one without has its label's place
    moved = rows.where("weight != 0").withColumn("value", F.col("if_new") + F.col("weight"))
    values = (moved.select("value", F.lit(0).alias("own")).distinct()
              .unionAll(model.labels.select("if_new", F.lit(1)))
              .groupBy("value").agg(F.sum("own").alias("own")))
    ranks = _in_order(values)
    placed = (moved.drop("least", "above").join(ranks, "value")
              .withColumn("above", F.col("least") - F.col("own"))
              .unionByName(rows.where("weight = 0").withColumn("value", F.col("if_new")),
                           allowMissingColumns=True))
    return placed.select(*key, "label_id", (F.col("value") / UNITS).alias("logit"), "target",
                         (F.col("if_new") / UNITS).alias("if_new"), "least", "above")


_loaded: dict[str, Callable] = {}  # of this Python worker


def _model(token: str, make_predict: Callable) -> Callable:
    """The model of a scoring job; a worker makes it once, for all its tasks."""
    if token not in _loaded:
        _loaded.clear()
        _loaded[token] = make_predict()
    return _loaded[token]


def score_batches(encoded: DataFrame, make_predict: Callable[[], Callable],
                  inputs=("code", "mask"), key=("patid",), batch_size: int = BATCH_SIZE
                  ) -> DataFrame:
    """(key, logits) of a caller's model.

    `make_predict` loads the model, once a Python worker, and returns the function that scores:
    it gets one 2-d array per input column and returns a 2-d array [rows, classes]. It sees up to
    batch_size rows at a time. `key` columns are passed on as they are. Arrays of one column must
    have one length and no nulls, as the encoders make them; anything else stops the job. Load
    large models from a path inside `make_predict`: what it closes over travels with each task.
    """
    inputs, key, token = list(inputs), list(key), uuid.uuid4().hex

    def matrix(column):
        if column.null_count or column.flatten().null_count:
            raise ValueError("null in an array to score")
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        if (sizes != sizes[0]).any():
            raise ValueError("arrays of several lengths")
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), sizes[0])

    def score(batches):
        import numpy as np
        import pyarrow as pa
        for whole in batches:
            for start in range(0, whole.num_rows, batch_size):
                batch = whole.slice(start, batch_size)
                predict = _model(token, make_predict)
                logits = np.asarray(predict(*[matrix(batch.column(c)) for c in inputs]), "float64")
                ends = np.arange(len(logits) + 1, dtype=np.int32) * logits.shape[1]
                out = pa.ListArray.from_arrays(pa.array(ends), pa.array(logits.ravel()))
                yield pa.RecordBatch.from_arrays([*map(batch.column, key), out], [*key, "logits"])

    fields = [encoded.schema[k] for k in key]
    logits = T.StructField("logits", T.ArrayType(T.DoubleType()))
    return encoded.select(*key, *[c for c in inputs if c not in key]).mapInArrow(
        score, T.StructType([*fields, logits]))


def scored_rows(scored: DataFrame, sample_col: str, target_col: str = "target",
                keep=()) -> DataFrame:
    """Array scores (`logits` and a 0/1 array of the same length) to long rows.

    The arrays are shuffled by sample before they are taken apart: the ranking
    metrics then find their rows in place, and one row per sample moves.
    """
    return (scored.repartition(sample_col)
            .select(F.col(sample_col).alias("sample_id"), *keep,
                    F.posexplode(F.arrays_zip("logits", F.col(target_col).alias("target"))))
            .select("sample_id", *keep, F.col("pos").cast("bigint").alias("label_id"),
                    F.col("col.logits").alias("logit"), F.col("col.target").alias("target")))
