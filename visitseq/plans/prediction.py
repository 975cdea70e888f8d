"""Labelled and encoded tables for predicting future codes, and their report."""

from pyspark.sql import DataFrame, functions as F

from visitseq.constants import MIN_VISITS, PREDICTION_MAX_LEN
from visitseq.operators import metrics, score
from visitseq.operators.encode import encode_next_visit
from visitseq.operators.events import unique_demographic
from visitseq.operators.labels import (
    distinct_labels, label_horizon, label_next_visit, pick_cuts, split_patients, tails_horizons,
    tails_next_visit)
from visitseq.operators.visits import TOKENS_PER_ROW, tail_visits
from visitseq.operators.vocab import label_vocab

KEY = ("patid", "split")


def labelled_rows(visits: DataFrame, demographic: DataFrame, months: int | None = None,
                  min_visits: int = MIN_VISITS, test_share: float = 0.2, seed: int = 0,
                  tokens_per_row: int = TOKENS_PER_ROW) -> DataFrame:
    """(patid, cut_date, part, code, age, label, split): whole histories in parts, whole label
    lists; months=None labels the next visit."""
    cuts = pick_cuts(visits, min_visits - 1, seed)
    people = unique_demographic(demographic)
    if months is None:
        rows = label_next_visit(visits, cuts, people, tokens_per_row)
    else:
        rows = label_horizon(visits, cuts, people, months, tokens_per_row)
    return split_patients(rows, test_share, seed)


def prediction_table(labelled: DataFrame, vocab: DataFrame, max_len: int = PREDICTION_MAX_LEN,
                     key=KEY, part: str | None = "part", names: DataFrame | None = None
                     ) -> DataFrame:
    """Encoded rows of a labelled table; the split stays as it was drawn, as part of the key."""
    names = label_vocab(vocab) if names is None else names
    return encode_next_visit(distinct_labels(labelled), vocab, names, max_len, key=key, part=part)


def prediction_rows(visits: DataFrame, demographic: DataFrame, months: int | None = None,
                    max_len: int = PREDICTION_MAX_LEN, min_visits: int = MIN_VISITS,
                    test_share: float = 0.2, seed: int = 0) -> DataFrame:
    """(patid, cut_date, code, age, label, split): what an encoder reads of `labelled_rows`, the
    end of each history and the whole label, without building the history."""
    cuts = pick_cuts(visits, min_visits - 1, seed, tail_visits(max_len))
    people = unique_demographic(demographic)
    if months is None:
        rows = tails_next_visit(visits, cuts, people, max_len)
    else:
        rows = tails_horizons(visits, cuts, people, [months], max_len).drop("months")
    return split_patients(rows, test_share, seed)


def counting_report(train: DataFrame, test: DataFrame, vocab: DataFrame, names: DataFrame,
                    key=("patid",), min_support: int | None = score.MIN_SUPPORT,
                    max_labels: int | None = score.MAX_LABELS) -> DataFrame:
    """One row: the metrics of the counting scorer on encoded test rows."""
    model = score.history_model(train, vocab, names, min_support, max_labels)
    scored = score.next_code_scores(test, model, key)
    loss = model.labels.agg(F.sum(metrics.soft_margin(
        F.col("if_new") / score.UNITS, F.lit(0)))).head()[0]
    return metrics.mean_metrics(
        metrics.sparse_sample_metrics(scored, model.n_labels, loss or 0.0, key))
