"""Pre-training tables: encoded once, masked and shuffled for every epoch."""

from pyspark.sql import DataFrame

from visitseq.constants import BATCH_SIZE, MIN_VISITS, MLM_MAX_LEN
from visitseq.operators.batches import assign_batches
from visitseq.operators.encode import encode_sequences
from visitseq.operators.events import unique_demographic
from visitseq.operators.masking import mask_rows
from visitseq.operators.visits import sequence_tails
from visitseq.sources.scratch import materialize


def encoded_table(visits: DataFrame, demographic: DataFrame, vocab: DataFrame,
                  max_len: int = MLM_MAX_LEN, min_visits: int = MIN_VISITS) -> DataFrame:
    """Encoded rows of the persons with enough visits, written once for all epochs."""
    tails = sequence_tails(visits, unique_demographic(demographic), max_len, min_visits)
    return materialize(encode_sequences(tails, vocab, max_len), "encoded")


def pretraining_table(encoded: DataFrame, vocab: DataFrame, max_len: int = MLM_MAX_LEN,
                      epoch: int = 0, seed: int = 0, batch_size: int = BATCH_SIZE,
                      key=("patid",)) -> DataFrame:
    """One epoch of an encoded table: its batches, in a new order, with a new mask.

    `key` are the columns that identify a row; order and mask are drawn from them. The only
    shuffle is the one into the order of the epoch.
    """
    batches = assign_batches(encoded, batch_size, epoch, seed, key)
    return mask_rows(batches, vocab, max_len, epoch, seed, key=key)
