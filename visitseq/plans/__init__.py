from visitseq.plans.formatting import (
    clean_events, format_sequences, people_table, visit_table, visit_vocab)
from visitseq.plans.prediction import (
    counting_report, labelled_rows, prediction_rows, prediction_table)
from visitseq.plans.pretraining import encoded_table, pretraining_table

__all__ = ["clean_events", "counting_report", "encoded_table", "format_sequences", "labelled_rows",
           "people_table", "prediction_rows", "prediction_table", "pretraining_table", "visit_table", "visit_vocab"]
