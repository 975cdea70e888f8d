"""From an event table and a demographic table to one sequence per person."""

from pyspark.sql import DataFrame, functions as F

from visitseq.operators.events import distinct_events, select_events, unique_demographic
from visitseq.operators.visits import build_sequences, build_visits
from visitseq.operators.vocab import build_vocab
from visitseq.sources.scratch import materialize, materialize_by


def clean_events(diagnoses: DataFrame, code_col: str = "code") -> DataFrame:
    return distinct_events(select_events(diagnoses, code_col))


def format_sequences(diagnoses: DataFrame, demographic: DataFrame,
                     code_col: str = "code") -> DataFrame:
    """Events to visits to sequences with two shuffles of the event side.

    The first, by person and date, receives events already combined per task;
    the second, by person, receives visits. The code array has the name of the
    code column.
    """
    visits = build_visits(select_events(diagnoses, code_col))
    rows = build_sequences(visits, unique_demographic(demographic))
    return rows.withColumnRenamed("code", code_col)


def visit_table(diagnoses: DataFrame, code_col: str = "code", buckets: int | None = None
                ) -> DataFrame:
    """The visits, written once: vocabulary, histories and labels all read them, and the raw
    events are scanned and shuffled a single time. They lie in buckets by person (at most one
    row a day each), so cuts, tails, labels and joins with people need no exchange of visits."""
    visits = build_visits(select_events(diagnoses, code_col))
    return materialize_by(visits, "patid", "visits", buckets)


def people_table(demographic: DataFrame) -> DataFrame:
    """One row per person, written once for the joins with events."""
    return materialize(unique_demographic(demographic), "people")


def visit_vocab(visits: DataFrame, min_count: int = 1) -> DataFrame:
    """Vocabulary of the codes of a visit table; a code counts once per visit.

    Stored, as every later step joins it."""
    return materialize(
        build_vocab(visits.select(F.explode("code").alias("code")), min_count=min_count), "vocab")
