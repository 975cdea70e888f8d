import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from visitseq import plans, sources
from visitseq.operators import events, visits
from workload import queries, tables

D = dt.date


@pytest.fixture
def diagnoses(spark):
    return spark.createDataFrame(
        [(1, D(2000, 1, 10), "B"), (1, D(2000, 1, 10), "A"), (1, D(2000, 1, 10), "A"),
         (1, D(2001, 3, 5), "C"), (1, D(2001, 3, 6), None), (2, D(2000, 1, 1), "A")],
        "patid long, eventdate date, code string")


@pytest.fixture
def demographic(spark):
    return spark.createDataFrame([(1, 1950), (3, 1960)], "patid long, yob int")


def test_sequence_of_one_person(diagnoses, demographic):
    rows = plans.format_sequences(diagnoses, demographic).collect()
    assert [(r.patid, r.part, r.code, r.age) for r in rows] == [
        (1, 0, ["A", "B", "SEP", "C", "SEP"], ["600", "600", "600", "614", "614"])]


def test_code_column_is_a_parameter(diagnoses, demographic):
    renamed = diagnoses.withColumnRenamed("code", "icd")
    assert plans.format_sequences(renamed, demographic, "icd").head().icd == [
        "A", "B", "SEP", "C", "SEP"]


def test_several_years_of_birth_give_one_row(spark, diagnoses):
    people = spark.createDataFrame([(1, 1950), (1, 1955), (2, None)], "patid long, yob int")
    rows = plans.format_sequences(diagnoses, people).collect()
    assert [(r.patid, r.age[0]) for r in rows] == [(1, "600")]
    report = events.demographic_conflicts(people).head()
    assert (report.persons, report.conflicting) == (1, 1)


def test_age_in_years(diagnoses, demographic):
    aged = events.add_age(events.join_demographic(diagnoses, demographic), unit="year")
    assert {r.age for r in aged.collect()} == {50, 51}


def test_timestamps_of_one_day_are_one_visit(spark):
    rows = spark.createDataFrame(
        [(1, dt.datetime(2000, 1, 1, 8), "A"), (1, dt.datetime(2000, 1, 1, 20), "B")],
        "patid long, eventdate timestamp_ntz, code string")
    assert visits.build_visits(events.select_events(rows, "code")).head().code == ["A", "B"]


def many_visits(spark, n_patients=7, n_visits=12):
    rows = [(p, D(2000, 1, 1) + dt.timedelta(days=9 * v), f"c{(p * v + k) % 5}")
            for p in range(n_patients) for v in range(n_visits + p) for k in range(1 + v % 3)]
    return spark.createDataFrame(rows, "patid long, eventdate date, code string")


def people(spark, n=7):
    return spark.createDataFrame([(p, 1950 + p) for p in range(n)], "patid long, yob int")


def test_invariants(spark):
    seq = plans.format_sequences(many_visits(spark), people(spark))
    checked = seq.select(
        (F.size("code") == F.size("age")).alias("same"),
        (F.size(F.filter("code", lambda t: t == "SEP")) - 12 - F.col("patid")).alias("extra"))
    assert {tuple(r) for r in checked.collect()} == {(True, 0)}


def test_long_sequences_continue_in_parts(spark):
    built = visits.build_visits(many_visits(spark))
    whole = {r.patid: (r.code, r.age)
             for r in visits.build_sequences(built, people(spark)).collect()}
    parts = visits.build_sequences(built, people(spark), tokens_per_row=10).collect()
    assert max(r.part for r in parts) > 1
    for patid, (code, age) in whole.items():
        own = sorted((r for r in parts if r.patid == patid), key=lambda r: r.part)
        assert sum((r.code for r in own), []) == code
        assert sum((r.age for r in own), []) == age
        # fewer than 10 tokens and a month more, which is four visits of four tokens
        assert all(r.code[-1] == "SEP" and len(r.code) < 10 + 16 for r in own)


@pytest.mark.parametrize("max_len", [4, 5, 16, 64])
def test_tails_are_the_end_of_the_sequences(spark, max_len):
    built = visits.build_visits(many_visits(spark))
    whole = visits.build_sequences(built, people(spark)).collect()
    tails = visits.sequence_tails(built, people(spark), max_len, 5).collect()
    assert ({(r.patid, tuple(r.code[1 - max_len:]), tuple(r.age[1 - max_len:])) for r in whole}
            == {(r.patid, tuple(r.code), tuple(r.age)) for r in tails})


def test_running_history_are_prefixes(spark):
    built = visits.build_visits(many_visits(spark))
    whole = {r.patid: r for r in visits.build_sequences(built, people(spark)).collect()}
    for r in visits.running_history(built, people(spark), 8).collect():
        assert r.code == whole[r.patid].code[:r.n_tokens][-7:]
        assert r.age == whole[r.patid].age[:r.n_tokens][-7:]
        assert whole[r.patid].code[:r.n_tokens].count("SEP") == r.n_visits


@pytest.mark.parametrize("tokens_per_row", [1, 30, 1000])
def test_references_give_the_whole_history(spark, tokens_per_row):
    built = visits.build_visits(many_visits(spark))
    whole = {r.patid: r for r in visits.build_sequences(built, people(spark)).collect()}
    index = visits.history_index(built)
    parts = visits.build_sequences(built, people(spark), tokens_per_row)
    found = {}
    for r in sorted(visits.history_prefixes(index, parts).collect(), key=lambda r: r.part):
        found.setdefault((r.patid, r.n_tokens), []).extend(zip(r.code, r.age))
    assert len(found) == index.count()
    for (patid, n), tokens in found.items():
        assert tokens == list(zip(whole[patid].code, whole[patid].age))[:n]


def test_null_codes_make_no_visit(spark):
    rows = [(1, D(2000, 1, 1), None), (1, D(2000, 1, 2), "A"), (1, D(2000, 1, 2), None)]
    df = spark.createDataFrame(rows, "patid long, eventdate date, code string")
    assert [tuple(r) for r in visits.build_visits(df).collect()] == [(1, D(2000, 1, 2), ["A"])]


@pytest.mark.parametrize("tokens_per_row", [1, 7, 10, 1000])
def test_stored_parts_give_the_same_tails(spark, tokens_per_row):
    built = visits.build_visits(many_visits(spark))
    parts = visits.build_sequences(built, people(spark), tokens_per_row)
    want = {(r.patid, tuple(r.code), tuple(r.age))
            for r in visits.sequence_tails(built, people(spark), 16, 15).collect()}
    enough = visits.min_visits_of_sequences(parts, 15)
    got = {(r.patid, tuple(r.code), tuple(r.age)) for r in visits.last_tokens(enough, 16).collect()}
    assert got == want
    one_row = visits.build_sequences(built, people(spark)).drop("part")
    assert visits.min_visits_of_sequences(one_row, 15).count() == len(want)


def test_min_visits(spark):
    built = visits.build_visits(many_visits(spark))
    kept = visits.min_visits(built, 15).select("patid").distinct().collect()
    assert {r.patid for r in kept} == {3, 4, 5, 6}
    tails = visits.sequence_tails(built, people(spark), 4, 15)
    assert {r.patid for r in tails.collect()} == {3, 4, 5, 6}


def test_horizon_tables_are_written_once_without_whole_histories(spark):
    with sources.recording() as paths:
        rows, *_ = queries._encoded(spark, SMALL, 12)
    stored = [p for p in paths if any(f"visitseq-{n}-" in p for n in ("labelled", "train", "test"))]
    assert len(stored) == 1
    table = spark.read.parquet(stored[0])
    assert {r["_table"] for r in table.select("_table").distinct().collect()} == {"train", "test"}
    assert table.where("size(code) > 99").count() == 0 < table.count()
    whole = plans.prediction_table(plans.labelled_rows(
        queries._stored(spark, SMALL), tables.demographic(spark, SMALL), 12, seed=queries.SEED),
        queries._vocab(spark, SMALL))
    assert sorted(rows.collect()) == sorted(whole.collect())
