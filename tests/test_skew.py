"""One person, day or code with a third of all rows."""

import datetime as dt
import random

from visitseq import plans
from visitseq.operators import events, labels, vocab, visits

D = dt.date


def skewed(spark):
    rng = random.Random(1)
    rows = [(p, D(2000, 1, 1) + dt.timedelta(days=rng.randrange(900)), f"c{rng.randrange(40)}")
            for p in range(200) for _ in range(30)]
    rows += [(0, D(2000, 1, 1) + dt.timedelta(days=rng.randrange(900)), "c0") for _ in range(3000)]
    rows += [(0, D(2001, 1, 1), f"c{rng.randrange(40)}") for _ in range(3000)]
    return rows, spark.createDataFrame(rows, "patid long, eventdate date, code string")


def brute_sequences(rows):
    out = {}
    for patid, day, code in sorted(set(rows)):
        out.setdefault(patid, {}).setdefault(day, []).append(code)
    return {p: [t for day in sorted(v) for t in sorted(v[day]) + ["SEP"]] for p, v in out.items()}


def test_results_are_whole(spark):
    rows, df = skewed(spark)
    people = spark.createDataFrame([(p, 1950) for p in range(200)], "patid long, yob int")
    want = brute_sequences(rows)
    whole = {r.patid: r.code for r in plans.format_sequences(df, people).collect()}
    assert whole == want
    built = plans.visit_table(df)
    parts = sorted(visits.build_sequences(built, people, 100).collect(),
                   key=lambda r: (r.patid, r.part))
    joined = {}
    for r in parts:
        assert len(r.code) < 100 + 31 * 41  # and one month
        joined.setdefault(r.patid, []).extend(r.code)
    assert joined == want
    tails = {r.patid: r.code for r in visits.sequence_tails(built, people, 16, 1).collect()}
    assert tails == {p: c[-15:] for p, c in want.items()}


def test_encoding_and_labels_of_the_hot_person(spark):
    rows, df = skewed(spark)
    people = spark.createDataFrame([(p, 1950) for p in range(200)], "patid long, yob int")
    built = plans.visit_table(df)
    words = plans.visit_vocab(built)
    labelled = plans.labelled_rows(built, people, tokens_per_row=500)
    assert labelled.where("part > 0").count() > 0
    table = plans.prediction_table(labelled, words, 32)
    encoded = {r.patid: r for r in table.collect()}
    assert len(encoded) == 200
    ids = {r.token: r.token_id for r in words.collect()}
    names = {r.token: r.label_id for r in vocab.label_vocab(words).collect()}
    cut = {r.patid: r.cut_no for r in
           labels.pick_cuts(built).select("patid", "cut_no").distinct().collect()}
    for patid, tokens in brute_sequences(rows).items():
        days = " ".join(tokens).split(" SEP")
        history = [t for day in days[:cut[patid]] for t in day.split() + ["SEP"]][-31:]
        history = ["CLS"] + (history[1:] if history[0] == "SEP" else history)
        want = [ids[t] for t in history]
        assert encoded[patid].code == want + [0] * (32 - len(want))
        label = sorted(names[t] for t in days[cut[patid]].split())
        assert encoded[patid].label_ids == label
        assert encoded[patid].label == label + [-1] * (32 - len(label))


def test_a_day_with_a_vocabulary_of_its_own(spark):
    full = [(0, D(2001, 6, 1), f"x{i:06d}") for i in range(100_000)]
    rows = [(p, D(2000, 1, 1) + dt.timedelta(days=9 * d), f"c{d % 7}")
            for p in range(20) for d in range(80)] + full
    df = spark.createDataFrame(rows, "patid long, eventdate date, code string")
    people = spark.createDataFrame([(p, 1950) for p in range(20)], "patid long, yob int")
    parts = visits.build_sequences(visits.build_visits(df), people, 1000).collect()
    joined = {}
    for r in sorted(parts, key=lambda r: r.part):
        assert len(r.code) == len(r.age)
        joined.setdefault(r.patid, []).extend(r.code)
    assert joined == brute_sequences(rows)


def test_event_join_splits_a_hot_person(spark):
    """With both sides straight from a shuffle AQE may split the hot partition."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2000",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000"}
    rows, df = skewed(spark)
    demographic = spark.createDataFrame([(p, 1950) for p in range(200)], "patid long, yob int")
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        joined = events.join_demographic(df, plans.people_table(demographic))
        assert joined.count() == len(rows)
        out = events.add_age(joined)
        assert len(out.collect()) == len(rows)
        assert "skewed" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)
