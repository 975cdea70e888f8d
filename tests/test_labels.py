import datetime as dt

from pyspark.sql import functions as F

from visitseq.operators import batches, indexing, labels

D = dt.date
DAYS = [(D(2000, 1, 1), ["A"]), (D(2000, 2, 1), ["B"]), (D(2000, 3, 1), ["C"]),
        (D(2000, 4, 1), ["D"]), (D(2000, 5, 1), ["E"]), (D(2000, 10, 1), ["A", "F"]),
        (D(2000, 12, 1), ["G"])]


def cuts_after_visit_4(spark):
    visits = spark.createDataFrame([(1, d, c) for d, c in DAYS],
                                   "patid long, eventdate date, code array<string>")
    picked = labels.pick_cuts(visits).select("patid", "n_visits", "last_date")
    return visits, labels.at_cut(picked.withColumn("cut_no", F.lit(4)), visits)


def people(spark):
    return spark.createDataFrame([(1, 1950)], "patid long, yob int")


def test_next_visit(spark):
    row = labels.label_next_visit(*cuts_after_visit_4(spark), people(spark)).head()
    assert row.cut_date == D(2000, 4, 1) and row.part == 0
    assert row.code == "A SEP B SEP C SEP D SEP".split()
    assert row.age == "600 600 601 601 602 602 603 603".split()
    assert row.label == ["E"]


def test_horizons(spark):
    cuts = cuts_after_visit_4(spark)
    assert labels.label_horizon(*cuts, people(spark), 6).head().label == ["A", "E", "F"]
    assert labels.label_horizon(*cuts, people(spark), 12).head() is None


def test_histories_are_whole_in_any_number_of_parts(spark):
    rows = labels.label_next_visit(*cuts_after_visit_4(spark), people(spark), 4).collect()
    assert [r.part for r in sorted(rows, key=lambda r: r.part)] == [0, 1]
    assert sum((r.code for r in sorted(rows, key=lambda r: r.part)), []) == \
        "A SEP B SEP C SEP D SEP".split()
    assert all(r.label == ["E"] for r in rows)


def test_positive_labels(spark):
    df = spark.createDataFrame([(1, [2, 0, 2, -1]), (2, [])], "patid long, label_ids array<bigint>")
    assert sorted(tuple(r) for r in labels.positive_labels(df).collect()) == [(1, 0), (1, 2)]


def test_cuts_leave_history_and_label(spark):
    visits = spark.createDataFrame(
        [(p, D(2000, 1, 1) + dt.timedelta(days=v), ["A"]) for p in range(60) for v in range(2 + p % 9)],
        "patid long, eventdate date, code array<string>")
    rows = labels.pick_cuts(visits, 4, 1).select("patid", "n_visits", "cut_no").distinct().collect()
    assert {r.n_visits for r in rows} == {5, 6, 7, 8, 9, 10}
    assert all(4 <= r.cut_no < r.n_visits for r in rows)
    assert len({r.cut_no for r in rows}) > 4
    assert len({r.patid for r in rows}) == len(rows)


def test_split_is_by_person_and_repeatable(spark):
    df = spark.range(4000).select((F.col("id") % 2000).alias("patid"))
    got = labels.split_patients(df, 0.2, 5).distinct().collect()
    assert len(got) == 2000
    assert 330 < sum(r.split == "test" for r in got) < 470


def test_distinct_labels_and_multi_hot(spark):
    df = spark.createDataFrame([(["B", "A", "B"],)], "label array<string>")
    assert labels.distinct_labels(df).head().label == ["A", "B"]
    ids = spark.createDataFrame([([1, 1, 0, -1, -1],)], "label_ids array<bigint>")
    assert labels.multi_hot(ids, 4).head().target == [1, 1, 0, 0]


def test_row_index_is_dense_and_ordered(spark):
    df = spark.range(0, 5000, numPartitions=7).select(
        (F.col("id") * 7919 % 5000).alias("k"), F.array(F.col("id")).alias("v"))
    got = indexing.with_row_index(df, [F.desc("k")]).collect()
    assert {(r.k, r.row_index) for r in got} == {(k, 4999 - k) for k in range(5000)}
    assert got[0].v == [got[0].v[0]]


def test_running_sum(spark):
    df = spark.range(0, 3000, numPartitions=5).select(
        (F.col("id") * 7919 % 3000).alias("k"), (F.col("id") % 3).alias("v"))
    values = {r.k: r.v for r in df.collect()}
    total, want = 0, {}
    for k in sorted(values, reverse=True):
        total += values[k]
        want[k] = total
    got = indexing.with_running_sum(df, [F.desc("k")], "v", "s").collect()
    assert {r.k: r.s for r in got} == want


def test_row_index_of_nothing(spark):
    assert indexing.with_row_index(spark.range(0), ["id"]).count() == 0


def test_epochs_are_different_permutations(spark):
    df = spark.range(1000).withColumnRenamed("id", "patid")
    orders = [[r.patid for r in batches.epoch_order(df, e, 1, slices=16).orderBy("row_index").collect()]
              for e in (0, 0, 1)]
    assert orders[0] == orders[1] != orders[2]
    assert sorted(orders[2]) == list(range(1000))
    indexes = batches.epoch_order(df, 0, 1).select("row_index").collect()
    assert sorted(r.row_index for r in indexes) == list(range(1000))


def test_rows_that_share_a_person_have_their_own_place(spark):
    df = spark.range(400).selectExpr("id % 5 as patid", "id as sample")
    orders = [[r["sample"] for r in batches.epoch_order(df.repartition(n), 1, 1, ("patid", "sample"))
               .orderBy("row_index").collect()] for n in (2, 7)]
    assert orders[0] == orders[1] and sorted(orders[0]) == list(range(400))


def test_batches(spark):
    df = spark.range(1000).withColumnRenamed("id", "patid")
    for epoch in (None, 3):
        sizes = {r.batch_id: r["count"] for r in
                 batches.assign_batches(df, 256, epoch).groupBy("batch_id").count().collect()}
        assert sizes == {0: 256, 1: 256, 2: 256, 3: 232}
    in_order = batches.assign_batches(df, 256).collect()
    assert all(r.batch_id == r.patid // 256 for r in in_order)


def test_packed_labels(spark):
    rows = [[], [5], [0, 63, 64, 64, 200, -1], [130, 129], [-1]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "patid int, label_ids array<long>")
    got = {r.patid: {w.word: w.bits % 2 ** 64 for w in r.words}
           for r in labels.packed_labels(df).collect()}
    for i, ids in enumerate(rows):
        want = {}
        for x in {x for x in ids if x >= 0}:
            want[x // 64] = want.get(x // 64, 0) | 1 << x % 64
        assert got[i] == want
    dense = {r.patid: r.target for r in labels.multi_hot(df, 131).collect()}
    assert all(dense[i] == [int(c in ids) for c in range(131)] for i, ids in enumerate(rows))


def test_tails_equal_the_ends_of_whole_histories(spark):
    """One pass for two horizons and for the next visit, against the stored labelled tables."""
    from visitseq import plans
    from visitseq.operators import encode
    from visitseq.operators.visits import tail_visits
    from workload import tables
    stored = plans.visit_table(tables.diagnoses(spark, "/root/testdata/sf0.001"))
    people = plans.people_table(tables.demographic(spark, "/root/testdata/sf0.001"))

    def rows(df):
        return sorted((r.patid, r.cut_date, tuple(r.code), tuple(r.age), tuple(r.label))
                      for r in df.collect())

    for max_len in (7, 40):
        cuts = labels.pick_cuts(stored, seed=3, last_visits=tail_visits(max_len))
        both = labels.tails_horizons(stored, cuts, people, [6, 12], max_len)
        for months in (6, 12):
            whole = labels.label_horizon(stored, cuts, people, months)
            ends = encode.last_tokens(whole, max_len, ("patid", "cut_date"), same=("label",))
            assert rows(both.where(f"months = {months}")) == rows(ends)
        whole = labels.label_next_visit(stored, cuts, people)
        ends = encode.last_tokens(whole, max_len, ("patid", "cut_date"), same=("label",))
        assert rows(labels.tails_next_visit(stored, cuts, people, max_len)) == rows(ends)
