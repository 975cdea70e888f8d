"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tests.conftest import SMALL, plan_of
from visitseq import plans, sources
from visitseq.operators import labels, lookup, metrics, score, visits
from workload import tables
from workload.queries import QUERIES

PYTHON = {"score_batches"}


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def exchanges(plan):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)


@pytest.mark.parametrize("name", QUERIES)
def test_no_python_and_no_pairs(spark, name):
    plan = plan_of(contract.queries()[name](spark, SMALL))
    assert ("Python" in plan or "InPandas" in plan) == (name in PYTHON)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_sequences_shuffle_sets_and_bounded_groups(spark, no_broadcast):
    stored = sources.materialize(visits.build_visits(tables.diagnoses(spark, SMALL)))
    diagnoses = stored.selectExpr("patid", "eventdate", "explode(code) as code")
    plan = plan_of(plans.format_sequences(diagnoses, tables.demographic(spark, SMALL)))
    keys = {re.sub(r"#\d+L?|_groupingexpression", "", k) for k in exchanges(plan)}
    # Distinct events, days, months, parts; by person alone only month sizes and people.
    assert keys == {"patid, eventdate, code, 8", "patid, eventdate, 8", "patid, , 8",
                    "patid, _month, 8", "patid, part, 8", "patid, 8"}


def window_inputs(node):
    """Names of the columns that each window of a logical plan gets."""
    children = [node.children().apply(i) for i in range(node.children().size())]
    if node.nodeName() == "Window":
        output = children[0].output()
        yield {output.apply(i).name() for i in range(output.size())}
    for child in children:
        yield from window_inputs(child)


def test_windows_carry_no_codes(spark):
    stored = plans.visit_table(tables.diagnoses(spark, SMALL))
    people = plans.people_table(tables.demographic(spark, SMALL))
    cuts = labels.pick_cuts(stored)
    for df in (visits.build_sequences(stored, people), cuts, visits.history_index(stored),
               labels.label_next_visit(stored, cuts, people),
               labels.label_horizon(stored, cuts, people, 6)):
        found = list(window_inputs(df._jdf.queryExecution().optimizedPlan()))
        assert found and not any("code" in columns for columns in found)
    counted = visits.min_visits(stored, 5)._jdf.queryExecution().optimizedPlan()
    assert list(window_inputs(counted)) == []


def test_tails_limit_before_the_shuffle(spark):
    stored = plans.visit_table(tables.diagnoses(spark, SMALL))
    people = plans.people_table(tables.demographic(spark, SMALL))
    plain = sources.materialize(stored)
    plan = plan_of(visits.sequence_tails(plain, people, 16))
    assert plan.count("WindowGroupLimit") == 2
    assert plan.rindex("WindowGroupLimit") > plan.index("Exchange")


def test_visits_are_dealt_once(spark, no_broadcast):
    """From the stored visits to tails and labels nothing is exchanged but the people."""
    stored = plans.visit_table(tables.diagnoses(spark, SMALL))
    people = tables.demographic(spark, SMALL)
    for months in (None, 6):
        plan = plan_of(plans.prediction_rows(stored, people, months))
        assert len(exchanges(plan)) == 1 and "Bucketed: true" in plan
        aggregate = plan.index("ObjectHashAggregate")
        assert "code" not in plan[plan.index("Exchange hashpartitioning"):plan.index(
            "Exchange hashpartitioning") + 60] and aggregate
    cuts = labels.pick_cuts(stored)
    assert exchanges(plan_of(cuts)) == []
    tails = visits.sequence_tails(stored, plans.people_table(people), 16)
    assert len(exchanges(plan_of(tails))) <= 1


def test_several_horizons_scan_visits_once(spark):
    stored = plans.visit_table(tables.diagnoses(spark, SMALL))
    people = plans.people_table(tables.demographic(spark, SMALL))
    cuts = sources.materialize(labels.pick_cuts(stored, last_visits=50))
    plan = plan_of(labels.tails_horizons(stored, cuts, people, [6, 12], 100))
    assert len(re.findall(r"FileScan parquet .*code#", plan)) == 1


def test_a_large_vocabulary_is_moved_once(spark):
    tokens = spark.range(5000).selectExpr(
        "id", "if(id % 3 = 0, 'hot', concat('t', id % 700)) as token")
    words = spark.range(700).selectExpr("concat('t', id) as token", "cast(id as int) as token_id"
                                        ).unionByName(spark.createDataFrame(
                                            [("hot", 900), ("UNK", 901)], "token string, token_id int"))
    rows = lookup.encode_tokens(tokens, words, broadcast_bytes=0, row_key=["id"])
    want = tokens.join(words, "token").select("id", "token_id").collect()
    assert sorted((r.id, r.token_id) for r in rows.collect()) == sorted(map(tuple, want))
    plan = plan_of(rows)
    assert "explode" not in plan.lower() and "Union" in plan
    heavy = lookup.heavy_values(tokens, ["token"], ["id"]).collect()
    assert max(heavy, key=lambda r: r["_n"])["token"] == "hot"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    largest = rows.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(
        F.max("count")).head()[0]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert largest < 5000 / 3  # the hot token stays where its rows were read


def test_metrics_shuffle_once(spark):
    rows = score.scored_rows(tables.scored_arrays(spark, SMALL), "sample_id")
    assert len(exchanges(plan_of(metrics.sample_metrics(rows)))) == 1
    masked = metrics.masked_cross_entropy(tables.scored_masked(spark, SMALL))
    assert exchanges(plan_of(masked)) == []


def test_scan_reads_only_the_used_columns(spark):
    plan = plan_of(plans.clean_events(tables.diagnoses(spark, SMALL)))
    assert "l_quantity" not in plan and "o_comment" not in plan
    assert "IsNotNull(l_orderkey)" in plan
