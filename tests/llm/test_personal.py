"""Personal data: base patterns against plain regular expressions, messages against all
labellings, learnt labels on held-out mentions."""

import itertools
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from visitseq.llm import personal

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            checked = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            good = {"email": True, "ip": kind == "ip" and max(map(int, m.group().split("."))) < 256,
                    "card": 12 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in checked) % 10 == 0,
                    "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


@settings(max_examples=1500, deadline=None)
@given(st.text("ab1234567890@@..+- ()é", max_size=60))
def test_base_patterns(text):
    assert personal.base_spans(text) == plain_base(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", "1.2.3.4", "256.1.1.1", ".", "4539148803436467", " ", "-",
                                 "+1 (555) 010-9999", "+", "7", "x", "@", "a@b", "é"]), max_size=25))
def test_base_mixtures(parts):
    text = "".join(parts)
    assert personal.base_spans(text) == plain_base(text)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = personal.find_personal(docs, ["doc_id", "text"]).collect()
    assert len(found) == docs.count()
    for row in found:
        base = [(s.start, s.rank, s.end) for s in row.spans if s.base]
        assert base == plain_base(row.text or "")
        spans = [(s.start, s.rank) for s in row.spans]
        assert spans == sorted(spans)
        if not any(c.isdigit() for c in row.text or "") and "@" not in (row.text or ""):
            assert not row.spans


@pytest.mark.parametrize("text", ["1" * 10**6, "a" * 10**6, "a@" * 300_000, "1." * 300_000, "1 " * 300_000,
                                  "+1" * 300_000, "+1" + " " * 10**6, "a(at)" * 200_000,
                                  "((((" * 200_000, "a-" * 500_000 + "@", "555-0199 " * 60_000])
def test_long_texts(text):
    start = time.time()
    personal.nodes_of(text)
    assert time.time() - start < 40


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 5), st.integers(0, 2**32 - 1))
def test_messages_on_trees(n, seed):
    """Without circles the messages give the exact marginals."""
    draw = np.random.default_rng(seed)
    labels = 3
    unary = draw.normal(size=(n, labels))
    one = np.array([draw.integers(0, i) for i in range(1, n)])
    two = np.arange(1, n)
    potential = draw.normal(size=(n - 1, labels, labels))
    total = np.zeros((n, labels))
    for y in itertools.product(range(labels), repeat=n):
        weight = np.exp(sum(unary[i, y[i]] for i in range(n)) + sum(
            potential[e, y[one[e]], y[two[e]]] for e in range(n - 1)))
        for i in range(n):
            total[i, y[i]] += weight
    got = personal.marginals(unary, one, two, potential, 80)
    assert np.allclose(got, total / total.sum(1, keepdims=True), atol=1e-6)


def test_messages_around_a_circle():
    """Strong equal links carry an observed label around a circle."""
    unary = np.zeros((4, 2))
    unary[0] = [-50, 0]
    got = personal.marginals(unary, np.array([0, 1, 2, 3]), np.array([1, 2, 3, 0]),
                             np.broadcast_to(np.diag([3.0, 3.0]), (4, 2, 2)))
    assert (got[:, 1] > 0.9).all()


def mention(i):
    return f"+1 ({200 + i % 700}) 555-{1000 + i % 9000:04d}"


def test_other_spellings_are_found(spark):
    """Mentions that no base pattern matches, in documents that training did not read."""
    rows = [(i, f"call {mention(i)} or write user{i}@mail{i % 9}.example.com about order {7000000 + 13 * i}. "
                + "words between " * 30 + f"again {mention(i)}") for i in range(400)]
    rows += [(1000 + i, f"call {mention(5000 + i)} now. " + "words between " * 40
              + f"or {mention(5000 + i)[1:]} and jo{i} (at) host{i}.example.org; part {8000000 + 17 * i}")
             for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = personal.learn(personal.scan(df.where("doc_id < 1000")))
    out = {r.doc_id: r.spans for r in personal.label(personal.scan(df), model).collect()}
    texts = dict(rows)
    phones = emails = wrong = 0
    for doc, spans in out.items():
        for s in spans:
            token = texts[doc][s.start:s.end]
            if not s.base:
                phones += s.rank == 3 and token.startswith("1 (")
                emails += s.rank == 0 and "(at)" in token
                wrong += "555" not in token and "(at)" not in token
    assert phones >= 95 and emails >= 95 and wrong == 0


def test_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([(None, None), (1, ""), (1, "a@b.cd"), (1, "a@b.cd")],
                               "doc_id long, text string").withColumn("spans", F.lit(5))
    out = personal.find_personal(df, ["doc_id"]).collect()
    assert sorted(len(r.spans) for r in out) == [0, 0, 1, 1]
    assert personal.find_personal(df.limit(0)).count() == 0
    none = personal.find_personal(df.where("text is null")).collect()
    assert [r.spans for r in none] == [[]]
    g = personal.graph(personal.scan(df).toArrow().column("_nodes").combine_chunks())
    assert len(g.start) == 2 and len(g.one) == 0
