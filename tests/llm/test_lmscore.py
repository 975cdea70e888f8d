import random
from math import exp, log

import numpy as np
import pyarrow as pa
import pytest

from visitseq.llm import lmscore
from visitseq.llm.textbytes import words

SCHEMA = "doc_id long, text string, mean string, n_tokens int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def corpus(n=400, seed=0):
    """Words of one kind come in a fixed order, so neighbours tell a word's kind."""
    rng = random.Random(seed)
    kinds = [[f"{k}{i}" for i in range(6)] for k in "abcd"]
    return [(i, " ".join(rng.choice(kinds[j % 4]) for j in range(40))) for i in range(n)]


def test_gradient():
    rng = np.random.default_rng(0)
    net = lmscore.Network(9, rng.normal(0, 0.5, len(lmscore.Network(9).flat)))
    around, target = rng.integers(0, 10, (50, 4)), rng.integers(0, lmscore.CLASSES, 50)

    def likelihood(flat):
        logs = lmscore.Network(9, flat).forward(around)[2].astype(float)
        return logs[np.arange(50), target].mean()

    rows, embed, *others = net.gradient(around, target)
    whole = np.zeros_like(net.embed)
    whole[rows] = embed
    slope = np.concatenate([x.ravel() for x in (whole, *others)])
    for i in rng.choice(len(slope), 60):
        step = np.zeros(len(slope), np.float32)
        step[i] = 1e-2
        rise = (likelihood(net.flat + step) - likelihood(net.flat - step)) / 2e-2
        assert abs(rise - slope[i]) < 2e-3


def brute(text, known, flat):
    """Sum of log-probabilities word by word."""
    net = lmscore.Network(known.size, flat)
    own = dict(zip(known.hashes.tolist(), known.ids.tolist()))
    ids = [own.get(h, known.size - 1)
           for h in words(pa.array([text or ""], pa.large_string())).hash.tolist()]
    total = 0.0
    for i, word in enumerate(ids):
        hidden = net.lift.astype(float).copy()
        for place, step in zip(net.places.astype(float), (-2, -1, 1, 2)):
            near = ids[i + step] if 0 <= i + step < len(ids) else known.size
            hidden += place * net.embed[near]
        z = np.tanh(hidden) @ net.out + net.bias
        total += z[known.classes[word]] - log(sum(map(exp, z))) + known.shares[word]
    return len(ids), total


def test_scores_equal_plain_loops(spark):
    rows = corpus(60) + [(900, None), (901, "..."), (902, "unseen"), (None, "a0 b1"), (3, "a1"),
                         (3, "a1"), (903, "a0 b1 c2 d3 " * 5000)]
    df = frame(spark, rows)
    known, flat = lmscore.learn(df, 20)
    got = [tuple(r) for r in lmscore.score(df, known, flat).collect()]
    want = [(d, *brute(t, known, flat)) for d, t in rows]
    assert sorted((repr(d), n) for d, n, *_ in got) == sorted((repr(d), n) for d, n, _ in want)
    assert np.allclose(sorted(x[2] for x in got), sorted(x[2] for x in want), rtol=1e-4, atol=1e-3)
    assert all((m is None) == (n == 0) and (n == 0 or abs(m - p / n) < 1e-9) for _, n, p, m in got)


def test_probabilities_sum_to_one(spark):
    known, flat = lmscore.learn(frame(spark, corpus(30)), 10)  # 24 types, 14 of them rare
    net = lmscore.Network(known.size, flat)
    around = np.array([[0, 1, 2, 3], [known.size, known.size, 5, 0]])
    for logs in net.forward(around)[2]:
        total = sum(exp(logs[known.classes[i]] + known.shares[i]) for i in range(known.size - 1))
        total += 14 * exp(logs[known.classes[-1]] + known.shares[-1])
        empty = [c for c in range(lmscore.CLASSES) if c not in known.classes]
        assert total + sum(exp(logs[c]) for c in empty) == pytest.approx(1, abs=1e-5)


def test_order_matters_after_training(spark):
    rows = corpus(800)
    known, flat = lmscore.learn(frame(spark, rows).repartition(3), batch=64)
    rng = random.Random(9)
    fresh = corpus(100, seed=5)
    mixed = [(i + 1000, " ".join(rng.sample(t.split(), 40))) for i, t in fresh]
    out = {r["doc_id"]: r["mean"]
           for r in lmscore.score(frame(spark, fresh + mixed), known, flat).collect()}
    kept = np.mean([out[i] for i, _ in fresh])
    assert kept > np.mean([out[i] for i, _ in mixed]) + 0.5
    assert kept > -log(24) + 0.5  # better than word counts alone


def test_empty_table(spark):
    df = frame(spark, [])
    known, flat = lmscore.learn(df)
    assert lmscore.score(df, known, flat).collect() == []


def test_every_count_is_in_the_scores(spark):
    """6000 words seen once to three times beside 24 frequent ones."""
    tail = {f"w{i}": i % 3 + 1 for i in range(6000)}
    rows = corpus(300) + [(1000 + n, " ".join(w for w, m in tail.items() if m >= n))
                          for n in (1, 2, 3)]
    df = frame(spark, rows)
    known, flat = lmscore.learn(df)
    types = sorted({w for _, t in rows for w in t.split()})
    own = dict(zip(types, words(pa.array([" ".join(types)], pa.large_string())).hash.tolist()))
    single = frame(spark, enumerate([*types, "new", "w1 w2 w2 w2"]))
    got = [r["log_prob"] for r in lmscore.score(single, known, flat).orderBy("doc_id").collect()]
    edges = np.full((1, 4), known.size)
    logs = lmscore.Network(known.size, flat).forward(edges)[2][0]
    empty = sum(exp(logs[c]) for c in range(lmscore.CLASSES) if c not in known.classes)
    assert sum(map(exp, got[:len(types)])) + empty == pytest.approx(1, abs=1e-4)

    def place(word):
        return len(known.hashes) + (own[word] >> 1) % known.places

    for word, score in zip(types, got):
        if word in tail:
            want = logs[known.classes[place(word)]] + known.shares[place(word)] + log(tail[word])
            assert score == pytest.approx(want, abs=1e-4)
    own["new"] = int(words(pa.array(["new"], pa.large_string())).hash[0])  # as if seen once
    assert got[-2] == pytest.approx(logs[known.classes[place("new")]] + known.shares[place("new")],
                                    abs=1e-4)
    ids = np.array([place(w) for w in ("w1", "w2", "w2", "w2")])
    around = np.array([[ids[i + s] if 0 <= i + s < 4 else known.size for s in (-2, -1, 1, 2)]
                       for i in range(4)])
    want = lmscore.log_probs(lmscore.Network(known.size, flat), known, ids, around).sum()
    assert got[-1] == pytest.approx(want + log(2) + 3 * log(3), abs=1e-3)


def test_vocabulary_grows_with_the_corpus(spark):
    sizes = []
    for times in (1, 16):
        text = " ".join(f"w{i} " * (20000 * times // (i + 1)) for i in range(8000))
        sizes.append(len(lmscore.vocabulary(frame(spark, [(1, text)])).hashes))
    assert 3 < sizes[1] / sizes[0] < 5


def test_copies_travel_as_rows_of_one_weight():
    known = lmscore.Vocabulary(np.array([], np.uint64), np.array([], np.int64), np.array([63]),
                               np.array([0.0]))
    start = lmscore.Network(known.size).flat
    texts = pa.RecordBatch.from_arrays([pa.array(["a b c d", None, "e f"])], ["text"])
    moved = pa.Table.from_batches(lmscore.train(iter([texts]), known, start, 4))
    assert moved.num_rows == len(start) // lmscore.WIDTH  # not one a parameter
    assert set(moved["weight"].to_pylist()) == {12.0, 6.0}  # a word and the edge, all others
    value = np.concatenate([np.array(v, np.float32) for v in moved["value"].to_pylist()])
    assert value.shape == start.shape and (value != start).any()
