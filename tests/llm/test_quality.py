import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.conftest import SMALL
from visitseq.llm import quality


def brute_marginals(good, moves, lines):
    """Forward and backward sums in plain loops, each text by itself."""
    out, pairs, first = [], np.zeros((2, 2)), 0
    for n in lines:
        e = [(1.0, np.exp(g)) for g in good[first:first + n]]
        m = np.exp(moves)
        a = [np.array(e[0])]
        for t in range(1, n):
            a.append(np.array([sum(a[-1][i] * m[i, j] for i in (0, 1)) * e[t][j] for j in (0, 1)]))
        b = [np.ones(2)]
        for t in range(n - 1, 0, -1):
            b.insert(0, np.array([sum(m[i, j] * e[t][j] * b[0][j] for j in (0, 1)) for i in (0, 1)]))
        z = (a[0] * b[0]).sum()
        out += [(x * y)[1] / z for x, y in zip(a, b)]
        for t in range(1, n):
            pairs += np.array([[a[t - 1][i] * m[i, j] * e[t][j] * b[t][j] / z for j in (0, 1)]
                               for i in (0, 1)])
        first += n
    return np.array(out), pairs


def test_marginals_equal_plain_loops():
    rng = np.random.default_rng(0)
    lines = np.array([1, 5, 1, 40, 2, 3])
    good, moves = rng.normal(0, 2, lines.sum()), rng.normal(0, 1, (2, 2))
    got, joint = quality.marginals(good, moves, lines)
    want, pairs = brute_marginals(good, moves, lines)
    assert np.allclose(got, want) and np.allclose(joint.sum(2), pairs)


def test_extreme_scores_stay_finite():
    lines = np.array([3000, 1])
    good = np.where(np.arange(3001) % 2, 900.0, -900.0)
    got, _ = quality.marginals(good, np.array([[9.0, -9], [-9, 9]]), lines)
    assert np.isfinite(got).all()


def test_lines_and_features():
    texts = ["One two two.\n\nTHREE!! FOUR!!\n", "", "é|é|é", "\n"]
    own, lines, size = quality.own_features(pa.array(texts, pa.large_string()))
    assert lines.tolist() == [4, 1, 1, 2]
    assert size.tolist() == [12, 0, 14, 0, 0, 8, 0, 0]
    at = {name: own[:, i] for i, name in enumerate(quality.FEATURES)}
    assert np.isclose(at["distinct_words"][0], 2 / 3) and np.isclose(at["same_as_last"][0], 1 / 3)
    assert np.isclose(at["capitals"][2], 1) and np.isclose(at["repeated_signs"][2], (2 / 14) ** .5)
    assert at["empty"].tolist() == [0, 1, 0, 1, 1, 0, 1, 1]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/../sf0.01/labels.parquet")
    model = quality.learn(docs, labels.filter(~quality.held_out()))
    got = (quality.score(docs, model).join(labels, "doc_id").filter(quality.held_out())
           .select("score", "quality").toPandas())
    right = ((got["score"] >= 0.3).astype(int) == got["quality"]).mean()
    assert len(got) > 40 and right >= 0.95


def test_odd_rows_and_clashing_columns(spark):
    good = "This is a sentence about something. Another follows it."
    bad = "NOISE!! NOISE!! NOISE!! ### ### 00000 $$$ $$$"
    rows = [(i, good + f" Number {i}.\n{good}", "x") for i in range(30)]
    rows += [(100 + i, f"{bad}\n{bad} {i}", "y") for i in range(30)]
    labels = spark.createDataFrame([(r[0], int(r[0] < 100), 1.0) for r in rows]
                                   + [(None, 1, 0.0), (5, None, 0.0), (777, 1, 0.0)],
                                   "doc_id long, quality int, score double")
    rows += [(1, good, "again"), (1, good, "again"), (None, bad, "no id"), (900, None, ""),
             (901, "", ""), (902, (good + "\n") * 20000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, good string") \
                .withColumn("_quality", F.lit(3))
    model = quality.learn(docs, labels)
    out = quality.score(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    by_id = {r["doc_id"]: r["score"] for r in out}
    assert by_id[3] > 0.5 > by_id[103] and by_id[902] > 0.5 > by_id[None]
    assert [len(r["good"]) for r in out if r["doc_id"] in (900, 901)] == [1, 1]


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    for labels, share in ((none, 0.5), (one, 1.0)):
        assert [r["score"] for r in quality.score(docs, quality.learn(docs, labels)).collect()] \
            == [share, share]
    assert quality.score(docs.limit(0), quality.learn(docs.limit(0), none)).collect() == []


def test_a_huge_document_does_not_end_the_sample(spark):
    """One labelled document beyond the bound of lines, and labels of documents that are not there."""
    good = "This is a sentence about something.\nAnd this is another one, too."
    bad = "$$$ ### !!!\n|| -- ||\n%%% &&& @@@"
    rows = [(i, good if i % 2 else bad) for i in range(60)] + [(1000, "x\n" * 200_001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(5000 + i, 1) for i in range(300)],
                                   "doc_id long, quality int")
    model = quality.learn(docs, labels, sample_docs=61)
    assert model.share is None and model.slope > 0
    score = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert min(score[i] for i in range(1, 60, 2)) > max(score[i] for i in range(0, 60, 2))


def test_scores_equal_plain_loops(spark):
    """The rows of the query from features, plain forward and backward sums and the curve."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.learn(docs, labels.filter(~quality.held_out()))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for row in docs.limit(60).collect():
        own, lines, size = quality.own_features(pa.array([row.text], pa.large_string()))
        n = len(own)
        table = [np.concatenate([own[i], own[i - 1] if i else 0 * own[i],
                                 own[i + 1] if i + 1 < n else 0 * own[i], [1]]) for i in range(n)]
        chance, _ = brute_marginals([x @ model.weights for x in table], model.moves, lines)
        mean = sum(p * (s + 1) for p, s in zip(chance, size)) / sum(s + 1 for s in size)
        assert np.isclose(got[row.doc_id], 1 / (1 + np.exp(-(model.slope * mean + model.shift))))
