import numpy as np
import pytest

from tests.conftest import SMALL
from visitseq.llm import neighbours, queries
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, node int, score string"


def brute(rows, asks, k=5):
    """query_id -> the k nearest by cosine in double precision, ties to smaller ids."""
    ok = sorted({(i, tuple(v)) for i, v in rows if i is not None and v
                 and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    lengths = [len(v) for _, v in ok]
    size = max(sorted(set(lengths)), key=lengths.count, default=0)
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in ok if len(v) == size]
    out = {}
    for i, v in ok:
        if asks(i):
            best = out.setdefault(i, {})
            for j, w in ok:
                if j != i:
                    s = (w * v).sum() / (np.sqrt((w * w).sum()) * np.sqrt((v * v).sum()))
                    best[j] = max(best.get(j, -2), s)
    return {i: sorted((-s, j) for j, s in best.items())[:k] for i, best in out.items()}


def run(spark, rows, mod=10, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = {}
    found = neighbours.nearest(df, "vec_id", "embedding", F.col("vec_id") % mod == 0, **options)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    for r in sorted(found.collect()):
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def vectors(n, d=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, d))
    return [(i, (centres[i % 20] + rng.normal(size=d) * 0.5).astype(np.float32).tolist())
            for i in range(n)]


def recall(got, want):
    hits = [len({j for _, j in got[i]} & {j for _, j in want[i]}) / max(1, len(want[i]))
            for i in want]
    return np.mean(hits)


def test_recall_over_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SAMPLE", 300)
    rows = vectors(3000)
    got, want = run(spark, rows, block=100), brute(rows, lambda i: i % 10 == 0)
    assert set(got) == set(want) and all(len(got[i]) == 5 for i in got)
    assert recall(got, want) >= 0.95
    scores = {(i, j): s for i, near in want.items() for s, j in near}
    assert all(abs(s - scores[i, j]) < 1e-12 for i, near in got.items() for s, j in near
               if (i, j) in scores)


def test_exact_when_the_test_never_stops_early(spark):
    rows = vectors(300)
    rows += [(i, rows[3][1]) for i in range(1000, 1100)]  # one vector many times: ties
    rows += [(7, rows[7][1]), (10, rows[11][1])]  # a repeated row, an id with two vectors
    rows += [(2000, None), (2010, []), (2020, [0.0] * 16), (2030, [float("nan")] * 16),
             (2040, [None] * 16), (2050, [float("inf")] * 16), (2060, [1.0]), (None, [1.0] * 16),
             (2070, [1e30] * 16), (2080, [1e-30] * 16)]
    got, want = run(spark, rows, stop=1 - 1e-13), brute(rows, lambda i: i % 10 == 0)
    assert {i: [j for _, j in near] for i, near in got.items()} \
        == {i: [j for _, j in near] for i, near in want.items()}
    assert np.allclose([s for i in sorted(got) for s, _ in got[i]],
                       [s for i in sorted(want) for s, _ in want[i]], atol=1e-12)


@pytest.mark.parametrize("n", [0, 1, 2, 4])
def test_few_rows(spark, n):
    got = run(spark, vectors(n))
    assert {i: len(near) for i, near in got.items()} == ({0: n - 1} if n > 1 else {})


def test_chi_square():
    draws = np.random.default_rng(0).standard_normal((200_000, neighbours.DIMS))
    x = neighbours.stop_factor(0.95)
    assert abs(neighbours.chi_square(x) - 0.95) < 1e-9
    assert abs(((draws ** 2).sum(1) <= x).mean() - 0.95) < 0.003


def test_query_recall(spark):
    rows = [(r["vec_id"], r["embedding"])
            for r in queries.table(spark, f"{SMALL}/../sf0.01", "embeddings").collect()]
    want = brute(rows, lambda i: i % 50 == 0)
    got = {}
    for r in queries.op1_nearest(spark, f"{SMALL}/../sf0.01").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert set(got) == set(want) and recall(got, want) >= 0.9


def test_scaled_copies_go_by_id(spark):
    """More vectors at one cosine than a query returns, spread over partitions."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=16)
    rows = [(i, (base * (1 + 0.37 * (i % 5) + i)).tolist()) for i in range(9, 31)]
    rows += [(100 + i, rng.normal(size=16).tolist()) for i in range(50)]
    rows.append((0, (base * 3).tolist()))
    order = rng.permutation(len(rows))
    df = spark.createDataFrame([rows[i] for i in order], "vec_id long, v array<double>").repartition(7)
    got = neighbours.nearest(df, "vec_id", "v", F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [9, 10, 11, 12, 13]
    assert all(abs(r.score - 1) < 1e-12 for r in got)
