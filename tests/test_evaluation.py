import math
import random

import pytest

from visitseq.operators import metrics, monitor, score

CASES = [([0.9, 0.8, 0.7, 0.6], [1, 0, 1, 0], 0.833333, 0.75),
         ([0.9, 0.9, 0.5], [1, 0, 1], 0.583333, 0.25),
         ([0.9, 0.5], [0, 0], 0.0, None),
         ([0.9, 0.5], [1, 1], 1.0, None)]


def scored(spark, samples):
    return spark.createDataFrame(
        [(i, k, float(x), y) for i, (xs, ys) in enumerate(samples)
         for k, (x, y) in enumerate(zip(xs, ys))],
        "sample_id long, label_id long, logit double, target int")


def test_ranking_metrics(spark):
    rows = {r.sample_id: r for r in
            metrics.sample_metrics(scored(spark, [c[:2] for c in CASES])).collect()}
    for i, (_, _, ap, auc) in enumerate(CASES):
        assert rows[i].ap == pytest.approx(ap, abs=1e-6)
        assert rows[i].auc == (None if auc is None else pytest.approx(auc))


def brute(xs, ys):
    pos = [x for x, y in zip(xs, ys) if y]
    neg = [x for x, y in zip(xs, ys) if not y]
    ap = 0.0
    for t in sorted(set(xs)):
        ahead = sum(y for x, y in zip(xs, ys) if x >= t)
        own = sum(y for x, y in zip(xs, ys) if x == t)
        ap += own / max(len(pos), 1) * ahead / sum(x >= t for x in xs)
    if not pos or not neg:
        return ap, None
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return ap, wins / len(pos) / len(neg)


def test_ranking_metrics_against_brute_force(spark):
    rng = random.Random(4)
    samples = [([rng.randrange(6) / 2 for _ in range(12)], [rng.randrange(2) for _ in range(12)])
               for _ in range(200)]
    for r in metrics.sample_metrics(scored(spark, samples)).collect():
        ap, auc = brute(*samples[r.sample_id])
        assert r.ap == pytest.approx(ap)
        assert r.auc == (None if auc is None else pytest.approx(auc))


def test_means_count_their_samples(spark):
    df = scored(spark, [c[:2] for c in CASES])
    ap = metrics.average_precision(df).head()
    auc = metrics.roc_auc(df).head()
    assert ap.ap == pytest.approx((0.833333 + 0.583333 + 0 + 1) / 4, abs=1e-6) and ap.samples == 4
    assert auc.auc == pytest.approx(0.5) and (auc.rated, auc.samples) == (2, 4)


def test_losses(spark):
    df = scored(spark, [([0, 0], [1, 0])])
    assert metrics.multilabel_soft_margin(df).head().loss == pytest.approx(math.log(2))
    big = scored(spark, [([800, -800], [0, 1])])
    assert metrics.multilabel_soft_margin(big).head().loss == pytest.approx(800)
    masked = spark.createDataFrame([([0.0, 0.0], 1), ([5.0, 1.0], -1)],
                                   "logits array<double>, label int")
    assert metrics.masked_cross_entropy(masked).head().loss == pytest.approx(math.log(2))
    far = spark.createDataFrame([([1000.0, 0.0], 1)], "logits array<double>, label int")
    assert metrics.masked_cross_entropy(far).head().loss == pytest.approx(1000)


def test_masked_precision(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], 1), ([1.0, 3.0, 3.0], 2), ([9.0, 1.0, 1.0], -1)],
                               "logits array<double>, label int")
    assert tuple(metrics.masked_precision(df).head()) == (0.5, 2)


def test_report_sums_the_batch_means(spark):
    df = scored(spark, [c[:2] for c in CASES[:1] * 3]).selectExpr("*", "sample_id div 2 as batch_id")
    one = metrics.multilabel_soft_margin(df).head().loss
    r = metrics.evaluate(df).head()
    assert r.loss == pytest.approx(2 * one) and (r.samples, r.batches) == (3, 2)
    assert r.ap == pytest.approx(0.833333, abs=1e-6) and r.auc == pytest.approx(0.75)


def test_best_epochs(spark):
    df = spark.createDataFrame([(1, e, ap) for e, ap in enumerate([0.40, 0.55, 0.55, 0.60])],
                               "run_id long, epoch int, ap double")
    assert sorted(r.epoch for r in monitor.best_epochs(df, 0.512).collect()) == [1, 3]
    assert sorted(r.epoch for r in monitor.best_epochs(df).collect()) == [0, 1, 3]


def test_loss_progress(spark):
    gaps = spark.createDataFrame([(0, s, s + 1.0, 2) for s in (0, 1, 3, 5)],
                                 "epoch int, step long, loss double, examples int")
    assert {r.report_step: r.mean_loss for r in monitor.loss_progress(gaps, 2).collect()} == {
        0: 1.0, 2: 2.0, 4: 4.0}
    df = spark.createDataFrame([(0, s, s + 1.0, 2) for s in range(6)],
                               "epoch int, step long, loss double, examples int")
    reports = {r.report_step: r.mean_loss for r in
               monitor.loss_progress(df.where("step < 5"), 2).collect()}
    assert reports == {0: 1.0, 2: 2.5, 4: 4.5}
    assert len(monitor.loss_progress(df, 2).collect()) == 3
    total = monitor.epoch_losses(df.where("step < 5")).head()
    assert (total.loss, total.examples, total.steps, total.loss_per_example) == (15.0, 10, 5, 1.5)


def test_scores_learn_what_recurs(spark, vocab):
    from visitseq import plans
    from visitseq.operators import encode, vocab as V
    names = V.label_vocab(vocab)
    rows = spark.createDataFrame(
        [(p, ["A", "SEP"] if p % 2 else ["B", "SEP"], ["1", "1"], ["A"] if p % 2 else ["B"])
         for p in range(20)],
        "patid long, code array<string>, age array<string>, label array<string>")
    encoded = encode.encode_next_visit(rows, vocab, names, 6)
    model = score.history_model(encoded, vocab, names)
    scores = score.next_code_scores(encoded, model).collect()
    assert len(scores) == 20  # no code speaks for a label that never followed it
    got = {(r.patid, r.label_id): r for r in scores}
    assert got[(1, 1)].logit == pytest.approx(2 * math.log(10.5 / 0.5), abs=1e-5)
    assert (got[(1, 1)].if_new, got[(1, 1)].least) == (0, 0)
    report = plans.counting_report(encoded, encoded, vocab, names).head()
    assert (report.ap, report.auc, report.rated, report.samples) == (1.0, 1.0, 20, 20)


@pytest.mark.parametrize("support, most, broadcast", [(None, None, None), (3, 200, 0), (4, 2, None)])
def test_scores_from_any_code(spark, support, most, broadcast):
    """Against plain loops over all pairs of history codes and labels."""
    from collections import Counter
    rng = random.Random(5)
    words = ["PAD", "UNK", "SEP", "CLS", "MASK", *"ABCDEFGH"]
    vocab = spark.createDataFrame(list(zip(words, range(13))), "token string, token_id int")
    names = spark.createDataFrame([("UNK", 0), *zip("ABCDEFGH", range(1, 9))],
                                  "token string, label_id int")
    train, test = ([(p, [3, *rng.choices(range(5, 11 + p % 3), k=6), 2], sorted(
        rng.sample(range(1, 9), rng.randrange(4)))) for p in range(n)] for n in (60, 25))
    train[0] = (0, [3, 5, 5, 2], [1, 1, 2, -1])
    schema = "patid long, code array<long>, label_ids array<long>"
    frames = [spark.createDataFrame(rows, schema) for rows in (train, test)]
    model = score.history_model(frames[0], vocab, names, support, most, broadcast)
    got = score.next_code_scores(frames[1], model, broadcast_bytes=broadcast).collect()

    known = {i for i in range(5, 13)}
    pairs, codes, labels = Counter(), Counter(), Counter()
    for _, code, label in train:
        held, wanted = set(code) & known, {i for i in label if i >= 0}
        codes.update(held)
        labels.update(wanted)
        pairs.update((c, i) for c in held for i in wanted)
    weight = {}
    for c in codes:
        best = sorted((-n, i) for (d, i), n in pairs.items() if d == c and n >= (support or 1))
        for minus, i in best[:most]:
            n, rest = -minus, labels[i] + minus
            weight[c, i] = round(1e6 * (math.log((n + .5) / (codes[c] - n + .5)) - math.log(
                (rest + .5) / (60 - codes[c] - rest + .5))))
    base = {i: round(1e6 * math.log((labels[i] + .5) / (60 - labels[i] + .5))) for i in range(9)}
    want = set()
    for p, code, label in test:
        for i in range(9):
            spoken = [weight[c, i] for c in set(code) if (c, i) in weight]
            if spoken or i in label:
                x = base[i] + sum(spoken)
                want.add((p, i, x / 1e6, int(i in label), base[i] / 1e6,
                          sum(b >= x for b in base.values()), sum(b > x for b in base.values())))
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert model.n_pairs == len(weight)


def test_sparse_metrics_equal_those_of_all_labels(spark):
    rng = random.Random(8)
    n = 12
    default = [rng.randrange(5) / 2 for _ in range(n)]
    own = {}  # the rows that differ, ties included
    for p in range(150):
        for k in rng.sample(range(n), rng.randrange(1, 7)):
            own[p, k] = (rng.choice([default[k], rng.randrange(5) / 2]), rng.randrange(2))
    sparse = spark.createDataFrame(
        [(p, k, x, y, default[k], sum(d >= x for d in default), sum(d > x for d in default))
         for (p, k), (x, y) in own.items()],
        "patid long, label_id long, logit double, target int, if_new double, least long, above long")
    dense = spark.createDataFrame(
        [(p, k, *own.get((p, k), (default[k], 0))) for p in range(150) for k in range(n)],
        "sample_id long, label_id long, logit double, target int")
    loss = sum(math.log1p(math.exp(d)) for d in default)
    want = {r.sample_id: r for r in metrics.sample_metrics(dense).collect()}
    got = metrics.sparse_sample_metrics(sparse, n, loss).collect()
    assert len(got) == len({p for p, _ in own})
    for r in got:
        w = want[r.patid]
        assert (r.ap, r.loss_sum) == (pytest.approx(w.ap), pytest.approx(w.loss_sum))
        assert r.auc == (None if w.auc is None else pytest.approx(w.auc))


def test_score_batches_sees_whole_rows(spark):
    df = spark.range(1000).selectExpr("id as patid", "id % 2 = 0 as even", "array(id, id + 1) code",
                                      "array(1L, 1L) mask")

    def load():
        def model(code, mask):
            assert len(code) <= 64
            return code * 2.0 + mask
        return model

    scored = score.score_batches(df, load, key=("patid", "even"), batch_size=64)
    assert {(r.patid, r.even, tuple(r.logits)) for r in scored.collect()} == {
        (i, i % 2 == 0, (2.0 * i + 1, 2.0 * i + 3)) for i in range(1000)}
    assert score.score_batches(df.where("patid < 0"), load).count() == 0
    mixed = df.withColumn("code", F.when(F.col("patid") == 5, F.array(F.lit(1))).otherwise(F.col("code")))
    with pytest.raises(Exception, match="several lengths"):
        score.score_batches(mixed, load).collect()


def test_a_worker_loads_a_model_once(spark, tmp_path):
    df = spark.range(2000).repartition(40).selectExpr("id as patid", "array(id) code")

    def load():
        import os
        with open(tmp_path / str(os.getpid()), "a") as log:
            log.write("x")
        return lambda code: code

    assert score.score_batches(df, load, ("code",), batch_size=10).count() == 2000
    assert {f.read_text() for f in tmp_path.iterdir()} == {"x"}
