import random

import corpus_pipeline
from tests.llm.test_packing import check
from tests.llm.test_secrets import brute as brute_secrets
from tests.llm.test_similarity import brute as brute_links, words

SCHEMA = "doc_id long, text string, n_chars long, row string, spans int, score double"


def table(spark, rows):
    return spark.createDataFrame(
        [(d, t, None if t is None else len(t), "x", 1, 0.5) for d, t in rows], SCHEMA)


def fixture():
    rng = random.Random(2)
    common = [f"word{i}" for i in range(200)]
    text = lambda n: " ".join(rng.choice(common) for _ in range(n))
    item = text(25)
    good = [(i, text(60) + ".\n" + text(40) + ".") for i in range(80)]
    good[5] = (5, good[4][1].replace("word1 ", "other ", 1))
    good[6] = (6, good[4][1])
    good[7] = (7, text(30) + " " + " ".join(item.split()[3:16]) + " " + text(9))
    good[8] = (8, text(30) + " password=abcdefghijklmnop " + text(20) + " " + "0a1b2c3d" * 4)
    junk = [(100 + i, "\n".join("JUNK!! ### " * 9 for _ in range(3)) + f" {i}") for i in range(40)]
    odd = [(8, good[8][1]), (None, text(50)), (300, text(15000))]
    labels = [(d, 1) for d, _ in good] + [(d, 0) for d, _ in junk]
    return good + junk + odd, labels, [(1, item), (2, None)]


def contaminated(text, items):
    own = words(text)
    windows = {w[i:i + 10] for _, t in items for w in [words(t)] for i in range(len(w) - 9)}
    return any(own[i:i + 10] in windows for i in range(len(own) - 9))


def test_every_stage_equals_brute_force(spark, tmp_path):
    rows, labels, items = fixture()
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(
        f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    sf, docs = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, got = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == columns
            out.write.parquet(f"{tmp_path}/stage{k}")
            docs = spark.read.parquet(f"{tmp_path}/stage{k}")
            got.append([(r["doc_id"], r["text"]) for r in docs.collect()])
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())

    assert sorted(map(repr, got[0])) == sorted(repr(r) for r in rows if "JUNK" not in r[1])

    numbered = list(enumerate(t for _, t in got[0]))  # groups by brute force, one row of each
    group = {i: c for i, c, *_ in brute_links(numbered)}
    where = {}
    for i, row in enumerate(got[0]):
        where.setdefault(row, set()).add(group[i])
    assert len(got[1]) == len(set(group.values())) == len(set().union(*[where[r] for r in got[1]]))

    assert sorted(map(repr, got[2])) == sorted(
        repr(r) for r in got[1] if not contaminated(r[1], items))
    assert not any(d == 7 for d, _ in got[2])

    spans = dict(map(lambda r: (r[0], r[1]), brute_secrets(got[2])))
    want = []
    for d, t in got[2]:
        for start, _, end in sorted(spans[d], reverse=True):
            t = t[:start] + "[SECRET]" + t[end:]
        want.append((d, t))
    assert sorted(map(repr, got[3])) == sorted(map(repr, want))
    assert sum("[SECRET] " in t and t.endswith("[SECRET]") for _, t in got[3]) == 1

    pieces = out.collect()
    check(got[3], pieces, 4096)
    first, second = corpus_pipeline.run(spark, sf), corpus_pipeline.run(spark, sf)
    for again in (second, first):  # a later run leaves an earlier result readable
        assert again.agg({"length": "sum"}).head()[0] == sum(p["length"] for p in pieces)


def test_empty_documents(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int"),
                         ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_null_and_empty_texts(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "a plain sentence of some words."), (None, None)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1)], "doc_id long, quality int").write.parquet(
        f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "")], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(p["doc_tokens"] == 1 for p in pieces) == 1 and {3} <= {p["doc_id"] for p in pieces}
