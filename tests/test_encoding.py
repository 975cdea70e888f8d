import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from visitseq.functions import age_id, attention_mask, index_seg, pad, position_idx, tail
from visitseq.functions.keyed import below, draw_hex, uniform
from visitseq.operators import encode, lookup, masking, vocab as V
from visitseq.sources import materialize


def labelled(spark, rows):
    return spark.createDataFrame(
        rows, "patid long, code array<string>, age array<string>, label array<string>")


CASES = {
    "short": (8, "A B SEP C SEP", "600 600 600 612 612", "CLS A B SEP C SEP PAD PAD",
              [1, 1, 1, 1, 1, 1, 0, 0], [602, 602, 602, 602, 614, 614, 0, 0],
              [0, 0, 0, 0, 1, 1, 2, 2], [0, 0, 0, 0, 1, 1, 0, 0]),
    "cut on sep": (4, "A SEP B SEP", "600 600 612 612", "CLS B SEP PAD",
                   [1, 1, 1, 0], [602, 614, 614, 0], [0, 0, 0, 1], [0, 0, 0, 1]),
    "cut on code": (5, "A B SEP C SEP", "600 600 600 612 612", "CLS B SEP C SEP",
                    [1, 1, 1, 1, 1], [602, 602, 602, 614, 614], [0, 0, 0, 1, 1], [0, 0, 0, 1, 1]),
    "bad ages": (4, "A SEP", "x 1320", "CLS A SEP PAD",
                 [1, 1, 1, 0], [1, 1, 1, 0], [0, 0, 0, 1], [0, 0, 0, 1]),
}
IDS = {"PAD": 0, "UNK": 1, "SEP": 2, "CLS": 3, "A": 5, "B": 6}


@pytest.mark.parametrize("name", CASES)
def test_next_visit_rows(spark, vocab, name):
    max_len, code, age, tokens, mask, ages, position, segment = CASES[name]
    df = labelled(spark, [(9, code.split(), age.split(), ["A", "A", "Z"]),
                          (10, [], [], ["A"])])
    rows = encode.encode_next_visit(df, vocab, V.label_vocab(vocab), max_len).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r.patid == 9
    assert r.code == [IDS.get(t, 1) for t in tokens.split()]
    assert (r.age, r.mask, r.position, r.segment) == (ages, mask, position, segment)
    assert r.label == [0, 1, 1] + [-1] * (max_len - 3)


def test_empty_label_and_label_cut(spark, vocab):
    df = labelled(spark, [(1, ["A", "SEP"], ["1", "1"], []),
                          (2, ["A", "SEP"], ["1", "1"], ["B"] * 9)])
    rows = encode.encode_next_visit(df, vocab, V.label_vocab(vocab), 4).collect()
    assert {r.patid: r.label for r in rows} == {1: [-1] * 4, 2: [2] * 9}
    assert {r.patid: r.label_ids for r in rows} == {1: [], 2: [2] * 9}
    cut = encode.encode_next_visit(df, vocab, V.label_vocab(vocab), 4, label_len=3).collect()
    assert {r.patid: r.label for r in cut} == {1: [-1] * 3, 2: [2] * 3}
    assert {r.patid: r.label_ids for r in cut} == {1: [], 2: [2] * 9}


def test_label_vocab(vocab):
    assert {tuple(r) for r in V.label_vocab(vocab).collect()} == {
        ("UNK", 0), ("A", 1), ("B", 2)}


def test_label_vocab_of_another_order(spark):
    tokens = ["A", "SEP", "UNK", "B", "PAD", "CLS", "C", "MASK"]
    words = spark.createDataFrame([(t, i) for i, t in enumerate(tokens)],
                                  "token string, token_id int")
    assert {tuple(r) for r in V.label_vocab(words).collect()} == {
        ("A", 0), ("UNK", 1), ("B", 2), ("C", 3)}


@pytest.fixture
def gapped(spark):
    tokens = {"PAD": 70, "UNK": 9, "SEP": 20, "CLS": 210, "MASK": 90, "A": 50, "B": 75}
    return spark.createDataFrame(list(tokens.items()), "token string, token_id int")


def test_label_vocab_of_gapped_ids(gapped):
    assert {tuple(r) for r in V.label_vocab(gapped).collect()} == {("UNK", 0), ("A", 1), ("B", 2)}
    links = V.label_of_token(gapped, V.label_vocab(gapped))
    assert {tuple(r) for r in links.collect()} == {(9, 0), (50, 1), (75, 2)}


@pytest.mark.parametrize("drop_kept", [False, True])
def test_masking_of_gapped_ids_is_that_of_dense_ones(spark, vocab, gapped, drop_kept):
    """With ids in the same order both vocabularies draw the same tokens."""
    dense = spark.createDataFrame(
        [(t, i) for i, t in enumerate("UNK SEP A PAD B MASK CLS".split())],
        "token string, token_id int")
    name = {r.token_id: r.token for r in gapped.collect()}
    same = {r.token_id: r.token for r in dense.collect()}
    rows = [encode.encode_mlm(mlm_input(spark, 60), words, 64, 2, 1, drop_kept=drop_kept).collect()
            for words in (gapped, dense)]
    got, want = ({r.patid: ([ids[c] for c in r.code], [ids.get(x) for x in r.label], r.position)
                  for r in table} for table, ids in zip(rows, (name, same)))
    assert got == want and len(got) == 60


def test_build_vocab(spark):
    codes = spark.createDataFrame([(c,) for c in "c b b a a SEP".split()], "code string")
    assert {r.token: r.token_id for r in V.build_vocab(codes).collect()} == {
        "PAD": 0, "UNK": 1, "SEP": 2, "CLS": 3, "MASK": 4, "a": 5, "b": 6, "c": 7}
    assert V.build_vocab(codes, min_count=2).count() == 7


def test_age_vocab(spark):
    assert V.age_vocab(spark, 110).count() == 1322
    assert V.age_vocab(spark, 110, 12).count() == 112
    with pytest.raises(ValueError):
        V.age_vocab(spark, 110, 3)
    table = V.age_vocab(spark, 3, 12, ("PAD", "UNK", "NA"))
    assert {tuple(r) for r in table.collect()} == {
        ("PAD", 0), ("UNK", 1), ("NA", 2), ("0", 3), ("1", 4), ("2", 5)}


def test_age_id_agrees_with_the_table(spark):
    table = V.age_vocab(spark, 2)
    got = table.select(age_id(F.col("age"), 2).alias("got"), "age_id").collect()
    assert len(got) == 26 and all(r.got == r.age_id for r in got)
    odd = spark.createDataFrame([("007",), ("-1",), ("24",), ("1.0",), (None,), ("",)], "age string")
    assert {r[0] for r in odd.select(age_id(F.col("age"), 2)).collect()} == {1}


def test_array_functions(spark):
    row = spark.sql("select array('A','SEP','SEP','B') as t, array(1,2) as n").select(
        tail(F.col("n"), 5), tail(F.col("n"), 1), pad(F.col("n"), 4, -1), pad(F.col("n"), 1, -1),
        position_idx(F.col("t")), index_seg(position_idx(F.col("t"))),
        attention_mask(F.col("t"), 3)).head()
    assert list(row) == [[1, 2], [2], [1, 2, -1, -1], [1], [0, 0, 1, 2], [0, 0, 1, 0], [1, 1, 1]]


def test_masking_by_given_draws(spark, vocab, monkeypatch):
    digits = F.lpad(F.lower(F.hex((F.col("u") * 2 ** 32).cast("bigint"))), 8, "0")
    monkeypatch.setattr(masking, "draw_hex", lambda *key: digits)
    monkeypatch.setattr(masking, "uniform", lambda *key, draw: F.lit(0.9))
    rows = spark.createDataFrame([(1, 0, 5, 0.05), (1, 1, 6, 0.125), (1, 2, 5, 0.14),
                                  (1, 3, 6, 0.5)], "patid long, pos int, token_id long, u double")
    got = masking.random_mask(rows, vocab).orderBy("pos").collect()
    assert [r.output_id for r in got] == [4, 6, 5, 6]
    assert [r.label for r in got] == [5, 6, 5, -1]
    dropped = masking.random_mask(rows, vocab, drop_kept=True).orderBy("pos").collect()
    assert [r.output_id for r in dropped] == [4, 6, None, 6]


def test_share_of_hex_draws(spark):
    draws = spark.range(20000).select(draw_hex(F.col("id")).alias("h"), uniform(F.col("id")).alias("u"))
    for share in (0.0, 0.12, 0.135, 0.15, 0.5, 0.999):
        assert draws.where(below(F.col("h"), share) != (F.col("u") < share)).count() == 0
    edge = spark.createDataFrame([("7fffffff",), ("80000000",)], "h string")
    assert [r[0] for r in edge.select(below(F.col("h"), 0.5)).collect()] == [True, False]


def mlm_input(spark, n=400):
    return spark.createDataFrame(
        [(p, ["A", "B", "SEP"] * 20, ["600"] * 60) for p in range(n)],
        "patid long, code array<string>, age array<string>")


def test_mlm_rows(spark, vocab):
    rows = encode.encode_mlm(mlm_input(spark), vocab, 64, epoch=1, seed=3)
    again = encode.encode_mlm(mlm_input(spark).repartition(5), vocab, 64, epoch=1, seed=3)
    other = encode.encode_mlm(mlm_input(spark), vocab, 64, epoch=2, seed=3)
    first = {r.patid: r for r in rows.collect()}
    assert first == {r.patid: r for r in again.collect()}
    assert first != {r.patid: r for r in other.collect()}
    true_ids = [3] + [5, 6, 2] * 20
    chosen = masked = kept = 0
    for r in first.values():
        assert all(len(r[c]) == 64 for c in ("age", "code", "position", "segment", "mask", "label"))
        assert r.position[:5] == [0, 0, 0, 0, 1] and r.position[61:] == [20] * 3
        for code, label, true in zip(r.code, r.label, true_ids):
            assert label in (-1, true)
            if label == -1:
                assert code == true
            else:
                chosen, masked, kept = chosen + 1, masked + (code == 4), kept + (code == true)
        assert r.label[61:] == [-1] * 3 and r.code[61:] == [0] * 3
    total = 400 * 61
    assert 0.14 < chosen / total < 0.16
    assert 0.77 < masked / chosen < 0.84
    assert 0.08 < kept / chosen < 0.15


def test_stored_parts_and_other_column_names(spark, vocab):
    whole = mlm_input(spark, 20)
    halves = whole.selectExpr("patid", "0 as part", "slice(code, 1, 9) as icd",
                              "slice(age, 1, 9) as years").unionByName(
        whole.selectExpr("patid", "1 as part", "slice(code, 10, 51) as icd",
                         "slice(age, 10, 51) as years"))
    want = sorted(encode.encode_mlm(whole, vocab, 64).collect())
    got = encode.encode_mlm(halves, vocab, 64, code_col="icd", age_col="years", part="part")
    assert sorted(got.collect()) == want
    # a column that happens to be called part means nothing by itself
    assert sorted(encode.encode_mlm(whole.withColumn("part", F.lit(3)), vocab, 64).collect()) == want


@pytest.mark.parametrize("max_len", [4, 6, 64])
def test_parts_with_labels_and_any_key(spark, vocab, max_len):
    whole = [(p, s, ["A", "B", "SEP"] * n, ["600"] * 3 * n, ["B", "Z"])
             for p, s, n in ((1, 0, 1), (1, 1, 9), (2, 0, 3))]
    schema = "patid long, sample int, code array<string>, age array<string>, label array<string>"
    parts = [(p, s, i, c[3 * i:3 * i + 3], a[3 * i:3 * i + 3], x)
             for p, s, c, a, x in whole for i in range(len(c) // 3)]
    cut = spark.createDataFrame(parts, schema.replace("code", "row int, code"))
    key = ("patid", "sample")
    names = V.label_vocab(vocab)
    want = encode.encode_next_visit(spark.createDataFrame(whole, schema), vocab, names, max_len,
                                    key=key)
    got = encode.encode_next_visit(cut, vocab, names, max_len, key=key, part="row")
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 3
    masked = encode.encode_mlm(cut, vocab, max_len, key=key, part="row")
    assert masked.count() == 3


def test_several_rows_of_a_person(spark, vocab):
    df = spark.createDataFrame(
        [(1, 0, ["A", "SEP"], ["1"] * 2, ["B"]), (1, 1, ["B", "A", "SEP"], ["2"] * 3, ["A"])],
        "patid long, sample int, code array<string>, age array<string>, label array<string>")
    rows = encode.encode_next_visit(df, vocab, V.label_vocab(vocab), 5, key=("patid", "sample"))
    assert {(r.patid, r["sample"]): (r.code, r.label[0]) for r in rows.collect()} == {
        (1, 0): ([3, 5, 2, 0, 0], 2), (1, 1): ([3, 6, 5, 2, 0], 1)}
    masked = encode.encode_mlm(df.drop("label"), vocab, 5, key=("patid", "sample"))
    assert masked.count() == 2


def test_masking_stored_rows_equals_masking_tokens(spark, vocab):
    df = mlm_input(spark, 50)
    encoded = encode.encode_sequences(df, vocab, 64)
    got = masking.mask_rows(encoded, vocab, 64, epoch=4, seed=2)
    tokens = encode.tail_cls(df, 64).select("patid", F.posexplode("code").alias("pos", "token"))
    want = masking.random_mask(lookup.encode_tokens(tokens, vocab), vocab, epoch=4, seed=2)
    want = {(r.patid, r.pos): (r.output_id, r.label) for r in want.collect()}
    for r in got.collect():
        assert [(c, l) for c, l in zip(r.code, r.label)][:61] == [want[r.patid, i] for i in range(61)]


def test_dropped_tokens_shorten_the_codes(spark, vocab):
    rows = encode.encode_mlm(mlm_input(spark, 50), vocab, 64, drop_kept=True).collect()
    assert any(r.code.count(0) > 3 for r in rows)
    assert all(len(r.code) == 64 for r in rows)


def test_mask_token_is_unknown(spark, vocab):
    tokens = spark.createDataFrame([("A",), ("B",), ("Q",)], "token string")
    got = {r.token: r.token_id for r in lookup.encode_tokens(tokens, vocab, "B").collect()}
    assert got == {"A": 5, "B": 1, "Q": 1}
    kept = lookup.encode_tokens(tokens, vocab, unknown=False).collect()
    assert {r.token: r.token_id for r in kept} == {"A": 5, "B": 6, "Q": None}


def test_large_vocabulary_is_not_broadcast(spark, vocab, monkeypatch):
    from tests.conftest import plan_of
    df = labelled(spark, [(p, ["A", "SEP", "Q", "SEP"], ["1"] * 4, ["B"]) for p in range(50)])
    names = materialize(V.label_vocab(vocab))
    want = sorted(encode.encode_next_visit(df, vocab, names, 6).collect())
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = encode.encode_next_visit(df, vocab, names, 6)
        plan = plan_of(large)  # heavy values are told apart by a broadcast, the vocabulary is not one
        assert "LeftOuter, BuildRight" not in plan and "SortMergeJoin" in plan
        assert all("LeftAnti" in line for line in plan.splitlines() if "BroadcastHashJoin" in line)
        assert sorted(large.collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shuffled_lookup_of_a_single_column(spark, vocab):
    tokens = spark.createDataFrame([(t,) for t in ["A"] * 500 + ["B", "Q"]], "token string")
    got = lookup.encode_tokens(tokens, vocab, broadcast_bytes=0).collect()
    assert sorted((r.token, r.token_id) for r in got) == [("A", 5)] * 500 + [("B", 6), ("Q", 1)]


def test_round_trip_of_tokens(spark, vocab):
    tokens = spark.createDataFrame([(i, t) for i, t in enumerate(["A", "B", "SEP"])],
                                   "i int, token string")
    ids = lookup.encode_tokens(tokens, vocab).drop("token")
    assert {(r.i, r.token) for r in lookup.decode_tokens(ids, vocab).collect()} == {
        (0, "A"), (1, "B"), (2, "SEP")}


def test_mlm_masks_token_rows(spark, vocab):
    """The draws are made in the token rows of the lookup, not inside the arrays."""
    rows = spark.range(300).selectExpr(
        "id as patid", "transform(sequence(0, int(id % 40)), i -> "
        "if(i % 4 = 3, 'SEP', if(i % 5 = 1, 'Z', if(i % 2 = 0, 'A', 'B')))) as code").selectExpr(
        "*", "transform(code, (c, i) -> string(300 + i)) as age")
    for words in (vocab, vocab.selectExpr("token", "token_id * 3 + 2 as token_id")):
        for drop in (False, True):
            got = encode.encode_mlm(rows, words, 16, 1, 7, drop_kept=drop)
            want = masking.mask_rows(encode.encode_sequences(rows, words, 16), words, 16, 1, 7, drop)
            assert got.columns == want.columns and got.count() == 300
            assert sorted(got.collect()) == sorted(want.collect())
    lines = plan_of(encode.encode_mlm(rows, vocab, 16, 1, 7)).split("\n")
    drawn = [line for line in lines if "md5(" in line]
    assert drawn and not any("lambda" in line for line in drawn)
