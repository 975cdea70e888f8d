import pytest
from pyspark.errors import AnalysisException

from visitseq import sources
from visitseq.operators import batches
from visitseq.operators.vocab import extend_vocab


def write(path, text):
    path.write_bytes(text.encode())


def test_tsv(spark, tmp_path):
    write(tmp_path / "t.txt", 'a\tb\n1\t\n"q\tz\na\tb\n')
    df = sources.read_tsv(spark, str(tmp_path / "t.txt"))
    assert df.columns == ["a", "b"]
    assert sorted(tuple(r) for r in df.collect()) == [('"q', "z"), ("1", "")]


def test_tsv_parts_with_and_without_header(spark, tmp_path):
    write(tmp_path / "part-0.txt", "a\tb\n1\t2\n")
    write(tmp_path / "part-1.txt", "3\t4\n" * 50)
    write(tmp_path / "part-2.txt", "a\tb\n5\t6\n")
    rows = sources.read_tsv(spark, str(tmp_path)).collect()
    assert len(rows) == 52 and set(rows) == {("1", "2"), ("3", "4"), ("5", "6")}


def test_tsv_after_empty_files_and_lines(spark, tmp_path):
    write(tmp_path / "part-0.txt", "")
    write(tmp_path / "part-1.txt", "\n\na\n1\n")
    write(tmp_path / "part-2.txt", "2\n" * 200)
    df = sources.read_tsv(spark, str(tmp_path), ragged="drop")
    assert df.columns == ["a"] and {r.a for r in df.collect()} <= {"", "1", "2"}
    assert df.where("a <> ''").count() == 201


def test_tsv_ragged_lines(spark, tmp_path):
    write(tmp_path / "t.txt", "a\tb\n1\t2\n3\n4\t5\t6\n7\t\n")
    with pytest.raises(Exception, match="not 2 fields"):
        sources.read_tsv(spark, str(tmp_path / "t.txt")).collect()
    with pytest.raises(Exception, match="not 2 fields"):
        sources.read_tsv(spark, str(tmp_path / "t.txt")).count()
    kept = sources.read_tsv(spark, str(tmp_path / "t.txt"), ragged="drop").collect()
    assert sorted(tuple(r) for r in kept) == [("1", "2"), ("7", "")]
    with pytest.raises(ValueError):
        sources.read_tsv(spark, str(tmp_path / "t.txt"), ragged="ignore")


def test_tsv_without_rows(spark, tmp_path):
    write(tmp_path / "t.txt", "")
    with pytest.raises(ValueError):
        sources.read_tsv(spark, str(tmp_path / "t.txt"))


def test_csv_columns_are_text(spark, tmp_path):
    write(tmp_path / "t.csv", 'a,b\n1,"x,y"\n')
    df = sources.read_csv(spark, str(tmp_path / "t.csv"))
    assert df.dtypes == [("a", "string"), ("b", "string")]
    assert tuple(df.head()) == ("1", "x,y")


def test_tsv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, 0.5, 'say "x"', ""), (1, 0.25, "a b", "y")],
                               "epoch int, loss double, note string, rest string")
    sources.write_tsv(df, str(tmp_path / "log"))
    back = sources.read_tsv(spark, str(tmp_path / "log"))
    assert sorted(tuple(r) for r in back.collect()) == [
        ("0", "0.5", 'say "x"', ""), ("1", "0.25", "a b", "y")]


def test_parquet_sink_does_not_overwrite(spark, tmp_path):
    df = spark.range(3)
    sources.write_parquet(df, str(tmp_path / "p"))
    with pytest.raises(AnalysisException):
        sources.write_parquet(df, str(tmp_path / "p"))
    sources.write_parquet(df, str(tmp_path / "p"), mode="overwrite")
    assert sources.read_parquet(spark, str(tmp_path / "p")).count() == 3


def test_binary_is_read_as_text(spark, tmp_path):
    spark.sql("select cast('abc' as binary) as code, 1 as n").write.parquet(str(tmp_path / "b"))
    df = sources.read_parquet(spark, str(tmp_path / "b"))
    assert df.dtypes == [("code", "string"), ("n", "int")] and df.head().code == "abc"
    raw = sources.read_parquet(spark, str(tmp_path / "b"), binary_as_string=False)
    assert raw.dtypes[0] == ("code", "binary")


def test_nested_binary_is_read_as_text(spark, tmp_path):
    spark.sql("""select array(cast('a' as binary), null) as code, map('k', cast('v' as binary)) as m,
        struct(cast('s' as binary) as x, 1 as y) as s, array(1, 2) as n""").write.parquet(
        str(tmp_path / "b"))
    df = sources.read_parquet(spark, str(tmp_path / "b"))
    assert df.dtypes == [("code", "array<string>"), ("m", "map<string,string>"),
                         ("s", "struct<x:string,y:int>"), ("n", "array<int>")]
    assert df.head().asDict(True) == {"code": ["a", None], "m": {"k": "v"},
                                      "s": {"x": "s", "y": 1}, "n": [1, 2]}


def test_dropped_table_is_gone(spark):
    with sources.recording() as paths:
        assert sources.materialize(spark.range(3)).count() == 3
    sources.materialize(spark.range(3))
    (path,) = paths
    sources.drop_table(spark, path)
    with pytest.raises(AnalysisException):
        spark.read.parquet(path)


def test_vocab_store(spark, vocab, tmp_path):
    sources.write_vocab(vocab, str(tmp_path / "v"))
    assert sorted(sources.read_vocab(spark, str(tmp_path / "v")).collect()) == sorted(vocab.collect())


def test_materialize_uses_the_checkpoint_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert sources.materialize(spark.range(3)).inputFiles()[0].startswith(f"file://{root}")


def test_log_of_repeated_epochs(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [("a b", 0, 0.5), ("a b", 1, 0.4), ("c/d", 0, 0.1)]
    for own in (rows[:1], rows[1:], [("a b", 1, 0.3)]):
        sources.append_log(spark.createDataFrame(own, "run string, epoch int, loss double"), path)
    back = sources.read_tsv(spark, path)
    assert back.columns == ["run", "epoch", "loss"]
    assert sorted(map(tuple, back.collect())) == [
        ("a b", "0", "0.5"), ("a b", "1", "0.3"), ("c/d", "0", "0.1")]


def test_epoch_store(spark, tmp_path):
    path = str(tmp_path / "epoch")
    rows = batches.assign_batches(spark.range(1000).withColumnRenamed("id", "patid"), 32, 1, 3)
    want = {r.patid: r for r in rows.collect()}
    sources.write_epoch(rows, path, 4)
    sources.write_epoch(rows.repartition(13), path, 4, mode="overwrite")  # written again
    index = spark.read.parquet(f"{path}/index")
    assert index.count() == 32 and index.select("file").distinct().count() == 8
    assert {r.patid: r for r in sources.read_epoch(spark, path).collect()} == want
    for batch in (0, 17, 31):
        got = sources.read_batch(spark, path, batch).collect()
        assert [r.row_index for r in got] == list(range(32 * batch, min(32 * batch + 32, 1000)))
    late = sources.read_epoch(spark, path, 20)
    assert late.count() == 1000 - 640 and len(late.inputFiles()) == 3
    assert sources.read_batch(spark, path, 32).count() == 0
    sources.write_epoch(rows.where("patid < 0"), str(tmp_path / "none"))
    assert sources.read_epoch(spark, str(tmp_path / "none")).count() == 0


def test_epoch_of_many_files(spark, tmp_path):
    path = str(tmp_path / "epoch")
    rows = sources.materialize(
        batches.assign_batches(spark.range(1003).withColumnRenamed("id", "patid"), 4, 1, 3))
    sources.write_epoch(rows, path, 2)
    index = sorted(map(tuple, spark.read.parquet(f"{path}/index").collect()))
    assert [(b, n) for b, _, n in index] == [(b, 4 if b < 250 else 3) for b in range(251)]
    names = [name for _, name, _ in index]
    assert names == sorted(names) and names[::2] == sorted(set(names))
    assert len({name.split("-")[1] for name in names}) <= 8  # tasks do not grow with the files
    for start, stop in ((0, None), (7, 240)):
        want = rows.where(f"batch_id >= {start} and batch_id < {stop or 251}").collect()
        got = sources.read_epoch(spark, path, start, stop).collect()
        assert sorted(got) == sorted(want) and want
    some = rows.where("row_index % 3 > 0 and batch_id > 1")  # batches of several sizes
    sources.write_epoch(some, str(tmp_path / "some"), 2)
    assert sorted(sources.read_epoch(spark, str(tmp_path / "some")).collect()) == sorted(some.collect())
    assert spark.read.parquet(str(tmp_path / "some/index")).count() == 249


def test_vocabulary_grows_without_changing_ids(spark, tmp_path, vocab):
    codes = spark.createDataFrame([(c,) for c in ["B", "Z", "Z", "Y", "Y", "X", None, None, "PAD"]],
                                  "code string")
    first = extend_vocab(vocab, codes, min_count=2)
    assert sorted(map(tuple, first.where("token_id > 4").collect())) == [
        ("A", 5, 0), ("B", 6, 0), ("Y", 7, 1), ("Z", 8, 1)]
    sources.write_vocab(first, str(tmp_path / "v"))
    second = extend_vocab(sources.read_vocab(spark, str(tmp_path / "v")), codes)
    assert set(first.collect()) < set(second.collect())
    assert tuple(second.where("version = 2").head()) == ("X", 9, 2)
    assert extend_vocab(second, codes).count() == second.count()
