import pytest

from visitseq.llm import licences

MIT = licences.TEXTS["MIT"]


def run(spark, rows, known=None):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows],
                               "doc_id long, text string, row int, lines string")
    known = known if known is not None else licences.known_licences(spark)
    return sorted(((r["doc_id"], r["whole"], r["lines"])
                   for r in licences.scan_licences(df, known).collect()), key=repr)


@pytest.mark.parametrize("text", [
    MIT, MIT.upper(), "Copyright (c) 2020 A. Nobody\nAll rights reserved.\n\n" + MIT,
    "© 1999 B\n" + MIT.replace("\n", " ").replace("subject to", "subject to\n   #"),
    MIT.replace("sublicense", "sublicence").replace('"', "“") + "\n\n***\n"])
def test_spellings_of_one_text(spark, text):
    assert run(spark, [(1, text)]) == [(1, ["MIT"], [])]


def test_other_texts_and_lines(spark):
    rows = [(1, MIT + " Not."), (2, "prose\n  // Licenced under the Apache Licence, Version 2.0\nmore"),
            (3, "SPDX-License-Identifier: ISC"), (4, None), (5, ""), (6, "Copyright 2020 X"),
            (None, "Released under the MIT License."), (7, "MIT License is mentioned"),
            (8, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.\n" * 3),
            (8, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.\n" * 3),
            (9, "word\n" * 50000 + "Licensed under GPLv3")]
    assert run(spark, rows) == sorted([
        (1, [], []), (2, [], ["Apache-2.0"]), (3, ["ISC"], ["ISC"]), (4, [], []), (5, [], []),
        (6, [], []), (None, ["MIT"], ["MIT"]), (7, [], []), (8, [], ["CC-BY-NC-4.0", "MIT"]),
        (8, [], ["CC-BY-NC-4.0", "MIT"]), (9, [], ["GPL-3.0"])], key=repr)


def test_empty_tables_and_equal_known_texts(spark):
    assert run(spark, []) == []
    known = spark.createDataFrame([("B", "Some text"), ("A", "some TEXT!"), (None, "x"), ("C", None)],
                                  "licence string, text string")
    assert run(spark, [(1, "Some\ntext"), (2, "some text"), (3, "x")], known) == [
        (1, ["A", "B"], []), (2, ["A", "B"], ["A", "B"]), (3, [], [])]
    assert run(spark, [(1, "a")], known.limit(0)) == [(1, [], [])]


@pytest.mark.parametrize("licence", list(licences.TEXTS))
def test_usual_files(spark, licence):
    text = licences.TEXTS[licence]
    title = licences.TITLES[licence][0]
    flat = text.replace("\n\n", "\n").replace(" copyright ", "\ncopyright ")  # wrapped otherwise
    rows = [(1, f"{title}\n\nCopyright (c) 2020 A. Nobody\n\n{text}"), (2, f"Copyright Acme Inc.\n{flat}"),
            (3, title)]
    assert run(spark, rows) == [(1, [licence], [licence]), (2, [licence], []),
                                (3, [licence], [licence])]


def test_holders_and_headers(spark):
    rows = [(1, "Copyright Nobody and others\n" + MIT), (2, "Copyright Holding plc\n" + MIT),
            (3, "copyright holders\n" + MIT), (4, "copyright notice\n" + MIT),
            (5, '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may')]
    assert run(spark, rows) == [(1, ["MIT"], []), (2, ["MIT"], []), (3, [], []), (4, [], []),
                                (5, [], ["Apache-2.0"])]
