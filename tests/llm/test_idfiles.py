from zlib import crc32

import numpy as np
import pytest
from tokenizers import Tokenizer

from visitseq.llm import huffman, idfiles, tokens
from visitseq.sources import scratch_path

TEXTS = ["Hello, World! it's <|endoftext|>", "", None, "é H̱ Été a.,b;c 'S 've",
         "word " * 9000, "tab\tand nbsp\nline\r\n\x01x \x01", "İstanbul ΣΑΣ. AB:C?!",
         "word " * 9000, "a.B!c 12.5 x.y,z"]


def expected(rows):
    tokenizer = Tokenizer.from_file(tokens.vocabulary_path())
    out, start = [], 0
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def read_back(spark, rows, schema="doc_id long, text string", **options):
    path = scratch_path(spark, "test")
    idfiles.write_ids(spark.createDataFrame(rows, schema), path, **options)
    back = idfiles.read_ids(spark, path)
    return [tuple(r) for r in back.select("doc_id", "start", "n_tokens", "ids_crc32").collect()]


def test_round_trip_of_odd_texts(spark):
    rows = [(i * 3, t) for i, t in enumerate(TEXTS)]
    got = read_back(spark, rows[::-1], ids_per_part=5000)
    assert sorted(got) == expected(rows)


def test_rows_sharing_a_doc_id_or_without(spark):
    rows = [(None, "no id"), *[(7, f"text {i}") for i in range(40)], (7, "text 1"), (9, "z")]
    got = read_back(spark, rows, ids_per_part=20)
    assert len(got) == len(rows)
    assert got.count(next(r for r in got if r[0] is None)) == 1
    ends = sorted((r[1], r[1] + r[2], r[0]) for r in got)
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:])) and ends[0][0] == 0
    assert [r[2] for r in ends] == [None] + [7] * 41 + [9]


def test_empty_table_and_clashing_columns(spark):
    assert read_back(spark, []) == []
    rows = [(1, "a b", 5, "x"), (2, None, 6, "y")]
    got = read_back(spark, rows, "doc_id long, text string, part int, ids string")
    assert sorted(got) == expected([r[:2] for r in rows])


@pytest.mark.parametrize("n,limit", [(1, 16), (2, 16), (300, 9), (300, 16), (5000, 13)])
def test_code(n, limit):
    rng = np.random.default_rng(n)
    counts = (rng.pareto(0.5, n) * 3 + 1).astype(np.int64)
    lengths = huffman.code_lengths(counts, limit)
    assert lengths.max() <= limit and (2.0 ** -lengths).sum() <= 1
    if n > 1:
        p = counts / counts.sum()
        assert (p * lengths).sum() <= max(-(p * np.log2(p)).sum() + 1, np.ceil(np.log2(n)))
    sizes = np.array([0, 1, 700, 0, 255, 256, 257])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    symbols = rng.choice(n, offsets[-1])
    bits, starts, at = huffman.encode(symbols, offsets, lengths, huffman.canonical(lengths))
    table = huffman.decode_table(lengths, limit)
    whole = huffman.decode(bits, 8 * starts[:-1], sizes, table, limit)
    assert (whole == symbols).all()
    assert (huffman.decode(bits, at[100:101], np.array([50]), table, limit)
            == symbols[100:150]).all()


def brute_lengths(counts):
    """Huffman by joining the two lightest trees."""
    trees = [(c, [i]) for i, c in enumerate(counts)]
    lengths = [0] * len(counts)
    while len(trees) > 1:
        trees.sort(key=lambda t: t[0])
        (a, x), (b, y), *trees = trees
        for i in x + y:
            lengths[i] += 1
        trees.append((a + b, x + y))
    return lengths


def test_unlimited_code_is_as_short_as_huffman():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 400])
    lengths = huffman.code_lengths(counts, 16)
    assert (counts * lengths).sum() == (counts * np.array(brute_lengths(counts))).sum()
