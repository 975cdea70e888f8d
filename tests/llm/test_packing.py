import itertools
from zlib import crc32

import numpy as np
import pytest
from tokenizers import Tokenizer

from visitseq.llm import packing, tokens


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_consecutive_keys_are_neighbours(dims, bits):
    grid = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = packing.hilbert_key(grid, bits)
    assert sorted(keys) == list(range(len(grid)))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def check(rows, pieces, capacity):
    """Every id of every row is in exactly one piece; sequences are full or a power of two."""
    tokenizer = Tokenizer.from_file(tokens.vocabulary_path())
    want = sorted(((d is None, d or 0), tuple(
        tokenizer.encode(t or "", add_special_tokens=False).ids + [2])) for d, t in rows)
    flat = sorted(((p.doc_id is None, p.doc_id or 0), p.sequence_id, p.offset, p.start, p)
                  for p in pieces)
    got, current = [], []
    for key, _, _, start, p in flat:
        assert crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length > 0
        assert start == len(current)  # pieces of a row follow each other on the curve
        current += np.frombuffer(p.ids, "<u4").tolist()
        if len(current) == p.doc_tokens:
            got.append((key, tuple(current)))
            current = []
    assert sorted(got) == want and not current
    sizes = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == sizes.get(p.sequence_id, 0)
        sizes[p.sequence_id] = p.offset + p.length
    assert sorted(sizes) == list(range(len(sizes)))
    assert all(s <= capacity and (s == capacity or s & (s - 1) == 0) for s in sizes.values())


def test_pieces_cover_all_ids(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(["red", "blue", "x.", "zeta"], rng.integers(0, 60))))
            for i in range(200)]
    rows += [(900, None), (901, ""), (None, "no id"), (902, "long " * 3000)]
    rows += [(i, "the same text in many rows") for i in range(1000, 1200)]  # ties
    rows += [(7, "repeated row"), (7, "repeated row")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows],
                               "doc_id long, text string, bucket int, ids string")
    for capacity, per_bucket in ((64, 500), (4096, 1 << 24)):
        check(rows, packing.pack(df, capacity=capacity, ids_per_bucket=per_bucket).collect(),
              capacity)


def test_copies_lie_together(spark):
    rows = [(i, ["alpha beta gamma delta", "uno dos tres quattro cinco"][i % 2]) for i in range(80)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"),
                          capacity=32).collect()
    order = [p.doc_id % 2 for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset))]
    assert sum(a != b for a, b in zip(order, order[1:])) == 1


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
