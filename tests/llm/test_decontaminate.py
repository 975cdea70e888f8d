import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from visitseq.llm import decontaminate
from visitseq.llm.textbytes import chunks, grams, words

SCHEMA = "doc_id long, text string, row string, windows int"


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@given(st.lists(st.one_of(st.none(), st.text("aB1é中 ,\n😀-", max_size=12)), max_size=8))
@settings(max_examples=200, deadline=None)
def test_words(texts):
    column = pa.array(["skipped", *texts], pa.string()).slice(1)
    got = [[] for _ in texts]
    hashes = {}
    for first, part in chunks(column, 10):
        found = words(part)
        data = [(t.as_py() or "").encode() for t in part]
        begin = np.cumsum([0, *map(len, data)])
        for row, start, end, value in zip(*found):
            word = data[row][start - begin[row]:end - begin[row]].decode()
            got[first + row].append("".join(c.lower() if c.isascii() else c for c in word))
            assert hashes.setdefault(value, got[first + row][-1]) == got[first + row][-1]
    assert got == [split(t) for t in texts]
    assert len(set(hashes.values())) == len(hashes)


def test_grams_stay_in_their_row():
    row = np.array([0, 0, 0, 1, 1, 3])
    value, whole = grams(np.arange(6, dtype=np.uint64), row, 2)
    assert whole.tolist() == [True, True, False, True, False] and len(set(value.tolist())) == 5
    assert grams(np.arange(2, dtype=np.uint64), row[:2], 3)[0].tolist() == []


@pytest.mark.parametrize("length", range(1, 11))
def test_equal_windows_have_equal_fingerprints(length):
    rng = np.random.default_rng(length)
    hashes = rng.integers(0, 1 << 60, 50, dtype=np.uint64)
    hashes[30:30 + length] = hashes[5:5 + length]
    at, finger, h1, h2 = decontaminate.windows_of(np.zeros(50, int), hashes, length)
    assert at.tolist() == list(range(51 - length))
    assert (finger[5], h1[5], h2[5]) == (finger[30], h1[30], h2[30])
    assert len(set(h1.tolist())) == len(at) - 1 == len(set(h2.tolist()))


def brute(docs, items, window=10):
    out = []
    own = [(i, split(t)) for i, t in items]
    for doc_id, text in docs:
        seq, hit, found = split(text), set(), set()
        for item, w in own:
            n = min(window, len(w))
            windows = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
            for i in range(len(seq) - n + 1):
                if n and tuple(seq[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add(item)
        spans, last = [], None
        for p in sorted(hit):
            if last is None or p > last[1]:
                last = [p, p]
                spans.append(last)
            last[1] = p + 1
        out.append((doc_id, len(seq), len(hit), sorted(str(i) for i in found if i is not None),
                    [tuple(s) for s in spans] or None, bool(hit)))
    return sorted(out, key=repr)


def run(spark, docs, items, **options):
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA)
    held = spark.createDataFrame([(*i, 7) for i in items], "item_id long, text string, length int")
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"],
                    r["spans"] and [tuple(s) for s in r["spans"]], r["contaminated"])
                   for r in decontaminate.decontaminate(df, held, **options).collect()), key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(60)}" for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 4, 9, 10, 11, 25]))) for i in range(30)]
    items += [(100, items[6][1] + " tail"), (101, items[6][1]), (None, text(12)), (102, None),
              (103, "..."), (104, "rare one")]
    docs = []
    for i in range(120):
        seq = text(rng.randrange(40)).split()
        for _ in range(rng.randrange(3)):  # passages, cut at either end, and neighbours of others
            w = rng.choice(items)[1] or ""
            cut = w.split()[rng.randrange(2):]
            at = rng.randrange(len(seq) + 1)
            seq[at:at] = cut[:len(cut) - rng.randrange(2)]
        docs.append((i, ", ".join(seq).upper() if i % 3 else "\n".join(seq)))
    docs += [(5, docs[5][1]), (5, "other"), (None, items[8][1]), (900, None), (901, ""),
             (902, "w1 " * 60000 + (items[6][1] or ""))]
    assert run(spark, docs, items) == brute(docs, items)


def test_one_passage_in_most_documents(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = [(i, f"start {i} {passage} end" if i % 3 else f"clean {i}") for i in range(600)]
    items = [(i, passage) for i in range(40)] + [(99, "p29 p28")]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == [(1, 2, 0, [], None, False)]


def test_other_window(spark):
    docs, items = [(1, "a b c d e f"), (2, "b c d")], [(1, "x b c d y"), (2, "e f")]
    assert run(spark, docs, items, window=3) == brute(docs, items, 3)
