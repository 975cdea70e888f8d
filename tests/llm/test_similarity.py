import random
import re
from collections import Counter

import pytest

from visitseq.llm import similarity
from visitseq.llm.components import components

SCHEMA = "doc_id long, text string, node long, bucket string"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return tuple(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low))


def grams(seq):
    return frozenset(seq[i:i + 5] for i in range(max(1, len(seq) - 4))) if seq else frozenset()


def brute(rows, threshold=0.8):
    """Links of all pairs of different word sequences, and components by their smallest id."""
    key = {i: words(t) or ("bytes", t or "") for i, (d, t) in enumerate(rows)}
    named = sorted({k for i, k in key.items() if any(
        rows[j][0] is not None for j, o in key.items() if o == k)}, key=repr)
    ids = {k: min(rows[j][0] for j, o in key.items() if o == k and rows[j][0] is not None)
           for k in named}
    links, parent = Counter(), {k: k for k in named}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    sets = {k: grams(k) if k[0] != "bytes" else frozenset() for k in named}
    for a, x in enumerate(named):
        for y in named[a + 1:]:
            both = len(sets[x] & sets[y])
            if both and both >= threshold * len(sets[x] | sets[y]):
                links[x] += 1
                links[y] += 1
                parent[root(x)] = root(y)
    low = {}
    for k in named:
        low[root(k)] = min(low.get(root(k), ids[k]), ids[k])
    copies = Counter(key.values())
    return sorted(((d, low[root(key[i])] if key[i] in parent else None, links[key[i]],
                    copies[key[i]]) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []

    def add(seq):
        rows.append((len(rows), " ".join(seq)))

    for _ in range(60):  # groups of near copies at several distances
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 30, 120]))]
        add(base)
        for _ in range(rng.choice([0, 0, 1, 3, 12])):
            seq = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                seq[rng.randrange(len(seq))] = rng.choice(vocabulary)
            add(seq)
    for _ in range(150):  # a passage that many share
        add(passage + [rng.choice(vocabulary) for _ in range(rng.choice([3, 40, 200]))])
    big = [rng.choice(vocabulary) for _ in range(150)]
    for i in range(180):  # one large group of near copies
        add(big[:-1] + [f"end{i}"])
    for _ in range(100):  # and one of exact copies
        add(big + big)
    return rows


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in similarity.similar(df, **options).select(
        "doc_id", "class_id", "n_links", "n_copies").collect()), key=repr)


def test_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 50)  # several blocks in the large group
    rows = corpus()
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, None), (2, ""), (3, "!!!"), (4, "One, two"), (5, "one two"), (6, "two one"),
            (7, text), (7, text), (7, text + " other words here"), (None, text), (None, "alone"),
            (8, text.upper() + "!"), (9, "long " * 30000), (10, "long " * 29999)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    edges += [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(2000, 2300)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert dict(map(tuple, got)) == {x: root(x) for x in parent if root(x) != x}


def test_rows_without_id_and_repeated_ids(spark):
    base = [f"w{i}" for i in range(40)]
    # a chain: the text in the middle links both others and has no id
    rows = [(5, " ".join([*base[:-3], *"abc"])), (None, " ".join(base)),
            (3, " ".join([*"def", *base[3:]]))]
    sets = [grams(words(t)) for _, t in rows]
    linked = [len(a & b) >= 0.8 * len(a | b) for a, b in
              ((sets[0], sets[1]), (sets[1], sets[2]), (sets[0], sets[2]))]
    assert linked == [True, True, False]
    lone = [f"y{i}" for i in range(40)]
    rows += [(None, " ".join(lone)), (None, " ".join([*lone[:-1], "z"]))]
    rows += [(7, " ".join([f"v{n}w{i}" for i in range(30)])) for n in range(50)]
    assert run(spark, rows) == sorted(
        [(5, 3, 1, 1), (None, 3, 2, 1), (3, 3, 1, 1), (None, None, 1, 1), (None, None, 1, 1)]
        + [(7, 7, 0, 1)] * 50, key=repr)
