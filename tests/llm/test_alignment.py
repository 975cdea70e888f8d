"""Alignment against plain loops over what the libraries give for whole texts."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from visitseq.llm import alignment

ODD = [None, "", " ", "a", "  two  spaces ", "x▁y", "tab\tand\n\nlines  nbsp 　 wide",
       "<|endoftext|> </s><s> <0x41>", "é 😀 smile 日本語 テキスト", "\x00nul", "it's they'll 12 345",
       "trailing  ", "é è", " ", "x  y", "ab 日 本", "日 本 x", "a" * 5000, "ab" * 3000,
       "x" * 100 + " ▁ " + "y" * 100, "the same words", "the same words", "\n a", " \n a b\n c"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    return first


def plain(text, library):
    """(n_a, n_b, n_groups, groups, linked pairs) by the definition."""
    both = alignment.vocabularies()
    if not text:
        return 0, 0, 0, "", []
    a = library.encode(" " + text, add_special_tokens=False).ids
    b = both.second.encode(text)
    ends = []
    for n, ids in enumerate((a, b)):
        if b"".join(both.bytes_of[n][i] for i in ids) != (" " + text).encode():
            return 0, 0, 0, "", []
        ends.append(np.cumsum([len(both.bytes_of[n][i]) for i in ids]).tolist())
    groups, links, i, j = [], [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        i_end, j_end = ends[0].index(cut) + 1, ends[1].index(cut) + 1
        groups.append(",".join(map(str, a[i:i_end])) + "|" + ",".join(map(str, b[j:j_end])))
        links.append((a[i_end - 1], b[j_end - 1]))
        i, j = i_end, j_end
    return len(a), len(b), len(groups), ";".join(groups), links


def compare(df, library):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    aligned = alignment.align(df)
    got = alignment.weigh(aligned, alignment.link_counts(aligned)).collect()
    want = [(doc, *plain(text, library)) for doc, text in rows]
    count = Counter(pair for row in want for pair in row[5])
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    full = sorted((*row[:5], len(row[5]), sum(count[p] == best[p[1]] for p in row[5]),
                   sum(count[p] for p in row[5])) for row in want)
    assert sorted(tuple(r) for r in got) == full


def test_odd_texts(spark, library):
    compare(spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string"), library)


def test_whole_table(spark, library):
    compare(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), library)


def test_small_memory(spark, library, monkeypatch):
    """What a full memory forgets is encoded again."""
    both = alignment.Vocabularies(alignment.FIRST, alignment.SECOND, known=40)
    monkeypatch.setattr(alignment, "TOGETHER", 3)
    texts = [f"word{i % 9} other{i % 4} rare{i} ▁ x" for i in range(60)]
    from visitseq.llm.textbytes import text_bytes
    import pyarrow as pa
    for text in texts:
        data, offsets = text_bytes(pa.array([" " + text, " plain words"], pa.large_string()))
        (a, a_at), (b, b_at) = both.tokens(data, offsets)
        assert a_at[1] == b_at[1] == 0  # U+2581 is not given back
        assert a.tolist() == library.encode(" plain words", add_special_tokens=False).ids
        assert len(both.slots) <= 40


@settings(max_examples=300, deadline=None)
@given(st.text("ab .,'1é▁ \n日", min_size=1, max_size=40))
def test_pieces_make_whole_texts(text):
    both = alignment.vocabularies()
    data = np.frombuffer((" " + text).encode(), np.uint8)
    found = both.tokens(data, np.array([0, len(data)]))
    whole = both.encode(" " + text)
    given_back = all(b"".join(both.bytes_of[n][i] for i in whole[n]) == (" " + text).encode()
                     for n in range(2))
    for (ids, _), want in zip(found, whole):
        assert ids.tolist() == (want.tolist() if given_back else [])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 80)), st.sets(st.integers(1, 80))), min_size=1,
                max_size=4))
def test_shared_cuts(texts):
    a, b, a_last, b_last = [], [], [], []
    for n, (x, y) in enumerate(texts):
        a += [100 * n + i for i in sorted(x | {90})]
        b += [100 * n + i for i in sorted(y | {90})]
        a_last.append(len(a) - 1)
        b_last.append(len(b) - 1)
    cut_a, cut_b = alignment.shared_cuts(*map(np.array, (a, b, a_last, b_last)))
    common = sorted(set(a) & set(b))
    assert [a[i] for i in cut_a] == common and [b[i] for i in cut_b] == common


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "ab cd", "x")], "doc_id long, text string, links string")
    out = alignment.align(df, keep=["doc_id"])
    assert out.count() == 1
    wide = df.withColumnsRenamed({"links": "n_links"})
    rows = alignment.align(wide, keep=["doc_id", "text"]).collect()
    assert rows[0]["text"] == "ab cd" and rows[0]["n_groups"] > 0
    empty = df.limit(0)
    aligned = alignment.align(empty)
    assert alignment.weigh(aligned, alignment.link_counts(aligned)).count() == 0
