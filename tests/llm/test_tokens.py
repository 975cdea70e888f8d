import pyarrow as pa
from hypothesis import given, settings, strategies as st
import pytest

from visitseq.llm import tokens

ALPHABET = "aAbBzZéÉßΣσİıÅ 12\n\t\r\x0b\x1c  .,;:!?'\"-_<|≯̱́中😀\x01"


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.WORD_BPE, known=50)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.one_of(st.text(ALPHABET, max_size=40), st.sampled_from(
    ["<|endoftext|>", "x<|EndOfText|>.y", "it's 'LL", "", "a.b", None])), max_size=6))
def test_pieces_give_the_ids_of_whole_texts(encoder, texts):
    ids, ends = encoder.encode(pa.array(texts, pa.string()), None)
    got = [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]
    assert got == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_other_tokenizers_encode_whole_texts():
    encoder = tokens.Encoder("byte_bpe_50k.json")
    texts = ["a b  c", "", "line\n\nline <|endoftext|>"]
    ids, ends = encoder.encode(pa.array(texts), None)
    got = [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
