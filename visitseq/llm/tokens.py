"""Token ids of whole texts with a public tokenizer, each distinct piece encoded once.

Pieces repeat far more often than texts, so a task asks the library for new pieces only.
Cutting a text into pieces is exact for tokenizers with word ends (``</w>``), which drop
white space and lower the case: no token spans a space, a line feed, or the border between an
ASCII letter and one of ``.,;:!?``. Texts that hold combining marks (their composition may
depend on case) or ``<|`` (special tokens) are encoded whole, as are all texts of other
tokenizers. ``tests/llm/test_tokens.py`` holds the result against the library on whole texts.

The memory for known pieces is bounded; when it is full the pieces seen once are forgotten,
which costs time and changes nothing.
"""

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from visitseq.llm.textbytes import text_bytes

WORD_BPE = "word_bpe_49k.json"
END_ID = 2
KNOWN_PIECES = 400_000
CHUNK_BYTES = 2 << 20
_MARK = "\x01"  # one id of its own between pieces that are encoded together

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[10] = 32
_STOPS = np.zeros(256, bool)
_STOPS[list(b".,;:!?")] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True

_LATIN = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def _byte_letters() -> list[str]:
    """The letter byte-level models use for each byte: itself where it prints, else the next
    free one from U+0100 on (the public rule of byte-level BPE)."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


_AS_LETTERS = dict(enumerate(_byte_letters()))


def vocabulary_path(name: str = WORD_BPE) -> str:
    """Where the installed package keeps a vocabulary; the same on driver and executors."""
    return public_tokenizers.path(name)


class Encoder:
    """Ids of many texts at once; ``name`` is a file of the public tokenizers."""

    def __init__(self, name: str, known: int = KNOWN_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task is the unit of parallelism
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(vocabulary_path(name))
        self.size = self.tokenizer.get_vocab_size()
        self.by_piece = getattr(self.tokenizer.model, "end_of_word_suffix", None) == "</w>"
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.known = known
        self.slots: dict[str, int] = {}
        self.sizes = np.zeros(0, np.int64)
        self.begins = np.zeros(0, np.int64)
        self.seen = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _forget(self):
        """Keep the pieces that were seen in several chunks."""
        stays = self.seen > 1
        if 2 * stays.sum() > self.known:
            stays[:] = False
        kept = np.flatnonzero(stays)
        pieces = list(self.slots)  # in the order of their slots
        self.slots = {pieces[s]: i for i, s in enumerate(kept)}
        source = np.repeat(stays, self.sizes)  # ids lie in the order of the slots, too
        self.flat, self.sizes, self.seen = self.flat[source], self.sizes[kept], self.seen[kept] // 2
        self.begins = np.cumsum(self.sizes) - self.sizes

    def _encode(self, pieces: list[str]) -> list[list[int]]:
        """Ids of new pieces: Latin words straight from the model, others joined by the mark."""
        out: list = [None] * len(pieces)
        rest, model = [], self.tokenizer.model
        for i, piece in enumerate(pieces):
            if _LATIN.fullmatch(piece):  # one pre-token; its normal form is its lower case
                if not piece.isascii():
                    piece = piece.lower().encode().decode("latin-1").translate(_AS_LETTERS)
                out[i] = [t.id for t in model.tokenize(piece)]
            elif self.mark is None or _MARK in piece:
                out[i] = self.tokenizer.encode(piece, add_special_tokens=False).ids
            else:
                rest.append(i)
        groups = [rest[i:i + 500] for i in range(0, len(rest), 500)]
        texts = [f" {_MARK} ".join(pieces[i] for i in group) for group in groups]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast(
                texts, add_special_tokens=False)):
            ids, first = found.ids + [self.mark], 0
            for i in group:
                last = ids.index(self.mark, first)
                out[i] = ids[first:last]
                first = last + 1
        return out

    def _learn(self, pieces: list[str]):
        ids = self._encode(pieces)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        first = len(self.slots)
        self.slots.update(zip(pieces, range(first, first + len(pieces))))
        self.begins = np.concatenate([self.begins, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.seen = np.concatenate([self.seen, np.zeros(len(sizes), np.int64)])
        self.flat = np.concatenate([self.flat, np.fromiter(
            chain.from_iterable(ids), np.uint32, int(sizes.sum()))])

    def _by_piece(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = _FOLD[data]
        at = np.flatnonzero(_STOPS[data[1:]] & _LOWER[data[:-1]]) + 1
        data = np.insert(data, at, 32)
        offsets = offsets + np.searchsorted(at, offsets)
        texts = pa.LargeStringArray.from_buffers(
            len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
        pieces = pc.split_pattern(texts, " ")
        row_ends = pieces.offsets.to_numpy()[1:]
        coded = pc.dictionary_encode(pieces.flatten())
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        if len(self.slots) + len(distinct) > self.known:
            self._forget()
        known = self.slots.get
        slots = np.array([known(p, -1) for p in distinct], np.int64)
        new = np.flatnonzero(slots < 0)
        if len(new):
            slots[new] = len(self.slots) + np.arange(len(new))
            self._learn([distinct[i] for i in new])
        self.seen[slots] += 1
        slot = slots[coded.indices.to_numpy()]
        sizes = self.sizes[slot]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.begins[slot] - ends[:-1], sizes)]
        return ids, np.concatenate([[0], ends[row_ends]])

    def encode(self, texts: pa.Array, end_id: int | None = END_ID
               ) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of a large_string array, and the n + 1 offsets of the texts.

        ``end_id`` is appended to every text. Nulls count as empty.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = np.ones(len(texts), bool)
        data, offsets = text_bytes(texts)
        if self.by_piece and len(texts):
            odd = np.flatnonzero((data == 0xCC) | (data == 0xCD))
            bars = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
            whole[:] = False
            whole[np.searchsorted(offsets, np.concatenate([odd, bars]), "right") - 1] = True
        if not whole.any() and len(texts):
            ids, ends = self._by_piece(data, offsets)
        else:
            ids, ends = self._mixed(texts, whole)
        if end_id is not None:
            ids = np.insert(ids, ends[1:], np.uint32(end_id))
            ends = ends + np.arange(len(ends))
        return ids, ends

    def _mixed(self, texts: pa.Array, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Some texts whole, the others by piece, in their order."""
        out: list = [np.zeros(0, np.uint32)] * len(texts)
        at = np.flatnonzero(whole)
        for i, found in zip(at, self.tokenizer.encode_batch_fast(
                texts.take(pa.array(at)).to_pylist(), add_special_tokens=False)):
            out[i] = np.asarray(found.ids, np.uint32)
        at = np.flatnonzero(~whole)
        if len(at):
            ids, ends = self._by_piece(*text_bytes(texts.take(pa.array(at))))
            for n, i in enumerate(at):
                out[i] = ids[ends[n]:ends[n + 1]]
        sizes = np.array([len(x) for x in out], np.int64)
        return (np.concatenate([np.zeros(0, np.uint32), *out]),
                np.concatenate([[0], np.cumsum(sizes)]))


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    """One encoder a Python worker, so later tasks find the pieces of earlier ones."""
    return Encoder(name)
