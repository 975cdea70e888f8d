"""Groups of tokens of two tokenizers that cover the same bytes.

A byte offset of a text at which a token of either tokenizer ends is a shared cut; the tokens
between two shared cuts are a group. Cuts are found by divide and conquer: an interval of a text
is probed at the end of its middle token, by bisection in the ends of the other tokenizer, then
at the ends next to the middle on either side; at the first common end it falls into two halves
that are treated alike, and an interval without any is a leaf, one group. All intervals of a
chunk of texts go through a level together, as numpy arrays.

Both tokenizers see a space and the text. No token spans the border before a single space
between two visible characters (byte-level BPE cuts words there, and no piece of the other
vocabulary has a space behind another character; this is checked when it is loaded), so pieces
between such spaces are encoded once per task; the memory for them is bounded and what it
forgets is encoded again. Alignment knows nothing of pieces.

The two tokens that end at a shared cut are linked. One of them ends with the other, so the
pairs that can be linked are bounded by the vocabularies (every token has at most as many ends
as it has bytes), not by the corpus; only for this reason their counts are broadcast.

Null and empty texts, and texts that a tokenizer does not give back byte for byte, have no
tokens and no groups. Rows are treated one by one, repeated rows and rows without id like
others; other columns are not read unless kept with ``keep``. An empty table gives no rows.
"""

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from visitseq.llm.textbytes import chunks, text_bytes

FIRST = "byte_bpe_50k.tiktoken"  # the same vocabulary as the .json file, without specials
SECOND = "piece_bpe_32k.model"
KNOWN_PIECES = 400_000
TOGETHER = 1000            # new pieces that are encoded as one text
LONG_PIECE = 64            # longer pieces are encoded each time
NEAR = 16                  # ends around the middle that are probed one by one

_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_LEAD2 = np.zeros(256, bool)   # first byte of a two-byte character that is no white space
_LEAD2[0xC3:0xE0] = True
_OPENS = _VISIBLE.copy()       # first byte of a character that is no white space
_OPENS[0xC3:0xF5] = True
_OPENS[[0xE1, 0xE2, 0xE3]] = False


class Vocabularies:
    """Both tokenizers, the bytes of their tokens, and the pieces a worker has seen."""

    def __init__(self, first: str, second: str, known: int = KNOWN_PIECES):
        import sentencepiece
        import tiktoken
        with open(public_tokenizers.path(first), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank)
                     for token, rank in map(bytes.split, lines)}
        self.first = tiktoken.Encoding(first, pat_str=public_tokenizers.PATTERN,
                                       mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(
            model_file=public_tokenizers.path(second))
        self.bytes_of = [[b""] * (max(ranks.values()) + 1),
                         [self._piece(i) for i in range(self.second.get_piece_size())]]
        for token, rank in ranks.items():
            self.bytes_of[0][rank] = token
        if any(b" " in piece.lstrip(b" ") for piece in self.bytes_of[1]):
            raise ValueError(f"{second} has pieces with a space inside: texts cannot be cut there")
        self.sizes = [np.array([len(x) for x in table], np.int64) for table in self.bytes_of]
        self.known = known
        self._clear()

    def _piece(self, i: int) -> bytes:
        piece = self.second.id_to_piece(i)
        if self.second.is_byte(i):
            return bytes([int(piece[1:-1], 16)])
        return piece.replace("▁", " ").encode()

    def _clear(self):
        self.slots: dict[bytes, int] = {}
        self.flat = [np.zeros(0, np.uint32), np.zeros(0, np.uint32)]
        self.begins = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.counts = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.exact = np.zeros(0, bool)
        self.seen = np.zeros(0, np.int64)

    def _forget(self):
        """Keep the pieces that were seen in several chunks."""
        stays = np.zeros(len(self.exact), bool)
        stays[list(self.slots.values())] = True
        stays &= self.seen > 1
        if 2 * stays.sum() > self.known:
            return self._clear()
        place = np.cumsum(stays) - 1
        self.slots = {p: int(place[s]) for p, s in self.slots.items() if stays[s]}
        for n in range(2):
            self.flat[n] = self.flat[n][np.repeat(stays, self.counts[n])]
            self.counts[n] = self.counts[n][stays]
            self.begins[n] = np.cumsum(self.counts[n]) - self.counts[n]
        self.exact, self.seen = self.exact[stays], self.seen[stays] // 2

    def encode(self, text: str) -> list[np.ndarray]:
        """The ids of a text that begins with the added space, by both tokenizers."""
        second = self.second.encode(text[1:], num_threads=1)  # it adds the space itself
        return [np.array(self.first.encode_ordinary(text), np.uint32),
                np.array(second, np.uint32)]

    def _encode(self, pieces: list[bytes]) -> list[tuple]:
        """(ids, tokens of each piece) for both tokenizers, and whether each piece is given
        back. Pieces that may stand side by side are encoded as one text."""
        joined = b"".join(pieces)
        ends = np.cumsum([len(p) for p in pieces])
        out = []
        for n, ids in enumerate(self.encode(joined.decode())):
            stops = np.cumsum(self.sizes[n][ids])
            at = np.searchsorted(stops, ends)
            if b"".join(map(self.bytes_of[n].__getitem__, ids.tolist())) != joined:
                break
            out.append((ids, np.diff(at, prepend=-1)))
        else:
            return [*out, np.ones(len(pieces), bool)]
        if len(pieces) == 1:
            none = np.zeros(0, np.uint32), np.zeros(1, np.int64)
            return [none, none, np.zeros(1, bool)]
        each = [self._encode([p]) for p in pieces]
        return [(np.concatenate([x[n][0] for x in each]), np.concatenate([x[n][1] for x in each]))
                for n in range(2)] + [np.concatenate([x[2] for x in each])]

    def _learn(self, pieces: list[bytes], alone: np.ndarray):
        """New pieces in their order; those ``alone`` (of odd begin or end) one by one."""
        groups, first = [], 0
        borders = np.flatnonzero(alone | np.roll(alone, 1)) if alone.any() else []
        for last in [*borders, len(pieces)]:
            groups += [pieces[i:min(i + TOGETHER, last)] for i in range(first, last, TOGETHER)]
            first = last
        found = [self._encode(group) for group in groups]
        for n in range(2):
            sizes = np.concatenate([x[n][1] for x in found])
            self.begins[n] = np.concatenate([
                self.begins[n], len(self.flat[n]) + np.cumsum(sizes) - sizes])
            self.counts[n] = np.concatenate([self.counts[n], sizes])
            self.flat[n] = np.concatenate([self.flat[n], *(x[n][0] for x in found)])
        self.exact = np.concatenate([self.exact, *(x[2] for x in found)])
        self.seen = np.concatenate([self.seen, np.zeros(len(pieces), np.int64)])

    def tokens(self, data: np.ndarray, offsets: np.ndarray) -> list:
        """For each tokenizer the ids and the n + 1 offsets of the texts in them; ``offsets``
        are those of texts that begin with their added space. Texts that are not given back
        byte for byte have no ids."""
        space = np.flatnonzero(data[1:-1] == 32) + 1
        before, after = data[space - 1], data[space + 1]
        two = (before >= 0x80) & _LEAD2[data[np.maximum(space - 2, 0)]]
        cuts = np.union1d(space[(_VISIBLE[before] | two) & _OPENS[after]], offsets)
        pieces = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(cuts) - 1,
            [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)])
        coded = pc.dictionary_encode(pieces)
        distinct = coded.dictionary.to_pylist()
        if len(self.slots) + len(distinct) > self.known or len(self.flat[0]) > 8 * self.known:
            self._forget()
        known = self.slots.get
        slots = np.array([known(p, -1) for p in distinct], np.int64)
        new = np.flatnonzero(slots < 0)
        if len(new):
            slots[new] = len(self.exact) + np.arange(len(new))
            learnt = [distinct[i] for i in new]
            odd = ~np.array([len(p) > 1 and _OPENS[p[1]]
                             and (_VISIBLE[p[-1]] or p[-1] >= 0x80 and _LEAD2[p[-2]])
                             for p in learnt])
            self._learn(learnt, odd)
            self.slots.update((p, int(s)) for p, s in zip(learnt, slots[new])
                              if len(p) <= LONG_PIECE)
        self.seen[slots] += 1
        slot = slots[coded.indices.to_numpy()]
        first = np.searchsorted(cuts, offsets)  # the first piece of each text
        bad = np.add.reduceat(~self.exact[slot], first[:-1]) > 0 if len(slot) else np.zeros(0, bool)
        out = []
        for n in range(2):
            sizes = np.where(np.repeat(bad, np.diff(first)), 0, self.counts[n][slot])
            ends = np.concatenate([[0], np.cumsum(sizes)])
            ids = self.flat[n][np.arange(ends[-1])
                               + np.repeat(self.begins[n][slot] - ends[:-1], sizes)]
            out.append((ids, ends[first]))
        return out


@lru_cache(maxsize=2)
def vocabularies(first: str = FIRST, second: str = SECOND) -> Vocabularies:
    """One pair a Python worker, so later tasks find the pieces of earlier ones."""
    return Vocabularies(first, second)


def shared_cuts(a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray
                ) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` (rising token ends) of the common ends, in order.

    ``a_last`` and ``b_last`` are the places of the last token of each text, whose ends are equal.
    """
    low = np.concatenate([[0], a_last[:-1] + 1])  # an interval: tokens low .. high - 1 of a,
    high = a_last                                 # b_low .. b_high - 1 of b, behind it a cut
    b_low, b_high = np.concatenate([[0], b_last[:-1] + 1]), b_last
    found_a, found_b = [a_last], [b_last]
    while True:
        some = np.flatnonzero((low < high) & (b_low < b_high))
        low, high, b_low, b_high = low[some], high[some], b_low[some], b_high[some]
        if not len(low):
            break
        middle = (low + high) >> 1
        cut_a, cut_b = np.full(len(low), -1), np.full(len(low), -1)
        open_ = np.arange(len(low))
        for away in range(NEAR):  # the middle, one before it, one after it, two before it, ...
            at = middle[open_] + (away + 1) // 2 * (-1 if away % 2 else 1)
            place = np.searchsorted(b, a[at])
            hit = b[place] == a[at]
            cut_a[open_[hit]], cut_b[open_[hit]] = at[hit], place[hit]
            open_ = open_[~hit & ((high - low)[open_] > away + 1)]
            if not len(open_):
                break
        else:  # what is still open is probed at all its ends, and the nearest hit taken
            sizes = (high - low)[open_]
            first = np.cumsum(sizes) - sizes
            at = np.arange(sizes.sum()) + np.repeat(low[open_] - first, sizes)
            place = np.searchsorted(b, a[at])
            far = np.abs(at - np.repeat(middle[open_], sizes)) * 2 + (at > np.repeat(
                middle[open_], sizes))
            far[b[place] != a[at]] = 2 * len(a)
            least = np.minimum.reduceat(far, first)
            hit = np.flatnonzero((far == np.repeat(least, sizes)) & (far < 2 * len(a)))
            rows = np.repeat(open_, sizes)[hit]
            cut_a[rows], cut_b[rows] = at[hit], place[hit]
        split = cut_a >= 0
        cut_a, cut_b = cut_a[split], cut_b[split]
        found_a.append(cut_a)
        found_b.append(cut_b)
        low, high = np.concatenate([low[split], cut_a + 1]), np.concatenate([cut_a, high[split]])
        b_low, b_high = (np.concatenate([b_low[split], cut_b + 1]),
                         np.concatenate([cut_b, b_high[split]]))
    return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))


@lru_cache(maxsize=1)
def _decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0 .. size - 1, one row each, and how many there are."""
    width = len(str(size - 1))
    numbers = np.arange(size).astype(f"S{width}")
    return numbers.view(np.uint8).reshape(size, width), np.char.str_len(numbers)


def _as_text(ids: list, cuts: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All groups as ``a1,a2|b1;a3|b2`` bytes, and where each token's part ends in them, in the
    order of the text: a group's first tokens, then its second ones."""
    own = [np.diff(c, prepend=-1) for c in cuts]  # tokens of each group
    before = [np.repeat(np.cumsum(own[1]) - own[1], own[0]), np.repeat(np.cumsum(own[0]), own[1])]
    place = [np.arange(len(ids[n])) + before[n] for n in range(2)]
    token = np.empty(len(ids[0]) + len(ids[1]), np.int64)
    mark = np.full(len(token), ord(","), np.uint8)
    for n in range(2):
        token[place[n]] = ids[n]
        mark[place[n][cuts[n]]] = ord("|;"[n])
    digits, length = _decimals(size)
    table = np.empty((len(token), digits.shape[1] + 1), np.uint8)
    table[:, :-1] = digits[token]
    length = length[token]
    table[np.arange(len(token)), length] = mark
    kept = np.arange(table.shape[1]) <= length[:, None]
    return table[kept], np.cumsum(length + 1)


def align(docs: DataFrame, keep=("doc_id",), first: str = FIRST, second: str = SECOND
          ) -> DataFrame:
    """``keep``, n_a, n_b, n_groups, groups, links: one row a row of ``docs``.

    ``groups`` lists the ids of the groups, ``a1,a2|b1;a3|b2,b3`` ('' without tokens). ``links``
    are the distinct linked pairs as a binary of unsigned 32-bit numbers, the numbers
    a * (size of the second vocabulary) + b first, then how often each is linked.
    """
    keep = list(keep)
    kind = T.StructType([docs.schema[c] for c in keep]
                        + [T.StructField(c, T.LongType()) for c in ("_n_a", "_n_b", "_n_groups")]
                        + [T.StructField("_groups", T.StringType()),
                           T.StructField("_links", T.BinaryType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = vocabularies(first, second)
        width = len(both.bytes_of[1])
        for batch in batches:
            for start, part in chunks(batch.column("_text")):
                data, offsets = text_bytes(part)
                filled = np.diff(offsets) > 0
                spaced = np.insert(data, offsets[:-1][filled], 32)
                (a, a_at), (b, b_at) = both.tokens(
                    spaced, np.concatenate([[0], np.cumsum(np.diff(offsets)[filled] + 1)]))
                some = np.diff(a_at) > 0
                a_end, b_end = (np.cumsum(both.sizes[n][ids]) for n, ids in enumerate((a, b)))
                cut_a, cut_b = shared_cuts(a_end, b_end, a_at[1:][some] - 1, b_at[1:][some] - 1)
                n_a, n_b, n_groups, text_at = np.zeros((4, len(part)), np.int64)
                rows = np.flatnonzero(filled)
                n_a[rows], n_b[rows] = np.diff(a_at), np.diff(b_at)
                per_text = np.diff(np.searchsorted(cut_a, a_at))
                n_groups[rows] = per_text
                text, ends = _as_text([a, b], [cut_a, cut_b], max(map(len, both.bytes_of)))
                stops = np.concatenate([[0], ends])[a_at[1:] + b_at[1:]]
                text_at[rows] = np.diff(stops, prepend=0)
                spans = np.concatenate([[0], np.cumsum(text_at)])
                # the sign behind the last token of a text goes
                last = spans[1:][text_at > 0] - 1
                text = np.delete(text, last)
                spans = spans - np.concatenate([[0], np.cumsum(text_at > 0)])
                pair = a[cut_a].astype(np.uint64) * np.uint64(width) + b[cut_b]
                owner = np.repeat(rows, per_text).astype(np.uint64)
                pairs, times = np.unique(owner << np.uint64(32) | pair, return_counts=True)
                at = np.searchsorted(pairs >> np.uint64(32), np.arange(len(part) + 1))
                low, times = pairs.astype("<u4"), times.astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(start, len(part)) for c in keep),
                     pa.array(n_a), pa.array(n_b), pa.array(n_groups),
                     pa.LargeStringArray.from_buffers(
                         len(part), pa.py_buffer(spans), pa.py_buffer(text)).cast(pa.string()),
                     pa.array([low[i:j].tobytes() + times[i:j].tobytes()
                               for i, j in zip(at, at[1:])], pa.binary())],
                    [*keep, "_n_a", "_n_b", "_n_groups", "_groups", "_links"])

    rows = docs.select(*keep, F.col("text").alias("_text")).mapInArrow(scan, kind)
    return rows.withColumnsRenamed({f"_{c}": c for c in (
        "n_a", "n_b", "n_groups", "groups", "links")})


def _unpacked(links: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs and counts of all rows, and the n + 1 offsets of the rows in them."""
    sizes = pc.binary_length(links).to_numpy(zero_copy_only=False).astype(np.int64) // 8
    flat = np.frombuffer(b"".join(links.to_pylist()), "<u4")
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(ends[-1]) + np.repeat(ends[:-1], sizes)  # a row's counts lie behind its pairs
    return flat[at], flat[at + np.repeat(sizes, sizes)], ends


def link_counts(aligned: DataFrame) -> DataFrame:
    """pair, n: how often each pair is linked in all texts. A task sums its own first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            new, times, _ = _unpacked(batch.column("links"))
            both = np.concatenate([pairs, new.astype(np.int64)])
            pairs, at = np.unique(both, return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, times.astype(np.int64)]),
                                 len(pairs)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])

    return (aligned.select("links").mapInArrow(count, "pair long, n long")
            .groupBy("pair").agg(F.sum("n").alias("n")))


def weigh(aligned: DataFrame, counts: DataFrame, first: str = FIRST, second: str = SECOND
          ) -> DataFrame:
    """``aligned`` without links, with n_links, n_best (links whose count is the highest of
    their second token) and count_sum (of their counts).

    The counts come to the driver and go to every task: the vocabularies bound them, see above.
    """
    width = len(vocabularies(first, second).bytes_of[1])
    table = counts.orderBy("pair").toArrow()
    pair = table.column("pair").to_numpy().astype(np.int64)
    n = table.column("n").to_numpy().astype(np.int64)
    highest = np.zeros(width, np.int64)
    np.maximum.at(highest, pair % width, n)
    shared = aligned.sparkSession.sparkContext.broadcast((pair, n, n == highest[pair % width]))
    keep = [c for c in aligned.columns if c != "links"]
    added = ["n_links", "n_best", "count_sum"]
    kind = T.StructType([aligned.schema[c] for c in keep]
                        + [T.StructField(f"_{c}", T.LongType()) for c in added])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            own, times, ends = _unpacked(batch.column("links"))
            at, times = np.searchsorted(pair, own), times.astype(np.int64)
            columns = [batch.column(c) for c in keep]
            for value in (times, times * best[at], times * n[at]):
                total = np.concatenate([[0], np.cumsum(value)])[ends]
                columns.append(pa.array(np.diff(total)))
            yield pa.RecordBatch.from_arrays(columns, kind.names)

    return aligned.mapInArrow(scan, kind).withColumnsRenamed({f"_{c}": c for c in added})
