"""Canonical length-limited Huffman codes: lengths, encoding and table-driven decoding."""

import numpy as np

U64 = np.uint64


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code length of each symbol with no length above ``limit`` (package-merge)."""
    n = len(counts)
    lengths = np.zeros(n, np.int64)
    if n < 2:
        return lengths + 1
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit codes of {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, np.float64)[order]
    items, levels = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = items[:len(items) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        rank = np.argsort(both, kind="stable")
        items = both[rank]
        levels.append(rank < n)
    used, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):  # the cheapest `take` items, packages opened one level down
        chosen = int(is_leaf[:take].sum())
        used[:chosen] += 1
        take = 2 * (take - chosen)
    lengths[order] = used
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, symbol): the lengths alone define them."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    for symbol in order:
        code <<= int(lengths[symbol]) - last
        last = int(lengths[symbol])
        codes[symbol] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray, limit: int) -> np.ndarray:
    """For each string of ``limit`` bits: symbol << 8 | code length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    entry = (order.astype(np.int64) << 8) | lengths[order]
    table = np.repeat(entry, 1 << (limit - lengths[order]))
    return np.concatenate([table, np.zeros((1 << limit) - len(table), np.int64)])


def encode(symbols: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, codes: np.ndarray
           ) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(bits, n + 1 byte offsets of the rows, bit position of every symbol).

    Every row begins at a byte. ``offsets`` are the n + 1 offsets of the rows in ``symbols``.
    """
    size = lengths[symbols]
    ends = np.concatenate([[0], np.cumsum(size)])
    begin = ends[offsets[:-1]]
    n_bytes = (ends[offsets[1:]] - begin + 7) // 8
    starts = np.concatenate([[0], np.cumsum(n_bytes)])
    at = ends[:-1] + np.repeat(8 * starts[:-1] - begin, np.diff(offsets))
    out = np.zeros(int(starts[-1]) // 4 + 2, np.uint64)
    if len(symbols):
        word = at >> 5
        value = codes[symbols] << (64 - size - (at & 31)).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] += np.add.reduceat(value >> U64(32), first)
        out[word[first] + 1] += np.add.reduceat(value & U64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes()[:int(starts[-1])], starts, at


def decode(data: bytes, at: np.ndarray, sizes: np.ndarray, table: np.ndarray, limit: int
           ) -> np.ndarray:
    """Symbols of all lanes, lane after lane; a lane is a bit position and a symbol count.

    All lanes advance together, one symbol a step: a step is a few array operations.
    """
    words = np.frombuffer(data + bytes(12 - len(data) % 4), ">u4").astype(np.uint64)
    pairs = words[:-1] << U64(32) | words[1:]
    out = np.zeros(int(sizes.sum()), np.uint32)
    order = np.argsort(-sizes, kind="stable")
    at, left = at[order].astype(np.int64), sizes[order]
    to = (np.cumsum(sizes) - sizes)[order]
    mask, active = U64((1 << limit) - 1), len(at)
    for step in range(int(left[0]) if len(left) else 0):
        while left[active - 1] <= step:
            active -= 1
        here = at[:active]
        shift = (64 - limit - (here & 31)).astype(np.uint64)
        found = table[(pairs[here >> 5] >> shift & mask).astype(np.int64)]
        out[to[:active] + step] = found >> 8
        here += found & 255
    return out
