"""Personal data in texts: four fixed patterns and a skip-chain conditional random field.

Base kinds, leftmost and without overlap within a kind: ``email``, ``ip``, ``card`` and
``phone``. Beside their matches a text has candidates: other numbers of 7 to 19 digits, and
addresses with a written-out sign such as ``name (at) host.tld``. Matches and candidates of a
text are the nodes of a graph; the label of a node is a kind or none. Neighbours less than
``NEAR`` characters apart are linked by the chain. Nodes that repeat each other, however distant
and differently written (the same last seven digits, the same address), are linked from each to
the next one: they share a potential that favours equal labels. Base matches are observed; loopy
sum-product messages bring their labels to the other nodes, and a candidate whose probability of
a kind reaches ``THRESHOLD`` is a span of that kind. Edges grow with the nodes: a token that
fills a document has two links an occurrence, not all pairs.

Weights are learnt by pseudo-likelihood (each node given its neighbours) from at most
``SAMPLE_DOCS`` documents of at most ``SAMPLE_NODES`` nodes, in the order of a hash; only their
nodes come to the driver. Base matches are their own labels, and once more in another spelling
(no plus sign, dots, a written-out sign), candidates count as none. Nothing else is sampled.

Null texts count as empty: no spans. Without any node in the table nothing is learnt or added.
Every row is treated by itself, repeated rows and rows without doc_id included; other columns
are not read unless kept with ``keep``. Texts of any length are scanned in linear time.
"""

import re
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from visitseq.sources import materialize

KINDS = ["email", "ip", "card", "phone"]
SAMPLE_DOCS = 4000
SAMPLE_NODES = 100
NEAR = 200
THRESHOLD = 0.9
ROUNDS = 20
_STEPS = 150
_LABELS = len(KINDS) + 1  # 0 is none, rank + 1 a kind
_WIDTH = 11               # features of a node
_CONTEXT = 256
_SIZE = 1024

# Fixed patterns of the base kinds. Possessive where giving back cannot help; an address is
# found from its sign, see base_spans.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

NUMBER = re.compile(r"\(?[0-9](?:[ ().-]{0,2}+[0-9])++")
SIGN = re.compile(r" ?[(\[](?:at|AT)[)\]] ?")
MARKED = re.compile(r"[A-Za-z0-9-]++(?: ?(?:\.|[(\[](?:dot|DOT)[)\]]) ?[A-Za-z0-9-]++)++")

_NODE = ("array<struct<start:int,end:int,kind:int,link:long,features:array<int>,"
         "other:array<int>>>")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    odd = sum(int(c) for c in digits[-1::-2])
    return (odd + sum(2 * int(c) - 9 * (c > "4") for c in digits[-2::-2])) % 10 == 0


def _local_start(text: str, sign: int, least: int) -> int:
    start = sign
    while start > least and text[start - 1] in _LOCAL:
        start -= 1
    return start


def _addresses(text: str, signs: Iterator[tuple[int, int]], domain: re.Pattern
               ) -> Iterator[tuple[int, int]]:
    """Leftmost matches of name, sign and domain, from the places of the signs."""
    last = 0
    for sign, after in signs:
        if sign < last:
            continue
        start = _local_start(text, sign, last)
        match = start < sign and domain.match(text, after)
        if match:
            last = match.end()
            yield start, last
        else:
            last = max(last, min(sign, len(text)))  # a name cannot reach over a sign


def _at_signs(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("@")
    while at >= 0:
        yield at, at + 1
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank, end) of all base matches, sorted; failing matches are dropped."""
    out = [(start, 0, end) for start, end in _addresses(text, _at_signs(text), DOMAIN)]
    for match in IP.finditer(text):
        parts = (p.lstrip("0") for p in match.group().split("."))
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((match.start(), 1, match.end()))
    for match in CARD.finditer(text):
        if match.end() - match.start() >= 12:
            digits = _digits(match.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((match.start(), 2, match.end()))
    if "+" in text:
        for match in PHONE.finditer(text):
            if 9 <= len(_digits(match.group())) <= 15:
                out.append((match.start(), 3, match.end()))
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """Other places that may be personal data."""
    out = [(m.start(), m.end()) for m in NUMBER.finditer(text)
           if m.end() - m.start() >= 7 and 7 <= len(_digits(m.group())) <= 19]
    if any(mark in text for mark in ("(at)", "[at]", "(AT)", "[AT]")):
        out += _addresses(text, ((m.start(), m.end()) for m in SIGN.finditer(text)), MARKED)
    return out


def _word(text: str) -> int:
    letters = re.findall(r"[^\W\d_]+", text)
    return crc32(letters[-1].lower().encode()) % _CONTEXT if letters else 0


def features(token: str, before: str, after: str) -> list[int]:
    """Ids below _SIZE: a slice of them for each property of a token and its surroundings."""
    digits = _digits(token)
    parts = token.split(".")
    words = re.findall(r"[^\W\d_]+", after)
    groups = "-".join(str(len(g)) for g in re.findall("[0-9]+", token)) if digits else ""
    own = [min(len(digits), 20), 2 * ("@" in token) + bool(SIGN.search(token)),
           token.startswith("+"), token.startswith("(") + 2 * ("(" in token[1:]),
           min(token.count("."), 4), min(token.count("-") + token.count(" "), 4),
           bool(digits) and luhn(digits),
           len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) < 256 for p in parts),
           crc32(groups.encode()) % 128, _word(before)]
    begins = [0, 32, 40, 48, 56, 64, 72, 80, 128, 256]
    after_word = crc32(words[0].lower().encode()) % _CONTEXT if words else 0
    return [a + b for a, b in zip(begins, map(int, own))] + [512 + after_word]


def _other_spelling(token: str, rank: int) -> str:
    if rank == 0:
        return token.replace("@", " (at) ")
    if rank == 3:
        return token[1:]
    return re.sub("[ -]", ".", token) if rank == 2 else token


def _link(token: str) -> int:
    """Equal for tokens that say the same."""
    digits = _digits(token)
    if "@" in token or SIGN.search(token):
        plain = re.sub(r"[(\[](?:at|dot)[)\]]", "", token.lower())
        digits = "@" + re.sub(r"[^a-z0-9]", "", plain)
    else:
        digits = digits[-7:]
    return crc32(digits.encode()) << 8 | len(digits) & 255


def nodes_of(text: str) -> list[dict]:
    """All nodes in the order of the text."""
    base = base_spans(text)
    found = [(start, end, rank + 1) for start, rank, end in base]
    reach, upto = [], 0  # base spans merged to disjoint ones
    for start, _, end in base:
        upto = max(upto, end)
        reach.append((start, upto))
    begins = [b for b, _ in reach]
    for start, end in candidates(text):
        at = int(np.searchsorted(begins, end)) - 1  # the last that begins before the end
        if at < 0 or reach[at][1] <= start:
            found.append((start, end, 0))
    out = []
    for start, end, kind in sorted(found):
        token, before, after = text[start:end], text[max(0, start - 24):start], text[end:end + 24]
        own = features(token, before, after)
        other = features(_other_spelling(token, kind - 1), before, after) if kind else own
        out.append({"start": start, "end": end, "kind": kind, "link": _link(token),
                    "features": own, "other": other})
    return out


def scan(docs: DataFrame, keep=("doc_id",)) -> DataFrame:
    """``keep`` and the nodes of every text."""
    keep = list(keep)
    kind = T.StructType([docs.schema[c] for c in keep]
                        + [T.StructField("_nodes", T._parse_datatype_string(_NODE))])
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()),
                                ("link", pa.int64()), ("features", pa.list_(pa.int32())),
                                ("other", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text")
            nodes = [nodes_of(texts[i].as_py() or "") for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(nodes, arrow)], [*keep, "_nodes"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, kind)


class Graph(NamedTuple):
    """Nodes of many texts and their links, each as (from, to), first ``n_chain`` of the chain."""
    start: np.ndarray
    end: np.ndarray
    kind: np.ndarray
    features: np.ndarray
    other: np.ndarray
    text: np.ndarray
    one: np.ndarray
    two: np.ndarray
    n_chain: int


def graph(nodes: pa.Array) -> Graph:
    """From a column of node lists; a text's nodes are in order."""
    sizes = np.diff(nodes.offsets.to_numpy())
    flat = nodes.flatten()
    start, end, kind, link = (flat.field(c).to_numpy(zero_copy_only=False)
                              for c in ("start", "end", "kind", "link"))
    own, other = (flat.field(c).flatten().to_numpy(zero_copy_only=False).reshape(
        len(start), _WIDTH) for c in ("features", "other"))
    text = np.repeat(np.arange(len(sizes)), sizes)
    near = np.flatnonzero((text[1:] == text[:-1]) & (start[1:] - end[:-1] < NEAR))
    order = np.lexsort((np.arange(len(link)), link, text))
    same = (text[order][1:] == text[order][:-1]) & (link[order][1:] == link[order][:-1])
    return Graph(start, end, kind, own, other, text, np.concatenate([near, order[:-1][same]]),
                 np.concatenate([near + 1, order[1:][same]]), len(near))


class Model(NamedTuple):
    weights: np.ndarray  # feature x label
    moves: np.ndarray    # label x label, along the chain
    same: np.ndarray     # label: both ends of a skip link have it


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def fit(g: Graph, steps: int = _STEPS) -> Model:
    """Adam on the log pseudo-likelihood with a small square penalty."""
    n = len(g.kind)
    ids = np.concatenate([g.features, g.other[g.kind > 0]])
    label = np.concatenate([g.kind, g.kind[g.kind > 0]])
    target = np.eye(_LABELS)[label]
    rows = np.concatenate([np.arange(n), np.flatnonzero(g.kind > 0)])
    before, after, alike = np.zeros((3, n, _LABELS))  # labels of the neighbours of each node
    one, two = g.one[:g.n_chain], g.two[:g.n_chain]
    np.add.at(before, (two, g.kind[one]), 1)
    np.add.at(after, (one, g.kind[two]), 1)
    one, two = g.one[g.n_chain:], g.two[g.n_chain:]
    np.add.at(alike, (two, g.kind[one]), 1)
    np.add.at(alike, (one, g.kind[two]), 1)
    before, after, alike = before[rows], after[rows], alike[rows]
    weights, moves, same = (np.zeros((_SIZE, _LABELS)), np.zeros((_LABELS, _LABELS)),
                            np.zeros(_LABELS))
    theta = [weights, moves, same]
    first, second = ([np.zeros_like(t) for t in theta] for _ in range(2))
    for step in range(1, steps + 1):
        weights, moves, same = theta
        p = _softmax(weights[ids].sum(1) + before @ moves + after @ moves.T + alike * same)
        off = (target - p) / max(1, len(label))
        slope = np.stack([np.bincount(ids.ravel(), np.repeat(off[:, k], ids.shape[1]), _SIZE)
                          for k in range(_LABELS)], 1)
        slopes = [slope, before.T @ off + off.T @ after, (alike * off).sum(0)]
        for i, s in enumerate(slopes):
            s = s - 1e-4 * theta[i]
            first[i] = 0.9 * first[i] + 0.1 * s
            second[i] = 0.99 * second[i] + 0.01 * s * s
            theta[i] = theta[i] + 0.1 * (first[i] / (1 - 0.9 ** step)) / (
                np.sqrt(second[i] / (1 - 0.99 ** step)) + 1e-8)
    return Model(*theta)


def marginals(unary: np.ndarray, one: np.ndarray, two: np.ndarray, potential: np.ndarray,
              rounds: int = ROUNDS) -> np.ndarray:
    """Loopy sum-product: node x label probabilities. ``potential`` (link x label x label) and
    ``unary`` are logarithms. Exact after enough rounds where the links make no circle."""
    source, target = np.concatenate([one, two]), np.concatenate([two, one])
    back = np.concatenate([np.arange(len(one)) + len(one), np.arange(len(one))])
    both = np.concatenate([potential, potential.transpose(0, 2, 1)])
    message = np.zeros((len(source), unary.shape[1]))

    def belief():
        total = unary.copy()
        for k in range(unary.shape[1]):
            total[:, k] += np.bincount(target, message[:, k], len(unary))
        return total

    for _ in range(rounds):
        out = (belief()[source] - message[back])[:, :, None] + both
        top = out.max(1)
        new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
        new -= new.max(1, keepdims=True)
        message = 0.5 * message + 0.5 * new
    return _softmax(belief())


def infer(g: Graph, model: Model) -> np.ndarray:
    """Label probabilities of every node; base matches are observed."""
    unary = model.weights[g.features].sum(1)
    seen = np.flatnonzero(g.kind > 0)
    unary[seen] = -50.0
    unary[seen, g.kind[seen]] = 0.0
    potential = np.empty((len(g.one), _LABELS, _LABELS))
    potential[:g.n_chain] = model.moves
    potential[g.n_chain:] = np.diag(model.same)
    return marginals(unary, g.one, g.two, potential)


def learn(scanned: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_nodes: int = SAMPLE_NODES
          ) -> Model:
    """The weights from a bounded sample of a written ``scan``, see above."""
    sample = (scanned.where(F.size("_nodes").between(1, sample_nodes))
              .select("_nodes").orderBy(F.xxhash64("_nodes", F.lit(7)), F.size("_nodes"))
              .limit(sample_docs).toArrow())
    nodes = sample.column("_nodes").combine_chunks()
    if isinstance(nodes, pa.ChunkedArray):
        nodes = pa.concat_arrays(nodes.chunks) if nodes.num_chunks else pa.array([], nodes.type)
    return fit(graph(nodes))


def label(scanned: DataFrame, model: Model, keep=("doc_id",), threshold: float = THRESHOLD
          ) -> DataFrame:
    """``keep`` and spans: array<struct<start, rank, end, base>>, sorted."""
    keep = list(keep)
    span = T._parse_datatype_string("array<struct<start:int,rank:int,end:int,base:boolean>>")
    kind = T.StructType([scanned.schema[c] for c in keep] + [T.StructField("spans", span)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = graph(batch.column("_nodes"))
            chance = infer(g, model)
            best = chance[:, 1:].argmax(1)
            rank = np.where(g.kind > 0, g.kind - 1, best)
            taken = (g.kind > 0) | (chance[np.arange(len(best)), best + 1] >= threshold)
            at = np.flatnonzero(taken)
            at = at[np.lexsort((rank[at], g.start[at], g.text[at]))]
            ends = np.searchsorted(g.text[at], np.arange(len(batch) + 1))
            spans = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(g.start[at], pa.int32()), pa.array(rank[at], pa.int32()),
                 pa.array(g.end[at], pa.int32()), pa.array(g.kind[at] > 0)],
                ["start", "rank", "end", "base"]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), spans],
                                             [*keep, "spans"])

    return scanned.mapInArrow(run, kind)


def find_personal(docs: DataFrame, keep=("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` and spans of personal data of every text: array<struct<start, rank, end, base>>.

    ``rank`` is the place in ``KINDS``. Positions are code points, the end exclusive.
    """
    scanned = materialize(scan(docs, keep), "personal")
    return label(scanned, learn(scanned), keep, threshold)


def as_text(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ",")
