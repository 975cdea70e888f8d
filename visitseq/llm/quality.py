"""Document quality from lines: a linear-chain conditional random field over good and bad lines.

Every line of a text has features of its own, of the line before and of the line after (shares
of letters, digits, signs and so on, repetition of words; see ``FEATURES``). The field has one
weight a feature and four transition weights; forward-backward gives each line's probability
to be good. The mean of these, weighted by line length, goes through a logistic curve fitted on
labelled documents: the score.

Labels belong to documents, not lines. Lines of good documents count as good; lines of bad ones
start as bad and are relabelled by the field between rounds of training, the worst line always
staying bad.

Training reads at most ``SAMPLE_DOCS`` labelled documents with at most ``SAMPLE_LINES`` lines in
all, in the order of a hash of doc_id; a single document with more than one in ``SAMPLE_SHARE``
of these lines is left out of the sample. Only features reach the driver. Scoring covers all
rows and whole texts: forward-backward is a prefix product of 2 x 2 matrices over all lines of
a chunk, in which the first line of a text cuts off what was before it.

Null and empty texts are one empty line. Without labels of both classes the score is the share
of good ones (0.5 without any). Repeated rows and rows without doc_id are scored like others;
columns other than doc_id and text are not read.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from visitseq.llm.textbytes import chunks, text_bytes, words

SAMPLE_DOCS = 4000
SAMPLE_LINES = 200_000
SAMPLE_SHARE = 20
ROUNDS = 3
STEPS = 120
FEATURES = ["length", "letters", "capitals", "digits", "spaces", "signs", "beyond_ascii",
            "repeated_signs", "n_words", "word_length", "distinct_words", "same_as_last",
            "signs_per_word", "ends_sentence", "starts_capital", "empty"]

_LETTER, _CAPITAL, _DIGIT, _SPACE, _SIGN, _HIGH, _STOP = (np.zeros(256, bool) for _ in range(7))
_CAPITAL[65:91] = _LETTER[65:91] = _LETTER[97:123] = _HIGH[128:] = _DIGIT[48:58] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SIGN[33:127] = ~(_LETTER | _DIGIT)[33:127]
_STOP[list(b".!?:;\"")] = True


class Model(NamedTuple):
    weights: np.ndarray  # of the features, then of their neighbours, then a constant
    moves: np.ndarray    # 2 x 2: from bad or good to bad or good
    slope: float
    shift: float
    share: float | None  # the score of every document if there was nothing to learn


def line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, and the number of lines of each text (at least one)."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, offsets[1:]]))
    inside = np.searchsorted(breaks, offsets)
    return starts, ends, np.diff(inside) + 1


def own_features(part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, lines of each text, bytes of every line)."""
    data, offsets = text_bytes(part)
    starts, ends, lines = line_bounds(data, offsets)
    size = ends - starts

    def count(member):
        total = np.concatenate([[0], np.cumsum(member, dtype=np.int32)])
        return total[ends] - total[starts]

    letters, signs = count(_LETTER[data] | _HIGH[data]), _SIGN[data]
    again = signs.copy()
    again[1:] &= data[1:] == data[:-1]
    again[:1] = False
    opens = signs.copy()
    opens[1:] &= ~signs[:-1]
    found = words(part)
    line = np.searchsorted(starts, found.start, "right") - 1
    n_words = np.bincount(line, minlength=len(starts))
    word_bytes = np.bincount(line, found.end - found.start, len(starts))
    keyed = found.hash + line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    distinct = np.bincount(line[np.unique(keyed, return_index=True)[1]], minlength=len(starts))
    same = np.zeros(len(line), bool)
    same[1:] = (line[1:] == line[:-1]) & (found.hash[1:] == found.hash[:-1])
    last = data[np.maximum(ends - 1, 0)] if len(data) else np.zeros(len(ends), np.uint8)
    first = data[np.minimum(starts, len(data) - 1)] if len(data) else last
    some, any_word = np.maximum(size, 1), np.maximum(n_words, 1)
    table = np.stack([
        np.log1p(size) / 8, letters / some, np.sqrt(count(_CAPITAL[data]) / np.maximum(letters, 1)),
        np.sqrt(count(_DIGIT[data]) / some), count(_SPACE[data]) / some,
        np.sqrt(count(signs) / some), count(_HIGH[data]) / some, np.sqrt(count(again) / some),
        np.log1p(n_words) / 5, np.log1p(word_bytes / any_word) / 3, distinct / any_word,
        np.bincount(line, same, len(starts)) / any_word,
        np.sqrt(np.minimum(count(opens) / any_word, 2)), (size > 0) & _STOP[last],
        (size > 0) & _CAPITAL[first], size == 0], 1)
    return table.astype(np.float32), lines, size


def with_neighbours(own: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zeros beyond the text), a constant."""
    ends = np.cumsum(lines)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[ends - lines] = 0
    after[ends - 1] = 0
    return np.concatenate([own, before, after, np.ones((len(own), 1), np.float32)], 1)


def _products(steps: np.ndarray, reach: int) -> np.ndarray:
    """Product of each matrix with the ``reach`` or more before it, scaled to a largest entry 1.

    ``steps`` is 2 x 2 x n: entries apart, so that a product is a few long vector operations.
    """
    total, stride = steps, 1
    while stride < reach:
        (a, b), (c, d) = total[:, :, :-stride]
        (e, f), (g, h) = total[:, :, stride:]
        new = np.array([[a * e + b * g, a * f + b * h], [c * e + d * g, c * f + d * h]])
        new /= new.max((0, 1))
        total = np.concatenate([total[:, :, :stride], new], 2)
        stride *= 2
    return total


def marginals(good: np.ndarray, moves: np.ndarray, lines: np.ndarray
              ) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line and the joint 2 x 2 (x n) probabilities with the line before.

    ``good`` are the lines' scores for good against bad. A text's first line has a matrix with
    equal rows: whatever stands before it cancels out, so texts need no separate treatment.
    """
    starts = np.cumsum(lines) - lines
    steps = np.empty((2, 2, len(good)))
    steps[:] = np.exp(moves - moves.max())[:, :, None]
    steps[:, :, starts] = 1
    steps *= np.exp(np.minimum([-good, good], 0))
    reach = int(lines.max(initial=1))
    forward = _products(steps, reach)[0]
    forward /= forward.sum(0)
    turned = steps[:, :, ::-1].transpose(1, 0, 2)
    suffix = _products(turned, reach)[:, :, ::-1].transpose(1, 0, 2)  # a line and all after it
    backward = np.ones((2, len(good)))
    backward[:, :-1] = suffix[:, :, 1:].sum(1)
    backward[:, starts[1:] - 1] = 1
    backward /= backward.sum(0)
    both = forward * backward
    both /= both.sum(0)
    joint = np.zeros_like(steps)
    joint[:, :, 1:] = forward[:, None, :-1] * steps[:, :, 1:] * backward[None, :, 1:]
    joint[:, :, starts] = 0
    joint /= np.maximum(joint.sum((0, 1)), 1e-300)
    return both[1], joint


def _train(x: np.ndarray, lines: np.ndarray, y: np.ndarray, weights: np.ndarray,
           moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adam on the mean log-likelihood of line labels ``y`` with a small square penalty."""
    starts = np.zeros(len(x), bool)
    starts[np.cumsum(lines) - lines] = True
    inner = np.flatnonzero(~starts)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner - 1], y[inner]), 1)
    theta = np.concatenate([weights, moves.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        good, joint = marginals(x @ theta[:-4], theta[-4:].reshape(2, 2), lines)
        slope = np.concatenate([x.T @ (y - good), (seen - joint.sum(2)).ravel()]) / len(x)
        slope -= 1e-4 * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope ** 2
        theta = theta + 0.2 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def _weighted(good: np.ndarray, lines: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Mean of P(good) over a text's lines by their length; a line break counts, too."""
    begin = np.cumsum(lines) - lines
    weight = size + 1.0
    return np.add.reduceat(good * weight, begin) / np.add.reduceat(weight, begin)


def fit(own: np.ndarray, lines: np.ndarray, size: np.ndarray, label: np.ndarray) -> Model:
    """The field and the curve from labelled documents."""
    width = 3 * len(FEATURES) + 1
    if not len(label) or label.min() == label.max():
        share = float(label.mean()) if len(label) else 0.5
        return Model(np.zeros(width), np.zeros((2, 2)), 0.0, 0.0, share)
    x = with_neighbours(own, lines).astype(np.float64)
    owner = np.repeat(np.arange(len(lines)), lines)
    y = label[owner]
    weights, moves = np.zeros(width), np.zeros((2, 2))
    for _ in range(ROUNDS):
        weights, moves = _train(x, lines, y, weights, moves)
        good, _ = marginals(x @ weights, moves, lines)
        y = np.where(label[owner] == 1, 1, (good > 0.5).astype(int))
        worst = np.lexsort((good, owner))[np.cumsum(lines) - lines]
        y[worst[label == 0]] = 0
    mean = _weighted(marginals(x @ weights, moves, lines)[0], lines, size)
    slope, shift = 1.0, 0.0
    for _ in range(200):  # logistic regression on one variable, both classes with equal weight
        p = 1 / (1 + np.exp(-(slope * mean + shift)))
        each = np.where(label == 1, 0.5 / label.sum(), 0.5 / (1 - label).sum())
        bend = each * p * (1 - p) + 1e-12
        grad = np.array([(each * (label - p) * mean).sum() - 1e-3 * slope, (each * (label - p)).sum()])
        curve = np.array([[(bend * mean * mean).sum() + 1e-3, (bend * mean).sum()],
                          [(bend * mean).sum(), bend.sum()]])
        move = np.linalg.solve(curve, grad)
        slope, shift = slope + move[0], shift + move[1]
        if np.abs(move).max() < 1e-9:
            break
    return Model(weights, moves, float(slope), float(shift), None)


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS,
          sample_lines: int = SAMPLE_LINES) -> Model:
    """Fit on labelled documents (labels: doc_id, quality); the sample is bounded, see above."""
    chosen = (labels.filter("doc_id is not null and quality in (0, 1)")
              .join(docs.select("doc_id"), "doc_id", "left_semi")
              .select("doc_id", F.col("quality").cast("int").alias("_quality"),
                      F.xxhash64("doc_id", F.lit(7)).alias("_order"))
              .orderBy("_order", "doc_id", "_quality").limit(sample_docs))
    most = max(1, sample_lines // SAMPLE_SHARE)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in chunks(batch.column("text")):
                own, lines, size = own_features(part)
                ends = np.concatenate([[0], np.cumsum(lines)])
                short = np.flatnonzero(lines <= most)
                rows = pa.array(first + short)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_quality").take(rows), batch.column("_order").take(rows),
                     pa.array(lines[short], pa.int64()),
                     pa.array([own[ends[i]:ends[i + 1]].tobytes() for i in short], pa.binary()),
                     pa.array([size[ends[i]:ends[i + 1]].astype("<i8").tobytes() for i in short],
                              pa.binary())], ["quality", "order", "lines", "own", "size"])

    featured = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # sample_docs rows
                .select("text", "_quality", "_order")
                .mapInArrow(scan, "quality int, order long, lines long, own binary, size binary")
                .orderBy("order", "own", "quality").limit(sample_docs))
    so_far = F.sum("lines").over(Window.orderBy("order", "own", "quality"))  # sample_docs rows
    rows = featured.withColumn("sum", so_far).filter(F.col("sum") <= sample_lines).collect()
    own = np.frombuffer(b"".join(r["own"] for r in rows), np.float32).reshape(-1, len(FEATURES))
    size = np.frombuffer(b"".join(r["size"] for r in rows), "<i8")
    return fit(own, np.array([r["lines"] for r in rows], np.int64), size,
               np.array([r["quality"] for r in rows], np.int64))


def score(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """``key``, score, good (probability of each line to be good): one row a row of ``docs``.

    ``key`` is a column to carry along: an id, or a struct of whole rows.
    """
    kind = T.StructType([docs.schema[key], T.StructField("score", T.DoubleType()),
                         T.StructField("good", T.ArrayType(T.FloatType()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in chunks(batch.column("_text")):
                own, lines, size = own_features(part)
                good, _ = marginals(with_neighbours(own, lines) @ model.weights, model.moves, lines)
                value = 1 / (1 + np.exp(-(model.slope * _weighted(good, lines, size) + model.shift)))
                if model.share is not None:
                    value = np.full(len(part), model.share)
                ends = np.concatenate([[0], np.cumsum(lines)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).slice(first, len(part)), pa.array(value),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                              pa.array(good.astype(np.float32)))],
                    [key, "score", "good"])
    return docs.select(key, F.col("text").alias("_text")).mapInArrow(scan, kind)


def held_out(column: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % 5 == 0
