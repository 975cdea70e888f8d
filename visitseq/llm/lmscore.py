"""Masked pseudo-likelihood of documents under a bidirectional window network, in numpy.

Every word is predicted from the ``WINDOW`` words before and after it. The network embeds them,
weighs each place, and gives probabilities of word classes; within its class a word has its
share of the corpus count (class-factored softmax, so that no step touches the whole
vocabulary). The score of a document is the sum of the conditional log-probabilities.

Learning covers the whole corpus. Counts of all words fix the vocabulary, the classes (about
equal shares of the corpus) and the share of every word in its class, which is its count by that
of the class. A word is in the vocabulary, with an embedding of its own, if it was seen
``often_enough``: the square root of the words of the corpus by ``OFTEN``, so the vocabulary
grows with the corpus but slower than it. The others, the tail, have their class and their
embedding by hash, with as many places as the vocabulary has words. Their counts stay a table:
scoring joins the tail words of the texts with it. A word that was not counted is taken for one
seen once. With ``size`` given, the vocabulary is that many words, and the others share one
class, each type with equal probability. Then, ``ROUNDS`` times, every task
trains a copy of the network on its part of that round's documents (a hash of the text picks
the round, so every word is learnt from once), and the copies are averaged: one row for a word's
parameters and task, summed by Spark, weighted by the words the parameter has seen. Only averaged
parameters reach the driver; their number does not depend on the data.

Words are those of ``textbytes.words``. Null texts and texts without words have n_tokens 0,
log_prob 0 and mean null. Every row is scored; rows without doc_id and repeated rows as well.
Other columns are not read.
"""

from collections.abc import Iterator
from math import ceil, sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from visitseq.llm.textbytes import chunks, words
from visitseq.sources import materialize, scratch_path

OFTEN = 32
CLASSES = 64
WIDTH = 16
WINDOW = 2
ROUNDS = 2
BATCH = 2048
RATE = 0.1
_PLACES = [*range(-WINDOW, 0), *range(1, WINDOW + 1)]
_HELD = 1 << 19


class Vocabulary(NamedTuple):
    hashes: np.ndarray   # sorted
    ids: np.ndarray      # by sorted hash; ids count down with the frequency
    classes: np.ndarray  # of every id, the last ``places`` being those of other words
    shares: np.ndarray   # log of the share in its class; for other words that of a count of 1
    places: int = 1
    tail: str | None = None  # table (hash, n) of other words seen more than once

    @property
    def size(self) -> int:
        return len(self.classes)


class Network:
    """Views on one flat vector of parameters."""

    def __init__(self, size: int, flat: np.ndarray | None = None):
        shapes = [(size + 1, WIDTH), (len(_PLACES), WIDTH), (WIDTH,), (WIDTH, CLASSES), (CLASSES,)]
        ends = np.cumsum([0, *(int(np.prod(s)) for s in shapes)])
        if flat is None:
            flat = np.random.default_rng(1).normal(0, 0.1, ends[-1])
            flat[ends[1]:ends[2]] = 1
        self.flat = np.array(flat, np.float32)
        self.embed, self.places, self.lift, self.out, self.bias = (
            self.flat[a:b].reshape(s) for a, b, s in zip(ends[:-1], ends[1:], shapes))

    def _shares(self, around: np.ndarray):
        """(embedded neighbours, hidden values, class scores, their exponentials and sums)."""
        x = self.embed.take(around, 0)
        hidden = np.tanh((x * self.places).sum(1) + self.lift)
        z = hidden @ self.out + self.bias
        z -= z.max(1, keepdims=True)
        e = np.exp(z)
        return x, hidden, z, e, e.sum(1, keepdims=True)

    def forward(self, around: np.ndarray):
        """(embedded neighbours, hidden values, class log-probabilities)."""
        x, hidden, z, _, total = self._shares(around)
        return x, hidden, z - np.log(total)

    def log_prob(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each row's target class."""
        *_, z, _, total = self._shares(around)
        return z[np.arange(len(target)), target] - np.log(total[:, 0])

    def gradient(self, around: np.ndarray, target: np.ndarray):
        """Mean gradient of the log-likelihood: (rows of embed, their part), then the others."""
        x, hidden, _, dz, total = self._shares(around)
        dz /= total * -len(target)
        dz[np.arange(len(target)), target] += np.float32(1 / len(target))
        da = (dz @ self.out.T) * (1 - hidden * hidden)
        dx = (da[:, None, :] * self.places).reshape(-1, WIDTH)
        # word and place in one number: sorting plain numbers is much faster than argsort
        bits = around.size.bit_length()
        both = np.sort((around.ravel().astype(np.int64) << bits) | np.arange(around.size))
        flat = both >> bits
        first = np.flatnonzero(np.diff(flat, prepend=-1))
        return (flat[first], np.add.reduceat(dx.take(both & ((1 << bits) - 1), 0), first),
                (x * da[:, None, :]).sum(0), da.sum(0), hidden.T @ dz, dz.sum(0))


def often_enough(total: int) -> int:
    """The count from which a word of a corpus of ``total`` words is in the vocabulary."""
    return max(1, ceil(sqrt(total) / OFTEN))


def _tail(counts: DataFrame, known: int, mass: float) -> tuple[np.ndarray, np.ndarray, str]:
    """Class and log share (of a count of 1) of every place of the tail, and its table."""
    n_classes = int(np.clip(round(CLASSES * mass), 1, CLASSES // 2))
    places = max(known, n_classes)
    own = np.arange(places) % n_classes
    of = F.shiftrightunsigned("hash", 1) % F.lit(places) % F.lit(n_classes)
    sums = np.ones(n_classes)
    for row in counts.groupBy(of.alias("class")).agg(F.sum("n").alias("n")).collect():
        sums[row["class"]] = row["n"]  # a row a class
    path = scratch_path(counts.sparkSession, "tail")
    materialize(counts.filter("n > 1"), path=path)
    return CLASSES - 1 - own, -np.log(sums[own]), path


def vocabulary(docs: DataFrame, size: int | None = None) -> Vocabulary:
    """Counts of every word of the corpus, and what follows from them."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def merged():
            value, back = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            return value, np.bincount(back, np.concatenate([c for _, c in held])).astype(np.int64)

        def rows(value, count):
            return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(count)],
                                              ["hash", "n"])

        for batch in batches:
            for _, part in chunks(batch.column("text")):
                held.append(np.unique(words(part).hash, return_counts=True))
                n += len(held[-1][0])
                if n > _HELD:
                    held = [merged()]
                    n = len(held[0][0])
                    if 2 * n > _HELD:
                        yield rows(*held.pop())
                        n = 0
        if held:
            yield rows(*merged())

    counts = materialize(docs.select("text").mapInArrow(scan, "hash long, n long")
                         .groupBy("hash").agg(F.sum("n").alias("n")), "words")
    types, total = counts.agg(F.count("*"), F.sum("n")).head()
    if size is None:
        often = often_enough(total or 0)
        top = counts.filter(F.col("n") >= often).toArrow()  # the vocabulary
    else:
        top = counts.orderBy(F.desc("n"), "hash").limit(size).toArrow()
    top = top.sort_by([("n", "descending"), ("hash", "ascending")])
    n = top["n"].to_numpy().astype(np.float64)
    share = n / max(total or 0, 1)
    if size is None and len(n) < types:
        rest, once, path = _tail(counts.filter(F.col("n") < often), len(n), 1 - share.sum())
    else:
        rest, path = np.array([CLASSES - 1]), None
        once = np.array([-np.log(max(types - len(n), 1))])
    own = int(rest.min())  # classes of the vocabulary
    classes = np.minimum((own * (np.cumsum(share) - share) / max(share.sum(), 1e-12)
                          ).astype(np.int64), own - 1)
    within = np.log(n / np.bincount(classes, n, CLASSES)[classes]) if len(n) else n
    hashes = top["hash"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], order, np.append(classes, rest), np.append(within, once),
                      len(rest), path)


def coded(part: pa.Array, known: Vocabulary
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all words, row of each, ids of the words around it or the edge's, hashes)."""
    found = words(part)
    edge = known.size
    other = ((found.hash >> np.uint64(1)) % np.uint64(known.places)).astype(np.int64)
    ids = other + len(known.hashes)
    if len(known.hashes):
        at = np.minimum(np.searchsorted(known.hashes, found.hash), len(known.hashes) - 1)
        ids = np.where(known.hashes[at] == found.hash, known.ids[at], ids)
    n = len(ids)
    around = np.full((n, len(_PLACES)), edge)
    for i, step in enumerate(_PLACES):
        to = slice(max(0, -step), n - max(0, step))
        of = slice(max(0, step), n - max(0, -step))
        near = found.row[to] == found.row[of]
        around[to, i] = np.where(near, ids[of], edge)
    return ids, found.row, around, found.hash


def train(batches: Iterator[pa.RecordBatch], known: Vocabulary, start: np.ndarray, size: int
          ) -> Iterator[pa.RecordBatch]:
    """index, value, weight: a copy trained on the task's texts, WIDTH parameters a row, which
    share their weight; only parameters it moved."""
    net = Network(known.size, start)
    scale = Network(known.size, np.full(len(net.flat), 1e-6))  # sums of squared gradients
    seen = np.zeros(known.size + 1)
    total = 0

    def rise(value, square, slope):
        square += slope * slope
        value += RATE * slope / np.sqrt(square)

    for batch in batches:
        for _, part in chunks(batch.column("text")):
            ids, _, around, _ = coded(part, known)
            target = known.classes[ids]
            order = np.random.default_rng(len(ids)).permutation(len(ids))
            for a in range(0, len(ids), size):
                pick = order[a:a + size]
                rows, embed, *others = net.gradient(around[pick], target[pick])
                square = scale.embed[rows] + embed * embed
                scale.embed[rows] = square
                net.embed[rows] += RATE * embed / np.sqrt(square)
                for name, slope in zip(("places", "lift", "out", "bias"), others):
                    rise(getattr(net, name), getattr(scale, name), slope)
            seen += np.bincount(around.ravel(), minlength=len(seen))
            total += len(ids)
    value = net.flat.reshape(-1, WIDTH)
    weight = np.full(len(value), float(total))
    weight[:len(seen)] = seen
    index = np.flatnonzero(weight)
    for a in range(0, len(index), 1 << 12):
        own = index[a:a + (1 << 12)]
        ends = pa.array(np.arange(len(own) + 1) * WIDTH, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(own, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(value[own].ravel())),
             pa.array(weight[own])], ["index", "value", "weight"])


def learn(docs: DataFrame, size: int | None = None, batch: int = BATCH
          ) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary and the averaged parameters."""
    spark = docs.sparkSession
    known = vocabulary(docs, size)
    flat = Network(known.size).flat
    for turn in range(ROUNDS):
        given = spark.sparkContext.broadcast((known, flat))
        own = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == turn)
        # floats are dealt, and summed where a parameter's copies meet
        copies = own.mapInArrow(lambda batches: train(batches, *given.value, batch),
                                "index int, value array<float>, weight double").repartition("index")
        sums = [(F.sum(F.get("value", F.lit(i)) * F.col("weight")) / F.sum("weight"))
                .cast("float").alias(f"v{i}") for i in range(WIDTH)]
        moved = copies.groupBy("index").agg(*sums).toArrow()
        flat = flat.copy()  # one row for WIDTH parameters reached the driver
        flat.reshape(-1, WIDTH)[moved["index"].to_numpy()] = np.stack(
            [moved[f"v{i}"].to_numpy() for i in range(WIDTH)], 1)
    return known, flat


def log_probs(net: Network, known: Vocabulary, ids: np.ndarray, around: np.ndarray) -> np.ndarray:
    """log P(word | words around it) of every word."""
    out = np.zeros(len(ids))
    for a in range(0, len(ids), BATCH):
        own = slice(a, a + BATCH)
        out[own] = net.log_prob(around[own], known.classes[ids[own]])
    return out + known.shares[ids]


def score(docs: DataFrame, known: Vocabulary, flat: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, log_prob, mean: one row a row of ``docs``."""
    dtype = docs.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    given = spark.sparkContext.broadcast((known, flat))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, values = given.value
        net = Network(vocabulary.size, values)
        for batch in batches:
            for first, part in chunks(batch.column("text")):
                ids, row, around, word = coded(part, vocabulary)
                n = np.bincount(row, minlength=len(part))
                total = np.bincount(row, log_probs(net, vocabulary, ids, around), len(part))
                columns = [batch.column("doc_id").slice(first, len(part)), pa.array(n, pa.int64()),
                           pa.array(total)]
                if vocabulary.tail is not None:
                    other = ids >= len(vocabulary.hashes)
                    ends = np.cumsum(np.bincount(row[other], minlength=len(part)))
                    columns.append(pa.ListArray.from_arrays(
                        pa.array(np.append(0, ends), pa.int32()), word[other].view(np.int64)))
                yield pa.RecordBatch.from_arrays(columns, names[:len(columns)])

    names = ["doc_id", "n_tokens", "log_prob", "tail"]
    fields = f"doc_id {dtype}, n_tokens long, log_prob double"
    read = docs.select("doc_id", "text")
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean")
    if known.tail is None:
        return read.mapInArrow(scan, fields).select("*", mean)
    scored = read.mapInArrow(scan, f"{fields}, tail array<long>")
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    counts = spark.read.schema("hash long, n long").parquet(known.tail)
    # a count of 1 is in log_prob already
    more = (scored.select("row", F.explode("tail").alias("hash")).join(counts, "hash")
            .groupBy("row").agg(F.sum(F.log("n")).alias("more")))
    total = (F.col("log_prob") + F.coalesce("more", F.lit(0.0))).alias("log_prob")
    return (scored.select("row", "doc_id", "n_tokens", "log_prob").join(more, "row", "left")
            .select("doc_id", "n_tokens", total).select("*", mean))
