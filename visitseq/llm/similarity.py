"""N-gram Jaccard join by chosen paths.

Texts are sets of word 5-grams (a text of one to four words is one gram). Two texts are linked
when the Jaccard similarity of their sets is at least ``threshold``.

1. Texts with the same words in the same order form a class; one row of each goes on.
2. A run sends every class down a random path: the node it is in draws one of ``COORDS``
   min-hashes, that is a sampled gram of the set, and classes that share it share the child
   node. Nodes of at most ``small`` classes are left to comparison, larger ones are split
   further, ``DEPTH`` times at most. A linked pair stays together with probability J a step, so
   ``runs_for(recall)`` runs find it with probability ``recall`` even if all its nodes are
   large; in small nodes one step is enough and the recall higher.
3. Inside a node, pairs are first compared by 128 one-byte min-hashes. The bound lies 4.5
   standard deviations below the threshold. A pair that met in an earlier run is skipped, so
   every pair has one node that counts it.
4. Texts of the classes that have such a pair are read again and the pairs verified exactly.

No pair ever becomes a row: a node gives each of its classes the number of links found in it
and the smallest class it hangs together with. Nodes that stay large are cut into blocks, and
every pair of blocks is a group of its own: a group holds at most 2 * ``BLOCK`` classes.

Nulls count as empty texts; texts without words are alike if their bytes are, and link to
nothing else. Rows are numbered and written once, so doc_id may be repeated or null: only the
output has it, and class_id is null where no text of a group has one. Other columns are not read.
"""

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from visitseq.llm.components import components
from visitseq.llm.textbytes import Words, chunks, grams, mix, text_bytes, words
from visitseq.sources import drop_table, materialize, recording, scratch_path

GRAM = 5
THRESHOLD = 0.8
COORDS = 128
DEPTH = 4
SMALL = 64
BLOCK = 512
RECALL = 0.999
_PAIRS = 1 << 17

_RANDOM = np.random.default_rng(20180614)
_XOR = _RANDOM.integers(0, 1 << 63, COORDS, dtype=np.uint64)
_ODD = _RANDOM.integers(0, 1 << 63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)


def runs_for(recall: float, threshold: float = THRESHOLD) -> int:
    """Runs after which a pair at the threshold was together in the deepest node once."""
    return ceil(log(1 - recall) / log(1 - threshold ** DEPTH))


def gram_hashes(found: Words, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams, row after row, and the n + 1 offsets of the rows."""
    count = np.bincount(found.row, minlength=n_rows)
    value, whole = grams(found.hash, found.row, GRAM)
    value, row = value[whole], found.row[:len(whole)][whole]
    short = np.flatnonzero((count > 0) & (count < GRAM))
    if len(short):
        begin = np.cumsum(count) - count
        extra = [int(mix(np.cumsum(found.hash[begin[r]:begin[r] + count[r]] * np.arange(
            1, count[r] + 1, dtype=np.uint64), dtype=np.uint64)[-1:])[0]) for r in short]
        value = np.concatenate([value, np.array(extra, np.uint64)])
        row = np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        value, row = value[order], row[order]
    return value, np.searchsorted(row, np.arange(n_rows + 1))


def sequence_hashes(found: Words, part: pa.Array) -> list[np.ndarray]:
    """128 bits of each row's words in their order; of its bytes where it has no word."""
    n = len(part)
    count = np.bincount(found.row, minlength=n)
    begin = np.cumsum(count) - count
    place = (np.arange(len(found.row)) - begin[found.row]).astype(np.uint64)
    out = []
    for base in _BASES:
        term = mix(found.hash ^ (mix(place + np.uint64(1)) * np.uint64(base)))
        ends = np.concatenate([[np.uint64(0)], np.cumsum(term, dtype=np.uint64)])
        out.append(mix(ends[begin + count] - ends[begin] + count.astype(np.uint64)))
    if (count == 0).any():
        data, offsets = text_bytes(part)
        for row in np.flatnonzero(count == 0):
            digest = blake2b(data[offsets[row]:offsets[row + 1]].tobytes(), digest_size=16).digest()
            out[0][row], out[1][row] = np.frombuffer(digest, "<u8")
    return [x.view(np.int64) for x in out]


def signatures(rows: DataFrame) -> DataFrame:
    """number, doc_id, h1, h2 (same words, same hashes) and COORDS min-hashes (null without words)."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in chunks(batch.column("text")):
                found = words(part)
                h1, h2 = sequence_hashes(found, part)
                value, offsets = gram_hashes(found, len(part))
                some = np.flatnonzero(np.diff(offsets))
                mins = np.zeros((COORDS, len(part)), np.uint32)
                if len(some):
                    for i in range(COORDS):
                        low = np.minimum.reduceat((value ^ _XOR[i]) * _ODD[i], offsets[some])
                        mins[i, some] = mix(low) >> np.uint64(32)
                empty = np.diff(offsets) == 0
                rows = np.ascontiguousarray(mins.T).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("number").slice(first, len(part)),
                     batch.column("doc_id").slice(first, len(part)), pa.array(h1), pa.array(h2),
                     pa.array([None if e else r.tobytes() for e, r in zip(empty, rows)],
                              pa.binary())], ["number", "doc_id", "h1", "h2", "mins"])
    return rows.select("number", "doc_id", "text").mapInArrow(
        scan, "number long, doc_id long, h1 long, h2 long, mins binary")


def _matrix(column: pa.Array, width: int, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


def paths(nodes: DataFrame, runs: int) -> DataFrame:
    """node, run, p1 .. pDEPTH: the tree nodes a class visits in each run."""
    names = [f"p{d}" for d in range(1, DEPTH + 1)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mins = _matrix(batch.column("mins"), COORDS, "<u4").astype(np.uint64)
            every = np.arange(len(mins))
            for run in range(runs):
                here = np.full(len(mins), mix(np.array([run + 1], np.uint64))[0])
                steps = []
                for _ in range(DEPTH):
                    coord = (here % np.uint64(COORDS)).astype(np.int64)
                    here = mix(here ^ mix(mins[every, coord] + (here << np.uint64(32))))
                    steps.append(pa.array(here.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), pa.array(np.full(len(mins), run, np.int32)), *steps],
                    ["node", "run", *names])
    return nodes.select("node", "mins").mapInArrow(
        scan, "node long, run int, " + ", ".join(f"{n} long" for n in names))


def buckets(nodes: DataFrame, runs: int, small: int) -> DataFrame:
    """node, run, bucket, n: the tree nodes in which classes are compared (two or more there)."""
    rest, done = paths(nodes, runs), []
    for depth in range(1, DEPTH + 1):
        key = f"p{depth}"
        sizes = rest.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
        split = materialize(rest.join(sizes, key), f"level{depth}")
        last = F.lit(depth == DEPTH) | (F.col("n") <= small)
        done.append(split.filter(last).select("node", "run", F.col(key).alias("bucket"), "n"))
        rest = split.filter(~last).drop("n", key)
    return reduce(DataFrame.unionAll, done)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple]:
    """(rows, n + 1 group offsets) of whole groups; input is sorted by the keys."""
    held: list[pa.RecordBatch] = []

    def flush(table):
        batch = table.combine_chunks().to_batches()[0]
        change = np.zeros(len(batch) - 1, bool)
        for key in keys:
            value = batch.column(key).to_numpy()
            change |= value[1:] != value[:-1]
        return batch, np.concatenate([[0], np.flatnonzero(change) + 1, [len(batch)]])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows, edges = flush(pa.Table.from_batches(held))
        if len(edges) > 2:
            yield rows.slice(0, edges[-2]), edges[:-1]
            held = [rows.slice(edges[-2])]
    if held:
        yield flush(pa.Table.from_batches(held))


def _pair_indices(edges: np.ndarray, sides: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of groups, some groups at a time; ``sides`` < 0: all pairs, else 0 against 1."""
    sizes = np.diff(edges)
    first = 0
    while first < len(sizes):
        total = np.cumsum(sizes[first:] ** 2)
        last = first + max(1, int(np.searchsorted(total, _PAIRS, "right")))
        left = np.arange(edges[first], edges[last])
        group_end = np.repeat(edges[first + 1:last + 1], sizes[first:last])
        for a in range(0, len(left), 256):  # bounds a large group's pairs as well
            own = left[a:a + 256]
            count = group_end[a:a + 256] - own - 1
            i = np.repeat(own, count)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
            keep = (sides[i] < 0) | (sides[i] != sides[j])
            yield i[keep], j[keep]
        first = last


class _Sketch:
    """What decides whether two rows are compared here."""

    def __init__(self, batch: pa.RecordBatch, runs: int, threshold: float):
        self.bytes = _matrix(batch.column("sketch"), COORDS, np.uint8)
        self.leaves = _matrix(batch.column("leaves"), runs, "<i8")
        self.run = batch.column("run").to_numpy()
        low, high = batch.column("low").to_numpy(), batch.column("high").to_numpy()
        self.sides = np.where(low == high, -1, (batch.column("block").to_numpy() != low).astype(int))
        bound = threshold - 4.5 * sqrt(threshold * (1 - threshold) / COORDS)
        self.least = COORDS * (bound * (1 - 1 / 256) + 1 / 256)

    def pairs(self, edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, j in _pair_indices(edges, self.sides):
            same = (self.bytes[i] == self.bytes[j]).sum(1)
            i, j = i[same >= self.least], j[same >= self.least]
            met = (self.leaves[i] == self.leaves[j]) & (self.leaves[i] != 0)
            first = met.argmax(1) == self.run[i]
            yield i[first], j[first]


_GROUP = ["bucket", "low", "high"]
_FIELDS = ("bucket long, low int, high int, block int, node long, run int, "
           "sketch binary, leaves binary")


def promising(groups: DataFrame, runs: int, threshold: float) -> DataFrame:
    """The rows that have a pair to verify in their group."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges in grouped(batches, _GROUP):
            sketch, hit = _Sketch(batch, runs, threshold), np.zeros(len(batch), bool)
            for i, j in sketch.pairs(edges):
                hit[i] = hit[j] = True
            yield batch.filter(pa.array(hit))
    return groups.mapInArrow(scan, _FIELDS)


def _overlaps(values: np.ndarray, offsets: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common grams of the row pairs (i, j); rows are sorted sets."""
    if len(i) < 64:
        return np.array([len(np.intersect1d(values[offsets[a]:offsets[a + 1]],
                                            values[offsets[b]:offsets[b + 1]], True))
                         for a, b in zip(i, j)], np.int64)
    used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
    rows = np.concatenate([np.arange(offsets[r], offsets[r + 1]) for r in used])
    owner = np.repeat(np.arange(len(used)), offsets[used + 1] - offsets[used])
    _, code, times = np.unique(values[rows], return_inverse=True, return_counts=True)
    shared = times[code] > 1
    code, owner = np.unique(code[shared], return_inverse=True)[1], owner[shared]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    common = np.zeros((len(used), len(used)), np.float32)
    for low in range(0, int(code.max(initial=-1)) + 1, 4096):
        a, b = np.searchsorted(code, [low, low + 4096])
        table = np.zeros((len(used), 4096), np.float32)
        table[owner[a:b], code[a:b] - low] = 1
        common += table @ table.T
    return common[back[:len(i)], back[len(i):]].astype(np.int64)


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row each row hangs together with."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def own_texts(read: DataFrame) -> DataFrame:
    """node, text: without texts that only share the doc_id of a class, one for each node."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in chunks(batch.column("text")):
                h1, h2 = sequence_hashes(words(part), part)
                rows = batch.slice(first, len(part))
                own = ((h1 == rows.column("h1").to_numpy()) & (h2 == rows.column("h2").to_numpy()))
                yield rows.filter(pa.array(own)).select(["node", "text"])
    return read.mapInArrow(scan, "node long, text string").dropDuplicates(["node"])


def verified(groups: DataFrame, runs: int, threshold: float) -> DataFrame:
    """node, links, label: exact links of a class in a group, and a class of its component."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges in grouped(batches, _GROUP):
            yield from _links(batch, edges, runs, threshold)
    return groups.mapInArrow(scan, "node long, links long, label long")


def _links(batch: pa.RecordBatch, edges: np.ndarray, runs: int, threshold: float
           ) -> Iterator[pa.RecordBatch]:
    node = batch.column("node").to_numpy()
    sketch = _Sketch(batch, runs, threshold)
    for a, b in zip(edges[:-1], edges[1:]):
        values, sizes = [], []
        for _, part in chunks(batch.column("text").slice(a, b - a)):
            value, offsets = gram_hashes(words(part), len(part))
            sets = [np.unique(value[x:y]) for x, y in zip(offsets[:-1], offsets[1:])]
            values += sets
            sizes += map(len, sets)
        sizes = np.array(sizes)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.concatenate(values)
        pairs = list(sketch.pairs(np.array([a, b])))
        i, j = (np.concatenate(x) - a for x in zip(*pairs))
        both = _overlaps(flat, offsets, i, j)
        # |A and B| >= t |A or B| in whole numbers
        whole = sizes[i] + sizes[j] - both
        linked = both >= threshold * whole - 1e-9
        i, j = i[linked], j[linked]
        links = np.bincount(i, minlength=b - a) + np.bincount(j, minlength=b - a)
        own = node[a:b]
        order = np.argsort(own)
        rank = np.empty(b - a, np.int64)
        rank[order] = np.arange(b - a)
        label = own[order][_labels(b - a, rank[i], rank[j])[rank]]
        some = links > 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(own[some]), pa.array(links[some]), pa.array(label[some])],
            ["node", "links", "label"])


def _in_groups(df: DataFrame) -> DataFrame:
    return df.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "node")


def similar(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL,
            small: int = SMALL) -> DataFrame:
    """doc_id, class_id, n_links, n_copies: one row a row of ``docs``.

    ``class_id`` is the smallest doc_id of all texts that hang together by links, ``n_links``
    the number of other texts linked to this one, ``n_copies`` the rows with the same words.
    """
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("number"),
                                   F.col("doc_id").cast("long"), "text"), "numbered")
    return _similar(rows, threshold, recall, small)


def _similar(rows: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL,
             small: int = SMALL) -> DataFrame:
    """The same of a written table of number (unique), doc_id and text."""
    spark, runs = rows.sparkSession, runs_for(recall, threshold)
    signed = materialize(signatures(rows), "signatures")
    classes = (signed.groupBy("h1", "h2")
               .agg(F.min("number").alias("rep"), F.min("doc_id").alias("least"),
                    F.count("*").alias("n_copies"), F.first("mins").alias("mins")))
    nodes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    compared = nodes.filter("mins is not null")

    with recording() as levels:
        found = buckets(compared, runs, small)
    spent = [scratch_path(spark, name) for name in ("buckets", "traits", "promising")]
    found = materialize(found, path=spent[0])
    for path in levels:
        drop_table(spark, path)
    # the bucket of each run, 0 for none: where two classes met first is read off both rows
    leaves = [F.coalesce(F.max(F.when(F.col("run") == r, F.col("bucket"))), F.lit(0))
              for r in range(runs)]
    met = found.groupBy("node").agg(F.array(*leaves).alias("leaves"))
    traits = compared.join(met, "node").select("node", "rep", "h1", "h2", "mins", "leaves")
    traits = materialize(_compact(traits), path=spent[1])

    n_blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = (found.withColumn("blocks", n_blocks)
              .withColumn("block", F.pmod(F.hash("node"), F.col("blocks")))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("bucket", F.least("block", "other").alias("low"),
                      F.greatest("block", "other").alias("high"), "block", "node", "run"))
    groups = _in_groups(placed.join(traits.select("node", "sketch", "leaves"), "node")
                        .select(*[f.split()[0] for f in _FIELDS.split(", ")]))
    hopeful = materialize(promising(groups, runs, threshold), path=spent[2])

    texts = rows.select(F.col("number").alias("rep"), "text")
    wanted = hopeful.select("node").distinct().join(
        traits.select("node", "rep", "h1", "h2"), "node")
    read = own_texts(texts.join(wanted, "rep").select("node", "h1", "h2", "text"))
    links = materialize(verified(_in_groups(hopeful.join(read, "node")), runs, threshold), "links")

    for path in spent:
        drop_table(spark, path)

    joined = components(links.select("node", "label").filter("node <> label").distinct(),
                        "node", "label")
    counted = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    named = (nodes.select("node", "h1", "h2", "least", "n_copies")
             .join(counted, "node", "left").join(joined, "node", "left")
             .withColumn("root", F.coalesce("root", "node")))
    named = materialize(named, "named")
    heads = named.groupBy("root").agg(F.min("least").alias("class_id"))
    return (signed.select("doc_id", "h1", "h2").join(named.join(heads, "root"), ["h1", "h2"])
            .select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                    "n_copies"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The first row of every group of texts that hang together; all columns of ``docs``.

    Rows are numbered and written once, so that ids need not be unique or present.
    """
    number = "_row"
    while number in docs.columns:
        number += "_"
    rows = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    key = F.col(number)
    found = _similar(rows.select(key.alias("number"), key.alias("doc_id"), "text"), **options)
    first = found.filter("doc_id = class_id").select(F.col("doc_id").alias(number)).distinct()
    return rows.join(first, number, "left_semi").drop(number)


def _compact(traits: DataFrame) -> DataFrame:
    """One byte of each min-hash and the leaves as bytes: what a group needs of a class."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mins = _matrix(batch.column("mins"), COORDS, "<u4")
            sketch = (mins & 255).astype(np.uint8)
            leaves = [np.asarray(x.values.to_numpy(), "<i8").tobytes()
                      for x in batch.column("leaves")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("node", "rep", "h1", "h2")),
                 pa.array([s.tobytes() for s in sketch], pa.binary()),
                 pa.array(leaves, pa.binary())],
                ["node", "rep", "h1", "h2", "sketch", "leaves"])
    return traits.mapInArrow(scan, "node long, rep long, h1 long, h2 long, sketch binary, "
                             "leaves binary")
