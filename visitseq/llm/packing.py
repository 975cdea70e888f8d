"""Packing along a space-filling curve: documents on similar subjects share sequences.

A document becomes a vector of hashed token counts (square roots, length 1), projected with
fixed random directions to ``DIMS`` coordinates. The coordinates are put on a grid by their
mean and deviation over the corpus, and the place on the Hilbert curve through that grid is
the key by which documents are sorted (ties by a hash of id and text). Ids are then cut every
``capacity``: a sequence is a stretch of the curve, full by construction. What remains at the
end of the corpus is cut into powers of two, which need no padding. So nothing is padded.

Sorting is over the corpus: keys are dealt into ordered buckets (``ordering``), copies of one
text over several of them, and the place of a bucket is a prefix sum of bucket sizes.

Null and empty texts consist of the end id. Rows that share a doc_id or have none stay apart.
An empty table gives no pieces. Other columns are not read.
"""

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from visitseq.llm import ordering, tokens
from visitseq.llm.idfiles import binary_ids, by_bytes, flat_ids, id_type
from visitseq.llm.textbytes import chunks, mix
from visitseq.sources.scratch import scratch_path

CAPACITY = 4096
HASHED = 256
DIMS = 4
BITS = 8
IDS_PER_BUCKET = 1 << 24
_AXES = [f"axis{i}" for i in range(DIMS)]


def hilbert_key(grid: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points (n, m) with ``bits`` bits a coordinate.

    From the highest bit down, the sub-cube a point is in is mirrored or has two axes swapped so
    that the curve inside it continues that of its neighbour; the Gray code of the sub-cubes
    gives their order.
    """
    x = [column.astype(np.int64) for column in grid.T]
    m = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(m):
            upper = (x[i] >> level & 1).astype(bool)
            swap = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(upper, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, m):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for column in x:
            key = key << 1 | ((column ^ flip) >> level & 1)
    return key


def coordinates(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """DIMS coordinates a document: hashed counts on the unit sphere, projected."""
    n = len(offsets) - 1
    slot = (mix(np.arange(int(ids.max(initial=0)) + 1, dtype=np.uint64)) % HASHED).astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.sqrt(np.bincount(row * HASHED + slot[ids], minlength=n * HASHED).reshape(n, HASHED))
    counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)
    axes = np.random.default_rng(HASHED).standard_normal((HASHED, DIMS))
    return np.einsum("nd,dk->nk", counts, axes)


def located_rows(docs: DataFrame, name: str) -> DataFrame:
    """doc_id, tie, n_tokens, ids and the coordinates of every document."""
    dtype, kind = docs.schema["doc_id"].dataType.simpleString(), id_type(name)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(name)
        for batch in batches:
            for first, part in chunks(batch.column("text"), tokens.CHUNK_BYTES):
                ids, ends = encoder.encode(part)
                rows = slice(first, first + len(part))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[rows], batch.column("tie")[rows],
                     pa.array(np.diff(ends), pa.int64()), binary_ids(ids, ends, kind),
                     *map(pa.array, coordinates(ids, ends).T)],
                    ["doc_id", "tie", "n_tokens", "ids", *_AXES])
    kept = docs.select("doc_id", F.pmod(F.xxhash64("doc_id", "text"), F.lit(ordering.TIES))
                       .cast("int").alias("tie"), "text")
    return kept.mapInArrow(scan, f"doc_id {dtype}, tie int, n_tokens long, ids binary, "
                           + ", ".join(f"{a} double" for a in _AXES))


def grid_of(batch: pa.RecordBatch, means: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Grid cells: each coordinate by its place in the corpus, about evenly filled."""
    place = np.stack([batch.column(a).to_numpy() for a in _AXES], 1)
    even = 1 / (1 + np.exp(-1.7 * (place - means) / widths))
    return np.minimum((even * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def sequence_starts(total: int, capacity: int) -> tuple[int, np.ndarray]:
    """Ids in full sequences, and where each sequence of the rest starts and the rest ends."""
    full, rest = total // capacity * capacity, total % capacity
    sizes = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return full, full + np.cumsum([0, *sizes])


def cut(starts: np.ndarray, sizes: np.ndarray, full: int, tail: np.ndarray, capacity: int):
    """(row, start in the row, length, sequence, offset) of all pieces of consecutive rows."""
    def sequence(at):
        late = full // capacity + np.searchsorted(tail, at, "right") - 1
        return np.where(at < full, at // capacity, late)

    first = sequence(starts)
    pieces = sequence(starts + sizes - 1) - first + 1
    row = np.repeat(np.arange(len(starts)), pieces)
    number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    seq = first[row] + number

    def begin_of(s):
        late = tail[np.clip(s - full // capacity, 0, len(tail) - 1)]
        return np.where(s * capacity < full, s * capacity, late)

    begin = np.maximum(starts[row], begin_of(seq))
    end = np.minimum((starts + sizes)[row], begin_of(seq + 1))
    return row, begin - starts[row], end - begin, seq, begin - begin_of(seq)


def pack(docs: DataFrame, name: str = tokens.WORD_BPE, capacity: int = CAPACITY,
         ids_per_bucket: int = IDS_PER_BUCKET) -> DataFrame:
    """One row a piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids_crc32, ids."""
    spark = docs.sparkSession
    dtype, kind = docs.schema["doc_id"].dataType.simpleString(), id_type(name)
    stored_at = scratch_path(spark, "located")
    located_rows(docs, name).write.option("compression", "zstd").parquet(stored_at)
    stored = spark.read.parquet(stored_at)

    facts = stored.agg(F.sum("n_tokens"), *[F.avg(a) for a in _AXES],
                       *[F.stddev_pop(a) for a in _AXES]).head()
    total = facts[0] or 0
    means = np.array([x or 0.0 for x in facts[1:1 + DIMS]])
    widths = np.maximum([x or 0.0 for x in facts[1 + DIMS:]], 1e-9)

    def keyed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(hilbert_key(grid_of(batch, means, widths), BITS))], ["key"])

    buckets = max(1, -(-total // ids_per_bucket))
    bounds = ordering.bounds_of(stored.select(*_AXES).mapInArrow(keyed, "key long"), "key", buckets)

    def placed(batches):
        for batch in batches:
            key = hilbert_key(grid_of(batch, means, widths), BITS)
            bucket = ordering.bucket_of(key, batch.column("tie").to_numpy(), bounds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket), pa.array(key),
                 *(batch.column(c) for c in ("tie", "doc_id", "n_tokens")), *batch.columns[-1:]],
                ["bucket", "key", "tie", "doc_id", "n_tokens", *batch.schema.names[-1:]])

    head = f"bucket int, key long, tie int, doc_id {dtype}, n_tokens long"
    small = stored.select(*_AXES, "tie", "doc_id", "n_tokens")
    before = ordering.offsets_of(
        small.withColumn("none", F.lit(0)).mapInArrow(placed, f"{head}, none int"),
        "bucket", "n_tokens")
    full, tail = sequence_starts(total, capacity)

    def pieces(batches):
        bucket = position = None
        for batch in by_bytes(batches, "ids", 2 << 20):
            own = batch.column("bucket").to_numpy()
            sizes = batch.column("n_tokens").to_numpy()
            starts = np.zeros(len(own), np.int64)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]])
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if own[a] != bucket:
                    bucket, position = own[a], before[own[a]]
                starts[a:b] = position + np.cumsum(sizes[a:b]) - sizes[a:b]
                position += int(sizes[a:b].sum())
            ids, offsets = flat_ids(batch.column("ids"), kind)
            row, start, length, sequence, offset = cut(starts, sizes, full, tail, capacity)
            first = offsets[row] + start
            parts = [ids[a:b].astype("<u4").tobytes() for a, b in zip(first, first + length)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length),
                 pa.array(sizes[row]), pa.array(sequence), pa.array(offset),
                 pa.array(map(crc32, parts), pa.int64()), pa.array(parts, pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset",
                 "ids_crc32", "ids"])

    return (stored.select(*_AXES, "tie", "doc_id", "n_tokens", "ids")
            .mapInArrow(placed, f"{head}, ids binary")
            .repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "key", "tie", "doc_id")
            .mapInArrow(pieces, f"doc_id {dtype}, start long, length long, doc_tokens long, "
                        "sequence_id long, offset long, ids_crc32 long, ids binary"))
