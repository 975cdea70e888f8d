"""Token ids of documents in Huffman-coded files, in the order of doc_id.

Writing: texts become ids (stored once, compressed), one aggregate counts every id of the
corpus, the driver makes one canonical code of at most ``limit`` bits from these counts (at
most one per vocabulary entry), tasks code the documents and deal them into ordered parts.

File format, a folder with two tables:
* ``codebook``: token_id, length (bits). The canonical code follows from the lengths.
* ``blocks``: part, block, n_ids, payload, and per document doc_id, n_tokens, and the bit
  position of every ``LANE``-th id (checkpoints). A block is decoded without any other;
  within it all checkpoints are decoded side by side.

Ids of all documents before a part are a prefix sum over parts, computed while reading.
Null and empty texts consist of the end id. Rows without doc_id come first; rows that share
a doc_id stay apart, in the order of a hash of the text. Other columns are not read.
"""

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from visitseq.llm import huffman, ordering, tokens
from visitseq.llm.textbytes import chunks
from visitseq.sources.scratch import drop_table, scratch_path

LIMIT = 16
LANE = 256
IDS_PER_PART = 1 << 24
BLOCK_BYTES = 1 << 19
_FIRST = -(1 << 63)


def token_rows(docs: DataFrame, name: str = tokens.WORD_BPE) -> DataFrame:
    """doc_id, tie, n_tokens, ids (little-endian unsigned integers, see ``id_type``)."""
    kind = id_type(name)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(name)
        for batch in batches:
            for first, part in chunks(batch.column("text"), tokens.CHUNK_BYTES):
                ids, ends = encoder.encode(part)
                rows = slice(first, first + len(part))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[rows], batch.column("tie")[rows],
                     pa.array(np.diff(ends), pa.int64()), binary_ids(ids, ends, kind)],
                    ["doc_id", "tie", "n_tokens", "ids"])
    kept = docs.select(F.col("doc_id").cast("long"), F.pmod(F.xxhash64("text"), F.lit(ordering.TIES))
                       .cast("int").alias("tie"), "text")
    return kept.mapInArrow(scan, "doc_id long, tie int, n_tokens long, ids binary")


def id_type(name: str) -> np.dtype:
    """Two bytes an id while tables are on their way, if the vocabulary allows it."""
    return np.dtype("<u2" if tokens.encoder(name).size <= 1 << 16 else "<u4")


def binary_ids(ids: np.ndarray, ends: np.ndarray, kind: np.dtype) -> pa.Array:
    """A binary column: the ids of each row."""
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(ends) - 1,
        [None, pa.py_buffer(kind.itemsize * ends), pa.py_buffer(ids.astype(kind))]
    ).cast(pa.binary())


def flat_ids(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column and the n + 1 offsets of its rows."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    ids = np.frombuffer(data[offsets[0]:offsets[-1]], kind)
    return ids, (offsets - offsets[0]) // kind.itemsize


def id_counts(rows: DataFrame, name: str) -> DataFrame:
    """token_id, n over all documents; a task adds up its own counts first."""
    size, kind = tokens.encoder(name).size, id_type(name)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in by_bytes(batches, "ids", 4 << 20):
            total += np.bincount(flat_ids(batch.column("ids"), kind)[0], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])],
                                         ["token_id", "n"])
    return (rows.select("ids").mapInArrow(count, "token_id int, n long")
            .groupBy("token_id").agg(F.sum("n").alias("n")))


def by_bytes(rows: Iterator[pa.RecordBatch], column: str, most: int
                      ) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes in a binary column, at least one row each."""
    for batch in rows:
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
        first = 0
        while first < len(ends):
            last = max(first + 1, int(np.searchsorted(
                ends, (ends[first - 1] if first else 0) + most, "right")))
            yield batch.slice(first, last - first)
            first = last


def write_ids(docs: DataFrame, path: str, name: str = tokens.WORD_BPE, limit: int = LIMIT,
              ids_per_part: int = IDS_PER_PART) -> None:
    """Encode ``docs`` (doc_id, text) and write codebook and blocks below ``path``."""
    spark = docs.sparkSession
    stored_at = scratch_path(spark, "ids")
    (token_rows(docs, name).withColumn("doc_id", F.coalesce("doc_id", F.lit(_FIRST)))
     .write.option("compression", "zstd").parquet(stored_at))
    stored = spark.read.parquet(stored_at)

    size = tokens.encoder(name).size
    counts = id_counts(stored, name).orderBy("token_id").toPandas()  # at most `size` rows
    symbols = counts["token_id"].to_numpy(np.int64)
    lengths = huffman.code_lengths(counts["n"].to_numpy(np.int64), limit)
    spark.createDataFrame(pa.table({"token_id": pa.array(symbols, pa.int32()),
                                    "length": pa.array(lengths, pa.int32())})
                          ).coalesce(1).write.parquet(f"{path}/codebook")

    slot = np.zeros(size, np.int32)
    slot[symbols] = np.arange(len(symbols))
    parts = max(1, -(-int(counts["n"].sum()) // ids_per_part))
    book = spark.sparkContext.broadcast(
        (slot, lengths, huffman.canonical(lengths), ordering.bounds_of(stored, "doc_id", parts),
         id_type(name)))
    coded = stored.mapInArrow(lambda b: _code(b, book.value),
                              "part int, doc_id long, tie int, n_tokens int, "
                              "at array<int>, payload binary")
    (coded.repartitionById(parts, "part").sortWithinPartitions("part", "doc_id", "tie", "payload")
     .mapInArrow(_blocks, "part int, block int, n_ids long, doc_id array<long>, "
                 "n_tokens array<int>, at array<int>, payload binary")
     .write.option("compression", "none").parquet(f"{path}/blocks"))
    drop_table(spark, stored_at)


def _code(batches: Iterator[pa.RecordBatch], book) -> Iterator[pa.RecordBatch]:
    """Each document as bits, with the bit position of every LANE-th id."""
    slot, lengths, codes, bounds, kind = book
    for batch in by_bytes(batches, "ids", 4 << 20):
        ids, offsets = flat_ids(batch.column("ids"), kind)
        bits, starts, at = huffman.encode(slot[ids], offsets, lengths, codes)
        count = np.diff(offsets)
        lanes = -(-count // LANE)
        first = np.repeat(offsets[:-1], lanes)
        lane_ends = np.concatenate([[0], np.cumsum(lanes)])
        step = np.arange(lane_ends[-1]) - np.repeat(lane_ends[:-1], lanes)
        marks = at[first + LANE * step] - 8 * np.repeat(starts[:-1], lanes)
        payload = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(count), [None, pa.py_buffer(starts), pa.py_buffer(bits)])
        key, tie = (batch.column(c).to_numpy() for c in ("doc_id", "tie"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ordering.bucket_of(key, tie, bounds)), batch.column("doc_id"),
             batch.column("tie"), pa.array(count, pa.int32()),
             pa.ListArray.from_arrays(pa.array(lane_ends, pa.int32()), pa.array(marks, pa.int32())),
             payload.cast(pa.binary())],
            ["part", "doc_id", "tie", "n_tokens", "at", "payload"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive documents of a part glued to blocks; one block is held at a time."""
    part, block, rows, size = None, 0, [], 0

    def flush():
        ids, counts, marks, payloads = zip(*rows)
        begin = np.cumsum([0, *map(len, payloads)][:-1])
        at = np.concatenate([m + 8 * b for m, b in zip(marks, begin)])
        return pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()),
            "n_ids": pa.array([sum(counts)], pa.int64()),
            "doc_id": pa.array([ids], pa.list_(pa.int64())),
            "n_tokens": pa.array([counts], pa.list_(pa.int32())),
            "at": pa.array([at], pa.list_(pa.int32())),
            "payload": pa.array([b"".join(payloads)], pa.binary())})

    for batch in batches:
        at = batch.column("at")
        marks, ends = at.flatten().to_numpy(), at.offsets.to_numpy() - at.offsets[0].as_py()
        columns = (batch.column(c).to_pylist() for c in ("part", "doc_id", "n_tokens", "payload"))
        for i, (own, doc, count, payload) in enumerate(zip(*columns)):
            if rows and (own != part or size + len(payload) > BLOCK_BYTES):
                yield flush()
                block, rows, size = (block + 1 if own == part else 0), [], 0
            part = own
            rows.append((doc, count, marks[ends[i]:ends[i + 1]], payload))
            size += len(payload)
    if rows:
        yield flush()


def read_ids(spark: SparkSession, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids (little-endian 32-bit), decoded block by block."""
    book = spark.read.parquet(f"{path}/codebook").toPandas()  # at most one row a token
    book = book.sort_values("token_id")
    symbols, lengths = book["token_id"].to_numpy(np.uint32), book["length"].to_numpy(np.int64)
    blocks = spark.read.parquet(f"{path}/blocks")
    before = ordering.offsets_of(blocks.select("part", "n_ids"), "part", "n_ids")
    code = spark.sparkContext.broadcast((symbols, huffman.decode_table(lengths, limit), before))
    # blocks of a part one after the other: the place of a block is the sum of those before it
    earlier = blocks.select("part", "block", "n_ids").groupBy("part").agg(
        F.array_sort(F.collect_list(F.struct("block", "n_ids"))).alias("sizes"))
    starts = earlier.select("part", F.expr(
        "inline(transform(sizes, (x, i) -> struct(x.block as block, "
        "aggregate(slice(sizes, 1, i), 0L, (a, y) -> a + y.n_ids) as before)))"))
    return blocks.join(starts, ["part", "block"]).mapInArrow(
        lambda batches: _decode(batches, code.value, limit),
        "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def _decode(batches: Iterator[pa.RecordBatch], code, limit: int) -> Iterator[pa.RecordBatch]:
    symbols, table, parts = code
    for batch in batches:
        for row in range(batch.num_rows):
            get = {c: batch.column(c)[row] for c in batch.schema.names}
            doc, count, at = (get[c].values.to_numpy() for c in ("doc_id", "n_tokens", "at"))
            count = count.astype(np.int64)
            lanes = -(-count // LANE)
            sizes = np.full(int(lanes.sum()), LANE, np.int64)
            sizes[np.cumsum(lanes) - 1] = count - LANE * (lanes - 1)
            ids = symbols[huffman.decode(get["payload"].as_py(), at, sizes, table, limit)]
            ends = np.concatenate([[0], np.cumsum(count)])
            data = ids.astype("<u4")  # outside the files an id has four bytes
            crc = [crc32(data[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            start = parts[get["part"].as_py()] + get["before"].as_py() + ends[:-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, mask=doc == _FIRST), pa.array(start, pa.int64()), pa.array(count),
                 pa.array(crc, pa.int64()), binary_ids(ids, ends, np.dtype("<u4"))],
                ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
