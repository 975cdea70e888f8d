"""Benchmark decontamination by winnowed fingerprints.

A text is a sequence of words (``textbytes.words``). An item window is ``window`` consecutive
words of a benchmark item; an item with fewer words is one window of all of them. For a window
of L words, k-grams with k = ceil(L / 2) are hashed and the smallest of the w = L - k + 1
k-grams inside the window is its fingerprint. A document keeps, for every such window of its
own, the same minimum: two equal windows always have equal fingerprints, so no shared span of
L words is missed, and neighbouring windows mostly share one.

The fingerprints of all items are summed into a bit map of fixed size (``MAP_BITS``), whatever
the size of the benchmark; tasks drop document windows whose fingerprint is not in it. What
stays is joined with the item windows on fingerprint and 128 bits of all L words: the join of
the fingerprints and the extension of a hit to the whole window are one equality join.

Nulls and empty texts have no words and no hits. Rows of documents are kept apart even if they
share a doc_id or have none. Items without item_id mark words but are not listed. Other
columns of the two tables are not read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from visitseq.llm.textbytes import chunks, grams, words
from visitseq.sources import materialize

WINDOW = 10
MAP_BITS = 1 << 23  # 1 MB
_SECOND = 0xA0761D6478BD642F


def windows_of(row: np.ndarray, hashes: np.ndarray, length: int
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First words of all windows of a length, their fingerprints and two hashes."""
    k = (length + 1) // 2
    w = length - k + 1
    first, whole = grams(hashes, row, length)
    second, _ = grams(hashes, row, length, _SECOND)
    seeds, _ = grams(hashes, row, k)
    size = len(first)
    finger = seeds[:size].copy()
    for i in range(1, w):
        np.minimum(finger, seeds[i:i + size], out=finger)
    at = np.flatnonzero(whole)
    # the length is part of the fingerprint: windows of other lengths never meet
    mark = finger[at] ^ np.uint64(length * 0x9E3779B97F4A7C15 % (1 << 64))
    return at, mark.view(np.int64), first[at].view(np.int64), second[at].view(np.int64)


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """item_id, length, finger, h1, h2: one row a window."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in chunks(batch.column("text")):
                found = words(part)
                count = np.bincount(found.row, minlength=len(part))
                for length in np.unique(np.minimum(count[count > 0], window)):
                    keep = (count[found.row] == length) | (
                        (length == window) & (count[found.row] >= window))
                    row = found.row[keep]
                    at, finger, h1, h2 = windows_of(row, found.hash[keep], int(length))
                    ids = batch.column("item_id").take(pa.array(row[at] + first))
                    yield pa.RecordBatch.from_arrays(
                        [ids.cast(pa.string()), pa.array(np.full(len(at), length, np.int32)),
                         pa.array(finger), pa.array(h1), pa.array(h2)],
                        ["item_id", "length", "finger", "h1", "h2"])
    return items.select(F.col("item_id").cast("string"), "text").mapInArrow(
        scan, "item_id string, length int, finger long, h1 long, h2 long")


def bit_map(fingers: DataFrame) -> np.ndarray:
    """Bits of the fingerprints modulo MAP_BITS: at most MAP_BITS / 64 longs reach the driver."""
    bit = F.pmod(F.col("finger"), F.lit(MAP_BITS))
    rows = (fingers.groupBy((bit / 64).cast("int").alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(finger, 64) as int))")).alias("bits"))
            .toPandas())
    bits = np.zeros(MAP_BITS // 64, np.int64)
    bits[rows["word"].to_numpy(int)] = rows["bits"].to_numpy(np.int64)
    return bits


def candidates(docs: DataFrame, lengths: list[int], bits, key: str) -> DataFrame:
    """``key``, n_words and the windows whose fingerprint some item may have."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()),
                               ("finger", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        for batch in batches:
            for first, part in chunks(batch.column("_text")):
                found = words(part)
                count = np.bincount(found.row, minlength=len(part))
                begin = np.concatenate([[0], np.cumsum(count)])
                hits = [[np.zeros(0, np.int64)] * 6]
                for length in lengths:
                    at, finger, h1, h2 = windows_of(found.row, found.hash, length)
                    bit = np.mod(finger, MAP_BITS)
                    keep = ((known[bit >> 6] >> (bit & 63)) & 1).astype(bool)
                    at = at[keep]
                    hits.append([found.row[at], at - begin[found.row[at]],
                                 np.full(len(at), length), finger[keep], h1[keep], h2[keep]])
                row, *fields = map(np.concatenate, zip(*hits))
                order = np.argsort(row, kind="stable")
                ends = np.searchsorted(row[order], np.arange(len(part) + 1))
                values = pa.StructArray.from_arrays(
                    [pa.array(x[order], t.type) for x, t in zip(fields, kind.value_type)],
                    fields=list(kind.value_type))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).slice(first, len(part)), pa.array(count, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)],
                    [key, "n_words", "windows"])

    window = T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "length")]
                          + [T.StructField(n, T.LongType()) for n in ("finger", "h1", "h2")])
    return docs.select(key, F.col("text").alias("_text")).mapInArrow(scan, T.StructType(
        [docs.schema[key], T.StructField("n_words", T.LongType()),
         T.StructField("windows", T.ArrayType(window))]))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW,
                  key: str = "doc_id") -> DataFrame:
    """``key``, n_words, n_hit, n_items, items (sorted ids), spans (hit word ranges), contaminated.

    One row a row of ``docs``; ``key`` is a column to carry along, an id or a struct of whole
    rows. ``spans`` are the maximal ranges [start, end) of hit words.
    """
    spark = docs.sparkSession
    known = materialize(item_windows(items, window), "item-windows")
    # a window with all items that hold it; equal lists of items share one id
    owners = (known.groupBy("length", "finger", "h1", "h2")
              .agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    owners = materialize(owners.withColumn("list_id", F.md5(F.to_json("items"))), "owners")
    lengths = [r[0] for r in owners.select("length").distinct().collect()]  # at most `window`
    bits = spark.sparkContext.broadcast(bit_map(owners))
    scanned = materialize(candidates(docs, sorted(lengths), bits, key)
                          .withColumn("_row", F.monotonically_increasing_id()), "scanned")

    hits = (scanned.select(F.col("_row").alias("row"), F.explode("windows").alias("w"))
            .select("row", "w.*")
            .join(owners.drop("items"), ["length", "finger", "h1", "h2"])
            .select("row", "start", (F.col("start") + F.col("length")).alias("end"), "list_id"))
    hits = materialize(hits, "hits")
    ordered = Window.partitionBy("row").orderBy("start", "end")
    covered = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    spans = (hits.select("row", "start", "end").withColumn("before", F.coalesce(covered, F.lit(0)))
             .withColumn("fresh", F.greatest(F.lit(0), F.col("end")
                                             - F.greatest("start", "before")))
             .withColumn("opens", (F.col("start") > F.col("before")) | (F.col("before") == 0))
             .withColumn("span", F.sum(F.col("opens").cast("int")).over(ordered))
             .groupBy("row", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"),
                                         F.sum("fresh").alias("fresh"))
             .groupBy("row").agg(F.sum("fresh").alias("n_hit"),
                                 F.array_sort(F.collect_list(F.struct("start", "end")))
                                 .alias("spans")))
    lists = (hits.select("row", "list_id").distinct()
             .join(owners.select("list_id", "items").dropDuplicates(["list_id"]), "list_id")
             .select("row", F.explode("items").alias("item"))
             .groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items")))
    none = F.array().cast("array<string>")
    return (scanned.select(F.col("_row").alias("row"), F.col(key).alias("_key"), "n_words")
            .join(spans, "row", "left").join(lists, "row", "left")
            .select(F.col("_key").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce("items", none).alias("items"), "spans",
                    F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated")))
