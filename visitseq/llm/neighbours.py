"""Approximate nearest neighbours by cosine: stable projections, kd-trees, a chi-square stop.

Vectors are brought to length 1 and projected with ``DIMS`` fixed normal directions (normal
variables are 2-stable). For two vectors at distance d, the squared projected distance divided
by d * d is chi-squared with ``DIMS`` degrees of freedom. So neighbours can be looked for in the
projection, nearest boxes first, and the search stops once the chi-square probability of
(projected distance so far / distance of the k-th best)**2 reaches ``STOP``: each true
neighbour is then missed with probability at most 1 - STOP.

* Equal vectors are one class that keeps its k + 1 smallest ids; no more can be in a result.
* The top of the kd-tree is fitted on at most ``SAMPLE`` classes (a hash decides which) and has
  at most ``CELLS`` cells; every class is put into its cell. Cells are dealt into blocks of
  about ``BLOCK`` classes; a task builds the rest of the tree for one block at a time.
* Queries first search the blocks of their own cell. The distance found bounds the radius, and
  a second round searches the other cells that the radius reaches. Both rounds stop by the
  test. How many cells that are depends on the data: vectors without near neighbours reach most.
* Scores are cosines in double precision on the original vectors.

Vectors that are null, empty, zero, or hold nulls or values that are not finite take no part,
nor rows without id, nor vectors of another length than the most frequent one. Repeated rows
count once; an id with several vectors is a candidate and a query with each of them. Scores equal
to twelve digits (scaled copies of a vector differ by rounding only) are ties; ties go to the
smaller id, in every step that cuts, so results do not depend on partitions. The sample of a
table whose hash is uneven may reach twice ``SAMPLE``. Other columns are not read.
"""

from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from visitseq.sources import materialize

DIMS = 8
STOP = 0.95
SAMPLE = 20_000
CELLS = 1024
BLOCK = 16_384
LEAF = 64
_DIGITS = 12
_AXES = [f"p{i}" for i in range(DIMS)]


def chi_square(x: float, dims: int = DIMS) -> float:
    """P(chi-squared with an even number of degrees of freedom <= x)."""
    term = total = exp(-x / 2)
    for i in range(1, dims // 2):
        term *= x / 2 / i
        total += term
    return 1 - total


def stop_factor(stop: float, dims: int = DIMS) -> float:
    """The x with chi_square(x) = stop: search reaches sqrt(x) times the k-th distance."""
    low, high = 0.0, 1000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, dims) < stop else (low, middle)
    return high


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Length 1; divided by the largest entry first, so that squares stay in range."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def projected(vectors: np.ndarray) -> np.ndarray:
    axes = np.random.default_rng(2014).standard_normal((vectors.shape[1], DIMS))
    return np.einsum("nd,dk->nk", _unit(vectors), axes)


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _floats(column: pa.Array) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.float64).reshape(len(column), -1)


def classes_of(rows: DataFrame, keep: int) -> DataFrame:
    """node, ids (the ``keep`` smallest), asks (whether a query has the vector), vector, p0..."""
    smallest = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    kept = (rows.select("vector", "id").distinct().withColumn("n", smallest)
            .filter(F.col("n") <= keep).groupBy("vector")
            .agg(F.array_sort(F.collect_list("id")).alias("ids")))
    asked = rows.groupBy("vector").agg(F.max("asks").alias("asks"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
            vectors = flat.reshape(batch.num_rows, -1).astype(np.float64)
            if not len(vectors):
                continue
            yield pa.RecordBatch.from_arrays(
                [batch.column("ids"), batch.column("asks"), batch.column("vector"),
                 pa.array([v.tobytes() for v in vectors], pa.binary()),
                 *map(pa.array, projected(vectors).T)], ["ids", "asks", "key", "vector", *_AXES])

    joined = kept.join(asked, "vector").select("ids", "asks", "vector").mapInArrow(
        scan, "ids array<long>, asks boolean, key array<double>, vector binary, "
        + ", ".join(f"{a} double" for a in _AXES))
    return joined.withColumns({"node": F.monotonically_increasing_id(),
                               "first": F.array_min("ids")})


def split_planes(points: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level the axis and the value that halve every box: the top of a kd-tree."""
    boxes, levels = [points], []
    for _ in range(depth):
        axes = [int(np.argmax(np.ptp(b, axis=0))) if len(b) else 0 for b in boxes]
        cuts = [float(np.median(b[:, a])) if len(b) else 0.0 for b, a in zip(boxes, axes)]
        levels.append((np.array(axes), np.array(cuts)))
        boxes = [half for b, a, c in zip(boxes, axes, cuts)
                 for half in (b[b[:, a] < c], b[b[:, a] >= c])]
    return levels


def cell_of(points: np.ndarray, levels) -> np.ndarray:
    cell = np.zeros(len(points), np.int64)
    for axes, cuts in levels:
        cell = 2 * cell + (points[np.arange(len(points)), axes[cell]] >= cuts[cell])
    return cell


class Tree:
    """The points of a block in leaves of a kd-tree, with the leaves' boxes."""

    def __init__(self, points: np.ndarray):
        self.order, self.bounds = [], []
        self._split(points, np.arange(len(points)))
        self.lows = np.array([low for low, _ in self.bounds])
        self.highs = np.array([high for _, high in self.bounds])

    def _split(self, points: np.ndarray, rows: np.ndarray):
        todo = [rows]
        while todo:
            rows = todo.pop()
            own = points[rows]
            low, high = own.min(0), own.max(0)
            axis = int(np.argmax(high - low))
            if len(rows) <= LEAF or low[axis] == high[axis]:
                self.order.append(rows)
                self.bounds.append((low, high))
                continue
            by = np.argsort(own[:, axis], kind="stable")
            todo += [rows[by[:len(rows) // 2]], rows[by[len(rows) // 2:]]]

    def near(self, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves, nearest box first, and the squared distances of their boxes."""
        gap = np.maximum(np.maximum(self.lows - point, point - self.highs), 0)
        square = (gap * gap).sum(1)
        order = np.argsort(square, kind="stable")
        return order, square[order]


def search(tree: Tree, points: np.ndarray, units: np.ndarray, point: np.ndarray, unit: np.ndarray,
           k: int, bound: float, factor: float, first: np.ndarray | None = None
           ) -> tuple[np.ndarray, np.ndarray]:
    """Rows and squared distances of the k nearest found; ``bound``: k-th best so far.

    Of rows at one distance (to ``_DIGITS``) those stay whose ``first`` (smallest id) is smallest.
    """
    rows, found = np.zeros(0, np.int64), np.zeros(0)
    leaves, squares = tree.near(point)
    at, step = 0, 4
    while at < len(leaves) and squares[at] <= factor * bound:
        own = np.concatenate([tree.order[leaf] for leaf in leaves[at:at + step]])
        gap = points[own] - point
        own = own[(gap * gap).sum(1) <= factor * bound]
        exact = np.maximum(2 - 2 * (units[own] @ unit), 0)
        rows, found = np.concatenate([rows, own]), np.concatenate([found, exact])
        if len(found) > k:
            ids = rows if first is None else first[rows]
            best = np.lexsort((ids, np.round(found, _DIGITS)))[:k]
            rows, found = rows[best], found[best]
        if len(found) == k:
            bound = min(bound, found.max())
        at, step = at + step, min(2 * step, 64)
    return rows, found


_GROUP = ["cell", "block"]
_FIELDS = "cell long, block int, kind int, node long, first long, bound double, vector binary, " + ", ".join(
    f"{a} double" for a in _AXES)


def _visit(points: DataFrame, asked: DataFrame, k: int, factor: float) -> DataFrame:
    """query, node, score: the k nearest classes found in each block for each query sent there."""
    both = points.withColumns({"kind": F.lit(0), "bound": F.lit(None).cast("double")})
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    rows = (both.select(names).unionAll(asked.withColumn("kind", F.lit(1)).select(names))
            .repartition(*_GROUP).sortWithinPartitions(*_GROUP, "kind", "node"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, members, tree = None, [], None
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            for a, b in _stretches(batch, [*_GROUP, "kind"]):
                part = batch.slice(a, b - a)
                here = tuple(part.column(c)[0].as_py() for c in _GROUP)
                if here != block:
                    block, members, tree = here, [], None
                if kinds[a] == 0:
                    members.append(part.select(["node", "first", "vector", *_AXES]))
                    continue
                if not members:
                    continue
                if tree is None:
                    whole = pa.Table.from_batches(members).combine_chunks()
                    place = np.stack([whole[x].to_numpy() for x in _AXES], 1)
                    vectors = _floats(whole["vector"].combine_chunks())
                    units, nodes, first = _unit(vectors), whole["node"].to_numpy(), whole["first"].to_numpy()
                    tree = Tree(place)
                yield from _answers(part, tree, place, vectors, units, nodes, first, k, factor)

    return rows.mapInArrow(scan, "query long, node long, first long, score double")


def _stretches(batch: pa.RecordBatch, keys: list[str]) -> list[tuple[int, int]]:
    change = np.zeros(max(0, batch.num_rows - 1), bool)
    for key in keys:
        value = batch.column(key).to_numpy()
        change |= value[1:] != value[:-1]
    edges = [0, *(np.flatnonzero(change) + 1), batch.num_rows]
    return [(int(a), int(b)) for a, b in zip(edges, edges[1:]) if b > a]


def _answers(part, tree, place, vectors, units, nodes, first, k, factor) -> Iterator[pa.RecordBatch]:
    asked = _floats(part.column("vector"))
    where = np.stack([part.column(x).to_numpy() for x in _AXES], 1)
    bounds = part.column("bound").to_numpy(zero_copy_only=False).astype(float)
    bounds = np.where(np.isnan(bounds), np.inf, bounds)
    out = ([], [], [], [])
    for i, (own, unit) in enumerate(zip(asked, _unit(asked))):
        rows, _ = search(tree, place, units, where[i], unit, k, bounds[i], factor, first)
        near = vectors[rows]
        big = np.abs(near).max(1, initial=0) * np.abs(own).max()
        if len(rows) and not (1e-100 < big.min() and big.max() < 1e100):
            near, own = near / np.abs(near).max(1, keepdims=True), own / np.abs(own).max()
        lengths = np.sqrt((near * near).sum(1)) * np.sqrt((own * own).sum())
        out[0].append(np.full(len(rows), part.column("node")[i].as_py()))
        out[1].append(nodes[rows])
        out[2].append(first[rows])
        out[3].append((near * own).sum(1) / lengths)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out],
                                     ["query", "node", "first", "score"])


def nearest(vectors: DataFrame, id_col: str, vector_col: str, asks: Column, k: int = 5,
            stop: float = STOP, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), <id_col>, score: the k nearest rows found for each row that asks.

    ``asks`` is a condition on the columns of ``vectors``; a row is never its own neighbour.
    """
    spark = vectors.sparkSession
    rows = (vectors.select(F.col(id_col).cast("long").alias("id"),
                           F.col(vector_col).cast("array<double>").alias("vector"),
                           F.coalesce(asks, F.lit(False)).alias("asks"))
            .filter(F.col("id").isNotNull() & _usable(F.col("vector"))))
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").head()
    if length is None:
        return spark.createDataFrame(
            [], f"query_id long, rank int, {id_col} long, score double")
    rows = rows.filter(F.size("vector") == length["n"])
    nodes = materialize(classes_of(rows, k + 1), "vectors")

    total = nodes.count()
    depth = min(int(CELLS).bit_length() - 1, max(0, (total // block).bit_length()))
    chosen = nodes.filter(F.pmod(F.xxhash64("node"), F.lit(total // SAMPLE + 1)) == 0)
    sample = np.array(chosen.select(_AXES).limit(2 * SAMPLE).collect()).reshape(-1, DIMS)
    levels = split_planes(sample, depth)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.stack([batch.column(a).to_numpy() for a in _AXES], 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell_of(points, levels)), *batch.columns], ["cell", *batch.schema.names])

    here = nodes.select("node", "first", "asks", "vector", *_AXES).mapInArrow(
        placed, "cell long, node long, first long, asks boolean, vector binary, "
        + ", ".join(f"{a} double" for a in _AXES))
    boxes = here.groupBy("cell").agg(F.count("*"), *map(F.min, _AXES), *map(F.max, _AXES)).collect()
    cells = np.array([b[0] for b in boxes])  # at most CELLS rows
    blocks = {b[0]: -(-b[1] // block) for b in boxes}
    lows = np.array([b[2:2 + DIMS] for b in boxes])
    highs = np.array([b[2 + DIMS:] for b in boxes])

    n_blocks = F.element_at(F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair]),
                            F.col("cell"))
    points = here.withColumn("block", F.pmod(F.hash("node"), n_blocks).cast("int"))
    queries = here.filter("asks")

    def everywhere(df: DataFrame) -> DataFrame:
        return df.withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1)))

    factor = stop_factor(stop)
    first = materialize(_visit(points, everywhere(queries.withColumn(
        "bound", F.lit(None).cast("double"))), k + 1, factor), "first")
    best = F.row_number().over(Window.partitionBy("query").orderBy(
        F.desc(F.round("score", _DIGITS)), "first", "node"))
    kth = (first.withColumn("n", best).filter(F.col("n") == k + 1)
           .select(F.col("query").alias("node"), (2 - 2 * F.col("score")).alias("bound")))

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.stack([batch.column(a).to_numpy() for a in _AXES], 1)
            bound = batch.column("bound").to_numpy(zero_copy_only=False).astype(float)
            bound = np.where(np.isnan(bound), np.inf, np.maximum(bound, 0) + 1e-12)
            own = batch.column("cell").to_numpy()
            for i, (low, high) in enumerate(zip(lows, highs)):
                gap = np.maximum(np.maximum(low - points, points - high), 0)
                go = np.flatnonzero(((gap * gap).sum(1) <= factor * bound) & (own != cells[i]))
                if len(go):
                    sent = batch.take(pa.array(go))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(go), cells[i])), pa.array(bound[go]),
                         *(sent.column(c) for c in ("node", "first", "vector", *_AXES))],
                        ["cell", "bound", "node", "first", "vector", *_AXES])

    further = queries.join(kth, "node", "left").select(
        "cell", "bound", "node", "first", "vector", *_AXES)
    further = further.mapInArrow(reached, "cell long, bound double, node long, first long, vector binary, "
                                 + ", ".join(f"{a} double" for a in _AXES))
    second = _visit(points, everywhere(further), k + 1, factor)

    ranked = first.unionAll(second).withColumn("n", best).filter(F.col("n") <= k + 1)
    known = nodes.select("node", "ids")
    answers = (ranked.join(known, "node").select("query", "score", F.explode("ids").alias("id"))
               .groupBy("query").agg(F.slice(F.array_sort(F.collect_list(
                   F.struct((-F.round("score", _DIGITS)).alias("about"), "id",
                            (-F.col("score")).alias("less")))), 1, 2 * k + 2).alias("near")))
    asked = (rows.filter("asks").select("id", "vector").distinct()
             .join(nodes.filter("asks").select(F.col("node").alias("query"),
                                               F.col("key").alias("vector")), "vector")
             .select(F.col("id").alias("query_id"), "query"))
    pairs = (asked.join(answers, "query").select("query_id", F.inline("near"))
             .filter("id <> query_id").groupBy("query_id", "id").agg(
                 F.min("about").alias("about"), F.min("less").alias("less")))
    order = Window.partitionBy("query_id").orderBy("about", "id")
    return (pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_col),
                    (-F.col("less")).alias("score")))
