"""Exact top-k search by inner product with KD-trees per shard.

Equal vectors are one entry, with their smallest ids as far as a result can hold them. Entries are
dealt into shards by a top tree of median splits, fitted on a bounded sample, so that a shard's
vectors lie together; an over-full leaf of it is split by a hash. A shard's entries form a KD-tree by median
splits of the widest dimension, each node with a tight bounding box. A query walks a tree best
first: the largest inner product that a box admits is a bound for all its vectors, and the walk
ends when no box can reach the kth score any more.

Each query first searches its own shard. The kth score found there goes with it: the root boxes of
all shards, two vectors a shard, refuse the query where they cannot reach that score, and only to the other
shards is it sent, where the score prunes from the root on.

Queries meet shards and boxes in blocks of bounded size: a task holds one shard, or one block of boxes, and one
block of queries.

Defined results: vectors that are null, empty or have null or non-finite components take no part; a query
is compared with vectors of its own dimension; rows that share the query's id are its own; a repeated id
stands for its best row and takes one place of a result, as a query too; ties go to the smaller id; an empty
table gives an empty result; other columns are left aside.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.storage import Scratch

#: Vectors of a leaf and of a shard, queries of a block, boxes of a block, and vectors that the top tree is fitted on.
LEAF, SHARD_ROWS, BLOCK_ROWS, BOX_ROWS, SAMPLE_ROWS = 64, 8_192, 4_096, 1_024, 16_384


class KdTree:
    """Tree over distinct integer vectors, each with the ids that it stands for."""

    def __init__(self, vectors: np.ndarray, ids: list, leaf: int = LEAF):
        self.points = vectors
        self.ids = ids
        self.low, self.high, self.children, self.ranges = [], [], [], []
        self.order = np.arange(len(self.points))
        self._build(0, len(self.points), leaf)
        self.points = self.points[self.order]
        self.ids = [self.ids[i] for i in self.order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _build(self, lo: int, hi: int, leaf: int) -> int:
        own = self.points[self.order[lo:hi]]
        low, high = own.min(0), own.max(0)
        node = len(self.low)
        self.low.append(low)
        self.high.append(high)
        self.children.append(None)
        self.ranges.append((lo, hi))
        if hi - lo > leaf:
            middle = (hi - lo) // 2
            part = np.argpartition(own[:, int(np.argmax(high - low))], middle)
            self.order[lo:hi] = self.order[lo:hi][part]
            self.children[node] = (self._build(lo, lo + middle, leaf), self._build(lo + middle, hi, leaf))
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product that each node's box admits, by query and node."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, bounds: list, own: int, k: int, least) -> list[tuple]:
        """The (score, id) of the k best other ids, each by its best vector, with a score of ``least`` or more, best first."""
        best: dict[int, int] = {}
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < least:
                break
            if self.children[node] is not None:
                for child in self.children[node]:
                    if bounds[child] >= least:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            lo, hi = self.ranges[node]
            scores = self.points[lo:hi] @ query
            for i in np.flatnonzero(scores >= least).tolist():
                score = int(scores[i])
                for j in self.ids[lo + i]:
                    if j != own and score > best.get(j, -np.inf):
                        best[j] = score
            if len(best) > k:
                best = dict(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])
            if len(best) == k:
                least = max(least, min(best.values()))
        return [(score, j) for j, score in sorted(best.items(), key=lambda x: (-x[1], x[0]))]


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, dim, vector array<long> of floor(scale * x) for the usable vectors."""
    x = F.col(vector_col)
    usable = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(usable & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"),
        F.size(x).alias("dim"),
        F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))).alias("vector"),
    )


def entries_of(rows: DataFrame, k: int) -> DataFrame:
    """dim, vector, ids: the distinct vectors, each with its k + 1 smallest distinct ids.

    Repeated rows are removed map-side first, and a window below a bound is limited in each task before its shuffle.
    """
    place = F.row_number().over(Window.partitionBy("dim", "vector").orderBy("id"))
    once = rows.select("dim", "vector", "id").distinct().withColumn("place", place).where(F.col("place") <= k + 1)
    return once.groupBy("dim", "vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))


class TopTree:
    """Median splits of a sample, as arrays; ``leaves`` tells the leaf of each vector."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.axis, self.value, self.children, self.leaf = [], [], [], []
        self.n = 0
        self._build(sample, leaves)

    def _build(self, own: np.ndarray, leaves: int) -> int:
        node = len(self.axis)
        self.axis.append(-1)
        self.value.append(0)
        self.children.append((0, 0))
        self.leaf.append(-1)
        axis = int(np.argmax(own.max(0) - own.min(0))) if len(own) else 0
        value = np.sort(own[:, axis])[len(own) // 2] if len(own) else 0
        right = own[:, axis] >= value if len(own) else np.zeros(0, bool)
        if leaves < 2 or len(own) < 8 or right.all() or not right.any():
            self.leaf[node] = self.n
            self.n += 1
            return node
        self.axis[node], self.value[node] = axis, int(value)
        self.children[node] = (self._build(own[~right], leaves // 2), self._build(own[right], leaves - leaves // 2))
        return node

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        axis, value, children, leaf = np.array(self.axis), np.array(self.value), np.array(self.children), np.array(self.leaf)
        at = np.zeros(len(vectors), np.int64)
        while (inner := np.flatnonzero(axis[at] >= 0)).size:
            own = at[inner]
            at[inner] = children[own, (vectors[inner, axis[own]] >= value[own]).astype(int)]
        return leaf[at]


def _longs(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _with_leaves(trees: dict[int, TopTree], entries: DataFrame) -> DataFrame:
    """``entries`` with the column leaf; vectors of a dimension that the sample lacks are in leaf 0."""
    sent = entries.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]):
        known = sent.value
        for batch in batches:
            dims = batch.column(0).to_numpy()
            leaf = np.zeros(len(dims), np.int64)
            for dim in np.unique(dims).tolist():
                if dim in known:
                    own = np.flatnonzero(dims == dim)
                    leaf[own] = known[dim].leaves(_longs(batch.column(1).take(pa.array(own)), dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["dim", "vector", "ids", "leaf"])

    return entries.select("dim", "vector", "ids").mapInArrow(run, "dim int, vector array<bigint>, ids array<bigint>, leaf long")


def _sharded(entries: DataFrame, rows: int) -> DataFrame:
    """``entries`` with shard, a name of at most about SHARD_ROWS vectors of one leaf of the top tree.

    The sample is of at most SAMPLE_ROWS entries, those that come first by a hash of their vectors.
    """
    sample = entries.select("dim", "vector").orderBy(F.xxhash64("vector"), "dim").limit(SAMPLE_ROWS).toArrow()
    dims = sample["dim"].to_numpy()
    trees = {}
    for dim in np.unique(dims).tolist():
        own = np.flatnonzero(dims == dim)
        trees[dim] = TopTree(_longs(sample["vector"].take(pa.array(own)), dim), max(1, -(-rows * len(own) // (len(dims) * SHARD_ROWS))))
    placed = _with_leaves(trees, entries)
    parts = placed.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / SHARD_ROWS).alias("parts"))
    part = F.pmod(F.xxhash64("vector"), F.col("parts"))
    return placed.join(parts, ["dim", "leaf"]).select("dim", "vector", "ids", F.xxhash64("leaf", part).alias("shard"))


def _boxes(entries: DataFrame) -> DataFrame:
    """dim, shard, low, high: the root box of each shard, from partial boxes of each batch."""
    ddl = "dim int, shard long, low array<bigint>, high array<bigint>"
    names = ["dim", "shard", "low", "high"]

    def rows(found: list[tuple]) -> pa.Table:
        columns = list(zip(*found, strict=True)) or [[], [], [], []]
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.Table.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], names=names)

    def partial(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            dims, shards = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found = []
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                own = own[np.argsort(shards[own], kind="stable")]
                x = _longs(batch.column(2).take(pa.array(own)), dim)
                name, start = np.unique(shards[own], return_index=True)
                for shard, low, high in zip(name.tolist(), np.minimum.reduceat(x, start).tolist(), np.maximum.reduceat(x, start).tolist(), strict=True):
                    found.append((dim, shard, low, high))
            yield from rows(found).to_batches()

    def whole(group: pa.Table) -> pa.Table:
        dim = group["dim"][0].as_py()
        return rows([(dim, group["shard"][0].as_py(), _longs(group["low"], dim).min(0).tolist(), _longs(group["high"], dim).max(0).tolist())])

    return entries.select("dim", "shard", "vector").mapInArrow(partial, ddl).groupBy("dim", "shard").applyInArrow(whole, ddl)


def _matrix(table: pa.Table) -> np.ndarray:
    values = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    whole = values.astype(np.int64).reshape(table.num_rows, -1)
    # float64 products of such integers are exact, and faster
    return whole.astype(np.float64) if len(whole) and float(np.abs(whole).max()) ** 2 * whole.shape[1] < 2**52 else whole


_RESULT = "query_id long, vec_id long, score long"
_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_ASKED = "id long, dim int, vector array<bigint>, least long, shard long"
_ASKED_SCHEMA = pa.schema([("id", pa.int64()), ("dim", pa.int32()), ("vector", pa.list_(pa.int64())), ("least", pa.int64()), ("shard", pa.int64())])


def _bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def _reached():
    """The (query, shard) pairs of a block of queries and a block of boxes whose bound reaches the query's kth score, but its own shard."""

    def run(boxes: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if boxes.num_rows and queries.num_rows:
            dim = queries["dim"][0].as_py()
            low, high, shards = _longs(boxes["low"], dim), _longs(boxes["high"], dim), boxes["shard"].to_numpy()
            x, homes = _longs(queries["vector"], dim), queries["home"].to_numpy()
            least = queries["least"].fill_null(-(1 << 63)).to_numpy()
            for lo in range(0, len(x), 512):
                row, col = np.nonzero((_bounds(x[lo : lo + 512], low, high) >= least[lo : lo + 512, None]) & (homes[lo : lo + 512, None] != shards[None, :]))
                sent = queries.slice(lo, 512).select(["id", "dim", "vector", "least"]).take(pa.array(row))
                out.append(sent.append_column("shard", pa.array(shards[col])).cast(_ASKED_SCHEMA))
        return pa.concat_tables(out) if out else _ASKED_SCHEMA.empty_table()

    return run


def _search_shard(k: int):
    def run(shard: pa.Table, queries: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if shard.num_rows and queries.num_rows:
            points, wanted = _matrix(shard), _matrix(queries)
            if points.dtype != wanted.dtype:
                points, wanted = points.astype(np.int64), wanted.astype(np.int64)
            tree = KdTree(points, shard["ids"].to_pylist())
            least = queries["least"].to_pylist()
            for lo in range(0, len(wanted), 512):
                bounds = tree.bounds(wanted[lo : lo + 512])
                for i, own in enumerate(queries["id"].slice(lo, 512).to_pylist()):
                    start = least[lo + i] if least[lo + i] is not None else -np.inf
                    rows += [(own, j, score) for score, j in tree.search(wanted[lo + i], bounds[i].tolist(), own, k, start)]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_SCHEMA)

    return run


def _ranked(found: DataFrame) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))


def exact_top_k(vectors: DataFrame, queries: Column, k: int, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query row with the other rows.

    ``queries`` is a condition on the id column. The quantised vectors are written once to the
    shared folder; each shard and each block of queries then travels to the tasks that pair them.
    """
    with Scratch(vectors.sparkSession) as put:
        whole = put(quantized(vectors.select(id_col, vector_col), id_col, vector_col, scale), "kd-vectors")
        entries = put(entries_of(whole, k), "kd-entries")
        entries = put(_sharded(entries, entries.count()), "kd-shards")
        asked = whole.select(F.col("id").alias(id_col), "dim", "vector").where(queries).withColumnRenamed(id_col, "id").distinct()
        asked = put(asked.join(entries.select("dim", "vector", F.col("shard").alias("home")), ["dim", "vector"]).select("id", "dim", "vector", "home"), "kd-queries")
        asking, shards = asked.count(), entries.select("dim", "shard").distinct().count()
        blocks, boxes = max(1, -(-asking // BLOCK_ROWS)), max(1, -(-shards // BOX_ROWS))

        def block(number: int, *by: str) -> Column:
            return F.pmod(F.xxhash64(F.lit("block"), *by), F.lit(number)).cast("int")

        def every(df: DataFrame, name: str, number: int) -> DataFrame:
            return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(number - 1)))) if number > 1 else df.withColumn(name, F.lit(0))

        key = ["dim", "shard", "block"]
        dealt = every(entries, "block", blocks)

        def found(wanted: DataFrame) -> DataFrame:
            sent = wanted.withColumn("block", block(blocks, "id", "vector")).select("id", "vector", "least", *key)
            return dealt.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(_search_shard(k), _RESULT)

        first = put(found(asked.withColumn("shard", F.col("home")).withColumn("least", F.lit(None).cast("long"))), "kd-home")
        if shards > 1:
            kth = _ranked(first).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
            known = every(asked.join(kth, "id", "left"), "part", boxes).withColumn("block", block(blocks, "id", "vector"))
            roots = every(put(_boxes(entries), "kd-boxes").withColumn("part", block(boxes, "shard")), "block", blocks)
            near = ["dim", "part", "block"]
            others = roots.groupBy(*near).cogroup(known.select("id", "vector", "least", "home", *near).groupBy(*near)).applyInArrow(_reached(), _ASKED)
            first = first.unionByName(found(put(others, "kd-pairs")))
        return put.keep(put(_ranked(first).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "kd-found"))
