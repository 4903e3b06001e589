"""Connected components over plain edge lists, and joins whose hot keys are split off."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.storage import Scratch

#: A key is hot that has more than this share of all rows, and so many at least; there are no more of them than the share's inverse.
HOT_SHARE, HOT_LEAST = 1 / 1_000, 1_000
#: Edges that a task contracts at once.
CHUNK_EDGES = 500_000


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """The hot keys of a column, at most a thousand."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    total = rows.count()
    return counts.where(F.col("_n") > max(HOT_LEAST, total * HOT_SHARE)).select(key)


def joined_by_key(rows: DataFrame, told: DataFrame, key: str, put: Scratch, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``told``, which has one row a key, so that no task gets all rows of a hot key.

    What is told of hot keys is broadcast, at most a thousand rows; the other rows meet by a shuffle, also where Spark would take
    the table for small by its compressed files and send all of it through the driver.
    """
    by_shuffle = told.hint("merge")
    hot = put(hot_keys(rows, key), "hot-keys")
    if hot.isEmpty():
        return rows.join(by_shuffle, key, how)
    warm = rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(told.join(hot, key, "left_semi")), key, how)
    return warm.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(by_shuffle, key, how))


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hi, lo: edges of every node of a chunk to the smallest one that the chunk connects it with."""
    top: dict = {}

    def find(x):
        while (up := top.setdefault(x, x)) != x:
            top[x] = x = top[up]
        return x

    def stars(schema: pa.Schema):
        nodes = list(top)
        roots = [find(x) for x in nodes]
        keep = [i for i, x in enumerate(nodes) if roots[i] != x]
        top.clear()
        for at in range(0, len(keep), 50_000):
            part = keep[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in part], schema.types[0]), pa.array([roots[i] for i in part], schema.types[1])], names=["hi", "lo"])

    met, schema = 0, None
    for batch in batches:
        schema = batch.schema
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (a := find(x)) != (b := find(y)):
                top[max(a, b)] = min(a, b)
        met += batch.num_rows
        if met >= CHUNK_EDGES:
            yield from stars(schema)
            met = 0
    if schema is not None:
        yield from stars(schema)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", owner: Scratch | None = None) -> DataFrame:
    """node, component: for every node of an undirected edge list, the smallest node that it reaches.

    Null ends make no edge. Every edge goes from its larger to its smaller end. Tasks first contract the edges that they hold to
    stars. Then large and small stars alternate: an edge moves to the smallest neighbour of its smaller end, and the smaller ends of one node
    move to the smallest of them; what two nodes reach stays the same, and the smaller ends only fall. It ends when no smaller end is
    itself the larger end of an edge: all edges then go to the component's smallest node. Both steps sum by key map-side and join one row a key,
    with hubs split off (``joined_by_key``), so a node of any degree spreads over the tasks. Edges live in the shared folder between the steps and meet by shuffles alone, so only
    a flag, the hubs' check and what is told of hubs come to the driver. Nodes may be of any type with an order; numbers are cheapest. The result reads a table, which
    ``owner`` deletes if given.
    """
    order = F.when(F.col("u") > F.col("v"), F.struct(F.col("u").alias("hi"), F.col("v").alias("lo"))).otherwise(F.struct(F.col("v").alias("hi"), F.col("u").alias("lo")))
    with Scratch(edges.sparkSession) as put:
        whole = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("u"), F.col(dst).alias("v"))
        whole = put(whole.select(F.inline(F.array(order))).distinct(), "cc-edges")
        kind = whole.schema["hi"].dataType.simpleString()
        found = put(whole.where("hi <> lo").mapInArrow(_contracted, f"hi {kind}, lo {kind}").distinct(), "cc-stars")
        while not found.select(F.col("lo").alias("hi")).join(found.hint("merge"), "hi", "left_semi").isEmpty() or not found.groupBy("hi").agg(F.min("lo").alias("a"), F.max("lo").alias("b")).where("a <> b").isEmpty():
            least = put(found.groupBy("hi").agg(F.min("lo").alias("least")), "cc-least")
            # large star: (hi, lo) to (hi, the smallest below lo)
            large = joined_by_key(found, least.select(F.col("hi").alias("lo"), "least"), "lo", put, "left")
            old, found = found, put(large.select("hi", F.coalesce("least", "lo").alias("lo")).distinct(), "cc-large")
            put.drop(old, least)
            # small star: all of a node's smaller ends, and the node, to the smallest of them
            least = put(found.groupBy("hi").agg(F.min("lo").alias("least")), "cc-least")
            small = joined_by_key(found, least, "hi", put)
            small = small.select(F.inline(F.array(F.struct("hi", "least"), F.struct(F.col("lo").alias("hi"), "least"))).alias("hi", "lo"))
            old, found = found, put(small.where("hi <> lo").distinct(), "cc-small")
            put.drop(old, least)
        nodes = whole.select(F.explode(F.array("hi", "lo")).alias("node")).distinct()
        out = put(nodes.join(found.select(F.col("hi").alias("node"), "lo").hint("merge"), "node", "left").select("node", F.coalesce("lo", "node").alias("component")), "cc-found")
        return put.keep(out) if owner is None else put.give(out, owner)
