import random

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import corpus, linking
from lexiloom.storage import Scratch


def plain(edges):
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
    return {x: find(x) for x in top}


@pytest.fixture
def tight(monkeypatch):
    """Chunks and hubs of a few edges, so that all steps are taken."""
    monkeypatch.setattr(linking, "CHUNK_EDGES", 3)
    monkeypatch.setattr(linking, "HOT_LEAST", 4)
    monkeypatch.setattr(linking, "HOT_SHARE", 0.01)


def shapes():
    rng = random.Random(5)
    chain = list(range(200))
    rng.shuffle(chain)
    yield "random", [(rng.randrange(150), rng.randrange(150)) for _ in range(120)]
    yield "chain", list(zip(chain, chain[1:], strict=False))
    yield "ordered chain", [(k, k + 1) for k in range(150)]
    yield "low hub", [(0, k) for k in range(1, 300)]
    yield "high hub", [(999, k) for k in range(300)] + [(k, k + 1_000) for k in range(0, 300, 7)]
    yield "two hubs", [(500, k) for k in range(200)] + [(501, k) for k in range(199, 400)]
    yield "odd", [(3, 3), (None, 4), (5, None), (7, 8), (8, 7), (7, 8)]
    yield "tree", [(k, k // 2) for k in range(1, 256)]


@pytest.mark.parametrize("name,edges", list(shapes()))
def test_components_of_many_shapes(spark, tight, name, edges):
    got = {r.node: r.component for r in linking.connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(5)).collect()}
    assert got == plain(edges)


def test_components_of_strings_and_of_nothing(spark, tight):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(90)}", f"n{rng.randrange(90)}") for _ in range(60)]
    assert {r.node: r.component for r in linking.connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()} == plain(edges)
    assert linking.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_joins_with_hot_keys_equal_plain_ones(spark, tight, how):
    rng = random.Random(2)
    rows = spark.createDataFrame([(rng.choice([1, 1, 1, 2, *range(3, 40), None]), k) for k in range(400)], "k long, x long")
    told = spark.createDataFrame([(k, f"v{k}") for k in range(0, 40, 2)] + [(1, "one")], "k long, v string")
    with Scratch(spark) as put:
        got = sorted(map(str, linking.joined_by_key(rows, told, "k", put, how).select("k", "x", "v").collect()))
    assert got == sorted(map(str, rows.join(told, "k", how).select("k", "x", "v").collect()))


def test_a_hub_is_in_many_tasks(spark):
    """The rows that a step gives for a hub of 60,000 edges, by task."""
    edges = spark.range(60_000).select((F.col("id") + 1).alias("hi"), F.lit(0).cast("long").alias("lo")).unionByName(spark.range(500).select((F.col("id") + 100_000).alias("hi"), (F.col("id") + 99_000).alias("lo"))).repartition(12)
    with Scratch(spark) as put:
        out = linking.joined_by_key(put(edges, "edges"), edges.groupBy("lo").agg(F.min("hi").alias("least")), "lo", put)
        sizes = sorted(r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert sum(sizes) == 60_500 and sizes[-1] < 5 * 60_500 / 12


def test_families_by_any_key(spark, tight):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, *"abcdefghij"]) if k % 3 else None, f"g{rng.randrange(60)}", "same" if k % 9 == 0 else None) for k in range(120)]
    keys = {"one": F.col("one"), "two": F.col("two"), "three": F.col("three")}
    got = {r.id: r.family for r in corpus.record_families(spark.createDataFrame(rows, "rid long, one string, two string, three string"), keys, "rid").collect()}
    nodes = {}
    for k, *values in rows:
        for n, v in enumerate(values):
            if v is not None:
                nodes.setdefault((n, v), []).append(k)
    want = plain([(k, k) for k, *_ in rows] + [(v[0], x) for v in nodes.values() for x in v])
    assert got == want


def test_no_step_sends_a_whole_table_through_the_driver(spark, monkeypatch):
    """Joins of tables whose files are small, but for hubs, are not broadcast."""
    seen, real = [], linking.Scratch.__call__

    def planned(self, df, name):
        seen.append(df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin"))
        return real(self, df, name)

    monkeypatch.setattr(linking.Scratch, "__call__", planned)
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(k, k + 100) for k in range(30)], "src long, dst long").repartition(5)
    assert {r.node: r.component for r in linking.connected_components(edges).collect()} == plain([tuple(r) for r in edges.collect()])
    assert len(seen) >= 3 and sum(seen) == 0
