import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import trie
from lexiloom.llm.queries import ORACLE

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in by.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        top = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = tuple(turns.get(top, [])[:h] + own[h:])
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        leaves = 0 if children[node] else 1
        for x in children[node]:
            saved, leaves = saved + sums[x][0], leaves + sums[x][1]
        sums[node] = saved, leaves
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in convs if len(built[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        out.append((convs[0], len(node), parent, len(convs), len(children[node]), sums[node][1], sums[node][0], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def random_rows(rng, convs, texts, most):
    rows = []
    for c in convs:
        for turn in range(rng.randrange(most + 1) or 1):
            rows.append((c, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(texts)))
    return rows


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.fixture
def small(monkeypatch):
    for name, value in (("BLOCK", 3), ("ENDS", 4), ("HOT_LEAST", 2), ("HOT_SHARE", 0.01)):
        monkeypatch.setattr(trie, name, value)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_conversations(spark, small, seed):
    rng = random.Random(seed)
    texts = [None, "", "a", "b\nc", "long text é😀 " * seed]
    convs = [*range(0, 230, rng.choice([1, 2])), 400, 1_000_001, -7, -150]
    rows = random_rows(rng, convs, texts, [3, 7, 12][seed - 1]) + [(None, 1, "user", "x")] * 3
    rows += [(600, t, "user", "a") for t in range(60)] + [(601, t, "user", "a") for t in range(60)] + [(602, 0, "user", "same")] * 30
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], SCHEMA + ", depth long, ka string").repartition(5)
    out = trie.prefix_trie(df)
    assert got(out) == plain(rows)
    assert out.select("depth", "ka", "kb").distinct().count() == out.count()


def test_many_copies_and_conversations_without_turns(spark, small):
    rows = [(c, t, "user", f"t{t}") for c in range(300) for t in range(2)]
    assert got(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    alone = [(c, 0, "user", "x") for c in range(1, 99)]
    assert any(r[1] == 0 and r[3] == 98 for r in plain(alone)) and got(trie.prefix_trie(spark.createDataFrame(alone, SCHEMA))) == plain(alone)


def test_empty_table(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_conversation_in_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(5, t, "user", f"turn {t % 7}") for t in range(400)] + [(c, t, "user", "other") for c in (4, 6) for t in range(3)]
        turns = trie.summed_turns(spark.createDataFrame(rows, SCHEMA).repartition(8))
        assert turns.where("conv = 5").select("part").distinct().count() > 3
        told = trie.carried(turns.cache()).where("conv = 5").orderBy("place").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [r.place for r in told] == list(range(400)) and all(a.after_a == b.before_a and a.after_b == b.before_b for a, b in zip(told, told[1:], strict=False))
    sums = 0
    for t, r in enumerate(told):
        said = hashlib.sha256(f"4:userturn {t % 7}".encode()).digest()
        sums = (sums + int.from_bytes(said[:8], "little") * pow(trie.BASES[0], t, 1 << 64)) % (1 << 64)
        assert r.after_a % (1 << 64) == sums


def test_suffix_sums_in_blocks(spark):
    rows = [(p, d, 10 * p + d) for p in range(3) for d in range(2, 30 * p + 4)]
    told = trie.suffix_sums(spark.createDataFrame(rows, "p long, d long, x long"), ["p"], "d", ["x"], block=4).collect()
    assert {(r.p, r.d): r.x for r in told} == {(p, d): sum(10 * p + k for q, k, _ in rows if q == p and k >= d) for p, d, _ in rows}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_conversations_match_the_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('/root/testdata/{sf}/conversations.parquet')")
    told = con.execute(ORACLE["op11_prefix_trie"])
    places = [[d[0] for d in told.description].index(c) for c in COLUMNS]
    want = sorted((tuple(r[i] for i in places) for r in told.fetchall()), key=str)
    df = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet")
    rows = [tuple(r) for r in df.select(*[F.col(c) for c in ("conv_id", "turn", "role", "text")]).collect()]
    assert got(trie.prefix_trie(df)) == want == plain(rows)
