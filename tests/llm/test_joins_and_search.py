import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import brute

from lexiloom.llm import induced, jaccard, kdtree, lsh, suffixdedup
from lexiloom.storage import Scratch


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def corpus(rng, n):
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice([2, 6, 20, 60, 150]))] for _ in range(12)]
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, "one"), (6, "One  two\tthree")]
    for i in range(n):
        own = list(rng.choice(base))
        for _ in range(rng.randrange(0, 1 + len(own) // 12)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((10 + i, " ".join(own)))
    return rows


@pytest.mark.parametrize("percent,n", [(85, 4), (80, 5)])
def test_jaccard_components_match_brute_force(spark, percent, n, monkeypatch):
    rows = corpus(random.Random(percent), 220)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 16)
    monkeypatch.setattr(jaccard, "LIST_MEMBERS", 8)
    sizes, want = brute.jaccard_components(rows, n, percent)
    got = jaccard.similar_classes(texts(spark, rows).withColumn("key", F.lit(1)), n, percent).collect()
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(got) == len(rows)


def test_jaccard_of_one_large_group_of_near_copies(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(900)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(300):
        own = list(base)
        for _ in range(rng.randrange(0, 9)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, " ".join(own)))
    _, want = brute.jaccard_components(rows)
    got = {r.doc_id: r.component_id for r in jaccard.similar_classes(texts(spark, rows)).collect()}
    assert got == want


def test_jaccard_repeated_rows_and_empty_table(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (None, "a b c d e f")]
    got = jaccard.similar_classes(texts(spark, rows)).collect()
    assert [r.component_id for r in got] == [1, 1, 1, 1]
    assert jaccard.similar_classes(texts(spark, [])).count() == 0


def test_jaccard_of_ids_with_several_texts(spark):
    a, b, c = "a b c d e f g", "one two three four five six", "x y z u v w"
    rows = [(3, a), (5, a), (5, b), (9, b), (9, c), (11, c), (20, "apart from all of them"), (30, None), (5, None)]
    got = {(r.doc_id, r.component_id) for r in jaccard.similar_classes(texts(spark, rows)).collect()}
    assert got == {(3, 3), (5, 3), (9, 3), (11, 3), (20, 20), (30, 30), (5, 5)}
    hub = [(1, f"w{k} w{k} only here {k} {k} {k}") for k in range(300)] + [(k + 10, f"w{k} w{k} only here {k} {k} {k}") for k in range(300)]
    assert {r.component_id for r in jaccard.similar_classes(texts(spark, hub)).collect()} == {1}


@pytest.mark.parametrize("block,batch,depth", [(1 << 18, 1 << 15, 128), (7, 5, 2), (64, 3, 0)])
@pytest.mark.parametrize("budget", [0, 1 << 30])
def test_suffix_arrays_and_common_prefixes_in_memory_and_on_disk(monkeypatch, block, batch, depth, budget):
    for name, value in (("BLOCK", block), ("BATCH", batch), ("DEPTH", depth)):
        monkeypatch.setattr(induced, name, value)
    rng = np.random.default_rng(2)
    texts = [np.append(rng.integers(1, letters + 1, n), 0) for n in (0, 2, 5, 40, 400) for letters in (1, 2, 20, 300)]
    texts.append(np.concatenate([[1] * 90, [2] * 90, [1] * 60, [0]]))
    pieces = [rng.integers(1, 5, rng.integers(1, 30)) for _ in range(5)]
    texts.append(np.concatenate([*(pieces[rng.integers(5)] for _ in range(60)), [0]]))
    for text in texts:
        want = sorted(range(len(text)), key=lambda i, t=text.tolist(): t[i:])
        shared = [0]
        for a, b in zip(want, want[1:], strict=False):
            own = text[a:][: len(text) - b] == text[b:][: len(text) - a]
            shared.append(min(int(np.argmin(np.append(own, False))), 50))
        with induced.Store(budget) as store:
            order, common = induced.suffix_order(store, text, int(text.max()) + 1, 50)
            assert order.tolist() == want and common.tolist() == shared
            assert bool(store.folder) == (budget == 0)


def coded(strings):
    return np.concatenate([np.append(np.frombuffer(s, np.uint8).astype(np.int16), np.int16(-1)) for s in strings])


@pytest.mark.parametrize("budget,block", [(1 << 30, 1 << 18), (0, 64)])
def test_first_owners_of_repeated_strings(monkeypatch, budget, block):
    monkeypatch.setattr(induced, "BLOCK", block)
    rng = np.random.default_rng(3)
    strings = [bytes(rng.integers(97, 99, rng.integers(0, 50)).astype(np.uint8)) for _ in range(30)]
    owners = rng.integers(0, 99, 30)
    best = {}
    for s, o in zip(strings, owners, strict=True):
        for i in range(len(s) - 5):
            best[s[i : i + 6]] = min(best.get(s[i : i + 6], 99), o)
    with induced.Store(budget) as store:
        got = list(induced.repeats(iter([(coded(strings[:7]), owners[:7]), (coded(strings[7:]), owners[7:])]), 6, store))
    assert [c for _, count in got for c in count.tolist()] == [max(0, len(s) - 5) for s in strings]
    assert np.concatenate([found for found, _ in got]).tolist() == [best[s[i : i + 6]] for s in strings for i in range(len(s) - 5)]


def passages(rng):
    shared = ["".join(rng.choice("abc é") for _ in range(k)) for k in (49, 50, 51, 80, 200)]
    rows = [(1, None), (2, ""), (3, "x" * 49), (4, "ab" * 90), (5, "ba" * 90), (40, "copy " * 30), (41, "copy " * 30), (41, "copy " * 30)]
    for i in range(80):
        parts = ["".join(rng.choice("defghi ") for _ in range(rng.randrange(0, 60))), rng.choice(shared), "".join(rng.choice("jklm\n") for _ in range(rng.randrange(0, 30)))]
        rows.append((100 + i, "".join(rng.sample(parts, 3))))
    return rows


@pytest.mark.parametrize("hot,budget", [(1 << 15, 1 << 30), (3, 1 << 30), (1 << 15, 0)])
def test_suffix_dedup_matches_brute_force(spark, monkeypatch, hot, budget):
    monkeypatch.setattr(suffixdedup, "HOT_LEAST", hot)
    monkeypatch.setattr(suffixdedup, "HOT_SHARE", 10**9)
    monkeypatch.setattr(induced, "BUDGET", budget)
    rows = passages(random.Random(8))
    want = brute.kept_bytes(list(dict(rows).items()))
    got = suffixdedup.dedup_digests(texts(spark, rows).withColumn("doc", F.lit(1))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r


def test_suffix_dedup_of_a_shard_far_larger_than_its_memory(spark):
    """All stretches in one shard of some 3 MB, sorted with 256 KB."""
    rng = random.Random(3)
    lines = ["".join(rng.choice("abcdefghij klmnop") for _ in range(rng.randrange(40, 120))) for _ in range(400)]
    rows = [(i, " ".join(rng.sample(lines, 8))) for i in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    before = suffixdedup.SHARD_BYTES
    try:
        suffixdedup.SHARD_BYTES = 1 << 30
        spans = suffixdedup.removed_spans(texts(spark, rows), budget=256 << 10).collect()
    finally:
        suffixdedup.SHARD_BYTES = before
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = brute.kept_bytes(rows)
    got = {r.doc: sum(b - a for a, b in suffixdedup.merged([(s["start"], s["stop"]) for s in r.spans])) for r in spans}
    assert got == {i: gone for i, (_, gone, _, _) in want.items() if gone}


def test_suffix_dedup_of_null_and_shared_ids_and_clashing_names(spark):
    shared = "x" * 20 + "shared passage of more than fifty bytes in all of them" + "y" * 9
    rows = [(None, shared + "a", 1), (None, shared + "b", 2), (7, "c" + shared, 3), (7, "d" + shared, 4), (9, "e" + shared, 5), (9, "e" + shared, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc long").withColumns({c: F.lit(c) for c in ("tag", "spans", "_doc", "_text_key", "_spans", "place")})
    out = suffixdedup.deduplicated(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.text, r.doc, r.tag) for r in out.collect()) == [(0, "a", 1, "tag"), (0, "b", 2, "tag"), (7, "c" + shared, 3, "tag"), (7, "d" + shared, 4, "tag"), (9, "e", 5, "tag"), (9, "e", 5, "tag")]


def test_suffix_dedup_of_a_very_long_text(spark):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh \n") for _ in range(900_000))
    rows = [(1, long), (2, long[300_000:300_080] + "!"), (3, "z" * 700_000)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffixdedup.dedup_digests(texts(spark, rows)).collect()}
    assert got == {1: (900_000, 0, 0), 2: (81, 80, 1), 3: (700_000, 0, 0)}


def test_stretches_without_a_partner_are_not_sorted(spark):
    """Words that many documents share, between words of their own, hold no repeated string of 50 bytes."""
    rng = random.Random(11)
    common = ["".join(rng.choice("abcdefgh") for _ in range(26)) for _ in range(40)]
    own = lambda: "".join(rng.choice("stuvwxyz") for _ in range(30))
    rows = [(i, " ".join(x for _ in range(12) for x in (rng.choice(common), own()))) for i in range(60)]
    found, partners = [], suffixdedup.Partners(50, 20)
    for data in (x.encode() for _, x in rows):
        raw = np.frombuffer(data, np.uint8)
        _, at, size, _ = suffixdedup.minimizers(raw, np.array([0, len(raw)]), 50)
        found.append((b"".join(data[a : a + n + 49] for a, n in zip(at, size, strict=True)), np.concatenate([[0], np.cumsum(size + 49)])))
    keys = [partners.keys(np.frombuffer(data, np.uint8), ends) for data, ends in found]
    for i, told in enumerate(keys):
        partners.add(told, np.full(len(told), i))
    assert sum(partners.several(x).sum() for x in keys) < sum(map(len, keys)) / 10
    rows += [(100 + i, own() + rows[i][1][200:300] + own()) for i in range(5)]
    rows += [(200, "ab" * 60), (201, "x" + "ab" * 40), (202, "ab" * 24 + "a" * 200), (203, "a" * 90)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.dedup_digests(texts(spark, rows)).collect()}
    assert got == {i: tuple(x) for i, x in brute.kept_bytes(rows).items()} and sum(x[1] for x in got.values()) > 500


def test_deduplicated_texts_keep_whole_characters(spark):
    shared = "é" * 40
    df = spark.createDataFrame([(1, "a" + shared + "b", 42, "s"), (2, "cé" + shared + "éd", 44, "s"), (3, "tiny", 4, "s"), (4, None, 0, "s"), (5, "a" + shared + "b", 42, "s")], "doc_id long, text string, n_chars long, source string")
    got = {r.doc_id: (r.text, r.n_chars, r.source) for r in suffixdedup.deduplicated(df, length_col="n_chars").collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1][0] == "a" + shared + "b" and got[3] == ("tiny", 4, "s") and got[4][0] is None
    assert got[2][0].startswith("c") and got[2][0].endswith("d") and len(got[2][0]) == got[2][1] < 10


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")


def made(n, d=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)).astype(np.float32)
    x[n // 2 : n // 2 + n // 3] = x[0]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(n + 100, None, 1), (n + 200, [], 1), (n + 300, [float("nan")] * d, 1), (n + 400, [None] + [1.0] * (d - 1), 1)]
    return x, rows


def best(scores, own, k):
    ids = [i for i in np.lexsort((np.arange(len(scores)), -scores)) if i != own][:k]
    return [(int(i), scores[i]) for i in ids]


def test_kdtree_search_is_exact(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "SHARD_ROWS", 90)
    monkeypatch.setattr(kdtree, "BLOCK_ROWS", 5)
    x, rows = made(400)
    q = np.floor(x.astype(np.float64) * 256).astype(np.int64)
    got = {}
    for r in kdtree.exact_top_k(vectors(spark, rows), F.col("vec_id") % 20 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 400, 20))
    for key, found in got.items():
        assert [(i, s) for _, i, s in sorted(found)] == best(q @ q[key], key, 5)


def test_lsh_scores_are_exact_and_recall_is_high(spark, monkeypatch):
    monkeypatch.setattr(lsh, "GROUP_ROWS", 100)
    x, rows = made(600, 16, 1)
    e = x.astype(np.float64)
    got, hit = {}, 0
    for r in lsh.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for key in range(0, 600, 20):
        scores = e @ e[key]
        want = {i for i, _ in best(scores, key, 20)}
        found = sorted(got[key])
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(abs(s - scores[i]) < 1e-9 for _, i, s in found)
        hit += len(want & {i for _, i, _ in found})
    assert hit / 600 >= 0.9


@pytest.mark.parametrize("n,d,k", [(2, 64, 20), (5, 64, 20), (12, 64, 20), (18, 64, 20), (22, 64, 20), (60, 64, 20), (60, 3, 20), (60, 64, 1)])
def test_search_of_few_vectors_finds_as_many_as_there_are(spark, n, d, k):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, d)).astype(np.float32)
    x /= np.sqrt((x * x).sum(1))[:, None]
    got = {}
    for r in lsh.nearest(vectors(spark, [(i, v.tolist(), 1) for i, v in enumerate(x)]), F.col("vec_id") % 5 == 0, k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    e = x.astype(np.float64)
    for q in range(0, n, 5):
        assert [r for r, _, _ in got[q]] == list(range(1, min(k, n - 1) + 1))
        assert all(i != q and abs(s - e[i] @ e[q]) < 1e-9 for _, i, s in got[q])
        if n <= k + 1:
            assert [i for _, i, _ in got[q]] == [i for i, _ in best(e @ e[q], q, k)]


def test_search_scans_all_entries_in_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(lsh, "SCAN_QUERIES", 3)
    x = np.random.default_rng(3).standard_normal((90, 6))
    tight = lsh.Settings(tables=1, projections=8, width=0.01, probes=1)
    monkeypatch.setattr(lsh, "probe_order", lambda near, probes: [()])
    got = {}
    for r in lsh.nearest(vectors(spark, [(i, v.tolist(), 1) for i, v in enumerate(x)]), F.col("vec_id") % 9 == 0, 7, tight).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    e = x.astype(np.float32).astype(np.float64)
    assert got == {q: [i for i, _ in best(e @ e[q], q, 7)] for q in range(0, 90, 9)}


def test_probe_order_is_by_cost():
    costs = np.array([0.3, 0.1, 0.2, 0.9, 0.05, 0.6])
    sets = lsh.probe_order(costs, 27)
    total = [sum(costs[i] for i in s) for s in sets]
    assert sets[0] == () and total == sorted(total) and len(sets) == len(set(map(frozenset, sets))) == 27
    assert all(len({i // 2 for i in s}) == len(s) for s in sets)


@pytest.mark.parametrize("search", [lambda df: kdtree.exact_top_k(df, F.col("vec_id") % 2 == 0, 3), lambda df: lsh.nearest(df, F.col("vec_id") % 2 == 0, 3)])
def test_search_of_few_or_no_vectors(spark, search):
    assert search(vectors(spark, [])).count() == 0
    got = sorted((r.query_id, r.rank, r.vec_id) for r in search(vectors(spark, [(2, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (5, [0.5, 0.5], 1)])).collect())
    assert got == [(2, 1, 3), (2, 2, 5)]


@pytest.mark.parametrize("words", range(1, 6))
def test_jaccard_of_tables_of_few_words(spark, words):
    rows = [(7, " ".join("abcde"[:words])), (9, " ".join("ABCDE"[:words]))]
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_classes(texts(spark, rows)).collect()} == {(7, max(1, words - 3), 7), (9, max(1, words - 3), 7)}
    got = jaccard.similar_classes(texts(spark, rows[:1])).collect()
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in got] == [(7, max(1, words - 3), 7)]


def near_group(rng, m, length, edits):
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(900)]
    base = [rng.choice(words) for _ in range(length)]
    for i in range(m):
        own = list(base)
        for _ in range(rng.randrange(0, edits)):
            own[rng.randrange(length)] = rng.choice(words)
        yield i, " ".join(own)


@pytest.mark.parametrize("m,length", [(500, 55), (1_000, 55), (2_000, 120), (4_000, 55)])
def test_edges_of_near_copies_stay_linear(spark, m, length, monkeypatch):
    seen = []
    real = jaccard.connected_components

    def counted(edges, *names):
        seen.append(edges.count())
        return real(edges, *names)

    monkeypatch.setattr(jaccard, "connected_components", counted)
    rows = list(near_group(random.Random(m), m, length, 3))
    got = jaccard.similar_classes(texts(spark, rows)).collect()
    assert len(got) == m and {r.component_id for r in got if r.doc_id > 0 and r.component_id == 0}
    assert max(seen) <= 3 * m


def test_jaccard_of_groups_that_chance_joins(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 8)
    rng = random.Random(5)
    rows = [(k * 100 + i, t) for k in range(3) for i, t in near_group(rng, 30, 40, 6)]
    _, want = brute.jaccard_components(rows)
    clusters = spark.createDataFrame([(0, i) for i, _ in rows], "component long, node long")
    docs = texts(spark, rows).withColumnRenamed("doc_id", "id")
    with Scratch(spark) as put:
        got = {r.node: r.label for r in jaccard.linked_labels(put, docs, clusters, 4, 85).collect()}
    assert got == want


def best_ids(rows, query_ids, k, scores):
    """query -> [(vec_id, score)] by plain search, a repeated id by its best row."""
    out = {}
    for q in query_ids:
        found = {}
        for i, x in rows:
            if i == q:
                for j, y in rows:
                    if j != q:
                        s = scores(x, y)
                        found[j] = max(found.get(j, s), s)
        out[q] = sorted(found.items(), key=lambda p: (-p[1], p[0]))[:k]
    return out


def odd_rows(rng, d):
    """Repeated rows: one id thirty times, many ids with one vector, one id with many vectors, and twice a query."""
    same = rng.standard_normal(d).astype(np.float32).tolist()
    rows = [(3, same)] * 30 + [(i, same) for i in range(4, 30)]
    rows += [(3, rng.standard_normal(d).astype(np.float32).tolist()) for _ in range(9)]
    rows += [(40 + i, rng.standard_normal(d).astype(np.float32).tolist()) for i in range(60)]
    rows += [(50, rng.standard_normal(d).astype(np.float32).tolist())] * 2
    return rows


@pytest.mark.parametrize("shard", [8_192, 16])
def test_kdtree_of_repeated_rows(spark, monkeypatch, shard):
    monkeypatch.setattr(kdtree, "SHARD_ROWS", shard)
    monkeypatch.setattr(kdtree, "BLOCK_ROWS", 7)
    monkeypatch.setattr(kdtree, "BOX_ROWS", 2)
    rows = odd_rows(np.random.default_rng(4), 6)
    low = [(i, np.floor(np.array(v, np.float32).astype(np.float64) * 256)) for i, v in rows]
    want = best_ids(low, {i for i, _ in rows if i % 5 == 0}, 5, lambda x, y: int(x @ y))
    got = {}
    for r in kdtree.exact_top_k(vectors(spark, [(*r, 1) for r in rows]), F.col("vec_id") % 5 == 0, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == want


def test_kdtree_takes_several_dimensions(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "SHARD_ROWS", 8)
    rng = np.random.default_rng(9)
    rows = [(i, rng.standard_normal(3 + i % 2).astype(np.float32).tolist(), 1) for i in range(60)]
    got = {}
    for r in kdtree.exact_top_k(vectors(spark, rows), F.col("vec_id") % 10 == 0, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in range(0, 60, 10):
        part = [(i, np.floor(np.array(v, np.float32).astype(np.float64) * 256)) for i, v, _ in rows if len(v) == 3 + q % 2]
        assert got[q] == best_ids(part, [q], 4, lambda x, y: int(x @ y))[q]


def test_lsh_of_repeated_rows(spark):
    rows = odd_rows(np.random.default_rng(4), 6)
    wide = lsh.Settings(tables=8, projections=2, width=4.0, probes=40)
    want = best_ids([(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows], {i for i, _ in rows if i % 5 == 0}, 20, lambda x, y: float(x @ y))
    got = {}
    for r in lsh.nearest(vectors(spark, [(*r, 1) for r in rows]), F.col("vec_id") % 5 == 0, 20, wide).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want)
    for q, found in got.items():
        assert [i for i, _ in found] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in found], [s for _, s in want[q]])


@pytest.mark.parametrize("norms", ["equal", "one long", "log-normal"])
def test_lsh_recall_without_structure(spark, norms):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((6_000, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    if norms == "one long":
        x[17] *= 10
    if norms == "log-normal":
        x *= np.exp(rng.normal(0, 0.5, len(x)))[:, None]
    x = x.astype(np.float32).astype(np.float64)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    found = {}
    for r in lsh.nearest(vectors(spark, rows), F.col("vec_id") % 100 == 0, 20).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hit = [len(found[q] & {i for i, _ in best(x @ x[q], q, 20)}) for q in range(0, 6_000, 100)]
    assert np.mean(hit) >= 0.9 * 20


def test_lsh_of_very_large_and_very_small_vectors(spark):
    rows = [(0, [1e200, 1e200], 1), (1, [1e200, 0.0], 1), (2, [1e-200, 1e-200], 1), (3, [2e-200, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = {(r.query_id, r.vec_id): r.score for r in lsh.nearest(df, F.col("vec_id") % 2 == 0, 3, lsh.Settings(tables=8, projections=1, width=8.0, probes=8)).collect()}
    assert got[0, 1] == float("inf") and got[0, 3] == 1e200 * 2e-200 and {q for q, _ in got} == {0, 2} and len(got) == 6


def test_jaccard_of_very_long_texts(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(100_000)]
    other = list(words)
    for k in range(0, len(words), 400):
        other[k] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:50_000])), (4, "one two")]
    got = {r.doc_id: r.component_id for r in jaccard.similar_classes(texts(spark, rows)).collect()}
    assert got == brute.jaccard_components(rows)[1] == {1: 1, 2: 1, 3: 3, 4: 4}


@pytest.mark.parametrize("times", [1, 6, 12, 100])
def test_keys_of_a_text_do_not_grow_with_the_table(times):
    # sets by log2 of their size in 0.5 GB of texts, whose lists had a mean length of 11
    sizes = {0: 539, 1: 1086, 2: 2792, 3: 2476, 4: 13687, 5: 14622, 6: 32617, 7: 61307, 8: 65963, 9: 36631, 10: 15564, 11: 5371, 12: 3399, 13: 354, 14: 2}
    light = jaccard.boundary({k: v * times for k, v in sizes.items()}, 11.0 * times, 85)
    prefix = {k: (s := int(1.5 * 2**k)) - jaccard.least_overlap(s, 85) + 1 for k in sizes}
    subsets = sum(v * prefix[k] * (prefix[k] + 1) / 2 for k, v in sizes.items() if int(1.5 * 2**k) <= light)
    assert 64 <= light and subsets <= sum(v * prefix[k] for k, v in sizes.items()) / 2


def test_texts_of_a_cluster_travel_only_where_marks_leave_a_link_possible(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 8)
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(900)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(30, 200)))) for k in range(300)]
    # near copies of some, of other lengths and with other edits, apart in the order of ids
    rows += [(1_000 + k, " ".join([*t.split()[: -max(1, len(t.split()) // (6 + k % 20))], *(["new"] * (k % 3))])) for k, t in rows[:80]]
    _, want = brute.jaccard_components(rows)
    clusters = spark.createDataFrame([(0, i) for i, _ in rows], "component long, node long")
    docs = texts(spark, rows).withColumnRenamed("doc_id", "id")
    seen, real = [], Scratch.__call__

    def counted(self, df, name):
        out = real(self, df, name)
        if name == "jaccard-pairs":
            seen.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "__call__", counted)
    with Scratch(spark) as put:
        got = {r.node: r.label for r in jaccard.linked_labels(put, docs, clusters, 4, 85).collect()}
    assert got == want and len(set(want.values())) < len(rows)
    assert sum(seen) < 2 * len(rows)
