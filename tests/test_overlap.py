import random
import time
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import corpus, overlap
from lexiloom.plans import queries

BASE = (
    "Measurements collected during several winter expeditions revealed unexpected salinity gradients beneath floating glacier tongues, "
    "which suggests that seasonal meltwater reaches considerable depth before mixing with ambient ocean currents offshore."
)


def frame(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} string, text string")


def found(spark, passage, source):
    return overlap.find_overlaps(frame(spark, [("p", passage)], "passage_id"), frame(spark, [("d", source)], "document_id")).collect()


def test_exact_match_of_everything(spark):
    (m,) = found(spark, BASE, BASE)
    assert m.kind == "exact_text_overlap" and m.matched == len(BASE.split()) and m.status == "complete" and m.match_no == 1


def test_case_and_punctuation(spark):
    (m,) = found(spark, BASE.upper().replace(",", " —").replace(" ", "  "), BASE)
    assert m.similarity == 1.0


def test_one_word_changed_is_near_exact(spark):
    (m,) = found(spark, BASE.replace("glacier", "iceberg"), BASE)
    assert m.kind == "near_exact_text_overlap" and 0.85 <= m.similarity < 1


def test_common_phrases_and_short_texts_do_not_match(spark):
    common = "this is what we were and they are to be with the one of them in that so it can do as you have been"
    assert found(spark, common, common) == []
    assert found(spark, "three little words", BASE) == []


def test_utf16_offsets_and_displayed_text(spark):
    passages, library = frame(spark, [("p", "🧪 🌍 Student note: " + BASE)], "passage_id"), frame(spark, [("d", "🧪 Preface. " + BASE)], "document_id")
    (m,) = overlap.displayed(overlap.find_overlaps(passages, library), passages, library).collect()
    assert m.q_from == len("🧪 🌍 Student note: ") + 2
    assert "🧪 Preface. ".join(["", BASE]).encode("utf-16-le")[2 * m.s_from : 2 * m.s_to].decode("utf-16-le") == m.s_span == BASE.rstrip(".")


def test_decomposed_and_composed_spelling_match_from_the_first_word(spark):
    composed = "École " + BASE.replace("revealed", "révélées").replace("depth", "ﬁn")
    passages, library = frame(spark, [("p", unicodedata.normalize("NFD", composed))], "passage_id"), frame(spark, [("d", composed)], "document_id")
    (m,) = overlap.displayed(overlap.find_overlaps(passages, library), passages, library).collect()
    assert (m.kind, m.q_start, m.s_start, m.matched) == ("exact_text_overlap", 0, 0, len(composed.split()))
    assert m.q_span == unicodedata.normalize("NFD", composed).rstrip(".") and m.s_span == composed.rstrip(".")


def test_both_spellings_have_one_hash(spark):
    rows = [(1, "x", "Café au lait"), (2, "x", unicodedata.normalize("NFD", "CAFÉ  au lait")), (3, "x", "cafe au lait"), (4, "x", "ﬁn Straße"), (5, "x", "FIN STRASSE")]
    df = spark.createDataFrame(rows, "id int, label string, text string")
    assert sorted(r.n for r in corpus.exact_groups(df, "id", "label", "text").collect()) == [1, 2, 2]


def test_words_by_built_ins_equal_exact_ones(spark):
    odd = ["ßẞ ß", "ΣΊΣΥΦΟΣ ς", "ŉ ŀ ĳ ſ µ ª", "İstanbul I", "ＦＵＬＬ ｗｉｄｔｈ", "ŽLUŤOUČKÝ kůň", "Ёлка йод", "漢字 かな", "a\u0301b c\u0327", "x²y ½", "O’Neil o'neil rock’n’roll", "", "ﬀ", "Ǆ ǆ"]
    df = spark.createDataFrame([(x,) for x in odd], "t string")
    for r in df.select("t", T.words(F.col("t")).alias("w"), T.tokens_exact("t").alias("e"), T.normalized(F.col("t")).alias("n"), T.normalized_exact("t").alias("m")).collect():
        assert r.w == [x.value for x in r.e], r.t
        assert r.n == r.m, r.t


def test_thirty_equal_documents_are_partial_and_all_there_without_bounds(spark):
    passages, library = frame(spark, [("p", BASE), ("q", "three little words")], "passage_id"), frame(spark, [(f"d{i:02}", BASE) for i in range(30)], "document_id")
    matches, told = overlap.search(passages, library)
    assert matches.count() == 24 and {r.status for r in matches.collect()} == {"partial"}
    assert {(r.passage_id, r.status, r.matches, r.warning is None) for r in told.collect()} == {("p", "partial", 24, False), ("q", "insufficient_text", 0, True)}
    matches, told = overlap.search(passages, library, overlap.EXACT)
    assert matches.count() == 30 and {r.status for r in matches.collect()} == {"complete"}


@pytest.mark.parametrize("bounds", [overlap.Bounds(hits=3), overlap.Bounds(documents=1), overlap.Bounds(runs=1), overlap.Bounds(pair_runs=1), overlap.Bounds(matches=1)])
def test_every_bound_is_told(spark, bounds):
    words = BASE.split()
    twice = " ".join([*words, "unrelated filler stands here", *reversed(words)])
    passages, library = frame(spark, [("p", twice)], "passage_id"), frame(spark, [("d", twice.replace("unrelated", "other").replace("stands", "sits")), ("e", BASE)], "document_id")
    assert {r.status for r in overlap.search(passages, library)[1].collect()} == {"complete"}
    assert {r.status for r in overlap.search(passages, library, bounds)[1].collect()} == {"partial"}


def test_outcomes_without_a_library(spark):
    passages = frame(spark, [("p", BASE)], "passage_id")
    matches, told = overlap.search(passages, frame(spark, [], "document_id"))
    assert matches.count() == 0 and [r.status for r in told.collect()] == ["empty"]
    assert [r.status for r in overlap.unavailable(passages).collect()] == ["unavailable"]


def test_decomposed_letters_are_one_word(spark):
    df = spark.createDataFrame([("Café straße A_b O’Neil",)], "t string")
    tokens = df.select(T.tokens_exact("t")).first()[0]
    assert [t.value for t in tokens] == ["café", "strasse", "a", "b", "o'neil"]
    assert df.select(F.size(T.words(F.col("t")))).first()[0] == 5


@pytest.mark.parametrize("offset", range(6))
def test_short_runs_need_an_indexed_seed(spark, offset):
    run = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot"]
    source = [f"s{i}" for i in range(offset)] + run + ["tail"] * 4
    passages, library = frame(spark, [("p", " ".join(["q0", *run, "q1"]))], "passage_id"), frame(spark, [("d", " ".join(source))], "document_id")
    pairs = overlap.seeds(passages, library).select("passage_id", "document_id").distinct()
    rows = overlap.blocks(passages, library, pairs).collect()
    seeded = any((offset + k) % 5 == 0 for k in range(2))
    assert [(r.q_start, r.q_end, r.s_start, r.matched) for r in rows] == ([(1, 7, offset, 6)] if seeded else [])


def test_runs_equal_word_by_word_extension(spark):
    rng = random.Random(2)
    a, b = ([rng.choice("vwxyz") for _ in range(80)] for _ in range(2))
    passages, library = frame(spark, [("p", " ".join(a))], "passage_id"), frame(spark, [("d", " ".join(b))], "document_id")
    pairs = spark.createDataFrame([("p", "d")], "passage_id string, document_id string")
    got = {(r.q_start, r.q_end, r.s_start, r.s_end) for r in overlap.blocks(passages, library, pairs).collect()}
    want = set()
    for q in range(len(a)):
        for s in range(len(b)):
            if a[q] == b[s] and (q == 0 or s == 0 or a[q - 1] != b[s - 1]):
                n = 0
                while q + n < len(a) and s + n < len(b) and a[q + n] == b[s + n]:
                    n += 1
                if n >= 5 and any((s + k) % 5 == 0 for k in range(n - 4)):
                    want.add((q, q + n, s, s + n))
    assert got == want


def test_chains_prefer_longer_runs_and_respect_the_gap():
    runs = pd.DataFrame([(0, 10, 0, 10, 10, 1), (12, 20, 13, 21, 8, 2), (11, 16, 11, 16, 5, 3), (40, 60, 40, 60, 20, 0)], columns=["q_start", "q_end", "s_start", "s_end", "matched", "block_rank"])
    runs.insert(0, "document_id", "d")
    runs.insert(0, "passage_id", "p")
    out = overlap.chain_runs(runs)
    assert out[["q_start", "q_end", "s_start", "s_end", "matched"]].values.tolist() == [[0, 20, 0, 21, 18]]


@pytest.mark.parametrize("seed", range(3))
def test_chains_by_hops_equal_those_of_a_task(spark, seed):
    rng = random.Random(seed)
    rows = set()
    for _ in range(250):
        q, n = rng.randrange(400), rng.choice([5, 6, 8, 11])
        s = q + rng.choice([0, 1, 2, 40])
        rows.add((rng.choice("pq"), "d", q, q + n, s, s + n, n))
    df = spark.createDataFrame(sorted(rows), "passage_id string, document_id string, q_start int, q_end int, s_start int, s_end int, matched int")
    want = set(map(tuple, overlap.chained(df, 10_000).collect()))
    assert len(want) > 50 and set(map(tuple, overlap.chained(df, None).collect())) == want


def test_suppression_equals_greedy_acceptance(spark):
    rng = random.Random(6)
    rows = set()
    for _ in range(60):
        q, s = rng.randrange(20), rng.randrange(20)
        n, m = rng.randrange(2, 20), rng.randrange(2, 20)
        rows.add(("p", "d", q, q + n, s, s + m, min(n, m)))
    got = {tuple(r) for r in overlap.suppressed(spark.createDataFrame(sorted(rows), "passage_id string, document_id string, q_start int, q_end int, s_start int, s_end int, matched int")).collect()}
    kept = []
    for r in sorted(rows, key=lambda r: (-r[6], -2 * r[6] / (r[3] - r[2] + r[5] - r[4]), r[2], r[4])):
        if not any(k[2] <= r[2] and k[3] >= r[3] and k[4] <= r[4] and k[5] >= r[5] for k in kept):
            kept.append(r)
    assert got == set(kept)


@pytest.mark.parametrize("first,chunk", [(256, 8_192), (2, 5), (0, 1)])
def test_suppression_of_random_spans_of_several_pairs(spark, monkeypatch, first, chunk):
    monkeypatch.setattr(overlap, "FIRST_SPANS", first)
    monkeypatch.setattr(overlap, "CHUNK_SPANS", chunk)
    rng = random.Random(first)
    rows = set()
    for _ in range(400):
        q, s, n, m = rng.randrange(300), rng.randrange(300), rng.choice([0, 1, 3, 7, 8, 16, 100]), rng.choice([1, 2, 8, 15, 90])
        rows.add((rng.choice("pq"), rng.choice("de"), q, q + n, s, s + m, rng.randrange(1, 99)))
    got = {tuple(r) for r in overlap.suppressed(spark.createDataFrame(sorted(rows), "passage_id string, document_id string, q_start int, q_end int, s_start int, s_end int, matched int")).collect()}
    kept = []
    for r in sorted(rows, key=lambda r: (-r[6], -2 * r[6] / (r[3] - r[2] + r[5] - r[4]), r[2], r[4])):
        if not any(k[:2] == r[:2] and k[2] <= r[2] and k[3] >= r[3] and k[4] <= r[4] and k[5] >= r[5] for k in kept):
            kept.append(r)
    assert got == set(kept)


def test_a_hundred_thousand_spans_of_one_pair(spark):
    """Half of them small and apart, half inside one another."""
    apart = spark.range(50_000).select((F.col("id") * 20).alias("q"), F.lit(14).alias("n"))
    nested = spark.range(50_000).select((1_000_000 + F.col("id") % 500 * 40 + F.col("id") % 7).alias("q"), (13 + F.col("id") % 23).alias("n"))
    rows = apart.unionByName(nested).select(F.lit("p").alias("passage_id"), F.lit("d").alias("document_id"), F.col("q").alias("q_start"), (F.col("q") + F.col("n")).alias("q_end"),
        F.col("q").alias("s_start"), (F.col("q") + F.col("n")).alias("s_end"), F.col("n").cast("long").alias("matched")).distinct()
    start = time.perf_counter()
    got = overlap.suppressed(rows).collect()
    assert time.perf_counter() - start < 60
    assert sum(r.q_start < 1_000_000 for r in got) == 50_000
    spans = sorted({(r.q_start, r.q_end) for r in rows.where("q_start >= 1000000").collect()}, key=lambda x: (x[0], -x[1]))
    top, last = [], -1
    for a, b in spans:
        if b > last:
            top.append((a, b))
            last = b
    assert sorted((r.q_start, r.q_end) for r in got if r.q_start >= 1_000_000) == top


def test_hits_over_the_bound_are_reported(spark):
    hits = spark.createDataFrame([("p", f"d{i}", 0, i, f"g{i}") for i in range(4)], "passage_id string, document_id string, q_pos int, s_pos int, gram string")
    assert [r.truncated for r in overlap.bounded_hits(hits, 2).collect()] == [True, True]
    assert not any(r.truncated for r in overlap.bounded_hits(hits, 9).collect())


def test_registered_hits_are_kept_up_to_the_bound_of_the_operator(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(60))
    spark.createDataFrame([("p", words)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, words)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["bounded_hits_full"](spark, str(tmp_path)).collect()
    assert sorted((r.q_pos, r.s_pos, r.truncated) for r in got) == [(i, i, False) for i in range(0, 56, 5)]


def test_pairs_are_made_once(spark):
    """The plan of the runs holds the grams of both sides, not the search for the pairs."""
    passages = spark.createDataFrame([(1, "a b c d e f g h i j k l m")], "passage_id long, text string")
    library = spark.createDataFrame([(7, "x a b c d e f g h i j k l m y"), (8, "none of it")], "document_id long, text string")
    pairs = overlap.seeds(passages, library).select("passage_id", "document_id").distinct()
    found = overlap.blocks(passages, library, pairs)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate inline") <= 4  # each side with and without intricate texts
    assert [tuple(r) for r in found.collect()] == [(1, 7, 0, 13, 1, 14, 13)]


def test_chains_are_spread_over_tasks(spark):
    rows = [(p, d, k * 20, k * 20 + 10, k * 20 + 3, k * 20 + 13, 10) for p in range(6) for d in range(6) for k in range(3)]
    rows += [(p, d, 10, 20, 13, 23, 10) for p in range(6) for d in range(6)]
    found = spark.createDataFrame(rows, "passage_id long, document_id long, q_start int, q_end int, s_start int, s_end int, matched int")
    spans = overlap.chained(found)
    assert spans.count() >= 36
    assert spans._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
