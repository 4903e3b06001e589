import random

import pytest
from pyspark.sql import functions as F

from lexiloom import checks
from lexiloom.operators import corpus, linking, metrics
from lexiloom.plans import queries

ROW = "id long, label int, score double, source_group string, text_sha256 string, prompt string, generator string, length_bucket string, split string"


def rows(spark, items, groups=None):
    made = [(i, label, score, (groups or {}).get(i, f"g{i}"), f"{i:064x}", "p", None, "short", "test") for i, (label, score) in enumerate(items)]
    return spark.createDataFrame(made, ROW)


def test_excerpt_choices(spark):
    def one(text):
        r = spark.createDataFrame([(text,)], "t string").select(corpus.excerpt(F.col("t")).alias("e")).first().e
        return r and (r.kind, len(r.excerpt.split()))

    assert one("w " * 400) == ("first_250_words", 250)
    assert one("too short") is None
    assert one("Title\n\n" + "w " * 90 + "\n \nend") == ("natural_paragraph", 90)
    assert one(" w" * 100 + "\n") == ("natural_paragraph", 100)
    assert one("w " * 50 + "\n\n" + "w " * 60) == ("whole_short_document", 110)


def test_families_link_over_absent_groups(spark):
    df = spark.createDataFrame([(1, "A"), (2, "C"), (3, None), (4, None)], "id long, source_group string")
    bridge = spark.createDataFrame([(["A", "B"],), (["B", "C"],)], "source_groups array<string>")
    got = {r.id: r.family for r in corpus.linked_families(df, {"source_group": F.col("source_group")}, "id", bridge).collect()}
    assert got == {"1": "record:1", "2": "record:1", "3": "record:3", "4": "record:4"}


def test_components_do_not_depend_on_order(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    first = sorted(map(tuple, linking.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    rng.shuffle(edges)
    again = sorted(map(tuple, linking.connected_components(spark.createDataFrame([(b, a) for a, b in edges], "src long, dst long")).collect()))
    assert first == again
    assert {c for n, c in first if n >= 100} == {100}


@pytest.mark.parametrize("kind", ["zig-zag", "shuffled"])
def test_components_of_long_chains(spark, kind):
    order = {"zig-zag": [0, *range(149, 0, -1)], "shuffled": random.Random(5).sample(range(1000), 1000)}[kind]
    edges = [*zip(order, order[1:]), (5000, 5001), (6000, 6000), (7000, None)]
    got = dict(map(tuple, linking.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert got == {n: 0 for n in order} | {5000: 5000, 5001: 5000, 6000: 6000}


def test_dedup_quarantines_conflicts(spark):
    df = spark.createDataFrame([("a", "ai", "Same  text"), ("b", "human", "same text"), ("c", "ai", "other"), ("d", "ai", "Other ")], "id string, label string, text string")
    admitted, removed, conflicts = corpus.exact_dedup(df, "id", "label", "text")
    assert [r.id for r in admitted.collect()] == ["c"]
    assert [tuple(r) for r in removed.collect()] == [("d", "c")]
    assert sorted(r.id for r in conflicts.collect()) == ["a", "b"]


def test_near_duplicates_report_and_keep(spark):
    words = [f"w{i}" for i in range(100)]
    df = spark.createDataFrame([("a", "human", " ".join(words)), ("b", "ai", " ".join([*words, "more"])), ("c", "ai", "short"), ("d", "human", " ".join(words))], "id string, label string, text string")
    got = {(r.left, r.right): (r.jaccard, r.label_conflict) for r in corpus.near_duplicates(df, "id", "label", "text").collect()}
    assert got == {("a", "b"): (96 / 97, True), ("a", "d"): (1.0, False)}


def test_scores_must_cover_exactly_the_rows(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "id long, text_sha256 string")
    for bad in ([(1, "x", 0.1)], [(1, "x", 0.1), (2, "y", 0.2), (2, "y", 0.3)], [(1, "x", 0.1), (2, "stale", 0.2)]):
        with pytest.raises(checks.CheckFailed):
            corpus.attach_scores(left, spark.createDataFrame(bad, "id long, text_sha256 string, score double"))
    assert corpus.attach_scores(left, spark.createDataFrame([(1, "x", 0.1), (2, "y", 0.2)], "id long, text_sha256 string, score double")).count() == 2


def test_confusion_rates_and_brier(spark):
    df = rows(spark, [(label, s) for label in (0, 1) for s in (0.9, 0.5, 0.1)]).withColumn("decision", metrics.Thresholds(0.2, 0.8).decide(F.col("score")))
    r = metrics.rates(metrics.confusion(df)).first()
    assert (r.tp, r.fp, r.tn, r.fn, r.abstain_human, r.abstain_ai) == (1,) * 6
    assert r.human_fpr == pytest.approx(1 / 3) and r.coverage == pytest.approx(2 / 3) and r.ai_recall == pytest.approx(1 / 3)
    assert metrics.brier(df).first().brier == pytest.approx(2.14 / 6)


def test_boundaries_and_disabled_sides(spark):
    scores = spark.createDataFrame([(0.2,), (0.8,), (0.5,)], "score double")
    assert [r[0] for r in scores.select(metrics.Thresholds(0.2, 0.8).decide(F.col("score"))).collect()] == ["human", "ai", "uncertain"]
    assert {r[0] for r in scores.select(metrics.Thresholds(None, None).decide(F.col("score"))).collect()} == {"uncertain"}
    with pytest.raises(ValueError):
        metrics.Thresholds(0.5, 0.5)


@pytest.mark.parametrize("items,want", [([(0, 0.5), (1, 0.5)], 0.5), ([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], 0.75), ([(1, 0.1), (0, 0.9)], 0.0), ([(0, 0.3)], None)])
def test_auroc(spark, items, want):
    assert metrics.auroc(rows(spark, items)).first().auroc == want


def test_wilson_bounds(spark):
    df = spark.createDataFrame([(0, 300), (0, 0)], "k int, n int")
    lower, upper = metrics.wilson(F.col("k"), F.col("n"))
    a, b = df.select(lower.alias("l"), upper.alias("u")).collect()
    assert a.u == pytest.approx(0.008937872175, abs=1e-10) and a.l == pytest.approx(0, abs=1e-12) and (b.l, b.u) == (None, None)


def chosen(spark, items, groups=None, cap=0.0):
    r = metrics.select_thresholds(metrics.units(rows(spark, items, groups)), cap, cap).first()
    return r.human_max, r.ai_min


def test_threshold_selection(spark):
    assert chosen(spark, [(0, 0.1), (0, 0.4), (1, 0.2), (1, 0.9)]) == (0.1, 0.9)
    assert chosen(spark, [(0, 0.5), (1, 0.5)]) == (None, None)
    many = [(0, 0.1)] * 200 + [(0, 0.9), (1, 0.9)]
    assert chosen(spark, many, {i: "one" for i in range(200)}, 0.01) == (0.1, None)
    assert chosen(spark, [(0, 0.1), (1, 0.9)], {0: "f", 1: "f"}) == (0.1, 0.9)


def test_metric_rows_are_validated(spark):
    fine = rows(spark, [(0, 0.1), (1, 0.9)])
    assert metrics.validate(fine) is fine
    bad = [fine.withColumn("score", F.lit(float("nan"))), fine.withColumn("score", F.lit(1.01)), fine.withColumn("label", F.lit(2)), fine.withColumn("id", F.lit(1).cast("long")), fine.withColumn("text_sha256", F.lit("0" * 64))]
    for df in bad:
        with pytest.raises(checks.CheckFailed):
            metrics.validate(df)


def test_release_gates(spark):
    items = [(0, 0.1)] * 300 + [(1, 0.9)] * 100
    t = metrics.Thresholds(0.2, 0.8)
    told = lambda x, g=None: {r.gate: r.passed for r in metrics.gates(metrics.summary(rows(spark, x, g), t), independent=True, unseen_passed=True).collect()}
    assert all(told(items).values())
    assert not told(items[1:])["minimum_human_groups"]
    assert not told([(0, 0.95), *items[1:]])["human_fpr_upper_95"]
    assert not told(items, {i: "one" for i in range(300)})["minimum_human_groups"]


def test_leaks_are_found(spark):
    df = spark.createDataFrame([("train", "a", None), ("test", "a", None), ("test", "b", None)], "split string, k string, n string")
    assert [tuple(r) for r in corpus.leaks(df, ["k", "n"]).collect()] == [("k", "a", 2)]


def test_order_does_not_change_splits(spark):
    df = spark.createDataFrame([(i, f"f{i % 30}") for i in range(60)], "id long, family string")
    first = {r.id: r.split for r in corpus.assign_splits(df).collect()}
    again = {r.id: r.split for r in corpus.assign_splits(df.orderBy(F.desc("id"))).collect()}
    assert first == again and set(first.values()) == {"train", "calibration", "test"}


def test_related_groups_have_near_pairs_of_admitted_records(spark, tmp_path):
    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words), "en", "A"), (2, " ".join([*words, "more"]), "en", "B"), (3, " ".join(words).upper(), "en", "C"), (4, "short", "en", "D")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.QUERIES["related_groups_full"](spark, str(tmp_path)).collect()))
    assert got == [("exact_normalized_text", "1,3", "A,C"), ("near_duplicate_text", "1,2", "A,B")]


def test_sources_link_by_excerpt_and_keep_null_texts(spark, tmp_path):
    shared = " ".join(f"w{i}" for i in range(100))
    rows = [(1, "first opening\n\n" + shared, "A"), (41, "another one\n\n" + shared, "B"), (42, None, "B"), (90, None, "C")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = dict(map(tuple, queries.QUERIES["source_components_full"](spark, str(tmp_path)).select("doc_id", "family").collect()))
    assert got == {1: 1, 41: 1, 42: 1, 90: 90}


@pytest.mark.parametrize("confidence", [0.8, 0.95, 0.99])
def test_wilson_bounds_of_any_confidence(spark, confidence):
    """The bounds are where the score test is just at its quantile."""
    from statistics import NormalDist

    lower, upper = metrics.wilson(F.col("k"), F.col("n"), confidence)
    z = NormalDist().inv_cdf(confidence)
    for r in spark.createDataFrame([(0, 9), (1, 9), (9, 9), (40, 123), (0, 0)], "k int, n int").select("k", "n", lower.alias("lo"), upper.alias("hi")).collect():
        if not r.n:
            assert r.lo is None and r.hi is None
            continue
        for bound in (r.lo, r.hi):
            if 1e-12 < bound < 1 - 1e-12:
                assert abs(abs(r.k / r.n - bound) / (bound * (1 - bound) / r.n) ** 0.5 - z) < 1e-6
    with pytest.raises(ValueError):
        metrics.wilson(F.col("k"), F.col("n"), 0.5)
