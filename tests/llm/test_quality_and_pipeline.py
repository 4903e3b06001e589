import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import brute

import corpus_pipeline
from lexiloom.llm import quality, suffixdedup

SF = "/root/testdata/sf0.01"


def made(rng, n):
    words = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        kind = i % 3
        own = [rng.choice(words) for _ in range(60)]
        if kind == 0:
            own[rng.randrange(60)] = "vile"
        if kind == 1:
            own = [w + "%%%" for w in own]
        docs.append((i, " ".join(own)))
        labels.append((i, 0 if kind == 1 else 1, 1 if kind == 0 else 0))
    return docs, labels


def test_grades_are_learnt(spark):
    docs, labels = made(random.Random(1), 2_400)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    held = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(df, held.where("doc_id < 1800"))
    assert model.fitted and (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in quality.score(df.where("doc_id >= 1800"), model).collect()}
    right = [got[i].keep == (i % 3 == 2) for i in range(1800, 2400)]
    assert np.mean(right) >= 0.97
    means = [np.mean([got[i].expected_grade for i in range(1800, 2400) if i % 3 == k]) for k in range(3)]
    assert means[0] < means[1] < means[2]


def tiny(seed, n=60, f=5):
    rng = np.random.default_rng(seed)
    x = rng.random((n, f)) < 0.4
    grades = np.clip(np.round(x @ np.linspace(-1, 2, f) + rng.normal(0, 0.5, n)), 0, 2).astype(np.int64)
    rows, column = np.nonzero(x)
    return rows, column, grades, np.full(n, 1 / n)


@pytest.mark.parametrize("seed", range(4))
def test_gradient_equals_finite_differences(seed):
    rows, column, grades, weight = tiny(seed)
    theta = np.random.default_rng(seed).normal(0, 1, 5 + 2)
    _, grad = quality.objective(theta, rows, column, grades, weight, 0.01)
    for k in range(len(theta)):
        step = np.zeros_like(theta)
        step[k] = 1e-6
        slope = (quality.objective(theta + step, rows, column, grades, weight, 0.01)[0] - quality.objective(theta - step, rows, column, grades, weight, 0.01)[0]) / 2e-6
        assert grad[k] == pytest.approx(slope, abs=1e-6)


@pytest.mark.parametrize("seed", range(3))
def test_fit_is_as_good_as_a_plain_search(seed):
    """Against a random descent on the likelihood, written out from its definition."""
    rows, column, grades, weight = tiny(seed, 90)
    x = np.zeros((90, 5))
    x[rows, column] = 1
    counts = np.bincount(grades, minlength=3)
    weight = np.minimum(counts.max() / counts, 2.0)[grades]
    weight /= weight.sum()

    def loss(w, low, high):
        s = x @ w
        below = np.stack([np.zeros(90), 1 / (1 + np.exp(s - low)), 1 / (1 + np.exp(s - high)), np.ones(90)], 1)
        p = below[np.arange(90), grades + 1] - below[np.arange(90), grades]
        return -(weight * np.log(np.maximum(p, 1e-9))).sum() + 0.01 * (w @ w) / 2

    rng = np.random.default_rng(seed)
    best, at, size = np.inf, np.zeros(7), 1.0
    for _ in range(12_000):
        new = at + rng.normal(0, size, 7)
        if new[6] > new[5] and (value := loss(new[:5], new[5], new[6])) < best:
            best, at = value, new
        size = max(0.997 * size, 0.01)
    model = quality.fit(rows, column, grades, size=5, ridge=0.01, steps=600)
    assert loss(model.weights, *model.thresholds) <= best + 0.005


def test_very_long_and_repeated_rows_are_scored(spark):
    docs, labels = made(random.Random(2), 600)
    rng = random.Random(3)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(120_000))
    df = spark.createDataFrame([*docs, (9_000, long), docs[5], docs[5]], "doc_id long, text string")
    held = spark.createDataFrame([*labels, (9_000, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.sampled_features(df, quality.graded(held)).where("doc_id = 9000").first()
    assert len(got.features) == quality.SAMPLE_FEATURES
    told = quality.score(df, quality.train(df, held)).collect()
    assert len(told) == 603 and len({r.score for r in told if r.doc_id == docs[5][0]}) == 1 and sum(r.doc_id == 9_000 for r in told) == 1


def test_held_out_accuracy_on_the_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    model = quality.train(docs, labels.where(fold > 0))
    told = quality.score(docs, model).join(quality.graded(labels.where(fold == 0)), "doc_id")
    r = told.agg(F.avg((F.col("keep") == (F.col("grade") == 2)).cast("int")).alias("right"), F.avg(F.when(F.col("grade") == 2, F.col("keep").cast("int"))).alias("kept")).first()
    assert r.right >= 0.88 and r.kept >= 0.93


def test_without_labels_all_stay(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (None, "")], "doc_id long, text string")
    model = quality.train(df, spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int"))
    assert not model.fitted
    assert [r.keep for r in quality.score(df, model).collect()] == [True] * 3
    assert quality.kept_documents(df, model).count() == 3
    assert quality.score(df.limit(0), model).count() == 0


def test_lowest_grade_of_repeated_labels(spark):
    rows = [(1, 1, 0), (1, 0, 0), (2, 1, 1), (3, None, 0), (None, 1, 0)]
    got = {r.doc_id: r.grade for r in quality.graded(spark.createDataFrame(rows, "doc_id long, quality int, toxic int")).collect()}
    assert got == {1: 1, 2: 0}


def test_stages_take_their_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, SF)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert after.columns == docs.columns
        if k == 1:
            rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
            _, component = brute.jaccard_components(rows, 5, 80)
            assert sorted(r.doc_id for r in after.select("doc_id").collect()) == sorted(i for i, c in component.items() if i == c)
        if k == 2:
            rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
            left = {i: n - gone for i, (n, gone, _, _) in brute.kept_bytes(rows).items()}
            got = {r.doc_id: r.text for r in after.collect()}
            assert all(len((got[i] or "").encode()) in range(max(0, n - 300), n + 1) for i, n in left.items() if i in got)
            assert {i for i in left if i not in got} <= {i for i, n in left.items() if n < 4}
            assert after.where("n_chars <> length(text)").count() == 0
        if k == 3:
            assert all(not brute.secret_spans(r.text) for r in after.collect())
        before = after
    assert before.agg(F.sum("length")).first()[0] == before.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows(spark, k):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id string"
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (None, "words here", "en", "s", 10, "x"), (2, "", "en", "s", 0, "x"), (3, "long " * 30_000, "en", "s", 150_000, "x")]
    stage = corpus_pipeline.STAGES[k][1]
    out = stage(spark, spark.createDataFrame(rows, schema), SF)
    if k < 4:
        assert out.columns == corpus_pipeline.COLUMNS
        assert out.where("doc_id = 1").count() <= 1
    assert out.count() > 0
    assert stage(spark, spark.createDataFrame([], schema), SF).count() == 0


def test_one_of_near_copies_with_repeated_rows_and_clashing_names(spark):
    a, b = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))
    rows = [(3, a), (5, a), (5, b), (9, b), (3, a), (12, "apart"), (12, "apart"), (None, a), (None, a), (40, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1, True, 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _passes boolean, component_id long")
    out = corpus_pipeline.keep_one_of_near_copies(spark, df, SF)
    assert out.columns == corpus_pipeline.COLUMNS
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted([(3, a), (12, "apart"), (0, a), (0, a), (40, "")])


def test_merged_runs():
    assert suffixdedup.merged([(0, 5), (5, 9), (12, 20), (13, 14)]) == [(0, 9), (12, 20)]
