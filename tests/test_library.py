import io
import os
import random
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import overlap
from lexiloom.sources import artifacts, library

WORDS = [f"{a}{b}" for a in ("harbour", "meadow", "lantern", "granite", "willow", "copper") for b in ("stone", "light", "field", "water", "song", "mark", "gate")]


def document(i, text):
    return {"document_id": i, "title": "t " + i, "text": text, "url": "https://a.org/" + i, "license_id": "CC-BY-4.0", "license_url": "", "source_provider": "p", "metadata": "{}"}


SCHEMA = ", ".join(f"{k} string" for k in document("x", ""))


def batch(spark, texts):
    return spark.createDataFrame([document(i, t) for i, t in texts.items()], SCHEMA)


def made(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def told(spark, passages, lib):
    matches, outcomes = overlap.search(passages, lib)
    return sorted(map(str, (r.asDict() for r in matches.select(sorted(matches.columns)).collect()))), sorted(map(str, outcomes.collect()))


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


@pytest.fixture
def world(spark):
    rng = random.Random(7)
    texts = {f"d{k:03}": made(rng, rng.randrange(5, 120)) for k in range(40)}
    quoted = [" ".join(texts[k].split()[3:40]) for k in list(texts)[:12]]
    passages = spark.createDataFrame([(f"p{k}", f"{made(rng, 6)} {q} {made(rng, 9)}") for k, q in enumerate(quoted)], "passage_id string, text string")
    return rng, texts, passages


def test_search_of_deltas_equals_search_of_texts(spark, tmp_path, world, monkeypatch):
    rng, texts, passages = world
    monkeypatch.setattr(library, "BUCKET_TOKENS", 300)
    monkeypatch.setattr(library, "BUCKET_DOCUMENTS", 7)
    path = str(tmp_path / "lib")
    library.upsert(spark, path, batch(spark, texts))
    changed = {"d001": made(rng, 50), "d002": texts["d001"], "d900": texts["d005"] + " " + made(rng, 5)}
    library.upsert(spark, path, batch(spark, changed))
    before = library.opened(spark, path)
    texts |= changed
    plain = lambda: spark.createDataFrame(list(texts.items()), "document_id string, text string")
    want = told(spark, passages, plain())
    assert want[0] and told(spark, passages, before) == want
    library.remove(spark, path, spark.createDataFrame([("d003",), ("d900",), ("none",)], "document_id string"))
    library.upsert(spark, path, batch(spark, {"d900": made(rng, 40), "d003": texts["d004"]}))
    library.remove(spark, path, spark.createDataFrame([("d900",)], "document_id string"))
    texts["d003"] = texts["d004"]
    del texts["d900"]
    now = told(spark, passages, plain())
    assert now != want
    for step in (None, 2, 3, "all"):
        if step:
            library.compact(spark, path, None if step == "all" else step)
        lib = library.opened(spark, path)
        assert len(lib.deltas) == {None: 5, 2: 4, 3: 2, "all": 1}[step]
        assert told(spark, passages, lib) == now
        assert sorted(r.document_id for r in lib.documents().collect()) == sorted(texts)
        assert lib.index().count() == sum((len(t.split()) - 5) // 5 + 1 for t in texts.values())
    assert told(spark, passages, before) == want  # a reader keeps its version
    assert len(library.vacuum(spark, path)) > 5 and told(spark, passages, library.opened(spark, path)) == now
    assert len(os.listdir(path)) == 2 + len([f for f in os.listdir(path) if f.endswith(".crc")])


@pytest.mark.parametrize("literals", [0, 2_000])
def test_the_library_is_read_as_it_lies(spark, tmp_path, world, monkeypatch, literals):
    """No shuffle between a bucketed scan and its join, and no text is read for the hits."""
    _, texts, passages = world
    monkeypatch.setattr(library, "BUCKET_TOKENS", 300)
    monkeypatch.setattr(library, "LITERAL_GRAMS", literals)
    path = str(tmp_path / "lib")
    library.upsert(spark, path, batch(spark, texts))
    lib = library.opened(spark, path)
    assert lib.deltas[0]["gram_buckets"] > 4
    asked = overlap.asked_grams(overlap.tokenized(passages, "passage_id", "text", "passage_id"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = plan(lib.hits(asked if literals == 0 else asked.limit(3)))
        wanted = plan(lib.tokens(spark.createDataFrame([("d001",)], "document_id string")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert [x for x in found.splitlines() if x.startswith("ReadSchema")] == ["ReadSchema: struct<gram:string,document_id:string,s_pos:int>"]
    if literals:
        assert "In(gram" in found or "EqualTo(gram" in found
    else:
        tree = found.split("== Physical Plan ==")[1].strip().split("\n\n")[0].splitlines()
        scan = next(i for i, x in enumerate(tree) if "Scan parquet" in x)
        join = max(i for i, x in enumerate(tree[:scan]) if "SortMergeJoin" in x)
        assert "Bucketed: true" in found and not any("Exchange" in x for x in tree[join:scan])
    assert "Bucketed: true" in wanted and "struct<document_id:string,words:string>" in wanted


def test_a_batch_costs_what_it_holds(spark, tmp_path):
    rng = random.Random(1)
    path = str(tmp_path / "lib")
    library.upsert(spark, path, batch(spark, {f"a{k}": made(rng, 400) for k in range(150)}))
    first = size(path)
    library.upsert(spark, path, batch(spark, {"a1": made(rng, 30)}))
    assert size(path) - first < first / 5
    assert library.summary(library.open_library(spark, path)[0]).first().documents == 150


def test_of_two_writers_one_fails_and_readers_see_a_whole_version(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    path = str(tmp_path / "lib")
    library.upsert(spark, path, batch(spark, {"a": made(rng, 30)}))
    real = artifacts.write_text

    def late(spark_, at, text):
        assert [r.document_id for r in library.opened(spark, path).documents().collect()] == ["a"]
        real(spark_, at, "{}")  # the other writer was first
        real(spark_, at, text)

    monkeypatch.setattr(artifacts, "write_text", late)
    with pytest.raises(library.CheckFailed, match="taken"):
        library.upsert(spark, path, batch(spark, {"b": made(rng, 30)}))


def test_null_and_rejected_rows_and_empty_batches(spark, tmp_path):
    path = str(tmp_path / "lib")
    assert library.upsert(spark, path, batch(spark, {})).count() == 0
    rejected = library.upsert(spark, path, batch(spark, {"a": None, "b": "four words are few", "c": "a b c d e"}).withColumns({"tokens": F.lit("clash"), "words": F.lit("clash")}))
    assert {r.document_id: r.problems for r in rejected.collect()} == {"a": ["text", "words"], "b": ["words"]}
    passages = spark.createDataFrame([("p", None), ("q", "a b c d e f g h i j k l m n")], "passage_id string, text string")
    matches, outcomes = overlap.search(passages, library.opened(spark, path))
    assert matches.count() == 0 and {r.status for r in outcomes.collect()} == {"insufficient_text", "complete"}


def test_a_delta_is_sorted_once_and_its_files_are_in_order(spark, tmp_path, world, monkeypatch):
    _, texts, _ = world
    monkeypatch.setattr(library, "BUCKET_TOKENS", 300)
    monkeypatch.setattr(library, "BUCKET_DOCUMENTS", 7)
    store = spark._jsparkSession.sharedState().statusStore()
    before, path = store.executionsCount(), str(tmp_path / "lib")
    library.upsert(spark, path, batch(spark, texts))
    found = store.executionsList()
    plans = [found.apply(k).physicalPlanDescription() for k in range(int(before), found.size())]
    written = [p for p in plans if "WriteFiles" in p and "hashpartitioning(gram" in p]
    assert written and not any("pmod(" in p for p in written)
    at = f"{path}/{library.opened(spark, path).deltas[0]['name']}/index"
    files = [f"{at}/{name}" for name in os.listdir(at) if name.startswith("part-")]
    assert len(files) > 4
    for name in files:
        rows = [(r.gram.encode(), r.document_id, r.s_pos) for r in spark.read.parquet(name).collect()]
        assert rows == sorted(rows)


def test_stored_words_are_indexed_as_tokens_are(spark):
    rows = spark.createDataFrame([(f"d{n}", " ".join(f"w{k}'s" if k % 3 else "ä" * (k + 1) for k in range(n))) for n in (0, 1, 4, 5, 6, 9, 10, 57)], "document_id string, words string")
    told = lambda df: sorted((r.document_id, r.s_pos, r.gram) for r in df.collect())
    assert told(library._index(rows)) == told(overlap.index_of(library._tokens(rows)))
    assert library._index(rows).dtypes == overlap.index_of(library._tokens(rows)).dtypes
