import hashlib
import json
import math
import random
import re
import zipfile
from collections import Counter
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lexiloom import checks
from lexiloom.functions import text as T
from lexiloom.operators import baseline, corpus
from lexiloom.sources import artifacts, library, markup, records

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"
ARTICLE = """<article xmlns:xlink="http://www.w3.org/1999/xlink"><front><article-meta><title-group><article-title>A <i>b</i>old title</article-title></title-group>
<contrib-group><contrib contrib-type="author"><name><surname>Doe</surname><given-names>Ann</given-names></name></contrib><contrib contrib-type="editor"><name><surname>Ed</surname><given-names>It</given-names></name></contrib></contrib-group>
<article-id pub-id-type="doi">10.1/x</article-id><permissions><license xlink:href="{url}"><license-p>Open{more}</license-p></license></permissions>
<abstract><title>Abstract</title><sec><title>Background</title><p>The micro<sup>o</sup>rganism was studied.</p></sec><p>Methods</p></abstract></article-meta></front>
<body><p>Body text.</p><fig><p>Not this.</p></fig><sec><p>More <b>text</b>.</p></sec></body></article>"""
OPEN = "https://creativecommons.org/licenses/by/4.0/"


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('﻿{"id": "1", "text": "x"}\n\n{"id": "2", "text": "é"}\n', encoding="utf-8")
    rows = records.read_json_lines(spark, str(tmp_path / "a.jsonl"), "id string, text string")
    assert sorted(r.id for r in rows.collect()) == ["1", "2"]
    ids = spark.createDataFrame([("2",)], "id string")
    assert [r.id for r in records.select_records(rows, ids, 1).collect()] == ["2"]
    with pytest.raises(checks.CheckFailed):
        records.select_records(rows, spark.createDataFrame([("9",)], "id string"))
    (tmp_path / "b.jsonl").write_text("{broken\n")
    with pytest.raises(Exception, match="MALFORMED"):
        records.read_json_lines(spark, str(tmp_path / "b.jsonl"), "id string").collect()


def test_labelled_csv(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text('id,prompt_id,text,generated\na,0,"Hello, ""you""\nthere",0\nb,1,Bye,1\n')
    got = {r.id: r for r in records.read_labelled_csv(spark, str(path), "DS").collect()}
    assert got["DS:a"].label == "human" and got["DS:a"].prompt_id == "DS:0" and got["DS:a"].text == 'Hello, "you"\nthere' and got["DS:b"].label == "ai" and got["DS:b"].generator is None
    path.write_text("id,prompt_id,text,generated\na,0,x,2\n")
    with pytest.raises(checks.CheckFailed):
        records.read_labelled_csv(spark, str(path), "DS")


def test_answers_keep_their_question(spark):
    df = spark.createDataFrame([("Why?", ["a", "b"], ["c"]), ("why? ", [], ["d"])], records.QA_SCHEMA)
    rows = records.flatten_answers(df, "Q").collect()
    assert len({r.id for r in rows}) == 4 and len({r.source_group for r in rows}) == 1
    assert sorted((r.label, r.text) for r in rows) == [("ai", "c"), ("ai", "d"), ("human", "a"), ("human", "b")]


def test_zip_members_and_listing(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("in/a.txt", "hello")
    (r,) = records.zip_members(spark, str(tmp_path / "x.zip")).collect()
    assert (r.member, r.bytes, r.sha256) == ("in/a.txt", 5, hashlib.sha256(b"hello").hexdigest())
    with pytest.raises(Exception, match="budget"):
        records.zip_members(spark, str(tmp_path / "x.zip"), most_bytes=4).collect()
    found = records.file_listing(spark, str(tmp_path))
    assert records.inventory_differences(found, found).count() == 0
    assert [r.problem for r in records.inventory_differences(found, found.withColumn("sha256", F.lit("0"))).collect()] == ["hash"]


def test_articles(spark):
    xml = [ARTICLE.format(url=OPEN, more=""), ARTICLE.format(url=OPEN, more=" but noncommercial"), ARTICLE.format(url="https://creativecommons.org.evil.test/licenses/by/4.0/", more=""), "<broken", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xml)], "id int, xml string")
    got = {r.id: r for r in markup.articles(df, "id", "xml", full_text=True).collect()}
    assert got[0].text == "Abstract Background The microorganism was studied. Methods\n\nBody text.\n\nMore text."
    assert got[0].title == "A bold title" and got[0].authors == ["Ann Doe"] and got[0].license_id == "CC-BY-4.0" and got[0].doi == "10.1/x" and got[0].scope == "abstract_and_body"
    assert [got[i].problem for i in range(1, 5)] == ["conflicting_license", "unknown_or_ambiguous_license", "malformed_xml", "malformed_xml"]
    assert markup.articles(df, "id", "xml", all_contributors=True).where("id = 0").first().authors == ["Ann Doe", "It Ed"]


def test_html_text(spark):
    df = spark.createDataFrame([("<p>a&amp;b<b>c</b></p><script>x()</script><div>d</div>",), (None,)], "h string")
    assert [r[0] for r in df.select(markup.html_text("h")).collect()] == ["a&bc d", None]


def document(i, **more):
    base = {"document_id": i, "title": "t", "text": "one two three four five six", "url": "https://a.org/x", "license_id": "CC-BY-4.0", "license_url": "", "source_provider": "p", "metadata": '{"attribution": "x", "license_evidence": "y"}'}
    return base | more


def test_library_replaces_and_rejects(spark, tmp_path):
    schema = ", ".join(f"{k} string" for k in document("x"))
    bad = [document("b", license_id="CC-BY-NC-SA-4.0"), document("c", url="javascript:alert(1)"), document("d", url="https://u:p@a.org/"), document("e", url="https://a.org/\nx"), document("f", text="too short")]
    rejected = library.upsert(spark, str(tmp_path), spark.createDataFrame([document("a"), *bad], schema))
    assert {r.document_id: r.problems for r in rejected.collect()} == {"b": ["license"], "c": ["url"], "d": ["url"], "e": ["url"], "f": ["words"]}
    library.upsert(spark, str(tmp_path), spark.createDataFrame([document("a", text="seven eight nine ten eleven twelve"), document("g")], schema))
    docs, entries = library.open_library(spark, str(tmp_path))
    assert library.summary(docs).first().documents == 2
    assert {(r.document_id, r.gram.split("\x1f")[0]) for r in entries.collect()} == {("a", "seven"), ("g", "one")}
    assert sum(library.provenance_problems(docs).first()) == 0


def test_library_states_and_repeated_ids(spark, tmp_path):
    schema = ", ".join(f"{k} string" for k in document("x"))
    path = str(tmp_path / "lib")
    assert library.status(spark, path) == "unavailable"
    with pytest.raises(library.Unavailable):
        library.open_library(spark, path)
    library.upsert(spark, path, spark.createDataFrame([], schema))
    assert library.status(spark, path) == "empty"
    told = library.upsert(spark, path, spark.createDataFrame([document("a"), document("b"), document("b", text="another text of just these seven words")], schema))
    assert [(r.document_id, r.problems) for r in told.collect()] == [("b", ["repeated"])] * 2
    assert library.status(spark, path) == "ready" and [r.document_id for r in library.open_library(spark, path)[0].collect()] == ["a"]
    for pointer in (tmp_path / "lib").glob("*current-*.json*"):
        pointer.unlink()
    with pytest.raises(checks.CheckFailed, match="pointer"):
        library.open_library(spark, path)


def test_two_writers_do_not_take_one_version(spark, tmp_path):
    artifacts.write_text(spark, str(tmp_path / "current-1.json"), "{}")
    with pytest.raises(checks.CheckFailed, match="taken"):
        artifacts.write_text(spark, str(tmp_path / "current-1.json"), "[]")
    assert artifacts.read_text(spark, str(tmp_path / "current-1.json")) == "{}"


def test_incremental_sink(spark, tmp_path):
    path = str(tmp_path / "out")
    sink = artifacts.IncrementalSink(spark, path)
    for n in (0, 1, 1):
        sink.write(spark.createDataFrame([(n, "é")], "n int, t string"), n)
    assert not artifacts.exists(spark, path) and sink.progress == {0: 1, 1: 1}
    with pytest.raises(checks.CheckFailed, match="partial"):
        artifacts.IncrementalSink(spark, path)
    assert sink.finish() == 2 and sorted(r.n for r in spark.read.json(path).collect()) == [0, 1]
    with pytest.raises(checks.CheckFailed, match="taken"):
        artifacts.IncrementalSink(spark, path)


def test_models_are_bound_to_their_files(spark, tmp_path):
    rows = [(i, "good green words here today" if i % 2 else "bad red terms there now", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, text string, label int")
    model = baseline.train(df)
    artifacts.save_model(model, str(tmp_path / "m"), seed=42)
    again = artifacts.load_model(spark, str(tmp_path / "m"))
    assert [r.score for r in baseline.predict(again, df).orderBy("id").collect()] == [r.score for r in baseline.predict(model, df).orderBy("id").collect()]
    changed = next((tmp_path / "m" / "metadata").glob("part-*"))
    changed.write_text(changed.read_text() + " ")
    for crc in (tmp_path / "m" / "metadata").glob(".part-*"):
        crc.unlink()
    with pytest.raises(checks.CheckFailed, match="metadata"):
        artifacts.load_model(spark, str(tmp_path / "m"))


def test_essays_need_their_prompts(spark, tmp_path):
    (tmp_path / "e.csv").write_text("id,prompt_id,text,generated\na,0,Hello,0\nb,1,Bye,1\n")
    (tmp_path / "p.csv").write_text('prompt_id,prompt_name\n0,"A, b"\n')
    with pytest.raises(checks.CheckFailed, match="prompts not found: 1"):
        records.read_essays(spark, str(tmp_path / "e.csv"), str(tmp_path / "p.csv"), "DS")
    (tmp_path / "p.csv").write_text("prompt_id,prompt_name\n0,x\n1,y\n")
    assert records.read_essays(spark, str(tmp_path / "e.csv"), str(tmp_path / "p.csv"), "DS").count() == 2


def test_fixtures_fail_as_a_whole(spark, tmp_path):
    case = {"id": "a", "title": "t", "text": "x", "text_sha256": hashlib.sha256(b"x").hexdigest(), "provenance": {"kind": "made"}}
    path = tmp_path / "c.json"
    path.write_text(json.dumps([case, case | {"id": "b"}]))
    assert records.verified_cases(spark, str(path), ["made"]).count() == 2
    for wrong in ({"id": "a"}, {"id": "b", "text": "y"}, {"id": "b", "provenance": {"kind": "found"}}):
        path.write_text(json.dumps([case, case | wrong]))
        with pytest.raises(checks.CheckFailed):
            records.verified_cases(spark, str(path), ["made"])


def test_shown_scores(spark):
    values = [0.0, 1.0, 0.5, 0.1, 1 / 3, 1e-7, 1.23456789012e-7, 0.00012, 0.000123456789012, 1.5, float("nan"), None]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    assert [r[0] for r in df.select(T.shown_score(F.col("x"))).collect()] == [
        "0.000000000", "1.000000000", "0.5000000000", "0.1000000000", "0.3333333333333333", "1.000000000e-7", "1.23456789012e-7", "0.0001200000000", "0.000123456789012",
        "Unavailable", "Unavailable", "Unavailable",
    ]


def test_shown_scores_equal_their_sql_below_a_thousandth(spark, tmp_path):
    # scores of these texts without quality: 0.0000146, 0.0000407, 0.0000071, 0.0000105914
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT unnest([34290, 36372, 2985100, 203612, 1])::BIGINT AS doc_id")
    con.execute("CREATE TABLE labels AS SELECT doc_id, 0 AS quality, 0 AS toxic FROM documents")
    con.execute("CREATE OR REPLACE TABLE documents AS SELECT doc_id, 'text ' || doc_id AS text, 'en' AS lang, 'src' AS source, 10::BIGINT AS n_chars FROM documents")
    for t in ("documents", "labels"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    got = {tuple(r) for r in __spark_entry__.queries()["shown_scores"](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(__spark_entry__.oracle_sql()["shown_scores"]).fetchall())
    assert (34290, "1.4552788343280554e-05") in got


def test_blob_ids_and_softmax(spark):
    df = spark.createDataFrame([(bytearray(b"hello\n"), [800.0, 800.0]), (bytearray(b""), [float("inf"), 0.0])], "b binary, l array<double>")
    assert [r[0] for r in df.select(T.git_blob_id(F.col("b"))).collect()] == ["ce013625030ba8dba906f756967f9e9ca394464a", "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"]
    assert [r[0] for r in df.select(T.softmax_first(F.col("l"))).collect()] == [0.5, None]


def test_digest_does_not_depend_on_order(spark):
    df = spark.range(5_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("line"))
    a, b = (corpus.digest(x, "id", F.col("line"), fan=16).first().sha256 for x in (df, df.repartition(7, "line")))
    assert a == b != corpus.digest(df.where("id <> 77"), "id", F.col("line"), fan=16).first().sha256


def test_page_text_is_that_of_a_plain_reader(spark):
    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.skipped = [], 0

        def handle_starttag(self, tag, attrs):
            self.skipped += tag in markup.HTML_SKIPPED
            self.out.append(" " if tag in markup.HTML_BLOCKS else "")

        def handle_endtag(self, tag):
            self.skipped -= tag in markup.HTML_SKIPPED
            self.out.append(" " if tag in markup.HTML_BLOCKS else "")

        def handle_data(self, data):
            self.out.append("" if self.skipped else data)

    for r in __spark_entry__.queries()["page_text"](spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet"), "page_id").collect():
        reader = Reader()
        reader.feed(r.html)
        reader.close()
        assert r.text.split() == "".join(reader.out).split()


def test_frozen_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", "train"), ("b", "test")], "text string, split string").withColumn("text_sha256", F.sha2("text", 256))
    library.freeze(df, str(tmp_path / "f"), ["text_sha256"])
    assert library.load_frozen(spark, str(tmp_path / "f"), ["text_sha256"]).count() == 2
    with pytest.raises(Exception, match="exists"):
        library.freeze(df, str(tmp_path / "f"), ["text_sha256"])
    part = next((tmp_path / "f" / "split=test").glob("part-*"))
    part.unlink()
    with pytest.raises(checks.CheckFailed, match="missing"):
        library.load_frozen(spark, str(tmp_path / "f"), ["text_sha256"])
    with pytest.raises(checks.CheckFailed):
        library.freeze(df.unionByName(df.withColumn("split", F.lit("other"))), str(tmp_path / "g"), ["text_sha256"])


def test_requests(spark):
    df = spark.createDataFrame([("",), ("x" * 50_001,), ("a\x00b",), ("w " * 12_001,), ("fine",)], "t string")
    assert [r[0] for r in df.select(library.request_problem(F.col("t"))).collect()] == ["blank", "too long", "invalid characters", "too many words", None]


def test_draw_of_the_largest_hash(spark):
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    for r in df.select("k", T.draw("s", F.col("k")).alias("u")).collect():
        assert r.u == int(hashlib.sha256(f"s:{r.k}".encode()).hexdigest()[:16], 16) / 2**64


def test_baseline_learns(spark):
    rows = [(i, "good green words here today" if i % 2 else "bad red terms there now", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, text string, label int")
    told = baseline.predict(baseline.train(df.where("id < 40")), df.where("id >= 40"))
    assert all((r.score > 0.5) == (r.label == 1) for r in told.collect())


def plain_vectors(texts, n_fit):
    """Vectors of all texts by the definition, fitted on the first ones: (dense rows by term, terms)."""
    blocks = []
    for analyse, least in ((plain_words, 2), (plain_chars, 3)):
        told = [Counter(analyse(t)) for t in texts]
        df = Counter(x for c in told[:n_fit] for x in c)
        terms = sorted(x for x, k in df.items() if k >= least)
        rows = np.array([[(1 + math.log(c[x])) * (math.log((1 + n_fit) / (1 + df[x])) + 1) if c[x] else 0.0 for x in terms] for c in told])
        blocks.append(rows / np.maximum(np.sqrt((rows**2).sum(1)), 1e-300)[:, None])
    return np.hstack([*blocks, np.ones((len(texts), 1))])


def plain_words(text):
    w = [x for x in re.findall(r"\w+", text.lower()) if len(x) > 1]
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def plain_chars(text):
    t = re.sub(r"\s\s+", " ", text.lower())
    return [t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1)]


def test_baseline_equals_a_plain_version(spark):
    """Vectors by their definition, and weights at the only point where the penalised loss has no slope."""
    rng = random.Random(3)
    words = ["Good", "green", "bad", "red", "über", "x", "naïve", "4 5", "the\n\n", "the "]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 14))) for _ in range(60)] + ["", "  ", None]
    labels = [(("bad" in (t or "")) or k % 5 == 0) * 1 for k, t in enumerate(texts)]
    df = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(zip(texts, labels, strict=True))], "id int, text string, label int")
    model = baseline.train(df.where("id < 50"))
    x = plain_vectors([t or "" for t in texts], 50)
    got = model.stages[0].transform(df).orderBy("id").select("features").collect()
    mine = np.array([r.features.toArray() for r in got])
    assert mine.shape == x.shape and np.allclose(mine @ mine.T, x @ x.T, atol=1e-12)
    assert np.allclose(np.sort(mine.sum(0)), np.sort(x.sum(0)))
    y = np.array(labels[:50]) * 2 - 1
    weight = np.where(y > 0, 50 / (2 * (y > 0).sum()), 50 / (2 * (y < 0).sum()))
    w = model.stages[1].coefficients.toArray()
    slope = w - mine[:50].T @ (weight * y / (1 + np.exp(y * (mine[:50] @ w))))
    assert np.abs(slope).max() < 1e-3 * np.abs(w).max()
    scores = [r.score for r in baseline.predict(model, df).orderBy("id").collect()]
    assert np.allclose(scores, 1 / (1 + np.exp(-mine @ w)))


def test_baseline_fits_a_bounded_sample(spark):
    df = spark.createDataFrame([(k, f"word{k % 7} and word{k % 3} stand here", k % 2) for k in range(50)], "id int, text string, label int")
    model = baseline.train(df, most=20)
    again = baseline.train(df.repartition(5), most=20)
    assert model.stages[0].getOrDefault(model.stages[0].wordTerms) == again.stages[0].getOrDefault(again.stages[0].wordTerms)
    assert baseline.predict(model, df).count() == 50


def test_baseline_vocabulary_is_the_most_frequent(spark, monkeypatch):
    monkeypatch.setattr(baseline, "_KINDS", {"word": (baseline.word_terms, 3, 2), "char": (baseline.char_terms, 5, 3)})
    texts = ["aa bb cc", "aa bb cc dd dd", "aa aa bb dd", "once only"]
    stage = baseline.vocabulary(spark.createDataFrame([(t,) for t in texts], "text string"))
    counts, df = Counter(w for t in texts for w in plain_words(t)), Counter(w for t in texts for w in set(plain_words(t)))
    parts = lambda w: set(baseline.word_terms(w)[0].tolist())
    term = lambda w: min(parts(w).difference(*(parts(x) for x in w.split() if x != w)))
    want = sorted((-n, term(w), w) for w, n in counts.items() if df[w] > 1)[:3]
    idf = dict(zip(stage.getOrDefault(stage.wordTerms), stage.getOrDefault(stage.wordIdf), strict=True))
    assert idf == {t: pytest.approx(math.log(5 / (1 + df[w])) + 1) for _, t, w in want} and len(stage.getOrDefault(stage.charTerms)) == 5


def test_baseline_scores_all_labelled_documents(spark):
    rows = __spark_entry__.queries()["baseline_scores"](spark, SF).collect()
    wanted = spark.read.parquet(f"{SF}/labels.parquet").join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").select("doc_id").collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in wanted)
    assert {r.split for r in rows} == {"train", "calibration", "test"}


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda v: repr(v) if isinstance(v, float) else str(v)
    return [columns[i] for i in order], sorted(tuple(fix(row[i]) for i in order) for row in rows)


def test_exact_duplicates_are_hashed_once(spark):
    df = spark.createDataFrame([(1, "x", "Same  text"), (2, "x", "same text"), (3, "y", "other"), (4, "x", "OTHER"), (5, "x", None)], "doc_id long, lang string, text string")
    admitted, removed, conflicts = corpus.exact_dedup(df, "doc_id", "lang", "text")
    assert all("regexp_replace" not in x._jdf.queryExecution().optimizedPlan().toString() for x in (removed, conflicts))
    assert [tuple(r) for r in removed.collect()] == [(2, 1)] and sorted(r.id for r in conflicts.collect()) == [3, 4] and sorted(r.doc_id for r in admitted.collect()) == [1, 5]


def test_excerpts_are_cut_once(spark):
    df = spark.createDataFrame([("a", "w " * 100), ("b", None)], "doc_id string, text string")
    cut = corpus.excerpts(df, "doc_id", "text")
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [(r.id, r.words) for r in cut.collect()] == [("a", 100)]


@pytest.mark.parametrize("name", sorted(k for k in __spark_entry__.oracle_sql() if not k.startswith("op") and k != "pipeline"))
def test_queries_equal_their_oracles(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, SF)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    told = con.execute(__spark_entry__.oracle_sql()[name])
    assert got == canonical([c[0] for c in told.description], told.fetchall())


@pytest.mark.parametrize("name", sorted(k for k in __spark_entry__.queries() if k not in __spark_entry__.oracle_sql() and not k.startswith("op") and k != "pipeline"))
def test_other_queries_run(spark, name):
    df = __spark_entry__.queries()[name](spark, SF)
    assert len(df.columns) == len(set(df.columns)) and df.count() >= 0
