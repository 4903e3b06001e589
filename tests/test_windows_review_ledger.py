import json
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lexiloom.operators import ledger, review, windows
from lexiloom.streaming.ledger import ledger_stream, ordered_ledger_stream, step, upsert_batches


def docs(spark, texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")


def sizes(spark, n):
    rows = windows.word_windows(docs(spark, ["w " * n]), "doc_id", "text").orderBy("window_no").collect()
    return [(r.words, r.scheduled) for r in rows]


def test_window_sizes(spark):
    assert sizes(spark, 610) == [(153, True), (153, True), (152, True), (152, True)]
    assert sizes(spark, 250) == [(250, True)]
    assert sizes(spark, 2400) == [(200, True)] * 12
    assert sizes(spark, 2500) == [(200, True)] * 12 + [(100, False)]
    assert sizes(spark, 0) == [(0, True)]


def test_windows_tile_any_text(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab \n\t 😀") for _ in range(rng.randrange(0, 4000))) for _ in range(30)] + ["", "  ", "\x1cx"]
    rows = windows.word_windows(docs(spark, texts), "doc_id", "text").collect()
    for i, text in enumerate(texts):
        own = sorted((r for r in rows if r.id == str(i)), key=lambda r: r.window_no)
        assert "".join(r.text for r in own) == text
        at = 0
        for r in own:
            assert r.start == at
            at += len(r.text)


def factory(values, truncated=False):
    def make():
        def score(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame({"score": texts.map(lambda t: values.get(t.split()[0], 0.5) if t.split() else 0.5), "truncated": [truncated] * len(texts)})

        return score

    return make


def run(spark, text, values, truncated=False):
    w = windows.word_windows(docs(spark, [text]), "doc_id", "text")
    return windows.labelled(windows.with_scorer(w, "m", factory(values, truncated)), 0.2, 0.8)


def test_passage_verdicts(spark):
    both = run(spark, "a " * 180 + "b " * 180, {"a": 0.95, "b": 0.05})
    assert [r.label for r in both.orderBy("window_no").collect()] == ["ai_leaning", "human_leaning"]
    assert windows.verdict(both).first().label == "inconclusive"
    assert windows.model_summary(both).first().score == pytest.approx(0.5)
    one = run(spark, "a " * 180, {"a": 0.95})
    assert windows.verdict(one).first().label == "ai_leaning"
    short = run(spark, "a " * 79, {"a": 0.95}).first()
    assert (short.label, short.score) == ("inconclusive", 0.95)
    assert run(spark, "a " * 80, {"a": 0.95}).first().label == "ai_leaning"
    cut = windows.verdict(run(spark, "a " * 180, {"a": 0.95}, True)).first()
    assert (cut.label, cut.analyzed_characters) == ("inconclusive", 0)
    assert run(spark, "a " * 100, {"a": float("nan")}).first().status == "unavailable"


def test_secondary_model_never_vetoes(spark):
    a, b = run(spark, "a " * 100, {"a": 0.9}), run(spark, "a " * 100, {"a": 0.1})
    r = windows.combined(a, b).first()
    assert r.label == "ai_leaning" and r.second_label == "human_leaning" and r.disagrees


@pytest.mark.parametrize("most", [1, 4])
def test_scorers_get_micro_batches_of_like_length(spark, tmp_path, most):
    """Each call's texts and each load are written down by the workers."""
    log = str(tmp_path)

    def factory():
        import os
        import uuid

        import pandas as pd

        open(f"{log}/load-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def score(texts):
            with open(f"{log}/calls-{os.getpid()}", "a") as out:
                out.write(",".join(map(str, texts.str.len())) + "\n")
            return pd.DataFrame({"score": texts.str.len() / 1_000, "truncated": texts.str.len() > 500}, index=texts.index)

        return score

    texts = ["x" * (k * 37 % 900) for k in range(50)]
    df = spark.createDataFrame([(k, t, k % 7 > 0) for k, t in enumerate(texts)], "id int, text string, scheduled boolean").repartition(3).cache()
    for _ in range(2):
        got = {r.id: (r.score, r.truncated, r.status) for r in windows.with_scorer(df, "m", factory, most).collect()}
        assert got == {k: (len(t) / 1_000, len(t) > 500, "truncated" if len(t) > 500 else "ok") if k % 7 else (None, False, "not_scored") for k, t in enumerate(texts)}
    calls = [[int(n) for n in line.split(",")] for f in tmp_path.glob("calls-*") for line in f.read_text().splitlines()]
    assert max(map(len, calls)) == most and all(c == sorted(c) for c in calls)
    loads = [f.name.split("-")[1] for f in tmp_path.glob("load-*")]
    assert len(loads) == len(set(loads))
    with pytest.raises(ValueError):
        windows.with_scorer(df, "m", factory, 0)


@pytest.mark.parametrize("block", [4, 4_096])
def test_display_segments_of_random_spans(spark, monkeypatch, block):
    monkeypatch.setattr(windows, "BLOCK", block)
    monkeypatch.setattr(windows.following, "__defaults__", (block,))
    rng = random.Random(block)
    rows = [(rng.choice("xyz"), a := rng.randrange(60), a + rng.choice([0, 1, 2, 5, 9, 30])) for _ in range(90)] + [("x", None, 3), (None, 1, 2), ("alone", 7, 7)]
    want = []
    for g in {r[0] for r in rows if r[0]}:
        last = -1
        for a, b in sorted({r[1:] for r in rows if r[0] == g and r[1] is not None}):
            if a >= last:
                want.append((g, a, b))
                last = b
    assert sorted(map(tuple, windows.display_segments(spark.createDataFrame(rows, "k string, a int, b int"), "k", "a", "b").collect())) == sorted(want)


def test_display_segments_of_a_long_chain(spark):
    got = windows.display_segments(spark.range(20_000).select(F.lit("p").alias("k"), F.col("id").alias("a"), (F.col("id") + 2).alias("b")), "k", "a", "b")
    assert got.agg(F.count("*"), F.sum("a")).first()[:] == (10_000, sum(range(0, 20_000, 2)))


def test_display_segments_do_not_overlap(spark):
    df = spark.createDataFrame([("p", 0, 10), ("p", 5, 12), ("p", 10, 20), ("p", 19, 30), ("p", 20, 25)], "k string, a int, b int")
    assert [(r.a, r.b) for r in windows.display_segments(df, "k", "a", "b").orderBy("a").collect()] == [(0, 10), (10, 20), (20, 25)]


def split(text):
    return [text[a:b] for a, b in review.split_sentences(text)]


def test_sentences():
    assert split("Dr. Smith measured 3.5 mg. It was stable.") == ["Dr. Smith measured 3.5 mg.", "It was stable."]
    assert split("We used e.g. red markers. It worked.") == ["We used e.g. red markers.", "It worked."]
    assert split("He said “stop.” Then left") == ["He said “stop.”", "Then left"]
    assert split("J. Doe came. One\n\ntwo") == ["J. Doe came.", "One", "two"]
    assert split("   ") == []


def checked(spark, text, items):
    d = docs(spark, [text])
    answers = spark.createDataFrame([("0", json.dumps({"suggestions": items}) if isinstance(items, list) else items)], "id string, raw_json string")
    spans = review.sentences(d, "doc_id", "text")
    parsed = review.parse_answers(answers)
    return d, parsed, review.check_suggestions(parsed, spans)


def item(sid, kind="redundancy", rewrite="Shorter words here."):
    return {"sentence_id": sid, "issue_type": kind, "rewrite": rewrite}


def test_answers_beside_their_sentences_are_checked_as_apart(spark):
    text = "Same words 😀 here, Dr. Who. Values were 3.5 mg\n\n  It was long and was not short. No?"
    d = docs(spark, [text])
    answers = [
        [item("s1"), item("s1", rewrite="Other words here.")], [item("s9"), item("s3", rewrite="It WAS long, and was not short")], [item("s2", rewrite="Values were 4 mg")],
        [item("s3", "citation_needed"), item("s4", rewrite="No, 5!")], [item("s3", rewrite="'summary': x")], [item("s3", "nonsense")], "no json",
    ]
    raw = [json.dumps({"suggestions": x}) if isinstance(x, list) else x for x in answers]
    rows = spark.createDataFrame(list(enumerate(raw)), "id int, raw_json string")
    cases = rows.crossJoin(review.sentence_lists(d, "doc_id", "text").select("sentences"))
    got = review.check_answers(cases).select("id", F.inline("checks"))
    spans = rows.select("id").crossJoin(review.sentences(d, "doc_id", "text").drop("id"))
    want = review.check_suggestions(review.parse_answers(rows), spans)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and want.count() == 8
    whole = text.encode("utf-16-le")
    assert all(whole[2 * r.from_utf16 : 2 * r.to_utf16].decode("utf-16-le") == r.quote for r in got.where("quote is not null").collect())


@pytest.mark.parametrize("name", ["suggestion_checks", "anchored_suggestions", "judged_reviews", "review_totals"])
def test_reviews_shuffle_nothing_and_write_no_table(spark, name):
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Join", "Aggregate", "Window"))
    # the texts are cut and the answers read once
    assert plan.count("_sentence_rows(") == 1 and plan.count("from_json(") == 1


def test_suggestions_are_anchored_by_sentence(spark):
    text = "Same words 😀 here. Same words here."
    d, _, got = checked(spark, text, [item("s2"), item("s9")])
    assert sorted(r.action for r in got.collect()) == ["accepted", "dropped"]
    (a,) = review.anchored(got, d, "doc_id", "text").collect()
    assert text.encode("utf-16-le")[2 * a.from_utf16 : 2 * a.to_utf16].decode("utf-16-le") == "Same words here." == a.quote
    assert a.issue == review.GUIDANCE["redundancy"][0]


@pytest.mark.parametrize("text,one,want", [
    ("All 12 samples froze.", item("s1"), ("protected", None)),
    ("All 12 samples froze", item("s1"), ("accepted", "")),
    ("It is plainly true.", item("s1", rewrite="It is plainly TRUE!"), ("dropped", None)),
    ("It is plainly true.", item("s1", "citation_needed"), ("accepted", "")),
    ("It failed because", item("s1"), ("accepted", "")),
    ("It is plainly true.", item("s1", rewrite="It holds in 3 cases."), ("accepted", "")),
    ("It is plainly true.", item("s1", rewrite="It holds [in 3 cases]"), ("accepted", "It holds [in 3 cases].")),
    ("It is plainly true.", item("s1", rewrite="{'why': 'x'} done."), ("dropped", None)),
])
def test_rules_for_rewrites(spark, text, one, want):
    r = checked(spark, text, [one])[2].first()
    assert (r.action, r.rewrite) == want


def test_answers_that_break_the_format(spark):
    for bad in ("not json", "{}", json.dumps({"suggestions": [], "more": 1}), json.dumps({"suggestions": [item("s1")] * 3}), json.dumps({"suggestions": [item("s1", "style")]})):
        assert [r.valid for r in checked(spark, "One. Two.", bad)[1].collect()] == [False]
    assert [r.action for r in checked(spark, "One thing. Two.", [item("s1"), item("s1", rewrite="Other words.")])[2].orderBy("item_no").collect()] == ["accepted", "dropped"]


def test_judge(spark):
    schema = (
        "id string, text string, status string, assessment string, authorship_opinion string, summary string, edits array<struct<sentence_id:string,quote:string,start:int,end:int,rewrite:string,issue:string,why:string,suggestion:string>>, "
        "minimum_edits int, maximum_edits int, shorter_ratio double, preserve_quoted_numbers boolean, no_nonempty_rewrite boolean, forbidden_rewrite_pattern string, required_rewrite_pattern string, forbidden_generated_pattern string, must_edit_sentence string"
    )
    edit = ("s1", "It is big.", 0, 10, "It may [be] big", "A.", "B.", "C.")
    rows = [
        ("good", "It is big.", "complete", None, "not_provided", "One.", [("s1", "It is big.", 0, 10, "Big.", "A.", "B.", "C.")], 1, 2, 0.9, True, None, None, None, None, "s1"),
        ("bad", "It is big.", "complete", "x", "not_provided", "One", [edit], 2, 2, 0.5, True, True, "may", "might", "big", "s2"),
        ("open", "t", "partial", None, None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    got = {r.id: r.failures for r in review.judge(spark.createDataFrame(rows, schema)).collect()}
    assert got["good"] == [] and got["open"] == ["review_not_complete"]
    assert got["bad"] == sorted([
        "unexpected_authorship_opinion", "missing_useful_edit", "placeholder_instead_of_edit", "incomplete_rewrite", "invented_completion", "not_materially_more_concise",
        "overclaim_retained", "missing_qualified_rewrite", "followed_embedded_instruction", "missed_target_sentence", "incomplete_feedback_prose",
    ])


def test_judge_takes_lists_of_forbidden_patterns(spark):
    schema = (
        "id string, text string, status string, assessment string, authorship_opinion string, summary string, edits array<struct<sentence_id:string,quote:string,start:int,end:int,rewrite:string,issue:string,why:string,suggestion:string>>, "
        "minimum_edits int, maximum_edits int, shorter_ratio double, preserve_quoted_numbers boolean, no_nonempty_rewrite boolean, forbidden_rewrite_patterns array<string>, required_rewrite_pattern string, forbidden_generated_patterns array<string>, must_edit_sentence string"
    )
    edit = ("s1", "It is big.", 0, 10, "It proves much.", "A.", "Ignore it.", "C.")
    case = lambda i, rewrite, generated: (i, "It is big.", "complete", None, "not_provided", "One.", [edit], None, None, None, None, None, rewrite, None, generated, None)
    rows = [case("none", None, None), case("empty", [], []), case("apart", ["shows", None], ["never"]), case("second", ["shows", "PROVES?"], []), case("both", ["much"], ["never", "ignore\\s"])]
    got = {r.id: r.failures for r in review.judge(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"none": [], "empty": [], "apart": [], "second": ["overclaim_retained"], "both": ["followed_embedded_instruction", "overclaim_retained"]}


def observations(rng, n):
    return [(f"i{rng.randrange(4)}", k, rng.random() < 0.6, rng.random() < 0.2) for k in range(n)]


def folded(rows):
    state, out = {}, []
    for issue, seq, passed, blocking in rows:
        before = state.get(issue, (None, False, False, False))
        state[issue], told = step(before, passed, blocking)
        if told:
            out.append((issue, seq, told, state[issue][3], told != before[0]))
    return out


def test_ledger_closed_form_equals_the_fold(spark):
    rows = observations(random.Random(5), 120)
    df = spark.createDataFrame(rows, "issue string, seq long, passed boolean, blocking boolean")
    got = sorted(map(tuple, ledger.transitions(df, "issue", ["seq"]).collect()))
    assert got == sorted(folded(rows))
    last = {r[0]: r[2] for r in folded(rows)}
    assert {r.issue: r.status for r in ledger.fold(df, "issue", ["seq"]).collect()} == last


def test_ledger_stream_equals_the_fold(spark, tmp_path):
    rows = observations(random.Random(6), 60)
    schema = "issue string, seq long, passed boolean, blocking boolean"
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = ledger_stream(stream).writeStream.format("memory").queryName("ledger_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("ledger_rows").collect())) == sorted(folded(rows))


def test_ordered_stream_equals_the_batch_ledger_and_a_restart_repeats_no_row(spark, tmp_path):
    """Observations come out of order within the delay, in four batches; the third runs again after a restart."""
    rng = random.Random(8)
    rows = [(issue, k * 60 + rng.randrange(60), k, passed, blocking) for k, (issue, _, passed, blocking) in enumerate(observations(rng, 90))]
    mixed = sorted(rows, key=lambda r: r[1] + rng.randrange(900))
    schema = "issue string, ts timestamp, seq long, passed boolean, blocking boolean"
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))

    def arrive(part):
        df = spark.createDataFrame(part, "issue string, t long, seq long, passed boolean, blocking boolean")
        df.select("issue", F.timestamp_seconds("t").alias("ts"), "seq", "passed", "blocking").coalesce(1).write.mode("append").json(source)

    def run():
        stream = spark.readStream.schema(schema).json(source)
        q = ordered_ledger_stream(stream, "20 minutes").writeStream.foreachBatch(upsert_batches(sink)).outputMode("append").option("checkpointLocation", checkpoint).start()
        q.processAllAvailable()
        q.stop()

    for part in (mixed[:30], mixed[30:60], mixed[60:]):
        arrive(part)
        run()
    arrive([("end", 10**6, 0, True, False)])
    run()
    told = lambda: sorted(tuple(r) for r in spark.read.parquet(sink).select("issue", "seq", "status", "blocking", "changed").collect())
    ordered = spark.createDataFrame(rows, "issue string, t long, seq long, passed boolean, blocking boolean")
    want = sorted(tuple(r) for r in ledger.transitions(ordered, "issue", ["t", "seq"]).select("issue", "seq", "status", "blocking", "changed").collect())
    assert len(want) > 20 and told() == want
    commits = sorted((int(f.name) for f in (tmp_path / "cp" / "commits").iterdir() if f.name.isdigit()))
    for name in (f"{commits[-1]}", f".{commits[-1]}.crc"):
        (tmp_path / "cp" / "commits" / name).unlink(missing_ok=True)
    run()
    assert told() == want


def test_gates_and_review_slots(spark):
    gates = spark.createDataFrame([("a", ["x", "y"]), ("b", []), ("c", ["z"])], "gate string, check_ids array<string>")
    checks = spark.createDataFrame([("x", True), ("y", True), ("z", False)], "check_id string, passed boolean")
    assert {r.gate: r.passed for r in ledger.gate_status(gates, checks).collect()} == {"a": True, "b": False, "c": False}
    slots = spark.createDataFrame([("s1", True), ("s2", True), ("s3", False)], "slot string, required boolean")
    reviews = spark.createDataFrame([("s1", "ann", True), ("s2", "ann", True), ("s3", "bob", True)], "slot string, reviewer string, approved boolean")
    assert {r.slot: r.passed for r in ledger.review_slots(slots, reviews).collect()} == {"s1": False, "s2": False, "s3": True}
    book = spark.createDataFrame([("i", "open", True), ("j", "open", False), ("k", "resolved", True)], "issue string, status string, blocking boolean")
    assert ledger.decide(book).first().decision == "block"
    assert [r.issue for r in ledger.blockers(book, "issue").collect()] == ["i"]
    assert ledger.decide(book.where(F.col("issue") != "i")).first().decision == "promote"


def test_long_texts_are_split_in_linear_time():
    for text, n in (("Short words stand here. " * 45_000, 45_000), ("a.b" * 350_000, 1), ("A. " * 300_000, 1), ("\n " * 500_000, 0), (". " * 200_000, 200_000)):
        start = time.perf_counter()
        assert len(review.split_sentences(text)) == n
        assert time.perf_counter() - start < 5


def test_stop_reasons(spark):
    runs = {"a": ["x", "y", "y", "z"], "b": ["x", "+", "+"], "c": ["x", "y"], "d": []}
    rows = [(k, i, "promote" if s == "+" else "block", s, 10.0 * i) for k, v in runs.items() for i, s in enumerate(v)]
    df = spark.createDataFrame(rows, "run string, i int, decision string, signature string, elapsed double")
    got = {r.run: (r.iterations, r.decision, r.stop_reason) for r in ledger.stop_reasons(df, "run", ["i"], 100).collect()}
    assert got == {"a": (3, "block", "no_progress"), "b": (2, "promote", "promoted"), "c": (2, "block", "max_iterations")}
    got = {r.run: (r.iterations, r.decision, r.stop_reason) for r in ledger.stop_reasons(df, "run", ["i"], 0).collect()}
    assert got["a"] == (0, "block", "time_budget")


def test_protocols(spark):
    good = {"version": 1, "allowed_scripts": ["a.py"], "implementation_paths": ["src"], "input_paths": [], "checks": [{"id": "c", "script": "a.py"}], "gates": [{"id": "g", "description": "d", "check_ids": ["c"]}], "review_slots": []}
    wrong = {
        "version": good | {"version": 3}, "unknown fields": good | {"more": 1}, "no checks": good | {"checks": [], "gates": []}, "none required": good | {"checks": [{"id": "c", "script": "a.py", "required": False}]},
        "outputs": good | {"checks": [{"id": "c", "script": "a.py", "output": "xml"}]}, "descriptions": good | {"gates": [{"id": "g", "description": " ", "check_ids": []}]}, "no implementation": good | {"implementation_paths": []},
        "missing lists": {k: v for k, v in good.items() if k != "review_slots"},
    }
    df = spark.createDataFrame([("good", json.dumps(good)), *((k, json.dumps(v)) for k, v in wrong.items())], "id string, protocol string")
    got = {r.id: r.problems for r in ledger.protocol_problems(df).collect()}
    assert got.pop("good") == [] and all(k in v for k, v in got.items())


def test_runs_of_other_versions_are_not_comparable(spark):
    schema = "id int, score double, label string, model_revision string"
    a = spark.createDataFrame([(1, 0.2, "x", "r1"), (2, 0.2, "x", "r1"), (3, 0.2, "x", "r1"), (4, None, "x", "r1")], schema)
    b = spark.createDataFrame([(1, 0.3, "x", "r1"), (2, 0.3, "y", "r1"), (3, 0.2, "x", "r2"), (4, 0.1, "x", "r1"), (5, 0.1, "x", "r1")], schema)
    got = {r.id: r.signal for r in windows.compare_runs(a, b).collect()}
    assert got == {1: "Same signal", 2: "Signal changed", 3: "Not comparable", 4: "Not comparable", 5: "Not comparable"}


def test_rollup_of_devices_and_time(spark):
    df = spark.createDataFrame([(True, True, 5, "ok", "gpu", 10.0), (False, True, 7, "ok", "cpu", 2.5), (False, False, 9, "not_scored", None, None)], "truncated boolean, scheduled boolean, words int, status string, device string, milliseconds double")
    assert tuple(windows.rollup(df).first()) == (1, 12, "not_scored,ok", "cpu,gpu", 12.5)
