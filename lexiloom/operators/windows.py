"""Windowed scoring: texts in bounded word windows, pluggable scorers, and aggregates that abstain."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import NOT_SPACE, utf16_offset
from lexiloom.storage import Scratch

# Windows of a text, target and most words of a window, most words of a single window, least words for a label.
MAX_WINDOWS, TARGET_WORDS, MAX_WORDS, SINGLE_WORDS, LEAST_WORDS = 12, 180, 200, 250, 80
#: Places of a passage whose spans are in one task.
BLOCK = 4_096


def word_windows(docs: DataFrame, id_col: str, text_col: str, target: int = TARGET_WORDS, most: int = MAX_WINDOWS) -> DataFrame:
    """id, window_no, n_windows, words, scheduled, start, text: windows that tile the text exactly.

    Up to 250 words one window; up to 12 x 200 words even windows of about ``target`` words, the remainder
    first; beyond, 12 windows of 200 words and an unscored tail. A window starts at its first word and ends
    where the next starts, so white space belongs to the window before it; ``start`` is a code point from 0.

    The text is cut at word starts by one split; windows are slices of the pieces, joined again.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lead = F.regexp_extract(text, rf"^(?:(?!{NOT_SPACE})[\s\S])*", 0)
    # a word with the white space after it
    pieces = F.regexp_extract_all(text, F.lit(rf"{NOT_SPACE}+(?:(?!{NOT_SPACE})[\s\S])*"), F.lit(0))
    base = docs.select(F.col(id_col).alias("id"), text.alias("whole"), lead.alias("lead"), pieces.alias("pieces")).withColumn("n", F.size("pieces"))
    number = (
        F.when(F.col("n") <= SINGLE_WORDS, F.lit(1))
        .when(F.col("n") <= most * MAX_WORDS, F.least(F.lit(most), F.ceil(F.col("n") / target).cast("int")))
        .otherwise(F.lit(most))
    )
    full = (F.col("n") > SINGLE_WORDS) & (F.col("n") > most * MAX_WORDS)
    base = base.withColumn("k", number).withColumn("tail", full)
    each = F.when(full, F.lit(MAX_WORDS)).otherwise(F.expr("n div k"))
    extra = F.when(full, F.lit(0)).otherwise(F.col("n") % F.col("k"))
    base = base.withColumn("each", each.cast("int")).withColumn("extra", extra.cast("int"))
    rows = base.withColumn("w", F.explode(F.sequence(F.lit(0), F.col("k") - 1 + F.col("tail").cast("int"))))
    scheduled = F.col("w") < F.col("k")
    first = F.when(scheduled, F.col("w") * F.col("each") + F.least("w", "extra")).otherwise(F.col("k") * MAX_WORDS)
    size = F.when(scheduled, F.col("each") + (F.col("w") < F.col("extra")).cast("int")).otherwise(F.col("n") - F.col("k") * MAX_WORDS)
    rows = rows.withColumn("first", first.cast("int")).withColumn("words", size.cast("int"))
    joined = F.array_join(F.slice("pieces", F.col("first") + 1, F.col("words")), "")
    before = F.array_join(F.slice("pieces", F.lit(1), F.col("first")), "")
    whole = F.when(F.col("w") == 0, F.concat("lead", joined)).otherwise(joined)
    start = F.when(F.col("w") == 0, F.lit(0)).otherwise(F.length("lead") + F.length(before))
    return rows.select("id", F.col("w").alias("window_no"), (F.col("k") + F.col("tail").cast("int")).alias("n_windows"), "words", scheduled.alias("scheduled"), start.cast("int").alias("start"), whole.alias("text"))


_LOADED: dict[str, Callable[[pd.Series], pd.DataFrame]] = {}


def _loaded(key: str, factory: Callable[[], Callable[[pd.Series], pd.DataFrame]]) -> Callable[[pd.Series], pd.DataFrame]:
    """The factory's scorer, made once in a worker's life."""
    if key not in _LOADED:
        _LOADED[key] = factory()
    return _LOADED[key]


def in_micro_batches(scorer: Callable[[pd.Series], pd.DataFrame], texts: pd.Series, most: int) -> pd.DataFrame:
    """score, truncated of texts, at most so many to a call and those of like length together, in the texts' own order."""
    order = texts.str.len().to_numpy().argsort(kind="stable")
    parts = [scorer(texts.iloc[order[at : at + most]].reset_index(drop=True)).reset_index(drop=True) for at in range(0, len(order), most)]
    told = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"score": [], "truncated": []})
    told.index = order
    return told.sort_index()


def with_scorer(windows: DataFrame, model: str, factory: Callable[[], Callable[[pd.Series], pd.DataFrame]], most: int | None = None, profile: ResourceProfile | None = None) -> DataFrame:
    """windows with model, score, truncated and status; ``factory`` is called once a worker.

    A scorer takes texts and gives score and truncated; with ``most``, no more than so many at once, sorted by length so that padding
    is small. ``profile`` names the resources of the stage, as a device. Windows out of schedule are not scored; a score
    that is missing or outside [0, 1] is unavailable.
    """
    if most is not None and most < 1:
        raise ValueError("a batch holds at least one text")
    key = hashlib.sha256(cloudpickle.dumps((model, factory))).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _loaded(key, factory)
        for batch in batches:
            told = scorer(batch["text"]) if most is None else in_micro_batches(scorer, batch["text"], most)
            yield batch.assign(model=model, score=told["score"].to_numpy(dtype=float), truncated=told["truncated"].to_numpy(dtype=bool))

    scheduled = windows.where("scheduled")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in windows.schema)
    scored = scheduled.mapInPandas(run, f"{kinds}, model string, score double, truncated boolean", profile=profile)
    rest = windows.where("not scheduled").select("*", F.lit(model).alias("model"), F.lit(None).cast("double").alias("score"), F.lit(False).alias("truncated"))
    return with_status(scored.unionByName(rest))


def with_status(scored: DataFrame) -> DataFrame:
    fine = F.col("score").isNotNull() & ~F.isnan("score") & F.col("score").between(0, 1)
    status = F.when(~F.col("scheduled"), "not_scored").when(~fine, "unavailable").when(F.col("truncated"), "truncated").otherwise("ok")
    return scored.withColumn("status", status).withColumn("score", F.when(fine & F.col("scheduled"), F.col("score")))


def leaning(score: Column, words: Column, status: Column, human_max: Column, ai_min: Column) -> Column:
    """ai_leaning, human_leaning or inconclusive; only whole windows of 80 to 250 words lean."""
    fit = (status == "ok") & words.between(LEAST_WORDS, SINGLE_WORDS)
    return F.when(fit & (score >= ai_min), "ai_leaning").when(fit & (score <= human_max), "human_leaning").otherwise("inconclusive")


def reasons(words: Column, status: Column, label: Column) -> Column:
    return (
        F.when(status == "not_scored", "outside the window budget").when(status == "unavailable", "no score").when(status == "truncated", "only the beginning was scored")
        .when(words < LEAST_WORDS, "too short for a label").when(label == "inconclusive", "between the boundaries").otherwise("crosses a boundary")
    )


def labelled(scored: DataFrame, human_max: float | None, ai_min: float | None) -> DataFrame:
    label = leaning(F.col("score"), F.col("words"), F.col("status"), F.lit(human_max).cast("double"), F.lit(ai_min).cast("double"))
    out = scored.withColumn("label", label)
    return out.withColumn("reason", reasons(F.col("words"), F.col("status"), F.col("label")))


def combined(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """The windows of the primary model with second_label and disagrees; the secondary never vetoes."""
    other = secondary.select("id", "window_no", F.col("label").alias("second_label"))
    disagrees = (F.col("label") != "inconclusive") & (F.col("second_label") != "inconclusive") & (F.col("label") != F.col("second_label"))
    return primary.join(other, ["id", "window_no"], "left").withColumn("disagrees", F.coalesce(disagrees, F.lit(False)))


def model_summary(rows: DataFrame) -> DataFrame:
    """id, score, label, status, scored, total: the word-weighted mean and the label all windows share."""
    scored = F.col("score").isNotNull()
    told = rows.groupBy("id").agg(
        (F.sum(F.when(scored, F.col("score") * F.col("words"))) / F.nullif(F.sum(F.when(scored, F.col("words"))), F.lit(0))).alias("score"),
        F.bool_and(F.col("status") == "ok").alias("complete"), F.min("label").alias("lo"), F.max("label").alias("hi"),
        F.count_if(scored).alias("scored"), F.count("*").alias("total"),
    )
    label = F.when(F.col("complete") & (F.col("lo") == F.col("hi")), F.col("lo")).otherwise("inconclusive")
    status = F.when(F.col("scored") == 0, "unavailable").when(F.col("complete"), "ok").otherwise("partial")
    return told.select("id", "score", label.alias("label"), status.alias("status"), "scored", "total")


def verdict(rows: DataFrame) -> DataFrame:
    """id, label, characters, analyzed_characters, full_coverage: unanimous and conclusive over fully covered texts only."""
    told = rows.groupBy("id").agg(
        F.sum(F.length("text")).alias("characters"), F.coalesce(F.sum(F.when(F.col("status") == "ok", F.length("text"))), F.lit(0)).alias("analyzed_characters"),
        F.min("label").alias("lo"), F.max("label").alias("hi"),
    )
    full = F.col("characters") == F.col("analyzed_characters")
    label = F.when(full & (F.col("lo") == F.col("hi")) & (F.col("lo") != "inconclusive"), F.col("lo")).otherwise("inconclusive")
    return told.select("id", label.alias("label"), "characters", "analyzed_characters", full.alias("full_coverage"))


def anchored(windows: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """windows with from_utf16 and to_utf16, offsets of the window in the whole text."""
    whole = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("whole"))
    joined = windows.join(whole, "id")
    return joined.withColumn("from_utf16", utf16_offset(F.col("whole"), F.col("start"))).withColumn("to_utf16", utf16_offset(F.col("whole"), F.col("start") + F.length("text"))).drop("whole")


def score_windows(docs: DataFrame, scorers: dict[str, Callable], thresholds: dict[str, tuple[float | None, float | None]], id_col: str, text_col: str) -> DataFrame:
    """All windows of all models in one table with labels; models without thresholds never lean."""
    windows = word_windows(docs, id_col, text_col)
    out = None
    for model, factory in scorers.items():
        part = labelled(with_scorer(windows, model, factory), *thresholds.get(model, (None, None)))
        out = part if out is None else out.unionByName(part)
    return out


def following(spans: DataFrame, group: str, start: str, end: str, block: int = BLOCK) -> DataFrame:
    """g, a, b, next (a, b): of every span the first of its group after it, by start and end, that starts at or after its end.

    Starts are dealt by blocks of places: the first within the end's own block, else that of the next block that has any.
    """
    rows = spans.select(F.col(group).alias("g"), F.col(start).cast("long").alias("a"), F.col(end).cast("long").alias("b")).distinct()
    asked = rows.select("g", F.expr(f"b div {block}").alias("block"), F.col("b").alias("at"), F.lit(0).alias("kind"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(-1.0).alias("tie"), "a", "b")
    there = rows.select("g", F.expr(f"a div {block}").alias("block"), F.col("a").alias("at"), F.lit(1).alias("kind"), F.col("b").cast("double").alias("tie"), "a", "b")
    # from the last place down, so that the last start that was met is the first one from here on; a span without length comes just before its own
    down = Window.partitionBy("g", "block").orderBy(F.desc("at"), F.desc("tie"))
    met = F.last(F.when(F.col("kind") == 1, F.struct("a", "b")), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    near = asked.unionByName(there).withColumn("near", met).where("kind = 0")
    firsts = there.groupBy("g", "block").agg(F.min(F.struct("a", "b")).alias("first"))
    # the blocks of ends and of starts, few to a group; an end's block may have no start
    blocks = asked.select("g", "block").distinct().join(firsts, ["g", "block"], "full_outer")
    later = F.min("first").over(Window.partitionBy("g").orderBy("block").rowsBetween(1, Window.unboundedFollowing))
    blocks = blocks.select("g", "block", later.alias("later"))
    return near.join(blocks, ["g", "block"], "left").select("g", "a", "b", F.coalesce("near", "later").alias("next"))


def display_segments(matches: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """The non-overlapping matches that a display shows: from the left, each that starts at or after the last shown end.

    Every match points to the one that would follow it. Those on the chain from the first are found by doubling: from the
    chain's first 2**k matches, jumps of 2**k reach as many again. So a group of any size spreads over the tasks. Equal matches are one; nulls are left out.
    """
    kind = {f.name: f.dataType.simpleString() for f in matches.schema}
    with Scratch(matches.sparkSession) as put:
        spans = matches.where(F.col(group).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull())
        jump = put(following(spans, group, start, end).select("g", "a", "b", F.col("next.a").alias("x"), F.col("next.b").alias("y")), "segments-next")
        shown = put(jump.groupBy("g").agg(F.min(F.struct("a", "b")).alias("m")).select("g", "m.a", "m.b"), "segments-shown")
        while True:
            more = put(shown.join(jump, ["g", "a", "b"]).where("x is not null").select("g", F.col("x").alias("a"), F.col("y").alias("b")), "segments-more")
            if more.isEmpty():
                break
            shown = put(shown.unionByName(more), "segments-shown")
            far = jump.select("g", F.col("a").alias("x"), F.col("b").alias("y"), F.col("x").alias("x2"), F.col("y").alias("y2"))
            jump = put(jump.join(far, ["g", "x", "y"]).where("x2 is not null").select("g", "a", "b", F.col("x2").alias("x"), F.col("y2").alias("y")), "segments-next")
        put.keep(shown)
        return shown.select(F.col("g").alias(group), F.col("a").cast(kind[start]).alias(start), F.col("b").cast(kind[end]).alias(end))


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, score_before, score_after, change, comparable, signal: two runs side by side.

    Runs are comparable where both have a score and agree on all of score_kind, model_revision and decision_policy that they
    have as columns (two nulls agree). The signal is Same signal, Signal changed, or Not comparable.
    """
    versions = [c for c in ("score_kind", "model_revision", "decision_policy") if c in before.columns and c in after.columns]

    def run(df: DataFrame, name: str) -> DataFrame:
        return df.select("id", *(F.col(c).alias(f"{c}_{name}") for c in ["score", "label", *versions]))

    both = run(before, "before").join(run(after, "after"), "id", "full_outer")
    comparable = F.col("score_before").isNotNull() & F.col("score_after").isNotNull()
    for c in versions:
        comparable &= F.col(f"{c}_before").eqNullSafe(F.col(f"{c}_after"))
    signal = F.when(~F.col("comparable"), "Not comparable").when(F.col("label_before").eqNullSafe(F.col("label_after")), "Same signal").otherwise("Signal changed")
    return both.withColumn("change", F.col("score_after") - F.col("score_before")).withColumn("comparable", comparable).withColumn("signal", signal)


def rollup(scored: DataFrame) -> DataFrame:
    """One row: truncated windows, scheduled words, the statuses, and of device and milliseconds, if there are such columns, the devices and the time."""
    more = []
    if "device" in scored.columns:
        more.append(F.array_join(F.array_sort(F.collect_set("device")), ",").alias("devices"))
    if "milliseconds" in scored.columns:
        more.append(F.sum("milliseconds").alias("milliseconds"))
    return scored.agg(
        F.count_if("truncated").alias("truncated"), F.sum(F.when(F.col("scheduled"), F.col("words"))).alias("words"),
        F.array_join(F.array_sort(F.collect_set("status")), ",").alias("statuses"), *more,
    )
