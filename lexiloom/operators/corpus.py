"""Corpus preparation: duplicates, near-duplicate audit, linked families, excerpts and splits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from lexiloom.checks import require_empty
from lexiloom.functions.text import NOT_SPACE, SPACE, draw, normalized, text_hash, word_count
from lexiloom.operators.linking import connected_components, joined_by_key
from lexiloom.storage import Scratch, materialize

# Words of near-duplicate grams, size of the sketch, least similarity, budget of pairs, excerpt bounds, split shares and seed.
GRAM, SKETCH, NEAR, PAIR_BUDGET = 5, 16, 0.8, 200_000
LEAST_WORDS, MOST_WORDS, SHORT_WORDS = 80, 250, 150
TRAIN_BELOW, CALIBRATION_BELOW = 0.6, 0.8
SEED = "split-v1"
#: Records beyond which a gram of their sketches is not paired out.
HOT_GRAM = 100
#: Bits of a set's marks, and sets whose marks are made at once.
MARK_BITS, MARK_ROWS = 2_048, 256


def _keyed(records: DataFrame, id_col: str, label_col: str, text_col: str) -> DataFrame:
    return records.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), text_hash(F.coalesce(F.col(text_col), F.lit(""))).alias("normalized_sha256"))


def _groups(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("normalized_sha256").agg(
        F.min("id").alias("kept"), F.count("*").alias("n"), F.min("label").alias("least_label"), F.max("label").alias("most_label")
    ).withColumn("conflict", ~F.col("least_label").eqNullSafe(F.col("most_label")))


def exact_groups(records: DataFrame, id_col: str, label_col: str, text_col: str) -> DataFrame:
    """normalized_sha256, kept, n, n_labels: the groups of records with equal normalised text.

    Groups of one label keep their first record by id; groups of several labels are conflicts.
    Aggregates have a fixed size, so a group of any size stays cheap.
    """
    return _groups(_keyed(records, id_col, label_col, text_col))


def exact_dedup(records: DataFrame, id_col: str, label_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(admitted records, removed: id and kept id, conflicts: id and hash), one row each.

    Hashes are written once, as groups and their members are both made of them.
    """
    keyed = materialize(_keyed(records, id_col, label_col, text_col), "exact-hashes")
    groups = _groups(keyed).select("normalized_sha256", "kept", "n", "conflict")
    whole = records.withColumn("normalized_sha256", text_hash(F.coalesce(F.col(text_col), F.lit(""))))
    admitted = whole.join(groups.drop("n"), "normalized_sha256").where(~F.col("conflict") & (F.col(id_col) == F.col("kept"))).drop("kept", "conflict")
    joined = keyed.join(groups.where("n > 1"), "normalized_sha256")
    removed = joined.where(~F.col("conflict") & (F.col("id") != F.col("kept"))).select(F.col("id").alias("removed"), "kept")
    conflicts = joined.where("conflict").select("id", "normalized_sha256")
    return admitted, removed, conflicts


def gram_sets(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, grams array<long>: the first 64 bits of the SHA-256 of each distinct five-word gram of the normalised text, sorted as their hex digits are."""
    tokens = F.regexp_extract_all(normalized(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    last = F.size("tokens") - GRAM
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    joined = lambda i: F.concat(*(part for k in range(GRAM) for part in ([F.lit(" ")] * bool(k) + [F.get("tokens", i + k)])))
    hashed = F.transform(places, lambda i: F.conv(F.substring(F.sha2(joined(i), 256), 1, 16), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63))))
    return records.select(F.col(id_col).alias("id"), tokens.alias("tokens")).select("id", F.sort_array(F.array_distinct(hashed)).alias("grams"))


def sketches(sets: DataFrame) -> DataFrame:
    """id, n, gram: the sixteen smallest grams of each set."""
    return sets.select("id", F.size("grams").alias("n"), F.explode(F.slice("grams", 1, SKETCH)).alias("gram"))


def _pairs(rows: DataFrame) -> DataFrame:
    """left, right of the ids of like size that share a gram, for (id, n, gram)."""
    other = rows.select(F.col("id").alias("right"), F.col("n").alias("m"), "gram")
    near = (F.col("left") < F.col("right")) & (F.least("n", "m") / F.greatest("n", "m") >= NEAR)
    return rows.withColumnRenamed("id", "left").join(other, "gram").where(near).select("left", "right").distinct()


def near_candidates(sets: DataFrame, ids: DataFrame, put: Scratch) -> DataFrame:
    """left, right: pairs of the records ``ids`` of like size, among them all similar ones that share one of their 16 smallest grams.

    Equal gram sets enter once, with their smallest id, and are linked to the others of their kind by
    ``near_duplicates``, so copies are never paired with one another. A gram that many sketches share is not paired
    out: similar sets also share a gram among the rarest fifth of their own, so records with such a gram are paired by those.
    """
    sketch = put(sketches(sets).join(ids, "id", "left_semi"), "near-sketches")
    counts = put(sketch.groupBy("gram").count().where("count > 1"), "near-counts")
    cold = _pairs(sketch.join(counts.where(F.col("count") <= HOT_GRAM).select("gram"), "gram", "left_semi"))
    hot = put(sketch.join(counts.where(F.col("count") > HOT_GRAM).select("gram"), "gram", "left_semi").select("id").distinct(), "near-hot")
    if hot.isEmpty():
        return cold
    grams = put(sets.join(hot, "id", "left_semi").select("id", F.size("grams").alias("n"), F.explode("grams").alias("gram")), "near-grams")
    often = put(grams.groupBy("gram").agg(F.count("*").alias("often")).where("often > 1"), "near-often")
    # a gram of one record alone pairs nothing, but it takes a place among the rarest
    ranked = joined_by_key(grams, often, "gram", put, "left").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(1)).alias("often"), "gram"))).alias("ranked"))
    most = F.col("n") - F.ceil(F.col("n") * F.lit(NEAR) - 1e-9).cast("int") + 1
    rarest = ranked.select("id", "n", F.explode(F.slice("ranked", F.lit(1), most)).alias("x")).where("x.often > 1").select("id", "n", F.col("x.gram").alias("gram"))
    return cold.unionByName(_pairs(put(rarest, "near-rarest"))).distinct()


@F.arrow_udf(ArrayType(LongType()))
def marks(sets: pa.Array) -> pa.Array:
    """MARK_BITS bits of each set of longs: whether an odd number of its elements has the bit's number as its last bits."""
    ends, words = sets.offsets.to_numpy(), MARK_BITS // 64
    flat, out = sets.values.to_numpy(), [np.zeros(0, np.int64)]
    for lo in range(0, len(sets), MARK_ROWS):
        hi = min(lo + MARK_ROWS, len(sets))
        row = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))
        counts = np.bincount(row * MARK_BITS + (flat[ends[lo] : ends[hi]] & (MARK_BITS - 1)), minlength=(hi - lo) * MARK_BITS)
        out.append(np.packbits((counts & 1).astype(np.uint8)).view(np.int64))
    flat = np.concatenate(out)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * words, pa.int32()), pa.array(flat))


def possible_pairs(sets: DataFrame, pairs: DataFrame, put: Scratch) -> DataFrame:
    """left, right: the pairs that may be similar by the marks of their sets, so that whole sets travel only for these.

    Sets of a and b elements with a similarity of 0.8 differ in a ninth of a + b elements at most, and their marks in no more bits than
    that. Most other pairs differ in more, unless their sets have several times as many elements as there are bits.
    """
    met = pairs.select(F.explode(F.array("left", "right")).alias("id")).distinct()
    told = put(sets.join(met, "id", "left_semi").select("id", F.size("grams").alias("n"), marks("grams").alias("marks")), "near-marks")
    a, b = (told.select(F.col("id").alias(side), F.col("n").alias(f"{side}_n"), F.col("marks").alias(f"{side}_marks")) for side in ("left", "right"))
    differ = F.zip_with("left_marks", "right_marks", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(differ, F.lit(0), lambda total, x: total + x)
    return put(pairs.join(a, "left").join(b, "right").where(9 * differ <= F.col("left_n") + F.col("right_n")).select("left", "right"), "near-possible")


def near_duplicates(records: DataFrame, id_col: str, label_col: str, text_col: str) -> DataFrame:
    """left, right, jaccard, label_conflict: an audit, which never drops records.

    Records with equal gram sets appear as pairs with the smallest id of their set (jaccard 1);
    between different sets, the smallest ids stand for all. ``near_status`` tells whether a budget of pairs holds.
    """
    with Scratch(records.sparkSession) as put:
        sets, first = _with_first(records, id_col, text_col, put)
        equal = first.where("id <> first").select(F.col("first").alias("left"), F.col("id").alias("right"), F.lit(1.0).alias("jaccard"))
        pairs = put(near_candidates(sets, first.where("id = first").select("id"), put), "near-pairs")
        pairs = possible_pairs(sets, pairs, put)
        # only sets that are in some pair travel
        both = pairs
        for side, name in (("left", "a"), ("right", "b")):
            own = sets.join(pairs.select(F.col(side).alias("id")).distinct(), "id", "left_semi")
            both = both.join(own.select(F.col("id").alias(side), F.col("grams").alias(name)), side)
        both = both.withColumn("shared", F.size(F.array_intersect("a", "b")))
        sketch = lambda c: F.slice(c, 1, SKETCH)
        near = both.withColumn("jaccard", F.col("shared") / (F.size("a") + F.size("b") - F.col("shared"))).where(F.col("jaccard") >= NEAR)
        near = near.where(F.arrays_overlap(sketch("a"), sketch("b"))).select("left", "right", "jaccard")
        every = put(near.unionByName(equal), "near-found")
        labels = records.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
        left, right = (labels.select(F.col("id").alias(c), F.col("label").alias(c + "_label")) for c in ("left", "right"))
        told = every.join(left, "left").join(right, "right")
        put.keep(every)
        return told.select("left", "right", "jaccard", (~F.col("left_label").eqNullSafe(F.col("right_label"))).alias("label_conflict"))


def _with_first(records: DataFrame, id_col: str, text_col: str, put: Scratch) -> tuple[DataFrame, DataFrame]:
    """(id, grams of the sets that are not empty; id, first: the smallest id of an equal set, by 128 bits of hashes)."""
    # written once: several plans read the sets, and a filter pushed below them would tokenise again for every gram
    sets = put(gram_sets(records, id_col, text_col), "near-sets")
    keyed = sets.where(F.size("grams") > 0).select("id", F.xxhash64("grams").alias("ka"), F.xxhash64(F.lit(GRAM), "grams").alias("kb"), F.size("grams").alias("n"))
    least = keyed.groupBy("ka", "kb", "n").agg(F.min("id").alias("first"))
    return sets, put(keyed.join(least, ["ka", "kb", "n"]).select("id", "first"), "near-first")


def near_status(records: DataFrame, id_col: str, text_col: str, budget: int = PAIR_BUDGET) -> DataFrame:
    """One row: budget, candidates (pairs of different sets that share one of their 16 smallest grams), status complete or exceeded.

    Pairs are counted by gram before any is made: each pair has at most 16 grams, so over 16 budgets by gram, or a gram with
    over one, is too many for sure, and candidates is null. Else no more than 16 budgets of them are made to count the different ones.
    """
    with Scratch(records.sparkSession) as put:
        sets, first = _with_first(records, id_col, text_col, put)
        sketch = put(sketches(sets).join(first.where("id = first").select("id"), "id", "left_semi"), "near-sketches")
        pairs = F.col("count") * (F.col("count") - 1) / 2
        told = sketch.groupBy("gram").count().agg(F.coalesce(F.sum(pairs), F.lit(0)).alias("all"), F.coalesce(F.max(pairs), F.lit(0)).alias("one")).first()
        if told["one"] > budget or told["all"] > SKETCH * budget:
            found = None
        else:
            many = sketch.groupBy("gram").count().where("count > 1").select("gram")
            few = sketch.join(many, "gram", "left_semi").select("id", "gram")
            found = few.join(few.withColumnRenamed("id", "other"), "gram").where("id < other").select("id", "other").distinct().count()
            found = None if found > budget else found
    row = (budget, found, "exceeded" if found is None else "complete")
    return records.sparkSession.createDataFrame([row], "budget long, candidates long, status string")


def linked_families(records: DataFrame, keys: dict[str, Column], id_col: str, relations: DataFrame | None = None) -> DataFrame:
    """id, family: records joined by any equal key, through chains, also over the absent groups of ``relations``.

    ``keys`` are named columns; null never links. The family's name is its smallest node, where nodes are
    'record:id' and 'key:value'. ``relations`` has an array column source_groups whose members belong together.
    """
    node = F.concat(F.lit("record:"), F.col(id_col).cast("string"))
    edges = None
    for name, value in keys.items():
        part = records.select(node.alias("src"), F.concat(F.lit(name + ":"), value.cast("string")).alias("dst")).where("dst is not null")
        edges = part if edges is None else edges.unionByName(part)
    own = records.select(node.alias("src"), node.alias("dst"))
    edges = own if edges is None else edges.unionByName(own)
    if relations is not None:
        group = F.concat(F.lit("source_group:"), F.col("g"))
        first = F.concat(F.lit("source_group:"), F.col("source_groups")[0])
        edges = edges.unionByName(relations.select("source_groups", F.explode("source_groups").alias("g")).select(first.alias("src"), group.alias("dst")))
    components = connected_components(edges)
    return components.where(F.col("node").startswith("record:")).select(F.expr("substring(node, 8)").alias("id"), F.col("component").alias("family"))


def record_families(records: DataFrame, keys: dict[str, Column], id_col: str) -> DataFrame:
    """id, family: records joined by any equal key, through chains; null never links. A family's name is its smallest id.

    Each key is folded to edges from its records to the smallest of them, so nodes are ids, and a key that a third of all records
    have spreads over the tasks.
    """
    with Scratch(records.sparkSession) as put:
        rows = records.select(F.col(id_col).cast("long").alias("id"), *(value.cast("string").alias(f"key_{name}") for name, value in keys.items()))
        rows = put(rows.where("id is not null"), "family-keys")
        edges = rows.select(F.col("id").alias("src"), F.col("id").alias("dst"))
        for name in keys:
            part = rows.select("id", F.sha2(f"key_{name}", 256).alias("key")).where("key is not null")
            first = put(part.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "family-first")
            edges = edges.unionByName(joined_by_key(part, first, "key", put).select(F.col("id").alias("src"), F.col("first").alias("dst")))
        found = connected_components(edges, owner=put)
        return put.keep(put(found.withColumnsRenamed({"node": "id", "component": "family"}), "families"))


def excerpt(text: Column) -> Column:
    """struct<excerpt, kind>: the first paragraph of 80 to 250 words, else the whole text, else its first 250 words; null if short."""
    paragraphs = F.filter(F.split(text, rf"\n{SPACE}*\n"), lambda p: word_count(p).between(LEAST_WORDS, MOST_WORDS))
    edge = rf"^{SPACE}+|{SPACE}+$"
    trimmed = lambda x: F.regexp_replace(x, edge, "")
    clip = F.regexp_extract(text, rf"^{SPACE}*(?:{NOT_SPACE}+{SPACE}+){{{MOST_WORDS - 1}}}{NOT_SPACE}+", 0)
    kind = lambda value, name: F.struct(trimmed(value).alias("excerpt"), F.lit(name).alias("kind"))
    # paragraphs and words are taken once each, so they are names inside functions of arrays
    natural = F.get(F.transform(F.slice(paragraphs, 1, 1), lambda p: kind(p, "natural_paragraph")), F.lit(0))
    other = lambda count: F.when(count < LEAST_WORDS, F.lit(None)).when(count <= MOST_WORDS, kind(text, "whole_short_document")).otherwise(kind(clip, "first_250_words"))
    return F.coalesce(natural, F.get(F.transform(F.array(word_count(text)), other), F.lit(0)))


def excerpts(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, excerpt, kind, words, length_bucket, excerpt_sha256 of the records that have an excerpt."""
    # a filter on the excerpt itself would be pushed below it and cut it once more; behind a generator it is cut once
    cut = records.select(F.col(id_col).alias("id"), F.explode_outer(F.array(excerpt(F.coalesce(F.col(text_col), F.lit(""))))).alias("e")).where("e is not null")
    found = cut.select("id", "e.excerpt", "e.kind").withColumn("words", word_count(F.col("excerpt")))
    bucket = F.when(F.col("words") < SHORT_WORDS, "80-149").otherwise("150-250")
    return found.withColumn("length_bucket", bucket).withColumn("excerpt_sha256", text_hash(F.col("excerpt")))


def excerpt_dedup(cut: DataFrame, labels: DataFrame) -> DataFrame:
    """id, excerpt_sha256, outcome: kept, duplicate_excerpt, or conflicting_excerpt (contradictory labels)."""
    joined = cut.join(labels, "id").select("id", "excerpt_sha256", "label")
    groups = joined.groupBy("excerpt_sha256").agg(F.min("id").alias("first"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    outcome = F.when(F.col("lo") != F.col("hi"), "conflicting_excerpt").when(F.col("id") != F.col("first"), "duplicate_excerpt").otherwise("kept")
    return joined.join(groups, "excerpt_sha256").select("id", "excerpt_sha256", outcome.alias("outcome"))


def split_name(unit: Column, seed: str = SEED) -> Column:
    u = draw(seed, unit)
    return F.when(u < TRAIN_BELOW, "train").when(u < CALIBRATION_BELOW, "calibration").otherwise("test")


def assign_splits(families: DataFrame, seed: str = SEED, external: bool = False) -> DataFrame:
    """id, split_unit, split: whole families by a stable hash of their name."""
    unit = F.sha2(F.col("family").cast("string"), 256)
    return families.select("id", unit.alias("split_unit"), (F.lit("external") if external else split_name(unit, seed)).alias("split"))


def leaks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """field, value, n_splits: key values that occur in more than one split. Must be empty."""
    pairs = ", ".join(f"'{k}', cast({k} as string)" for k in keys)
    long = rows.select("split", F.expr(f"stack({len(keys)}, {pairs}) as (field, value)")).where("value is not null")
    return long.groupBy("field", "value").agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def related_groups(removed: DataFrame, near: DataFrame, groups: DataFrame) -> DataFrame:
    """reason, record_ids, source_groups: relations from exact (removed, kept) and near (left, right) pairs; ``groups`` has id, source_group."""
    pairs = removed.select(F.lit("exact_normalized_text").alias("reason"), F.col("kept").alias("a"), F.col("removed").alias("b")).unionByName(
        near.select(F.lit("near_duplicate_text").alias("reason"), F.col("left").alias("a"), F.col("right").alias("b"))
    )
    a, b = (groups.select(F.col("id").alias(c), F.col("source_group").alias("g" + c)) for c in ("a", "b"))
    joined = pairs.join(a, "a").join(b, "b")
    return joined.select("reason", F.array("a", "b").alias("record_ids"), F.array_sort(F.array_distinct(F.array("ga", "gb"))).alias("source_groups"))


def missing(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).join(present.select(key), key, "left_anti").distinct()


def attach_scores(rows: DataFrame, predictions: DataFrame, key: str = "id", hash_col: str = "text_sha256") -> DataFrame:
    """rows with the column score; fails if ids are missing on either side or repeated, or hashes differ."""
    require_empty(predictions.groupBy(key).count().where("count > 1"), "repeated predictions")
    require_empty(missing(rows, predictions, key).unionByName(missing(predictions, rows, key)), "ids of one side only")
    scored = rows.join(predictions.select(key, F.col(hash_col).alias("_hash"), "score"), key)
    require_empty(scored.where(~F.col("_hash").eqNullSafe(F.col(hash_col))), "stale predictions")
    return scored.drop("_hash")


def first_per(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def two_level_counts(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """outer, inner, n of the pairs that occur."""
    return rows.groupBy(outer, inner).agg(F.count("*").alias("n"))


def generator_counts(rows: DataFrame, generator: str = "generator", default: str = "unknown") -> DataFrame:
    """generator, n; rows without one count under ``default``."""
    return rows.groupBy(F.coalesce(F.col(generator), F.lit(default)).alias(generator)).agg(F.count("*").alias("n"))


def digest(rows: DataFrame, key: str, line: Column, fan: int = 1_000, levels: int = 3) -> DataFrame:
    """One row, sha256: a digest of all rows in the order of an integer key, whatever order they come in.

    A tree: lines are joined by blocks of ``fan`` keys and hashed, then their digests by blocks of ``fan`` blocks, and so on
    for ``levels`` levels, and the rest at last; so no group is larger than ``fan`` to a distinct key.
    """
    told = rows.select(F.col(key).cast("long").alias("at"), line.alias("line"))
    for _ in range(levels):
        block = F.floor(F.col("at") / fan).cast("long")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), ",")
        told = told.groupBy(block.alias("b")).agg(F.sha2(joined, 256).alias("line")).withColumnRenamed("b", "at")
    last = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), ",")
    return told.agg(F.sha2(last, 256).alias("sha256"))
