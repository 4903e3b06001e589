"""Audit of how filters interact, by a subset-zeta transform.

Each document has a mask with a bit for every filter that it fails. What a set of filters leaves of a part is the
number of masks disjoint from the set, so it is a sum over the subsets of the complement. One pass counts the masks
of each part (at most 2**n rows a part leave the scan's tasks); the zeta transform turns the counts into sums over the subsets of every mask in n
rounds, one a filter, on an array of 2**n numbers. Any order of the filters is then a chain of sets, and each of its
steps a difference of two neighbours, for all documents and likewise for those with a label. No document is looked at twice.

Defined results: a null text is empty; a null part counts as the empty string; a row without an id, or an id without a label, has
no label; repeated rows count as often as they stand (copies by identity of text need a smaller id, so rows of one id are no copies of
each other, and rows without an id are no copies and make none); labels of one id are joined by their largest; a very long text is split whole;
an empty table gives an empty result; other columns are left aside.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words.
SPACE = r"[\x20\x09-\x0D]+"


def word_counts(text: Column) -> Column:
    """(n, kinds): the words of a text that is not null, and its distinct words."""
    # a text that starts or ends with white space has an empty string there
    words = F.array_remove(F.split(text, SPACE), "")
    return F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("kinds")))[0]


def quality_rules(text: Column, told: Column) -> dict[str, Column]:
    """The failure conditions A to D of a text that is not null and its ``word_counts``."""
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": told["n"] < 200, "B": 100 * told["kinds"] < 50 * told["n"], "C": 100 * capitals > 3 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def masked(docs: DataFrame, rules: dict[str, Column], text_sha: Column, id_col: str, part_col: str) -> DataFrame:
    """id, sha, part, mask, n: light rows, equal ones together; bit k of a mask is set where rule k fails."""
    mask = F.lit(0)
    for k, rule in enumerate(rules.values()):
        mask = mask + F.when(F.coalesce(rule, F.lit(False)), 1 << k).otherwise(0)
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_sha.alias("sha"), part.alias("part"), mask.alias("mask"))
    return rows.groupBy("id", "sha", "part", "mask").agg(F.count("*").alias("n"))


def zeta(counts: Column, n: int) -> Column:
    """Sums over subsets: element m of the result adds up the elements of ``counts`` at all subsets of m."""
    def round_of(bit: int) -> Column:
        with_bit = lambda a: F.transform(a, lambda x, m: F.when(m.bitwiseAND(F.lit(bit)) != 0, x + F.get(a, m - bit)).otherwise(x))
        # as the one element of an array, so that a round is computed once though it is looked at twice
        return F.aggregate(F.array(counts), F.array().cast("array<bigint>"), lambda _, a: with_bit(a))

    for k in range(n):
        counts = round_of(1 << k)
    return counts


def audit(masks: DataFrame, filters: list[str], labels: list[str]) -> DataFrame:
    """A row for each part, order of the filters and step; from (part, mask, n, and a count for each label).

    part, filter_order, step, kept (after the step), removed (here), redundant (failing its filter, removed earlier),
    unique_fails (failing its filter only), <label>_lost (removed here) and shapley (its filter's removed, over all orders).
    """
    n, every = len(filters), (1 << len(filters)) - 1
    measures = ["n", *labels]
    by_mask = masks.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in measures))
    places = F.sequence(F.lit(0), F.lit(every))
    held = by_mask.groupBy("part").agg(*(F.map_from_entries(F.collect_list(F.struct("mask", c))).alias(c) for c in measures))
    dense = lambda c: F.transform(places, lambda m: F.coalesce(F.try_element_at(F.col(c), m), F.lit(0)).cast("long"))
    arrays = held.select("part", *(dense(c).alias(c) for c in measures))
    below = arrays.select("part", F.col("n").alias("exact"), *(zeta(F.col(c), n).alias(c) for c in measures))

    steps = []
    for order in permutations(range(n)):
        before = 0
        for step, k in enumerate(order):
            steps.append(("".join(filters[i] for i in order), step + 1, k, before))
            before |= 1 << k
    chain = F.expr("inline(array(" + ", ".join(f"struct('{o}' AS filter_order, {s} AS step, {1 << k} AS bit, {b} AS before)" for o, s, k, b in steps) + "))")
    left = lambda c, gone: F.get(F.col(c), F.lit(every) - gone)  # noqa: E731  survivors of a set of filters
    rows = below.select("part", "exact", *measures, chain)
    bit, before = F.col("bit"), F.col("before")
    after = before + bit
    removed = left("n", before) - left("n", after)
    failing = left("n", F.lit(0)) - left("n", bit)
    # over all orders, the sets before a filter come |set|! (n - 1 - |set|)! times each
    weight = {k: sum(1 for o in permutations(range(n)) if set(o[: o.index(0)]) == set(range(1, k + 1))) for k in range(n)}
    terms = F.transform(
        F.filter(places, lambda s: s.bitwiseAND(bit) == 0),
        lambda s: (F.get(F.col("n"), F.lit(every) - s) - F.get(F.col("n"), F.lit(every) - s - bit)) * F.element_at(F.array(*(F.lit(weight[k]) for k in range(n))), F.bit_count(s) + 1),
    )
    shapley = F.aggregate(terms, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        "part", "filter_order", "step", left("n", after).alias("kept"), removed.alias("removed"), (failing - removed).alias("redundant"),
        F.get(F.col("exact"), bit).alias("unique_fails"), *((left(c, before) - left(c, after)).alias(f"{c}_lost") for c in labels), shapley.alias("shapley"),
    )


def audit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``audit`` of the filters A to E, E being a text that a smaller id has too, with labels good (quality = 1) and toxic (toxic = 1).

    Texts leave the scan as a hash and a mask. The first id of a text is joined by both text and id, so that copies, however
    many, spread over the tasks.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(part_col).alias("_part"))
    docs = docs.withColumn("_told", word_counts(text))
    rules = quality_rules(text, F.col("_told"))
    light = masked(docs, rules, F.unhex(F.sha2(text, 256)), "_id", "_part")
    first = light.where("id is not null").groupBy("sha").agg(F.min("id").alias("id")).withColumn("is_first", F.lit(True))
    light = light.join(first, ["sha", "id"], "left")
    copy = F.col("id").isNotNull() & F.col("is_first").isNull()
    told = labels.select(F.col(id_col).cast("long").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("id is not null")
    told = told.groupBy("id").agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("good", "toxic")))
    rows = light.join(told, "id", "left")
    mask = F.col("mask") + F.when(copy, 1 << len(rules)).otherwise(0)
    counted = rows.select("part", mask.alias("mask"), "n", *(F.when(F.col(c), F.col("n")).otherwise(F.lit(0).cast("long")).alias(c) for c in ("good", "toxic")))
    return audit(counted, [*rules, "E"], ["good", "toxic"])
