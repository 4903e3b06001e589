"""Evaluation of binary classifiers that may abstain.

``rows`` have id, label (0 or 1), score, source_group, text_sha256 and may have dimension columns. Units are
families of rows that share a source group or a text hash. Everything is conditional aggregation, windows over
distinct scores, and joins; only thresholds (two numbers) come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.checks import require
from lexiloom.operators.corpus import record_families

# The confidence of one-sided bounds, error caps, and the release limits.
CONFIDENCE = 0.95
CAP = 0.01
#: Ranges of scores for running sums.
SCORE_BUCKETS = 4_096
LEAST_HUMAN_GROUPS, LEAST_AI_GROUPS, LEAST_RECALL, LEAST_COVERAGE, MOST_FPR = 300, 100, 0.8, 0.6, 0.01


@dataclass(frozen=True)
class Thresholds:
    """Scores up to human_max are human, from ai_min ai, between them uncertain; None disables a side."""

    human_max: float | None
    ai_min: float | None

    def __post_init__(self):
        for value in (self.human_max, self.ai_min):
            if value is not None and not 0 <= value <= 1:
                raise ValueError("thresholds lie between 0 and 1")
        if self.human_max is not None and self.ai_min is not None and self.human_max >= self.ai_min:
            raise ValueError("human_max must be below ai_min")

    def decide(self, score: Column) -> Column:
        return decision(score, F.lit(self.human_max).cast("double"), F.lit(self.ai_min).cast("double"))


def decision(score: Column, human_max: Column, ai_min: Column) -> Column:
    return F.when(score >= ai_min, "ai").when(score <= human_max, "human").otherwise("uncertain")


def validate(rows: DataFrame) -> DataFrame:
    """``rows``, or an error: ids unique, labels 0 or 1, scores in [0, 1], hashes of 64 hex digits, one label a text."""
    require(rows, {
        "id": F.col("id").isNull(),
        "label": F.col("label").isNull() | ~F.col("label").isin(0, 1),
        "score": F.col("score").isNull() | F.isnan("score") | ~F.col("score").between(0, 1),
        "text_sha256": F.col("text_sha256").isNotNull() & ~F.col("text_sha256").rlike("^[0-9a-fA-F]{64}$"),
    })
    require(rows.groupBy("id").count(), {"repeated id": F.col("count") > 1})
    require(rows.where("text_sha256 is not null").groupBy(F.lower("text_sha256")).agg(F.countDistinct("label").alias("n")), {"conflicting labels": F.col("n") > 1})
    return rows


def units(rows: DataFrame, dims: list[str] | None = None) -> DataFrame:
    """rows with ``unit``: families by source group or text hash, within the values of ``dims`` if given."""
    inside = F.concat_ws("\x1f", *(F.coalesce(F.col(d).cast("string"), F.lit("\x00")) for d in dims or []))
    keys = {"group": F.concat(inside, F.lit("|"), F.col("source_group").cast("string")), "text": F.concat(inside, F.lit("|"), F.lower("text_sha256"))}
    return rows.join(record_families(rows, keys, "id").withColumnRenamed("family", "unit"), "id")


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def confusion(decided: DataFrame, dims: list[str] | None = None) -> DataFrame:
    """records, human, ai, tp, fp, tn, fn, abstain_human, abstain_ai for each value of ``dims``."""
    human, ai = F.col("label") == 0, F.col("label") == 1
    d = F.col("decision")
    return decided.groupBy(*(dims or [])).agg(
        F.count("*").alias("records"), F.count_if(human).alias("human"), F.count_if(ai).alias("ai"),
        F.count_if(ai & (d == "ai")).alias("tp"), F.count_if(human & (d == "ai")).alias("fp"),
        F.count_if(human & (d == "human")).alias("tn"), F.count_if(ai & (d == "human")).alias("fn"),
        F.count_if(human & (d == "uncertain")).alias("abstain_human"), F.count_if(ai & (d == "uncertain")).alias("abstain_ai"),
    )


def rates(counts: DataFrame) -> DataFrame:
    """The ratios of a confusion table; null where the denominator is zero."""
    c = F.col
    return counts.withColumns({
        "human_fpr": ratio(c("fp"), c("human")), "answered_human_fpr": ratio(c("fp"), c("fp") + c("tn")), "false_human_rate": ratio(c("fn"), c("ai")),
        "ai_recall": ratio(c("tp"), c("ai")), "human_recall": ratio(c("tn"), c("human")), "ai_precision": ratio(c("tp"), c("tp") + c("fp")),
        "human_precision": ratio(c("tn"), c("tn") + c("fn")), "coverage": ratio(c("tp") + c("fp") + c("tn") + c("fn"), c("records")),
        "human_coverage": ratio(c("fp") + c("tn"), c("human")), "ai_coverage": ratio(c("tp") + c("fn"), c("ai")),
    })


def brier(rows: DataFrame, dims: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(dims or [])).agg(F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("brier"))


def running_sums(per: DataFrame, columns: list[str], dims: list[str] | None = None, descending: bool = False, own: bool = True) -> DataFrame:
    """``per`` (a row for each score and dims) with the columns summed up over all lower scores, and its own if ``own``.

    Scores are cut into SCORE_BUCKETS ranges: their totals are summed up over the few ranges, and rows only within
    a range, so no task holds all distinct scores.
    """
    dims = dims or []
    cut = per.withColumn("_b", F.floor(F.col("score") * SCORE_BUCKETS))
    by = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    totals = cut.groupBy(*dims, "_b").agg(*(F.sum(c).alias("_t_" + c) for c in columns))
    over = Window.partitionBy(*dims).orderBy(by("_b")).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*(F.col(d).alias("_d_" + d) for d in dims), F.col("_b").alias("_k"), *(F.coalesce(F.sum("_t_" + c).over(over), F.lit(0)).alias("_t_" + c) for c in columns))
    on = F.col("_b") == F.col("_k")
    for d in dims:
        on = on & F.col(d).eqNullSafe(F.col("_d_" + d))
    inside = Window.partitionBy(*dims, "_b").orderBy(by("score")).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    joined = cut.join(before, on)
    return joined.select(*dims, "score", *((F.col("_t_" + c) + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias("run_" + c) for c in columns), *(c for c in per.columns if c not in (*dims, "score")))


def auroc(rows: DataFrame, dims: list[str] | None = None) -> DataFrame:
    """Mann-Whitney probability with half credit for ties; null where a class is missing.

    The counts per distinct score are ranged over by a running sum, so no pairs are formed.
    """
    dims = dims or []
    per = rows.groupBy(*dims, "score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    below = F.col("run_n")
    won = running_sums(per, ["n"], dims, own=False).withColumn("won", F.col("p") * below + 0.5 * F.col("p") * F.col("n"))
    return won.groupBy(*dims).agg(ratio(F.sum("won"), F.sum("p") * F.sum("n")).alias("auroc"))


def wilson(successes: Column, total: Column, confidence: float = CONFIDENCE) -> tuple[Column, Column]:
    """Lower and upper bounds, each one-sided at the confidence, which is between a half and one; null without trials."""
    if not 0.5 < confidence < 1:
        raise ValueError("one-sided confidence must be between 0.5 and 1")
    z = NormalDist().inv_cdf(confidence)
    n = F.when(total > 0, total.cast("double"))
    p = successes / n
    scale = 1 + z * z / n
    center = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    # greatest and least pass over nulls
    return F.when(n.isNotNull(), F.greatest(F.lit(0.0), center - half)), F.when(n.isNotNull(), F.least(F.lit(1.0), center + half))


def family_rates(decided: DataFrame, dims: list[str] | None = None) -> DataFrame:
    """Family counts over rows with a source group: human families with a false flag, ai families all caught.

    ``decided`` has unit and decision. Bounds are null as soon as a human row has no source group.
    """
    dims = dims or []
    grouped = F.col("source_group").isNotNull()
    per = decided.groupBy(*dims, "unit", "label").agg(
        F.bool_or(grouped).alias("known"), F.bool_or(grouped & (F.col("decision") == "ai")).alias("flagged"),
        F.bool_and(~grouped | (F.col("decision") == "ai")).alias("caught"), F.count_if(~grouped).alias("ungrouped"),
    )
    human, ai = F.col("label") == 0, F.col("label") == 1
    told = per.groupBy(*dims).agg(
        F.count_if(human & F.col("known")).alias("human_groups"), F.count_if(ai & F.col("known")).alias("ai_groups"),
        F.count_if(human & F.col("flagged")).alias("false_groups"), F.count_if(ai & F.col("known") & F.col("caught")).alias("caught_groups"),
        F.sum("ungrouped").alias("missing_groups"), F.coalesce(F.sum(F.when(human, F.col("ungrouped"))), F.lit(0)).alias("human_missing"),
    )
    lower, upper = wilson(F.col("false_groups"), F.col("human_groups"))
    complete = F.col("human_missing") == 0
    return told.withColumns({
        "human_group_fpr": ratio(F.col("false_groups"), F.col("human_groups")), "ai_group_recall": ratio(F.col("caught_groups"), F.col("ai_groups")),
        "fpr_lower": F.when(complete, lower), "fpr_upper": F.when(complete, upper),
    }).drop("human_missing")


def threshold_options(rows: DataFrame) -> DataFrame:
    """For each distinct score c: units of each label with a maximum >= c, and with a minimum <= c.

    ``rows`` have unit. Counts come from running sums over the distinct scores, from both ends.
    """
    scores = rows.select("score").distinct()
    per = rows.groupBy("label", "unit").agg(F.max("score").alias("hi"), F.min("score").alias("lo"))
    counts = per.groupBy(F.col("hi").alias("score")).agg(F.count_if(F.col("label") == 1).alias("hi_ai"), F.count_if(F.col("label") == 0).alias("hi_human"))
    lows = per.groupBy(F.col("lo").alias("score")).agg(F.count_if(F.col("label") == 1).alias("lo_ai"), F.count_if(F.col("label") == 0).alias("lo_human"))
    table = scores.join(counts, "score", "left").join(lows, "score", "left").na.fill(0)
    high = running_sums(table.select("score", "hi_ai", "hi_human"), ["hi_ai", "hi_human"], descending=True)
    low = running_sums(table.select("score", "lo_ai", "lo_human"), ["lo_ai", "lo_human"])
    told = high.select("score", F.col("run_hi_ai").alias("hi_ai"), F.col("run_hi_human").alias("hi_human"))
    return told.join(low.select("score", F.col("run_lo_ai").alias("lo_ai"), F.col("run_lo_human").alias("lo_human")), "score")


def select_thresholds(rows: DataFrame, ai_cap: float = CAP, human_cap: float = CAP) -> DataFrame:
    """One row human_max, ai_min: most correct families under each side's cap on wrong ones.

    Ties prefer fewer wrong families, then the more careful score. A side without an admissible score is null.
    ``rows`` have unit.
    """
    totals = rows.agg(F.countDistinct(F.when(F.col("label") == 0, F.col("unit"))).alias("n_human"), F.countDistinct(F.when(F.col("label") == 1, F.col("unit"))).alias("n_ai"))
    options = threshold_options(rows).join(F.broadcast(totals))
    fit = (F.col("hi_ai") > 0) & (F.col("hi_human") / F.col("n_human") <= ai_cap)
    upper = options.agg(F.max(F.when(fit, F.struct("hi_ai", (-F.col("hi_human")).alias("w"), "score")))["score"].alias("ai_min"))
    below = options.join(F.broadcast(upper)).where(F.col("ai_min").isNull() | (F.col("score") < F.col("ai_min")))
    fit = (F.col("lo_human") > 0) & (F.col("lo_ai") / F.col("n_ai") <= human_cap)
    lower = below.agg((-F.max(F.when(fit, F.struct("lo_human", (-F.col("lo_ai")).alias("w"), (-F.col("score")).alias("s"))))["s"]).alias("human_max"))
    return lower.join(F.broadcast(upper))


def collected(thresholds: DataFrame) -> Thresholds:
    row = thresholds.first()
    return Thresholds(row["human_max"], row["ai_min"])


def summary(rows: DataFrame, thresholds: Thresholds, dims: list[str] | None = None) -> DataFrame:
    """All metrics, for each value of ``dims``; families are formed anew inside each value."""
    dims = dims or []
    decided = units(rows, dims).withColumn("decision", thresholds.decide(F.col("score")))
    parts = [rates(confusion(decided, dims)), brier(decided, dims), auroc(decided, dims), family_rates(decided, dims)]
    out = parts[0]
    for part in parts[1:]:
        if dims:
            named = part.select(*(F.col(d).alias("_" + d) for d in dims), *(c for c in part.columns if c not in dims))
            on = F.lit(True)
            for d in dims:
                on = on & F.col(d).eqNullSafe(F.col("_" + d))
            out = out.join(named, on).drop(*("_" + d for d in dims))
        else:
            out = out.join(F.broadcast(part))
    return out


def subgroups(rows: DataFrame, thresholds: Thresholds, fields: list[str]) -> DataFrame:
    """Metrics by field and value, with '__missing__' for nulls of a field that occurs at all; ids are integers.

    All fields go through one summary: a row counts once for each field, under an id of its own there.
    """
    seen = rows.agg(*(F.bool_or(F.col(f).isNotNull()).alias(f) for f in fields)).first()
    told = [f for f in fields if seen[f]]
    each = [F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("__missing__")).alias("value"), F.lit(k).alias("_no")) for k, f in enumerate(told)]
    none = F.array().cast("array<struct<field:string,value:string,_no:int>>")
    stacked = rows.select("*", F.inline(F.array(*each) if each else none)).withColumn("id", F.col("id") * max(len(told), 1) + F.col("_no")).drop("_no")
    return summary(stacked, thresholds, ["field", "value"])


def unseen_generators(rows: DataFrame, known: DataFrame, thresholds: Thresholds, least_groups: int = LEAST_AI_GROUPS) -> DataFrame:
    """generator, ai_groups, ai_recall, ai_group_recall, passed for ai rows whose generator was not calibrated on."""
    ai = rows.where((F.col("label") == 1) & F.col("generator").isNotNull()).join(known.select("generator").where("generator is not null").distinct(), "generator", "left_anti")
    told = summary(ai, thresholds, ["generator"])
    good = (F.col("ai_groups") >= least_groups) & (F.col("missing_groups") == 0) & (F.col("ai_recall") >= LEAST_RECALL) & (F.col("ai_group_recall") >= LEAST_RECALL)
    return told.select("generator", "ai_groups", "missing_groups", "ai_recall", "ai_group_recall", F.coalesce(good, F.lit(False)).alias("passed"))


def gates(told: DataFrame, *, test_split: bool = True, calibrated: bool = True, independent: bool = False, unseen_passed: bool = False) -> DataFrame:
    """gate, passed: the release checks of a one-row summary."""
    c = F.col
    checks = {
        "test_split": F.lit(test_split), "calibration_provenance": F.lit(calibrated),
        "independent_source_groups": (c("missing_groups") == 0) & F.lit(independent),
        "minimum_human_groups": c("human_groups") >= LEAST_HUMAN_GROUPS, "minimum_ai_groups": c("ai_groups") >= LEAST_AI_GROUPS,
        "human_fpr_upper_95": (c("fpr_upper") <= MOST_FPR) & (c("human_fpr") <= MOST_FPR),
        "ai_recall": (c("ai_recall") >= LEAST_RECALL) & (c("ai_group_recall") >= LEAST_RECALL),
        "coverage": c("coverage") >= LEAST_COVERAGE, "unseen_generator_evidence": F.lit(unseen_passed),
    }
    made = F.array(*(F.struct(F.lit(name).alias("gate"), F.coalesce(ok, F.lit(False)).alias("passed")) for name, ok in checks.items()))
    return told.select(F.inline(made))


def policy_matrix(scored: DataFrame, primary: Thresholds, secondary: Thresholds, dataset: str = "dataset") -> DataFrame:
    """dataset, policy and rates for five policies over score (primary) and second_score.

    agreement: both decide alike, else uncertain; primary; secondary; half: the primary score cut at one half;
    combined: the primary decides and the secondary never vetoes.
    """
    a, b = primary.decide(F.col("score")), secondary.decide(F.col("second_score"))
    policies = {"agreement": F.when(a == b, a).otherwise("uncertain"), "primary": a, "secondary": b, "half": F.when(F.col("score") >= 0.5, "ai").otherwise("human"), "combined": a}
    stacked = F.inline(F.array(*(F.struct(F.lit(n).alias("policy"), d.alias("decision")) for n, d in policies.items())))
    return rates(confusion(scored.select(dataset, "label", stacked), [dataset, "policy"]))


def choose_candidate(told: DataFrame) -> DataFrame:
    """The representation with the highest (ai_recall, coverage, preference); ``told`` has kind and preference."""
    return told.agg(F.max_by("kind", F.struct("ai_recall", "coverage", "preference")).alias("kind"))


def overlaps(calibration: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """key, n: how many distinct values of each key are in both sets; all must be 0 before a test."""
    parts = [calibration.select(F.col(k).cast("string").alias("v")).where("v is not null").intersect(test.select(F.col(k).cast("string").alias("v"))).agg(F.lit(k).alias("key"), F.count("*").alias("n")) for k in keys]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("key", "n")


def native_cutoff(rows: DataFrame, cutoff: DataFrame) -> DataFrame:
    """The logit of the first row whose score equals the cut-off exactly; ``cutoff`` is one row named score."""
    return rows.join(F.broadcast(cutoff), "score").agg(F.min_by("logit", "id").alias("native"))


def external_overlap(rows: DataFrame, external: DataFrame, hashes: list[str]) -> DataFrame:
    """The external rows of which any hash is any hash of ``rows``: a corpus held out must give none."""

    def every(df: DataFrame) -> DataFrame:
        return df.select(F.explode(F.array(*hashes)).alias("_hash")).where("_hash is not null").distinct()

    marked = external.withColumn("_hash", F.array(*hashes))
    met = marked.select(*external.columns, F.explode("_hash").alias("_hash")).join(every(rows), "_hash", "left_semi")
    return met.drop("_hash").distinct()


def prediction_problems(predictions: DataFrame, preprocessing: str, max_tokens: int) -> DataFrame:
    """id, problems array<string> of predictions (id, preprocessing, max_tokens, truncated, logits, score) against their contract."""
    c = F.col
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rules = {
        "preprocessing": ~c("preprocessing").eqNullSafe(preprocessing), "max_tokens": ~c("max_tokens").eqNullSafe(max_tokens), "truncated": F.coalesce("truncated", F.lit(True)),
        "logits": ~F.coalesce((F.size("logits") == 2) & ~F.exists("logits", lambda x: ~finite(x)), F.lit(False)), "score": ~F.coalesce(finite(c("score")) & c("score").between(0, 1), F.lit(False)),
    }
    return predictions.select("id", F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items()))).alias("problems"))


#: What of a report may be published.
PUBLIC = ["human_max", "ai_min", "selected_on", "calibration_sha256", "product_approved"]


def public_report(report: DataFrame, more: list[str] | None = None) -> DataFrame:
    """The columns of a report that are on the list; others, such as ids and texts, stay private."""
    return report.select(*(c for c in report.columns if c in {*PUBLIC, *(more or [])}))
