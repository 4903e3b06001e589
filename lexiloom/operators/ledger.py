"""The issue ledger: open, resolved and reopened issues from observations in order.

A passed observation of an issue that never failed leaves no row. A later pass resolves it; a failure
opens it, or reopens it if it was ever resolved. Blocking is sticky.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def transitions(seen: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, the order columns, status, blocking, changed for every observation that has a status.

    In closed form over the observations of a key: a failure reopens iff some earlier one passed after the
    first failure; a pass resolves iff some failure came before.
    """
    w = Window.partitionBy(key).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    failed = F.coalesce(F.bool_or(~F.col("passed")).over(before), F.lit(False))
    marked = seen.withColumn("_failed", failed)
    resolved = F.coalesce(F.bool_or(F.col("passed") & F.col("_failed")).over(before), F.lit(False))
    status = F.when(F.col("passed") & F.col("_failed"), "resolved").when(F.col("passed"), F.lit(None)).when(resolved, "reopened").otherwise("open")
    sticky = F.bool_or(F.coalesce("blocking", F.lit(False)) & F.col("_told")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    told = marked.withColumn("status", status).withColumn("_told", F.col("status").isNotNull())
    told = told.withColumn("blocking", sticky).where("_told")
    changed = ~F.col("status").eqNullSafe(F.lag("status").over(w))
    return told.select(key, *order, "status", "blocking", changed.alias("changed"))


def fold(seen: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, status, blocking, changes: the ledger after all observations."""
    steps = transitions(seen, key, order)
    at = F.struct(*order)
    return steps.groupBy(key).agg(F.max_by("status", at).alias("status"), F.bool_or("blocking").alias("blocking"), F.count_if("changed").alias("changes"))


def history(seen: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, history array of (order columns, status): the appended changes."""
    return transitions(seen, key, order).where("changed").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, "status"))).alias("history"))


def counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("status").agg(F.count("*").alias("n"), F.count_if("blocking").alias("blocking"))


def blockers(ledger: DataFrame, key: str) -> DataFrame:
    return ledger.where((F.col("status") != "resolved") & F.col("blocking")).select(key).orderBy(key)


def gate_status(gates: DataFrame, checks: DataFrame) -> DataFrame:
    """gate, passed: gates with dependencies that all passed; gates has gate, check_ids, checks has check_id, passed."""
    needed = gates.select("gate", F.explode_outer("check_ids").alias("check_id"))
    joined = needed.join(checks, "check_id", "left")
    return joined.groupBy("gate").agg((F.count("check_id") > 0).alias("some"), F.bool_and(F.coalesce("passed", F.lit(False))).alias("every")).select("gate", (F.col("some") & F.col("every")).alias("passed"))


def review_slots(slots: DataFrame, reviews: DataFrame) -> DataFrame:
    """slot, reviewer, passed: a slot passes with a review whose reviewer fills no other required slot."""
    joined = slots.join(reviews, "slot", "left")
    used = F.count(F.when(F.col("required"), F.col("reviewer"))).over(Window.partitionBy("reviewer"))
    return joined.withColumn("used", used).select("slot", "reviewer", (F.col("reviewer").isNotNull() & F.coalesce("approved", F.lit(False)) & (F.col("used") <= 1)).alias("passed"))


def decide(ledger: DataFrame) -> DataFrame:
    """decision, blocking: promote without unresolved blocking issues, else block."""
    told = ledger.agg(F.count_if((F.col("status") != "resolved") & F.col("blocking")).alias("blocking"))
    return told.select(F.when(F.col("blocking") == 0, "promote").otherwise("block").alias("decision"), "blocking")


def stop_reasons(sweeps: DataFrame, key: str, order: list[str], max_seconds: float) -> DataFrame:
    """key, iterations, decision, stop_reason of runs of sweeps (decision, signature, elapsed before the sweep began).

    A run stops before the first sweep that begins beyond its time, after the first that promotes, or after the first that
    repeats the signature of the one before; else when its sweeps are over.
    """
    w = Window.partitionBy(key).orderBy(*order)
    n = F.row_number().over(w)
    repeated = F.col("signature").eqNullSafe(F.lag("signature").over(w)) & (n > 1)
    why = F.when(F.col("elapsed") >= max_seconds, "time_budget").when(F.col("decision") == "promote", "promoted").when(repeated, "no_progress")
    told = sweeps.withColumn("n", n).withColumn("why", why)
    stop = F.min(F.when(F.col("why").isNotNull(), F.struct("n", "why")))
    ended = told.groupBy(key).agg(stop.alias("stop"), F.count("*").alias("all"))
    ended = ended.withColumn("iterations", F.when(F.col("stop").isNull(), F.col("all")).when(F.col("stop.why") == "time_budget", F.col("stop.n") - 1).otherwise(F.col("stop.n")))
    last = told.join(ended.select(key, "iterations"), key).where("n <= iterations").groupBy(key).agg(F.max_by("decision", "n").alias("decision"))
    return ended.join(last, key, "left").select(key, F.col("iterations").cast("long").alias("iterations"), F.coalesce("decision", F.lit("block")).alias("decision"), F.coalesce("stop.why", F.lit("max_iterations")).alias("stop_reason"))


#: The fields of a protocol of version 1, and of its entries.
PROTOCOL_FIELDS = ["version", "allowed_scripts", "implementation_paths", "input_paths", "checks", "gates", "review_slots"]
CHECK_FIELDS = ["id", "script", "args", "required", "timeout_seconds", "output"]
_PROTOCOL = (
    "struct<version:string,allowed_scripts:array<string>,implementation_paths:array<string>,input_paths:array<string>,checks:array<struct<id:string,script:string,args:array<string>,"
    "required:string,timeout_seconds:string,output:string>>,gates:array<struct<id:string,description:string,check_ids:array<string>,required:string>>,review_slots:array<struct<id:string,required:string>>>"
)


def protocol_problems(protocols: DataFrame) -> DataFrame:
    """id, problems array<string> of protocols (id, protocol as JSON); what its paths name is not looked at."""
    p = F.from_json("protocol", _PROTOCOL)
    keys = F.json_object_keys("protocol")

    def ids(name: str):
        return F.transform(F.col(f"p.{name}"), lambda x: x["id"])

    def bad(name: str):
        names, listed = ids(name), F.col(f"p.{name}")
        blank = F.exists(names, lambda x: F.coalesce(F.trim(x), F.lit("")) == "")
        flag = F.exists(listed, lambda x: ~F.coalesce(x["required"], F.lit("true")).isin("true", "false"))
        return blank | flag | (F.size(F.array_distinct(names)) < F.size(names))

    checks = F.col("p.checks")
    timeout = lambda x: F.coalesce(x["timeout_seconds"], F.lit("30")).try_cast("double")
    known = F.coalesce(ids("checks"), F.array().cast("array<string>"))
    rules = {
        "version": ~F.col("p.version").eqNullSafe("1"), "unknown fields": F.size(F.array_except("keys", F.array(*map(F.lit, PROTOCOL_FIELDS)))) > 0,
        "missing lists": F.exists(F.array(*(F.col(f"p.{c}").isNull() for c in PROTOCOL_FIELDS[1:])), lambda x: x),
        "no implementation": F.size("p.implementation_paths") < 1, "no checks": F.size("p.checks") < 1, "checks": bad("checks"), "gates": bad("gates"), "review_slots": bad("review_slots"),
        "scripts": F.exists(checks, lambda x: ~F.coalesce(F.array_contains("p.allowed_scripts", x["script"]), F.lit(False))),
        "timeouts": F.exists(checks, lambda x: ~F.coalesce(timeout(x).between(0.01, 3600), F.lit(False))),
        "outputs": F.exists(checks, lambda x: ~F.coalesce(x["output"], F.lit("json")).isin("json", "exit_code")),
        "none required": (F.size("p.checks") > 0) & ~F.exists(checks, lambda x: F.coalesce(x["required"], F.lit("true")) == "true"),
        "descriptions": F.exists("p.gates", lambda x: F.coalesce(F.trim(x["description"]), F.lit("")) == ""),
        "unknown checks": F.exists("p.gates", lambda x: F.size(F.array_except(F.coalesce(x["check_ids"], F.array().cast("array<string>")), known)) > 0),
    }
    read = protocols.select("id", p.alias("p"), keys.alias("keys"))
    return read.select("id", F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()))).alias("problems"))
