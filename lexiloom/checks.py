"""Assertions over DataFrames: counts of violations in one pass, and an error that names them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        super().__init__(", ".join(f"{name}: {n}" for name, n in sorted(counts.items())))


def violations(df: DataFrame, rules: dict[str, Column]) -> dict[str, int]:
    """How many rows violate each rule (a rule is true where a row is wrong; null counts as wrong)."""
    row = df.agg(*(F.count_if(F.coalesce(rule, F.lit(True))).alias(name) for name, rule in rules.items())).first()
    return {name: row[name] for name in rules if row[name]}


def require(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df``, or CheckFailed if any row violates a rule."""
    if found := violations(df, rules):
        raise CheckFailed(found)
    return df


def require_unique(df: DataFrame, *columns: str) -> DataFrame:
    repeated = df.groupBy(*columns).count().where("count > 1").count()
    if repeated:
        raise CheckFailed({"repeated " + ",".join(columns): repeated})
    return df


def require_empty(df: DataFrame, name: str) -> None:
    if n := df.count():
        raise CheckFailed({name: n})
