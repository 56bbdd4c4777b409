"""Ordered rules that give a value together with the rule that decided it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rule_cascade(rules: list[tuple[Column, str, str]], default: tuple[str | None, str] = (None, "no rule")) -> tuple[Column, Column]:
    """(value, basis) columns of the first rule that holds.

    ``rules`` holds (condition, value, basis); a null condition doesn't hold. Both
    columns come from the same list, so they can't disagree.
    """
    value, basis = F.lit(default[0]), F.lit(default[1])
    for condition, v, b in reversed(rules):
        hit = F.coalesce(condition, F.lit(False))
        value, basis = F.when(hit, F.lit(v)).otherwise(value), F.when(hit, F.lit(b)).otherwise(basis)
    return value, basis


def flag_battery(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """One boolean column per pattern, matched in lower case; null text gives null (P10)."""
    return df.withColumns({name: F.lower(F.col(text)).rlike(p) for name, p in patterns.items()})


def theta_rules(df: DataFrame, text: str, rules: DataFrame, pattern: str) -> DataFrame:
    """Left join to a small rule table by regular expression.

    The rules are written by hand, so their number is bounded; they are broadcast.
    """
    return df.join(F.broadcast(rules), F.expr(f"{text} rlike {pattern}"), "left")


def assert_cardinality(rules: DataFrame, target: DataFrame, keys: list[str], n: int = 1) -> None:
    """Every rule must meet exactly ``n`` rows of the target, else raise."""
    met = target.groupBy(*keys).agg(F.count("*").alias("_n"))
    wrong = rules.select(*keys).join(met, keys, "left").where(F.coalesce("_n", F.lit(0)) != n)
    bad = wrong.limit(5).collect()
    if bad:
        raise ValueError(f"rules that don't meet exactly {n} rows: {[r.asDict() for r in bad]}")


def guarded_corrections(df: DataFrame, fixes: DataFrame, keys: list[str], field: str, new: str, old: str | None = None) -> DataFrame:
    """Replace ``field`` where a correction's keys meet; with ``old`` only if the row
    still holds the value the correction was written for (J14, P15, E29)."""
    picked = fixes.select(*keys, F.col(new).alias("_new"), *([F.col(old).alias("_old")] if old else []))
    joined = df.join(F.broadcast(picked), keys, "left")  # corrections are written by hand
    holds = F.col("_new").isNotNull()
    if old:
        holds = holds & F.col(field).eqNullSafe(F.col("_old"))
    return joined.withColumn(field, F.when(holds, F.col("_new")).otherwise(F.col(field))).drop("_new", "_old")
