"""Operators over ordered rows: runs, segments, stretches, sequence checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(cols: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in cols]


def islands(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "run_no") -> DataFrame:
    """Number the runs of equal values of each key in order (W5, gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(*_order(order))
    new = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def segments_on_fall(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "segment_no") -> DataFrame:
    """Count up whenever the value falls below the one before."""
    w = Window.partitionBy(*keys).orderBy(*_order(order))
    fall = F.when(F.col(value) < F.lag(value).over(w), 1).otherwise(0)
    return df.withColumn("_fall", fall).withColumn(name, F.sum("_fall").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fall")


def falls_back(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "falls_back") -> DataFrame:
    """True where a value lies below the largest before it."""
    w = Window.partitionBy(*keys).orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.col(value) < F.max(value).over(w), F.lit(False)))


def number_gaps(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """(keys, after, missing): holes in a sequence of numbers."""
    w = Window.partitionBy(*keys).orderBy(number)
    step = F.lead(number).over(w) - F.col(number) - 1
    return df.where(F.col(number).isNotNull()).select(*keys, number).distinct().select(*keys, F.col(number).alias("after"), step.alias("missing")).where("missing > 0")


def number_gaps_allowing(df: DataFrame, keys: list[str], order: list[str], number: str) -> DataFrame:
    """(keys, after, hole, unnumbered, missing): holes in the numbers of ordered rows that
    are wider than the rows without a number between them allow (W12)."""
    w = Window.partitionBy(*keys).orderBy(*_order(order))
    blank = F.sum(F.when(F.col(number).isNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    known = df.withColumn("_blank", blank).where(F.col(number).isNotNull())
    hole, between = F.lead(number).over(w) - F.col(number) - 1, F.lead("_blank").over(w) - F.col("_blank")
    told = known.select(*keys, F.col(number).alias("after"), hole.alias("hole"), between.alias("unnumbered"))
    return told.where("hole > 0 and hole > unnumbered").withColumn("missing", F.col("hole") - F.col("unnumbered"))


def fill_from_next(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """A null takes the value of the next row of its key."""
    w = Window.partitionBy(*keys).orderBy(*_order(order))
    return df.withColumn(value, F.coalesce(F.col(value), F.lead(value).over(w)))


def fill_last(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Nearest value before or at the row."""
    w = Window.partitionBy(*keys).orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def stretch_choice(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Per key the value with most unbroken stretches, then most rows.

    Gives (keys, winner, label): ``consistent`` for a single value, ``by stretches``,
    ``by rows``, or ``unresolved`` with a null winner at a full tie. Nulls in the
    value don't count.
    """
    known = df.where(F.col(value).isNotNull())
    numbered = islands(known, keys, order, value, "_run")
    per = numbered.groupBy(*keys, value).agg(F.countDistinct("_run").alias("_s"), F.count("*").alias("_r"))
    w = Window.partitionBy(*keys).orderBy(F.desc("_s"), F.desc("_r"), F.col(value))
    ranked = per.withColumn("_k", F.row_number().over(w)).withColumn("_s2", F.lead("_s").over(w)).withColumn("_r2", F.lead("_r").over(w))
    label = (
        F.when(F.col("_s2").isNull(), "consistent").when(F.col("_s") > F.col("_s2"), "by stretches").when(F.col("_r") > F.col("_r2"), "by rows").otherwise("unresolved")
    )
    return ranked.where("_k = 1").withColumn("label", label).select(*keys, F.when(F.col("label") != "unresolved", F.col(value)).alias("winner"), "label")


def block_totals(df: DataFrame, keys: list[str], order: list[str], amount: str, is_total: Column) -> DataFrame:
    """Each total row with the sum of the rows since the total before it."""
    w = Window.partitionBy(*keys).orderBy(*_order(order))
    before = F.coalesce(F.sum(F.when(is_total, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = df.withColumn("block_no", before).withColumn("_total", is_total)
    return marked.groupBy(*keys, "block_no").agg(
        F.max(F.when(F.col("_total"), F.col(amount))).alias("stated"), F.sum(F.when(~F.col("_total"), F.col(amount))).alias("summed")
    )
