"""Aggregations that plain group-by doesn't offer in one step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_text(value: Column, order: Column, separator: str = ", ") -> Column:
    """Distinct values joined in the order of another key (A5)."""
    pairs = F.sort_array(F.collect_set(F.struct(order.alias("o"), value.alias("v"))))
    return F.array_join(F.transform(pairs, lambda p: p["v"]), separator)


def majority(df: DataFrame, keys: list[str], values: list[str], first: str) -> DataFrame:
    """Most frequent combination of values per key; the one seen first wins ties
    (A15, A16, A9, O4). Gives keys, values and votes."""
    votes = df.groupBy(*keys, *values).agg(F.count("*").alias("votes"), F.min(first).alias("_first"))
    w = Window.partitionBy(*keys).orderBy(F.desc("votes"), "_first", *values)
    return votes.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_first")


def others_median(df: DataFrame, keys: list[str], member: str, value: str, least: int = 4) -> DataFrame:
    """Upper median of the key's other members, for keys with enough members.

    One list of (member, value) per key is built; members of a key are a bounded
    list such as days or seasons.
    """
    listed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(value).alias("v"), F.col(member).alias("m")))).alias("_all"))
    joined = df.join(listed, keys)
    rest = F.filter("_all", lambda x: ~x["m"].eqNullSafe(F.col(member)))
    middle = F.try_element_at(F.col("_rest"), (F.floor(F.size("_rest") / 2) + 1).cast("int"))["v"]
    return joined.withColumn("_rest", rest).where(F.size("_rest") >= least).withColumn("others_median", middle).drop("_all", "_rest")


def bag_overlap(left: DataFrame, right: DataFrame, key: str, item: str) -> DataFrame:
    """Multiset precision and recall of two item bags per key."""
    a = left.groupBy(key, item).agg(F.count("*").alias("a"))
    b = right.groupBy(key, item).agg(F.count("*").alias("b"))
    both = a.join(b, [key, item], "full_outer").fillna(0, ["a", "b"])
    sums = both.groupBy(key).agg(F.sum("a").alias("n_left"), F.sum("b").alias("n_right"), F.sum(F.least("a", "b")).alias("n_both"))
    share = lambda of: F.round(F.try_divide(F.col("n_both"), F.col(of)), 6)
    return sums.select(key, "n_left", "n_right", "n_both", share("n_right").alias("prec"), share("n_left").alias("rec"))


def verdict(a: Column, b: Column, c: Column) -> Column:
    """Agreement of three sources; a missing source never agrees."""
    ab, bc, ac = F.coalesce(a == b, F.lit(False)), F.coalesce(b == c, F.lit(False)), F.coalesce(a == c, F.lit(False))
    return F.when(ab & bc, "all agree").when(ab, "first two agree").when(bc, "last two agree").when(ac, "first and last agree").otherwise("all differ")
