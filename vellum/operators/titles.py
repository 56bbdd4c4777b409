"""Titles of one day and place matched by tiers, down to likeness."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.names import title_key

#: Tiers from the surest on; the last two need this likeness of keys.
TIERS = ["exact_printed", "exact", "excerpt", "prefix", "fuzzy", "window"]
LEAST = 0.8


def ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def window_ratio(short: str, long: str) -> float:
    """Greatest likeness of the shorter key to a stretch of its length in the longer."""
    short, long = sorted((short, long), key=len)
    n = len(short)
    return max((ratio(short, long[i : i + n]) for i in range(len(long) - n + 1)), default=0.0)


@F.pandas_udf(T.IntegerType())
def _tier(a: pd.Series, b: pd.Series, ka: pd.Series, kb: pd.Series) -> pd.Series:
    def of(x: str, y: str, kx: str, ky: str) -> int:
        if x == y:
            return 0
        if kx == ky:
            return 1
        small, large = sorted((kx, ky), key=len)
        if len(small) >= 4 and large.endswith(small):
            return 2
        if len(small) >= 4 and large.startswith(small):
            return 3
        if ratio(kx, ky) >= LEAST:
            return 4
        return 5 if len(small) >= 6 and window_ratio(small, large) >= LEAST else 9

    return pd.Series([of(*row) for row in zip(a, b, ka, kb)], dtype="int32")


def tiered_titles(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, title: str) -> DataFrame:
    """(left_id, match, tier): the right title of the same keys that the best tier gives
    (J17), smallest id at a tie; ``none`` where no tier holds.

    Titles meet on the keys alone, a day and a place; null and blank titles match
    nothing, repeated rows count once, null keys meet nothing.
    """
    side = lambda df, i, t: df.select(*keys, F.col(i).alias(f"_{t}id"), F.col(title).alias(f"_{t}"), title_key(F.col(title)).alias(f"_{t}k")).distinct()
    a, b = side(left, left_id, "a"), side(right, right_id, "b").where("_bk is not null and _bk <> ''")
    met = a.where("_ak is not null and _ak <> ''").join(b, keys).withColumn("_t", _tier("_a", "_b", "_ak", "_bk")).where("_t < 9")
    best = met.withColumn("_r", F.row_number().over(Window.partitionBy("_aid").orderBy("_t", "_bid"))).where("_r = 1").select("_aid", "_bid", "_t")
    names = F.array(*[F.lit(t) for t in TIERS])
    told = a.select("_aid").distinct().join(best, "_aid", "left")
    return told.select(F.col("_aid").alias(left_id), F.col("_bid").alias("match"), F.coalesce(F.get(names, F.col("_t")), F.lit("none")).alias("tier"))
