"""Mixing sources to target weights by Poisson replication.

Each document of a source gets a copy count from the Poisson distribution with the
source's mean repetition rate, inverted at a uniform number hashed from the document
id and a seed; counts stop at the source's cap. The same document, seed and rate
always give the same count, on any cluster. Because counts only grow with the rate,
the rate of each source is chosen so that the tokens drawn meet the target to within
about one document: for document and copy k there is one rate at which copy k
appears, so the sought rate is a weighted quantile of these, found by refining a
histogram. Copies are then put into one global random order.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.session import materialize

#: Bins of each refinement of the rate's histogram, and refinements.
BINS, REFINEMENTS = 512, 4


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) hashed from key and seed."""
    bits = F.shiftrightunsigned(F.xxhash64(key.cast("string"), F.lit(seed)), 12).cast("double")
    return (bits + 0.5) / F.lit(2.0**52)


def poisson_below(k: int, rate: np.ndarray) -> np.ndarray:
    """P(count < k) at each rate, for rates of any size."""
    with np.errstate(divide="ignore"):
        log_rate = np.log(rate)
    total = np.exp(-rate)
    for i in range(1, k):
        total = total + np.exp(i * log_rate - rate - math.lgamma(i + 1))
    return total


def rate_bound(cap: int) -> float:
    """A rate at which every document is drawn as often as the cap allows: beyond it
    the chance of fewer copies is under the smallest number ``uniform`` gives."""
    rate = cap + 40.0
    while poisson_below(cap, np.array([rate]))[0] > 2.0**-54:
        rate *= 1.25
    return float(rate)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _entry_rates(u: pd.Series, cap: pd.Series) -> pd.Series:
    """For each copy up to the cap the smallest rate at which it is drawn."""
    u_, caps = u.to_numpy(), cap.fillna(0).to_numpy().astype(int)
    out: list[list[float]] = [[] for _ in u_]
    for most in np.unique(caps[caps > 0]):
        rows = np.flatnonzero(caps == most)
        bound, mine, found = rate_bound(int(most)), u_[rows], np.zeros((len(rows), most))
        for k in range(1, most + 1):
            low, high = found[:, k - 2].copy() if k > 1 else np.zeros(len(rows)), np.full(len(rows), bound)
            for _ in range(50):
                middle = (low + high) / 2
                drawn = poisson_below(k, middle) <= mine
                high, low = np.where(drawn, middle, high), np.where(drawn, low, middle)
            found[:, k - 1] = high
        for i, rates in zip(rows, found.tolist()):
            out[i] = rates
    return pd.Series(out)


def mixture_size(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_tokens, wanted): tokens wanted of each
    source in the largest mixture that no cap forbids. One row per source."""
    named = sizes.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"))
    # one row per source: a bounded list, given by the targets
    rows = (
        targets.where("source is not null and target_share > 0 and max_repeats > 0")
        .groupBy("source")
        .agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
        .join(named, "source", "left")
        .fillna(0, ["n_tokens"])
    )
    limit = F.min(F.col("n_tokens") * F.col("max_repeats") / F.col("target_share")).over(Window.partitionBy(F.lit(1)))
    return rows.withColumn("wanted", F.floor(limit * F.col("target_share")))


def poisson_mixture(sizes: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 17) -> DataFrame:
    """The mixture: (key, source, copy_no, n_tokens, position_key), one row per copy.

    ``sizes`` has key, source and n_tokens; documents of no target source, with a
    null source or without tokens take no part, repeated keys count once. If a
    target source has no tokens the only mixture with the target shares is empty.
    Sorting by position_key gives the global order; the rows come range-partitioned
    and sorted by it.
    """
    spark = sizes.sparkSession
    docs = sizes.where("source is not null and n_tokens > 0").groupBy(key).agg(
        F.min("source").alias("source"), F.min_by("n_tokens", "source").alias("n_tokens")
    )
    plan = mixture_size(docs, targets).collect()  # one row per source of the target list
    wanted = {r.source: r.wanted for r in plan}
    caps = F.create_map(*[x for r in plan for x in (F.lit(r.source), F.lit(int(r.max_repeats)))]) if plan else None
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, source string, copy_no int, n_tokens long, position_key long"
    if not plan or not all(wanted.values()):
        return spark.createDataFrame([], schema)
    drawn = docs.withColumn("cap", caps[F.col("source")]).where("cap is not null")
    copies = drawn.select(
        key, "source", F.col("n_tokens").cast("long").alias("n_tokens"), F.posexplode(_entry_rates(uniform(F.col(key), seed), F.col("cap"))).alias("c", "rate")
    )
    copies = materialize(copies)
    rates = _meeting_rates(copies, wanted, {r.source: rate_bound(int(r.max_repeats)) for r in plan})
    rate = F.create_map(*[x for s, v in rates.items() for x in (F.lit(s), F.lit(float(v)))])
    position = F.xxhash64(F.col(key).cast("string"), F.col("c"), F.lit(seed + 1))
    return (
        copies.where(F.col("rate") <= rate[F.col("source")])
        .select(key, "source", (F.col("c") + 1).alias("copy_no"), "n_tokens", position.alias("position_key"))
        .repartitionByRange("position_key")
        .sortWithinPartitions("position_key")
    )


def _meeting_rates(copies: DataFrame, wanted: dict[str, int], bounds: dict[str, float]) -> dict[str, float]:
    """Per source the rate at which the drawn tokens come closest to those wanted.

    Only sums per source and bin reach the driver: BINS rows a source and round."""
    low, high = dict.fromkeys(wanted, 0.0), dict(bounds)
    below = dict.fromkeys(wanted, 0)  # tokens drawn at the rate low
    rates = dict(bounds)
    open_ = set(wanted)
    for _ in range(REFINEMENTS):
        at = lambda of: F.create_map(*[x for s in wanted for x in (F.lit(s), F.lit(of[s]))])[F.col("source")]
        width = (at(high) - at(low)) / BINS
        sums = (
            copies.where((F.col("rate") > at(low)) & (F.col("rate") <= at(high)))
            .groupBy("source", F.ceil((F.col("rate") - at(low)) / width).alias("bin"))
            .agg(F.sum("n_tokens").alias("t"))
            .orderBy("source", "bin")
            .collect()
        )
        for s, aim in [(s, wanted[s]) for s in sorted(open_)]:
            width_s, start = (high[s] - low[s]) / BINS, low[s]
            for r in sums:
                if r.source != s:
                    continue
                if below[s] + r.t > aim:  # the sought rate lies in this bin
                    nearer = below[s] + r.t - aim < aim - below[s]
                    low[s], high[s] = start + (r.bin - 1) * width_s, start + r.bin * width_s
                    rates[s] = high[s] if nearer else low[s]
                    break
                below[s] += r.t
            else:  # all its copies together don't exceed what is wanted, or the bin is a single rate
                open_.discard(s)
    return rates


def mixture_report(mixture: DataFrame, targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per target source: share wanted and reached, tokens, documents, copies and
    the most often one document was used. Sources that gave nothing have zeros."""
    per_doc = mixture.groupBy("source", key).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("c"))
    got = per_doc.groupBy("source").agg(
        F.sum("t").alias("n_tokens"), F.count("*").alias("n_docs"), F.sum("c").alias("n_copies"), F.max("c").alias("most_repeats")
    )
    every = Window.partitionBy(F.lit(1))
    return (
        targets.groupBy("source")
        .agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
        .join(got, "source", "left")
        .fillna(0)
        .withColumn("actual_share", F.when(F.sum("n_tokens").over(every) > 0, F.col("n_tokens") / F.sum("n_tokens").over(every)).otherwise(F.lit(0.0)))
    )
