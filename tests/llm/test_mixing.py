import numpy as np
from pyspark.sql import functions as F

from vellum.llm.mixing import mixture_report, poisson_below, poisson_mixture, rate_bound


def sizes(spark, n=4000):
    s = F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "mid").otherwise("small")
    return spark.range(n).select(F.col("id").alias("doc_id"), s.alias("source"), (F.col("id") % 97 + 5).cast("int").alias("n_tokens"))


TARGETS = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 3)]


def targets(spark, rows=TARGETS):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_poisson_below():
    assert np.allclose(poisson_below(2, np.array([1.0])), 2 * np.exp(-1))


def test_shares_caps_and_repeatability(spark):
    mix = poisson_mixture(sizes(spark), targets(spark))
    report = {r.source: r for r in mixture_report(mix, targets(spark)).collect()}
    for source, share, cap in TARGETS:
        assert abs(report[source].actual_share - share) < 0.003
        assert report[source].most_repeats <= cap
    again = poisson_mixture(sizes(spark).repartition(7), targets(spark))
    key = ["doc_id", "copy_no"]
    assert sorted(map(tuple, mix.select(*key).collect())) == sorted(map(tuple, again.select(*key).collect()))
    other = poisson_mixture(sizes(spark), targets(spark), seed=5)
    assert sorted(map(tuple, mix.select(*key).collect())) != sorted(map(tuple, other.select(*key).collect()))


def test_order_mixes_sources(spark):
    rows = [r.source for r in poisson_mixture(sizes(spark), targets(spark)).orderBy("position_key").collect()]
    third = rows[: len(rows) // 3]
    assert 0.5 < third.count("mid") / len(third) / (rows.count("mid") / len(rows)) < 1.5


def test_nulls_repeats_empty(spark):
    df = sizes(spark, 300)
    odd = df.union(df.limit(100)).union(spark.createDataFrame([(900, None, 4), (901, "other", 4), (902, "big", None), (903, "big", 0)], "doc_id long, source string, n_tokens int"))
    a = {tuple(r) for r in poisson_mixture(odd, targets(spark)).select("doc_id", "copy_no").collect()}
    assert a == {tuple(r) for r in poisson_mixture(df, targets(spark)).select("doc_id", "copy_no").collect()}
    assert not {k for k, _ in a} & {900, 901, 902, 903}
    assert poisson_mixture(df.limit(0), targets(spark)).collect() == []
    assert poisson_mixture(df, targets(spark, [])).collect() == []
    assert poisson_mixture(df, targets(spark, [*TARGETS, ("absent", 0.1, 2)])).collect() == []


def test_high_caps_meet_the_target(spark):
    """Four documents that may come a hundred times come as often as their share asks."""
    sizes_ = spark.createDataFrame([(i, "few", 10) for i in range(4)] + [(100 + i, "many", 10) for i in range(720)], "doc_id long, source string, n_tokens int")
    goals = targets(spark, [("few", 0.05, 100), ("many", 0.95, 1)])
    got = {r.source: r for r in mixture_report(poisson_mixture(sizes_, goals), goals).collect()}
    assert got["many"].n_copies == 720 and abs(got["few"].n_copies - 38) <= 1
    more = targets(spark, [("few", 0.333, 100), ("many", 0.667, 1)])
    got = {r.source: r for r in mixture_report(poisson_mixture(sizes_, more), more).collect()}
    assert abs(got["few"].n_copies - 359) <= 2 and got["few"].most_repeats <= 100


def test_rate_bound():
    for cap in (1, 2, 10, 100, 900):
        assert poisson_below(cap, np.array([rate_bound(cap)]))[0] < 2.0**-53
