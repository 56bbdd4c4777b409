from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.operators.intervals import interval_gaps, merge_intervals, season_spans, season_text, season_year
from pyspark.sql import functions as F

SPAN = "person string, start long, end long, note string"


def brute(rows):
    covered = {}
    for p, s, e, _ in rows:
        if p is not None and s is not None and e is not None and s < e:
            covered.setdefault(p, set()).update(range(s, e))
    out = set()
    for p, points in covered.items():
        for x in points:
            if x - 1 not in points:
                y = x
                while y in points:
                    y += 1
                out.add((p, x, y))
    return out


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(-30, 40), st.integers(-30, 60), st.just("x")), max_size=14), st.sampled_from([1, 3, 8]))
def test_merge_is_union(spark, rows, width):
    df = spark.createDataFrame(rows, SPAN)
    got = {tuple(r) for r in merge_intervals(df, "person", "start", "end", width).collect()}
    assert got == brute(rows)


def test_gaps_between_periods(spark):
    rows = [("a", 1, 3, ""), ("a", 9, 20, ""), ("a", 5, 6, ""), ("a", 40, 41, ""), ("b", 2, 3, ""), ("a", 1, 3, "")]
    periods = merge_intervals(spark.createDataFrame(rows, SPAN), "person", "start", "end")
    got = {tuple(r) for r in interval_gaps(periods, "person", "start", "end").collect()}
    assert got == {("a", 3, 5), ("a", 6, 9), ("a", 20, 40)}


def test_nulls_reversed_and_empty(spark):
    rows = [("a", None, 3, ""), ("a", 5, None, ""), (None, 1, 2, ""), ("a", 7, 7, ""), ("a", 9, 8, "")]
    assert merge_intervals(spark.createDataFrame(rows, SPAN), "person", "start", "end").collect() == []
    assert merge_intervals(spark.createDataFrame([], SPAN), "person", "start", "end").collect() == []


def test_clashing_extra_columns(spark):
    df = spark.createDataFrame([("a", 1, 3, 7, 8)], "person string, start long, end long, _k long, _s long")
    assert [tuple(r) for r in merge_intervals(df, "person", "start", "end").collect()] == [("a", 1, 3)]


def test_season_forms(spark):
    texts = ["1898-99", " 1899-00", "1893/94", "1897–1898", "1898 - 99", "1901—02", "1898-98", "1898", None, "x", "1899-1900"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(season_year(F.col("t")).alias("y"))
    assert [r.y for r in df.collect()] == [1898, 1899, 1893, 1897, 1898, 1901, None, None, None, None, 1899]
    assert spark.range(1).select(season_text(F.lit(1899))).first()[0] == "1899-00"


def test_span_lists(spark):
    text = "1890-91..1892-93; съ 1896-97 по 1895-96, 1903-04 ;?; 1900-01 … 1901/02;1899-1900.. 1900-01;"
    df = spark.createDataFrame([("p", text), ("q", None), ("r", ""), ("s", "1890-91..?")], "person string, t string")
    got = sorted(tuple(r) for r in season_spans(df, "person", "t").collect())
    assert got == [("p", 1890, 1893), ("p", 1895, 1897), ("p", 1899, 1901), ("p", 1900, 1902), ("p", 1903, 1904)]


def test_a_very_long_interval_stays_a_few_rows(spark):
    df = spark.createDataFrame([("a", 3, 10**15), ("a", 10**15, 10**15 + 1), ("a", -5, 1), ("b", 0, 8), ("b", 8, 16), ("b", 17, 40)], "k string, s long, e long")
    got = sorted(map(tuple, merge_intervals(df, "k", "s", "e").collect()))
    assert got == [("a", -5, 1), ("a", 3, 10**15 + 1), ("b", 0, 16), ("b", 17, 40)]


def test_runs_inside_a_range_of_covered_shards(spark):
    rows = [("a", -10, -9, "x"), ("a", -17, 0, "x"), ("b", 3, 4, "x"), ("b", 5, 6, "x"), ("b", -30, 40, "x"), ("c", 3, 4, "x"), ("c", 16, 33, "x")]
    got = {tuple(r) for r in merge_intervals(spark.createDataFrame(rows, SPAN), "person", "start", "end").collect()}
    assert got == {("a", -17, 0), ("b", -30, 40), ("c", 3, 4), ("c", 16, 33)}
