import pytest
from pyspark.sql import functions as F

from vellum.operators import calendar as C
from vellum.operators import matching as M
from vellum.operators import rules as R
from vellum.operators import runs as S
from vellum.operators import text as X


def test_components_of_a_chain_and_no_edges(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.vertex: r.component for r in M.min_label_components(edges, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    assert M.min_label_components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_circle_of_replacements_raises(spark):
    with pytest.raises(RuntimeError):
        M.final_of_chain(spark.createDataFrame([(1, 2), (2, 1)], "o long, n long"), "o", "n", max_depth=4)


def test_cardinality_guard(spark):
    rules = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(ValueError):
        R.assert_cardinality(rules, spark.createDataFrame([(1,), (1,), (2,)], "k int"), ["k"])
    R.assert_cardinality(rules, spark.createDataFrame([(1,), (2,), (3,)], "k int"), ["k"])


def test_rule_with_null_condition_does_not_hold(spark):
    v, b = R.rule_cascade([(F.col("x") > 1, "big", "over one"), (F.col("x").isNull(), "none", "blank")])
    got = spark.createDataFrame([(None,), (2,), (0,)], "x int").select(v.alias("v"), b.alias("b")).collect()
    assert [tuple(r) for r in got] == [("none", "blank"), ("big", "over one"), (None, "no rule")]


def test_stretches(spark):
    rows = [("a", i, v) for i, v in enumerate("xyxyyyy")] + [("b", 0, "q"), ("c", 0, "x"), ("c", 1, "y"), ("d", 0, None)]
    got = {r.k: (r.winner, r.label) for r in S.stretch_choice(spark.createDataFrame(rows, "k string, i int, v string"), ["k"], ["i"], "v").collect()}
    assert got == {"a": ("y", "by rows"), "b": ("q", "consistent"), "c": (None, "unresolved")}


def test_julian_leap_day(spark):
    df = spark.createDataFrame([("1900-02-29",), ("1900-03-01",)], "t string").withColumn("n", C.julian_day(F.col("t")))
    a, b = df.select("n", C.iso_of_julian_day(F.col("n")).alias("t")).collect()
    assert b.n == a.n + 1 and a.t == "1900-02-29" and b.t == "1900-03-01"


def test_greedy_claims_once(spark):
    rows = [("g", 1, 10, 0.9), ("g", 1, 11, 0.8), ("g", 2, 10, 0.7), ("g", 2, 11, 0.1)]
    got = {(r.l, r.r) for r in M.greedy_claim(spark.createDataFrame(rows, "g string, l int, r int, s double"), "g", "l", "r", "s").collect()}
    assert got == {(1, 10), (2, 11)}


def test_windows_merge(spark):
    df = spark.createDataFrame([(1, "a key b key " + "x" * 50 + " key")], "k int, t string")
    got = [(r.start, r.end) for r in X.keyword_windows(df, "k", "t", "key", 5).collect()]
    assert got == [(0, 16), (58, 66)]


def test_stitch(spark):
    df = spark.createDataFrame([(1, ["a b c d", "c d e", "x"]), (2, [])], "k int, b array<string>")
    assert [r.stitched for r in X.stitched(df, "k", "b").orderBy("k").collect()] == ["a b c d e x", ""]


def test_reading_selector_cases(spark):
    cases = [
        (["домъ", "дом", "домъ"], "домъ", "hard or soft sign"), (["", "театръ", None], "театръ", "present in some"), (["мiръ", "міръ", "міръ"], "міръ", "other letters"),
        (["a", "b", "c"], "REVIEW:a|b|c", "other letters"), (["вечеръ", "вечерь", "вечеръ"], "вечеръ", "hard or soft sign"), ([], None, "other letters"), (["Опера", "опера", "опера"], "опера", "case"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "k int, readings array<string>")
    from vellum.operators.text import select_reading

    got = {r.k: (r.chosen, r.kind) for r in select_reading(df, "k", "readings").collect()}
    assert {k: v for k, v in got.items() if cases[k][0]} == {i: c[1:] for i, c in enumerate(cases) if c[0]}
    assert got[5][0] is None


def test_votes_of_passes(spark):
    from vellum.operators.text import vote

    rows = [("k1", "1898"), ("k1", "1898"), ("k2", "1901"), ("k2", "1901"), ("k2", "1907"), ("k3", None), ("k3", None), ("k4", None), ("k4", "1900"), ("k5", "1902"), ("k5", "1902"), ("k5", None), ("k6", "a"), ("k6", "b")]
    got = {r.k: (r.verdict, r.value) for r in vote(spark.createDataFrame(rows, "k string, p string"), "k", "p").collect()}
    assert got == {"k1": ("agreed", "1898"), "k2": ("conflict", "1901"), "k3": ("blank agreed", None), "k4": ("single", "1900"), "k5": ("agreed", "1902"), "k6": ("conflict", "b")}


def test_partial_dates(spark):
    from vellum.operators.calendar import partial_date

    want = {
        "17 мая 1898": ("1898-05-17", "day", 1898, 5), "мартъ 1902": (None, "month", 1902, 3), "осень 1899": (None, "season", 1899, None), "около 1901 года": (None, "year", 1901, None),
        "31 февраля 1900": (None, "month", 1900, 2), "29 февраля 1900": ("1900-02-29", "day", 1900, 2), "безъ даты": (None, "none", None, None), "уволенъ 24.08.1897": ("1897-08-24", "day", 1897, 8), "31.09.1897": (None, "month", 1897, 9),
    }
    got = {r.text: (r.iso, r.precision, r.y, r.m) for r in partial_date(spark.createDataFrame([(t,) for t in want] , "t string"), "t").collect()}
    assert got == want


def test_sums_with_leading_digits(spark, tmp_path):
    from vellum.plans.ledgers import sums_in_text

    rows = [(1, "сборъ 12 р. 50 к. и 1 790 р. 93 к."), (2, "123 456 р. 5 к."), (3, "1905 7 р. 1 к."), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: (r.sums, r.minor) for r in sums_in_text(spark, str(tmp_path)).collect()} == {1: (2, 180343), 2: (1, 12345605)}
