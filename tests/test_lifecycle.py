from pyspark.sql import functions as F

from vellum.functions import names as N
from vellum.operators import lifecycle as C

PAIR = "a string, b string, v string, extra int"


def test_settled_groups(spark):
    rows = [("p1", "p2", "yes", 1), ("p3", "p2", "yes", 1), ("p2", "p1", "yes", 2), ("q1", "q2", "yes", 1), ("q2", "q3", "yes", 1), ("q3", "q1", "apart", 1), ("r1", "r1", "yes", 1), ("s1", None, "yes", 1), ("t1", "t2", "no", 1)]
    since = spark.createDataFrame([("p3", "1890"), ("p3", "1888"), ("p1", "1889"), ("q1", "1880")], "e string, since string")
    got = C.settled_groups(spark.createDataFrame(rows, PAIR), "a", "b", "v", ["yes"], "apart", since, "e", "since")
    assert {tuple(r) for r in got.collect()} == {("p1", "p1", "p3", "merged"), ("p2", "p1", "p3", "merged"), ("p3", "p1", "p3", "merged"), ("q1", "q1", "q1", "held"), ("q2", "q1", "q2", "held"), ("q3", "q1", "q3", "held")}
    assert C.settled_groups(spark.createDataFrame([], PAIR), "a", "b", "v", ["yes"], "apart", since, "e", "since").collect() == []


def test_crosswalk(spark):
    old = spark.createDataFrame([("m1", "A"), ("m2", "A"), ("m3", "B"), ("m4", "C"), ("m5", "D"), ("m5", "D")], "m string, o string")
    new = spark.createDataFrame([("m1", "X"), ("m2", "X"), ("m3", "X"), ("m4", "Y"), ("m5", "Z")], "m string, n string")
    got = {(r.o, r.n): (r.shared, r.kind) for r in C.crosswalk(old, new, "m", "o", "n").collect()}
    assert got == {("A", "X"): (2, "merged"), ("B", "X"): (1, "merged"), ("C", "Y"): (1, "kept"), ("D", "Z"): (1, "kept")}


def test_supplied(spark):
    parents = spark.createDataFrame([("k1", "P1"), ("k2", "P2"), ("k2", "P3"), ("k4", "P4"), ("k1", "P1")], "k string, p string")
    missing = spark.createDataFrame([("k1", 1), ("k1", 2), ("k2", 3), ("k3", 4), ("k4", 5), (None, 6)], "k string, n int")
    children = spark.createDataFrame([("P4",), (None,)], "p string")
    assert sorted(tuple(r) for r in C.supplied(missing, parents, children, ["k"], "p", "n").collect()) == [("P1__supplied1", "P1", 1), ("P1__supplied2", "P1", 2)]


def test_names(spark):
    df = spark.createDataFrame([("L'Étoile — ѣхалъ", "Ивановъ", "1899-12-30", 2, "среду"), ("", "Ландина", "1900-01-30", 29, "вторыя"), (None, None, None, None, None)], "t string, s string, d string, day int, w string")
    got = df.select(
        N.title_key(F.col("t")), N.gender_of_surname(F.col("s")), N.declined(F.col("s")), N.backfilled(F.col("d"), F.col("day")), N.weekday_of_word(F.col("w"))
    ).collect()
    assert tuple(got[0]) == ("letoileѣхал", "m", ["Иванова", "Иванову", "Ивановымъ", "Ивановѣ"], "1900-01-02", 3)
    assert tuple(got[1]) == ("", "f", ["Ландиной", "Ландину", "Ландиною"], "1900-02-29", None)  # a Julian leap year
    assert got[2][0] is None and got[2][3] is None and got[2][4] is None
