import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.sources import files as S


def test_delimited_keeps_blank_and_null_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,""\n2,\\N\n3,"x ""y"", z"\n')
    rows = {r.k: r.v for r in S.read_delimited(spark, str(tmp_path / "a.csv"), ["k", "v"]).collect()}
    assert rows == {"1": "", "2": None, "3": 'x "y", z'}
    cast = S.with_casts(S.read_delimited(spark, str(tmp_path / "a.csv"), ["k", "v"]), {"k": "int", "v": "int"})
    assert [(r.k, r.v) for r in cast.collect()] == [(1, None), (2, None), (3, None)]


def test_pages_split_into_good_and_bad(spark, tmp_path):
    (tmp_path / "p1.json").write_text('```json\n{"page": "p1", "entries": [{"name": "а\\д"}]}\n```')
    (tmp_path / "p2.json").write_text("{not json")
    schema = T.StructType([T.StructField("page", T.StringType()), T.StructField("entries", T.ArrayType(T.StructType([T.StructField("name", T.StringType())])))])
    good, bad = S.read_pages(spark, str(tmp_path), schema)
    assert [(r.page, r.entries[0].name, r.repairs) for r in good.collect()] == [("p1", "ад", 1)]
    assert bad.count() == 1
    flat = S.flatten(good, "page", "entries", "e").collect()
    assert [(r.e_id, r.name) for r in flat] == [("p1__e001", "ад")]


def test_optional_and_manifest(spark, tmp_path):
    assert S.optional(spark, str(tmp_path / "none"), "a int").collect() == []
    names = spark.createDataFrame([("review_1899-00_SP_v00p0012.png",), ("x",), ("roster_1898-98_Moscow_v00p3",)], "n string")
    got = [(r.kind, r.season, r.city, r.page, r.season_ok) for r in S.manifest(names, "n").collect()]
    assert got[0] == ("review", "1899-00", "SP", 12, True) and not got[1][4] and not got[2][4]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "c", "z")], "page int, o string, line string").withColumn("d", F.lit("1900-02-28").cast("date"))
    assert S.export_sqlite(df, str(tmp_path / "x.db"), "t", ["page", "o", "line", "d"]) == 3
    with pytest.raises(ValueError):
        S.check_columns(df, ["page", "missing"])
    S.export_notes(df, "page", "o", "line", str(tmp_path / "notes"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "notes"), wholetext=True).collect())[0].startswith("# 1\nx\ny")
    S.export_queue(df, str(tmp_path / "q"))
    S.export_json(df, "o", 2, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    assert json.loads(df.select(F.to_json(F.struct("o"))).first()[0])["o"] == "a"


def test_ledger_and_keys(spark, tmp_path):
    path = str(tmp_path / "ledger")
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "k int, v string")
    assert S.append_new(a, path, ["k"]) == 2
    assert S.append_new(spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string"), path, ["k"]) == 1
    assert spark.read.parquet(path).count() == 3
    S.assert_keys(a.distinct(), ["k"], {"v": (a, "v")})
    with pytest.raises(ValueError):
        S.assert_keys(a, ["k"])
    with pytest.raises(ValueError):
        S.assert_keys(a.distinct(), ["k"], {"v": (a.where("v = 'x'"), "v")})
    forms = S.lexicon({"person": (a, "v", "k"), "work": (a, "v", "k")})
    assert forms.count() == 4
