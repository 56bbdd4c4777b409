import unicodedata

import pytest
from pyspark.sql import functions as F

from vellum.llm.charforms import ConflictError, Normalizer, Transducer, consistent, consistent_form, normalizer

CASES = {
    "A. Г. Сорплавенкo": "А. Г. Сорплавенко",
    "З． О． Стампулевъ": "З. О. Стампулевъ",
    "Снѣжный карaвaнъ": "Снѣжный караванъ",
    "Ε. Тр‌олтирскій": "Е. Тролтирскій",
    "Ｌｅ Ｍｅｕｎｉｅｒ Ｏｕｂｌｉé": "Le Meunier Oublié",
    "Ольгердъ ＸＩＶ": "Ольгердъ XIV",
    "Ольгердъ XIV": "Ольгердъ XIV",
    "Le Carnaval Égaré, 2-е дѣйствіе": "Le Carnaval Égaré, 2-е дѣйствіе",
    "B. Stourtchagskii": "B. Stourtchagskii",
    "Кронанский": "Кронанский",
    "Н. К. Астуричъ": "Н. К. Астуричъ",
    "λόγος": "λόγος",
    "": "",
}


def test_cases():
    for raw, want in CASES.items():
        assert normalizer()(raw) == unicodedata.normalize("NFC", want)


def test_second_pass_changes_nothing():
    for raw in CASES:
        once = normalizer()(raw)
        assert normalizer()(once) == once


def test_conflicts_are_refused():
    with pytest.raises(ConflictError):
        Transducer([("a", "b"), ("a", "c")])
    with pytest.raises(ConflictError):
        Transducer([("a", "b"), ("b", "c")])
    assert Transducer([("a", "1"), ("ab", "2")])("abaab") == "212"


def test_columns(spark):
    long_ = "Снѣжный карaвaнъ " * 30_000
    df = spark.createDataFrame([(None,), ("",), (long_,), ("x",)], "value string")
    got = [r.v for r in df.select(consistent(F.col("value")).alias("v")).collect()]
    assert got == [None, "", long_.replace("a", "а"), "x"]
    assert Normalizer()(None) is None


def test_clusters_no_rule_names():
    """Letters under several accents are composed, in the script of their word."""
    form = consistent_form
    assert form("Ба́лётъ") == "Ба́лётъ"
    assert form("ệlève") == "ệlève"
    assert form("Те‍а­тръ") == "Театръ"
    for text in ("Ба́лётъ", "q̣̇x", "́", "‍", "é" * 3000):
        assert form(form(text)) == form(text)
