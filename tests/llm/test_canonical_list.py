import random

import pandas as pd

from vellum.llm.canonical_list import _entry_pieces, _value_pieces, map_titles, match_entries, osa, whole_edits

WORKS = [
    ("w1", "Снѣжный часовщикъ", "бал.", "соч. Женмоговъ, 1896"),
    ("w2", "Снѣжный часовщикъ", "ком.", "Дралслоровъ, впервые 1904"),
    ("w3", "Медвяная виноградница", "оп.", None),
    ("w4", "Комета и маркитантка", "др.", "музыка и программа: Бедасскій (1883); also billed as «Le Meunier Enchanté»"),
    ("w5", "Бархатный поединокъ", None, None),
    (None, "Лунный фонарь", None, None),
]
ROWS = [
    (1, "«СНѢЖНЫЙ ЧАСОВЩИКЪ»", "женмогов-1896", "w1"),
    (2, "Снежный часовщик", "Дралслоровъ, 04 г.", "w2"),
    (3, "2-й актъ изъ Медвяная виноградница", None, "w3"),
    (4, "Виноградница медвян.", None, "w3"),
    (5, "Кмета и маркитантка, въ 3 д.", "1883 Бедасскій", "w4"),
    (6, "Le Meunir Enchanté", None, "w4"),
    (7, "Бархатныйпоединокъ", None, "w5"),
    (8, "Снѣжный часовщикъ", "Иваневъ 1901", "none"),
    (9, "Снѣжный ледоколъ", None, "none"),
    (10, None, None, "none"),
    (11, "  ", "Женмоговъ 1896", "none"),
    (12, "?", None, "none"),
    (13, "Бархатный поединокъ " + "лампа " * 3000, None, "none"),
    (1, "«СНѢЖНЫЙ ЧАСОВЩИКЪ»", "женмогов-1896", "w1"),
]
WORK = "work_id string, canonical_title string, canonical_genre string, title_note string"


def test_osa():
    assert (osa("abc", "acb"), osa("abc", "abd"), osa("", "ab"), osa("заколдованный", "заоклодванный")) == (1, 1, 2, 2)


def test_rows(spark):
    typed = spark.createDataFrame([r[:3] for r in ROWS], "same_title_id long, verbatim_title string, work_key string")
    got = {r.same_title_id: r.work_id for r in map_titles(typed, spark.createDataFrame(WORKS, WORK)).collect()}
    assert got == {r[0]: r[3] for r in ROWS}


def test_empty_tables(spark):
    typed = spark.createDataFrame([r[:3] for r in ROWS[:2]], "same_title_id long, verbatim_title string, work_key string")
    works = spark.createDataFrame(WORKS, WORK)
    assert map_titles(typed.limit(0), works).collect() == []
    assert {r.work_id for r in map_titles(typed, works.limit(0)).collect()} == {"none"}


def test_clashing_columns(spark):
    values = spark.createDataFrame([("бархатный поедино", 1, 2.0)], "entry string, token int, score double")
    entries = spark.createDataFrame([("Бархатный поединокъ", 1)], "value string, word int")
    got = match_entries(values, "entry", entries, "value").collect()
    assert [(r.value, r.entry) for r in got] == [("бархатный поедино", "Бархатный поединокъ")]


def test_short_words(spark):
    """Titles of short words are matched exactly; short words rank titles that differ in them."""
    works = spark.createDataFrame([("a", "Ея", None, None), ("b", "Ея жизнь", None, None), ("c", "Жизнь", None, None), ("d", "Я и ты", None, None)], WORK)
    rows = [(1, "Ея", "a"), (2, "ея жизнь", "b"), (3, "Жизнь", "c"), (4, "я и ты", "d"), (5, "Я", "none"), (6, "Юя", "none"), (7, "жизнь ея", "b"), (8, "Его жиизнь", "none")]
    typed = spark.createDataFrame([(i, t, None) for i, t, _ in rows], "same_title_id long, verbatim_title string, work_key string")
    assert {r.same_title_id: r.work_id for r in map_titles(typed, works).collect()} == {i: w for i, _, w in rows}


def test_pieces_lose_nothing():
    """Letters within the edits allowed always share a piece with the entry."""
    rng = random.Random(7)
    for _ in range(3000):
        entry = "".join(rng.choice("абвг") for _ in range(rng.randint(1, 22)))
        value = list(entry)
        for _ in range(whole_edits(len(entry))):
            at = rng.randrange(len(value)) if value else 0
            how = rng.random()
            if how < 0.3 and value:
                del value[at]
            elif how < 0.6:
                value.insert(at, rng.choice("абвг"))
            elif how < 0.8 and value:
                value[at] = rng.choice("абвг")
            elif at + 1 < len(value):
                value[at], value[at + 1] = value[at + 1], value[at]
        typed = "".join(value)
        if osa(typed, entry) <= whole_edits(len(entry)):
            a, b = (f.func(pd.Series([x]))[0] for f, x in ((_value_pieces, typed), (_entry_pieces, entry)))
            assert set(a) & set(b)
