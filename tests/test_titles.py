from vellum.operators.titles import LEAST, ratio, tiered_titles, window_ratio

ROWS = "city string, day string, id int, title string, note string"


def test_tiers(spark):
    left = [
        ("SP", "d1", 1, "Лунный фонарь", ""), ("SP", "d1", 2, "лунный фонарь.", ""), ("SP", "d1", 3, "2-й актъ изъ Лунный фонарь", ""), ("SP", "d1", 4, "Лунный фонарь, балетъ", ""),
        ("SP", "d1", 5, "Лунный фанарикъ", ""), ("SP", "d1", 6, "вечеромъ Лунной фонарь былъ данъ", ""), ("SP", "d1", 7, "Опера", ""), ("SP", "d2", 8, "Лунный фонарь", ""), ("SP", "d1", 9, None, ""), ("SP", "d1", 1, "Лунный фонарь", ""), (None, "d1", 10, "Лунный фонарь", ""), ("SP", "d1", 11, "…", ""),
    ]
    right = [("SP", "d1", 50, "Лунный фонарь", ""), ("SP", "d1", 51, "Лунный фонарь", ""), ("SP", "d1", 52, "", ""), ("Moscow", "d1", 53, "Опера", ""), ("SP", "d1", 54, None, "")]
    got = {r.id: (r.match, r.tier) for r in tiered_titles(spark.createDataFrame(left, ROWS), spark.createDataFrame(right, ROWS), ["city", "day"], "id", "id", "title").collect()}
    assert got == {1: (50, "exact_printed"), 2: (50, "exact"), 3: (50, "excerpt"), 4: (50, "prefix"), 5: (50, "fuzzy"), 6: (50, "window"), 7: (None, "none"), 8: (None, "none"), 9: (None, "none"), 10: (None, "none"), 11: (None, "none")}
    assert tiered_titles(spark.createDataFrame([], ROWS), spark.createDataFrame(right, ROWS), ["city", "day"], "id", "id", "title").collect() == []


def test_likeness():
    assert ratio("абвг", "абвг") == 1.0 and window_ratio("бв", "абвг") == 1.0 and window_ratio("абвг", "бв") == 1.0
    assert ratio("лунныйфонарь", "лунныйфонарик") >= LEAST > ratio("опера", "балет")
