from vellum.operators.mentions import text_mentions

TEXTS = [
    (1, "Балетъ «Снѣжный  караванъ» исполнила г-жа А. Ландина, а Петровъ хвалилъ Петрова. Петровичъ", "x"),
    (2, "«Письмо Ландиной» читано. Ландиною довольны, г. Петровымъ тоже", "x"),
    (3, None, "x"),
    (4, "  ", "x"),
    (1, "Балетъ «Снѣжный  караванъ» исполнила г-жа А. Ландина, а Петровъ хвалилъ Петрова. Петровичъ", "x"),
    (5, "слово " * 20_000 + "Петровъ", "x"),
    (6, "«Опера Ландина» дана", "x"),
]


def tables(spark):
    docs = spark.createDataFrame(TEXTS, "id long, body string, kind string")
    works = spark.createDataFrame([("w1", "Снѣжный караванъ"), ("w2", "Опера Ландина"), ("w9", None)], "w string, t string")
    people = spark.createDataFrame([("p1", "Ландина"), ("p2", "Петровъ"), ("p3", "Петровъ"), (None, None)], "p string, f string")
    return docs, works, people


def test_passes_claims_and_fallbacks(spark):
    docs, works, people = tables(spark)
    text = {i: t for i, t, _ in TEXTS}
    got = {}
    for r in text_mentions(docs, "id", "body", works, "t", "w", people, "f", "p").collect():
        assert text[r.id][r.char_start : r.char_end] == r.surface
        got.setdefault(r.id, []).append((r.char_start, r.kind, r.surface, r.entity, r.method, r.confidence))
    cut = {i: [x[1:] for x in sorted(v)] for i, v in got.items()}
    assert cut == {
        1: [("work", "Снѣжный  караванъ", "w1", "exact", "high"), ("person", "Ландина", "p1", "exact", "high"), ("person", "Петровъ", "p2", "exact", "medium"), ("person", "Петрова", "p2", "declined", "low")],
        2: [("person", "Ландиной", "p1", "declined", "low"), ("person", "Ландиною", "p1", "declined", "low"), ("person", "Петровымъ", "p2", "declined", "high")],
        5: [("person", "Петровъ", "p2", "exact", "medium")],
        6: [("work", "Опера Ландина", "w2", "exact", "high")],  # the title claims the name in it
    }


def test_empty_tables(spark):
    docs, works, people = tables(spark)
    assert text_mentions(docs.limit(0), "id", "body", works, "t", "w", people, "f", "p").collect() == []
    assert text_mentions(docs, "id", "body", works.limit(0), "t", "w", people.limit(0), "f", "p").collect() == []
