from vellum.llm.name_links import attribute_names, spelling_pairs
from vellum.llm.name_parts import parse

NAMES = (
    ["И. Д. Чатирацкій"] * 6
    + ["Чатирацкій, Иванъ Дмитріевичъ"] * 3
    + ["М. Г. Чатирацкій"] * 5
    + ["Чатирацкій, Михаилъ Георгіевичъ", "Миша Чатирацкій", "М. Чатирацкій", "И. Д. Чатирацккій", "И. Д. Чатирацкій", "I. Tchatiratskii", "И. Чатирацк.", "ЧАТИРАЦКІЙ И. Д."]
    + ["Глимрадева, Софья Никитична", "С. Н. Глимрадева", "С. Н. Глимрадевъ", "Глимрадева 1-я, Софья", "Глимрадева 1-я", "Глимрадева 2-я"]
    + [None, "", "—"]
)


def groups(spark, names):
    rows = attribute_names(spark.createDataFrame([(n,) for n in names], "name string"), "name").collect()
    out = {}
    for r in rows:
        out.setdefault(r.person, set()).add(r.value)
    return sorted(map(sorted, out.values()))


def test_parts():
    assert parse("Звулрусейнъ 1-й, Романъ")[:2] == ("zvoulrousein", False)
    assert parse("Г. Бреллеренко").first == "g" and parse("г. Бреллеренко").first == ""
    assert parse("S. Gamkrateva").surname == "gamkrateva"
    assert parse("—") is None and parse(None) is None


def test_groups(spark):
    got = groups(spark, NAMES)
    ivan = {"И. Д. Чатирацкій", "Чатирацкій, Иванъ Дмитріевичъ", "И. Д. Чатирацккій", "И. Д. Чатирацкій", "I. Tchatiratskii", "И. Чатирацк.", "ЧАТИРАЦКІЙ И. Д."}
    assert sorted(ivan) in got
    assert sorted({"М. Г. Чатирацкій", "Чатирацкій, Михаилъ Георгіевичъ", "Миша Чатирацкій", "М. Чатирацкій"}) in got
    assert sorted({"Глимрадева, Софья Никитична", "С. Н. Глимрадева", "Глимрадева 1-я, Софья", "Глимрадева 1-я"}) in got
    assert ["С. Н. Глимрадевъ"] in got and ["Глимрадева 2-я"] in got


def test_pairs_are_ordered_and_once(spark):
    df = spark.createDataFrame([("p", "b"), ("p", "a"), ("p", "ѣ"), ("q", "c")], "person string, value string")
    assert sorted(map(tuple, spelling_pairs(df).collect())) == [("a", "b"), ("a", "ѣ"), ("b", "ѣ")]


def test_empty_and_clashing(spark):
    assert groups(spark, [None, ""]) == []
    df = spark.createDataFrame([("И. Д. Чатирацкій", 1, "x")], "value string, n int, person string")
    assert attribute_names(df, "value").count() == 1


def test_a_slip_without_the_second_initial(spark):
    """A rare misspelling with one initial goes to the person it is a slip of."""
    names = ["Желглигскій, Юлій Ивановичъ", "Ю. И. Желглигскій", "Ю. Желглигскій", "Желглигцкій, Ю.", "Желглигская, Анна Петровна", "А. П. Желглигская"]
    got = {r.value: r.person for r in attribute_names(spark.createDataFrame([(n,) for n in names], "name string"), "name").collect()}
    assert len({got[n] for n in names[:4]}) == 1 and got[names[4]] == got[names[5]] != got[names[0]]
