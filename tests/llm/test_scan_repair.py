import pytest
from pyspark.sql import functions as F

from vellum.llm.scan_repair import _slips, confusion_cost, find_noise, noise_kinds, repaired, surely

PLAIN = "Къ сожалѣнію, крестьянская пляска потеряла въ живости, и баллада-пантомима была повторена дважды. Новая занавѣсь заслуживаетъ полнаго одобренія."
FIELDS = "block_id string, value string, heading boolean, page int"


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"c{i}", PLAIN, False, 1) for i in range(30)]
    rows += [
        ("hyphen", "Къ сожалѣнію, крестьянс-\nкая пляска", False, 1),
        ("own", "и баллада-\nпантомима была", False, 1),
        ("own2", "и баллада=\nпантомима была", False, 1),
        ("soft", "по\xad\nтеряла въ живости", False, 1),
        ("page", "пляска потеряла\n— 66 —\nвъ живости", False, 1),
        ("roman", "пляска потеряла\nCXLII\nвъ живости", False, 1),
        ("number", "Къ сожалѣнію, на страницѣ\n233 потеряла", False, 1),
        ("head", "пляска потеряла\nОТЧЕТЪ ЗА СЕЗОНЪ 1904—05 г.\nвъ живости", False, 1),
        ("spaced", "пляска потеряла\nО б о з р ѣ н і е. 12\nвъ живости", False, 1),
        ("digit", "крестьянская пляск8 потеряла", False, 1),
        ("pair", "Новая занавѣсь заслуживаетъ полнаго одобрепія", False, 1),
        ("two", "ра3\nвъ живости и пов-\n[12]\nторена", False, 1),
        ("heading", "ОПЕРА.", True, 1),
        ("year", "1897", True, 1),
        ("empty", "", False, 1),
        ("null", None, False, 1),
        ("long", (PLAIN + " ") * 500, False, 1),
        ("c0", PLAIN, False, 1),
    ]
    for i in range(4):
        rows.append((f"mixed{i}", "Новая занавѣсь\nОпера и балетъ\nзаслуживаетъ полнаго", False, 1))
    return find_noise(spark.createDataFrame(rows, FIELDS), ["block_id"], "value", "heading")


def test_costs():
    assert confusion_cost("картина", "картипа") == 1.0
    assert confusion_cost("дважды", "дваждьі") == 0.4
    assert confusion_cost("картина", "картинахъ") == float("inf")
    assert confusion_cost("обозрѣніе", "060зрѣніе") == pytest.approx(0.9)  # three slips
    assert confusion_cost("желаніе", "я;елапіе") == pytest.approx(1.3)


def test_sure_letters():
    assert surely("06озрЬніе") == "обозрѣніе"
    assert surely("ОБ03РѢНІЕ") == "ОБОЗРѢНІЕ"
    assert surely("слуя;ба") == "служба" and surely("слово") == "слово"


def test_context_picks_the_repair(spark):
    """One misreading of two words is repaired by the word before."""
    rows = [("глубокая", "нора", 20), ("поймали", "вора", 20), ("глубокая", "пора", 1), ("поймали", "пора", 1), ("въ", "з0л0т0", 1)]
    pairs = spark.createDataFrame(rows, "before string, w string, k long")
    got = {(r.before, r.w): r.right for r in _slips(pairs, pairs.groupBy("w").agg(F.sum("k").alias("n"))).collect()}
    assert got == {("глубокая", "пора"): "нора", ("поймали", "пора"): "вора", ("въ", "з0л0т0"): "золото"}


def test_long_lines_and_long_heads(spark):
    """A head of any length is learned; words far behind in a line count."""
    head = "Опера и балетъ " + "въ театрахъ столицы и провинціи " * 4 + "за годъ"
    rows = [(f"m{i}", f"Новая занавѣсь\n{head}\nзаслуживаетъ полнаго", False, 1) for i in range(4)]
    rows.append(("far", "слово " * 60 + "Новая занавѣсь", False, 1))
    got = noise_kinds(find_noise(spark.createDataFrame(rows, FIELDS), ["block_id"], "value", "heading")).collect()
    assert {(r.block_id, r.noise) for r in got} == {(f"m{i}", "running_head") for i in range(4)}


def test_kinds(found):
    got = {}
    for r in noise_kinds(found).collect():
        got.setdefault(r.block_id, set()).add(r.noise)
    assert got == {
        "hyphen": {"hyphen_break"},
        "soft": {"hyphen_break"},
        "page": {"page_number"},
        "roman": {"page_number"},
        "head": {"running_head"},
        "spaced": {"running_head", "page_number"},
        "digit": {"misread"},
        "pair": {"misread"},
        "two": {"misread", "hyphen_break", "page_number"},
        **{f"mixed{i}": {"running_head"} for i in range(4)},
    }


def test_repaired(found):
    text = {r.block_id: r.repaired for r in repaired(found).collect()}
    assert text["hyphen"] == "Къ сожалѣнію, крестьянская пляска"
    assert text["own"] == text["own2"] == "и баллада-пантомима была"
    assert text["head"] == text["page"] == "пляска потеряла въ живости"
    assert text["pair"].endswith("одобренія") and text["digit"] == "крестьянская пляска потеряла"
    assert text["heading"] == "ОПЕРА." and text["c0"] == PLAIN and text["empty"] == "" and "null" not in text


def test_empty_table(spark):
    r = find_noise(spark.createDataFrame([], FIELDS), ["block_id"], "value", "heading")
    assert noise_kinds(r).collect() == []
