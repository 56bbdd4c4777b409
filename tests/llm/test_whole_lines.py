"""Statistics that cover whole lines and chains of any length."""

from vellum.llm import scan_repair
from vellum.llm.name_links import attribute_names


def test_head_pairs_of_whole_lines(spark):
    long = "слово " * 60
    paired = "Обозрѣніе сезона"
    # the head stands in mid-sentence, but its words stand often beyond the fortieth of a line too
    pages = [f"актеры играли и пѣли\n{paired}\nвесьма хорошо." for _ in range(12)]
    lines = [long + paired + " вышло въ свѣтъ." for _ in range(12)]
    read = lambda texts: spark.createDataFrame([(t, False) for t in texts], "t string, h boolean").select(scan_repair._first_reading("t", "h").alias("r")).select("r.*")
    heads = lambda texts: [r.head for r in scan_repair.learned_heads(read(texts)).collect()]
    assert heads(pages) == [paired]
    assert heads(pages + lines) == []


def test_slips_of_slips_to_the_end(spark):
    # each one edit from the next, thirteen times as frequent: the first is five hops from the last
    surnames = ["Бабинъ", "Бадинъ", "Бадонъ", "Гадонъ", "Гадовъ", "Радовъ"]
    rows = spark.createDataFrame([(f"{s}, Иванъ Петровичъ", 13**k) for k, s in enumerate(surnames)], "value string, n int")
    got = attribute_names(rows.selectExpr("value", "explode(sequence(1, n))"), "value").collect()
    assert len(got) == len(surnames) and len({r.person for r in got}) == 1
