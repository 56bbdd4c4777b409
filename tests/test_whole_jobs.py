"""Queries that must cover whole tables and whole values, on fixtures a cut would fail."""

from vellum.plans import entities, relational, texts


def stored(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_candidate_pairs_of_all_reasons(spark, tmp_path):
    rows = [
        ("a", "b", 0.7, "transliteration", None),
        ("b", "a", 0.9, "same_initials", "pending"),
        ("a", "b", 0.9, "ordinal_variant", "rejected"),
        ("b", "a", 0.6, "surname_levenshtein", "confirmed_tenure"),
        ("c", "d", None, "shared_start_date", "kept_apart"),
        ("d", "c", 0.5, "same_initials", None),
        ("e", "f", None, "same_initials", "confirmed"),
        ("e", "e", 0.9, "transliteration", "confirmed"),
        ("e", None, 0.9, "transliteration", "confirmed"),
    ]
    d = stored(spark, tmp_path, "person_candidate", rows, "person_id_1 string, person_id_2 string, similarity_score double, match_reason string, status string")
    got = sorted(map(tuple, entities.candidate_pairs(spark, d).collect()))
    assert got == [("a", "b", 0.9, "same_initials", True), ("c", "d", 0.5, "same_initials", False), ("e", "f", None, "same_initials", True)]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distance_of_whole_texts(spark, tmp_path):
    said = ["Мазурка, 12 пар.", "Полька, 12 пар.", "полька, 12 паръ.", "", "Ѣ\U0001d11e", None, "x", "домъ"]
    rows = [(f"b{i}", "p", i, t) for i, t in enumerate(said)] + [("c1", "q", 8, "домъ"), ("c0", None, 0, "a"), ("c2", None, 1, "b")]
    d = stored(spark, tmp_path, "review_passage", rows, "block_id string, page_id string, block_index int, text string")
    got = {r.block_id: (r.distance, r.cer) for r in texts.edit_distance_cer(spark, d).collect()}
    want = {}
    for i, (a, b) in enumerate(zip(said, said[1:])):
        if a is not None and b is not None:
            n = levenshtein(a, b)
            want[f"b{i}"] = (n, round(n / len(a), 6) if a else None)
    assert got == want
    assert got["b0"][0] >= 5


def test_enumerated_items_of_all_documents(spark, tmp_path):
    rows = [
        (1, "reader_letter", "Прошу: 1) ноты; партитуру 2) либретто 10) клавиръ"),
        (2, None, "а) первое\nеще строка"),
        (3, "obituary", "см. 4) далѣе; безъ списка\nвторая строка"),
        (4, "archive_request", "1) a; b\n2) c"),
        (5, "archive_request", "(см. 4) и x(5) нѣтъ"),
        (6, "editorial_note", "  1) a 2) b"),
        (7, "editorial_note", " \n"),
        (8, "editorial_note", None),
        (9, "editorial_note", "вводъ b) одна c)"),
        (10, "editorial_note", "123) a 1)x 2) y"),
        (11, "editorial_note", " 1) одно"),
    ]
    d = stored(spark, tmp_path, "documents", rows, "doc_id long, source string, text string")
    got = {}
    for r in texts.segment_items(spark, d).orderBy("doc_id", "k").collect():
        got.setdefault(r.doc_id, []).append((r.k, r.enumerator, r.piece))
    assert got == {
        1: [(1, None, "Прошу:"), (2, "1)", "ноты; партитуру"), (3, "2)", "либретто"), (4, "10)", "клавиръ")],
        2: [(1, "а)", "первое\nеще строка")],
        3: [(1, None, "см. 4) далѣе; безъ списка\nвторая строка")],
        4: [(1, "1)", "a; b"), (2, "2)", "c")],
        5: [(1, None, "(см. 4) и x(5) нѣтъ")],
        6: [(1, "1)", "a"), (2, "2)", "b")],
        9: [(1, None, "вводъ b) одна c)")],
        10: [(1, None, "123) a 1)x 2) y")],
        11: [(1, None, "1) одно")],
    }


def test_medoids_of_all_blocks(spark, tmp_path):
    a, b, c = "Касса открыта съ утра", "Касса открыта съ утра!", "Касса открыта съ утpа!!"
    rows = [
        ("b1", "p", "paragraph", a),
        ("b2", "p", "footnote", b),
        ("b3", "p", "list_item", a),
        ("b4", "p", "heading", c),  # b2 sums to 2.887, b1 to 2.886, the least pair is 0.909
        ("b5", "p", "paragraph", "Мазурка"),
        ("b6", "p", "plate", None),
        ("b7", "q", "heading", "Балетъ"),
        ("b8", "q", "heading", "Балетъ"),
        ("b9", None, "paragraph", a),
        ("c1", "r", "paragraph", ""),
        # equal twice outweighs a text between two others
        ("d1", "s", "paragraph", "abcdefgh"),
        ("d2", "s", "paragraph", "abcdefxx"),
        ("d3", "s", "paragraph", "abcdefxx"),
    ]
    d = stored(spark, tmp_path, "review_passage", rows, "block_id string, page_id string, block_type string, text string")
    got = sorted((r.page_id or "", r.medoid, r.readings, r.band) for r in texts.medoid_banding(spark, d).collect())
    assert got == [("", "b9", 1, "single"), ("p", "b2", 4, "high"), ("p", "b5", 1, "single"), ("q", "b7", 2, "identical"), ("r", "c1", 1, "single"), ("s", "d2", 3, "medium")]


def test_medoids_against_every_pair(spark, tmp_path):
    import difflib
    import itertools
    import random

    rng = random.Random(5)
    base = ["касса открыта", "мазурка и полька", "балетъ въ четырехъ"]
    rows = []
    for i in range(40):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = rng.choice("абв")
        rows.append((f"b{i:02}", f"p{i % 4}", "".join(t)))
    d = stored(spark, tmp_path, "review_passage", rows, "block_id string, page_id string, text string")
    got = sorted((r.page_id, r.readings, r.medoid, r.band) for r in texts.medoid_banding(spark, d).collect())
    s = {}
    for page in {r[1] for r in rows}:
        for x, y in itertools.combinations(sorted(r for r in rows if r[1] == page), 2):
            s[x[0], y[0]] = s[y[0], x[0]] = difflib.SequenceMatcher(None, x[2], y[2], autojunk=False).ratio()
    left, want = {r[0]: r for r in rows}, []
    while left:
        group, todo = set(), [min(left)]
        while todo:
            k = todo.pop()
            group.add(k)
            left.pop(k, None)
            todo += [o for o in left if s.get((k, o), 0) >= 0.6 and o not in todo]
        total = {k: round(sum(s[k, o] for o in group if o != k), 9) for k in group}
        low = min((s[p] for p in itertools.combinations(sorted(group), 2)), default=None)
        band = "single" if low is None else "identical" if low >= 0.999 else "high" if low >= 0.9 else "medium" if low >= 0.6 else "low"
        want.append((rows[int(min(group)[1:])][1], len(group), min(group, key=lambda k: (-total[k], k)), band))
    assert got == sorted(want)


def test_bands_of_all_documents(spark, tmp_path):
    rows = [(1, "obituary", "a b c d e f g h"), (2, "reader_letter", "одинъ два три"), (3, None, "x"), (4, "catalogue_card", ""), (5, "obituary", None)]
    d = stored(spark, tmp_path, "documents", rows, "doc_id long, source string, text string")
    got = {r.doc_id: r.stitched for r in texts.band_stitch(spark, d).collect()}
    assert got == {1: "a b c d e f g h", 2: "одинъ два три", 3: "x", 4: ""}


def folded(word):
    import re

    return re.sub(r"([^\W\d_])\1", r"\1", word.lower().translate(str.maketrans("ѣіѳѵё", "еифие", "ъь")))


def test_variants_by_fold_of_all_words(spark, tmp_path):
    import re
    from collections import Counter, defaultdict

    said = ["послѣ " * 10 + "после ", "Михаилъ " * 6 + "михаил ѳоминична", "фоминична " * 5 + "балеты", "балетъ " * 9 + "балетомъ", "классъ " * 5 + "класъ", "миръ міръ " * 5, "я " * 4, None, ""]
    d = stored(spark, tmp_path, "documents", [(i, t) for i, t in enumerate(said)], "doc_id long, text string")
    count = Counter(w for t in said if t for w in re.findall("[a-zа-яѣіѳѵё]+", t.lower()))
    groups = defaultdict(dict)
    for w, n in count.items():
        groups[folded(w)][w] = n
    want = {(w, f, n, max(g.values())) for f, g in groups.items() for w, n in g.items() if n < max(g.values()) >= 5 * n and sum(g.values()) >= 5}
    got = [tuple(r) for r in texts.name_variants(spark, d).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {w for w, *_ in want} == {"после", "михаил", "ѳоминична", "класъ"}


def test_families_counted_after_the_fold(spark, tmp_path):
    rows = [(n,) for n in ["Ѳедоровъ", "Федоров", "Виллъ", "Вилъ", "Мартьянова", "Мартьянова", None]]
    d = stored(spark, tmp_path, "review_person", rows, "canonical_family_name string")
    assert [tuple(r) for r in texts.folded_families(spark, d).collect()] == [("all", 5, 3)]


def test_claims_over_all_prices(spark, tmp_path):
    import datetime
    import random

    rng, may = random.Random(3), datetime.datetime(1997, 5, 3)
    rows = [
        (1, may, "1-URGENT", "O", 19999.0),
        (2, may, "1-URGENT", "F", 20001.0),
        (3, may, "1-URGENT", "F", 15000.0),
        (4, may, "2-HIGH", "O", 1000.0),
        (5, may, "2-HIGH", "F", 19000.0),
        (6, may, "3-MEDIUM", "O", 50000.0),
        (7, may, "3-MEDIUM", "F", 80000.0),
        (8, may, "5-LOW", "O", 0.0),
        (9, may, "5-LOW", "F", 0.0),
    ]
    rows += [(100 + i, datetime.datetime(1998, 1 + i % 2, 9), "2-HIGH", "OF"[rng.randint(0, 1)], round(rng.uniform(900, 150000), 2)) for i in range(120)]
    d = stored(spark, tmp_path, "orders", rows, "o_orderkey long, o_orderdate timestamp_ntz, o_orderpriority string, o_orderstatus string, o_totalprice double")
    got = {(r.l, r.r): r.score for r in relational.greedy_claim(spark, d).collect()}
    assert got[1, 2] == 0.9999 and got[6, 7] == 0.625
    assert not {4, 8} & {left for left, _ in got}
    pairs = []
    for a in rows:
        for b in rows:
            if a[3] == "O" and b[3] == "F" and (a[1].month, a[1].year, a[2]) == (b[1].month, b[1].year, b[2]) and min(a[4], b[4]) > 0:
                score = round(1 - abs(a[4] - b[4]) / max(a[4], b[4]), 6)
                if score >= 0.6:
                    pairs.append((-score, a[0], b[0]))
    want, used = {}, set()
    for score, left, right in sorted(pairs):
        if not {left, right} & used:
            used |= {left, right}
            want[left, right] = -score
    assert got == want


def test_claims_make_no_pairs(spark, tmp_path):
    import datetime

    # 225 million pairs of one price, which no task could hold, beside a group of three
    may, n = datetime.datetime(1997, 5, 3), 15000
    rows = [((i * 7919) % (2 * n), may, "1-URGENT", "OF"[i % 2], 500.0) for i in range(2 * n)]
    rows += [(2 * n, may, "2-HIGH", "O", 100.0), (2 * n + 1, may, "2-HIGH", "F", 100.00005), (2 * n + 2, may, "2-HIGH", "F", 60.0), (2 * n + 3, may, "2-HIGH", "P", 100.0)]
    d = stored(spark, tmp_path, "orders", rows, "o_orderkey long, o_orderdate timestamp_ntz, o_orderpriority string, o_orderstatus string, o_totalprice double")
    claimed = relational.greedy_claim(spark, d)
    assert "Join" not in claimed._jdf.queryExecution().toString()
    left, right = (sorted(r[0] for r in rows[: 2 * n] if r[3] == s) for s in "OF")
    want = [("1997-05|1-URGENT", a, b, 1.0) for a, b in zip(left, right, strict=True)] + [("1997-05|2-HIGH", 2 * n, 2 * n + 1, 1.0)]
    assert sorted(map(tuple, claimed.collect())) == sorted(want)


def test_closest_claims_equal_those_of_all_pairs(spark):
    import random

    from pyspark.sql import functions as F

    from vellum.operators import matching as M

    rng, prices = random.Random(11), [100.0, 100.00005, 100.0001, 99.9999, 61.0, 60.0, 59.99, 150.0]
    rows = []
    for g in range(60):  # ties of value, of rounded score and of key; some without a group or a value
        odd = [float("nan"), float("inf")] if g % 3 == 0 else []
        for i in range(rng.randint(1, 14)):
            value = rng.choice([*prices, *odd, None]) if g % 2 else round(rng.uniform(1000, 1000.02), 4)
            rows.append((f"g{g}" if g else None, rng.randint(0, 9) if g % 5 == 0 else i * 37 % 101, value, rng.random() < 0.5))
    df = spark.createDataFrame(rows, "g string, k long, v double, s boolean")
    left, right = (df.where(t).select("g", F.col("k").alias(k), F.col("v").alias(v)) for t, k, v in (("NOT s", "l", "a"), ("s", "r", "b")))
    pairs = left.join(right, "g").withColumn("score", M.closeness(F.col("a"), F.col("b"))).where("score >= 0.6")
    want = M.greedy_claim(pairs, "g", "l", "r", "score")
    got = M.claim_closest(df, "g", "k", "v", F.col("s"), 0.6)
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 100
    # rows without a key are one each, and come after the others
    df = spark.createDataFrame([("g", None, 5.0, False), ("g", None, 5.0, False), ("g", 1, 5.0, False), ("g", 2**60 + 1, 5.0, True), ("g", None, 5.0, True)], "g string, k long, v double, s boolean")
    assert sorted(map(str, M.claim_closest(df, "g", "k", "v", F.col("s"), 0.6).select("l", "r").collect())) == ["Row(l=1, r=1152921504606846977)", "Row(l=None, r=None)"]
