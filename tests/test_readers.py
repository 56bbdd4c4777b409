import random

from vellum.operators.readers import alike, compared_readings, difference, merged_words

ROWS = "p string, i string, t string, extra int"


def test_kinds_of_difference():
    cases = {("а б", "а б"): "SAME", ("мiръ", "міръ"): "HOMOGLYPH", ("а б.", "аб"): "SPACING", ("въ 1890", "въ 1891"): "NUMBER", ("Домъ", "домъ"): "CASE", ("домъ", "дымъ"): "CHARS"}
    assert {k: difference(*k) for k in cases} == cases


def test_merged_words_keep_both_readings():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        left, right, open_ = [], [], False
        merged = merged_words(" ".join(a), " ".join(b)).replace("[", "[ ").replace("|", " | ").replace("]", " ]").split()
        side = None
        for w in merged:
            if w in "[|]":
                side = {"[": left, "|": right, "]": None}[w]
            elif side is None:
                left.append(w)
                right.append(w)
            else:
                side.append(w)
        assert (left, right, open_) == (a, b, False)


def test_pairs_against_brute_force(spark):
    rng = random.Random(8)
    line = lambda: " ".join(rng.choice(["балетъ", "опера", "новый", "занавѣсь", "актъ"]) for _ in range(4))
    base = [line() for _ in range(12)]
    bend = lambda s: s[: rng.randrange(len(s))] + rng.choice("ъі") + s[rng.randrange(len(s)) :]
    a = [(f"p{k % 3}", f"a{k:02}", s, 1) for k, s in enumerate(base)] + [("p0", "a90", None, 1), ("p9", "a91", "одна", 1)]
    b = [(f"p{k % 3}", f"b{k:02}", bend(s), 2) for k, s in enumerate(base)] + [("p8", "b91", "одинъ", 1)]
    got = {(r.stored_id, r.read_id) for r in compared_readings(spark.createDataFrame(a, ROWS), spark.createDataFrame(b, ROWS), "p", "i", "t").collect()}
    want, used = set(), set()
    tried = sorted((-alike(x[2], y[2]), x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] and alike(x[2], y[2]) >= 0.72)
    for _, x, y in tried:
        if not {x, y} & used:
            used |= {x, y}
            want.add((x, y))
    want |= {(x[1], None) for x in a if x[2] and x[1] not in used} | {(None, y[1]) for y in b if y[1] not in used}
    assert got == want
    assert compared_readings(spark.createDataFrame([], ROWS), spark.createDataFrame([], ROWS), "p", "i", "t").collect() == []
