"""Mapping typed values to the entries of a canonical list.

Token-level repair: every distinct typed token is joined to the vocabulary of the
list by edit distance (candidates meet on symmetric deletions, an equi-join; the
distance is then computed for these only). Abbreviated tokens meet prefixes, glued
ones are cut in two. The repaired tokens of a value then rank whole entries by soft
TF-IDF: a value meets the entries whose rarest word it holds, as an entry stands only
if each of its words found its counterpart. Words of one or two letters are compared
exactly; they weigh in the ranking, and decide where a title has no others. Values
that match no entry by tokens, as when a blank moved, meet entries on pieces of their
letters that few edits must leave whole.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.charforms import consistent
from vellum.operators.sizing import lookup
from vellum.session import materialize, settled

#: Words around a title that aren't part of it, in folded spelling.
CARRIER_WORDS = [
    "балет", "бал", "опера", "оп", "драма", "др", "комедия", "ком", "дивертисм", "дивертисмент", "феерия", "сцена", "сцены",
    "актъ", "акт", "действие", "картина", "карт", "отрывок", "из", "въ", "первый", "раз", "новая", "пост", "постановка", "разъ", "изъ",
]
#: Tokens from this length on may hold slips, and must find their counterpart; shorter
#: ones are compared exactly and must only where a title has no longer ones.
SHORTEST = 3
#: Soft TF-IDF that an entry must reach at least, over the tokens that must be found.
LEAST_SCORE = 0.75
#: A token typed this often, and at least this share as often as a word of the list
#: near it, is a word of its own and no slip.
OWN_COUNT, OWN_SHARE = 3, 0.1
#: Edits by which a value may differ from an entry when a slip moved or lost a blank
#: (letters only, in order), and the share of its letters they may be.
WHOLE_EDITS, WHOLE_SHARE = 3, 0.2


def fold(text: Column) -> Column:
    """Characters in their consistent form, lower case, reformed spelling, no accents."""
    low = F.lower(consistent(text))
    plain = F.translate(low, "ѣіѳѵёéèêëàâçôîïûùüöä", "еифиеeeeeaacoiiuuuoa")
    return F.regexp_replace(plain, r"ъ(?=\P{L}|$)", "")


def tokens(folded: Column) -> Column:
    """Words with a following abbreviation point."""
    return F.regexp_extract_all(folded, F.lit(r"(\p{L}+\.?)"), F.lit(1))


def bare_token(token: Column) -> Column:
    return F.rtrim(token, F.lit("."))


def required(token: Column, all_tokens: Column) -> Column:
    """Whether the token must find its counterpart."""
    long = lambda w: F.length(bare_token(w)) >= SHORTEST
    return long(token) | ~F.exists(all_tokens, long)


@lru_cache(maxsize=200_000)
def osa(a: str, b: str) -> int:
    """Edit distance in which swapping two neighbours is one edit."""
    if a == b:
        return 0
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], two[j - 2] + 1)
        two, one = one, row
    return one[-1]


@F.pandas_udf(T.IntegerType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([osa(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="Int32")


@F.pandas_udf(T.ArrayType(T.StringType()))
def deletions(words: pd.Series, depth: pd.Series) -> pd.Series:
    """The word and all it becomes by up to ``depth`` deletions."""

    def of(word: str, n: int) -> list[str]:
        level = found = {word}
        for _ in range(int(n)):
            level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
            found = found | level
        return list(found)

    return pd.Series([of(w, n) if w is not None else None for w, n in zip(words, depth)])


def allowed(length: Column) -> Column:
    """Edits a token of that length may hold."""
    return F.when(length < 5, 1).otherwise(2)


def repair_tokens(typed: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, word, sim) for distinct ``typed.token`` and ``vocabulary.word``, where
    ``vocabulary.carrier`` marks words around titles.

    A token that is itself in the vocabulary isn't repaired. A token with a point may
    stand for a word it begins; a token close to nothing is cut in two where both
    halves are words (then it gives two rows).
    """
    bare = bare_token(F.col("token"))
    base = typed.select("token", bare.alias("bare"), F.col("token").endswith(".").alias("cut")).distinct()
    base = materialize(base)
    whole = vocabulary.where((F.length("word") >= SHORTEST) | F.col("carrier")).select("word", F.col("word").alias("surface"), F.lit(False).alias("short"))
    starts = vocabulary.where(F.length("word") > SHORTEST + 1).select(
        "word", F.explode(F.transform(F.sequence(F.lit(SHORTEST), F.length("word") - 1), lambda n: F.left("word", n))).alias("surface")
    )
    surfaces = materialize(whole.unionByName(starts.withColumn("short", F.lit(True))))
    listed = vocabulary.select("word")
    exact = base.join(lookup(listed), base.bare == listed.word).select("token", "word", F.lit(1.0).alias("sim"), F.lit(False).alias("half"))
    rest = base.join(listed.withColumnRenamed("word", "bare"), "bare", "left_anti").where(F.length("bare") >= SHORTEST)
    near = _near(rest, surfaces)
    alone = rest.join(near.select("token").distinct(), "token", "left_anti").where(F.length("bare") >= 2 * SHORTEST)
    cuts = alone.select("token", "bare", F.explode(F.sequence(F.lit(SHORTEST), F.length("bare") - SHORTEST)).alias("at"))
    halves = cuts.select(
        "token", "at", F.posexplode(F.array(F.left("bare", F.col("at")), F.expr("substr(bare, at + 1)"))).alias("side", "part")
    )
    halves = materialize(halves)
    parts = halves.select(F.col("part").alias("token"), F.col("part").alias("bare"), F.lit(False).alias("cut")).distinct()
    known = _near(parts, surfaces.where("not short"), most=1).select(F.col("token").alias("part"), "word", "sim")
    both = halves.join(known, "part").withColumn("sides", F.size(F.collect_set("side").over(Window.partitionBy("token", "at"))))
    # both halves, or one whole word of which the other half is then judged by its letters
    glued = both.where("sides = 2 or sim = 1").select("token", "word", (F.col("sim") * 0.95).alias("sim"), F.lit(True).alias("half"))
    found = exact.unionByName(near.withColumn("half", F.lit(False))).unionByName(glued)
    return found.groupBy("token", "word").agg(F.max("sim").alias("sim"), F.max("half").alias("half"))


def _letters(folded: Column, carrying: Column) -> Column:
    """The letters of a folded value in order, without its carrying words."""
    return F.array_join(F.transform(F.filter(tokens(folded), lambda w: ~F.array_contains(carrying, w)), bare_token), "")


def whole_edits(length: int) -> int:
    """Edits that letters of an entry of that length may hold."""
    return min(WHOLE_EDITS, int(length * WHOLE_SHARE))


def pieces(length: int) -> list[tuple[int, int]]:
    """(start, end) of pieces of an entry of that length, one more than the edits it
    may hold, with a letter between them: an edit, even a swap of neighbours, reaches
    into one piece only, so at least one is left whole."""
    n = whole_edits(length) + 1
    room = length - (n - 1)
    out, at = [], 0
    for i in range(n):
        size = room * (i + 1) // n - room * i // n
        out.append((at, at + size))
        at += size + 1
    return out


_STRINGS = T.ArrayType(T.StringType())


@F.pandas_udf(_STRINGS)
def _entry_pieces(letters: pd.Series) -> pd.Series:
    return letters.map(lambda s: [f"{len(s)}/{i}/{s[a:b]}" for i, (a, b) in enumerate(pieces(len(s)))], na_action="ignore")


@F.pandas_udf(_STRINGS)
def _value_pieces(letters: pd.Series) -> pd.Series:
    """Keys of all entries' pieces that a value could hold."""

    def of(s: str) -> list[str]:
        keys = set()
        for length in range(max(1, len(s) - WHOLE_EDITS), len(s) + WHOLE_EDITS + 1):
            most = whole_edits(length)
            if abs(length - len(s)) > most:
                continue
            for i, (a, b) in enumerate(pieces(length)):
                keys |= {f"{length}/{i}/{s[a + d : b + d]}" for d in range(-most, most + 1) if a + d >= 0 and b + d <= len(s)}
        return list(keys)

    return letters.map(of, na_action="ignore")


def _near(base: DataFrame, surfaces: DataFrame, most: int = 2) -> DataFrame:
    depth = F.least(allowed(F.length("bare")), F.lit(most))
    left = base.select("token", "bare", "cut", depth.alias("depth"), F.explode(deletions(F.col("bare"), depth)).alias("key"))
    other = F.when(F.col("short"), 1).otherwise(F.least(allowed(F.length("surface")), F.lit(most)))
    right = surfaces.select("word", "surface", "short", F.explode(deletions(F.col("surface"), other)).alias("key"))
    met = left.join(lookup(right), "key").where("not short or cut").select("token", "bare", "depth", "word", "surface", "short").distinct()
    told = met.withColumn("d", edit_distance(F.col("bare"), F.col("surface")))
    good = told.where((F.col("d") <= F.col("depth")) & (~F.col("short") | (F.col("d") <= 1)))
    size = F.greatest(F.length("bare"), F.length("surface"))
    sim = F.when(F.col("short"), 0.97 - 0.1 * F.col("d")).otherwise(1 - F.col("d") / (size + 2))
    return good.groupBy("token", "word").agg(F.max(sim).alias("sim"))


def _own_words(repairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Repairs without those of tokens that are words of their own."""
    used = parts.groupBy(F.rtrim("token", F.lit(".")).alias("bare")).agg(F.count("*").alias("used"))
    used = materialize(used)
    bare = repairs.withColumn("bare", F.rtrim("token", F.lit(".")))
    counted = bare.join(used, "bare", "left").join(used.select(F.col("bare").alias("word"), F.col("used").alias("word_used")), "word", "left")
    own = (F.col("sim") < 1) & ~F.col("token").endswith(".") & (F.col("used") >= OWN_COUNT)
    return counted.where(~(own & (F.col("used") >= OWN_SHARE * F.coalesce("word_used", F.lit(0))))).drop("bare", "used", "word_used")


@settled
def match_entries(values: DataFrame, value: str, entries: DataFrame, entry: str, carriers: list[str] | None = None) -> DataFrame:
    """Best entries of the list for every distinct value: (value, entry, score).

    Nulls, blanks and values without letters match nothing. At a tie several
    entries are given; values that match none are absent. Both columns may repeat.
    """
    spark = values.sparkSession
    typed = values.groupBy(F.col(value).alias("value")).count().where("value is not null")
    typed = materialize(typed.select("value", fold(F.col("value")).alias("folded")))
    listed = entries.select(F.col(entry).alias("entry")).where("entry is not null").distinct().withColumn("folded", fold(F.col("entry")))
    listed = materialize(listed.withColumn("t", F.array_distinct(F.transform(tokens(F.col("folded")), bare_token))))
    words = materialize(listed.select("entry", F.explode("t").alias("word"), "t").select("entry", "word", required(F.col("word"), F.col("t")).alias("req")))
    total = listed.count()
    weights = materialize(words.groupBy("word").agg((F.lit(1.0) + F.log(F.lit(float(max(total, 1))) / F.countDistinct("entry"))).alias("idf")))
    carrying = spark.createDataFrame([(w,) for w in (carriers or [])], "word string")
    vocabulary = materialize(
        weights.select("word", F.lit(False).alias("carrier"))
        .unionByName(carrying.join(weights, "word", "left_anti").withColumn("carrier", F.lit(True)))
    )
    parts = typed.select("folded").distinct().withColumn("t", tokens(F.col("folded")))
    parts = materialize(parts.select("folded", F.posexplode("t").alias("at", "token"), "t").select("folded", "at", "token", required(F.col("token"), F.col("t")).alias("req")))
    repairs = _own_words(repair_tokens(parts.select("token"), vocabulary), parts).join(lookup(vocabulary), "word")
    best = F.max(F.struct("sim", (~F.col("carrier")).alias("own"))).over(Window.partitionBy("token"))
    # a token that is nearest to a carrying word carries
    repairs = materialize(repairs.withColumn("carries", ~best["own"]))
    rarest = F.lit(1.0 + 1.0) + F.log(F.lit(float(max(total, 1))))
    hits = (
        parts.join(lookup(repairs), "token", "left")
        .where("carries is null or not carries")
        .where("carrier is null or not carrier")
        .join(lookup(weights), "word", "left")
    )
    # a glued token counts for each of its halves
    slot = F.when(F.col("half"), F.concat_ws("/", "at", "word")).otherwise(F.col("at").cast("string"))
    hits = materialize(hits.withColumn("slot", slot))
    whole = hits.groupBy("folded", "slot").agg(F.max(F.coalesce("idf", rarest)).alias("w"), F.max("half").alias("half"), F.min("at").alias("at"), F.max("req").alias("req"), F.max(F.col("word").isNotNull()).alias("known"))
    # short words that no entry has are particles of the typist's
    weight = F.when(~F.col("half"), F.col("w") * F.col("w")).otherwise(0)
    value_norm = whole.groupBy("folded").agg(
        F.sum(F.when(F.col("req") | F.col("known"), weight)).alias("sq"),
        F.sum(F.when(F.col("req"), weight)).alias("sq_req"),
        F.count_distinct(F.when(F.col("req"), F.col("at"))).alias("n_value"),
    )
    weighed = materialize(words.join(lookup(weights), "word"))
    entry_norm = materialize(
        weighed.groupBy("entry").agg(
            F.sum(F.col("idf") * F.col("idf")).alias("sq_entry"),
            F.sum(F.when(F.col("req"), F.col("idf") * F.col("idf"))).alias("sq_entry_req"),
            F.count_if("req").alias("n_entry"),
            F.max(F.when(F.col("req"), F.struct("idf", "word"))).alias("rare"),
        )
    )
    # an entry stands only where its rarest word is met, so no other word brings it up
    found = hits.where("word is not null").select("folded", "word", "sim", "idf", "at")
    brought = found.select("folded", "word").distinct().join(lookup(entry_norm.select("entry", F.col("rare.word").alias("word"))), "word").select("folded", "entry")
    pairs = brought.join(found, "folded").join(lookup(words.select("entry", "word", "req")), ["entry", "word"])
    one = pairs.groupBy("folded", "entry", "word").agg(F.max("sim").alias("sim"), F.max("idf").alias("idf"), F.max("req").alias("req"), F.collect_set("at").alias("ats"))
    scored = one.groupBy("folded", "entry").agg(
        F.sum(F.col("sim") * F.col("idf") * F.col("idf")).alias("dot"),
        F.sum(F.when(F.col("req"), F.col("sim") * F.col("idf") * F.col("idf"))).alias("dot_req"),
        F.count_if("req").alias("m_entry"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("req"), F.col("ats")).otherwise(F.array().cast("array<int>")))))).alias("m_value"),
    )
    covered = materialize(
        scored.join(lookup(entry_norm), "entry")
        .join(value_norm, "folded")
        .withColumn("score", F.col("dot") / F.sqrt(F.col("sq_entry") * F.greatest("sq", "sq_entry")))
        .withColumn("least", F.col("dot_req") / F.sqrt(F.col("sq_entry_req") * F.greatest("sq_req", "sq_entry_req")))
        .where((F.col("m_entry") == F.col("n_entry")) & (F.col("m_value") >= F.col("n_value")) & (F.col("least") >= LEAST_SCORE))
        .select("folded", "entry", "score")
    )
    # values with a moved or lost blank: the letters decide, without carrying words
    left = typed.select("folded").distinct().join(covered.select("folded").distinct(), "folded", "left_anti")
    carried = repairs.where("carries").select("token").distinct()
    said = parts.join(lookup(carried), "token", "left_semi").groupBy("folded").agg(F.collect_set("token").alias("carrying"))
    none = F.array().cast("array<string>")
    spelt = left.join(said, "folded", "left").select("folded", _letters(F.col("folded"), F.coalesce("carrying", none)).alias("a")).where("a <> ''")
    titles = listed.select("entry", _letters(F.col("folded"), none).alias("b")).where("b <> ''")
    keys = materialize(titles.select("entry", "b", F.explode(_entry_pieces("b")).alias("key")))
    near = spelt.select("folded", "a", F.explode(_value_pieces("a")).alias("key")).join(lookup(keys), "key").select("folded", "a", "entry", "b").distinct()
    most = F.least(F.lit(WHOLE_EDITS), F.floor(F.length("b") * WHOLE_SHARE))
    slips = near.withColumn("d", edit_distance(F.col("a"), F.col("b"))).where(F.col("d") <= most)
    slips = slips.withColumn("score", F.lit(LEAST_SCORE) - F.col("d") * 0.01).select("folded", "entry", "score")
    ranked = covered.unionByName(slips)
    top = ranked.withColumn("most", F.max("score").over(Window.partitionBy("folded"))).where("score >= most - 1e-9")
    return typed.join(top.select("folded", "entry", "score"), "folded").select("value", "entry", "score")


#: `соч. Римплорскій, 1892`, `музыка и программа: Женмоговъ (1896)`, `Дралслоровъ, впервые 1904`
NOTE_AUTHOR = r"(\p{L}+),?\s+(?:впервые\s+)?\(?(\d{4})\)?"
#: Words in the list's notes that name another title of the entry.
BILLED = r"also billed as «([^»]+)»"


def work_keys(key: Column) -> tuple[Column, Column]:
    """Folded author and year digits (two or four) of a typed key, else empty."""
    folded = fold(key)
    return F.regexp_extract(folded, r"(\p{L}{3,})", 1), F.regexp_extract(folded, r"(\d{4}|\d{2})(?!\d)", 1)


@settled
def map_titles(typed: DataFrame, works: DataFrame) -> DataFrame:
    """(same_title_id, work_id, score): the work each typed title means, or ``none``.

    Titles that are null, blank or without letters give ``none``; so does a title of
    the list whose author and year are others than those typed. Among works that
    still share the title, the one whose author and year are typed goes first, then
    the one of the genre typed behind the title, then works whose note names no
    author; if several are left, the smallest id stands. Repeated rows count once.
    """
    rows = typed.select("same_title_id", "verbatim_title", "work_key").where("same_title_id is not null")
    rows = materialize(rows.groupBy("same_title_id").agg(F.min_by("verbatim_title", F.struct("verbatim_title", "work_key")).alias("verbatim_title"), F.min_by("work_key", F.struct("verbatim_title", "work_key")).alias("work_key")))
    note = F.regexp_replace(F.coalesce("title_note", F.lit("")), r";?\s*" + BILLED, "")
    listed = materialize(
        works.where("work_id is not null").select(
            "work_id",
            "canonical_genre",
            fold(F.regexp_extract(note, NOTE_AUTHOR, 1)).alias("author"),
            F.regexp_extract(note, NOTE_AUTHOR, 2).alias("year"),
            F.explode(F.array_compact(F.array("canonical_title", F.nullif(F.regexp_extract(F.coalesce("title_note", F.lit("")), BILLED, 1), F.lit(""))))).alias("title"),
        )
    )
    met = match_entries(rows, "verbatim_title", listed, "title", CARRIER_WORDS)
    named = rows.join(met, rows.verbatim_title == met.value).join(lookup(listed), F.col("entry") == F.col("title"))
    author, year = work_keys(F.col("work_key"))
    named = named.withColumn("key_author", author).withColumn("key_year", year)
    filled = (F.col("key_author") != "") & (F.col("key_year") != "")
    noted = F.col("author") != ""
    close = edit_distance(F.col("key_author"), F.col("author")) <= F.when(F.length("author") < 5, 1).otherwise(2)
    same = F.col("year").endswith(F.col("key_year")) & close
    genre = F.regexp_extract(F.lower("verbatim_title"), r",\s*(\p{L}+\.(?:-\p{L}+)?)\W*$", 1)
    by_genre = (genre != "") & (fold(genre) == fold(F.col("canonical_genre")))
    level = F.when(filled & noted & same, 0).when(filled & noted, 9).when(by_genre, 1).when(~noted, 2).otherwise(3)
    chosen = (
        named.withColumn("level", level)
        .where("level < 9")
        .groupBy("same_title_id")
        .agg(F.min(F.struct("level", (-F.col("score")).alias("s"), "work_id")).alias("b"))
    )
    return rows.select("same_title_id").join(chosen, "same_title_id", "left").select(
        "same_title_id", F.coalesce("b.work_id", F.lit("none")).alias("work_id"), (-F.col("b.s")).alias("score")
    )
