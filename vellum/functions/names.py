"""Column expressions on titles, names and dates as printed; they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with accents and what they become; signs that are dropped.
ACCENTED, BARE, DROPPED = "àâäáãçèéêëìíîïñòóôöõùúûüýÿ", "aaaaaceeeeiiiinooooouuuuyy", "ъь"
#: Endings of surnames and their endings in other cases (old spelling).
DECLENSION = [
    ("овъ", "ова ову овымъ овѣ"), ("евъ", "ева еву евымъ евѣ"), ("инъ", "ина ину инымъ инѣ"), ("ій", "аго ому имъ омъ"), ("ая", "ой ую ою"),
    ("ова", "овой ову овою"), ("ева", "евой еву евою"), ("ина", "иной ину иною"), ("йнъ", "йна йну йномъ йнѣ"), ("ичъ", "ича ичу ичемъ ичѣ"),
]
#: Beginnings of weekdays without signs, longest first, Monday = 1.
WEEKDAYS = [("воскрес", 7), ("понед", 1), ("вторн", 2), ("четве", 4), ("пятни", 5), ("суббо", 6), ("сред", 3)]
#: Genres as printed and in full.
GENRES = {"бал.": "балетъ", "бал.-феерія": "балетъ-феерія", "ком.": "комедія", "др.": "драма", "оп.": "опера", "дивертисм.": "дивертисментъ"}
#: A genre behind the last comma of a title.
SUFFIX = r"^(.*),\s*(\p{L}+\.?(?:-\p{L}+\.?)?)\s*$"


def title_key(title: Column) -> Column:
    """Lower case, without signs, accents of Latin letters and anything but letters
    and digits (F22)."""
    return F.regexp_replace(F.translate(F.lower(title), ACCENTED + DROPPED, BARE), r"[^\p{L}\p{N}]+", "")


def title_key_sql(column: str) -> str:
    """The same as SQL."""
    return rf"regexp_replace(translate(lower({column}), '{ACCENTED}{DROPPED}', '{BARE}'), '[^\p{{L}}\p{{N}}]+', '', 'g')"


def genre_split(title: Column, vocabulary: list[str]) -> tuple[Column, Column]:
    """(title without its genre, genre in full); a suffix outside the vocabulary
    belongs to the title (F24)."""
    suffix = F.lower(F.regexp_extract(title, SUFFIX, 2))
    known = suffix.isin(vocabulary)
    full = F.create_map(*[F.lit(x) for pair in GENRES.items() for x in pair])
    return F.when(known, F.regexp_extract(title, SUFFIX, 1)).otherwise(title), F.when(known, F.coalesce(full[suffix], suffix))


def last_word(name: Column) -> Column:
    return F.regexp_extract(name, r"(\p{L}+)\P{L}*$", 1)


def gender_of_surname(surname: Column) -> Column:
    """``f``, ``m`` or empty by the ending."""
    return F.when(surname.rlike("(ова|ева|ина|ына|ая)$"), "f").when(surname.rlike("(ов|ев|ин|ын)ъ?$|(ій|ый)$"), "m").otherwise("")


def gender_of_honorific(honorific: Column) -> Column:
    return F.when(honorific.rlike("^г-ж"), "f").when(honorific.rlike("^(г\\.|г-н|барон)"), "m").otherwise("")


def weekday_of_word(word: Column) -> Column:
    """Number of the weekday a word begins with, 1 = Monday, else null."""
    plain = F.translate(F.lower(word), DROPPED, "")
    out = F.lit(None).cast("int")
    for prefix, day in reversed(WEEKDAYS):
        out = F.when(plain.startswith(prefix), day).otherwise(out)
    return out


def declined(surname: Column) -> Column:
    """Array of the surname in other cases; empty where no ending is known."""
    out = F.array().cast("array<string>")
    for ending, others in reversed(DECLENSION):
        stem = F.left(surname, F.length(surname) - len(ending))
        out = F.when(surname.endswith(ending), F.array(*[F.concat(stem, F.lit(o)) for o in others.split()])).otherwise(out)
    return out


def word_stem(word: Column) -> Column:
    """A word without vowels and signs at its end."""
    return F.regexp_replace(word, "[аеиійоуыѣъьюя]+$", "")


def month_days(year: Column, month: Column) -> Column:
    """Days of a month, every fourth year a leap year as in the Julian calendar."""
    return F.when(month == 2, F.when(year % 4 == 0, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def backfilled(start: Column, day: Column) -> Column:
    """ISO date of a day printed under a header that begins at ``start`` (ISO): a day
    before the header's falls into the next month; null where the month is shorter (F19)."""
    y, m, d = (F.substring(start, p, n).try_cast("int") for p, n in ((1, 4), (6, 2), (9, 2)))
    later = day < d
    month = F.when(later, m % 12 + 1).otherwise(m)
    year = F.when(later & (m == 12), y + 1).otherwise(y)
    return F.when(day <= month_days(year, month), F.format_string("%04d-%02d-%02d", year, month, day))
