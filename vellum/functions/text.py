"""Column expressions on text that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def spelling_fold(text: Column) -> Column:
    """Old letters to new ones, signs dropped, repeated letters collapsed, lower case."""
    low = F.translate(F.lower(text), "ѣіѳѵёъь", "еифие")
    return F.regexp_replace(low, r"(\p{L})\1+", "$1")


def squash(text: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def stem_key(text: Column, length: int = 4) -> Column:
    """First letters of each word."""
    return F.array_join(F.transform(F.split(F.trim(F.lower(text)), r"\s+"), lambda w: F.left(w, F.lit(length))), " ")


def ordinal_split(text: Column) -> tuple[Column, Column]:
    """``X 2-й`` to (base, ordinal); without ordinal null."""
    pattern = r"^(.*?)\s+(\d+)-\p{L}+$"
    hit = text.rlike(pattern)
    return F.when(hit, F.regexp_extract(text, pattern, 1)).otherwise(text), F.when(hit, F.regexp_extract(text, pattern, 2).try_cast("int"))


def natural_id(*parts: Column) -> Column:
    """Stable id of a natural key: first ten hex digits of its SHA-1."""
    return F.left(F.sha1(F.concat_ws("|", *parts)), F.lit(10))


def minor_units(major: Column, minor: Column) -> Column:
    """Roubles and kopecks to kopecks; null without roubles."""
    return major.try_cast("bigint") * 100 + F.coalesce(minor.try_cast("bigint"), F.lit(0))


def rejoin_lines(text: Column) -> Column:
    """Hyphen-broken lines joined, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(\p{L})-\s*\n\s*(\p{Ll})", "$1$2"), r"\s+", " "))


def words(text: Column) -> Column:
    """Lower-case words of a text, Latin or Cyrillic."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-zа-яѣіѳѵё]+)"), F.lit(1))
