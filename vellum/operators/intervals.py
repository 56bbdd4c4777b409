"""Overlapping and gapped intervals: two-level merge.

Intervals are half-open ``[start, end)`` over integers; intervals that overlap or
touch form one period. Level one clips every interval to fixed time shards and
merges inside (entity, shard), where shards that an interval covers whole stay one
range; level two stitches only the coverage that touches a shard boundary. The first shuffle carries one row per distinct clipped start of
an entity and shard and map task (the longest end wins before the shuffle), so an
entity that holds a third of all rows doesn't reach one task whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.session import materialize, settled


def _runs(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Union of the intervals of each key, as disjoint runs."""
    order = Window.partitionBy(*keys).orderBy(start)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(before >= F.col(start), 0).otherwise(1))
    numbered = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


@settled
def merge_intervals(
    df: DataFrame, entity: str, start: str, end: str, shard_width: int = 8
) -> DataFrame:
    """Continuous periods of each entity: columns (entity, start, end).

    Rows with a null entity, a null end or ``start >= end`` cover nothing. Other
    columns are ignored; repeated rows and ties change nothing; an empty table
    gives an empty one. ``shard_width`` is in the unit of the interval ends and
    should be some hundred times the usual interval at fine units.
    """
    w = F.lit(shard_width)
    first, last = F.floor(F.col("_s") / w), F.floor((F.col("_e") - 1) / w)
    clean = df.select(
        F.col(entity).alias("_k"), F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e")
    ).where("_k is not null and _s is not null and _e is not null and _s < _e")
    part = lambda h, a, b: F.struct(h.cast("long").alias("h"), a.cast("long").alias("s"), b.cast("long").alias("e"))
    none = F.lit(None)
    head = part(first, F.col("_s"), F.least("_e", (first + 1) * w))
    tail = F.when(last > first, part(last, last * w, F.col("_e")))
    whole = F.when(last > first + 1, part(none, (first + 1) * w, last * w))
    clipped = clean.select("_k", F.explode(F.array_compact(F.array(head, tail, whole))).alias("p"))
    clipped = clipped.select("_k", F.col("p.h").alias("_h"), F.col("p.s").alias("_s"), F.col("p.e").alias("_e"))
    reduced = clipped.groupBy("_k", "_h", "_s").agg(F.max("_e").alias("_e"))
    local = materialize(_runs(reduced, ["_k", "_h"], "_s", "_e"))
    touches = F.col("_h").isNull() | (F.col("_s") == F.col("_h") * w) | (F.col("_e") == (F.col("_h") + 1) * w)
    inner = local.where(~touches)
    # what lies inside a range of covered shards is covered: told by shard, not by row
    covers = local.where("_h is null").select("_k", F.floor(F.col("_s") / w).alias("_h"), F.floor(F.col("_e") / w).alias("_to"))
    shards = inner.select("_k", "_h").distinct().withColumn("_to", F.lit(None).cast("long"))
    upto = Window.partitionBy("_k").orderBy("_h", F.col("_to").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    free = shards.unionByName(covers).withColumn("_reach", F.max("_to").over(upto)).where("_to is null and (_reach is null or _reach <= _h)").select("_k", "_h")
    inner = inner.join(free, ["_k", "_h"], "left_semi").select("_k", "_s", "_e")
    edge = _runs(local.where(touches).select("_k", "_s", "_e"), ["_k"], "_s", "_e")
    return inner.unionByName(edge).select(
        F.col("_k").alias(entity), F.col("_s").alias(start), F.col("_e").alias(end)
    )


def interval_gaps(periods: DataFrame, entity: str, start: str, end: str, shard_width: int = 8) -> DataFrame:
    """Gaps between the disjoint periods of each entity: (entity, start, end).

    Inside a shard of period starts the next start is found by a window over
    (entity, shard); between shards one summary row per entity and shard is
    compared, so no task holds all periods of a huge entity.
    """
    p = periods.select(
        F.col(entity).alias("_k"),
        F.col(start).alias("_s"),
        F.col(end).alias("_e"),
        F.floor(F.col(start) / F.lit(shard_width)).alias("_h"),
    )
    inside = p.withColumn("_n", F.lead("_s").over(Window.partitionBy("_k", "_h").orderBy("_s")))
    shards = p.groupBy("_k", "_h").agg(F.min("_s").alias("_f"), F.max("_e").alias("_e"))
    across = shards.withColumn("_n", F.lead("_f").over(Window.partitionBy("_k").orderBy("_h")))
    return (
        inside.select("_k", "_e", "_n")
        .unionByName(across.select("_k", "_e", "_n"))
        .where("_n is not null")
        .select(F.col("_k").alias(entity), F.col("_e").alias(start), F.col("_n").alias(end))
    )


#: A season as written: `1898-99`, `1899/00`, `1898—1899`, `1898 - 99`.
SEASON = r"(\d{4})\s*[-–—/]\s*(\d{4}|\d{2})(?!\d)"


def season_year(text: Column) -> Column:
    """First year of a season in any of its written forms, else null.

    The second year must follow the first."""
    first = F.regexp_extract(text, r"^\s*" + SEASON + r"\s*$", 1)
    second = F.regexp_extract(text, r"^\s*" + SEASON + r"\s*$", 2)
    year = first.try_cast("int")
    return F.when((year + 1) % 100 == F.right(second, F.lit(2)).try_cast("int"), year)


def season_text(year: Column) -> Column:
    """`1898-99` for 1898, `1899-00` for 1899."""
    return F.concat(
        F.lpad(year.cast("string"), 4, "0"),
        F.lit("-"),
        F.lpad(((year + 1) % 100).cast("string"), 2, "0"),
    )


def season_spans(df: DataFrame, entity: str, text: str) -> DataFrame:
    """Spans of a list such as ``1890-91..1894-95; съ 1896-97 по 1899-00, 1903-04``.

    Gives (entity, start, end) with half-open years; a span with an end that can't
    be read gives no row; ends in the wrong order are swapped.
    """
    piece = df.select(F.col(entity), F.explode(F.split(F.col(text), r"[;,]")).alias("_p"))
    bare = F.regexp_replace(F.col("_p"), r"^\s*(?:съ|с)\s+", "")
    ends = F.split(bare, r"\s*(?:\.\.+|…|\s(?:по|до)\s)\s*")
    spans = piece.select(entity, ends.alias("_x")).where(F.size("_x") <= 2)
    a = season_year(F.col("_x")[0])
    b = season_year(F.try_element_at("_x", F.lit(-1)))
    return spans.select(entity, F.least(a, b).alias("start"), (F.greatest(a, b) + 1).alias("end"), (a + b).alias("_ok")).where(
        "_ok is not null"
    ).drop("_ok")
