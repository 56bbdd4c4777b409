"""Calendar operators: Julian day numbers, gap synthesis, drift votes, partial dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.runs import islands


def julian_day(iso: Column) -> Column:
    """Day number of an ISO date string in the Julian calendar (F18); 29 February of
    a Julian leap year is a valid day there though no Gregorian date."""
    y, m, d = (F.substring(iso, p, n).try_cast("int") for p, n in ((1, 4), (6, 2), (9, 2)))
    a = F.floor((14 - m) / 12)
    yy, mm = y + 4800 - a, m + 12 * a - 3
    return (d + F.floor((153 * mm + 2) / 5) + 365 * yy + F.floor(yy / 4) - 32083).cast("int")


def weekday_of(day_number: Column) -> Column:
    """0 = Monday for a Julian day number."""
    return (day_number % 7).cast("int")


def iso_of_julian_day(day_number: Column) -> Column:
    """Julian-calendar ISO string of a day number."""
    c = day_number + 32082
    d = F.floor((4 * c + 3) / 1461)
    e = c - F.floor(1461 * d / 4)
    m = F.floor((5 * e + 2) / 153)
    day = e - F.floor((153 * m + 2) / 5) + 1
    month, year = m + 3 - 12 * F.floor(m / 10), d - 4800 + F.floor(m / 10)
    return F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int"))


def day_grid(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Every day between the first and the last of each key."""
    bounds = df.groupBy(*keys).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    return bounds.select(*keys, F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias(day))


def synthesize_gaps(df: DataFrame, keys: list[str], day: str, status: str = "status") -> DataFrame:
    """Rows as they are with status ``captured`` and, for each day of the grid no row
    covers, one with ``not_captured`` and nulls elsewhere (E1, U2)."""
    missing = day_grid(df, keys, day).join(df.select(*keys, day).distinct(), [*keys, day], "left_anti")
    return df.withColumn(status, F.lit("captured")).unionByName(missing.withColumn(status, F.lit("not_captured")), allowMissingColumns=True)


def drift_vote(blocks: DataFrame, keys: list[str], order: list[str], day_number: str, printed_weekday: str, reach: int = 7, least: int = 2) -> DataFrame:
    """Status of dated blocks against their printed weekday.

    Blocks whose weekday fits are ``verified``; in each run of mismatches the shift
    that most blocks agree on (smallest size, then sign, at a tie) corrects them if at
    least ``least`` agree, else they stay ``unresolved``.
    """
    state = F.when(F.col(printed_weekday).isNull(), "no_weekday").when(weekday_of(F.col(day_number)) == F.col(printed_weekday), "verified").otherwise("mismatch")
    told = islands(blocks.withColumn("status", state), keys, order, "status", "_run")
    shifts = F.array(*[F.lit(k) for k in range(-reach, reach + 1) if k])
    tried = told.where("status = 'mismatch'").withColumn("_k", F.explode(shifts)).where(weekday_of(F.col(day_number) + F.col("_k")) == F.col(printed_weekday))
    votes = tried.groupBy(*keys, "_run", "_k").agg(F.count("*").alias("_votes"))
    w = Window.partitionBy(*keys, "_run").orderBy(F.desc("_votes"), F.abs("_k"), "_k")
    best = votes.withColumn("_r", F.row_number().over(w)).where(f"_r = 1 and _votes >= {least}").select(*keys, "_run", F.col("_k").alias("_shift"))
    joined = told.join(best, [*keys, "_run"], "left")
    fits = (F.col("status") == "mismatch") & (weekday_of(F.col(day_number) + F.col("_shift")) == F.col(printed_weekday))
    return (
        joined.withColumn("shift_days", F.when(fits, F.col("_shift")))
        .withColumn("status", F.when(fits, "corrected").when(F.col("status") == "mismatch", "unresolved").otherwise(F.col("status")))
        .drop("_run", "_shift")
    )


#: Beginnings of the months' names in old and new spelling.
MONTH_STEMS = ["янв", "фев", "мар", "апр", "ма[йя]", "июн|іюн", "июл|іюл", "авг", "сент", "окт", "ноя", "дек"]


def partial_date(df: DataFrame, text: str) -> DataFrame:
    """(text, iso, precision, y, m): the date in a text as far as it goes; an impossible
    day falls through to its month, 29 February of a Julian leap year is a day (F15, F17)."""
    t = F.col(text)
    month = F.lit(None).cast("int")
    for i, stem in reversed(list(enumerate(MONTH_STEMS, 1))):
        month = F.when(F.lower(t).rlike(rf"(^|\s)({stem})"), i).otherwise(month)
    number = lambda pattern: F.regexp_extract(t, pattern, 1).try_cast("int")
    m, y = F.coalesce(number(r"\d{1,2}\.(\d\d)\.\d{4}"), month), number(r"(1[789]\d\d)")
    read = df.select(t.alias("text"), m.alias("m"), y.alias("y"), F.coalesce(number(r"(\d{1,2})\.\d\d\.\d{4}"), number(r"(?:^|\s)(\d{1,2})\s")).alias("dd"))
    long_ = F.when(F.col("m").isin(4, 6, 9, 11), 30).when(F.col("m") == 2, F.when(F.col("y") % 4 == 0, 29).otherwise(28)).otherwise(31)
    whole = F.coalesce(F.col("dd") <= long_, F.lit(False)) & F.col("m").isNotNull() & F.col("y").isNotNull()
    precision = F.when(whole, "day").when(F.col("m").isNotNull(), "month").when(F.lower("text").rlike("осен|весн|зим|лѣто"), "season").when(F.col("y").isNotNull(), "year").otherwise("none")
    return read.select("text", F.when(whole, F.format_string("%04d-%02d-%02d", "y", "m", "dd")).alias("iso"), precision.alias("precision"), "y", "m")
