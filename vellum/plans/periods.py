"""Service periods of persons (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.intervals import interval_gaps, merge_intervals, season_spans, season_text, season_year
from vellum.session import settled
from vellum.sources.tables import table


def attested_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of both tables as (person_id, start, end), half-open years.

    A null last season covers the first season only. A first or last season that
    can't be read covers nothing.
    """
    notes = season_spans(table(spark, folder, "person_tenure_note", "person_id", "service_periods"), "person_id", "service_periods")
    p = table(spark, folder, "review_person", "person_id", "first_attested_season", "last_attested_season")
    a = season_year(F.col("first_attested_season"))
    b = season_year(F.coalesce("last_attested_season", "first_attested_season"))
    people = p.select("person_id", F.least(a, b).alias("start"), (F.greatest(a, b) + 1).alias("end"), (a + b).alias("_ok"))
    return notes.unionByName(people.where("_ok is not null").drop("_ok"))


@settled
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Periods and gaps of every person, as seasons; see TESTDATA.md."""
    periods = merge_intervals(attested_spans(spark, folder), "person_id", "start", "end")
    gaps = interval_gaps(periods, "person_id", "start", "end")
    both = periods.withColumn("kind", F.lit("period")).unionByName(gaps.withColumn("kind", F.lit("gap")))
    return both.select(
        "person_id",
        "kind",
        season_text(F.col("start")).alias("first_season"),
        season_text(F.col("end") - 1).alias("last_season"),
    )


QUERIES = {"p6_found": p6_found}

_YEAR = r"""CASE WHEN regexp_matches({x}, '^\s*\d{{4}}\s*[-–—/]\s*(\d{{4}}|\d{{2}})\s*$')
 AND (CAST(regexp_extract({x}, '(\d{{4}})', 1) AS INT) + 1) % 100 = CAST(regexp_extract({x}, '(\d\d)\s*$', 1) AS INT)
 THEN CAST(regexp_extract({x}, '(\d{{4}})', 1) AS INT) END"""

ORACLE = {
    "p6_found": rf"""
WITH pieces AS (
  SELECT person_id, regexp_replace(trim(unnest(string_split_regex(service_periods, '[;,]'))), '^(съ|с)\s+', '') AS p
  FROM person_tenure_note WHERE service_periods IS NOT NULL),
ends AS (
  SELECT person_id, string_split_regex(p, '\s*(\.\.+|…|\s(по|до)\s)\s*') AS x FROM pieces),
spans AS (
  SELECT person_id, {_YEAR.format(x="x[1]")} AS a, {_YEAR.format(x="x[len(x)]")} AS b FROM ends WHERE len(x) <= 2
  UNION ALL
  SELECT person_id, {_YEAR.format(x="first_attested_season")},
         {_YEAR.format(x="coalesce(last_attested_season, first_attested_season)")} FROM review_person),
years AS (
  SELECT DISTINCT person_id, unnest(generate_series(least(a, b), greatest(a, b))) AS y
  FROM spans WHERE a IS NOT NULL AND b IS NOT NULL AND person_id IS NOT NULL),
runs AS (
  SELECT person_id, min(y) AS s, max(y) AS e
  FROM (SELECT person_id, y, y - row_number() OVER (PARTITION BY person_id ORDER BY y) AS g FROM years)
  GROUP BY person_id, g),
both_kinds AS (
  SELECT person_id, 'period' AS kind, s, e FROM runs
  UNION ALL
  SELECT person_id, 'gap', e + 1, n - 1
  FROM (SELECT person_id, e, lead(s) OVER (PARTITION BY person_id ORDER BY s) AS n FROM runs) WHERE n IS NOT NULL)
SELECT person_id, kind,
  s || '-' || lpad(CAST((s + 1) % 100 AS VARCHAR), 2, '0') AS first_season,
  e || '-' || lpad(CAST((e + 1) % 100 AS VARCHAR), 2, '0') AS last_season
FROM both_kinds"""
}
