"""Queries of dated text, ledgers of references, curated overrides and further flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions.text import minor_units
from vellum.operators import rules as R
from vellum.operators import runs as S
from vellum.operators.sizing import lookup
from vellum.sources.tables import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


@query(r"""WITH t AS (SELECT person_id, list, coalesce(printed_leaving, '') AS s, printed_leaving_date AS d, printed_in_seasons AS z FROM (SELECT DISTINCT * FROM person_tenure_note))
SELECT person_id, list, regexp_extract(s, '^([а-яѣі]+)', 1) AS kind, strftime(d, '%Y-%m-%d') AS stated,
CASE WHEN regexp_matches(s, '\d\d\.\d\d\.\d{4}') THEN regexp_extract(s, '(\d{4})$', 1) || '-' || regexp_extract(s, '\.(\d\d)\.', 1) || '-' || regexp_extract(s, '(\d\d)\.\d\d\.\d{4}', 1) END AS read_as,
CAST(CASE WHEN month(d) >= 8 THEN year(d) ELSE year(d) - 1 END AS INT) AS season_year FROM t""")
def period_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Kind and date out of a printed note, season of the date."""
    t = table(spark, d, "person_tenure_note").distinct().withColumn("s", F.coalesce("printed_leaving", F.lit("")))
    g = lambda p: F.regexp_extract("s", p, 1)
    read = F.when(F.col("s").rlike(r"\d\d\.\d\d\.\d{4}"), F.concat_ws("-", g(r"(\d{4})$"), g(r"\.(\d\d)\."), g(r"(\d\d)\.\d\d\.\d{4}")))
    day = F.col("printed_leaving_date")
    season = F.when(F.month(day) >= 8, F.year(day)).otherwise(F.year(day) - 1)
    return t.select("person_id", "list", g("^([а-яѣі]+)").alias("kind"), F.date_format(day, "yyyy-MM-dd").alias("stated"), read.alias("read_as"), season.alias("season_year"))


@query(r"""WITH t AS (SELECT DISTINCT person_id, unnest(string_split_regex(cities, '[;,\s]+')) AS city FROM review_person), k AS (SELECT DISTINCT city FROM production_entry WHERE city IS NOT NULL)
SELECT person_id, CAST(count(*) AS BIGINT) AS listed, CAST(count(k.city) AS BIGINT) AS known FROM t LEFT JOIN k USING (city) WHERE t.city <> '' GROUP BY 1""")
def ledger_links(spark: SparkSession, d: str) -> DataFrame:
    """Token lists to links to known values, counted back on the parent."""
    t = table(spark, d, "review_person", "person_id", "cities")
    x = t.select("person_id", F.explode(F.split("cities", r"[;,\s]+")).alias("city")).where("city <> ''").distinct()
    k = table(spark, d, "production_entry", "city").where("city is not null").distinct().withColumn("k", F.lit(1))
    return x.join(lookup(k), "city", "left").groupBy("person_id").agg(F.count("*").alias("listed"), F.count("k").alias("known"))


@query("""WITH m AS (SELECT DISTINCT mention_id, block_id, mention_type, char_start, surface FROM review_mention), o AS (SELECT *, row_number() OVER (PARTITION BY block_id, surface ORDER BY char_start, mention_id) AS nth FROM m),
r(surface, nth, ruled) AS (VALUES ('Зельмира', 1, 'queen'), ('Зельмира', 2, 'queen again'), ('духъ водопада', 1, 'spirit'))
SELECT mention_id, CAST(o.nth AS INT) AS nth, ruled FROM o LEFT JOIN r ON o.surface = r.surface AND o.nth = r.nth""")
def curated_override(spark: SparkSession, d: str) -> DataFrame:
    """Rulings by block, surface and occurrence."""
    m = table(spark, d, "review_mention", "mention_id", "block_id", "mention_type", "char_start", "surface").distinct()
    o = m.withColumn("nth", F.row_number().over(Window.partitionBy("block_id", "surface").orderBy(F.col("char_start").asc_nulls_last(), "mention_id")))
    r = spark.createDataFrame([("Зельмира", 1, "queen"), ("Зельмира", 2, "queen again"), ("духъ водопада", 1, "spirit")], "surface string, nth int, ruled string")
    return o.join(F.broadcast(r), ["surface", "nth"], "left").select("mention_id", "nth", "ruled")  # a written list


@query("""WITH p AS (SELECT page_id, block_index, block_id, lag(block_id) OVER w AS before, lead(block_id) OVER w AS after FROM review_passage WINDOW w AS (PARTITION BY page_id ORDER BY block_index, block_id)),
m AS (SELECT block_id, count(DISTINCT mention_id) AS n FROM review_mention WHERE work_id IS NOT NULL GROUP BY 1) SELECT p.block_id, before, after, CAST(n AS BIGINT) AS mentions FROM p JOIN m USING (block_id)""")
def passages_of_works(spark: SparkSession, d: str) -> DataFrame:
    """Passages with a linked work and their neighbours in reading order."""
    w = Window.partitionBy("page_id").orderBy("block_index", "block_id")
    p = table(spark, d, "review_passage", "page_id", "block_index", "block_id").withColumn("before", F.lag("block_id").over(w)).withColumn("after", F.lead("block_id").over(w))
    m = table(spark, d, "review_mention", "block_id", "mention_id", "work_id").where("work_id is not null").groupBy("block_id").agg(F.countDistinct("mention_id").alias("mentions"))
    return p.join(m, "block_id").select("block_id", "before", "after", "mentions")


@query("""WITH m AS (SELECT DISTINCT mention_id, block_id, mention_type, char_start, surface FROM review_mention), o AS (SELECT *, last_value(CASE WHEN mention_type = 'work' THEN surface END IGNORE NULLS) OVER (PARTITION BY block_id ORDER BY char_start NULLS LAST, mention_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS near FROM m)
SELECT mention_id, near AS governing_work FROM o WHERE mention_type = 'person'""")
def governing_work(spark: SparkSession, d: str) -> DataFrame:
    """The nearest work named before a person in the block."""
    m = table(spark, d, "review_mention", "mention_id", "block_id", "mention_type", "char_start", "surface").distinct()
    m = m.withColumn("work", F.when(F.col("mention_type") == "work", F.col("surface")))
    near = S.fill_last(m, ["block_id"], ["char_start", "mention_id"], "work", "near")
    return near.where("mention_type = 'person'").select("mention_id", F.col("near").alias("governing_work"))


@query(r"""WITH f AS (
SELECT 'total_without_unit' AS flag, production_entry_id AS row_id FROM production_entry WHERE total_text <> '' AND NOT regexp_matches(total_text, 'раз')
UNION ALL SELECT 'blank_heading', production_entry_id FROM production_entry WHERE coalesce(trim(section_heading), '') = ''
UNION ALL SELECT 'digit_in_title', production_entry_id FROM production_entry WHERE regexp_matches(title, '[а-яѣі][0-9]')
UNION ALL SELECT 'same_start_other_surface', block_id || ':' || char_start FROM (SELECT block_id, char_start FROM review_mention WHERE char_start IS NOT NULL AND block_id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT surface) > 1)
UNION ALL SELECT 'span_reversed', CAST(mention_id AS VARCHAR) FROM (SELECT DISTINCT mention_id FROM review_mention WHERE char_end <= char_start)
UNION ALL SELECT 'anonymous_with_person', CAST(credit_id AS VARCHAR) FROM (SELECT DISTINCT credit_id FROM review_credit WHERE is_anonymous AND person_id IS NOT NULL))
SELECT flag, row_id FROM f""")
def dq_flags_more(spark: SparkSession, d: str) -> DataFrame:
    """Q7, Q9, Q10, Q14, Q16: one rule per flag, in one long table."""
    p = table(spark, d, "production_entry", "production_entry_id", "total_text", "section_heading", "title")
    m = table(spark, d, "review_mention", "mention_id", "block_id", "char_start", "char_end", "surface")
    c = table(spark, d, "review_credit", "credit_id", "is_anonymous", "person_id")
    f = lambda df, flag, row: df.select(F.lit(flag).alias("flag"), row.cast("string").alias("row_id"))
    starts = m.where("char_start is not null and block_id is not null").groupBy("block_id", "char_start").agg(F.countDistinct("surface").alias("k")).where("k > 1")
    key = F.col("production_entry_id")
    parts = [
        f(p.where((F.col("total_text") != "") & ~F.col("total_text").rlike("раз")), "total_without_unit", key),
        f(p.where(F.trim(F.coalesce("section_heading", F.lit(""))) == ""), "blank_heading", key),
        f(p.where(F.col("title").rlike("[а-яѣі][0-9]")), "digit_in_title", key),
        f(starts, "same_start_other_surface", F.concat_ws(":", "block_id", "char_start")),
        f(m.where("char_end <= char_start").select("mention_id").distinct(), "span_reversed", F.col("mention_id")),
        f(c.where("is_anonymous and person_id is not null").select("credit_id").distinct(), "anonymous_with_person", F.col("credit_id")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("""WITH g AS (SELECT n_nationkey, n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN 'visiting' END AS troupe FROM nation)
SELECT c_custkey, CASE WHEN troupe IS NOT NULL THEN 'guest' WHEN c_mktsegment = 'BUILDING' THEN 'house' ELSE 'unknown' END AS company, CASE WHEN troupe IS NOT NULL THEN 'troupe' WHEN c_mktsegment = 'BUILDING' THEN 'segment' ELSE 'no rule' END AS basis FROM customer JOIN g ON n_nationkey = c_nationkey""")
def company_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Company from a joined attribute first, then from the row."""
    g = table(spark, d, "nation", "n_nationkey").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, "visiting").alias("troupe"))
    value, basis = R.rule_cascade([(F.col("troupe").isNotNull(), "guest", "troupe"), (F.col("c_mktsegment") == "BUILDING", "house", "segment")], ("unknown", "no rule"))
    c = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment").join(lookup(g), F.col("n_nationkey") == F.col("c_nationkey"))
    return c.select("c_custkey", value.alias("company"), basis.alias("basis"))


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^0-9 ]|[^0-9] )([0-9]{1,3}( [0-9]{3})* р\. [0-9]{1,2} к\.)', 1)) AS s FROM documents)
SELECT doc_id, CAST(count(*) AS BIGINT) AS sums, CAST(sum(CAST(replace(regexp_extract(s, '^([0-9 ]+) р', 1), ' ', '') AS BIGINT) * 100 + CAST(regexp_extract(s, 'р\. ([0-9]{1,2}) к', 1) AS BIGINT)) AS BIGINT) AS minor FROM t GROUP BY 1""")
def sums_in_text(spark: SparkSession, d: str) -> DataFrame:
    """sums of money found in running text, in minor units."""
    t = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?:^|[^0-9 ]|[^0-9] )([0-9]{1,3}( [0-9]{3})* р\. [0-9]{1,2} к\.)"), F.lit(1))).alias("s"))
    major = F.replace(F.regexp_extract("s", "^([0-9 ]+) р", 1), F.lit(" "), F.lit(""))
    minor = F.regexp_extract("s", r"р\. ([0-9]{1,2}) к", 1)
    return t.groupBy("doc_id").agg(F.count("*").alias("sums"), F.sum(minor_units(major, minor)).alias("minor"))
