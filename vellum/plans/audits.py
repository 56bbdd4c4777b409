"""Audits, votes and roll-ups over the yearbook tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions.names import last_word, title_key, title_key_sql
from vellum.functions.text import squash
from vellum.operators import mentions
from vellum.operators import runs as R
from vellum.operators.sizing import lookup
from vellum.operators.titles import tiered_titles
from vellum.session import own_dir
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


def _flags(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _flag(df: DataFrame, flag: str, row) -> DataFrame:
    return df.select(F.lit(flag).alias("flag"), row.cast("string").alias("row_id"))


@query(None)
def title_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Works named in notices against the titles typed for their date and
    city: as printed, by key, as an excerpt, by containment, by likeness, inside a longer text."""
    c = table(spark, d, "review_credit", "credit_id", "city", "date_undate", "work_surface").where("work_surface is not null and date_undate is not null").distinct()
    t = table(spark, d, "same_title_works", "same_title_id", "city", "date", "verbatim_title").where("verbatim_title is not null and date is not null").distinct()
    left = c.select("city", F.col("date_undate").alias("date"), "credit_id", F.col("work_surface").alias("title"))
    return tiered_titles(left, t.select("city", "date", "same_title_id", F.col("verbatim_title").alias("title")), ["city", "date"], "credit_id", "same_title_id", "title")


@query("""WITH c AS (SELECT DISTINCT name_surface AS n, season, city, role_category, TRY_CAST(left(season, 4) AS INT) AS y FROM review_credit WHERE name_surface IS NOT NULL AND season IS NOT NULL),
g AS (SELECT n, y, lead(y) OVER (PARTITION BY n ORDER BY y) AS nx FROM (SELECT DISTINCT n, y FROM c))
SELECT 'both cities in a season' AS flag, n || ' ' || season AS row_id FROM c GROUP BY n, season HAVING count(DISTINCT city) > 1
UNION ALL SELECT 'gap of four seasons', n || ' ' || y FROM g WHERE nx - y > 4
UNION ALL SELECT 'four parts in a season', n || ' ' || season FROM c GROUP BY n, season HAVING count(DISTINCT role_category) >= 4""")
def person_audits(spark: SparkSession, d: str) -> DataFrame:
    """Q26: seasons of a name that speak for two persons."""
    c = table(spark, d, "review_credit", F.col("name_surface").alias("n"), "season", "city", "role_category").where("n is not null and season is not null").distinct()
    at = F.concat_ws(" ", "n", "season")
    per = c.groupBy("n", "season").agg(F.count_distinct("city").alias("cities"), F.count_distinct("role_category").alias("parts"))
    years = c.select("n", F.left("season", F.lit(4)).try_cast("int").alias("y")).distinct()
    gaps = years.withColumn("nx", F.lead("y").over(Window.partitionBy("n").orderBy("y"))).where("nx - y > 4")
    return _flags([_flag(per.where("cities > 1"), "both cities in a season", at), _flag(gaps, "gap of four seasons", F.concat_ws(" ", "n", "y")), _flag(per.where("parts >= 4"), "four parts in a season", at)])


@query("""WITH e AS (SELECT DISTINCT production_entry_id, page_id, season, city, nullif(printed_page_number, '') AS folio, source_page_index AS i FROM production_entry),
p AS (SELECT DISTINCT season, city, i, TRY_CAST(folio AS INT) AS f FROM e WHERE folio IS NOT NULL AND i IS NOT NULL), g AS (SELECT *, lead(f) OVER w AS nf, lead(i) OVER w AS ni FROM p WINDOW w AS (PARTITION BY season, city ORDER BY i, f))
SELECT 'no_folio' AS flag, production_entry_id AS row_id FROM e WHERE folio IS NULL
UNION ALL SELECT 'duplicate_folio', season || '/' || city || '/' || folio FROM e WHERE folio IS NOT NULL GROUP BY season, city, folio HAVING count(DISTINCT i) > 1
UNION ALL SELECT 'folio_step_differs', season || '/' || city || '/' || i FROM g WHERE nf - f <> ni - i""")
def folio_flags(spark: SparkSession, d: str) -> DataFrame:
    """Q19: pages without a printed number, numbers on several pages, steps that differ."""
    e = table(spark, d, "production_entry", "production_entry_id", "season", "city", "printed_page_number", "source_page_index").distinct().withColumn("folio", F.nullif("printed_page_number", F.lit(""))).withColumnRenamed("source_page_index", "i")
    p = e.where("folio is not null and i is not null").select("season", "city", "i", F.col("folio").try_cast("int").alias("f")).distinct()
    w = Window.partitionBy("season", "city").orderBy("i", F.col("f").asc_nulls_last())
    steps = p.withColumn("nf", F.lead("f").over(w)).withColumn("ni", F.lead("i").over(w)).where("nf - f <> ni - i")
    twice = e.where("folio is not null").groupBy("season", "city", "folio").agg(F.count_distinct("i").alias("n")).where("n > 1")
    place = lambda last: F.when(F.col("season").isNotNull() & F.col("city").isNotNull(), F.concat_ws("/", "season", "city", last))
    return _flags([_flag(e.where("folio is null"), "no_folio", F.col("production_entry_id")), _flag(twice, "duplicate_folio", place("folio")), _flag(steps, "folio_step_differs", place("i"))])


@query(r"""WITH m AS (SELECT DISTINCT surface FROM review_mention WHERE mention_type = 'theater' AND surface IS NOT NULL), v AS (SELECT DISTINCT theater FROM same_title_works WHERE theater IS NOT NULL),
s AS (SELECT surface, regexp_replace(lower(surface), '[^\p{L}\p{N}]', '', 'g') AS k FROM m), l AS (SELECT regexp_replace(lower(theater), '[^\p{L}\p{N}]', '', 'g') AS k, min(theater) AS theater FROM v GROUP BY 1)
SELECT surface, theater, CASE WHEN theater IS NULL THEN 'unrecognized' WHEN theater = surface THEN 'as listed' ELSE 'other spelling' END AS note FROM s LEFT JOIN l USING (k)""")
def theatre_spellings(spark: SparkSession, d: str) -> DataFrame:
    """Q10: theatres as mentioned against the list, by their letters alone."""
    m = table(spark, d, "review_mention", "mention_type", "surface").where("mention_type = 'theater' and surface is not null").select("surface").distinct().withColumn("k", squash(F.col("surface")))
    v = table(spark, d, "same_title_works", "theater").where("theater is not null").distinct().groupBy(squash(F.col("theater")).alias("k")).agg(F.min("theater").alias("theater"))
    note = F.when(F.col("theater").isNull(), "unrecognized").when(F.col("theater") == F.col("surface"), "as listed").otherwise("other spelling")
    return m.join(lookup(v), "k", "left").select("surface", "theater", note.alias("note"))


@query("""WITH a AS (SELECT season, city, count(DISTINCT page_id) AS n FROM review_mention GROUP BY ALL), b AS (SELECT season, city, count(DISTINCT page_id) AS n FROM review_credit GROUP BY ALL), c AS (SELECT season, city, count(DISTINCT page_id) AS n FROM production_entry GROUP BY ALL),
u AS (SELECT season, city, 1 AS s, n FROM a UNION ALL SELECT season, city, 2, n FROM b UNION ALL SELECT season, city, 3, n FROM c)
SELECT season, city, max(n) FILTER (WHERE s = 1) AS mentions, max(n) FILTER (WHERE s = 2) AS credits, max(n) FILTER (WHERE s = 3) AS entries, count(DISTINCT n) > 1 OR count(*) < 3 AS disagree FROM u GROUP BY season, city""")
def three_source_cells(spark: SparkSession, d: str) -> DataFrame:
    """Q13: pages of a season and city in three sources; a missing source disagrees."""
    side = lambda name, s: table(spark, d, name, "season", "city", "page_id").groupBy("season", "city").agg(F.count_distinct("page_id").alias("n")).withColumn("s", F.lit(s))
    u = side("review_mention", 1).unionByName(side("review_credit", 2)).unionByName(side("production_entry", 3))
    of = lambda s: F.max(F.when(F.col("s") == s, F.col("n")))
    return u.groupBy("season", "city").agg(of(1).alias("mentions"), of(2).alias("credits"), of(3).alias("entries"), ((F.count_distinct("n") > 1) | (F.count("*") < 3)).alias("disagree"))


@query(r"""WITH e AS (SELECT DISTINCT production_entry_id, performed_text AS p, total_text AS t, n_dates, total_count FROM production_entry),
x AS (SELECT *, TRY_CAST(nullif(regexp_extract(p, '(\d+)', 1), '') AS INT) AS said, TRY_CAST(nullif(regexp_extract(t, '(\d+)', 1), '') AS INT) AS total FROM e)
SELECT production_entry_id, said, total, CASE WHEN p IS NULL OR said IS NULL THEN 'no number said' WHEN t IS NULL OR t = '' THEN 'no total' WHEN NOT regexp_matches(t, 'раз') THEN 'total without unit' WHEN said <> total THEN 'total differs' WHEN total_count IS NOT NULL AND total_count <> n_dates THEN 'dates differ' ELSE 'agrees' END AS verdict FROM x""")
def printed_totals(spark: SparkSession, d: str) -> DataFrame:
    """The total printed under an entry against what its text says."""
    e = table(spark, d, "production_entry", "production_entry_id", "performed_text", "total_text", "n_dates", "total_count").distinct()
    number = lambda c: F.regexp_extract(c, r"(\d+)", 1).try_cast("int")
    x = e.withColumn("said", number("performed_text")).withColumn("total", number("total_text"))
    v = (
        F.when(F.col("performed_text").isNull() | F.col("said").isNull(), "no number said").when(F.col("total_text").isNull() | (F.col("total_text") == ""), "no total")
        .when(~F.col("total_text").rlike("раз"), "total without unit").when(F.col("said") != F.col("total"), "total differs")
        .when(F.col("total_count").isNotNull() & (F.col("total_count") != F.col("n_dates")), "dates differ").otherwise("agrees")
    )
    return x.select("production_entry_id", "said", "total", v.alias("verdict"))


@query("""WITH c AS (SELECT DISTINCT credit_id, production_entry_id, name_printed FROM production_entry_credit WHERE name_printed IS NOT NULL), e AS (SELECT production_entry_id, min(description_text) AS x FROM production_entry GROUP BY 1)
SELECT credit_id, coalesce(contains(x, name_printed), false) AS in_text FROM c LEFT JOIN e USING (production_entry_id)""")
def names_in_text(spark: SparkSession, d: str) -> DataFrame:
    """A credited name must stand in the entry's text as printed."""
    c = table(spark, d, "production_entry_credit", "credit_id", "production_entry_id", "name_printed").where("name_printed is not null").distinct()
    e = table(spark, d, "production_entry", "production_entry_id", "description_text").groupBy("production_entry_id").agg(F.min("description_text").alias("x"))
    return c.join(e, "production_entry_id", "left").select("credit_id", F.coalesce(F.col("x").contains(F.col("name_printed")), F.lit(False)).alias("in_text"))


@query("""WITH f AS (SELECT work_id, min(season) AS first_season, count(DISTINCT mention_id) AS mentions FROM review_mention WHERE work_id IS NOT NULL GROUP BY 1), w AS (SELECT work_id, canonical_title AS t, count(*) OVER (PARTITION BY canonical_title) AS n FROM research_work)
SELECT work_id, CASE WHEN n > 1 THEN t || ' (' || coalesce(first_season, '?') || ')' ELSE t END AS label, first_season, coalesce(mentions, 0) AS mentions FROM w LEFT JOIN f USING (work_id)""")
def first_seasons(spark: SparkSession, d: str) -> DataFrame:
    """First season of every work, which tells works of one title apart."""
    f = table(spark, d, "review_mention", "work_id", "season", "mention_id").where("work_id is not null").groupBy("work_id").agg(F.min("season").alias("first_season"), F.count_distinct("mention_id").alias("mentions"))
    w = table(spark, d, "research_work", "work_id", F.col("canonical_title").alias("t")).withColumn("n", F.count("*").over(Window.partitionBy("t")))
    label = F.when(F.col("n") > 1, F.concat("t", F.lit(" ("), F.coalesce("first_season", F.lit("?")), F.lit(")"))).otherwise(F.col("t"))
    return w.join(f, "work_id", "left").select("work_id", label.alias("label"), "first_season", F.coalesce("mentions", F.lit(0)).alias("mentions"))


@query("""SELECT season, city, count(DISTINCT mention_id) AS mentions FROM review_mention GROUP BY season, city HAVING count(work_id) FILTER (WHERE link_confidence = 'high') * 9 < count(*)""")
def silent_seasons(spark: SparkSession, d: str) -> DataFrame:
    """Seasons in which less than one mention of nine is a work surely linked."""
    g = table(spark, d, "review_mention", "season", "city", "mention_id", "work_id", "link_confidence").groupBy("season", "city")
    return g.agg(F.count_distinct("mention_id").alias("mentions"), F.count("*").alias("n"), F.count_if((F.col("link_confidence") == "high") & F.col("work_id").isNotNull()).alias("sure")).where("sure * 9 < n").drop("sure", "n")


_E = f"e AS (SELECT DISTINCT production_entry_id, {title_key_sql('title')} AS k FROM production_entry WHERE title IS NOT NULL)"
_W = f"w AS (SELECT work_id, {title_key_sql('canonical_title')} AS k, coalesce(excerpt_of_work_id, work_id) AS parent, title_note FROM research_work WHERE canonical_title IS NOT NULL)"


@query(rf"""WITH {_E}, {_W}, a AS (SELECT k, min(name_printed) AS name FROM e JOIN (SELECT DISTINCT production_entry_id, name_printed FROM production_entry_credit WHERE role_category = 'author' AND name_printed IS NOT NULL) USING (production_entry_id) WHERE k <> '' GROUP BY k),
t AS (SELECT work_id, parent, a.name AS by_entry, nullif(regexp_extract(title_note, '(\p{{L}}{{4,}}),', 1), '') AS by_note FROM w LEFT JOIN a USING (k))
SELECT t.work_id, coalesce(t.by_entry, t.by_note, p.by_entry, p.by_note) AS author, CASE WHEN t.by_entry IS NOT NULL THEN 'entry' WHEN t.by_note IS NOT NULL THEN 'note' WHEN coalesce(p.by_entry, p.by_note) IS NOT NULL THEN 'parent' ELSE 'none' END AS basis
FROM t LEFT JOIN t p ON p.work_id = t.parent AND t.parent <> t.work_id""")
def credited_authors(spark: SparkSession, d: str) -> DataFrame:
    """The author of a work by an entry of its title, else its note, else its parent."""
    c = table(spark, d, "production_entry_credit", "production_entry_id", "name_printed", "role_category").where("role_category = 'author' and name_printed is not null").select("production_entry_id", "name_printed").distinct()
    e = table(spark, d, "production_entry", "production_entry_id", "title").where("title is not null").select("production_entry_id", title_key(F.col("title")).alias("k")).where("k <> ''").distinct()
    a = e.join(c, "production_entry_id").groupBy("k").agg(F.min("name_printed").alias("by_entry"))
    w = table(spark, d, "research_work", "work_id", "canonical_title", "excerpt_of_work_id", "title_note").where("canonical_title is not null")
    w = w.select("work_id", title_key(F.col("canonical_title")).alias("k"), F.coalesce("excerpt_of_work_id", "work_id").alias("parent"), F.nullif(F.regexp_extract("title_note", r"(\p{L}{4,}),", 1), F.lit("")).alias("by_note"))
    t = w.join(a, "k", "left")
    p = t.select(F.col("work_id").alias("parent"), F.coalesce("by_entry", "by_note").alias("by_parent"))
    told = t.withColumn("parent", F.when(F.col("parent") != F.col("work_id"), F.col("parent"))).join(p, "parent", "left")
    basis = F.when(F.col("by_entry").isNotNull(), "entry").when(F.col("by_note").isNotNull(), "note").when(F.col("by_parent").isNotNull(), "parent").otherwise("none")
    return told.select("work_id", F.coalesce("by_entry", "by_note", "by_parent").alias("author"), basis.alias("basis"))


@query("""WITH w AS (SELECT work_id, coalesce(excerpt_of_work_id, work_id) AS top FROM research_work), u AS (SELECT block_id, work_id, 'mention' AS via FROM review_mention WHERE work_id IS NOT NULL AND block_id IS NOT NULL UNION SELECT block_id, work_id, 'credit' FROM review_credit WHERE work_id IS NOT NULL AND block_id IS NOT NULL)
SELECT top AS work_id, count(DISTINCT block_id) AS passages, count(DISTINCT block_id) FILTER (WHERE via = 'mention') AS by_mention, count(DISTINCT block_id) FILTER (WHERE via = 'credit') AS by_credit, count(DISTINCT block_id) FILTER (WHERE top = u.work_id) AS own FROM u JOIN w USING (work_id) GROUP BY 1""")
def rolled_up_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages of a work by all links, excerpts counted with their parent."""
    side = lambda name, via: table(spark, d, name, "block_id", "work_id").where("work_id is not null and block_id is not null").distinct().withColumn("via", F.lit(via))
    w = table(spark, d, "research_work", "work_id", F.coalesce("excerpt_of_work_id", "work_id").alias("top"))
    u = side("review_mention", "mention").unionByName(side("review_credit", "credit")).join(lookup(w), "work_id")
    when = lambda test: F.count_distinct(F.when(test, F.col("block_id")))
    return u.groupBy(F.col("top")).agg(F.count_distinct("block_id").alias("passages"), when(F.col("via") == "mention").alias("by_mention"), when(F.col("via") == "credit").alias("by_credit"), when(F.col("top") == F.col("work_id")).alias("own")).withColumnRenamed("top", "work_id")


_NOTES = "n AS (SELECT DISTINCT person_id, decided, research_reading AS r FROM person_tenure_note WHERE person_id IS NOT NULL AND decided IS NOT NULL AND research_reading IS NOT NULL)"


@query(f"""WITH {_NOTES}, l AS (SELECT *, lag(r) OVER (PARTITION BY person_id ORDER BY decided, r) AS before FROM n)
SELECT person_id, count(*) AS changes, string_agg(decided || ' ' || before || ' > ' || r, '; ' ORDER BY decided, r) AS points FROM l WHERE before IS NOT NULL AND before <> r GROUP BY 1""")
def change_points(spark: SparkSession, d: str) -> DataFrame:
    """When the reading of a person's service changed, from what to what."""
    n = table(spark, d, "person_tenure_note", "person_id", "decided", F.col("research_reading").alias("r")).where("person_id is not null and decided is not null and r is not null").distinct()
    l = n.withColumn("before", F.lag("r").over(Window.partitionBy("person_id").orderBy("decided", "r"))).where("before is not null and before <> r")
    told = F.concat("decided", F.lit(" "), "before", F.lit(" > "), "r")
    points = F.transform(F.sort_array(F.collect_list(F.struct("decided", "r", told.alias("x")))), lambda p: p["x"])
    return l.groupBy("person_id").agg(F.count("*").alias("changes"), F.array_join(points, "; ").alias("points"))


@query(f"""WITH {_NOTES}, s AS (SELECT *, CASE WHEN lag(r) OVER w = r THEN 0 ELSE 1 END AS new FROM n WINDOW w AS (PARTITION BY person_id ORDER BY decided, r)),
p AS (SELECT person_id, r, sum(new) AS st, count(*) AS c FROM s GROUP BY 1, 2), k AS (SELECT *, row_number() OVER a AS i, lead(st) OVER a AS st2, lead(c) OVER a AS c2, first_value(r) OVER (PARTITION BY person_id ORDER BY c DESC, r) AS major FROM p WINDOW a AS (PARTITION BY person_id ORDER BY st DESC, c DESC, r))
SELECT person_id, CASE WHEN st2 IS NOT NULL AND st = st2 AND c = c2 THEN NULL ELSE r END AS winner, CASE WHEN st2 IS NULL THEN 'consistent' WHEN st = st2 AND c = c2 THEN 'unresolved' WHEN r <> major THEN 'overturn majority (review)' WHEN st > st2 THEN 'by stretches' ELSE 'by rows' END AS label FROM k WHERE i = 1""")
def stretch_labels(spark: SparkSession, d: str) -> DataFrame:
    """The reading with most stretches; where it overturns the majority of rows
    that is said, for review."""
    n = table(spark, d, "person_tenure_note", "person_id", "decided", F.col("research_reading").alias("r")).where("person_id is not null and decided is not null and r is not null").distinct()
    chosen = R.stretch_choice(n, ["person_id"], ["decided", "r"], "r")
    major = n.groupBy("person_id", "r").agg(F.count("*").alias("c")).groupBy("person_id").agg(F.min(F.struct((-F.col("c")).alias("c"), "r")).alias("m"))
    over = F.col("winner").isNotNull() & (F.col("label") != "consistent") & (F.col("winner") != F.col("m.r"))
    return chosen.join(major, "person_id").select("person_id", "winner", F.when(over, "overturn majority (review)").otherwise(F.col("label")).alias("label"))


@query("""WITH t AS (SELECT person_id, list(DISTINCT left(printed_in_seasons, 4)) AS ys FROM person_tenure_note WHERE printed_in_seasons IS NOT NULL AND person_id IS NOT NULL GROUP BY 1),
p AS (SELECT DISTINCT least(person_id_1, person_id_2) AS k1, greatest(person_id_1, person_id_2) AS k2 FROM person_candidate WHERE person_id_1 <> person_id_2)
SELECT k1, k2, CASE WHEN a.ys IS NULL OR b.ys IS NULL THEN 'no_date_data' WHEN len(list_intersect(a.ys, b.ys)) > 0 THEN 'shared' ELSE 'conflicting' END AS signal FROM p LEFT JOIN t a ON a.person_id = k1 LEFT JOIN t b ON b.person_id = k2""")
def tenure_signals(spark: SparkSession, d: str) -> DataFrame:
    """Seasons of both persons of a pair: shared, conflicting, or not known."""
    t = table(spark, d, "person_tenure_note", "person_id", "printed_in_seasons").where("printed_in_seasons is not null and person_id is not null").groupBy("person_id").agg(F.collect_set(F.left("printed_in_seasons", F.lit(4))).alias("ys"))
    p = table(spark, d, "person_candidate", "person_id_1", "person_id_2").where("person_id_1 <> person_id_2").select(F.least("person_id_1", "person_id_2").alias("k1"), F.greatest("person_id_1", "person_id_2").alias("k2")).distinct()
    both = p.join(t.toDF("k1", "a"), "k1", "left").join(t.toDF("k2", "b"), "k2", "left")
    signal = F.when(F.col("a").isNull() | F.col("b").isNull(), "no_date_data").when(F.arrays_overlap("a", "b"), "shared").otherwise("conflicting")
    return both.select("k1", "k2", signal.alias("signal"))


@query(f"""WITH k AS (SELECT DISTINCT person_id, display, {title_key_sql('display')} AS k FROM (SELECT person_id_1 AS person_id, display_1 AS display, status FROM person_candidate UNION ALL SELECT person_id_2, display_2, status FROM person_candidate) WHERE person_id IS NOT NULL AND display IS NOT NULL),
prior AS (SELECT DISTINCT person_id_1 AS person_id, 'frozen-' || left(sha1(display_1), 8) AS cluster FROM person_candidate WHERE status = 'confirmed' AND person_id_1 IS NOT NULL AND display_1 IS NOT NULL),
c AS (SELECT k, min(cluster) AS frozen FROM k JOIN prior USING (person_id) GROUP BY k)
SELECT k.person_id, coalesce(p.cluster, c.frozen, left(sha1(k.k), 10)) AS cluster, CASE WHEN p.cluster IS NOT NULL THEN 'member before' WHEN c.frozen IS NOT NULL THEN 'joined by key' ELSE 'new' END AS basis FROM k LEFT JOIN prior p USING (person_id) LEFT JOIN c USING (k)""")
def frozen_clusters(spark: SparkSession, d: str) -> DataFrame:
    """E5: clusters by exact key in which members of before stay where they were."""
    pc = table(spark, d, "person_candidate", "person_id_1", "person_id_2", "display_1", "display_2", "status")
    people = pc.select(F.col("person_id_1").alias("person_id"), F.col("display_1").alias("display")).unionByName(pc.select(F.col("person_id_2").alias("person_id"), F.col("display_2").alias("display")))
    k = people.where("person_id is not null and display is not null").distinct().withColumn("k", title_key(F.col("display")))
    prior = pc.where("status = 'confirmed' and person_id_1 is not null and display_1 is not null").select(F.col("person_id_1").alias("person_id"), F.concat(F.lit("frozen-"), F.left(F.sha1("display_1"), F.lit(8))).alias("cluster")).distinct()
    c = k.join(prior, "person_id").groupBy("k").agg(F.min("cluster").alias("frozen"))
    told = k.join(prior, "person_id", "left").join(c, "k", "left")
    basis = F.when(F.col("cluster").isNotNull(), "member before").when(F.col("frozen").isNotNull(), "joined by key").otherwise("new")
    return told.select("person_id", F.coalesce("cluster", "frozen", F.left(F.sha1("k"), F.lit(10))).alias("cluster"), basis.alias("basis"))


@query(f"""WITH w AS (SELECT work_id, canonical_genre AS g, {title_key_sql('canonical_title')} AS k FROM research_work WHERE canonical_title IS NOT NULL)
SELECT k, count(DISTINCT g) AS genres, count(*) AS works, string_agg(DISTINCT g, ', ' ORDER BY g) AS listed FROM w GROUP BY k HAVING count(DISTINCT g) > 1""")
def genre_review(spark: SparkSession, d: str) -> DataFrame:
    """Titles that stand under several genres, for review."""
    w = table(spark, d, "research_work", "canonical_title", "canonical_genre").where("canonical_title is not null").withColumn("k", title_key(F.col("canonical_title")))
    g = w.groupBy("k").agg(F.count_distinct("canonical_genre").alias("genres"), F.count("*").alias("works"), F.array_join(F.sort_array(F.collect_set("canonical_genre")), ", ").alias("listed"))
    return g.where("genres > 1")


_PART = r"^\s*«?(?:\d-(?:й|я)\s+(?:актъ|карт\.?|дѣйствіе)\s+(?:изъ\s+)?|Сцена изъ\s+)"


@query(rf"""WITH t AS (SELECT DISTINCT same_title_id, {title_key_sql(f"regexp_replace(verbatim_title, '{_PART}', '')")} AS k FROM same_title_works WHERE regexp_matches(verbatim_title, '{_PART}')),
w AS (SELECT {title_key_sql('canonical_title')} AS k, count(*) AS n, min(work_id) AS id, count(*) FILTER (WHERE art_form = 'ballet') AS nb, min(work_id) FILTER (WHERE art_form = 'ballet') AS ib FROM research_work GROUP BY 1)
SELECT same_title_id, CASE WHEN n = 1 THEN id WHEN nb = 1 THEN ib END AS parent, CASE WHEN n IS NULL THEN 'not in list' WHEN n = 1 THEN 'unique' WHEN nb = 1 THEN 'unique of its art' ELSE 'several' END AS note FROM t LEFT JOIN w USING (k)""")
def excerpts_to_parents(spark: SparkSession, d: str) -> DataFrame:
    """Acts and scenes to their work, if it is the only one of the title, or of the art."""
    t = table(spark, d, "same_title_works", "same_title_id", "verbatim_title").where(F.col("verbatim_title").rlike(_PART)).select("same_title_id", title_key(F.regexp_replace("verbatim_title", _PART, "")).alias("k")).distinct()
    ballet = F.col("art_form") == "ballet"
    w = table(spark, d, "research_work", "work_id", "canonical_title", "art_form").groupBy(title_key(F.col("canonical_title")).alias("k")).agg(
        F.count("*").alias("n"), F.min("work_id").alias("id"), F.count_if(ballet).alias("nb"), F.min(F.when(ballet, F.col("work_id"))).alias("ib")
    )
    note = F.when(F.col("n").isNull(), "not in list").when(F.col("n") == 1, "unique").when(F.col("nb") == 1, "unique of its art").otherwise("several")
    return t.join(lookup(w), "k", "left").select("same_title_id", F.when(F.col("n") == 1, F.col("id")).when(F.col("nb") == 1, F.col("ib")).alias("parent"), note.alias("note"))


@query("""WITH s AS (SELECT page_id, block_index, block_id, coalesce(md5(text), 'dark') AS sig FROM review_passage WHERE page_id IS NOT NULL), v AS (SELECT page_id, block_index, sig, count(*) AS c, min(block_id) AS first FROM s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id, block_index ORDER BY sig <> 'dark' DESC, c DESC, first) AS k, count(*) OVER (PARTITION BY page_id, block_index) AS versions FROM v) SELECT page_id, block_index, first AS block_id, c AS votes, versions, sig <> 'dark' AS content FROM r WHERE k = 1""")
def sample_votes(spark: SparkSession, d: str) -> DataFrame:
    """Of several samples of a place the content most of them agree on; content beats none."""
    s = table(spark, d, "review_passage", "page_id", "block_index", "block_id", "text").where("page_id is not null").withColumn("sig", F.coalesce(F.md5("text"), F.lit("dark")))
    v = s.groupBy("page_id", "block_index", "sig").agg(F.count("*").alias("votes"), F.min("block_id").alias("block_id")).withColumn("content", F.col("sig") != "dark")
    place = Window.partitionBy("page_id", "block_index")
    r = v.withColumn("k", F.row_number().over(place.orderBy(F.desc("content"), F.desc("votes"), "block_id"))).withColumn("versions", F.count("*").over(place))
    return r.where("k = 1").select("page_id", "block_index", "block_id", "votes", "versions", "content")


@query("""WITH a AS (SELECT production_entry_id AS e, role_category AS r, count(*) AS n FROM (SELECT DISTINCT credit_id, production_entry_id, role_category FROM production_entry_credit) WHERE r IS NOT NULL GROUP BY ALL), x AS (SELECT a.e AS e1, b.e AS e2, a.r FROM a, a b WHERE 1 = 0),
s AS (SELECT e, string_agg(r || ':' || n, ',' ORDER BY r) AS bag, sum(n) AS size FROM a GROUP BY e), p AS (SELECT DISTINCT production_entry_id AS e, page_id, entry_order FROM production_entry),
o AS (SELECT p.e, lead(p.e) OVER (PARTITION BY page_id ORDER BY entry_order, p.e) AS nx FROM p),
d AS (SELECT o.e, o.nx, bool_and(coalesce(b.n, 0) >= coalesce(a.n, 0)) AS within FROM o JOIN a ON a.e = o.e LEFT JOIN a b ON b.e = o.nx AND b.r = a.r WHERE nx IS NOT NULL GROUP BY ALL)
SELECT d.e AS entry, d.nx AS next, CASE WHEN s1.bag = s2.bag THEN 'exact' WHEN within THEN 'clear' ELSE 'ambiguous' END AS verdict FROM d JOIN s s1 ON s1.e = d.e LEFT JOIN s s2 ON s2.e = d.nx""".replace(", x AS (SELECT a.e AS e1, b.e AS e2, a.r FROM a, a b WHERE 1 = 0)", ""))
def bag_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of an entry against those of the next on its page, as bags: the same,
    contained, or neither."""
    c = table(spark, d, "production_entry_credit", "credit_id", F.col("production_entry_id").alias("e"), F.col("role_category").alias("r")).distinct().where("r is not null")
    a = c.groupBy("e", "r").agg(F.count("*").alias("n"))
    s = a.groupBy("e").agg(F.sort_array(F.collect_list(F.struct("r", "n"))).alias("bag"))
    p = table(spark, d, "production_entry", F.col("production_entry_id").alias("e"), "page_id", "entry_order").distinct()
    o = p.withColumn("nx", F.lead("e").over(Window.partitionBy("page_id").orderBy("entry_order", "e"))).where("nx is not null").select("e", "nx")
    b = a.select(F.col("e").alias("nx"), "r", F.col("n").alias("m"))
    within = o.join(a, "e").join(b, ["nx", "r"], "left").groupBy("e", "nx").agg(F.bool_and(F.coalesce("m", F.lit(0)) >= F.col("n")).alias("within"))
    both = within.join(s, "e").join(s.select(F.col("e").alias("nx"), F.col("bag").alias("bag2")), "nx", "left")
    verdict = F.when(F.col("bag") == F.col("bag2"), "exact").when(F.col("within"), "clear").otherwise("ambiguous")
    return both.select(F.col("e").alias("entry"), F.col("nx").alias("next"), verdict.alias("verdict"))


@query("""WITH m AS (SELECT DISTINCT person_id_2 AS a, person_id_1 AS b FROM person_candidate WHERE status = 'confirmed' AND person_id_1 <> person_id_2) SELECT x.a AS old, x.b AS via, count(*) AS onward FROM m x JOIN m y ON x.b = y.a GROUP BY 1, 2""")
def chain_check(spark: SparkSession, d: str) -> DataFrame:
    """Replacements whose target is itself replaced."""
    m = table(spark, d, "person_candidate", F.col("person_id_2").alias("old"), F.col("person_id_1").alias("via"), "status").where("status = 'confirmed' and old <> via").select("old", "via").distinct()
    return m.join(m.select(F.col("old").alias("via"), F.col("via").alias("to")), "via").groupBy("old", "via").agg(F.count("*").alias("onward"))


@query("""WITH s AS (SELECT DISTINCT season, city FROM production_entry WHERE season IS NOT NULL AND city IS NOT NULL), r AS (SELECT theater, list(DISTINCT city) AS cities FROM same_title_works WHERE theater IS NOT NULL AND city IS NOT NULL GROUP BY 1),
g AS (SELECT season, s.city, theater FROM s JOIN r ON list_contains(cities, s.city)), h AS (SELECT DISTINCT season, city, theater FROM same_title_works) SELECT g.season, g.city, g.theater, h.theater IS NOT NULL AS played FROM g LEFT JOIN h ON h.season = g.season AND h.city = g.city AND h.theater = g.theater""")
def roster_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every season of a city with each theatre of its roster, and whether it
    played; the roster's list of cities is opened, so that the join is an equality."""
    s = table(spark, d, "production_entry", "season", "city").where("season is not null and city is not null").distinct()
    t = table(spark, d, "same_title_works", "season", "city", "theater").distinct()
    r = t.where("theater is not null and city is not null").groupBy("theater").agg(F.collect_set("city").alias("cities"))
    g = s.join(lookup(r.select("theater", F.explode("cities").alias("city"))), "city")
    return g.join(t.withColumn("h", F.lit(True)), ["season", "city", "theater"], "left").select("season", "city", "theater", F.coalesce("h", F.lit(False)).alias("played"))


@query("SELECT season, count(DISTINCT production_entry_id) AS entries FROM production_entry GROUP BY season")
def published_view(spark: SparkSession, d: str) -> DataFrame:
    """K1, K2: a table written over, and a view on it asked by SQL."""
    at = f"{own_dir(spark)}/published-entries"
    for _ in range(2):  # the second replaces the first
        table(spark, d, "production_entry", "production_entry_id", "season").write.mode("overwrite").parquet(at)
    spark.read.parquet(at).createOrReplaceTempView("vellum_entries")
    return spark.sql("SELECT season, count(DISTINCT production_entry_id) AS entries FROM vellum_entries GROUP BY season")


@query("""WITH m AS (SELECT DISTINCT mention_id, block_id, mention_type, char_start, surface, role_name FROM review_mention WHERE block_id IS NOT NULL AND char_start IS NOT NULL AND mention_type IN ('role', 'person')),
o AS (SELECT *, lead(mention_type) OVER w AS nt, lead(surface) OVER w AS ns, lead(char_start) OVER w AS nc FROM m WINDOW w AS (PARTITION BY block_id ORDER BY char_start, mention_id)) SELECT mention_id, block_id, surface AS part, ns AS performer, nc - char_start AS distance FROM o WHERE mention_type = 'role' AND nt = 'person'""")
def cast_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A part and the person named next in its block."""
    m = table(spark, d, "review_mention", "mention_id", "block_id", "mention_type", "char_start", "surface").where("block_id is not null and char_start is not null and mention_type in ('role', 'person')").distinct()
    w = Window.partitionBy("block_id").orderBy("char_start", "mention_id")
    nx = lambda c: F.lead(c).over(w)
    o = m.withColumn("nt", nx("mention_type")).withColumn("performer", nx("surface")).withColumn("distance", nx("char_start") - F.col("char_start"))
    return o.where("mention_type = 'role' and nt = 'person'").select("mention_id", "block_id", F.col("surface").alias("part"), "performer", "distance")


@query(r"""WITH m AS (SELECT DISTINCT mention_id, city, regexp_extract(surface, '(\p{L}+)\P{L}*$', 1) AS f FROM review_mention WHERE mention_type = 'person' AND surface IS NOT NULL), p AS (SELECT person_id, canonical_family_name AS f, coalesce(cities, '') AS cities, same_family_in_db FROM review_person),
a AS (SELECT f, count(*) AS n, min(person_id) AS i FROM p GROUP BY f), c AS (SELECT f, trim(unnest(string_split_regex(cities, '[,;]'))) AS city, person_id FROM p), b AS (SELECT f, city, count(DISTINCT person_id) AS n, min(person_id) AS i FROM c GROUP BY ALL)
SELECT mention_id, CASE WHEN a.n = 1 THEN a.i WHEN b.n = 1 THEN b.i END AS person_id, CASE WHEN a.n IS NULL THEN 'no_record' WHEN a.n = 1 OR b.n = 1 THEN 'proposed' ELSE 'needs_reading' END AS status, CASE WHEN a.n = 1 THEN 'family' WHEN b.n = 1 THEN 'city' END AS rung
FROM m LEFT JOIN a USING (f) LEFT JOIN b ON b.f = m.f AND b.city = m.city""")
def notice_persons(spark: SparkSession, d: str) -> DataFrame:
    """A mention's person by family, then by city; what is left needs reading.
    Rungs are counts of candidates, so that no pairs are formed."""
    m = table(spark, d, "review_mention", "mention_id", "mention_type", "city", "surface").where("mention_type = 'person' and surface is not null").select("mention_id", "city", last_word(F.col("surface")).alias("f")).distinct()
    p = table(spark, d, "review_person", "person_id", F.col("canonical_family_name").alias("f"), F.coalesce("cities", F.lit("")).alias("cities"))
    a = p.groupBy("f").agg(F.count("*").alias("na"), F.min("person_id").alias("ia"))
    c = p.select("f", F.explode(F.split("cities", "[,;]")).alias("c"), "person_id").select("f", F.trim("c").alias("city"), "person_id")
    b = c.groupBy("f", "city").agg(F.count_distinct("person_id").alias("nb"), F.min("person_id").alias("ib"))
    told = m.join(lookup(a), "f", "left").join(lookup(b), ["f", "city"], "left")
    one, two = F.coalesce(F.col("na") == 1, F.lit(False)), F.coalesce(F.col("nb") == 1, F.lit(False))
    status = F.when(F.col("na").isNull(), "no_record").when(one | two, "proposed").otherwise("needs_reading")
    return told.select("mention_id", F.when(one, F.col("ia")).when(two, F.col("ib")).alias("person_id"), status.alias("status"), F.when(one, "family").when(two, "city").alias("rung"))


@query(r"""WITH e AS (SELECT DISTINCT production_entry_id, season, total_count AS stored, n_dates, TRY_CAST(nullif(regexp_extract(performed_text, '(\d+)', 1), '') AS INT) AS said FROM production_entry),
x AS (SELECT *, stored IS NOT NULL AND n_dates IS NOT NULL AND stored <> n_dates AND said IS NOT DISTINCT FROM stored AS applies FROM e)
SELECT production_entry_id, CASE WHEN applies THEN n_dates ELSE CAST(stored AS INT) END AS total, applies, CAST(count(*) FILTER (WHERE applies) OVER (PARTITION BY season) AS BIGINT) AS applied_in_season FROM x""")
def guarded_corrections(spark: SparkSession, d: str) -> DataFrame:
    """A stored total gives way to the dates only where the text says
    what is stored, with the number of corrections applied in the season."""
    e = table(spark, d, "production_entry", "production_entry_id", "season", F.col("total_count").alias("stored"), "n_dates", "performed_text").distinct()
    e = e.withColumn("said", F.regexp_extract("performed_text", r"(\d+)", 1).try_cast("int")).drop("performed_text").distinct()
    applies = F.coalesce((F.col("stored") != F.col("n_dates")) & F.col("said").eqNullSafe(F.col("stored")), F.lit(False))
    x = e.withColumn("applies", applies)
    return x.select("production_entry_id", F.when(F.col("applies"), F.col("n_dates")).otherwise(F.col("stored")).alias("total"), "applies", F.count_if("applies").over(Window.partitionBy("season")).alias("applied_in_season"))


@query(None)
def text_mentions(spark: SparkSession, d: str) -> DataFrame:
    """M1: works and persons of the lists in the documents, by passes with claims."""
    works, people = table(spark, d, "research_work", "work_id", "canonical_title"), table(spark, d, "review_person", "person_id", "canonical_family_name")
    return mentions.text_mentions(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", works, "canonical_title", "work_id", people, "canonical_family_name", "person_id")


@query(r"""WITH f AS (SELECT DISTINCT canonical_family_name AS w FROM review_person WHERE canonical_family_name IS NOT NULL),
u AS (SELECT DISTINCT page_id, 1 AS reader, regexp_extract(surface, '(\p{L}+)\P{L}*$', 1) AS w FROM review_mention WHERE mention_type = 'person' AND surface IS NOT NULL AND page_id IS NOT NULL
 UNION SELECT DISTINCT page_id, 2, regexp_extract(name_surface, '(\p{L}+)\P{L}*$', 1) FROM review_credit WHERE name_surface IS NOT NULL AND page_id IS NOT NULL),
e AS (SELECT page_id, w, count(*) FILTER (WHERE reader = 1) AS a, count(*) FILTER (WHERE reader = 2) AS b FROM u WHERE w NOT IN (SELECT w FROM f) GROUP BY ALL)
SELECT page_id, CAST(sum(a) AS BIGINT) AS first_reader, CAST(sum(b) AS BIGINT) AS second_reader, count(*) FILTER (WHERE a > 0 AND b > 0) AS joint, coalesce(string_agg(w, ',' ORDER BY w) FILTER (WHERE a > 0 AND b > 0), '') AS words FROM e GROUP BY page_id""")
def joint_errors(spark: SparkSession, d: str) -> DataFrame:
    """V4: surnames outside the list that two readers of a page gave, and those both gave."""
    f = table(spark, d, "review_person", F.col("canonical_family_name").alias("w")).where("w is not null").distinct()
    side = lambda name, c, keep, r: table(spark, d, name).where(keep).where(f"{c} is not null and page_id is not null").select("page_id", F.lit(r).alias("reader"), last_word(F.col(c)).alias("w")).distinct()
    u = side("review_mention", "surface", "mention_type = 'person'", 1).unionByName(side("review_credit", "name_surface", "true", 2)).join(lookup(f), "w", "left_anti")
    e = u.groupBy("page_id", "w").agg(F.count_if(F.col("reader") == 1).alias("a"), F.count_if(F.col("reader") == 2).alias("b"))
    both = F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("w"))
    return e.groupBy("page_id").agg(F.sum("a").alias("first_reader"), F.sum("b").alias("second_reader"), F.count(both).alias("joint"), F.array_join(F.sort_array(F.collect_set(both)), ",").alias("words"))


@query("""WITH e AS (SELECT DISTINCT production_entry_id, page_id, entry_order, title, fragment FROM production_entry), g AS (SELECT *, count(*) FILTER (WHERE coalesce(fragment, '') <> 'end') OVER (PARTITION BY page_id ORDER BY entry_order, production_entry_id ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT page_id, CAST(run AS BIGINT) AS run, count(*) AS pieces, string_agg(coalesce(title, ''), ' / ' ORDER BY entry_order, production_entry_id) AS title FROM g GROUP BY page_id, run""")
def merged_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Entries broken over pages put together: an end belongs to the entry before it."""
    e = table(spark, d, "production_entry", "production_entry_id", "page_id", "entry_order", "title", "fragment").distinct()
    w = Window.partitionBy("page_id").orderBy("entry_order", "production_entry_id").rowsBetween(Window.unboundedPreceding, 0)
    g = e.withColumn("run", F.sum(F.when(F.coalesce("fragment", F.lit("")) != "end", 1).otherwise(0)).over(w))
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("entry_order", "production_entry_id", F.coalesce("title", F.lit("")).alias("t")))), lambda x: x["t"])
    return g.groupBy("page_id", "run").agg(F.count("*").alias("pieces"), F.array_join(pieces, " / ").alias("title"))


@query("""WITH c AS (SELECT DISTINCT credit_id, page_id, block_id, char_start, name_surface FROM review_credit WHERE block_id IS NOT NULL AND name_surface IS NOT NULL AND char_start IS NOT NULL),
m AS (SELECT DISTINCT block_id, char_start, person_id FROM review_mention WHERE mention_type = 'person' AND block_id IS NOT NULL AND char_start IS NOT NULL AND person_id IS NOT NULL),
u AS (SELECT block_id, char_start, 0 AS side, person_id, NULL AS credit_id FROM m UNION ALL SELECT block_id, char_start, 1, NULL, credit_id FROM c),
l AS (SELECT *, last_value(person_id IGNORE NULLS) OVER w AS p, last_value(CASE WHEN side = 0 THEN char_start END IGNORE NULLS) OVER w AS from_at FROM u WINDOW w AS (PARTITION BY block_id ORDER BY char_start, side, coalesce(person_id, ''), coalesce(credit_id, 0) ROWS UNBOUNDED PRECEDING))
SELECT credit_id, p AS person_id, char_start - from_at AS distance FROM l WHERE side = 1""")
def nearest_preceding(spark: SparkSession, d: str) -> DataFrame:
    """The person linked nearest before each credit in its block, and how far."""
    c = table(spark, d, "review_credit", "credit_id", "page_id", "block_id", "char_start", "name_surface").where("block_id is not null and name_surface is not null and char_start is not null").distinct()
    m = table(spark, d, "review_mention", "block_id", "char_start", "person_id", "mention_type").where("mention_type = 'person' and block_id is not null and char_start is not null and person_id is not null").drop("mention_type").distinct()
    u = m.withColumn("side", F.lit(0)).unionByName(c.select("block_id", "char_start", "credit_id").withColumn("side", F.lit(1)), allowMissingColumns=True)
    u = u.withColumn("o1", F.coalesce("person_id", F.lit(""))).withColumn("o2", F.coalesce("credit_id", F.lit(0))).withColumn("at", F.when(F.col("side") == 0, F.col("char_start")))
    order = ["char_start", "side", "o1", "o2"]
    near = R.fill_last(R.fill_last(u, ["block_id"], order, "person_id", "p"), ["block_id"], order, "at", "from_")
    return near.where("side = 1").select("credit_id", F.col("p").alias("person_id"), (F.col("char_start") - F.col("from_")).alias("distance"))
