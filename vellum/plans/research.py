"""Queries over the yearbook tables: titles, credits, performances, names, ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import names as N
from vellum.functions.text import natural_id, words
from vellum.operators import lifecycle as C
from vellum.operators.sizing import lookup
from vellum.session import materialize, settled
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


_key = N.title_key_sql
_ENTRIES = f"e AS (SELECT DISTINCT production_entry_id, season, city, {_key('title')} AS k FROM production_entry WHERE title IS NOT NULL)"
_WORKS = f"w AS (SELECT work_id, {_key('canonical_title')} AS k FROM research_work WHERE canonical_title IS NOT NULL)"


def _entries(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "production_entry", "production_entry_id", "season", "city", "title").where("title is not null")
    return rows.select("production_entry_id", "season", "city", N.title_key(F.col("title")).alias("k")).distinct()


def _works(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "research_work", "work_id", "canonical_title").where("canonical_title is not null").select("work_id", N.title_key(F.col("canonical_title")).alias("k"))


@query(f"WITH {_ENTRIES}, {_WORKS} SELECT 'entry' AS kind, production_entry_id AS id, k FROM e UNION ALL SELECT 'work', work_id, k FROM w")
def title_keys(spark: SparkSession, d: str) -> DataFrame:
    """keys of all titles, by which entries and works meet."""
    e = _entries(spark, d).select(F.lit("entry").alias("kind"), F.col("production_entry_id").alias("id"), "k")
    return e.unionByName(_works(spark, d).select(F.lit("work").alias("kind"), F.col("work_id").alias("id"), "k"))


_FULL = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in N.GENRES.items())


@query(rf"""WITH g AS (SELECT DISTINCT lower(canonical_genre) AS g FROM research_work WHERE canonical_genre IS NOT NULL),
t AS (SELECT DISTINCT same_title_id, verbatim_title AS v, lower(regexp_extract(verbatim_title, '{N.SUFFIX}', 2)) AS s FROM same_title_works WHERE verbatim_title IS NOT NULL)
SELECT same_title_id, CASE WHEN g IS NOT NULL THEN regexp_extract(v, '{N.SUFFIX}', 1) ELSE v END AS title, CASE WHEN g IS NOT NULL THEN CASE s {_FULL} ELSE s END END AS genre FROM t LEFT JOIN g ON s = g""")
def genre_suffixes(spark: SparkSession, d: str) -> DataFrame:
    """genre behind a title, checked against the genres of the list of works."""
    # the genres of a list are a handful of words; read to state the rule
    known = [r.g for r in table(spark, d, "research_work", "canonical_genre").select(F.lower("canonical_genre").alias("g")).where("g is not null").distinct().limit(1000).collect()]
    t = table(spark, d, "same_title_works", "same_title_id", "verbatim_title").where("verbatim_title is not null").distinct()
    title, genre = N.genre_split(F.col("verbatim_title"), known)
    return t.select("same_title_id", title.alias("title"), genre.alias("genre"))


_SEX = "CASE WHEN regexp_matches({s}, '(ова|ева|ина|ына|ая)$') THEN 'f' WHEN regexp_matches({s}, '(ов|ев|ин|ын)ъ?$|(ій|ый)$') THEN 'm' ELSE '' END"
_HON = "CASE WHEN regexp_matches(honorific_printed, '^г-ж') THEN 'f' WHEN regexp_matches(honorific_printed, '^(г\\.|г-н|барон)') THEN 'm' ELSE '' END"


@query(rf"""WITH t AS (SELECT DISTINCT credit_id, name_printed, regexp_extract(name_printed, '(\p{{L}}+)\P{{L}}*$', 1) AS s, {_HON} AS h FROM production_entry_credit WHERE name_printed IS NOT NULL),
x AS (SELECT credit_id, h AS by_honorific, {_SEX.format(s='s')} AS by_surname FROM t)
SELECT credit_id, by_honorific, by_surname, NOT (by_honorific <> '' AND by_surname <> '' AND by_honorific <> by_surname) AS linked,
CASE WHEN by_honorific <> '' AND by_surname <> '' AND by_honorific <> by_surname THEN 'gender contradiction' END AS flag FROM x""")
def gender_guard(spark: SparkSession, d: str) -> DataFrame:
    """Gender by honorific and by surname; a contradiction unlinks and flags."""
    t = table(spark, d, "production_entry_credit", "credit_id", "name_printed", "honorific_printed").where("name_printed is not null").distinct()
    x = t.select("credit_id", N.gender_of_honorific(F.col("honorific_printed")).alias("by_honorific"), N.gender_of_surname(N.last_word(F.col("name_printed"))).alias("by_surname"))
    clash = (F.col("by_honorific") != "") & (F.col("by_surname") != "") & (F.col("by_honorific") != F.col("by_surname"))
    return x.withColumn("linked", ~clash).withColumn("flag", F.when(clash, "gender contradiction"))


_ENDS = ", ".join(f"('{e}', '{o}')" for e, others in N.DECLENSION for o in others.split())
_FORMS = f"""f AS (SELECT DISTINCT canonical_family_name AS f FROM review_person WHERE canonical_family_name IS NOT NULL), ends(e, o) AS (VALUES {_ENDS}),
forms AS (SELECT left(f, length(f) - length(e)) || o AS form, min(f) AS f FROM f JOIN ends ON ends_with(f, e) GROUP BY 1),
stems AS (SELECT regexp_replace(f, '[аеиійоуыѣъьюя]+$', '') AS st, min(f) AS f FROM f GROUP BY 1)"""
_LINKED = rf"""m AS (SELECT DISTINCT mention_id, block_id, season, regexp_extract(surface, '(\p{{L}}+)\P{{L}}*$', 1) AS word FROM review_mention WHERE mention_type = 'person' AND surface IS NOT NULL),
linked AS (SELECT mention_id, block_id, season, word, coalesce(f.f, forms.f, stems.f) AS family, CASE WHEN f.f IS NOT NULL THEN 'exact' WHEN forms.f IS NOT NULL THEN 'declined' WHEN stems.f IS NOT NULL THEN 'stem' ELSE 'none' END AS method
FROM m LEFT JOIN f ON word = f.f LEFT JOIN forms ON word = form LEFT JOIN stems ON regexp_replace(word, '[аеиійоуыѣъьюя]+$', '') = st)"""


def _linked_mentions(spark: SparkSession, d: str) -> DataFrame:
    f = materialize(table(spark, d, "review_person", "canonical_family_name").where("canonical_family_name is not null").select(F.col("canonical_family_name").alias("f")).distinct())
    forms = materialize(f.select("f", F.explode(N.declined(F.col("f"))).alias("word")).groupBy("word").agg(F.min("f").alias("by_form")))
    stems = materialize(f.groupBy(N.word_stem(F.col("f")).alias("stem")).agg(F.min("f").alias("by_stem")))
    m = table(spark, d, "review_mention", "mention_id", "block_id", "season", "mention_type", "surface").where("mention_type = 'person' and surface is not null")
    m = m.select("mention_id", "block_id", "season", N.last_word(F.col("surface")).alias("word")).distinct().withColumn("stem", N.word_stem(F.col("word")))
    met = m.join(lookup(f.select(F.col("f").alias("word"), F.col("f").alias("exact"))), "word", "left").join(lookup(forms), "word", "left").join(lookup(stems), "stem", "left")
    method = F.when(F.col("exact").isNotNull(), "exact").when(F.col("by_form").isNotNull(), "declined").when(F.col("by_stem").isNotNull(), "stem").otherwise("none")
    return met.select("mention_id", "block_id", "season", "word", F.coalesce("exact", "by_form", "by_stem").alias("family"), method.alias("method"))


@query(f"WITH {_FORMS}, {_LINKED} SELECT mention_id, word, family, method FROM linked")
@settled
def declined_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Person mentions by surname, then by its cases, then by its stem."""
    return _linked_mentions(spark, d).select("mention_id", "word", "family", "method")


@query(f"""WITH {_FORMS}, {_LINKED} SELECT word, count(*) AS n, count(DISTINCT block_id) AS blocks, min(season) AS first_season FROM linked WHERE method = 'none' GROUP BY word HAVING count(*) >= 2""")
@settled
def unknown_names(spark: SparkSession, d: str) -> DataFrame:
    """M5: surnames mentioned that no tier knows, with how often and since when."""
    left = _linked_mentions(spark, d).where("method = 'none'")
    return left.groupBy("word").agg(F.count("*").alias("n"), F.count_distinct("block_id").alias("blocks"), F.min("season").alias("first_season")).where("n >= 2")


@query("""WITH e AS (SELECT DISTINCT production_entry_id, page_id, entry_order, fragment FROM production_entry),
l AS (SELECT *, lag(production_entry_id) OVER (PARTITION BY page_id ORDER BY entry_order, production_entry_id) AS before FROM e)
SELECT production_entry_id, CASE WHEN fragment = 'end' THEN before END AS continues, CASE WHEN fragment = 'end' AND before IS NULL THEN 'no entry before on the page' WHEN fragment = 'end' THEN 'linked' END AS note FROM l""")
def continuation_links(spark: SparkSession, d: str) -> DataFrame:
    """The end of an entry linked to the entry before it on its page."""
    e = table(spark, d, "production_entry", "production_entry_id", "page_id", "entry_order", "fragment").distinct()
    before = F.lag("production_entry_id").over(Window.partitionBy("page_id").orderBy("entry_order", "production_entry_id"))
    end = F.col("fragment") == "end"
    l = e.withColumn("before", before)
    return l.select("production_entry_id", F.when(end, F.col("before")).alias("continues"), F.when(end & F.col("before").isNull(), "no entry before on the page").when(end, "linked").alias("note"))


_NOTICES = "n AS (SELECT season, city, work_id, count(DISTINCT credit_id) AS c FROM review_credit WHERE work_id IS NOT NULL GROUP BY ALL)"


@query(f"""WITH {_ENTRIES}, {_WORKS}, {_NOTICES},
x AS (SELECT e.production_entry_id, w.work_id, coalesce(c, 0) AS notices FROM e JOIN w ON e.k = w.k AND e.k <> '' LEFT JOIN n ON n.work_id = w.work_id AND n.season = e.season AND n.city = e.city),
r AS (SELECT *, row_number() OVER (PARTITION BY production_entry_id ORDER BY notices DESC, work_id) AS k, count(*) OVER (PARTITION BY production_entry_id) AS works, lead(notices) OVER (PARTITION BY production_entry_id ORDER BY notices DESC, work_id) AS next FROM x)
SELECT production_entry_id, work_id, notices, works, CASE WHEN works = 1 THEN 'only work of the title' WHEN notices > next THEN 'most notices' ELSE 'tie, first id' END AS work_basis FROM r WHERE k = 1""")
@settled
def entry_best_work(spark: SparkSession, d: str) -> DataFrame:
    """The work of an entry among those of its title, by the notices of its
    season and city, with the reason."""
    n = table(spark, d, "review_credit", "season", "city", "work_id", "credit_id").where("work_id is not null").groupBy("season", "city", "work_id").agg(F.count_distinct("credit_id").alias("c"))
    x = _entries(spark, d).where("k <> ''").join(lookup(materialize(_works(spark, d))), "k").join(n, ["season", "city", "work_id"], "left")
    x = x.select("production_entry_id", "work_id", F.coalesce("c", F.lit(0)).alias("notices"))
    order = Window.partitionBy("production_entry_id").orderBy(F.desc("notices"), "work_id")
    r = x.withColumn("k", F.row_number().over(order)).withColumn("works", F.count("*").over(Window.partitionBy("production_entry_id"))).withColumn("next", F.lead("notices").over(order))
    basis = F.when(F.col("works") == 1, "only work of the title").when(F.col("notices") > F.col("next"), "most notices").otherwise("tie, first id")
    return r.where("k = 1").select("production_entry_id", "work_id", "notices", "works", basis.alias("work_basis"))


_SHOWS = "s AS (SELECT DISTINCT date, city, theater, time_of_day FROM same_title_works WHERE date IS NOT NULL AND city IS NOT NULL)"


@query(f"""WITH {_SHOWS}, c AS (SELECT DISTINCT credit_id, date_undate AS date, city FROM review_credit WHERE date_undate IS NOT NULL),
g AS (SELECT c.credit_id, count(s.date) AS n, count(*) FILTER (WHERE time_of_day = 'evening') AS ev, min(theater) AS th, min(theater) FILTER (WHERE time_of_day = 'evening') AS eth FROM c LEFT JOIN s ON s.date = c.date AND s.city = c.city GROUP BY 1)
SELECT credit_id, CASE WHEN n = 1 THEN th WHEN n > 1 AND ev = 1 THEN eth END AS theater, CASE n WHEN 0 THEN 'no performance listed' WHEN 1 THEN 'only performance' ELSE CASE WHEN ev = 1 THEN 'evening performance' ELSE 'several performances' END END AS note FROM g""")
def performance_links(spark: SparkSession, d: str) -> DataFrame:
    """A notice linked to the performance of its date if that is unique, or the
    only one in the evening; the note says why not."""
    s = table(spark, d, "same_title_works", "date", "city", "theater", "time_of_day").where("date is not null and city is not null").distinct()
    per_day = s.groupBy("date", "city").agg(
        F.count("*").alias("n"), F.count_if(F.col("time_of_day") == "evening").alias("ev"), F.min("theater").alias("th"), F.min(F.when(F.col("time_of_day") == "evening", F.col("theater"))).alias("eth")
    )
    c = table(spark, d, "review_credit", "credit_id", "date_undate", "city").where("date_undate is not null").distinct().withColumnRenamed("date_undate", "date")
    g = c.join(per_day, ["date", "city"], "left")
    one = F.col("n") == 1
    evening = (F.col("n") > 1) & (F.col("ev") == 1)
    note = F.when(F.col("n").isNull(), "no performance listed").when(one, "only performance").when(evening, "evening performance").otherwise("several performances")
    return g.select("credit_id", F.when(one, F.col("th")).when(evening, F.col("eth")).alias("theater"), note.alias("note"))


@query(f"""WITH p AS (SELECT date, city, {_key('verbatim_title')} AS k FROM same_title_works WHERE date IS NOT NULL AND city IS NOT NULL AND verbatim_title IS NOT NULL),
g AS (SELECT date, city, count(DISTINCT k) AS n, min(k) AS k FROM p WHERE k <> '' GROUP BY ALL), c AS (SELECT DISTINCT credit_id, date_undate AS date, city FROM review_credit WHERE work_id IS NULL AND date_undate IS NOT NULL)
SELECT credit_id, CASE WHEN n = 1 THEN k END AS title_key, CASE WHEN n IS NULL THEN 'no programme' WHEN n = 1 THEN 'programme of the day' ELSE 'several programmes' END AS note FROM c LEFT JOIN g USING (date, city)""")
def unnamed_programmes(spark: SparkSession, d: str) -> DataFrame:
    """M7: notices that name no work, by the programme of their date."""
    p = table(spark, d, "same_title_works", "date", "city", "verbatim_title").where("date is not null and city is not null").withColumn("k", N.title_key(F.col("verbatim_title"))).where("k <> ''")
    g = p.groupBy("date", "city").agg(F.count_distinct("k").alias("n"), F.min("k").alias("k"))
    c = table(spark, d, "review_credit", "credit_id", "date_undate", "city", "work_id").where("work_id is null and date_undate is not null").select("credit_id", F.col("date_undate").alias("date"), "city").distinct()
    note = F.when(F.col("n").isNull(), "no programme").when(F.col("n") == 1, "programme of the day").otherwise("several programmes")
    return c.join(g, ["date", "city"], "left").select("credit_id", F.when(F.col("n") == 1, F.col("k")).alias("title_key"), note.alias("note"))


#: Words before a name in a description and the parts they tell.
TRIGGERS = {"соч.": "music+programme", "по роману": "source", "инструментована": "instrumentation", "поставленъ": "staging", "музыка": "music", "либретто": "libretto"}
_TRIGGER = r"(соч\.|по роману|инструментована|поставленъ|музыка|либретто)"
_NAMED = r"((?:\p{Lu}\.\s*)+\p{Lu}\p{L}+|\p{Lu}\p{L}+(?:\s+\p{Lu}\.)+)"
_PARTS = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TRIGGERS.items())


@query(rf"""WITH e AS (SELECT DISTINCT production_entry_id, string_split(description_text, ';') AS x FROM production_entry WHERE description_text IS NOT NULL),
c AS (SELECT production_entry_id, unnest(x) AS clause, generate_subscripts(x, 1) AS pos FROM e),
t AS (SELECT production_entry_id, pos, nullif(regexp_extract(clause, '{_TRIGGER}', 1), '') AS tr, nullif(regexp_extract(clause, '{_NAMED}', 1), '') AS name FROM c),
l AS (SELECT *, last_value(tr IGNORE NULLS) OVER (PARTITION BY production_entry_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS told FROM t)
SELECT production_entry_id, CAST(pos AS INT) AS pos, name, unnest(string_split(coalesce(CASE told {_PARTS} END, 'author'), '+')) AS part FROM l WHERE name IS NOT NULL""")
def prose_credits(spark: SparkSession, d: str) -> DataFrame:
    """Names in a description with the part told by the nearest trigger
    before them; a trigger for two parts gives two rows."""
    e = table(spark, d, "production_entry", "production_entry_id", "description_text").where("description_text is not null").distinct()
    c = e.select("production_entry_id", F.posexplode(F.split("description_text", ";")).alias("pos", "clause"))
    empty = F.lit("")
    t = c.select("production_entry_id", (F.col("pos") + 1).alias("pos"), F.nullif(F.regexp_extract("clause", _TRIGGER, 1), empty).alias("tr"), F.nullif(F.regexp_extract("clause", _NAMED, 1), empty).alias("name"))
    told = F.last("tr", ignorenulls=True).over(Window.partitionBy("production_entry_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    parts = F.create_map(*[F.lit(x) for pair in TRIGGERS.items() for x in pair])
    l = t.withColumn("told", told).where("name is not null")
    return l.select("production_entry_id", "pos", "name", F.explode(F.split(F.coalesce(parts[F.col("told")], F.lit("author")), r"\+")).alias("part"))


@query(f"""WITH {_ENTRIES}, s AS (SELECT DISTINCT same_title_id, city, {_key('verbatim_title')} AS k FROM same_title_works WHERE production_entry_id IS NULL AND verbatim_title IS NOT NULL),
p AS (SELECT city, k, min(production_entry_id) AS production_entry_id FROM e GROUP BY ALL HAVING count(*) = 1),
a AS (SELECT production_entry_id, same_title_id FROM s JOIN p USING (city, k) WHERE k <> '' AND production_entry_id NOT IN (SELECT production_entry_id FROM same_title_works WHERE production_entry_id IS NOT NULL))
SELECT production_entry_id || '__supplied' || row_number() OVER (PARTITION BY production_entry_id ORDER BY same_title_id) AS child_id, production_entry_id, same_title_id FROM a""")
def supplied_rows(spark: SparkSession, d: str) -> DataFrame:
    """Titles typed without an entry, supplied to the one entry they name if it has none."""
    rows = table(spark, d, "same_title_works", "same_title_id", "city", "verbatim_title", "production_entry_id")
    missing = rows.where("production_entry_id is null and verbatim_title is not null").select("same_title_id", "city", N.title_key(F.col("verbatim_title")).alias("k")).where("k <> ''").distinct()
    return C.supplied(missing, _entries(spark, d), rows.where("production_entry_id is not null"), ["city", "k"], "production_entry_id", "same_title_id")


@query(f"""WITH {_ENTRIES}, {_WORKS}, a AS (SELECT k, min(production_entry_id) AS production_entry_id FROM e GROUP BY k HAVING count(DISTINCT production_entry_id) = 1), b AS (SELECT k, min(work_id) AS work_id FROM w GROUP BY k HAVING count(DISTINCT work_id) = 1)
SELECT k, production_entry_id, work_id FROM a JOIN b USING (k)""")
def unique_title_links(spark: SparkSession, d: str) -> DataFrame:
    """Entries and works linked where the title is unique on both sides."""
    return C.unique_links(_entries(spark, d), _works(spark, d), ["k"], "production_entry_id", "work_id")


@query("""WITH r AS (SELECT DISTINCT name_surface AS n, role_category AS r, person_id AS p FROM review_credit WHERE person_id IS NOT NULL AND name_surface IS NOT NULL),
m1 AS (SELECT n, r, min(p) AS p FROM r GROUP BY n, r HAVING count(DISTINCT p) = 1), m2 AS (SELECT n, min(p) AS p FROM r GROUP BY n HAVING count(DISTINCT p) = 1),
c AS (SELECT DISTINCT credit_id, name_printed AS n, role_category AS r FROM production_entry_credit WHERE name_printed IS NOT NULL)
SELECT credit_id, coalesce(m1.p, m2.p, 'minted-' || left(sha1(c.n), 10)) AS person_key, CASE WHEN m1.p IS NOT NULL THEN 'name and part' WHEN m2.p IS NOT NULL THEN 'name' ELSE 'minted' END AS basis
FROM c LEFT JOIN m1 ON c.n = m1.n AND c.r = m1.r LEFT JOIN m2 ON c.n = m2.n""")
def form_map(spark: SparkSession, d: str) -> DataFrame:
    """Credits to persons by the map of (name, part), else of the name, else a
    minted key."""
    r = table(spark, d, "review_credit", "name_surface", "role_category", "person_id").where("person_id is not null and name_surface is not null").distinct()
    r = r.toDF("n", "r", "p")
    sole = lambda keys, name: r.groupBy(*keys).agg(F.min("p").alias(name), F.count_distinct("p").alias("c")).where("c = 1").drop("c")
    c = table(spark, d, "production_entry_credit", "credit_id", "name_printed", "role_category").where("name_printed is not null").distinct().toDF("credit_id", "n", "r")
    told = c.join(sole(["n", "r"], "p1"), ["n", "r"], "left").join(sole(["n"], "p2"), "n", "left")
    basis = F.when(F.col("p1").isNotNull(), "name and part").when(F.col("p2").isNotNull(), "name").otherwise("minted")
    return told.select("credit_id", F.coalesce("p1", "p2", F.concat(F.lit("minted-"), natural_id(F.col("n")))).alias("person_key"), basis.alias("basis"))


_STATES = "'confirmed', 'confirmed_tenure', 'confirmed_wikidata'"


@query(f"""WITH RECURSIVE links AS (SELECT person_id_1 AS a, person_id_2 AS b FROM person_candidate WHERE status IN ({_STATES}) AND person_id_1 <> person_id_2
  UNION SELECT person_id_2, person_id_1 FROM person_candidate WHERE status IN ({_STATES}) AND person_id_1 <> person_id_2),
reach(p, o) AS (SELECT a, a FROM links UNION SELECT r.p, l.b FROM reach r JOIN links l ON l.a = r.o),
g AS (SELECT p AS person_id, min(o) AS group_id FROM reach GROUP BY p),
held AS (SELECT DISTINCT x.group_id FROM person_candidate c JOIN g x ON x.person_id = c.person_id_1 JOIN g y ON y.person_id = c.person_id_2 AND x.group_id = y.group_id WHERE c.status = 'kept_apart'),
f AS (SELECT person_id, min(decided) AS since FROM person_tenure_note WHERE decided IS NOT NULL GROUP BY 1),
s AS (SELECT g.*, row_number() OVER (PARTITION BY g.group_id ORDER BY since NULLS LAST, g.person_id) AS k FROM g LEFT JOIN f USING (person_id)),
best AS (SELECT group_id, person_id AS survivor FROM s WHERE k = 1)
SELECT g.person_id, g.group_id, CASE WHEN h.group_id IS NOT NULL THEN g.person_id ELSE survivor END AS survivor, CASE WHEN h.group_id IS NOT NULL THEN 'held' ELSE 'merged' END AS state
FROM g JOIN best USING (group_id) LEFT JOIN held h USING (group_id)""")
@settled
def lifecycle_groups(spark: SparkSession, d: str) -> DataFrame:
    """Confirmed pairs closed to groups; the member decided on first
    survives; a group with a pair kept apart is held whole."""
    pairs = table(spark, d, "person_candidate", "person_id_1", "person_id_2", "status")
    notes = table(spark, d, "person_tenure_note", "person_id", "decided").where("decided is not null")
    states = [s.strip("' ") for s in _STATES.split(",")]
    return C.settled_groups(pairs, "person_id_1", "person_id_2", "status", states, "kept_apart", notes, "person_id", "decided")


@query(f"""WITH p AS (SELECT DISTINCT person_id_1 AS m, display_1 AS d FROM person_candidate WHERE person_id_1 IS NOT NULL AND display_1 IS NOT NULL),
x AS (SELECT DISTINCT m, left(sha1(d), 10) AS o, left(sha1({_key('d')}), 10) AS n FROM p), met AS (SELECT o, n, count(*) AS shared FROM x GROUP BY ALL),
i AS (SELECT n, count(*) AS f FROM met GROUP BY n), j AS (SELECT o, count(*) AS t FROM met GROUP BY o)
SELECT o AS old_id, n AS new_id, shared, CASE WHEN f = 1 AND t = 1 THEN 'kept' WHEN t = 1 THEN 'merged' WHEN f = 1 THEN 'split' ELSE 'mixed' END AS kind FROM met JOIN i USING (n) JOIN j USING (o)""")
def id_crosswalk(spark: SparkSession, d: str) -> DataFrame:
    """Ids by display as printed against ids by its key, through their persons."""
    p = table(spark, d, "person_candidate", "person_id_1", "display_1").where("person_id_1 is not null and display_1 is not null").distinct()
    old = p.select(F.col("person_id_1").alias("m"), natural_id(F.col("display_1")).alias("old_id"))
    new = p.select(F.col("person_id_1").alias("m"), natural_id(N.title_key(F.col("display_1"))).alias("new_id"))
    return C.crosswalk(old, new, "m", "old_id", "new_id")


@query(r"""WITH p AS (SELECT DISTINCT page_id, regexp_replace(page_id, '_v\d+p0*', '_p') AS label FROM production_entry WHERE page_id IS NOT NULL)
SELECT DISTINCT c.credit_id, coalesce(p.label || substr(c.credit_id, length(p.page_id) + 1), c.credit_id) AS new_id FROM production_entry_credit c LEFT JOIN p ON regexp_extract(c.credit_id, '^(.*?)__', 1) = p.page_id WHERE c.credit_id IS NOT NULL""")
def relabelled_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that begin with the id of a page, after the pages got new labels."""
    p = table(spark, d, "production_entry", "page_id").where("page_id is not null").distinct().withColumn("label", F.regexp_replace("page_id", r"_v\d+p0*", "_p"))
    c = table(spark, d, "production_entry_credit", "credit_id").where("credit_id is not null").distinct().withColumn("page_id", F.regexp_extract("credit_id", "^(.*?)__", 1))
    new = F.concat("label", F.substring("credit_id", F.length("page_id") + 1, F.length("credit_id")))
    return c.join(p, "page_id", "left").select("credit_id", F.coalesce(new, "credit_id").alias("new_id"))


@query("""WITH t AS (SELECT DISTINCT same_title_id, season, city, theater, date FROM same_title_works WHERE regexp_matches(date, '^\\d{4}-\\d{2}-\\d{2}$')),
h AS (SELECT *, min(date) OVER (PARTITION BY season, city, theater) AS start, CAST(substr(date, 9, 2) AS INT) AS dd FROM t),
x AS (SELECT *, CAST(substr(start, 1, 4) AS INT) AS y, CAST(substr(start, 6, 2) AS INT) AS m, dd < CAST(substr(start, 9, 2) AS INT) AS later FROM h),
z AS (SELECT *, CASE WHEN later THEN m % 12 + 1 ELSE m END AS mm, CASE WHEN later AND m = 12 THEN y + 1 ELSE y END AS yy FROM x)
SELECT same_title_id, CASE WHEN dd <= CASE WHEN mm = 2 THEN CASE WHEN yy % 4 = 0 THEN 29 ELSE 28 END WHEN mm IN (4, 6, 9, 11) THEN 30 ELSE 31 END THEN printf('%04d-%02d-%02d', yy, mm, dd) END AS backfilled FROM z""".replace("\\\\", "\\"))
def month_backfill(spark: SparkSession, d: str) -> DataFrame:
    """days under the header of a season and theatre that begins with its first
    date; a day before that one falls into the next month, if it is long enough."""
    t = table(spark, d, "same_title_works", "same_title_id", "season", "city", "theater", "date").where(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$")).distinct()
    start = F.min("date").over(Window.partitionBy("season", "city", "theater"))
    return t.withColumn("start", start).select("same_title_id", N.backfilled(F.col("start"), F.substring("date", 9, 2).cast("int")).alias("backfilled"))


_DAYS = " ".join(f"WHEN starts_with(p, '{w}') THEN {n}" for w, n in N.WEEKDAYS)


@query(f"""WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-zа-яѣіѳѵё]+')) AS w FROM documents WHERE text IS NOT NULL), u AS (SELECT w, translate(w, 'ъь', '') AS p, count(*) AS n FROM t GROUP BY ALL)
SELECT w AS word, CAST(CASE {_DAYS} END AS INT) AS weekday, n FROM u WHERE CASE {_DAYS} END IS NOT NULL""")
def weekday_words(spark: SparkSession, d: str) -> DataFrame:
    """words of the documents that name a weekday, in any case and spelling."""
    w = table(spark, d, "documents", "text").select(F.explode(words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return w.withColumn("weekday", N.weekday_of_word(F.col("word"))).where("weekday is not null").select("word", "weekday", "n")


@query(r"""WITH c AS (SELECT DISTINCT credit_id, name_printed AS v FROM production_entry_credit WHERE name_printed IS NOT NULL),
s1 AS (SELECT *, nullif(regexp_extract(v, '^(г-жа|г-жи|г-нъ|г\.|барона)\s+', 1), '') AS honorific, regexp_replace(v, '^(г-жа|г-жи|г-нъ|г\.|барона)\s+', '') AS a FROM c),
s2 AS (SELECT *, regexp_replace(a, '([А-ЯѲІ]\.)(\S)', '\1 \2', 'g') AS b FROM s1), s3 AS (SELECT *, regexp_replace(b, '\s{2,}', ' ') AS e FROM s2),
s4 AS (SELECT *, nullif(trim(regexp_extract(e, '^((?:[А-ЯѲІ]\.\s)+)', 1)), '') AS initials FROM s3)
SELECT credit_id, honorific, initials, regexp_replace(e, '^((?:[А-ЯѲІ]\.\s)+)', '') AS family FROM s4""")
def field_repairs(spark: SparkSession, d: str) -> DataFrame:
    """A name as printed in steps: the honorific moved to its own field,
    initials set apart, the first wide gap narrowed, initials split off."""
    honorific, initials = r"^(г-жа|г-жи|г-нъ|г\.|барона)\s+", r"^((?:[А-ЯѲІ]\.\s)+)"
    empty = F.lit("")

    def move_honorific(df: DataFrame) -> DataFrame:
        return df.withColumn("honorific", F.nullif(F.regexp_extract("v", honorific, 1), empty)).withColumn("v", F.regexp_replace("v", honorific, ""))

    def set_apart(df: DataFrame) -> DataFrame:
        return df.withColumn("v", F.regexp_replace("v", r"([А-ЯѲІ]\.)(\S)", "$1 $2"))

    def narrow_first(df: DataFrame) -> DataFrame:
        return df.withColumn("v", F.regexp_replace("v", r"^(.*?)\s{2,}", "$1 "))  # anchored: the first only

    def split(df: DataFrame) -> DataFrame:
        return df.select("credit_id", "honorific", F.nullif(F.trim(F.regexp_extract("v", initials, 1)), empty).alias("initials"), F.regexp_replace("v", initials, "").alias("family"))

    c = table(spark, d, "production_entry_credit", "credit_id", "name_printed").where("name_printed is not null").distinct().withColumnRenamed("name_printed", "v")
    return c.transform(move_honorific).transform(set_apart).transform(narrow_first).transform(split)


@query("""SELECT doc_id FROM documents WHERE lower(text) LIKE '%бенефис%' OR lower(text) LIKE '%юбиле%' OR lower(text) LIKE '%anniversa%' OR lower(text) LIKE '%receipts%'""")
def any_term(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold one of several terms, in any letter case."""
    return table(spark, d, "documents", "doc_id", "text").where(F.lower("text").rlike("бенефис|юбиле|anniversa|receipts")).select("doc_id")


@query("""WITH c AS (SELECT DISTINCT credit_id, page_id, name_surface, role_category FROM review_credit WHERE name_surface IS NOT NULL AND page_id IS NOT NULL)
SELECT a.page_id, a.name_surface, a.credit_id AS credit_1, b.credit_id AS credit_2 FROM c a JOIN c b ON a.page_id = b.page_id AND a.name_surface = b.name_surface AND a.credit_id < b.credit_id AND a.role_category IS NOT DISTINCT FROM b.role_category""")
def same_person_on_page(spark: SparkSession, d: str) -> DataFrame:
    """Q1: one name twice on a page for the same part; other parts are distinct postings."""
    c = table(spark, d, "review_credit", "credit_id", "page_id", "name_surface", "role_category").where("name_surface is not null and page_id is not null").distinct()
    b = c.select(F.col("credit_id").alias("credit_2"), F.col("page_id").alias("_p"), F.col("name_surface").alias("_n"), F.col("role_category").alias("_r"))
    on = (F.col("page_id") == F.col("_p")) & (F.col("name_surface") == F.col("_n")) & F.col("role_category").eqNullSafe(F.col("_r")) & (F.col("credit_id") < F.col("credit_2"))
    return c.join(b, on).select("page_id", "name_surface", F.col("credit_id").alias("credit_1"), "credit_2")


@query("""SELECT DISTINCT production_entry_id, strpos(lower(section_heading), lower(title)) > 0 AS title_in_heading, regexp_matches(lower(section_heading), 'балет|опер|драм') AND regexp_matches(lower(description_text), '^(балет|опер|драм)') AS genre_said_twice
FROM production_entry WHERE section_heading IS NOT NULL AND title IS NOT NULL AND description_text IS NOT NULL""")
def heading_flags(spark: SparkSession, d: str) -> DataFrame:
    """Q2: headings that repeat what the entry itself says."""
    e = table(spark, d, "production_entry", "production_entry_id", "section_heading", "title", "description_text").where("section_heading is not null and title is not null and description_text is not null")
    twice = F.lower("section_heading").rlike("балет|опер|драм") & F.lower("description_text").rlike("^(балет|опер|драм)")
    return e.select("production_entry_id", F.lower("section_heading").contains(F.lower("title")).alias("title_in_heading"), twice.alias("genre_said_twice")).distinct()


@query("""SELECT mention_id, count(*) AS deliveries, coalesce(arg_min(surface, loaded_at), '') <> coalesce(arg_max(surface, loaded_at), '') OR coalesce(arg_min(link_method, loaded_at), '') <> coalesce(arg_max(link_method, loaded_at), '') AS changed
FROM (SELECT mention_id, coalesce(surface, '') AS surface, coalesce(link_method, '') AS link_method, loaded_at FROM review_mention WHERE loaded_at IS NOT NULL) GROUP BY 1 HAVING count(*) > 1""")
def changed_after_first(spark: SparkSession, d: str) -> DataFrame:
    """Q4: records delivered again, and whether what was verified first has changed."""
    m = table(spark, d, "review_mention", "mention_id", "surface", "link_method", "loaded_at").where("loaded_at is not null").fillna("", ["surface", "link_method"])
    said = F.struct("surface", "link_method")
    g = m.groupBy("mention_id").agg(F.count("*").alias("deliveries"), F.min_by(said, "loaded_at").alias("a"), F.max_by(said, "loaded_at").alias("b"))
    return g.where("deliveries > 1").select("mention_id", "deliveries", (F.col("a") != F.col("b")).alias("changed"))


_TYPED = f"t AS (SELECT DISTINCT season, city, theater, date, time_of_day, {_key('verbatim_title')} AS k FROM same_title_works WHERE verbatim_title IS NOT NULL AND date IS NOT NULL AND theater IS NOT NULL)"


def _typed(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "same_title_works", "season", "city", "theater", "date", "time_of_day", "verbatim_title").where("verbatim_title is not null and date is not null and theater is not null")
    return t.withColumn("k", N.title_key(F.col("verbatim_title"))).drop("verbatim_title").distinct()


@query(f"""WITH {_TYPED}, s AS (SELECT season, city, k, theater, array_to_string(list_sort(list(DISTINCT date)), ',') AS dates FROM t GROUP BY ALL),
w AS (SELECT *, first_value(dates) OVER (PARTITION BY season, city, k ORDER BY theater) AS first, count(*) OVER (PARTITION BY season, city, k) AS n FROM s)
SELECT season, city, k, theater, dates, dates <> first AS mismatch FROM w WHERE n > 1""")
def theatre_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Q15: dates of a title in each theatre, where they differ from the first theatre's."""
    s = _typed(spark, d).groupBy("season", "city", "k", "theater").agg(F.array_join(F.sort_array(F.collect_set("date")), ",").alias("dates"))
    w = Window.partitionBy("season", "city", "k")
    told = s.withColumn("first", F.first("dates").over(w.orderBy("theater"))).withColumn("n", F.count("*").over(w))
    return told.where("n > 1").select("season", "city", "k", "theater", "dates", (F.col("dates") != F.col("first")).alias("mismatch"))


@query(f"""WITH {_TYPED}, b AS (SELECT season, city, theater, date, time_of_day, left(sha1(array_to_string(list_sort(list(DISTINCT k)), '|')), 10) AS bill FROM t GROUP BY ALL)
SELECT city, bill, count(*) AS sessions, count(DISTINCT theater) AS theaters, min(date) AS first_date FROM b GROUP BY ALL HAVING count(*) > 1""")
def same_bill_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Q17: sessions of a city with the same bill."""
    b = _typed(spark, d).groupBy("season", "city", "theater", "date", "time_of_day").agg(natural_id(F.array_join(F.sort_array(F.collect_set("k")), "|")).alias("bill"))
    return b.groupBy("city", "bill").agg(F.count("*").alias("sessions"), F.count_distinct("theater").alias("theaters"), F.min("date").alias("first_date")).where("sessions > 1")


@query("""SELECT season, city, count(DISTINCT page_id) AS pages, count(*) FILTER (WHERE link_confidence = 'low') AS low, count(*) FILTER (WHERE link_confidence = 'low') = 0 AS zero_uncertainty
FROM review_mention GROUP BY season, city HAVING count(DISTINCT page_id) >= 3""")
def zero_uncertainty(spark: SparkSession, d: str) -> DataFrame:
    """Q23: seasons of some pages in which nothing at all was marked uncertain."""
    m = table(spark, d, "review_mention", "season", "city", "page_id", "link_confidence")
    g = m.groupBy("season", "city").agg(F.count_distinct("page_id").alias("pages"), F.count_if(F.col("link_confidence") == "low").alias("low"))
    return g.where("pages >= 3").withColumn("zero_uncertainty", F.col("low") == 0)


@query("""WITH t AS (SELECT DISTINCT season, city, date, time_of_day FROM same_title_works WHERE date IS NOT NULL), p AS (SELECT season, city, date, count(*) AS sessions, bool_or(time_of_day = 'morning') AS morning, bool_or(time_of_day = 'evening') AS evening FROM t GROUP BY ALL)
SELECT season, city, count(*) AS days, count(*) FILTER (WHERE morning AND NOT evening) AS morning_only, round(count(*) FILTER (WHERE sessions > 1) / count(*), 6) AS split_rate FROM p GROUP BY ALL""")
def session_probes(spark: SparkSession, d: str) -> DataFrame:
    """Q27: days with a morning but no evening, and the share of days with several sessions."""
    t = table(spark, d, "same_title_works", "season", "city", "date", "time_of_day").where("date is not null").distinct()
    p = t.groupBy("season", "city", "date").agg(F.count("*").alias("sessions"), F.bool_or(F.col("time_of_day") == "morning").alias("morning"), F.bool_or(F.col("time_of_day") == "evening").alias("evening"))
    return p.groupBy("season", "city").agg(
        F.count("*").alias("days"), F.count_if(F.col("morning") & ~F.col("evening")).alias("morning_only"), F.round(F.count_if(F.col("sessions") > 1) / F.count("*"), 6).alias("split_rate")
    )


@query(r"""WITH p AS (SELECT DISTINCT person_id_1 AS person_id, display_1 AS d FROM person_candidate WHERE person_id_1 IS NOT NULL AND display_1 IS NOT NULL),
x AS (SELECT person_id, regexp_extract(d, '^(\p{L}+)', 1) AS family, regexp_extract(d, ',\s*(\p{L}+)\s+\p{L}+\s*$', 1) AS given, regexp_extract(d, ',\s*\p{L}+\s+(\p{L}+)\s*$', 1) AS patr FROM p),
g AS (SELECT given, count(*) FILTER (WHERE regexp_matches(patr, 'ичъ?$')) AS m, count(*) FILTER (WHERE regexp_matches(patr, '(вна|чна)$')) AS f FROM x WHERE given <> '' GROUP BY 1),
l AS (SELECT given, CASE WHEN m >= 4 AND m >= 0.95 * (m + f) THEN 'm' WHEN f >= 4 AND f >= 0.95 * (m + f) THEN 'f' END AS learned FROM g)
SELECT person_id, given, learned, """ + _SEX.format(s="family") + r""" AS by_surname, """ + _SEX.format(s="family") + r""" NOT IN ('', learned) AS conflict FROM x JOIN l USING (given) WHERE learned IS NOT NULL""")
def gender_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Q28: gender of given names learned from patronymics (four or more, 95 %), and
    whether a person's surname contradicts it."""
    p = table(spark, d, "person_candidate", "person_id_1", "display_1").where("person_id_1 is not null and display_1 is not null").distinct()
    x = p.select(
        F.col("person_id_1").alias("person_id"), F.regexp_extract("display_1", r"^(\p{L}+)", 1).alias("family"),
        F.regexp_extract("display_1", r",\s*(\p{L}+)\s+\p{L}+\s*$", 1).alias("given"), F.regexp_extract("display_1", r",\s*\p{L}+\s+(\p{L}+)\s*$", 1).alias("patr"),
    )
    g = x.where("given <> ''").groupBy("given").agg(F.count_if(F.col("patr").rlike("ичъ?$")).alias("m"), F.count_if(F.col("patr").rlike("(вна|чна)$")).alias("f"))
    both = F.col("m") + F.col("f")
    learned = F.when((F.col("m") >= 4) & (F.col("m") >= 0.95 * both), "m").when((F.col("f") >= 4) & (F.col("f") >= 0.95 * both), "f")
    told = x.join(g.select("given", learned.alias("learned")).where("learned is not null"), "given").withColumn("by_surname", N.gender_of_surname(F.col("family")))
    return told.select("person_id", "given", "learned", "by_surname", (~F.col("by_surname").isin("") & (F.col("by_surname") != F.col("learned"))).alias("conflict"))


@query(r"""WITH c AS (SELECT DISTINCT credit_id, name_printed AS v FROM production_entry_credit WHERE name_printed IS NOT NULL),
f AS (SELECT credit_id, unnest([CASE WHEN regexp_matches(v, '\d') THEN 'digit' END, CASE WHEN regexp_matches(v, '\s{2,}') THEN 'wide gap' END, CASE WHEN NOT regexp_matches(v, '\p{Lu}\.') THEN 'no initial' END,
 CASE WHEN regexp_matches(v, '\p{L}{2,}\.$') THEN 'cut' END, CASE WHEN regexp_matches(v, '[A-Za-z]') THEN 'Latin letter' END, CASE WHEN NOT regexp_matches(v, '\p{Ll}') THEN 'capitals' END]) AS flag FROM c)
SELECT credit_id, flag FROM f WHERE flag IS NOT NULL""")
def name_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Q28: the shapes a name as printed should not have."""
    v = F.col("name_printed")
    tests = {"digit": v.rlike(r"\d"), "wide gap": v.rlike(r"\s{2,}"), "no initial": ~v.rlike(r"\p{Lu}\."), "cut": v.rlike(r"\p{L}{2,}\.$"), "Latin letter": v.rlike("[A-Za-z]"), "capitals": ~v.rlike(r"\p{Ll}")}
    c = table(spark, d, "production_entry_credit", "credit_id", "name_printed").where("name_printed is not null").distinct()
    return c.select("credit_id", F.explode(F.array_compact(F.array(*[F.when(test, flag) for flag, test in tests.items()]))).alias("flag"))
