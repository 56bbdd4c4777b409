"""Queries of text operators and data-quality checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.text import rejoin_lines, spelling_fold, words
from vellum.operators import text as X
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


_W = "[a-zа-яѣіѳѵё]+"


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_shipdate, l_quantity) AS k FROM lineitem),
t AS (SELECT l_orderkey, k, regexp_extract_all('lot 4 of 9; lot 7 of 2; lot 1 of ' || CAST(l_orderkey % 5 AS VARCHAR), 'lot ([0-9]+)', 1) AS ls FROM r)
SELECT l_orderkey, CAST(k AS INT) AS k, CAST(coalesce(ls[k], ls[1]) AS INT) AS value FROM t""")
def nth_label_repair(spark: SparkSession, d: str) -> DataFrame:
    """The kth row takes the kth sentence, else the first."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", "l_quantity")
    r = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", "l_quantity").withColumn("k", F.row_number().over(w))
    text = F.concat(F.lit("lot 4 of 9; lot 7 of 2; lot 1 of "), (F.col("l_orderkey") % 5).cast("string"))
    ls = F.regexp_extract_all(text, F.lit(r"lot ([0-9]+)"), F.lit(1))
    return r.withColumn("ls", ls).select("l_orderkey", "k", F.coalesce(F.get("ls", F.col("k") - 1), F.col("ls")[0]).cast("int").alias("value"))


def _fold(column: str) -> str:
    """SQL of the spelling fold."""
    plain = f"translate(lower({column}), 'ѣіѳѵёъь', 'еифие')"
    return f"array_to_string(list_filter(string_split({plain}, ''), lambda c, i: i = 1 OR c <> string_split({plain}, '')[i - 1]), '')"


@query(f"""WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-zа-яѣіѳѵё]+')) AS w FROM documents), c AS (SELECT w, count(*) AS n FROM t GROUP BY 1), k AS (SELECT *, {_fold('w')} AS k FROM c),
m AS (SELECT *, max(n) OVER (PARTITION BY k) AS top, sum(n) OVER (PARTITION BY k) AS total FROM k) SELECT w AS variant, k AS fold, CAST(n AS BIGINT) AS n, CAST(top AS BIGINT) AS dominant FROM m WHERE n < top AND top >= 5 * n AND total >= 5""")
def name_variants(spark: SparkSession, d: str) -> DataFrame:
    """Rare variants of a frequent word with the same spelling fold, over all words."""
    t = table(spark, d, "documents", "text").select(F.explode(words(F.col("text"))).alias("w"))
    return X.variant_outliers(t.withColumn("fold", spelling_fold(F.col("w"))), "w", "fold")


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zа-яѣіѳѵё]+') AS ws FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(len(ws) AS INT) AS n_words, CAST(len(list_distinct(ws)) AS INT) AS n_distinct, len(ws) >= 8 AND len(list_distinct(ws)) / len(ws) < 0.34 AS degenerate FROM t""")
def repetition(spark: SparkSession, d: str) -> DataFrame:
    """Q20: texts that repeat a few words."""
    t = table(spark, d, "documents", "doc_id", "text").where("text is not null").withColumn("ws", words(F.col("text")))
    n, u = F.size("ws"), F.size(F.array_distinct("ws"))
    return t.select("doc_id", n.alias("n_words"), u.alias("n_distinct"), ((n >= 8) & (u / n < 0.34)).alias("degenerate"))


@query(r"""WITH t AS (SELECT block_id, page_id, regexp_replace(lower(text), '\s+', ' ', 'g') AS k FROM review_passage WHERE length(text) >= 60), g AS (SELECT md5(k) AS h, min(block_id) AS first_block, count(*) AS n, count(DISTINCT page_id) AS pages FROM t GROUP BY 1)
SELECT h, first_block, CAST(n AS BIGINT) AS n, CAST(pages AS BIGINT) AS pages FROM g WHERE n > 1""")
def duplicate_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Q22: blocks whose text stands twice, by the hash of the normalised text."""
    t = table(spark, d, "review_passage", "block_id", "page_id", "text").where(F.length("text") >= 60)
    k = F.md5(F.regexp_replace(F.lower("text"), r"\s+", " "))
    return t.groupBy(k.alias("h")).agg(F.min("block_id").alias("first_block"), F.count("*").alias("n"), F.countDistinct("page_id").alias("pages")).where("n > 1")


@query(r"""SELECT block_id, regexp_matches(text, '(^|[^А-Яа-яѣі])([А-Яа-яѣі] ){3,}') AS letter_spacing, regexp_matches(text, '[А-Яа-яѣі][A-Za-z]|[A-Za-z][А-Яа-яѣі]') AS mixed_script, regexp_matches(text, '[0-9][а-яѣі]|[а-яѣі][0-9]') AS digit_in_word FROM review_passage WHERE text IS NOT NULL""")
def letter_checks(spark: SparkSession, d: str) -> DataFrame:
    """Letter spacing, mixed scripts, digits in words."""
    t = table(spark, d, "review_passage", "block_id", "text").where("text is not null")
    r = lambda p: F.col("text").rlike(p)
    return t.select("block_id", r("(^|[^А-Яа-яѣі])([А-Яа-яѣі] ){3,}").alias("letter_spacing"), r("[А-Яа-яѣі][A-Za-z]|[A-Za-z][А-Яа-яѣі]").alias("mixed_script"), r("[0-9][а-яѣі]|[а-яѣі][0-9]").alias("digit_in_word"))


@query(None)
def segment_items(spark: SparkSession, d: str) -> DataFrame:
    """Texts of all documents cut at their enumerators, whole where there are none.
    Null and blank texts have no pieces."""
    return X.enumerated_items(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


_TOPICS = {"receipts": "касса|сбор|roubles|receipts", "dance": "мазурк|пляск|mazurka|варіаці", "index": "указател|index|folio"}


@query("""WITH t AS (SELECT doc_id, lower(text) AS x FROM documents WHERE text IS NOT NULL)
SELECT doc_id, concat_ws('|', CASE WHEN regexp_matches(x, 'мазурк|пляск|mazurka|варіаці') THEN 'dance' END, CASE WHEN regexp_matches(x, 'указател|index|folio') THEN 'index' END, CASE WHEN regexp_matches(x, 'касса|сбор|roubles|receipts') THEN 'receipts' END) AS topics FROM t""")
def topic_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags by a table of patterns."""
    t = table(spark, d, "documents", "doc_id", "text").where("text is not null").withColumn("x", F.lower("text"))
    tags = F.array_compact(F.array(*[F.when(F.col("x").rlike(p), n) for n, p in sorted(_TOPICS.items())]))
    return t.select("doc_id", F.array_join(tags, "|").alias("topics"))


@query("""WITH t AS (SELECT doc_id, lower(text) AS x FROM documents WHERE text IS NOT NULL), l(form, entity) AS (SELECT lower(canonical_title), min(work_id) FROM research_work GROUP BY 1)
SELECT doc_id, entity, CAST(position('«' || form || '»' IN x) AS INT) AS first_at, CAST((length(x) - length(replace(x, '«' || form || '»', ''))) / (length(form) + 2) AS INT) AS times FROM t JOIN l ON contains(x, '«' || form || '»')""")
def mention_match(spark: SparkSession, d: str) -> DataFrame:
    """Quoted titles of a closed vocabulary in free text, with offsets.

    Quoted spans are cut out with their offsets and meet the vocabulary by equality,
    so no text is compared with every form."""
    lex = table(spark, d, "research_work", "work_id", "canonical_title").groupBy(F.lower("canonical_title").alias("form")).agg(F.min("work_id").alias("entity"))
    spans = X.quoted_spans(table(spark, d, "documents", "doc_id", "text").where("text is not null"), "doc_id", F.lower("text"))
    met = spans.join(lookup(lex), "form")
    return met.groupBy("doc_id", "entity").agg(F.min("at").alias("first_at"), F.count("*").cast("int").alias("times"))


@query(None)
def kwic_windows(spark: SparkSession, d: str) -> DataFrame:
    """M6: keyword in context, overlapping windows merged."""
    t = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    return X.keyword_windows(t, "doc_id", "text", "roubles|касса|сбор", 40)


@query(None)
def medoid_banding(spark: SparkSession, d: str) -> DataFrame:
    """Most central of the readings of one block and how alike they
    are. Readings of a block are the blocks of its page, of any type, with a text at
    least 0.6 alike; what was read once stands for itself."""
    return X.medoids(table(spark, d, "review_passage", "block_id", "page_id", "text"), "page_id", "block_id", "text")


@query(None)
def edit_distance_cer(spark: SparkSession, d: str) -> DataFrame:
    """Edit distance and error rate of the whole texts of neighbouring blocks.

    Characters count as stored, case too. No SQL: DuckDB's distance counts bytes."""
    p = table(spark, d, "review_passage", "block_id", "page_id", "block_index", "text").where("text is not null")
    b = p.select("page_id", (F.col("block_index") - 1).alias("block_index"), F.col("text").alias("other"))
    dist, n = F.levenshtein("text", "other"), F.length("text")
    return p.join(b, ["page_id", "block_index"]).withColumn("distance", dist).select("block_id", "distance", F.when(n > 0, F.round(F.col("distance") / n, 6)).alias("cer"))


@query(None)
def reading_selector(spark: SparkSession, d: str) -> DataFrame:
    """Of the titles typed for one production a reading that was offered: blanks
    dropped, mixed script loses, then majority, else a REVIEW entry."""
    t = table(spark, d, "same_title_works", "production_entry_id", "same_title_id", "verbatim_title").where("production_entry_id is not null").distinct()
    offered = F.transform(F.sort_array(F.collect_list(F.struct("same_title_id", F.coalesce("verbatim_title", F.lit("")).alias("v")))), lambda x: x["v"])
    return X.select_reading(t.groupBy("production_entry_id").agg(offered.alias("readings")), "production_entry_id", "readings")


@query("""WITH t AS (SELECT DISTINCT same_title_id, production_entry_id AS k, nullif(theater, '') AS p FROM same_title_works WHERE production_entry_id IS NOT NULL),
c AS (SELECT k, p, CASE WHEN p IS NULL THEN 0 ELSE count(*) END AS n FROM t GROUP BY k, p),
g AS (SELECT k, count(p) AS v, sum(n) AS votes, arg_max(p, (n, p)) FILTER (WHERE p IS NOT NULL) AS value FROM c GROUP BY k)
SELECT k, CASE WHEN v = 0 THEN 'blank agreed' WHEN v > 1 THEN 'conflict' WHEN votes = 1 THEN 'single' ELSE 'agreed' END AS verdict, value FROM g""")
def kind_vote(spark: SparkSession, d: str) -> DataFrame:
    """X11: what several passes say of one field: agreed, conflict (most votes win, the
    last by name at a tie), single, blank."""
    t = table(spark, d, "same_title_works", "same_title_id", "production_entry_id", "theater").where("production_entry_id is not null").distinct()
    return X.vote(t.select(F.col("production_entry_id").alias("k"), F.nullif("theater", F.lit("")).alias("p")), "k", "p")


@query("""WITH f AS (
SELECT 'duplicate_key' AS flag, CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) AS row_id FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'zero_dark', CAST(user_id AS VARCHAR) FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'error') = 0 AND count(DISTINCT CAST(ts AS DATE)) >= 6
UNION ALL SELECT 'dark_with_content', CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'error' AND value > 50
UNION ALL SELECT 'unknown_vocabulary', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW'))
SELECT flag, row_id FROM f""")
def quality_union(spark: SparkSession, d: str) -> DataFrame:
    """Q7, Q8, Q9, Q10, Q14, Q16: flags of several checks in one long table."""
    l = table(spark, d, "lineitem", "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").count().where("count > 1")
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "ts", "value")
    z = e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("dark"), F.countDistinct(F.to_date("ts")).alias("days")).where("dark = 0 and days >= 6")
    known = spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("3-MEDIUM",), ("5-LOW",)], "o_orderpriority string")
    o = table(spark, d, "orders", "o_orderkey", "o_orderpriority").where("o_orderpriority is not null").join(F.broadcast(known), "o_orderpriority", "left_anti")  # closed vocabulary
    f = lambda df, flag, row: df.select(F.lit(flag).alias("flag"), row.cast("string").alias("row_id"))
    return (
        f(l, "duplicate_key", F.concat_ws("/", "l_orderkey", "l_linenumber"))
        .unionByName(f(z, "zero_dark", F.col("user_id")))
        .unionByName(f(e.where("event_type = 'error' and value > 50"), "dark_with_content", F.col("event_id")))
        .unionByName(f(o, "unknown_vocabulary", F.col("o_orderkey")))
    )


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN 'identical' ELSE 'content disagrees' END AS verdict, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def cross_key_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Q8, Q12, Q17: rows under one key, contents alike or not."""
    g = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey").groupBy("l_orderkey", "l_linenumber").agg(F.countDistinct("l_suppkey").alias("k"), F.count("*").alias("n"))
    return g.where("n > 1").select("l_orderkey", "l_linenumber", F.when(F.col("k") == 1, "identical").otherwise("content disagrees").alias("verdict"), "n")


@query("""WITH a AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(CAST(a.n AS VARCHAR), 'missing') || '/' || coalesce(CAST(b.n AS VARCHAR), 'missing') AS readings FROM a FULL JOIN b ON a.k = b.k WHERE a.n IS DISTINCT FROM b.n""")
def cross_source_disagree(spark: SparkSession, d: str) -> DataFrame:
    """Q13, Q15: sources that disagree on a cell; missing counts as a reading."""
    n = lambda f: F.nullif(F.count_if(F.col("l_returnflag") == f), F.lit(0))
    g = table(spark, d, "lineitem", "l_orderkey", "l_returnflag").groupBy(F.col("l_orderkey").alias("k")).agg(n("A").alias("a"), n("N").alias("b")).where("not (a <=> b)")
    t = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("missing"))
    return g.select("k", F.concat_ws("/", t("a"), t("b")).alias("readings"))


@query("""WITH g AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders), h AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders)
SELECT g.o_custkey, round(avg(CASE WHEN g.o_orderstatus = h.o_orderstatus THEN 1.0 ELSE 0 END), 6) AS positional, round(avg(CASE WHEN g.o_orderkey = h.o_orderkey THEN 1.0 ELSE 0 END), 6) AS keyed FROM g JOIN h USING (o_custkey, i) GROUP BY 1""")
def positional_vs_key_eval(spark: SparkSession, d: str) -> DataFrame:
    """Rows paired by position, scored by value and by key. Both
    positions come from one scan: the pairs of a customer share its partition."""
    o = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    i = o.withColumn("i", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).withColumn("j", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    g, h = i.select("o_custkey", "i", "o_orderkey", "o_orderstatus"), i.select("o_custkey", F.col("j").alias("i"), F.col("o_orderkey").alias("k2"), F.col("o_orderstatus").alias("s2"))
    s = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return g.join(h, ["o_custkey", "i"]).groupBy("o_custkey").agg(s(F.col("o_orderstatus") == F.col("s2")).alias("positional"), s(F.col("o_orderkey") == F.col("k2")).alias("keyed"))


@query("""WITH s AS (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, CAST(max(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY 1), t AS (SELECT l_orderkey, q, total, total - q + CASE WHEN q % 10 = 3 THEN q + 5 WHEN q % 10 = 8 THEN q - 5 ELSE q END AS stated FROM s)
SELECT l_orderkey, CAST(q AS BIGINT) AS read_as, CAST(CASE WHEN q % 10 = 3 THEN q + 5 WHEN q % 10 = 8 THEN q - 5 END AS BIGINT) AS meant FROM t WHERE stated <> total""")
def digit_lookalike(spark: SparkSession, d: str) -> DataFrame:
    """One confused digit (3 and 8) that makes a stated sum hold."""
    g = table(spark, d, "lineitem", "l_orderkey", "l_quantity").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("total"), F.max(F.col("l_quantity").cast("long")).alias("q"))
    last = F.col("q") % 10
    g = g.withColumn("stated", F.col("total") - F.col("q") + F.when(last == 3, F.col("q") + 5).when(last == 8, F.col("q") - 5).otherwise(F.col("q")))
    text = F.col("q").cast("string")
    pos = F.sequence(F.lit(1), F.length(text))
    swapped = F.transform(pos, lambda i: F.concat(F.substring(text, 1, 0), F.left(text, i - 1), F.translate(F.substr(text, i, F.lit(1)), "38", "83"), F.substr(text, i + 1)).cast("long"))
    hits = F.filter(swapped, lambda v: (v != F.col("q")) & (F.col("total") - F.col("q") + v == F.col("stated")))
    return g.where("stated <> total").select("l_orderkey", F.col("q").alias("read_as"), F.get(hits, F.lit(0)).alias("meant"))


@query("""WITH y AS (SELECT season, city, count(*) AS n, count(*) FILTER (WHERE is_premiere) AS premieres, count(total_count) AS with_total, sum(total_count) AS t FROM production_entry GROUP BY 1, 2)
SELECT season, city, CAST(n AS BIGINT) AS n, CAST(premieres AS BIGINT) AS premieres, CAST(with_total AS BIGINT) AS with_total, CAST(t AS BIGINT) AS total FROM y""")
def season_overview(spark: SparkSession, d: str) -> DataFrame:
    """Productions of each season and city."""
    p = table(spark, d, "production_entry", "season", "city", "is_premiere", "total_count")
    return p.groupBy("season", "city").agg(F.count("*").alias("n"), F.count_if("is_premiere").alias("premieres"), F.count("total_count").alias("with_total"), F.sum("total_count").alias("total"))


@query("""WITH c AS (SELECT DISTINCT credit_id, production_entry_id, role_category, name_printed FROM production_entry_credit) SELECT role_category, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT production_entry_id) AS BIGINT) AS productions,
CAST(count(*) FILTER (WHERE name_printed IS NULL OR name_printed = '') AS BIGINT) AS blank FROM c GROUP BY 1""")
def credit_overview(spark: SparkSession, d: str) -> DataFrame:
    """Credits by category, repeats once, blanks counted."""
    c = table(spark, d, "production_entry_credit", "credit_id", "production_entry_id", "role_category", "name_printed").distinct()
    return c.groupBy("role_category").agg(F.count("*").alias("n"), F.countDistinct("production_entry_id").alias("productions"), F.count_if(F.col("name_printed").isNull() | (F.col("name_printed") == "")).alias("blank"))


@query(r"""SELECT block_id, trim(regexp_replace(regexp_replace(text, '(\p{L})-\s*\n\s*(\p{Ll})', '\1\2', 'g'), '\s+', ' ', 'g')) AS joined FROM review_passage WHERE text IS NOT NULL""")
def rejoined_lines(spark: SparkSession, d: str) -> DataFrame:
    """hyphen-broken lines joined, white space collapsed."""
    return table(spark, d, "review_passage", "block_id", "text").where("text is not null").select("block_id", rejoin_lines(F.col("text")).alias("joined"))


@query(f"""SELECT 'all' AS family, count(DISTINCT canonical_family_name) AS names, count(DISTINCT {_fold('canonical_family_name')}) AS n FROM review_person WHERE canonical_family_name IS NOT NULL""")
def folded_families(spark: SparkSession, d: str) -> DataFrame:
    """distinct family names before and after the spelling fold."""
    p = table(spark, d, "review_person", "canonical_family_name").where("canonical_family_name is not null")
    return p.agg(F.countDistinct("canonical_family_name").alias("names"), F.countDistinct(spelling_fold(F.col("canonical_family_name"))).alias("n")).select(F.lit("all").alias("family"), "names", "n")


@query(None)
def band_stitch(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive bands of words stitched at their longest overlap."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def halves(texts: pd.Series) -> pd.Series:
        def cut(t: str) -> list[str]:
            w = t.split()
            m = len(w) // 2
            return [" ".join(w[: m + 3]), " ".join(w[max(0, m - 2) :])]

        return texts.map(cut)

    t = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    return X.stitched(t.withColumn("bands", halves("text")), "doc_id", "bands").withColumn("whole", F.col("stitched"))
