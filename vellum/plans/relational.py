"""Queries of the relational operators: projections, joins, aggregates, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions.text import minor_units, words
from vellum.operators import aggregates as A
from vellum.operators import matching as M
from vellum.operators import rules as R
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


@query("""SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' THEN 'ring' WHEN p_name LIKE '%gear%' THEN 'gear' WHEN p_name LIKE '%bolt%' THEN 'bolt' END AS family FROM part""")
def canonical_contains(spark: SparkSession, d: str) -> DataFrame:
    """Canonical family by substring, first hit wins."""
    n = F.col("p_name")
    return table(spark, d, "part", "p_partkey", "p_name").select(
        "p_partkey", F.when(n.contains("ring"), "ring").when(n.contains("gear"), "gear").when(n.contains("bolt"), "bolt").alias("family")
    )


@query("""SELECT p_partkey,
CASE WHEN p_type = 'PROMO' THEN 'promo' WHEN p_size >= 40 THEN 'bulky' WHEN p_retailprice < 950 THEN 'cheap' WHEN p_name LIKE 'red %' OR p_name LIKE 'blue %' THEN 'coloured' END AS class,
CASE WHEN p_type = 'PROMO' THEN 'printed type' WHEN p_size >= 40 THEN 'size from 40' WHEN p_retailprice < 950 THEN 'price under 950' WHEN p_name LIKE 'red %' OR p_name LIKE 'blue %' THEN 'colour word' ELSE 'no rule' END AS basis
FROM part""")
def class_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Ordered rules give class and basis."""
    rules = [
        (F.col("p_type") == "PROMO", "promo", "printed type"),
        (F.col("p_size") >= 40, "bulky", "size from 40"),
        (F.col("p_retailprice") < 950, "cheap", "price under 950"),
        (F.col("p_name").rlike("^(red|blue) "), "coloured", "colour word"),
    ]
    value, basis = R.rule_cascade(rules)
    return table(spark, d, "part").select("p_partkey", value.alias("class"), basis.alias("basis"))


@query(r"""SELECT doc_id, regexp_matches(lower(text), 'https?://|www\.') AS has_url, regexp_matches(lower(text), '[0-9]{4}') AS has_year,
regexp_matches(lower(text), '\?') AS asks, regexp_matches(lower(text), '^\s*$') AS is_blank FROM documents""")
def flag_battery(spark: SparkSession, d: str) -> DataFrame:
    """P10: one boolean per pattern."""
    rules = {"has_url": r"https?://|www\.", "has_year": "[0-9]{4}", "asks": r"\?", "is_blank": r"^\s*$"}
    return R.flag_battery(table(spark, d, "documents", "doc_id", "text"), "text", rules).drop("text")


@query("""SELECT p_partkey, CASE WHEN starts_with(p_brand, 'Brand#') THEN substr(p_brand, 7) ELSE p_brand END AS brand_no, p_type || ' / ' || p_name AS label,
p_name AS bare FROM part""")
def prefix_strip(spark: SparkSession, d: str) -> DataFrame:
    """Strip a prefix given by another column; replace and drop columns."""
    df = table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type").withColumn("label", F.concat_ws(" / ", "p_type", "p_name"))
    lead = F.concat(F.col("p_type"), F.lit(" / "))
    df = df.withColumn("bare", F.when(F.col("label").startswith(lead), F.expr("substr(label, length(p_type) + 4)")).otherwise(F.col("label")))
    df = df.withColumn("brand_no", F.when(F.col("p_brand").startswith("Brand#"), F.expr("substr(p_brand, 7)")).otherwise(F.col("p_brand")))
    return df.drop("p_name", "p_brand", "p_type")


@query("""WITH a AS (SELECT c_custkey, nullif(c_nationkey % 7, 0) AS k FROM customer), b AS (SELECT nullif(n_nationkey % 7, 0) AS k, min(n_name) AS lead_name FROM nation GROUP BY 1)
SELECT a.c_custkey, b.lead_name FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k""")
def null_safe_merge(spark: SparkSession, d: str) -> DataFrame:
    """Join in which null meets null."""
    a = table(spark, d, "customer", "c_custkey", "c_nationkey").select("c_custkey", F.nullif(F.col("c_nationkey") % 7, F.lit(0)).alias("ka"))
    b = table(spark, d, "nation").select(F.nullif(F.col("n_nationkey") % 7, F.lit(0)).alias("kb"), "n_name").groupBy("kb").agg(F.min("n_name").alias("lead_name"))
    return a.join(lookup(b), F.col("ka").eqNullSafe(F.col("kb"))).select("c_custkey", "lead_name")


_RULES = [("^red ", "warm", "colour"), ("^blue ", "cold", "colour"), (" bolt$", "fastener", "object"), (" (gear|ring)$", "moving part", "object")]


@query("""WITH r(pattern, label, basis) AS (VALUES ('^red ', 'warm', 'colour'), ('^blue ', 'cold', 'colour'), (' bolt$', 'fastener', 'object'), (' (gear|ring)$', 'moving part', 'object'))
SELECT p_partkey, label, basis FROM part LEFT JOIN r ON regexp_matches(p_name, r.pattern)""")
def theta_rule_join(spark: SparkSession, d: str) -> DataFrame:
    """Left join to rules by regular expression."""
    rules = spark.createDataFrame(_RULES, "pattern string, label string, basis string")
    return R.theta_rules(table(spark, d, "part", "p_partkey", "p_name"), "p_name", rules, "pattern").select("p_partkey", "label", "basis")


@query("""WITH r(first_day, last_day, era) AS (VALUES (DATE '1995-01-01', DATE '1996-12-31', 'early'), (DATE '1997-01-01', DATE '1998-06-30', 'middle'), (DATE '2000-01-01', DATE '2001-03-31', 'late'))
SELECT o_orderkey, era FROM orders LEFT JOIN r ON CAST(o_orderdate AS DATE) BETWEEN first_day AND last_day""")
def range_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The range a date lies in."""
    rows = [("1995-01-01", "1996-12-31", "early"), ("1997-01-01", "1998-06-30", "middle"), ("2000-01-01", "2001-03-31", "late")]
    r = spark.createDataFrame(rows, "a string, b string, era string").select(F.to_date("a").alias("first_day"), F.to_date("b").alias("last_day"), "era")
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate").withColumn("day", F.to_date("o_orderdate"))
    return M.range_lookup(o, r, [], "day", "first_day", "last_day").select("o_orderkey", "era")


@query("""WITH f(o_orderkey, new_status, old_status) AS (VALUES (1, 'X', 'F'), (2, 'X', 'Z'), (5, 'Y', NULL)),
g AS (SELECT o.o_orderkey, o.o_orderstatus, f.new_status, f.old_status FROM orders o LEFT JOIN f ON o.o_orderkey = f.o_orderkey)
SELECT o_orderkey, CASE WHEN new_status IS NOT NULL AND o_orderstatus IS NOT DISTINCT FROM old_status THEN new_status ELSE o_orderstatus END AS o_orderstatus FROM g""")
def corrections_guarded(spark: SparkSession, d: str) -> DataFrame:
    """Corrections that hold only for the value they were written for."""
    fixes = spark.createDataFrame([(1, "X", "F"), (2, "X", "Z"), (5, "Y", None)], "o_orderkey long, new string, old string")
    orders = table(spark, d, "orders", "o_orderkey", "o_orderstatus")
    R.assert_cardinality(fixes, orders.join(F.broadcast(fixes.select("o_orderkey")), "o_orderkey", "left_semi"), ["o_orderkey"])
    return R.guarded_corrections(orders, fixes, ["o_orderkey"], "o_orderstatus", "new", "old")


@query("""WITH a AS (SELECT l_orderkey, min(l_shipdate) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_orderkey, min(l_shipdate) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
c AS (SELECT l_orderkey, max(l_shipdate) AS v FROM lineitem GROUP BY 1)
SELECT o_orderkey, strftime(coalesce(a.v, b.v, c.v, o_orderdate), '%Y-%m-%d') AS best_day,
CASE WHEN a.v IS NOT NULL THEN 'returned' WHEN b.v IS NOT NULL THEN 'finished' WHEN c.v IS NOT NULL THEN 'any line' ELSE 'order' END AS basis
FROM orders o LEFT JOIN a ON a.l_orderkey = o_orderkey LEFT JOIN b ON b.l_orderkey = o_orderkey LEFT JOIN c ON c.l_orderkey = o_orderkey""")
def precedence_join(spark: SparkSession, d: str) -> DataFrame:
    """First source that has a value. The three left joins of the sketch are
    one aggregate over one scan, so the orders are shuffled once."""
    lines = table(spark, d, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus", "l_shipdate").groupBy("l_orderkey").agg(
        F.min(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).alias("a"),
        F.min(F.when(F.col("l_linestatus") == "F", F.col("l_shipdate"))).alias("b"),
        F.max("l_shipdate").alias("c"),
    )
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    basis = F.when(F.col("a").isNotNull(), "returned").when(F.col("b").isNotNull(), "finished").when(F.col("c").isNotNull(), "any line").otherwise("order")
    return o.select("o_orderkey", F.date_format(F.coalesce("a", "b", "c", "o_orderdate"), "yyyy-MM-dd").alias("best_day"), basis.alias("basis"))


@query("""SELECT l_orderkey AS o_orderkey, string_agg(DISTINCT l_returnflag || l_linestatus, ', ' ORDER BY l_returnflag || l_linestatus) AS kinds, CAST(count(*) AS BIGINT) AS n_lines FROM lineitem GROUP BY 1""")
def correlated_rollup(spark: SparkSession, d: str) -> DataFrame:
    """What correlated subqueries gave, as one aggregate."""
    kind = F.concat("l_returnflag", "l_linestatus")
    return table(spark, d, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        A.ordered_text(kind, kind).alias("kinds"), F.count("*").alias("n_lines")
    )


@query("""WITH c AS (SELECT a.o_orderkey, b.o_orderkey AS match_id, CAST(date_diff('day', a.o_orderdate, b.o_orderdate) AS INT) AS k
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderstatus = 'F' AND abs(date_diff('day', a.o_orderdate, b.o_orderdate)) BETWEEN 1 AND 3 WHERE a.o_orderstatus = 'O')
SELECT o_orderkey, match_id, k AS offset_days FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(k), -k, match_id) AS r FROM c) WHERE r = 1""")
def nearest_date_match(spark: SparkSession, d: str) -> DataFrame:
    """Nearest date at +1, -1, +2, -2, +3, -3 days."""
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus").withColumn("day", F.to_date("o_orderdate"))
    left, right = o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'").select("o_custkey", "day", F.col("o_orderkey").alias("r"))
    return M.nearest_by_offset(left, right, ["o_custkey"], "day", "r", [1, -1, 2, -2, 3, -3], "o_orderkey")


@query("""WITH l AS (SELECT DISTINCT p_brand, p_name FROM part WHERE p_type = 'PROMO'), r AS (SELECT DISTINCT p_brand, p_name FROM part WHERE p_type = 'SMALL'),
c AS (SELECT l.p_brand, l.p_name, r.p_name AS match_name, CASE WHEN l.p_name = r.p_name THEN 0 WHEN split_part(l.p_name, ' ', 2) = split_part(r.p_name, ' ', 2) THEN 1 WHEN split_part(l.p_name, ' ', 1) = split_part(r.p_name, ' ', 1) THEN 2 END AS k
FROM l JOIN r USING (p_brand))
SELECT p_brand, p_name, match_name, CASE k WHEN 0 THEN 'exact' WHEN 1 THEN 'object' ELSE 'colour' END AS tier
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY k, match_name) AS rn FROM c WHERE k IS NOT NULL) WHERE rn = 1""")
def tiered_title_match(spark: SparkSession, d: str) -> DataFrame:
    """Exact before partial matches, one per key."""
    p = table(spark, d, "part", "p_brand", "p_name", "p_type")
    left = p.where("p_type = 'PROMO'").select("p_brand", "p_name").distinct()
    right = p.where("p_type = 'SMALL'").select("p_brand", F.col("p_name").alias("match_name")).distinct()
    word = lambda c, i: F.split(F.col(c), " ")[i]
    tiers = [("exact", F.col("p_name") == F.col("match_name")), ("object", word("p_name", 1) == word("match_name", 1)), ("colour", word("p_name", 0) == word("match_name", 0))]
    return M.first_of_tiers(left.join(right, "p_brand"), ["p_brand", "p_name"], tiers, [F.col("match_name")]).select("p_brand", "p_name", "match_name", "tier")


@query(None)
def greedy_claim(spark: SparkSession, d: str) -> DataFrame:
    """Open and finished orders of one month and priority paired best first,
    from all pairs whose prices are at least 0.6 alike (the floor of X2). Prices of
    zero and below are alike to nothing."""
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "o_totalprice").where("o_totalprice > 0 AND o_orderstatus IN ('O', 'F')").withColumn("group", F.concat_ws("|", F.date_format("o_orderdate", "yyyy-MM"), "o_orderpriority"))
    return M.claim_closest(o, "group", "o_orderkey", "o_totalprice", F.col("o_orderstatus") == "F", 0.6)


@query("""WITH l AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS computed FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1), p AS (SELECT o_orderkey, o_totalprice AS printed FROM orders WHERE o_orderstatus <> 'P')
SELECT coalesce(o_orderkey, l_orderkey) AS k, round(printed, 2) AS printed, computed, round(computed - printed, 2) AS difference,
CASE WHEN printed IS NULL THEN 'only computed' WHEN computed IS NULL THEN 'only printed' WHEN computed > printed THEN 'above' ELSE 'below' END AS verdict
FROM p FULL OUTER JOIN l ON o_orderkey = l_orderkey""")
def full_outer_recon(spark: SparkSession, d: str) -> DataFrame:
    """Printed against computed totals; a missing side keeps nulls."""
    lines = table(spark, d, "lineitem", "l_orderkey", "l_extendedprice", "l_returnflag").where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum("l_extendedprice"), 2).alias("computed"))
    p = table(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderstatus").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), F.round("o_totalprice", 2).alias("printed"))
    v = F.when(F.col("printed").isNull(), "only computed").when(F.col("computed").isNull(), "only printed").when(F.col("computed") > F.col("printed"), "above").otherwise("below")
    return p.join(lines, "k", "full_outer").select("k", "printed", "computed", F.round(F.col("computed") - F.col("printed"), 2).alias("difference"), v.alias("verdict"))


@query("""SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS n_finished, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS open_value,
CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers, round(avg(o_totalprice), 2) AS mean_price, round(min(o_totalprice), 2) AS least, round(max(o_totalprice), 2) AS most FROM orders GROUP BY 1""")
def filter_aggs(spark: SparkSession, d: str) -> DataFrame:
    """A1, A2, A4."""
    p = F.col("o_totalprice")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("o_orderstatus") == "F").alias("n_finished"),
        F.round(F.sum(F.when(F.col("o_orderstatus") == "O", p)), 2).alias("open_value"),
        F.countDistinct("o_custkey").alias("customers"),
        F.round(F.avg(p), 2).alias("mean_price"),
        F.round(F.min(p), 2).alias("least"),
        F.round(F.max(p), 2).alias("most"),
    )


@query("""SELECT event_type, CAST(count(DISTINCT (nullif(user_id % 5, 0), CAST(ts AS DATE))) AS BIGINT) AS pairs FROM events GROUP BY 1""")
def tuple_distinct(spark: SparkSession, d: str) -> DataFrame:
    """A3: distinct pairs, a null in a pair counts."""
    pair = F.struct(F.nullif(F.col("user_id") % 5, F.lit(0)).alias("u"), F.to_date("ts").alias("day"))
    return table(spark, d, "events", "event_type", "user_id", "ts").groupBy("event_type").agg(F.countDistinct(pair).alias("pairs"))


@query("""WITH x AS (SELECT DISTINCT o_custkey, o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS r, o_orderstatus FROM orders)
SELECT o_custkey, o_orderpriority, string_agg(o_orderstatus, ' > ' ORDER BY r) AS statuses FROM x GROUP BY 1, 2""")
def ordered_string_agg(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values in the order of a closed vocabulary."""
    rank = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    return table(spark, d, "orders", "o_custkey", "o_orderpriority", "o_orderstatus").groupBy("o_custkey", "o_orderpriority").agg(A.ordered_text(F.col("o_orderstatus"), rank, " > ").alias("statuses"))


@query("""WITH v AS (SELECT o_custkey, o_orderstatus, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1, 2), m AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, f, o_orderstatus) AS r FROM v),
b AS (SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS dearest, arg_min(o_orderkey, o_totalprice) AS cheapest FROM orders GROUP BY 1)
SELECT m.o_custkey, o_orderstatus AS usual_status, CAST(n AS BIGINT) AS votes, dearest, cheapest FROM m JOIN b USING (o_custkey) WHERE r = 1""")
def argmax_mode(spark: SparkSession, d: str) -> DataFrame:
    """Mode with a stated tie rule, arg max and arg min."""
    o = table(spark, d, "orders", "o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice")
    usual = A.majority(o, ["o_custkey"], ["o_orderstatus"], "o_orderkey").withColumnRenamed("o_orderstatus", "usual_status")
    ends = o.groupBy("o_custkey").agg(F.max_by("o_orderkey", "o_totalprice").alias("dearest"), F.min_by("o_orderkey", "o_totalprice").alias("cheapest"))
    return usual.join(ends, "o_custkey").select("o_custkey", "usual_status", "votes", "dearest", "cheapest")


@query("""WITH n AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2),
o AS (SELECT a.event_type, a.day, a.n, list_sort(list(b.n)) AS r FROM n a JOIN n b ON a.event_type = b.event_type AND a.day <> b.day GROUP BY 1, 2, 3)
SELECT event_type, strftime(day, '%Y-%m-%d') AS day, CAST(n AS BIGINT) AS n, CAST(r[len(r) // 2 + 1] AS BIGINT) AS others_median,
CASE WHEN n < 0.8 * r[len(r) // 2 + 1] THEN 'low' WHEN n > 1.25 * r[len(r) // 2 + 1] THEN 'high' ELSE 'usual' END AS band FROM o WHERE len(r) >= 4""")
def leave_one_out_median(spark: SparkSession, d: str) -> DataFrame:
    """Each day against the median of the other days."""
    n = table(spark, d, "events", "event_type", "ts").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    m = A.others_median(n, ["event_type"], "day", "n")
    band = F.when(F.col("n") < 0.8 * F.col("others_median"), "low").when(F.col("n") > 1.25 * F.col("others_median"), "high").otherwise("usual")
    return m.select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "others_median", band.alias("band"))


@query("""WITH v AS (SELECT l_orderkey, l_returnflag, l_linestatus, count(*) AS n, min(l_shipdate) AS f FROM lineitem GROUP BY 1, 2, 3)
SELECT l_orderkey, l_returnflag, l_linestatus, CAST(n AS BIGINT) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, f, l_returnflag, l_linestatus) AS r FROM v) WHERE r = 1""")
def majority_pair_vote(spark: SparkSession, d: str) -> DataFrame:
    """Two fields voted on as a pair."""
    return A.majority(table(spark, d, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus", "l_shipdate"), ["l_orderkey"], ["l_returnflag", "l_linestatus"], "l_shipdate")


@query("""WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS content, event_id FROM events),
v AS (SELECT user_id, day, content, count(*) AS n, min(event_id) AS f FROM s GROUP BY 1, 2, 3)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, content, CAST(n AS BIGINT) AS corroborated FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY content IS NULL, n DESC, f) AS r FROM v) WHERE r = 1""")
def sample_union_vote(spark: SparkSession, d: str) -> DataFrame:
    """Repeated samples of a cell; content beats darkness, then the most corroborated."""
    e = table(spark, d, "events", "user_id", "ts", "event_type", "event_id")
    s = e.select("user_id", F.to_date("ts").alias("day"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("content"), "event_id")
    v = s.groupBy("user_id", "day", "content").agg(F.count("*").alias("corroborated"), F.min("event_id").alias("f"))
    w = Window.partitionBy("user_id", "day").orderBy(F.col("content").isNull(), F.desc("corroborated"), "f")
    return v.withColumn("r", F.row_number().over(w)).where("r = 1").select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "content", "corroborated")


@query("""WITH t AS (SELECT lang, source, unnest(regexp_extract_all(lower(text), '[a-zа-яѣіѳѵё]+')) AS w FROM documents WHERE lang IS NOT NULL AND source IN ('obituary', 'premiere_notice')),
g AS (SELECT lang AS k, source, w, count(*) AS n FROM t GROUP BY 1, 2, 3), a AS (SELECT k, w, n FROM g WHERE source = 'obituary'), b AS (SELECT k, w, n FROM g WHERE source = 'premiere_notice'),
j AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b ON a.k = b.k AND a.w = b.w)
SELECT k, CAST(sum(x) AS BIGINT) AS n_left, CAST(sum(y) AS BIGINT) AS n_right, CAST(sum(least(x, y)) AS BIGINT) AS n_both,
CASE WHEN sum(y) > 0 THEN round(sum(least(x, y)) / sum(y), 6) END AS prec, CASE WHEN sum(x) > 0 THEN round(sum(least(x, y)) / sum(x), 6) END AS rec FROM j GROUP BY 1""")
def bag_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    """Word bags of two sources compared, per language."""
    t = table(spark, d, "documents", "lang", "source", "text").where("lang is not null")
    w = t.select(F.col("lang").alias("k"), "source", F.explode(words(F.col("text"))).alias("w"))
    return A.bag_overlap(w.where("source = 'obituary'"), w.where("source = 'premiere_notice'"), "k", "w")


@query("""WITH x AS (SELECT l_orderkey, l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY 1, 2), p AS (SELECT l_orderkey, coalesce(max(n) FILTER (WHERE f = 'A'), 0) AS a, coalesce(max(n) FILTER (WHERE f = 'R'), 0) AS r, coalesce(max(n) FILTER (WHERE f = 'N'), 0) AS n FROM x GROUP BY 1)
SELECT l_orderkey, CASE WHEN a = r AND r = n THEN 'exact' WHEN (a >= r AND a >= n) OR (r >= a AND r >= n) OR (n >= a AND n >= r) THEN CASE WHEN greatest(a, r, n) = a + r + n THEN 'clear' ELSE 'ambiguous' END END AS standing FROM p""")
def bag_dominance(spark: SparkSession, d: str) -> DataFrame:
    """Whether one kind covers the whole bag."""
    c = lambda f: F.count_if(F.col("l_returnflag") == f)
    p = table(spark, d, "lineitem", "l_orderkey", "l_returnflag").groupBy("l_orderkey").agg(c("A").alias("a"), c("R").alias("r"), c("N").alias("n"))
    all_ = F.col("a") + F.col("r") + F.col("n")
    s = F.when((F.col("a") == F.col("r")) & (F.col("r") == F.col("n")), "exact").when(F.greatest("a", "r", "n") == all_, "clear").otherwise("ambiguous")
    return p.select("l_orderkey", s.alias("standing"))


@query("""SELECT CASE WHEN GROUPING(o_orderpriority) = 1 THEN 'all' ELSE o_orderpriority END AS priority, o_orderstatus AS status, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderstatus, o_orderpriority))""")
def two_level_family(spark: SparkSession, d: str) -> DataFrame:
    """Two levels in one pass."""
    table(spark, d, "orders", "o_orderpriority", "o_orderstatus", "o_totalprice").createOrReplaceTempView("vellum_orders_levels")
    return spark.sql("""SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'all' ELSE o_orderpriority END AS priority, o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total
        FROM vellum_orders_levels GROUP BY GROUPING SETS ((o_orderstatus), (o_orderstatus, o_orderpriority))""")


@query("""WITH f AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '+' ORDER BY l_returnflag) AS k, count(DISTINCT l_returnflag) AS c FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN c = 1 THEN k ELSE 'mixed:' || k END AS family FROM f""")
def family_of_events(spark: SparkSession, d: str) -> DataFrame:
    """One family, or mixed with its parts."""
    g = table(spark, d, "lineitem", "l_orderkey", "l_returnflag").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_returnflag")).alias("k"))
    return g.select("l_orderkey", F.when(F.size("k") == 1, F.col("k")[0]).otherwise(F.concat(F.lit("mixed:"), F.array_join("k", "+"))).alias("family"))


@query("""WITH e AS (SELECT l_orderkey, count(*) AS n_rows, count(DISTINCT l_linenumber) AS explicit FROM lineitem GROUP BY 1), m AS (SELECT o_orderkey, CAST(2 + o_custkey % 3 AS BIGINT) AS matched FROM orders)
SELECT l_orderkey, CAST(greatest(explicit, least(n_rows, matched)) AS BIGINT) AS counted FROM e JOIN m ON l_orderkey = o_orderkey""")
def capped_counts(spark: SparkSession, d: str) -> DataFrame:
    """max(explicit, min(rows, matched))."""
    e = table(spark, d, "lineitem", "l_orderkey", "l_linenumber").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.countDistinct("l_linenumber").alias("x"))
    m = table(spark, d, "orders", "o_orderkey", "o_custkey").select("o_orderkey", (2 + F.col("o_custkey") % 3).alias("m"))
    return e.join(m, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", F.greatest("x", F.least("n", "m")).alias("counted"))


@query("""SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS flags, bool_or(l_discount > 0.09) AS any_deep, CAST(min(l_suppkey) AS BIGINT) AS any_supplier, CAST(count(*) AS BIGINT) AS n
FROM lineitem GROUP BY ALL HAVING count(*) >= 4 AND count(*) FILTER (WHERE l_linestatus = 'F') > 0""")
def set_and_misc_aggs(spark: SparkSession, d: str) -> DataFrame:
    """A6, A7, A10 to A13, A24."""
    g = table(spark, d, "lineitem", "l_orderkey", "l_returnflag", "l_discount", "l_suppkey", "l_linestatus").groupBy("l_orderkey").agg(
        F.array_join(F.sort_array(F.collect_set("l_returnflag")), "|").alias("flags"),
        F.bool_or(F.col("l_discount") > 0.09).alias("any_deep"),
        F.min("l_suppkey").alias("any_supplier"),
        F.count("*").alias("n"),
        F.count_if(F.col("l_linestatus") == "F").alias("f"),
    )
    return g.where("n >= 4 and f > 0").drop("f")


@query("""SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * 100 + CAST(round((o_totalprice - floor(o_totalprice)) * 100) AS BIGINT) AS minor FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderstatus = 'P'""")
def minor_unit_money(spark: SparkSession, d: str) -> DataFrame:
    """text money to minor units, null without the main unit."""
    o = table(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderstatus")
    p = F.col("o_totalprice")
    text = o.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.floor(p).cast("string")).alias("major"), F.round((p - F.floor(p)) * 100).cast("int").cast("string").alias("minor"))
    return text.select("o_orderkey", minor_units(F.col("major"), F.col("minor")).alias("minor"))


@query("""SELECT 'union' AS op, c_nationkey AS k FROM customer UNION SELECT 'union', s_nationkey FROM supplier
UNION ALL SELECT 'intersect', k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'except', k FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier)""")
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    """U1, U3, U4, U5."""
    c, s = table(spark, d, "customer", "c_nationkey", "c_acctbal"), table(spark, d, "supplier", "s_nationkey")
    n = table(spark, d, "nation", "n_nationkey")
    k = lambda df, col: df.select(F.col(col).alias("k"))
    u = k(c, "c_nationkey").union(k(s, "s_nationkey")).distinct()
    i = k(c.where("c_acctbal > 9000"), "c_nationkey").intersect(k(s, "s_nationkey"))
    x = k(n, "n_nationkey").subtract(k(s, "s_nationkey"))
    tag = lambda df, op: df.select(F.lit(op).alias("op"), "k")
    return tag(u, "union").unionByName(tag(i, "intersect")).unionByName(tag(x, "except"))


@query("""SELECT * FROM (SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS price, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS INT) AS place FROM orders) WHERE place <= 3""")
def sort_topk(spark: SparkSession, d: str) -> DataFrame:
    """Best three orders of each customer."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey")
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice").withColumn("place", F.row_number().over(w))
    return o.where("place <= 3").select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("price"), "place")


@query("""SELECT c_custkey, o_orderkey AS first_order, strftime(o_orderdate, '%Y-%m-%d') AS first_day FROM (SELECT o_custkey AS c_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1""")
def first_per_group(spark: SparkSession, d: str) -> DataFrame:
    """Earliest row of each key, without a sort: min of (date, id)."""
    g = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("m"))
    return g.select("c_custkey", F.col("m.o_orderkey").alias("first_order"), F.date_format("m.o_orderdate", "yyyy-MM-dd").alias("first_day"))


@query("""SELECT n_name, o_orderpriority, CAST(count(*) AS BIGINT) AS n, min(year(o_orderdate)) AS first_year FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1, 2""")
def analytics_basic(spark: SparkSession, d: str) -> DataFrame:
    """Counts per key over joined tables, semi-join for EXISTS."""
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    r = table(spark, d, "lineitem", "l_orderkey", "l_returnflag").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    c = table(spark, d, "customer", "c_custkey", "c_nationkey").join(F.broadcast(table(spark, d, "nation", "n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    j = o.join(r, "o_orderkey", "left_semi").join(c, F.col("o_custkey") == F.col("c_custkey"))  # nations are a fixed list
    return j.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("n"), F.min(F.year("o_orderdate")).alias("first_year"))


@query("""SELECT c_custkey, CASE WHEN o.n IS NOT NULL THEN 'orders' WHEN c_acctbal < 0 THEN 'account' ELSE 'none' END AS attribution, CAST(coalesce(o.n, 0) AS BIGINT) AS n
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) o ON o_custkey = c_custkey""")
def tiered_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Attribution with fallback."""
    u = table(spark, d, "orders", "o_custkey", "o_orderpriority").where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, d, "customer", "c_custkey", "c_acctbal").join(u, F.col("c_custkey") == F.col("o_custkey"), "left")
    a = F.when(F.col("n").isNotNull(), "orders").when(F.col("c_acctbal") < 0, "account").otherwise("none")
    return c.select("c_custkey", a.alias("attribution"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH k AS (SELECT l_orderkey, CASE WHEN bool_or(l_discount >= 0.1) THEN 'special' WHEN count(*) = 1 THEN 'solo' ELSE 'shared' END AS kind, sum(l_extendedprice) AS receipt FROM lineitem GROUP BY 1)
SELECT 'all' AS basis, CAST(count(*) AS BIGINT) AS n, round(avg(receipt), 2) AS mean_receipt FROM k WHERE kind <> 'special' UNION ALL SELECT 'solo', CAST(count(*) AS BIGINT), round(avg(receipt), 2) FROM k WHERE kind = 'solo'""")
def box_office(spark: SparkSession, d: str) -> DataFrame:
    """Mean receipts of solo and of all events, special ones left out."""
    g = table(spark, d, "lineitem", "l_orderkey", "l_discount", "l_extendedprice").groupBy("l_orderkey").agg(
        F.when(F.bool_or(F.col("l_discount") >= 0.1), "special").when(F.count("*") == 1, "solo").otherwise("shared").alias("kind"), F.sum("l_extendedprice").alias("receipt")
    )
    both = g.where("kind <> 'special'").select(F.explode(F.when(F.col("kind") == "solo", F.array(F.lit("all"), F.lit("solo"))).otherwise(F.array(F.lit("all")))).alias("basis"), "receipt")
    return both.groupBy("basis").agg(F.count("*").alias("n"), F.round(F.avg("receipt"), 2).alias("mean_receipt"))


@query("""SELECT 'customer' AS kind, c_custkey AS id, c_name AS label, NULL AS city FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL FROM supplier UNION ALL SELECT 'nation', n_nationkey, n_name, NULL FROM nation
UNION ALL SELECT 'production', source_page_index, title, city FROM production_entry""")
def provenance_union(spark: SparkSession, d: str) -> DataFrame:
    """Union by name, missing columns null."""
    parts = [
        table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("label")),
        table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("label")),
        table(spark, d, "nation").select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("label")),
        table(spark, d, "production_entry").select(F.lit("production").alias("kind"), F.col("source_page_index").cast("long").alias("id"), F.col("title").alias("label"), "city"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


@query("""SELECT l_orderkey, CAST(l_linenumber AS INT) AS l_linenumber, round(l_quantity, 2) AS l_quantity FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(l_quantity >= 50))""")
def whole_group_view(spark: SparkSession, d: str) -> DataFrame:
    """Whole group kept if any of its rows is flagged."""
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    keep = lines.where("l_quantity >= 50").select("l_orderkey").distinct()
    return lines.join(keep, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", F.round("l_quantity", 2).alias("l_quantity"))


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), c AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT c_custkey AS k, CASE WHEN a.n = b.n AND b.n = c.n THEN 'all agree' WHEN a.n = b.n THEN 'first two agree' WHEN b.n = c.n THEN 'last two agree' WHEN a.n = c.n THEN 'first and last agree' ELSE 'all differ' END AS verdict
FROM customer LEFT JOIN a ON a.k = c_custkey LEFT JOIN b ON b.k = c_custkey LEFT JOIN c ON c.k = c_custkey""")
def three_source_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Verdict of three counts; missing never agrees."""
    n = lambda s: F.nullif(F.count_if(F.col("o_orderstatus") == s), F.lit(0))
    g = table(spark, d, "orders", "o_custkey", "o_orderstatus").groupBy(F.col("o_custkey").alias("k")).agg(n("F").alias("a"), n("O").alias("b"), n("P").alias("c"))
    cust = table(spark, d, "customer", "c_custkey").select(F.col("c_custkey").alias("k"))
    return cust.join(g, "k", "left").select("k", A.verdict(F.col("a"), F.col("b"), F.col("c")).alias("verdict"))


@query("""WITH r(name, city_list) AS (VALUES ('purchase', '0,1'), ('signup', '2'), ('view', '0,2')), s(season) AS (VALUES (1), (2))
SELECT season, r.name, CAST(u AS INT) AS u FROM s, r, (SELECT DISTINCT CAST(user_id % 3 AS INT) AS u FROM events) x WHERE list_contains(string_split(city_list, ','), CAST(u AS VARCHAR))""")
def roster_cross_grid(spark: SparkSession, d: str) -> DataFrame:
    """Small season by roster grid, narrowed by array membership. The
    roster and the seasons are written lists; the table side is one row per remainder."""
    r = spark.createDataFrame([("purchase", ["0", "1"]), ("signup", ["2"]), ("view", ["0", "2"])], "name string, cities array<string>")
    seasons = F.explode(F.array(F.lit(1), F.lit(2))).alias("season")
    grid = r.select(seasons, "name", "cities").select("season", "name", F.explode("cities").alias("city")).withColumn("u", F.col("city").cast("int"))
    seen = table(spark, d, "events", "user_id").select((F.col("user_id") % 3).cast("int").alias("u")).distinct()
    return grid.join(seen, "u", "left_semi").select("season", "name", "u")


@query("""WITH v AS (SELECT l_orderkey, count(*) AS n, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS moved FROM lineitem GROUP BY 1)
SELECT l_orderkey AS entity, CAST(n - moved AS BIGINT) AS n FROM v WHERE n > moved UNION ALL SELECT -1 - l_orderkey, CAST(moved AS BIGINT) FROM v WHERE moved > 0""")
def split_and_recount(spark: SparkSession, d: str) -> DataFrame:
    """Rows moved to a derived entity; counts by aggregation, empty entities vanish."""
    l = table(spark, d, "lineitem", "l_orderkey", "l_returnflag")
    e = F.when(F.col("l_returnflag") == "A", -1 - F.col("l_orderkey")).otherwise(F.col("l_orderkey"))
    return l.select(e.alias("entity")).groupBy("entity").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS sib FROM lineitem GROUP BY 1)
SELECT l.l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_returnflag = 'N' AND sib THEN 'by sibling' WHEN l_returnflag = 'N' THEN 'plain' ELSE 'own' END AS class FROM lineitem l JOIN s USING (l_orderkey)""")
def sibling_context(spark: SparkSession, d: str) -> DataFrame:
    """Class decided by another row of the same group."""
    l = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    sib = F.bool_or(F.col("l_returnflag") == "R").over(Window.partitionBy("l_orderkey"))
    c = F.when((F.col("l_returnflag") == "N") & F.col("sib"), "by sibling").when(F.col("l_returnflag") == "N", "plain").otherwise("own")
    return l.withColumn("sib", sib).select("l_orderkey", "l_linenumber", "l_suppkey", c.alias("class"))


@query("""WITH a AS (SELECT l_orderkey AS k, max(round(l_tax, 2)) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_orderkey AS k, max(round(l_tax, 2)) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL OR b.k IS NULL THEN 'passthrough' WHEN a.v = b.v THEN 'agreed' WHEN coalesce(a.k, b.k) % 7 = 0 THEN 'ruled' ELSE 'pending' END AS state,
CASE WHEN a.k IS NULL THEN b.v WHEN b.k IS NULL OR a.v = b.v THEN a.v WHEN coalesce(a.k, b.k) % 7 = 0 THEN greatest(a.v, b.v) END AS value FROM a FULL JOIN b ON a.k = b.k""")
def half_merge(spark: SparkSession, d: str) -> DataFrame:
    """Halves merged, rulings applied, nothing lost."""
    v = lambda s: F.max(F.when(F.col("l_linestatus") == s, F.round("l_tax", 2)))
    g = table(spark, d, "lineitem", "l_orderkey", "l_linestatus", "l_tax").groupBy(F.col("l_orderkey").alias("k")).agg(v("F").alias("a"), v("O").alias("b"))
    one, ruled = F.col("a").isNull() | F.col("b").isNull(), F.col("k") % 7 == 0
    state = F.when(one, "passthrough").when(F.col("a") == F.col("b"), "agreed").when(ruled, "ruled").otherwise("pending")
    value = F.when(one | (F.col("a") == F.col("b")), F.coalesce("a", "b")).when(ruled, F.greatest("a", "b"))
    return g.select("k", state.alias("state"), value.alias("value"))
