"""Queries of ordered rows and the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.operators import calendar as C
from vellum.operators import runs as R
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


def _days(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "user_id", "event_type", "ts").select("user_id", "event_type", F.to_date("ts").alias("day")).distinct()


_GRID = """WITH e AS (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events), b AS (SELECT user_id, min(day) AS a, max(day) AS z FROM e GROUP BY 1),
g AS (SELECT user_id, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS day FROM b), m AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.user_id = g.user_id AND e.day = g.day)),
"""


@query(
    _GRID
    + """u AS (SELECT user_id, event_type, day, 'captured' AS status FROM e UNION ALL SELECT user_id, NULL, day, 'not_captured' FROM m)
SELECT user_id, event_type, strftime(day, '%Y-%m-%d') AS day, status FROM u"""
)
def gap_synthesis(spark: SparkSession, d: str) -> DataFrame:
    """Days between a user's first and last without any event."""
    out = C.synthesize_gaps(_days(spark, d), ["user_id"], "day")
    return out.select("user_id", "event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "status")


@query(_GRID + """c AS (SELECT DISTINCT user_id, day + 1 AS day FROM e WHERE event_type = 'error') SELECT user_id, strftime(day, '%Y-%m-%d') AS day FROM m WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = m.user_id AND c.day = m.day)""")
def gap_suppression(spark: SparkSession, d: str) -> DataFrame:
    """A placeholder goes where a corrected row has its day."""
    days = _days(spark, d)
    gaps = C.synthesize_gaps(days, ["user_id"], "day").where("status = 'not_captured'").select("user_id", "day")
    moved = days.where("event_type = 'error'").select("user_id", F.date_add("day", 1).alias("day"))
    return gaps.join(moved, ["user_id", "day"], "left_anti").select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("""WITH n AS (SELECT event_id, user_id, event_type, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run_no FROM n)
SELECT user_id, CAST(run_no AS BIGINT) AS run_no, min(event_type) AS event_type, CAST(count(*) AS BIGINT) AS n, min(event_id) AS first_id FROM r GROUP BY 1, 2""")
def islands_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of the same event type of a user."""
    e = R.islands(table(spark, d, "events", "event_id", "user_id", "event_type"), ["user_id"], ["event_id"], "event_type")
    return e.groupBy("user_id", "run_no").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""WITH n AS (SELECT o_custkey, o_orderkey, o_orderstatus AS v, CASE WHEN lag(o_orderstatus) OVER w = o_orderstatus THEN 0 ELSE 1 END AS new FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
p AS (SELECT o_custkey, v, sum(new) AS s, count(*) AS r FROM n GROUP BY 1, 2), k AS (SELECT *, row_number() OVER w AS k, lead(s) OVER w AS s2, lead(r) OVER w AS r2 FROM p WINDOW w AS (PARTITION BY o_custkey ORDER BY s DESC, r DESC, v)),
l AS (SELECT o_custkey, v, CASE WHEN s2 IS NULL THEN 'consistent' WHEN s > s2 THEN 'by stretches' WHEN r > r2 THEN 'by rows' ELSE 'unresolved' END AS label FROM k WHERE k = 1)
SELECT o_custkey, CASE WHEN label <> 'unresolved' THEN v END AS winner, label FROM l""")
def stretch_choice(spark: SparkSession, d: str) -> DataFrame:
    """The value with most unbroken stretches."""
    return R.stretch_choice(table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey"], "o_orderstatus")


@query("""WITH f AS (SELECT o_custkey, o_orderkey, CASE WHEN day(o_orderdate) < lag(day(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) THEN 1 ELSE 0 END AS f FROM orders)
SELECT o_custkey, o_orderkey, CAST(sum(f) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS segment_no FROM f""")
def month_segments(spark: SparkSession, d: str) -> DataFrame:
    """A new segment whenever the day falls."""
    o = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate").withColumn("dom", F.dayofmonth("o_orderdate"))
    return R.segments_on_fall(o, ["o_custkey"], ["o_orderkey"], "dom").select("o_custkey", "o_orderkey", "segment_no")


@query("""SELECT o_custkey, o_orderkey, coalesce(o_orderdate < max(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS out_of_order FROM orders""")
def monotonic_check(spark: SparkSession, d: str) -> DataFrame:
    """Rows that lie before an earlier row's date."""
    o = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate")
    return R.falls_back(o, ["o_custkey"], ["o_orderkey"], "o_orderdate", "out_of_order").drop("o_orderdate")


@query("""WITH s AS (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'N' THEN 2 ELSE 3 END AS section FROM lineitem),
m AS (SELECT *, max(section) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM s)
SELECT l_suppkey, section, CAST(count(*) AS BIGINT) AS rows_back, min(l_orderkey) AS first_order FROM m WHERE section < top GROUP BY 1, 2""")
def running_max_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a section behind the highest section reached before them."""
    f = F.col("l_returnflag")
    b = table(spark, d, "lineitem", "l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber").withColumn("section", F.when(f == "A", 1).when(f == "N", 2).otherwise(3)).drop("l_returnflag").distinct()
    back = R.falls_back(b, ["l_suppkey"], ["l_orderkey", "l_linenumber", "section"], "section").where("falls_back")
    return back.groupBy("l_suppkey", "section").agg(F.count("*").alias("rows_back"), F.min("l_orderkey").alias("first_order"))


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'signup' THEN event_id END AS n FROM events), u AS (SELECT *, count(*) FILTER (WHERE n IS NULL) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS blank FROM e),
g AS (SELECT user_id, n, lead(n) OVER w - n - 1 AS hole, lead(blank) OVER w - blank AS between_ FROM u WHERE n IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, n AS after, CAST(hole AS BIGINT) AS hole, CAST(between_ AS BIGINT) AS unnumbered, CAST(hole - between_ AS BIGINT) AS missing FROM g WHERE hole > 0 AND hole > between_""")
def number_gap_allowance(spark: SparkSession, d: str) -> DataFrame:
    """Holes in a numbering beyond what unnumbered rows between allow for."""
    e = table(spark, d, "events", "user_id", "event_id", "event_type").withColumn("n", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return R.number_gaps_allowing(e, ["user_id"], ["event_id"], "n")


@query("""WITH m AS (SELECT DISTINCT mention_id, block_id, char_start, link_confidence FROM review_mention WHERE block_id IS NOT NULL),
n AS (SELECT *, CASE WHEN link_confidence IS NOT DISTINCT FROM lag(link_confidence) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM m WINDOW w AS (PARTITION BY block_id ORDER BY char_start NULLS LAST, mention_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY block_id ORDER BY char_start NULLS LAST, mention_id ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT block_id, min(mention_id) AS first_mention, CAST(count(*) AS BIGINT) AS length FROM r WHERE link_confidence = 'low' GROUP BY block_id, run HAVING count(*) >= 3""")
def shift_block(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of at least three doubtful rows in a row; shorter ones are chance."""
    m = table(spark, d, "review_mention", "mention_id", "block_id", "char_start", "link_confidence").where("block_id is not null").distinct()
    runs = R.islands(m, ["block_id"], ["char_start", "mention_id"], "link_confidence").where("link_confidence = 'low'")
    return runs.groupBy("block_id", "run_no").agg(F.min("mention_id").alias("first_mention"), F.count("*").alias("length")).where("length >= 3").drop("run_no")


@query("""WITH o AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before_id FROM events)
SELECT user_id, before_id AS view_id, event_id AS purchase_id FROM o WHERE before = 'view' AND event_type = 'purchase'""")
def adjacent_pairing(spark: SparkSession, d: str) -> DataFrame:
    """A view and the purchase right after it are one visit."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events", "user_id", "event_id", "event_type").withColumn("before", F.lag("event_type").over(w)).withColumn("view_id", F.lag("event_id").over(w))
    return e.where("before = 'view' and event_type = 'purchase'").select("user_id", "view_id", F.col("event_id").alias("purchase_id"))


@query("""WITH e AS (SELECT user_id, event_id, value, event_type = 'purchase' AS t FROM events), b AS (SELECT *, coalesce(sum(CASE WHEN t THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block_no FROM e)
SELECT user_id, CAST(block_no AS BIGINT) AS block_no, round(max(value) FILTER (WHERE t), 2) AS stated, round(sum(value) FILTER (WHERE NOT t), 2) AS summed FROM b GROUP BY 1, 2""")
def block_total_check(spark: SparkSession, d: str) -> DataFrame:
    """Stated totals against the rows since the total before."""
    b = R.block_totals(table(spark, d, "events", "user_id", "event_id", "value", "event_type"), ["user_id"], ["event_id"], "value", F.col("event_type") == "purchase")
    return b.select("user_id", "block_no", F.round("stated", 2).alias("stated"), F.round("summed", 2).alias("summed"))


@query("""WITH c AS (SELECT o_orderkey, o_custkey, o_orderdate, count(*) OVER (PARTITION BY o_custkey, o_orderpriority, o_orderstatus) AS n, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority, o_orderstatus) AS m FROM orders)
SELECT o_orderkey, CASE WHEN n = 1 THEN m END AS linked, CASE WHEN n = 1 THEN 'unique' ELSE 'several' END AS note FROM c""")
def uniqueness_guard(spark: SparkSession, d: str) -> DataFrame:
    """Link only where exactly one row has the key."""
    w = Window.partitionBy("o_custkey", "o_orderpriority", "o_orderstatus")
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus").withColumn("n", F.count("*").over(w)).withColumn("m", F.min("o_orderkey").over(w))
    return o.select("o_orderkey", F.when(F.col("n") == 1, F.col("m")).alias("linked"), F.when(F.col("n") == 1, "unique").otherwise("several").alias("note"))


@query("""WITH n AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate, CASE WHEN l_discount >= 0.05 THEN NULL ELSE l_quantity END AS q FROM lineitem),
u AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS s, max(q) AS q FROM n GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, round(coalesce(q, lead(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)), 2) AS q FROM u""")
def next_sibling_fill(spark: SparkSession, d: str) -> DataFrame:
    """A blank count is the next row's."""
    n = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_quantity").withColumn("q", F.when(F.col("l_discount") < 0.05, F.col("l_quantity")))
    u = n.groupBy("l_orderkey", "l_linenumber").agg(F.max("q").alias("q"))
    return R.fill_from_next(u, ["l_orderkey"], ["l_linenumber"], "q").select("l_orderkey", "l_linenumber", F.round("q", 2).alias("q"))


@query("""WITH b AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders), p AS (SELECT o_custkey, d, CAST(date_diff('day', DATE '1995-01-02', d) AS INT) AS n, CASE WHEN (o_custkey + year(d)) % 2 = 0 THEN CAST((date_diff('day', DATE '1995-01-02', d) + 2) % 7 AS INT) ELSE CAST((date_diff('day', DATE '1995-01-02', d) + 7) % 7 AS INT) END AS w FROM b),
q AS (SELECT *, CASE WHEN (n + 7) % 7 = w THEN 'verified' ELSE 'mismatch' END AS s FROM p),
r AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY d) AS run FROM (SELECT *, CASE WHEN lag(s) OVER (PARTITION BY o_custkey ORDER BY d) = s THEN 0 ELSE 1 END AS new FROM q)),
k AS (SELECT o_custkey, run, k, count(*) AS v FROM (SELECT *, unnest([-7,-6,-5,-4,-3,-2,-1,1,2,3,4,5,6,7]) AS k FROM r WHERE s = 'mismatch') WHERE (n + k + 14) % 7 = w GROUP BY 1, 2, 3),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, run ORDER BY v DESC, abs(k), k) AS i FROM k) WHERE i = 1 AND v >= 2)
SELECT r.o_custkey, strftime(d, '%Y-%m-%d') AS day, CASE WHEN s = 'mismatch' AND t.k IS NOT NULL AND (n + t.k + 14) % 7 = w THEN 'corrected' WHEN s = 'mismatch' THEN 'unresolved' ELSE s END AS status,
CASE WHEN s = 'mismatch' AND (n + t.k + 14) % 7 = w THEN t.k END AS shift_days FROM r LEFT JOIN t ON r.o_custkey = t.o_custkey AND r.run = t.run""")
def drift_vote(spark: SparkSession, d: str) -> DataFrame:
    """Weekdays misprinted by runs, corrected by a vote of the run."""
    b = table(spark, d, "orders", "o_custkey", "o_orderdate").select("o_custkey", F.to_date("o_orderdate").alias("day")).distinct()
    n = F.datediff("day", F.lit("1995-01-02").cast("date"))  # a Monday
    off = F.when((F.col("o_custkey") + F.year("day")) % 2 == 0, 2).otherwise(0)
    b = b.withColumn("n", n + 7).withColumn("w", ((F.col("n") + off) % 7).cast("int"))
    v = C.drift_vote(b, ["o_custkey"], ["day"], "n", "w")
    return v.select("o_custkey", F.date_format("day", "yyyy-MM-dd").alias("day"), "status", "shift_days")


@query("""WITH o AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS iso, CAST(o_orderdate AS DATE) AS g FROM orders)
SELECT iso, CAST(date_diff('day', DATE '1970-01-01', g) + 2440588 + 13 AS INT) AS julian_day, CAST((date_diff('day', DATE '1970-01-01', g) + 2440588 + 13) % 7 AS INT) AS weekday, iso AS back,
CAST(CASE WHEN month(g) >= 8 THEN year(g) ELSE year(g) - 1 END AS INT) AS season FROM o""")
def julian_day_math(spark: SparkSession, d: str) -> DataFrame:
    """Julian day number, weekday and back, season of a date read as Julian."""
    o = table(spark, d, "orders", "o_orderdate").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso")).distinct().withColumn("julian_day", C.julian_day(F.col("iso")))
    y, m = F.substring("iso", 1, 4).cast("int"), F.substring("iso", 6, 2).cast("int")
    return o.select("iso", "julian_day", C.weekday_of(F.col("julian_day")).alias("weekday"), C.iso_of_julian_day(F.col("julian_day")).alias("back"), F.when(m >= 8, y).otherwise(y - 1).alias("season"))


_MONTH = "CASE " + " ".join(f"WHEN regexp_matches(lower(t), '(^|\\s)({stem})') THEN {i}" for i, stem in enumerate(C.MONTH_STEMS, 1)) + " END"


@query(rf"""WITH t AS (SELECT DISTINCT printed_leaving AS t FROM person_tenure_note WHERE printed_leaving IS NOT NULL UNION SELECT tenure_evidence FROM person_candidate WHERE tenure_evidence IS NOT NULL),
p AS (SELECT t, coalesce(TRY_CAST(nullif(regexp_extract(t, '\d{{1,2}}\.(\d\d)\.\d{{4}}', 1), '') AS INT), {_MONTH}) AS m, TRY_CAST(nullif(regexp_extract(t, '(1[789]\d\d)', 1), '') AS INT) AS y,
 coalesce(TRY_CAST(nullif(regexp_extract(t, '(\d{{1,2}})\.\d\d\.\d{{4}}', 1), '') AS INT), TRY_CAST(nullif(regexp_extract(t, '(?:^|\s)(\d{{1,2}})\s', 1), '') AS INT)) AS dd FROM t),
l AS (SELECT *, dd IS NOT NULL AND m IS NOT NULL AND y IS NOT NULL AND dd <= CASE WHEN m IN (4, 6, 9, 11) THEN 30 WHEN m = 2 THEN CASE WHEN y % 4 = 0 THEN 29 ELSE 28 END ELSE 31 END AS whole FROM p)
SELECT t AS text, CASE WHEN whole THEN printf('%04d-%02d-%02d', y, m, dd) END AS iso, CASE WHEN whole THEN 'day' WHEN m IS NOT NULL THEN 'month' WHEN regexp_matches(lower(t), 'осен|весн|зим|лѣто') THEN 'season' WHEN y IS NOT NULL THEN 'year' ELSE 'none' END AS precision, y, m FROM l""")
def partial_date(spark: SparkSession, d: str) -> DataFrame:
    """dates in printed notes as far as they go: day, month, season, year."""
    notes = table(spark, d, "person_tenure_note", "printed_leaving").select(F.col("printed_leaving").alias("text"))
    text = notes.unionByName(table(spark, d, "person_candidate", "tenure_evidence").select(F.col("tenure_evidence").alias("text"))).where("text is not null").distinct()
    return C.partial_date(text, "text")


@query("""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type FROM events), m AS (SELECT DISTINCT user_id, strftime(day, '%Y-%m') AS mon FROM e WHERE event_type = 'purchase'), dd AS (SELECT DISTINCT user_id, day FROM e WHERE event_type = 'purchase')
SELECT DISTINCT e.user_id, strftime(e.day, '%Y-%m-%d') AS day, CASE WHEN dd.day IS NOT NULL THEN 'direct' WHEN m.mon IS NOT NULL THEN 'period' ELSE 'none' END AS evidence
FROM e LEFT JOIN dd ON dd.user_id = e.user_id AND dd.day = e.day LEFT JOIN m ON m.user_id = e.user_id AND m.mon = strftime(e.day, '%Y-%m') WHERE e.event_type = 'click'""")
def direct_or_period_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of the day itself, else of its month."""
    g = table(spark, d, "events", "user_id", "ts", "event_type").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.bool_or(F.col("event_type") == "purchase").alias("buys"), F.bool_or(F.col("event_type") == "click").alias("clicks"))
    month = F.bool_or("buys").over(Window.partitionBy("user_id", F.date_format("day", "yyyy-MM")))
    g = g.withColumn("month", month).where("clicks")
    return g.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.when(F.col("buys"), "direct").when(F.col("month"), "period").otherwise("none").alias("evidence"))


@query("""SELECT production_entry_id, total_count, n_dates, CASE WHEN total_count IS NULL THEN 'no total' WHEN total_count = n_dates THEN 'agrees' WHEN total_count > n_dates THEN 'printed more' ELSE 'dates more' END AS verdict,
coalesce(try_cast(regexp_extract(total_text, '([0-9]+)', 1) AS INT) IS DISTINCT FROM total_count, false) AS text_differs FROM production_entry""")
def production_totals(spark: SparkSession, d: str) -> DataFrame:
    """Printed total of a production against its dates and its own text."""
    p = table(spark, d, "production_entry", "production_entry_id", "total_count", "n_dates", "total_text")
    v = F.when(F.col("total_count").isNull(), "no total").when(F.col("total_count") == F.col("n_dates"), "agrees").when(F.col("total_count") > F.col("n_dates"), "printed more").otherwise("dates more")
    said = F.regexp_extract("total_text", "([0-9]+)", 1).try_cast("int")
    return p.select("production_entry_id", "total_count", "n_dates", v.alias("verdict"), (~said.eqNullSafe(F.col("total_count"))).alias("text_differs"))


@query("""WITH s AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS y FROM orders), g AS (SELECT o_custkey, y, lead(y) OVER (PARTITION BY o_custkey ORDER BY y) AS n FROM s), v AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS p, count(*) AS c FROM orders GROUP BY 1)
SELECT v.o_custkey, CAST(coalesce(max(n - y - 1), 0) AS BIGINT) AS longest_gap, CAST(min(p) AS BIGINT) AS priorities, min(c) = 1 AS once FROM v LEFT JOIN g USING (o_custkey) GROUP BY 1""")
def entity_audit(spark: SparkSession, d: str) -> DataFrame:
    """Q26: gaps between seasons, conflicting values, entities seen once."""
    o = table(spark, d, "orders", "o_custkey", "o_orderdate", "o_orderpriority")
    y = o.select("o_custkey", F.year("o_orderdate").alias("y")).distinct()
    gap = y.withColumn("g", F.lead("y").over(Window.partitionBy("o_custkey").orderBy("y")) - F.col("y") - 1).groupBy("o_custkey").agg(F.coalesce(F.max("g"), F.lit(0)).cast("long").alias("longest_gap"))
    v = o.groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("priorities"), (F.count("*") == 1).alias("once"))
    return v.join(gap, "o_custkey").select("o_custkey", "longest_gap", "priorities", "once")
