"""Queries of entity resolution, provenance and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions.names import title_key, title_key_sql
from vellum.functions.text import natural_id, ordinal_split, squash, stem_key
from vellum.operators import matching as M
from vellum.operators.sizing import lookup
from vellum.sources.tables import table

QUERIES: dict = {}
ORACLE: dict = {}
#: SQL of the distinct entries with the key of their title.
KEYED_ENTRIES = f"e AS (SELECT DISTINCT production_entry_id, season, city, {title_key_sql('title')} AS k FROM production_entry WHERE title IS NOT NULL)"


def query(sql: str | None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


@query("""SELECT p_name || '|' || p_brand AS k, substr(sha1(p_name || '|' || p_brand), 1, 10) AS cluster_id, CAST(count(*) AS BIGINT) AS n, min(p_partkey) AS first_part FROM part GROUP BY 1""")
def exact_key_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Clusters by key with an id hashed from it."""
    p = table(spark, d, "part", "p_partkey", "p_name", "p_brand")
    g = p.groupBy("p_name", "p_brand").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part"))
    return g.select(F.concat_ws("|", "p_name", "p_brand").alias("k"), natural_id(F.col("p_name"), F.col("p_brand")).alias("cluster_id"), "n", "first_part")


@query("""WITH p AS (SELECT DISTINCT p_brand, p_name, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part),
x AS (SELECT l.p_brand, l.p_name AS n1, r.p_name AS n2, 'same object' AS reason, levenshtein(l.a, r.a) AS dist, greatest(length(l.a), length(r.a)) AS len FROM p l JOIN p r ON l.p_brand = r.p_brand AND l.b = r.b AND l.p_name < r.p_name
UNION ALL SELECT l.p_brand, l.p_name, r.p_name, 'same colour', levenshtein(l.b, r.b), greatest(length(l.b), length(r.b)) FROM p l JOIN p r ON l.p_brand = r.p_brand AND l.a = r.a AND l.p_name < r.p_name)
SELECT p_brand, n1, n2, reason, CAST(dist AS INT) AS dist, round(1 - dist / len, 6) AS score FROM x WHERE dist BETWEEN 1 AND 2""")
def blocked_levenshtein(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that share two of three fields, the third near."""
    p = table(spark, d, "part", "p_brand", "p_name").distinct().withColumn("a", F.split("p_name", " ")[0]).withColumn("b", F.split("p_name", " ")[1])
    out = None
    for block, other, reason in (("b", "a", "same object"), ("a", "b", "same colour")):
        pairs = M.blocked_pairs(p, "p_name", ["p_brand", block], [other])
        dist, score = M.edit_score(F.col(f"{other}_1"), F.col(f"{other}_2"))
        part = pairs.withColumn("dist", dist).where("dist >= 1").select("p_brand", F.col("p_name_1").alias("n1"), F.col("p_name_2").alias("n2"), F.lit(reason).alias("reason"), "dist", score.alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""WITH s AS (SELECT o_custkey AS c, list_sort(list(DISTINCT year(o_orderdate))) AS ys FROM orders GROUP BY 1)
SELECT a.c AS c1, b.c AS c2, CASE WHEN len(list_intersect(a.ys, b.ys)) > 0 THEN 'shared' ELSE 'conflicting' END AS signal, CAST(len(list_intersect(a.ys, b.ys)) AS INT) AS n_shared FROM s a JOIN s b ON b.c = a.c + 1""")
def set_signal(spark: SparkSession, d: str) -> DataFrame:
    """Sets of two sides compared."""
    s = table(spark, d, "orders", "o_custkey", "o_orderdate").groupBy(F.col("o_custkey").alias("c1")).agg(F.collect_set(F.year("o_orderdate")).alias("ys"))
    t = s.select((F.col("c1") - 1).alias("c1"), F.col("c1").alias("c2"), F.col("ys").alias("yt"))
    n = F.size(F.array_intersect("ys", "yt"))
    return s.join(t, "c1").select("c1", "c2", F.when(n > 0, "shared").otherwise("conflicting").alias("signal"), n.alias("n_shared"))


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey - c_custkey % 8 + c_custkey % 4 AS b FROM customer), l AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
r(v, o) AS (SELECT a, a FROM l UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.o) SELECT v AS vertex, min(o) AS component FROM r GROUP BY 1""")
def components(spark: SparkSession, d: str) -> DataFrame:
    """Smallest id of everything connected, to a fixed point."""
    c = table(spark, d, "customer", "c_custkey")
    k = F.col("c_custkey")
    return M.min_label_components(c.select(k.alias("a"), (k - k % 8 + k % 4).alias("b")), "a", "b")


@query("""WITH RECURSIVE m AS (SELECT c_custkey AS o, c_custkey // 2 AS n FROM customer WHERE c_custkey > 0), r(o, f, d) AS (SELECT o, n, 1 FROM m UNION ALL SELECT r.o, m.n, r.d + 1 FROM r JOIN m ON m.o = r.f)
SELECT o AS c_custkey, arg_max(f, d) AS final, CAST(max(d) AS INT) AS depth FROM r GROUP BY 1""")
def supersession_chain(spark: SparkSession, d: str) -> DataFrame:
    """End of each chain of replacements."""
    m = table(spark, d, "customer", "c_custkey").where("c_custkey > 0").withColumn("to", F.floor(F.col("c_custkey") / 2))
    return M.final_of_chain(m, "c_custkey", "to")


@query(r"""WITH p AS (SELECT DISTINCT least(person_id_1, person_id_2) AS k1, greatest(person_id_1, person_id_2) AS k2, regexp_extract(lower(display_1), '^(\p{L}+)', 1) AS f1, regexp_extract(lower(display_2), '^(\p{L}+)', 1) AS f2, similarity_score AS s, coalesce(status, '') AS st, tenure_signal AS t FROM person_candidate WHERE person_id_1 <> person_id_2),
g AS (SELECT k1, k2, bool_or(st IN ('rejected', 'kept_apart')) AS barred, max(s) AS s, bool_or(coalesce(t IN ('same_start', 'adjacent'), false)) AS tenure, bool_or(coalesce(left(f1, 4) = left(f2, 4), false)) AS family FROM p GROUP BY 1, 2)
SELECT k1, k2, CASE WHEN barred THEN 'ruled out' WHEN NOT family THEN 'other family' WHEN coalesce(s, 0) < 0.7 THEN 'not alike enough' WHEN NOT tenure THEN 'no common service' ELSE 'passes' END AS gate FROM g""")
def gated_merge(spark: SparkSession, d: str) -> DataFrame:
    """A candidate pair merges only past all gates; else the first that closed.
    Groups are then closed and held back in ``lifecycle_groups``."""
    p = table(spark, d, "person_candidate", "person_id_1", "person_id_2", "display_1", "display_2", "similarity_score", "status", "tenure_signal").where("person_id_1 <> person_id_2")
    family = lambda c: F.left(F.regexp_extract(F.lower(c), r"^(\p{L}+)", 1), F.lit(4))
    no = F.lit(False)
    g = p.groupBy(F.least("person_id_1", "person_id_2").alias("k1"), F.greatest("person_id_1", "person_id_2").alias("k2")).agg(
        F.bool_or(F.coalesce(F.col("status").isin("rejected", "kept_apart"), no)).alias("barred"),
        F.max("similarity_score").alias("s"),
        F.bool_or(F.coalesce(F.col("tenure_signal").isin("same_start", "adjacent"), no)).alias("tenure"),
        F.bool_or(F.coalesce(family("display_1") == family("display_2"), no)).alias("family"),
    )
    gate = F.when(F.col("barred"), "ruled out").when(~F.col("family"), "other family").when(F.coalesce("s", F.lit(0.0)) < 0.7, "not alike enough").when(~F.col("tenure"), "no common service").otherwise("passes")
    return g.select("k1", "k2", gate.alias("gate"))


@query("""SELECT s_suppkey, CASE WHEN s_acctbal >= 0 AND s_nationkey < 20 AND s_suppkey % 3 > 0 THEN 'accept' ELSE 'review' END AS decision,
concat_ws('; ', CASE WHEN s_acctbal < 0 THEN 'negative account' END, CASE WHEN s_nationkey >= 20 THEN 'rare nation' END, CASE WHEN s_suppkey % 3 = 0 THEN 'ambiguous key' END) AS reasons FROM supplier""")
def accept_or_review(spark: SparkSession, d: str) -> DataFrame:
    """Accept only if nothing speaks against it, else list the reasons."""
    r = F.array_compact(F.array(F.when(F.col("s_acctbal") < 0, "negative account"), F.when(F.col("s_nationkey") >= 20, "rare nation"), F.when(F.col("s_suppkey") % 3 == 0, "ambiguous key")))
    s = table(spark, d, "supplier", "s_suppkey", "s_acctbal", "s_nationkey").withColumn("r", r)
    return s.select("s_suppkey", F.when(F.size("r") == 0, "accept").otherwise("review").alias("decision"), F.array_join("r", "; ").alias("reasons"))


@query("""WITH g AS (SELECT p_name || p_brand || p_size AS w, CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_type END AS t, p_partkey FROM part), n AS (SELECT w, count(DISTINCT t) AS k, min(t) AS sole FROM g GROUP BY 1)
SELECT p_partkey, g.w || '/' || CASE WHEN k <= 1 THEN coalesce(sole, '') ELSE coalesce(t, 'blank') END AS work FROM g JOIN n USING (w)""")
def group_or_split(spark: SparkSession, d: str) -> DataFrame:
    """Blanks join the sole genre; several genres split."""
    p = table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_size", "p_type").withColumn("t", F.when(F.col("p_type") != "PROMO", F.col("p_type")))
    p = p.withColumn("w", F.concat("p_name", "p_brand", F.col("p_size").cast("string")))
    p = p.withColumn("kinds", F.sort_array(F.collect_set("t").over(Window.partitionBy("w"))))
    one = F.coalesce(F.get("kinds", F.lit(0)), F.lit(""))
    return p.select("p_partkey", F.concat(F.col("w"), F.lit("/"), F.when(F.size("kinds") <= 1, one).otherwise(F.coalesce("t", F.lit("blank")))).alias("work"))


@query(r"""WITH t AS (SELECT production_entry_id, regexp_replace(title, ',\s+\d-[^,]*$', '') AS base, title FROM production_entry WHERE title IS NOT NULL), w AS (SELECT canonical_title, count(*) AS n, min(work_id) AS id FROM research_work GROUP BY 1)
SELECT production_entry_id, base, CASE WHEN n = 1 THEN id END AS parent, CASE WHEN n IS NULL THEN 'not in list' WHEN n > 1 THEN 'several' WHEN base = title THEN 'whole' ELSE 'excerpt' END AS note FROM t LEFT JOIN w ON canonical_title = base""")
def excerpt_parent(spark: SparkSession, d: str) -> DataFrame:
    """An excerpt's title leads to its parent if that is the only one."""
    t = table(spark, d, "production_entry", "production_entry_id", "title").where("title is not null").withColumn("base", F.regexp_replace("title", r",\s+\d-[^,]*$", ""))
    w = table(spark, d, "research_work", "work_id", "canonical_title").groupBy(F.col("canonical_title").alias("base")).agg(F.count("*").alias("n"), F.min("work_id").alias("id"))
    note = F.when(F.col("n").isNull(), "not in list").when(F.col("n") > 1, "several").when(F.col("base") == F.col("title"), "whole").otherwise("excerpt")
    return t.join(lookup(w), "base", "left").select("production_entry_id", "base", F.when(F.col("n") == 1, F.col("id")).alias("parent"), note.alias("note"))


@query(r"""WITH t AS (SELECT DISTINCT person_id AS k, cities AS refs FROM review_person WHERE cities IS NOT NULL), n AS (SELECT city, min(season) AS since FROM production_entry WHERE city IS NOT NULL GROUP BY 1), x AS (SELECT k, trim(unnest(string_split_regex(refs, '[,;]'))) AS city FROM t)
SELECT k, string_agg(DISTINCT city || ' since ' || since, ', ' ORDER BY city || ' since ' || since) AS places FROM x JOIN n USING (city) GROUP BY 1""")
def footnote_explode(spark: SparkSession, d: str) -> DataFrame:
    """Reference lists to what they refer to, unknown ones dropped."""
    t = table(spark, d, "review_person", F.col("person_id").alias("k"), "cities").where("cities is not null").distinct()
    n = table(spark, d, "production_entry", "city", "season").where("city is not null").groupBy("city").agg(F.min("season").alias("since"))
    x = t.select("k", F.explode(F.split("cities", "[,;]")).alias("r")).select("k", F.trim("r").alias("city"))
    said = F.concat_ws(" since ", "city", "since")
    return x.join(lookup(n), "city").groupBy("k").agg(F.array_join(F.sort_array(F.collect_set(said)), ", ").alias("places"))


@query("""WITH old AS (SELECT o_orderkey AS nk, CAST(1 + row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS id FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'), m AS (SELECT max(id) AS top FROM old), cur AS (SELECT o_orderkey AS nk FROM orders WHERE o_orderstatus <> 'P'),
f AS (SELECT nk FROM cur WHERE nk NOT IN (SELECT nk FROM old)) SELECT cur.nk, coalesce(old.id, m.top + r.n) AS id, old.id IS NOT NULL AS kept FROM cur LEFT JOIN old USING (nk) CROSS JOIN m LEFT JOIN (SELECT nk, row_number() OVER (ORDER BY nk) AS n FROM f) r USING (nk)""")
def id_continuity(spark: SparkSession, d: str) -> DataFrame:
    """Known keys keep their id, new ones get ids above the largest.

    The snapshot before holds the orders up to 1998, today's the settled ones. Keys
    are numbered by range partition, without sorting all in one task."""
    o = table(spark, d, "orders", F.col("o_orderkey").alias("nk"), "o_orderdate", "o_orderstatus")
    old = M.numbered(o.where("o_orderdate < timestamp_ntz'1999-01-01'").select("nk"), "nk").select("nk", (F.col("n") + 1).alias("id"))
    cur = o.where("o_orderstatus <> 'P'").select("nk")
    top = old.agg(F.max("id").alias("top")).first().top or 0
    fresh = M.numbered(cur.join(old, "nk", "left_anti"), "nk").select("nk", (F.col("n") + top).alias("fresh"))
    return cur.join(old, "nk", "left").join(fresh, "nk", "left").select("nk", F.coalesce("id", "fresh").alias("id"), F.col("id").isNotNull().alias("kept"))


@query(r"""WITH m AS (SELECT DISTINCT mention_id, season, city, surface, regexp_extract(surface, '(\p{L}+)\P{L}*$', 1) AS f, TRY_CAST(left(season, 4) AS INT) AS y FROM review_mention WHERE mention_type = 'person' AND surface IS NOT NULL AND season IS NOT NULL),
p AS (SELECT person_id, canonical_family_name AS f, TRY_CAST(nullif(regexp_extract(first_attested_season, '(\d{4})', 1), '') AS INT) AS a, TRY_CAST(nullif(regexp_extract(coalesce(last_attested_season, first_attested_season), '(\d{4})', 1), '') AS INT) AS z, coalesce(cities, '') AS cities, n_mentions FROM review_person),
c AS (SELECT mention_id, person_id, (CASE WHEN contains(cities, coalesce(city, '?')) THEN 6 ELSE -4 END) + (CASE WHEN coalesce(n_mentions, 0) >= 10 THEN 4 ELSE 0 END) AS score FROM m JOIN p ON m.f = p.f AND m.y BETWEEN least(p.a, p.z) AND greatest(p.a, p.z)),
r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS s2 FROM c WINDOW w AS (PARTITION BY mention_id ORDER BY score DESC, person_id))
SELECT mention_id, CASE WHEN score - coalesce(s2, -99) >= 4 THEN person_id END AS linked, CAST(score AS INT) AS score, CAST(score - coalesce(s2, -99) AS INT) AS margin FROM r WHERE k = 1""")
def evidence_ranker(spark: SparkSession, d: str) -> DataFrame:
    """M2: summed evidence for the persons of a mention, linked only with a margin.

    Persons meet a mention on the family and a season they are attested in, so each
    mention meets the few of that name and year, however many rows there are."""
    m = table(spark, d, "review_mention", "mention_id", "mention_type", "season", "city", "surface").where("mention_type = 'person' and surface is not null and season is not null")
    m = m.select("mention_id", "city", F.regexp_extract("surface", r"(\p{L}+)\P{L}*$", 1).alias("f"), F.left("season", F.lit(4)).try_cast("int").alias("y")).distinct()
    year = lambda c: F.regexp_extract(c, r"(\d{4})", 1).try_cast("int")
    a, z = year(F.col("first_attested_season")), year(F.coalesce("last_attested_season", "first_attested_season"))
    p = table(spark, d, "review_person", "person_id", "canonical_family_name", "first_attested_season", "last_attested_season", "cities", "n_mentions").where(a.isNotNull() & z.isNotNull())
    p = p.select("person_id", F.col("canonical_family_name").alias("f"), F.explode(F.sequence(F.least(a, z), F.greatest(a, z))).alias("y"), F.coalesce("cities", F.lit("")).alias("cities"), "n_mentions")
    score = F.when(F.col("cities").contains(F.coalesce("city", F.lit("?"))), 6).otherwise(-4) + F.when(F.coalesce("n_mentions", F.lit(0)) >= 10, 4).otherwise(0)
    w = Window.partitionBy("mention_id").orderBy(F.desc("score"), "person_id")
    r = m.join(p, ["f", "y"]).withColumn("score", score).withColumn("k", F.row_number().over(w)).withColumn("margin", F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(-99)))
    return r.where("k = 1").select("mention_id", F.when(F.col("margin") >= 4, F.col("person_id")).alias("linked"), "score", "margin")


@query("""WITH o AS (SELECT DISTINCT c_custkey AS c, c_nationkey AS n, c_mktsegment AS m, CAST(o_orderdate AS DATE) AS d FROM orders JOIN customer ON c_custkey = o_custkey),
p AS (SELECT a.c AS c1, b.c AS c2, count(*) AS shared FROM o a JOIN o b ON a.n = b.n AND a.m = b.m AND a.d = b.d AND a.c < b.c GROUP BY 1, 2)
SELECT c1, c2, CAST(shared AS INT) AS shared, CASE WHEN shared > 1 THEN 'corroborated' ELSE 'shared date' END AS evidence FROM p""")
def corroborated_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that share a date, weighed by how many; blocked on the shared date
    first, so that rows without common evidence never meet."""
    c = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    o = table(spark, d, "orders", "o_custkey", F.to_date("o_orderdate").alias("d")).join(c, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_nationkey", "c_mktsegment", "d").distinct()
    p = M.blocked_pairs(o, "c_custkey", ["c_nationkey", "c_mktsegment", "d"], []).groupBy(F.col("c_custkey_1").alias("c1"), F.col("c_custkey_2").alias("c2")).agg(F.count("*").cast("int").alias("shared"))
    return p.withColumn("evidence", F.when(F.col("shared") > 1, "corroborated").otherwise("shared date"))


@query("""WITH RECURSIVE t AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey - c_custkey % 4 END AS parent, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS own FROM customer)
SELECT t.id, coalesce(t.own, p.own) AS inherited, t.parent IS NOT NULL AS from_parent FROM t LEFT JOIN t p ON p.id = t.parent""")
def inherit_from_parent(spark: SparkSession, d: str) -> DataFrame:
    """A blank attribute comes from the end of the parent chain."""
    c = table(spark, d, "customer", "c_custkey", "c_mktsegment").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_custkey") - F.col("c_custkey") % 4).alias("parent"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")).alias("own"))
    chain = M.final_of_chain(c.select("id", "parent"), "id", "parent")
    up = c.select(F.col("id").alias("final"), F.col("own").alias("up"))
    return c.join(chain, "id", "left").join(up, "final", "left").select("id", F.coalesce("own", "up").alias("inherited"), F.col("parent").isNotNull().alias("from_parent"))


@query("""WITH o AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus = 'O'), f AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus = 'F'), j AS (SELECT coalesce(o.k, f.k) AS k, o.d AS a, f.d AS b FROM (SELECT DISTINCT * FROM o) o FULL JOIN (SELECT DISTINCT * FROM f) f ON o.k = f.k AND o.d = f.d)
SELECT CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'exact' WHEN a IS NULL THEN 'only finished' ELSE 'only open' END AS category, CAST(count(*) AS BIGINT) AS n FROM j GROUP BY 1""")
def two_way_audit(spark: SparkSession, d: str) -> DataFrame:
    """Categories in both directions."""
    g = table(spark, d, "orders", "o_custkey", "o_orderdate", "o_orderstatus").where("o_orderstatus <> 'P'").groupBy("o_custkey", F.to_date("o_orderdate").alias("d")).agg(F.bool_or(F.col("o_orderstatus") == "O").alias("a"), F.bool_or(F.col("o_orderstatus") == "F").alias("b"))
    c = F.when(F.col("a") & F.col("b"), "exact").when(F.col("b"), "only finished").otherwise("only open")
    return g.groupBy(c.alias("category")).agg(F.count("*").alias("n"))


@query(f"""WITH {KEYED_ENTRIES}, t AS (SELECT DISTINCT same_title_id, season, city, {title_key_sql('verbatim_title')} AS k FROM same_title_works WHERE verbatim_title IS NOT NULL),
a AS (SELECT k, count(*) AS n, min(production_entry_id) AS i FROM e GROUP BY k), b AS (SELECT k, city, count(*) AS n, min(production_entry_id) AS i FROM e GROUP BY k, city), c AS (SELECT k, city, season, count(*) AS n, min(production_entry_id) AS i FROM e GROUP BY k, city, season)
SELECT same_title_id, CASE WHEN a.n = 1 THEN a.i WHEN b.n = 1 THEN b.i WHEN c.n = 1 THEN c.i END AS chosen, CASE WHEN a.n = 1 THEN 'sole' WHEN b.n = 1 THEN 'by city' WHEN c.n = 1 THEN 'by season' ELSE 'open' END AS rung
FROM t JOIN a USING (k) LEFT JOIN b ON b.k = t.k AND b.city = t.city LEFT JOIN c ON c.k = t.k AND c.city = t.city AND c.season = t.season WHERE t.k <> ''""")
def tie_break_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Candidates narrowed rung by rung until one is left. Each rung
    is a count of its candidates, so that no pairs are formed."""
    e = table(spark, d, "production_entry", "production_entry_id", "season", "city", "title").where("title is not null").withColumn("k", title_key(F.col("title"))).drop("title").distinct()
    t = table(spark, d, "same_title_works", "same_title_id", "season", "city", "verbatim_title").where("verbatim_title is not null")
    t = t.select("same_title_id", "season", "city", title_key(F.col("verbatim_title")).alias("k")).where("k <> ''").distinct()
    rung = lambda keys, i: e.groupBy(*keys).agg(F.count("*").alias(f"n{i}"), F.min("production_entry_id").alias(f"i{i}"))
    told = t.join(rung(["k"], 0), "k").join(rung(["k", "city"], 1), ["k", "city"], "left").join(rung(["k", "city", "season"], 2), ["k", "city", "season"], "left")
    one = lambda i: F.col(f"n{i}") == 1
    chosen = F.when(one(0), F.col("i0")).when(one(1), F.col("i1")).when(one(2), F.col("i2"))
    return told.select("same_title_id", chosen.alias("chosen"), F.when(one(0), "sole").when(one(1), "by city").when(one(2), "by season").otherwise("open").alias("rung"))


@query("""WITH a AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderpriority = '5-LOW'),
t AS (SELECT o_orderkey, min(abs(date_diff('day', a.d, b.d))) AS near FROM a LEFT JOIN b ON a.o_custkey = b.o_custkey GROUP BY 1) SELECT o_orderkey, CASE WHEN near = 0 THEN 'on the day' WHEN near <= 400 THEN 'within 400 days' ELSE 'none' END AS tier FROM t""")
def range_tier_match(spark: SparkSession, d: str) -> DataFrame:
    """Named on the day, or near it. One equi-join on the customer; the
    nearest date before and behind comes from a window over both kinds together."""
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority").where("o_orderpriority in ('1-URGENT', '5-LOW')").withColumn("d", F.to_date("o_orderdate"))
    low = F.when(F.col("o_orderpriority") == "5-LOW", F.col("d"))
    w = Window.partitionBy("o_custkey").orderBy("d")
    before = F.max(low).over(w.rangeBetween(Window.unboundedPreceding, 0))
    behind = F.min(low).over(w.rangeBetween(0, Window.unboundedFollowing))
    t = o.withColumn("b", F.datediff("d", before)).withColumn("a", F.datediff(behind, "d")).where("o_orderpriority = '1-URGENT'").withColumn("near", F.least("a", "b"))
    return t.select("o_orderkey", F.when(F.col("near") == 0, "on the day").when(F.col("near") <= 400, "within 400 days").otherwise("none").alias("tier"))


@query("""WITH t AS (SELECT p_partkey, p_name AS base, CASE WHEN p_size > 25 THEN p_name || ' ' || p_size || '-th' ELSE p_name END AS t, CASE WHEN p_size > 25 THEN p_size END AS ordinal FROM part)
SELECT p_partkey, regexp_replace(lower(t), '[^a-z0-9]', '', 'g') AS squashed, left(split_part(t, ' ', 1), 4) || ' ' || left(split_part(t, ' ', 2), 4) || CASE WHEN ordinal IS NULL THEN '' ELSE ' ' || left(split_part(t, ' ', 3), 4) END AS stem, base, ordinal FROM t""")
def string_keys(spark: SparkSession, d: str) -> DataFrame:
    """squashed key, stem key, ordinal split off."""
    p = table(spark, d, "part", "p_partkey", "p_name", "p_size")
    t = p.select("p_partkey", F.when(F.col("p_size") > 25, F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit("-th"))).otherwise(F.col("p_name")).alias("t"))
    base, ordinal = ordinal_split(F.col("t"))
    return t.select("p_partkey", squash(F.col("t")).alias("squashed"), stem_key(F.col("t")).alias("stem"), base.alias("base"), ordinal.alias("ordinal"))


@query("""WITH p AS (SELECT least(person_id_1, person_id_2) AS person_id_1, greatest(person_id_1, person_id_2) AS person_id_2, round(similarity_score, 4) AS s, match_reason, status FROM person_candidate WHERE person_id_1 <> person_id_2),
r AS (SELECT *, row_number() OVER (PARTITION BY person_id_1, person_id_2 ORDER BY s DESC NULLS LAST, match_reason DESC NULLS LAST) AS k, bool_or(coalesce(status, '') LIKE 'confirmed%') OVER (PARTITION BY person_id_1, person_id_2) AS confirmed FROM p)
SELECT person_id_1, person_id_2, s AS score, match_reason AS reason, confirmed FROM r WHERE k = 1""")
def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Candidate pairs of all reasons in one order with their best score, the
    reason that gave it (the last by name at a tie), and whether any row confirms them."""
    p = table(spark, d, "person_candidate", "person_id_1", "person_id_2", "similarity_score", "match_reason", "status").where("person_id_1 <> person_id_2")
    p = p.select(F.least("person_id_1", "person_id_2").alias("person_id_1"), F.greatest("person_id_1", "person_id_2").alias("person_id_2"), F.struct(F.round("similarity_score", 4).alias("s"), "match_reason").alias("b"), "status")
    g = p.groupBy("person_id_1", "person_id_2").agg(F.max("b").alias("b"), F.bool_or(F.coalesce("status", F.lit("")).startswith("confirmed")).alias("confirmed"))
    return g.select("person_id_1", "person_id_2", F.col("b.s").alias("score"), F.col("b.match_reason").alias("reason"), "confirmed")


@query("""SELECT mention_type, link_method, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT block_id) AS BIGINT) AS blocks, round(avg(char_end - char_start), 4) AS mean_length FROM (SELECT mention_id, min(mention_type) AS mention_type, min(link_method) AS link_method, min(block_id) AS block_id, min(char_start) AS char_start, min(char_end) AS char_end FROM review_mention GROUP BY 1) GROUP BY 1, 2""")
def mention_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Mentions by type and link method, late repeats counted once."""
    m = table(spark, d, "review_mention", "mention_id", "mention_type", "link_method", "block_id", "char_start", "char_end")
    one = m.groupBy("mention_id").agg(*[F.min(c).alias(c) for c in ("mention_type", "link_method", "block_id", "char_start", "char_end")])
    return one.groupBy("mention_type", "link_method").agg(F.count("*").alias("n"), F.countDistinct("block_id").alias("blocks"), F.round(F.avg(F.col("char_end") - F.col("char_start")), 4).alias("mean_length"))


@query("""SELECT credit_id, arg_max(work_surface, loaded_at) AS work_surface, CAST(count(*) AS INT) AS deliveries FROM review_credit GROUP BY 1 HAVING count(*) > 1""")
def latest_delivery(spark: SparkSession, d: str) -> DataFrame:
    """Of repeated deliveries the latest stands."""
    g = table(spark, d, "review_credit", "credit_id", "work_surface", "loaded_at").groupBy("credit_id").agg(F.max_by("work_surface", "loaded_at").alias("work_surface"), F.count("*").cast("int").alias("deliveries"))
    return g.where("deliveries > 1")


@query("""WITH o AS (SELECT o_custkey AS k, string_agg('{"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%d') || '","o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}', ',' ORDER BY o_orderdate, o_orderkey) AS x FROM orders GROUP BY 1)
SELECT c_custkey, '{"c_name":"' || c_name || '"' || CASE WHEN x IS NULL THEN '' ELSE ',"orders":[' || x || ']' END || '}' AS dossier FROM customer LEFT JOIN o ON k = c_custkey""")
def dossier(spark: SparkSession, d: str) -> DataFrame:
    """One nested document per customer; a customer without orders has none."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate")
    o = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(day, "o_orderkey", "o_orderstatus"))).alias("orders"))
    c = table(spark, d, "customer", "c_custkey", "c_name").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", F.to_json(F.struct("c_name", "orders")).alias("dossier"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, json_extract_string(props, '$.k') IS NULL AS absent FROM events""")
def parsed_props(spark: SparkSession, d: str) -> DataFrame:
    """F32: a field out of JSON text, and whether it is absent."""
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events", "event_id", "props").select("event_id", k.try_cast("int").alias("k"), k.isNull().alias("absent"))
