"""Queries of readers, writers and streams: what comes back against the tables themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.readers import compared_readings
from vellum.session import own_dir
from vellum.sources import files
from vellum.sources.tables import table
from vellum.streaming import windows

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


def _place(spark: SparkSession) -> str:
    return f"{own_dir(spark)}/flow-{uuid.uuid4().hex}"


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment, c_acctbal AS balance, CAST(c_acctbal AS INT) IS NULL AS unread FROM customer")
def delimited_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A table written as delimited text, read as strings and cast."""
    at = _place(spark)
    table(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment", "c_acctbal").write.option("header", True).option("quoteAll", True).csv(at)
    rows = files.read_delimited(spark, at, ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"]).withColumn("balance", F.col("c_acctbal"))
    cast = files.with_casts(rows, {"balance": "double"})
    return cast.select("c_custkey", "c_name", "c_mktsegment", "balance", F.col("balance").isNull().alias("unread"))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS page, CAST(o_custkey AS VARCHAR) || '__o' || lpad(CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS VARCHAR), 3, '0') AS o_id,
CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS o_order, o_orderkey AS key, o_orderstatus AS status FROM orders""")
def json_pages(spark: SparkSession, d: str) -> DataFrame:
    """Orders written as one JSON page a customer in shards, read again
    page by page, their children laid flat with ordinal ids."""
    at = _place(spark)
    o = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus").groupBy(F.col("o_custkey").cast("string").alias("page"))
    pages = o.agg(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")))).alias("items"))
    files.export_json(pages, "page", 4, at)
    read = spark.read.schema(pages.schema).json(at)
    return files.flatten(read, "page", "items", "o")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def ledger_appends(spark: SparkSession, d: str) -> DataFrame:
    """A ledger that got the first half, all rows, and all rows again: each once."""
    at = _place(spark)
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus")
    for part in (o.where("o_orderkey % 2 = 0"), o, o):
        files.append_new(part, at, ["o_orderkey"])
    return spark.read.parquet(at)


@query("""SELECT regexp_extract(page_id, '^([a-z]+)_', 1) AS kind, CASE WHEN regexp_matches(page_id, '^[a-z]+_\\d{4}-\\d{2}_[A-Za-z]+_v\\d+p\\d+') THEN regexp_extract(page_id, '_(\\d{4}-\\d{2})_', 1) ELSE '' END AS season, count(DISTINCT page_id) AS pages FROM production_entry WHERE page_id IS NOT NULL GROUP BY 1, 2""".replace("\\\\", "\\"))
def page_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Kind, season and place out of the names of pages, counted."""
    names = table(spark, d, "production_entry", "page_id").where("page_id is not null").distinct()
    m = files.manifest(names, "page_id")
    return m.groupBy("kind", F.when(F.col("season") == "-", "").otherwise(F.col("season")).alias("season")).agg(F.count("*").alias("pages"))


def _streamed(spark: SparkSession, d: str, make, schema: str, mode: str = "append") -> DataFrame:
    """The result of a stream over the events, run to its end into files."""
    at = _place(spark)
    source = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").option("pathGlobFilter", "events.parquet").parquet(d)
    made = make(source.withColumn("at", F.col("ts").cast("timestamp")))
    made.writeStream.format("parquet").option("path", at).option("checkpointLocation", at + "-log").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(at)


@query("""WITH w AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2), m AS (SELECT max(ts) - INTERVAL 2 DAY AS mark FROM events)
SELECT strftime(day, '%Y-%m-%d') AS day, event_type, n, total FROM w, m WHERE CAST(day + 1 AS TIMESTAMP) <= mark""")
def streamed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Streams: counts per day and type as a stream gives them, which holds back the days
    that the watermark hasn't passed."""
    rows = _streamed(spark, d, lambda s: windows.windowed_counts(s, "at", ["event_type"]), "start timestamp, event_type string, n long, total double")
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query("SELECT event_id, user_id FROM events")
def streamed_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Streams: every event once, repeats within the watermark left out."""
    rows = _streamed(spark, d, lambda s: windows.deduplicated(s, "at", "event_id").select("event_id", "user_id"), "event_id long, user_id long")
    return rows


@query("""WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS new FROM events),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run_no FROM e) SELECT user_id AS key, event_id AS at_id, event_type AS value, CAST(run_no AS BIGINT) AS run_no FROM r WHERE new = 1""")
def streamed_runs(spark: SparkSession, d: str) -> DataFrame:
    """Streams: starts of runs with the state kept between batches."""
    return _streamed(spark, d, lambda s: windows.run_starts(s.select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type"), "key long, at_id long, value string, run_no long")


@query(None)
def reader_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of a page that two readers gave, paired by likeness from 0.72 on,
    each once, with the kinds of difference and the merged words."""
    p = table(spark, d, "review_passage", "page_id", "block_id", "block_index", "text").where("text is not null")
    stored = p.where("block_index % 2 = 0").select("page_id", F.col("block_id").alias("id"), "text")
    read = p.where("block_index % 2 = 1").select("page_id", F.col("block_id").alias("id"), "text")
    return compared_readings(stored, read, "page_id", "id", "text")
