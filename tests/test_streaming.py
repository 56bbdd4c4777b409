from pyspark.sql import functions as F

from vellum.streaming.windows import deduplicated, event_stream, run_starts, windowed_counts

from conftest import DATA


def drain(df, spark, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_counts_match_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.write.parquet(src)
    got = drain(windowed_counts(event_stream(spark, src), "at", ["event_type"]), spark, "counted", "complete", tmp_path)
    assert got.agg(F.sum("n")).first()[0] == events.count()
    batch = events.groupBy(F.to_date("ts").alias("d"), "event_type").count()
    assert got.count() == batch.count()


def test_repeats_once(spark, tmp_path):
    src = str(tmp_path / "in")
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.union(events.limit(50)).coalesce(1).write.parquet(src)
    got = drain(deduplicated(event_stream(spark, src), "at", "event_id"), spark, "once", "append", tmp_path)
    assert got.count() == events.count()


def test_runs_keep_state(spark, tmp_path):
    src = str(tmp_path / "in")
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.orderBy("event_id").coalesce(1).write.parquet(src)
    got = drain(run_starts(event_stream(spark, src), "user_id", "event_id", "event_type"), spark, "runs", "append", tmp_path)
    from vellum.plans.sequences import islands_runs

    assert got.count() == islands_runs(spark, DATA).count()
