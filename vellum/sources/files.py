"""Readers and writers: delimited text, JSON pages, exports."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.session import materialize, release


def read_delimited(spark: SparkSession, path: str, columns: list[str] | None = None, infer: bool = False) -> DataFrame:
    """Delimited text with a header (S1, S2). With ``columns`` every field is a string
    and an empty field stays an empty string, distinct from null; ``infer`` types them."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    if infer:
        return reader.option("inferSchema", True).csv(path)
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.option("nullValue", "\\N").option("emptyValue", "").csv(path)


def with_casts(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    """Blank to null, then a cast that gives null where it fails."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")).try_cast(t) for c, t in casts.items()})


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at the path, or an empty one of the schema if absent."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def bare_json(text: Column) -> tuple[Column, Column]:
    """Page text without a code fence and with stray backslashes dropped, and the
    number of backslashes repaired (S5, S6)."""
    body = F.regexp_replace(F.trim(text), r"^```[a-z]*\s*|\s*```$", "")
    body = F.regexp_replace(body, r"\\н", r"\\n")
    stray = r'\\(?!["\\/bfnrtu])'
    return F.regexp_replace(body, stray, ""), F.size(F.regexp_extract_all(body, F.lit(stray), F.lit(0)))


def read_pages(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """JSON pages, one file each: (good rows, errors); no page is lost."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    body, repairs = bare_json(F.col("value"))
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    read = raw.select("file", repairs.alias("repairs"), F.from_json(body, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("page"), body.alias("body"))
    bad = F.col("page").isNull() | F.col("page._corrupt").isNotNull()
    good = read.where(~bad).select("file", "repairs", *[F.col(f"page.{f.name}").alias(f.name) for f in schema.fields])
    return good, read.where(bad).select("file", F.lit("not valid JSON of the schema").alias("error"), "body")


def flatten(df: DataFrame, key: str, items: str, mark: str) -> DataFrame:
    """Children of an array with ordinal ids such as ``page__e001``."""
    child = df.select(F.col(key), F.posexplode(items).alias("_pos", "_item"))
    ident = F.format_string(f"%s__{mark}%03d", F.col(key), F.col("_pos") + 1)
    return child.select(F.col(key), ident.alias(f"{mark}_id"), (F.col("_pos") + 1).alias(f"{mark}_order"), "_item.*")


def manifest(names: DataFrame, name: str) -> DataFrame:
    """Kind, season, city and page of file names; ``season_ok`` tells whether the
    second year follows the first (S12)."""
    pattern = r"^([a-z]+)_(\d{4})-(\d{2})_([A-Za-z]+)_v\d+p(\d+)"
    g = lambda i: F.regexp_extract(name, pattern, i)
    ok = (g(2).try_cast("int") + 1) % 100 == g(3).try_cast("int")
    return names.select(name, g(1).alias("kind"), F.concat_ws("-", g(2), g(3)).alias("season"), g(4).alias("city"), g(5).try_cast("int").alias("page"), F.coalesce(ok, F.lit(False)).alias("season_ok"))


def lexicon(parts: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(kind, form, entity_id) from several tables given as kind: (frame, form, id)."""
    out = None
    for kind, (df, form, ident) in parts.items():
        one = df.where(F.col(form).isNotNull()).select(F.lit(kind).alias("kind"), F.lower(form).alias("form"), F.col(ident).cast("string").alias("entity_id")).distinct()
        out = one if out is None else out.unionByName(one)
    return out


def check_columns(df: DataFrame, declared: list[str]) -> DataFrame:
    """The frame, or an error that names missing and undeclared columns (K3)."""
    missing, extra = set(declared) - set(df.columns), set(df.columns) - set(declared)
    if missing or extra:
        raise ValueError(f"missing: {sorted(missing)}, undeclared: {sorted(extra)}")
    return df.select(*declared)


def export_strings(df: DataFrame) -> DataFrame:
    """All columns as strings, dates in ISO form (K3)."""
    iso = lambda f: F.date_format(f.name, "yyyy-MM-dd") if isinstance(f.dataType, T.DateType) else F.col(f.name).cast("string").alias(f.name)
    return df.select(*[iso(f).alias(f.name) for f in df.schema.fields])


def export_sqlite(df: DataFrame, path: str, name: str, declared: list[str], most_rows: int = 1_000_000) -> int:
    """One SQLite table of a small frame, written by the driver in batches (K3)."""
    import sqlite3

    rows = materialize(export_strings(check_columns(df, declared)))
    if rows.count() > most_rows:
        release(rows)
        raise ValueError(f"more than {most_rows} rows for a single file; write Parquet")
    with sqlite3.connect(path) as db:
        db.execute(f'CREATE TABLE "{name}" ({", ".join(chr(34) + c + chr(34) + " TEXT" for c in declared)})')
        marks = ", ".join("?" * len(declared))
        n = db.executemany(f'INSERT INTO "{name}" VALUES ({marks})', map(tuple, rows.toLocalIterator())).rowcount
    release(rows)
    return max(n, 0)


def export_workbook(frames: dict[str, DataFrame], path: str, most_rows: int = 100_000) -> None:
    """One sheet per small table (K4); needs an Excel writer for pandas."""
    with pd.ExcelWriter(path) as book:
        for name, df in frames.items():
            if df.limit(most_rows + 1).count() > most_rows:
                raise ValueError(f"{name} has more than {most_rows} rows")
            df.toPandas().to_excel(book, sheet_name=name[:31], index=False)


def export_notes(df: DataFrame, page: str, order: str, line: str, path: str) -> None:
    """One markdown note per page (K5)."""
    notes = df.groupBy(page).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, line))), lambda x: x[line]), "\n").alias("body"))
    notes.select(F.concat(F.lit("# "), F.col(page).cast("string"), F.lit("\n"), F.col("body")).alias("value"), F.col(page).alias("page")).write.partitionBy("page").text(path)


def export_queue(df: DataFrame, path: str) -> None:
    """A review queue as one UTF-8 file with a byte-order mark in its header (K6)."""
    first = df.columns[0]
    df.withColumnRenamed(first, "﻿" + first).coalesce(1).write.option("header", True).option("quoteAll", True).csv(path)


def export_json(df: DataFrame, key: str, shards: int, path: str) -> None:
    """JSON in a fixed number of shards by key (K7)."""
    df.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards))).write.partitionBy("shard").json(path)


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose keys the ledger doesn't hold yet; gives how many (K8)."""
    known = optional(df.sparkSession, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields))
    df = df.join(known.select(*keys), keys, "left_anti")
    fresh = df.dropDuplicates(keys).select(*df.columns).cache()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n


def assert_keys(df: DataFrame, primary: list[str], references: dict[str, tuple[DataFrame, str]] | None = None) -> None:
    """Primary key unique and not null, every reference known, else an error (C4)."""
    nulls = F.lit(False)
    for k in primary:
        nulls = nulls | F.col(k).isNull()
    if df.where(nulls).limit(1).count() or df.groupBy(*primary).count().where("count > 1").limit(1).count():
        raise ValueError(f"{primary} is no key")
    for column, (other, key) in (references or {}).items():
        orphans = df.where(F.col(column).isNotNull()).join(other.select(F.col(key).alias(column)).distinct(), column, "left_anti").limit(5).collect()
        if orphans:
            raise ValueError(f"{column}: unknown {json.dumps([r.asDict()[column] for r in orphans], default=str)}")
