"""Session factory and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MARKED: set[str] = set()
_OPEN: list[list[DataFrame]] = []


def get_spark(app: str = "vellum", cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the operators expect.

    On a cluster the session comes from spark-submit; nothing here is needed there.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Where that is unset
    a temporary folder of this process serves a local master; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="vellum-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the driver ends."""
    home = f"{shared_dir(spark)}/vellum/{spark.sparkContext.applicationId}"
    if home not in _MARKED:
        _MARKED.add(home)
        fs, target = _hadoop(spark, home)
        fs.deleteOnExit(target)
    return home


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write to the shared folder as Parquet and read it again.

    Cuts the lineage like a reliable checkpoint, but stays columnar and gives the
    optimizer true sizes. The files survive the loss of any executor. They belong to
    the innermost open ``scratch`` and go with it; others go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vellum_path = path
    if _OPEN:
        _OPEN[-1].append(out)
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a materialized frame that no later frame reads."""
    path = getattr(df, "_vellum_path", None)
    if path is not None:
        fs, target = _hadoop(df.sparkSession, path)
        fs.delete(target, True)


def written_bytes(df: DataFrame) -> int | None:
    """Bytes of a materialized frame's files, null for any other frame; no job."""
    path = getattr(df, "_vellum_path", None)
    if path is None:
        return None
    fs, target = _hadoop(df.sparkSession, path)
    return int(fs.getContentSummary(target).getLength())


@contextmanager
def scratch() -> Iterator[None]:
    """Frames materialized inside are deleted at the end."""
    _OPEN.append([])
    try:
        yield
    finally:
        for df in _OPEN.pop():
            release(df)


def settled(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator with its result written and all its other tables deleted."""

    @wraps(make)
    def run(*args, **kwargs) -> DataFrame:
        with scratch():
            result = make(*args, **kwargs)
            own = _OPEN.pop()
            try:
                return materialize(result)  # belongs to the scratch around, if any
            finally:
                _OPEN.append(own)

    return run


def num_slots(spark: SparkSession) -> int:
    """Tasks the session runs side by side."""
    return max(int(spark.sparkContext.defaultParallelism), 1)


def spread(df: DataFrame) -> DataFrame:
    """The frame over as many partitions as tasks can run, where a scan of few files
    would leave most of them idle before costly Python work; larger scans stay."""
    slots = num_slots(df.sparkSession)
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df
