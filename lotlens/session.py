"""Session and shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

LOCAL_FOLDER = "/tmp/checkpoints/lotlens"


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("lotlens")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", LOCAL_FOLDER)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; ``LOCAL_FOLDER`` on one machine if none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = LOCAL_FOLDER
    return folder


def run_folder(spark: SparkSession) -> str:
    """The application's own place in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}"


#: Folder of the tables of the ``passing`` block that runs, if any.
_PASSING: ContextVar[str] = ContextVar("passing", default="")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for one intermediate table."""
    return f"{run_folder(spark)}/{_PASSING.get()}{name}-{uuid.uuid4().hex}"


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Removes the application's intermediate tables, once its results are written."""
    _drop(spark, run_folder(spark))


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside go at the end, but those with a path of their own; shuffle files go as soon as their job is over."""
    name, folder = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", f"passing-{uuid.uuid4().hex}/"
    old, token = spark.conf.get(name), _PASSING.set(folder)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        _PASSING.reset(token)
        spark.conf.set(name, old)
        _drop(spark, f"{run_folder(spark)}/{folder}")


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes a derived table to the shared folder and reads it back.

    For tables that several steps read: computed once, safe against lost executors, and of
    known size, so that the optimizer broadcasts them only when they are small.
    """
    path = path or scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of one task of heavy text work.
TASK_ROWS = 50_000


def spread(df: DataFrame) -> DataFrame:
    """Spreads rows over all cores, and over more tasks of ``TASK_ROWS`` rows as they grow, before heavy text work; else unchanged."""
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, df.count() // TASK_ROWS)
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
