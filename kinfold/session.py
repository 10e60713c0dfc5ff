"""Session construction and the settings the plans in this package rely on."""

from __future__ import annotations

import atexit
import tempfile
from contextlib import contextmanager
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def build_session(app: str = "kinfold", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution and UTC; on a cluster everything else comes from spark-defaults."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, a temporary one in local mode, and an error on a cluster. It goes when the driver ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="kinfold-")
    _written.append(f"{folder.rstrip('/')}/kinfold-{name}-{uuid.uuid4().hex}")
    return _written[-1]


#: Where Spark has it, the shuffle files of an execution go when it ends instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession):
    """What is written within leaves no shuffle files behind. Nothing within may be lazy: the setting is read when an execution begins."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as written below a new scratch path and read back; its shuffle files are gone. remove deletes it before the driver ends."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kinfold_path = path
    return out


def remove(table: DataFrame) -> None:
    _written.remove(table._kinfold_path)
    _delete(table.sparkSession.sparkContext, table._kinfold_path)


def _delete(context: SparkContext, name: str) -> None:
    path = context._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def _clean_up() -> None:
    context = SparkContext._active_spark_context
    if context is not None:
        for name in _written:
            _delete(context, name)


atexit.register(_clean_up)
