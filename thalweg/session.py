"""Sessions, the shared folder, and getting this package to the executors."""

from __future__ import annotations

import contextlib
import functools
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _archive() -> str:
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="thalweg-"), "thalweg_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    return path


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package, so that functions that run there can be loaded."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        context.addPyFile(_archive())
    return spark


def session(app: str = "thalweg", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local session (as in tests) takes a temporary folder of this
    machine; on a cluster, whose executors would not see it, this raises ValueError.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="thalweg-")
        context.setCheckpointDir(base)
    return base


#: Removes an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes that Spark hands to a Python worker at once, in rows of tables that hold arrays: of Spark's 64 MB a worker keeps two or three copies.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
TILES_AT_ONCE = "4m"


@contextlib.contextmanager
def _set(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def few_tiles(spark: SparkSession):
    """What is executed inside hands Python workers few tiles at once."""
    return _set(spark, ARROW_BYTES, TILES_AT_ONCE)


def shuffles_removed(spark: SparkSession):
    """What is executed inside leaves no shuffle files: for plans that run once."""
    return _set(spark, CLEANUP, "true")


def written_tiles(df: DataFrame, name: str) -> DataFrame:
    """written(), for tables whose rows hold arrays of whole tiles: Python workers get few of them at once."""
    with few_tiles(df.sparkSession):
        return written(df, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files of the writing go with its end; discard() removes the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/thalweg/{uuid.uuid4().hex}/{name}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path.rsplit("/", 1)[0]
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables that written() made and nothing reads any more; others are left alone."""
    for table in tables:
        path = vars(table).get("written_to")
        if path:
            jvm = table.sparkSession.sparkContext._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
