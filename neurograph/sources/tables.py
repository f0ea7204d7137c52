"""Tables that loops write between rounds, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset, a local master (as in tests) gets a temporary folder, and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="neurograph-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Whether a table that is made meanwhile leaves no shuffle files when it has been run. Else they stay until the driver's JVM happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def run_once(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of tables that are made and run in here are deleted after the run."""
    old = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, old)


def written(df: DataFrame, label: str, *spent: DataFrame) -> DataFrame:
    """Writes and reads again: cuts the lineage, and lost executors don't lose it. ``spent`` are earlier tables that only ``df`` needed; their files go, and
    so do those of the shuffles behind ``df``."""
    path = f"{shared_folder(df.sparkSession)}/neurograph/{label}-{uuid.uuid4().hex}"
    with run_once(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    drop(*spent)
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes the files of written tables that nothing reads any more."""
    for t in tables:
        if old := _WRITTEN.pop(t, None):
            folder = t.sparkSession._jvm.org.apache.hadoop.fs.Path(old)
            folder.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
