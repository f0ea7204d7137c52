"""What the operators of this subpackage share: written intermediate tables, Arrow maps, words and their hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII white space that separates words; ``bytes.split()`` splits at exactly these.
SPACES = b" \t\n\r\x0b\x0c"
#: Distinct words that a worker remembers before it starts anew.
CACHE_WORDS = 1_000_000
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Folders of the tables that ``materialize`` wrote.
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``. Where that is unset, a local master gets a temporary folder, and a
    cluster an error, as its machines would each write to their own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="neurograph-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/neurograph/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes what ``materialize`` wrote for ``tables``, once nothing that is still to run reads them."""
    for t in tables:
        if path := _WRITTEN.pop(t, None):
            spark = t.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def slices(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of at most ``rows`` rows and ``size`` bytes, but of one row at least."""
    if batch.num_rows > rows:
        for k in range(0, batch.num_rows, rows):
            yield from slices(batch.slice(k, rows), rows, size)
    elif batch.num_rows > 1 and batch.nbytes > size:
        half = batch.num_rows // 2
        yield from slices(batch.slice(0, half), rows, size)
        yield from slices(batch.slice(half), rows, size)
    elif batch.num_rows:
        yield batch


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, rows: int = 512, size: int = 8 << 20) -> DataFrame:
    """``mapInArrow`` whose kernel sees parts of at most ``rows`` rows and ``size`` bytes, whatever batches the session makes. Where the session has no byte
    bound of its own it gets this one, the same for all operators, as Spark's default of 64 MB is held several times over by each task."""
    conf = df.sparkSession._jsparkSession.conf()
    if not conf.contains(_BYTES):
        conf.set(_BYTES, str(8 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(part for b in batches for part in slices(b, rows, size))

    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case of its letters."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def raw_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes, without a detour by str."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


class WordHashes(dict):
    """word -> XXH3 (64 bits); the same in every process."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deals rows by ``keys``; AQE may split and join the partitions."""
    return df.repartition(*[F.col(k) for k in keys])
