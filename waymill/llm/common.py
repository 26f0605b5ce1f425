"""What the operators of this subpackage share: typed columns, tables in the shared folder, Arrow rows."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: settings while a table is written, by the default that they replace
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": ("false", "true"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m"),
}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all run on this machine."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("waymill.shared.dir", None)
        if not base:
            if not re.match(r"local($|\[)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all share")
            base = "file://" + tempfile.mkdtemp(prefix="waymill-")
            spark.conf.set("waymill.shared.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/waymill/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def purge(spark: SparkSession) -> None:
    """Delete all that this application wrote into the shared folder, once its results are no longer read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/waymill/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once into the shared folder and read it back: cuts lineage and survives lost executors. The write's shuffle files go with
    its end, as nothing reads them any more, and batches that go to Python are small, unless the session sets their size itself."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for key, (default, own) in WRITING.items():
        if before[key] in (None, default):
            spark.conf.set(key, own)
    try:
        df.write.parquet(path)
    finally:
        for key, old in before.items():
            spark.conf.unset(key) if old is None else spark.conf.set(key, old)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that materialize wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def trim() -> None:
    """Give memory that this Python worker freed back to the system: workers are kept for later tasks, next to a JVM that needs it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(col: str = "text") -> Column:
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.encode(F.col(col), "UTF-8"), F.lit(b""))


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(col).cast("string"), F.lit("")), "UTF-8"))


def rows(batches: Iterable[pa.RecordBatch], most: int = 1 << 24, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about `most` bytes of its text column, or one row."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        n = batch.num_rows
        if batch.nbytes <= most or n < 2:
            yield batch
            continue
        sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(at)]
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start, n - start)


def strings(batch: pa.RecordBatch, col: str = "text") -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(col)).to_pylist()]
