"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python tasks handle an Arrow batch in slices of about this many text bytes, so that one batch of very
#: long documents doesn't multiply in memory.
SLICE_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("recall.shared.dir", None)
        if not found:
            found = "file://" + tempfile.mkdtemp(prefix="recall-shared-")
            spark.conf.set("recall.shared.dir", found)
    return found


def saved(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors.

    Shuffle files of what led here are let go, as Spark does once nothing on the driver refers to them.
    """
    path = f"{shared_dir(df.sparkSession)}/recall-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    let_go(df.sparkSession)
    return out


def let_go(spark: SparkSession) -> None:
    """Shuffle files that nothing on the driver refers to any more go."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def forget(df: DataFrame) -> None:
    """Deletes what saved() wrote; nothing may read it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spare(df: DataFrame, name: str) -> str:
    """A column name like name that df doesn't have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc_mod(mod: int):
    """crc32 of doc_id as text, modulo mod: the folds that contracts name."""
    return F.crc32(F.col("doc_id").cast("string")) % mod


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about `most` bytes of text; a longer single text is a piece of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.binary())), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)
