"""Tables that a job writes and reads again, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session, whose tasks all run on this machine, gets a temporary folder; a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("recall.tables.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="recall-tables-")
        spark.conf.set("recall.tables.dir", found)
    return found


def kept(df: DataFrame) -> DataFrame:
    """df written and read again: ends its lineage, survives lost executors and is worked out once."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
