"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Most buckets of a table: Spark refuses over 100,000, and each is a file. A bucket holds any number of keys.
MOST_BUCKETS = 20_000

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset, a folder of our own on a single machine only."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or _OWN_DIRS.get(sc.applicationId)
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _OWN_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found


def written(df: DataFrame, what: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The frame written as Parquet, in folders by the columns `by`, and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, what: str) -> DataFrame:
    """The frame as a table bucketed by `key`, in the shared folder: groups of the key then need no shuffle of it.

    Spark deals a bucketed side anew if it has fewer buckets than the session has shuffle partitions, so
    there are as many at least. Beyond MOST_BUCKETS the buckets grow instead.
    """
    spark = df.sparkSession
    name = f"{what}_{uuid.uuid4().hex}"
    n = max(1, min(buckets, MOST_BUCKETS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(name)
    return spark.table(name)
