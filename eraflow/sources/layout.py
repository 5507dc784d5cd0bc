"""Panels and predictions laid out for joins and era scans.

A table is stored in buckets of (era, id), sorted, inside folders of ranges of eras. Tables
of the same number of buckets join on (era, id) where they lie, without a shuffle, and a
bound on ``era_num`` is turned into a bound on the folders, so that a scan of some eras
opens their folders only. Rows of one era are spread over all buckets, so an era of any
size is no hot bucket.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, BUCKET_ERAS = 64, 8
_NAME = re.compile(r"^[a-z]\w*$")


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int = BUCKETS, width: int = BUCKET_ERAS) -> DataFrame:
    """Store ``df`` (with era, era_num and id) at ``path`` as the table ``name`` of the
    session's catalog, in folders of ``width`` era numbers; the stored table."""
    if not _NAME.match(name):
        raise ValueError(f"no table name: {name!r}")
    # One task writes one bucket of one folder: as many files as buckets and folders.
    placed = df.withColumn("era_bucket", F.floor(F.col("era_num") / width).cast("int"))
    (
        placed.repartition(buckets, "era", "id")
        .write.format("parquet").mode("overwrite").option("path", path)
        .partitionBy("era_bucket").bucketBy(buckets, "era", "id").sortBy("era", "id").saveAsTable(name)
    )
    return df.sparkSession.table(name)


def open_bucketed(spark: SparkSession, name: str, path: str, schema: str, buckets: int = BUCKETS) -> DataFrame:
    """A table that another session stored at ``path``, with the columns of ``schema`` (DDL,
    era_bucket left out)."""
    if not _NAME.match(name):
        raise ValueError(f"no table name: {name!r}")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({schema}, era_bucket INT) USING parquet PARTITIONED BY (era_bucket) "
        f"CLUSTERED BY (era, id) SORTED BY (era, id) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
    )
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name)


def eras_between(first: int | None = None, last: int | None = None, width: int = BUCKET_ERAS) -> Column:
    """A filter on ``era_num`` that also names the folders it needs."""
    keep = F.lit(True)
    if first is not None:
        keep = keep & (F.col("era_num") >= first) & (F.col("era_bucket") >= first // width)
    if last is not None:
        keep = keep & (F.col("era_num") <= last) & (F.col("era_bucket") <= last // width)
    return keep
