"""Session helpers: shared working folder, table hand-over, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of one group (an era, a feature of an era, ...) that one task may sort.
DEFAULT_MAX_GROUP_ROWS = 4_000_000
# Rows and bytes a table may have before we refuse to broadcast it.
DEFAULT_BROADCAST_ROWS = 100_000
DEFAULT_BROADCAST_BYTES = 32 << 20


def local_session(cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the local benchmark; on a cluster use the one given."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("eraflow")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting (tests) gets a temporary folder; on a
    cluster the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _fallback:
        _fallback[context.applicationId] = tempfile.mkdtemp(prefix="eraflow-")
    return _fallback[context.applicationId]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and
    survives the loss of executors, because the files are on shared storage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/eraflow/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def max_group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.eraflow.maxGroupRows", str(DEFAULT_MAX_GROUP_ROWS)))


def broadcast_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.eraflow.broadcastRows", str(DEFAULT_BROADCAST_ROWS)))


def broadcast_bytes(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.eraflow.broadcastBytes", str(DEFAULT_BROADCAST_BYTES)))


def fits_broadcast(spark: SparkSession, rows: int, row_bytes: int) -> bool:
    """Whether a table of that many rows of that width is within both bounds."""
    return rows <= broadcast_rows(spark) and rows * row_bytes <= broadcast_bytes(spark)


def broadcast_checked(small: DataFrame) -> DataFrame:
    """Hint a broadcast only after measuring the table: its rows (the count stops one row
    past the bound) and its bytes, 16 a cell and what strings, binaries and arrays hold.
    Larger tables stay unhinted: a shuffle join, whose hot keys AQE splits."""
    spark = small.sparkSession
    held = F.lit(16 * len(small.columns)).cast("bigint")
    for name, kind in small.dtypes:
        if kind in ("string", "binary"):
            held = held + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
        elif kind.startswith("array"):
            held = held + F.coalesce(F.size(F.col(f"`{name}`")), F.lit(0)) * 16
    limit = broadcast_rows(spark)
    found = small.limit(limit + 1).agg(F.count(F.lit(1)).alias("rows"), F.sum(held).alias("bytes")).first()
    if found["rows"] <= limit and (found["bytes"] or 0) <= broadcast_bytes(spark):
        return F.broadcast(small)
    return small
