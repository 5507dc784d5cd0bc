"""Incremental results over eras that arrive as files.

Both jobs use ``availableNow`` triggers and a checkpoint folder: a run processes what
has arrived since the last one and stops. Restarting after a failure repeats at most
one micro-batch, and repeating it gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eraflow.functions.stats import is_finite
from eraflow.operators.analysis import labelled, moments, unpivot
from eraflow.session import broadcast_checked, remove_path
from eraflow.sources import snapshots


def era_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 8
) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )


def feature_moments(stream: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pooled moments per feature as a streaming aggregation. The state is one row of
    mergeable moments per feature, however many eras have passed."""
    long = unpivot(stream, [], features, "v")
    per = long.groupBy("k").agg(*moments(F.when(is_finite("v"), F.col("v"))))
    return labelled(per, features, "feature")


def run_feature_moments(
    stream: DataFrame, features: Sequence[str], out: str, checkpoint: str
) -> None:
    """Process everything available. Every batch publishes the moments so far as a
    snapshot at ``out`` (``snapshots.current`` reads the last one): readers never see a
    gap, and a batch that is repeated after a failure publishes nothing new."""

    def replace(batch: DataFrame, number: int) -> None:
        snapshots.publish(batch, out, number)

    # the state is a row per feature: more parts of it than that would be committed empty by
    # every batch. A query keeps the number it was started with, also when it is restarted.
    parts = "spark.sql.shuffle.partitions"
    spark = stream.sparkSession
    usual = spark.conf.get(parts)
    spark.conf.set(parts, str(max(1, min(int(usual), len(features)))))
    try:
        query = (
            feature_moments(stream, features)
            .writeStream.outputMode("complete")
            .foreachBatch(replace)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(parts, usual)
    query.awaitTermination()


def run_era_scores(
    stream: DataFrame,
    state: str,
    score: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    open_eras: int | None = None,
) -> None:
    """Score the eras of every micro-batch on all of their rows so far.

    A batch's rows are kept under ``state`` by era and batch; an era is scored on its own
    folder, so a batch reads the rows of its eras and nothing else, however long the
    stream is. Scores go to ``out`` by era and batch as well; ``current_scores`` takes an
    era's last batch, so a late file scores its era again and no reader sees a gap. Both
    writes replace what the same batch wrote before.

    With ``open_eras``, eras that many numbers below the highest one seen are closed: their
    rows are deleted, their scores stay, and rows that come later still are kept under
    ``state``/late, unscored. ``score`` maps rows to (era, value)."""
    schema = stream.schema

    def put(df: DataFrame, path: str, number: int) -> None:
        marked = df.withColumn("batch", F.lit(number).cast("bigint"))
        writer = marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("era_num", "batch").parquet(path)

    def rescore(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        arrived = batch.withColumn("era_key", F.col("era_num"))
        eras = sorted(r["era_num"] for r in batch.select("era_num").distinct().collect())
        if not eras:
            return
        known = _era_folders(spark, f"{state}/rows")
        closed_below = max([*eras, *known]) - open_eras if open_eras is not None else None
        late = [e for e in eras if closed_below is not None and e < closed_below and e not in known]
        if late:
            put(arrived.where(F.col("era_num").isin(late)), f"{state}/late", number)
        eras = [e for e in eras if e not in late]
        if eras:
            put(arrived.where(F.col("era_num").isin(eras)), f"{state}/rows", number)
            folders = [f"{state}/rows/era_num={e}" for e in eras]
            kept = T.StructType([*[f for f in schema.fields if f.name != "era_num"], T.StructField("era_key", schema["era_num"].dataType)])
            rows = spark.read.schema(kept).option("recursiveFileLookup", True).parquet(*folders)
            rows = rows.withColumnRenamed("era_key", "era_num").select(*schema.fieldNames())
            put(score(rows).withColumn("era_num", F.col("era").cast("int")), out, number)
        if closed_below is not None:
            for e in {*known, *eras}:
                if e < closed_below:
                    remove_path(spark, f"{state}/rows/era_num={e}")

    query = (
        stream.writeStream.foreachBatch(rescore)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _era_folders(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the eras that have rows in the store (one folder each)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    names = [status.getPath().getName() for status in system.listStatus(folder)]
    return [int(n.removeprefix("era_num=")) for n in names if n.startswith("era_num=")]


def current_scores(spark: SparkSession, out: str) -> DataFrame:
    """The scores of every era as of the last batch that had rows of it."""
    scores = spark.read.parquet(out)
    last = scores.groupBy("era_num").agg(F.max("batch").alias("batch"))
    return scores.join(broadcast_checked(last), ["era_num", "batch"], "left_semi").drop("batch")
