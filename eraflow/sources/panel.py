"""Reading and writing panels: projected scans, unions of splits, snapshots, ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eraflow.session import broadcast_checked

KEYS = ("era", "id")


def existing(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The listed columns the frame has, once each, in the listed order."""
    return [c for c in dict.fromkeys(columns) if c in df.columns]


def scan(
    spark: SparkSession,
    path: str,
    features: Sequence[str] = (),
    targets: Sequence[str] = (),
    known_targets: Sequence[str] | None = None,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Keys, features and targets of a stored split and nothing else, so the parquet
    reader touches only these columns. A target that is not in ``known_targets`` is
    an error; one the file lacks is skipped."""
    unknown = set(targets) - set(known_targets) if known_targets is not None else set()
    if unknown:
        raise ValueError(f"unknown targets: {sorted(unknown)}")
    df = spark.read.parquet(path)
    return df.select(*existing(df, [*KEYS, *extra, *features, *targets]))


def scan_eras(
    frames: Sequence[DataFrame], columns: Sequence[str], max_era: int | None = None
) -> DataFrame:
    """Union of splits, bounded by era. The bound is on the stored integer, so it is
    pushed into the scan."""
    picked = []
    for df in frames:
        df = df.select(*existing(df, [*KEYS, "era_num", *columns]))
        picked.append(df.where(F.col("era_num") <= max_era) if max_era is not None else df)
    out = picked[0]
    for df in picked[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def full_history(train: DataFrame, validation: DataFrame) -> DataFrame:
    return train.unionByName(validation, allowMissingColumns=True)


def truncated_window(df: DataFrame, eras_per_split: int, split: str = "split") -> DataFrame:
    """The first eras of every split. Positions are found on the table of eras; the
    panel is only semi-joined with it."""
    eras = df.select(split, "era", "era_num").distinct()
    order = Window.partitionBy(split).orderBy("era_num")
    first = eras.withColumn("i", F.row_number().over(order)).where(F.col("i") <= eras_per_split)
    return df.join(broadcast_checked(first.select(split, "era")), [split, "era"], "left_semi")


def coalesced_target(df: DataFrame, candidates: Sequence[str]) -> str:
    """First candidate column the frame has (target fallback chain)."""
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"none of {list(candidates)} is present")


def horizon_targets(df: DataFrame, chain_20: Sequence[str], chain_60: Sequence[str]) -> tuple[str, str]:
    """Target columns of both horizons, the longer one falling back on the shorter."""
    short = coalesced_target(df, chain_20)
    return short, next((c for c in chain_60 if c in df.columns), short)


def lookups(
    targets: DataFrame, meta: DataFrame, benchmarks: DataFrame, benchmark: str, meta_column: str
) -> tuple[DataFrame, DataFrame]:
    """Targets and one benchmark column restricted to the eras the meta model covers; a
    benchmark file without that column gives an empty frame."""
    eras = broadcast_checked(meta.where(F.col(meta_column).isNotNull()).select("era").distinct())
    restricted = targets.join(eras, "era", "left_semi")
    if benchmark not in benchmarks.columns:
        empty = meta.sparkSession.createDataFrame([], f"era string, id string, {benchmark} double")
        return restricted, empty
    return restricted, benchmarks.select("era", "id", benchmark).join(
        eras, "era", "left_semi"
    )


def snapshot(df: DataFrame, name: str) -> DataFrame:
    """One row: columns, rows, distinct eras, era bounds, and a digest of these."""
    per_era = df.groupBy("era", "era_num").agg(F.count(F.lit(1)).alias("rows"))
    facts = per_era.agg(
        F.lit(name).alias("dataset"),
        F.lit(",".join(sorted(df.columns))).alias("columns"),
        F.sum("rows").alias("n_rows"),
        F.count(F.lit(1)).alias("n_eras"),
        F.min_by("era", "era_num").alias("min_era"),
        F.max_by("era", "era_num").alias("max_era"),
    )
    parts = ("dataset", "columns", "n_rows", "n_eras", "min_era", "max_era")
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in parts])
    return facts.withColumn("fingerprint", F.sha2(text, 256))


def era_ledger(df: DataFrame, date: str, split: str = "split") -> DataFrame:
    """(date, dataset, start_era, end_era): era range of every split."""
    return df.groupBy(F.col(split).alias("dataset")).agg(
        F.min_by("era", "era_num").alias("start_era"), F.max_by("era", "era_num").alias("end_era")
    ).select(F.lit(date).cast("date").alias("date"), "dataset", "start_era", "end_era")


def update_ledger(ledger: DataFrame, today: DataFrame) -> DataFrame:
    """Replace the rows of the new date, keep the others."""
    dates = today.select("date").distinct()
    return ledger.join(dates, "date", "left_anti").unionByName(
        today, allowMissingColumns=True
    )


def last_live_round(ledger: DataFrame) -> DataFrame:
    live = ledger.where("dataset = 'live'")
    return live.agg(F.max(F.col("round_id").cast("int")).alias("last_round"))


def write_table(df: DataFrame, path: str, bucket_width: int | None = None) -> None:
    """Parquet sink. With ``bucket_width`` the files are grouped by ranges of eras (an
    integer column, so zero-padded labels survive and era bounds prune folders)."""
    if bucket_width is None:
        df.write.mode("overwrite").parquet(path)
        return
    bucketed = df.withColumn("era_bucket", (F.col("era_num") / bucket_width).cast("int"))
    bucketed.write.mode("overwrite").partitionBy("era_bucket").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV sink with the spellings NaN / Infinity for non-finite doubles."""
    cells = []
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            c = F.col(name)
            cells.append(
                F.when(F.isnan(c), "NaN")
                .when(c == float("inf"), "Infinity")
                .when(c == float("-inf"), "-Infinity")
                .otherwise(c.cast("string"))
                .alias(name)
            )
        else:
            cells.append(F.col(name))
    df.select(*cells).write.mode("overwrite").option("header", True).csv(path)


def newest_version(versions: DataFrame, column: str = "version") -> DataFrame:
    """The highest v<major>.<minor> label, compared as numbers."""
    parts = F.struct(
        F.regexp_extract(column, r"^v(\d+)\.(\d+)$", 1).cast("int").alias("major"),
        F.regexp_extract(column, r"^v(\d+)\.(\d+)$", 2).cast("int").alias("minor"),
    )
    return versions.where(F.col(column).rlike(r"^v\d+\.\d+$")).agg(F.max_by(column, parts).alias("newest"))
