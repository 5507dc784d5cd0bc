"""Row-level projections, predicates and joins of panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eraflow.functions.stats import all_finite, is_finite, none_null, ratio
from eraflow.session import broadcast_checked

KEYS = ["era", "id"]
# integers up to 32 bits and floats are held in single precision
CAST_TO_FLOAT = (T.ByteType, T.ShortType, T.IntegerType, T.FloatType)


def finite_target_rows(df: DataFrame, target: str) -> DataFrame:
    return df.where(is_finite(target))


def coerce_float(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Cast the features to single precision if all have one of these types; else nothing."""
    if not all(isinstance(df.schema[c].dataType, CAST_TO_FLOAT) for c in features):
        return df
    return df.withColumns({c: F.col(c).cast("float") for c in features})


def benchmark_predictions(benchmarks: DataFrame, column: str) -> DataFrame:
    """A benchmark column as a prediction frame: present, numeric and finite."""
    value = F.col(column).cast("double")
    return benchmarks.select(*KEYS, value.alias("prediction")).where(is_finite("prediction"))


def fill_missing(df: DataFrame, features: Sequence[str], value: float = 0.5) -> DataFrame:
    """Replace NULLs only; a NaN stays what it is."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(value)) for c in features})


def era_table(df: DataFrame) -> DataFrame:
    return df.select("era", "era_num").distinct()


def _placed(eras: DataFrame, descending: bool = False) -> DataFrame:
    order = F.desc("era_num") if descending else F.asc("era_num")
    return eras.withColumn("position", F.row_number().over(Window.orderBy(order)))


def eras_after_purge(df: DataFrame, purge: int) -> DataFrame:
    """Drop the first ``purge`` eras, counted by numeric order."""
    keep = _placed(era_table(df)).where(F.col("position") > purge).select("era")
    return df.join(broadcast_checked(keep), "era", "left_semi")


def every_nth_era(df: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th era, the first included: a feature of its own (thinning
    overlapping target windows)."""
    keep = _placed(era_table(df)).where((F.col("position") - 1) % step == 0).select("era")
    return df.join(broadcast_checked(keep), "era", "left_semi")


def rows_of_eras(df: DataFrame, eras: DataFrame) -> DataFrame:
    return df.join(broadcast_checked(eras.select("era").distinct()), "era", "left_semi")


def validated_eras(df: DataFrame) -> DataFrame:
    """Distinct era labels in numeric order. A label that is not a number, or two
    spellings of one number, fail the job."""
    labels = df.select(F.col("era").cast("string").alias("era")).distinct()
    number = F.expr("try_cast(era as int)")
    checked = labels.withColumn(
        "era_num",
        F.when(number.isNotNull(), number).otherwise(
            F.raise_error(F.concat(F.lit("non-numeric era label: "), F.col("era"))).cast("int")
        ),
    )
    spelled = checked.groupBy("era_num").agg(
        F.min("era").alias("era"), F.count(F.lit(1)).alias("spellings")
    )
    conflict = F.raise_error(
        F.concat(F.lit("inconsistent zero padding of era "), F.col("era_num").cast("string"))
    )
    return spelled.select(
        F.when(F.col("spellings") == 1, F.col("era")).otherwise(conflict.cast("string")).alias("era"),
        "era_num",
    )


def bins_valid(df: DataFrame, features: Sequence[str], top: int = 4) -> DataFrame:
    """One row: do all features hold integers from 0 to ``top`` only?"""
    checks = []
    for c in features:
        v = F.col(c).cast("double")
        good = is_finite(v) & (v >= 0.0) & (v <= float(top)) & (v == F.floor(v))
        checks.append(F.coalesce(F.bool_and(good), F.lit(False)).alias(c))
    return df.agg(*checks)


def standardize(train: DataFrame, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Centre and scale by the train mean and population deviation; a feature without
    spread becomes 0. The statistics are a scalar subquery: one row, whatever the data."""
    stats = train.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in features],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in features],
        ).alias("stats")
    ).scalar()
    scaled = {
        c: F.coalesce(
            ratio(F.col(c) - F.col(f"__stats.m_{c}"), F.col(f"__stats.s_{c}")), F.lit(0.0)
        )
        for c in features
    }
    return rows.withColumn("__stats", stats).withColumns(scaled).select(*rows.columns)


# -- joins -------------------------------------------------------------------


def evaluation_base(
    predictions: DataFrame, meta: DataFrame, targets: DataFrame, features: DataFrame
) -> DataFrame:
    """Inner join on (era, id). Ids are required on every side: joining on the era
    alone would pair all rows of an era with all others."""
    for df in (predictions, meta, targets, features):
        missing = [k for k in KEYS if k not in df.columns]
        if missing:
            raise ValueError(f"missing key columns: {missing}")
    return predictions.join(meta, KEYS).join(targets, KEYS).join(features, KEYS)


def attach_benchmark(base: DataFrame, benchmarks: DataFrame, column: str) -> DataFrame:
    return base.join(benchmarks.select(*KEYS, column), KEYS, "left")


def stacked_predictions(long: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Out-of-fold predictions of several targets side by side, on the rows all of
    them cover: one shuffle however many targets there are."""
    wide = long.groupBy(*KEYS).pivot("target", list(targets)).agg(F.first("prediction"))
    return wide.where(none_null(list(targets)))


def common_rows(long: DataFrame, n_models: int, name: str = "model_id") -> DataFrame:
    """Rows of the (era, id) keys that every one of ``n_models`` models has. A key has at
    most one row per model, so neither the count nor the join has hot keys."""
    covered = (
        long.groupBy(*KEYS).agg(F.count_distinct(name).alias("n")).where(F.col("n") == n_models)
    )
    return long.join(covered.select(*KEYS), KEYS, "left_semi")


def aligned_sources(left: DataFrame, right: DataFrame, targets: DataFrame) -> DataFrame:
    """Full outer join of two prediction sources, then inner join with the targets."""
    return left.join(right, KEYS, "full").join(targets, KEYS)


def with_labels(series: DataFrame, labels: DataFrame) -> DataFrame:
    """Per-era scores with their era's label; no shared era at all is an error."""
    joined = series.join(broadcast_checked(labels), "era")
    if joined.limit(1).count() == 0:
        raise ValueError("scores and labels share no era")
    return joined


def with_metadata(cards: DataFrame, metadata: DataFrame, key: str = "model_id") -> DataFrame:
    return cards.join(broadcast_checked(metadata), key, "left")


def complete_join(left: DataFrame, right: DataFrame, keys: Sequence[str] = tuple(KEYS)) -> DataFrame:
    """Inner join that must not lose a row of the left side."""
    lost = left.join(right, list(keys), "left_anti").limit(1).count()
    if lost:
        raise ValueError("the join would drop rows")
    return left.join(right, list(keys))


def universe_differences(submitted: DataFrame, expected: DataFrame, key: str = "id") -> DataFrame:
    """Ids on one side only: (id, problem) with problem "extra" or "missing"."""
    extra = submitted.select(key).distinct().join(expected, key, "left_anti")
    missing = expected.select(key).distinct().join(submitted, key, "left_anti")
    return extra.select(key, F.lit("extra").alias("problem")).unionByName(
        missing.select(key, F.lit("missing").alias("problem"))
    )


def meta_training_rows(predictions: DataFrame, targets: DataFrame, target: str) -> DataFrame:
    return predictions.join(targets.where(F.col(target).isNotNull()).select(*KEYS, target), KEYS)


def block_of(position: Column, n: Column, blocks: int) -> Column:
    return F.floor((position - 1) * blocks / n).cast("int")


def block_score_matrix(
    df: DataFrame, feature: str, second: str, target: str, blocks: int = 4
) -> DataFrame:
    """Least-squares fits of two features on each block of eras, scored on every block:
    (train_block, test_block, corr). Fits are a row per block, so pairing blocks is a
    small explode, not a product of rows."""
    eras = _placed(era_table(df)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    eras = eras.select("era", block_of(F.col("position"), F.col("n"), blocks).alias("block"))
    rows = df.join(broadcast_checked(eras), "era").select(
        "block", F.col(feature).cast("double").alias("a"), F.col(second).cast("double").alias("b"),
        F.col(target).cast("double").alias("t"),
    ).where(all_finite(["a", "b", "t"]))
    s = rows.groupBy("block").agg(
        F.var_pop("a").alias("aa"), F.var_pop("b").alias("bb"), F.covar_pop("a", "b").alias("ab"),
        F.covar_pop("a", "t").alias("at"), F.covar_pop("b", "t").alias("bt"), F.var_pop("t").alias("tt"),
        F.count(F.lit(1)).alias("n"),
    )
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    fits = s.select(
        F.col("block").alias("train_block"),
        ratio(F.col("at") * F.col("bb") - F.col("bt") * F.col("ab"), det).alias("wa"),
        ratio(F.col("bt") * F.col("aa") - F.col("at") * F.col("ab"), det).alias("wb"),
    )
    # A fit's correlation with the target of a block needs that block's second moments only.
    packed = fits.agg(F.collect_list(F.struct("train_block", "wa", "wb")).alias("fits")).scalar()
    paired = s.withColumn("fits", packed).select(F.col("block").alias("test_block"), "*", F.explode("fits").alias("f"))
    wa, wb = F.col("f.wa"), F.col("f.wb")
    spread = wa * wa * F.col("aa") + 2 * wa * wb * F.col("ab") + wb * wb * F.col("bb")
    scale = F.sqrt(F.greatest(spread, F.lit(0.0))) * F.sqrt("tt")
    corr = F.when((F.col("n") >= 2) & (scale > 0), ratio(wa * F.col("at") + wb * F.col("bt"), scale))
    return paired.select(F.col("f.train_block").alias("train_block"), "test_block", F.coalesce(corr, F.lit(0.0)).alias("corr"))


def checked_ids(df: DataFrame) -> DataFrame:
    """Facts a submission must satisfy: unique ids, finite values, all inside (0, 1)."""
    value = F.col("prediction").cast("double")
    per_id = df.groupBy("id").agg(
        F.count(F.lit(1)).alias("c"),
        F.bool_and(is_finite(value)).alias("finite"),
        F.bool_and(F.coalesce((value > 0.0) & (value < 1.0), F.lit(False))).alias("inside"),
    )
    return per_id.agg(
        F.sum("c").alias("n_rows"),
        F.count_if(F.col("c") > 1).alias("n_repeated_ids"),
        F.bool_and("finite").alias("all_finite"),
        F.bool_and("inside").alias("all_inside"),
    )
