"""Operators over per-era score series: summaries, drawdowns, streaks, payouts.

A series frame has one row per (``by``..., era) with ``era_num`` and ``value``. Its
groups are bounded by the number of eras, so windows per series are safe; nothing
here touches the panel's rows except :func:`ordinal_percentile`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eraflow.functions.ranks import group_shape
from eraflow.functions.stats import clip, ratio, sample_kurtosis, sample_skew
from eraflow.session import broadcast_checked, materialize, max_group_rows

ERAS_PER_YEAR = 52.0
CORR_WEIGHT, MMC_WEIGHT = 0.75, 2.25
PAYOUT_CLIP = 0.05


def with_era_num(df: DataFrame) -> DataFrame:
    """Numeric chronology from the era label; a non-numeric label fails the job."""
    return df if "era_num" in df.columns else df.withColumn("era_num", F.col("era").cast("int"))


def _time(by: Sequence[str]) -> Window:
    return Window.partitionBy(*by).orderBy("era_num")


def _running(by: Sequence[str]) -> Window:
    return _time(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def cumulative(series: DataFrame, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Running sum, its running maximum, and the distance below that maximum."""
    run = _running(by)
    return (
        with_era_num(series)
        .withColumn("cum", F.sum(value).over(run))
        .withColumn("peak", F.max("cum").over(run))
        .withColumn("drawdown", F.col("peak") - F.col("cum"))
    )


def summarize(series: DataFrame, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Mean, population deviation, their ratio, and the largest drawdown of the
    running sum (whose peak starts at the first value)."""
    sd = F.stddev_pop(value)
    return cumulative(series, by, value).groupBy(*by).agg(
        F.avg(value).alias("mean"),
        sd.alias("std"),
        F.coalesce(ratio(F.avg(value), sd), F.lit(0.0)).alias("sharpe"),
        F.max("drawdown").alias("max_drawdown"),
    )


def wealth(series: DataFrame, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Running product of 1 + value and its relative drawdown (0 while the peak is
    not positive)."""
    run = _running(by)
    grown = with_era_num(series).withColumn("wealth", F.product(F.col(value) + 1.0).over(run))
    peak = F.max("wealth").over(run)
    return grown.withColumn(
        "wealth_drawdown",
        F.when(peak > 0.0, F.col("wealth") / peak - 1.0).otherwise(F.lit(0.0)),
    )


def longest_streak(
    df: DataFrame, flag: Column, out: str, by: Sequence[str] = ()
) -> DataFrame:
    """Longest run of consecutive rows (in era order) on which ``flag`` holds."""
    order = _time(by)
    marked = df.withColumn("__flag", F.coalesce(flag, F.lit(False)))
    marked = marked.withColumn("__all", F.row_number().over(order))
    island = F.col("__all") - F.sum(F.col("__flag").cast("int")).over(_running(by))
    runs = (
        marked.withColumn("__island", island)
        .groupBy(*by, "__island")
        .agg(F.count_if("__flag").alias("__length"))
    )
    return runs.groupBy(*by).agg(F.max("__length").alias(out))


def max_burn_streak(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return longest_streak(
        with_era_num(series), F.col("value") < 0.0, "max_burn_streak", by
    )


def time_to_recovery(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Longest stretch the running sum stays below its running maximum."""
    return longest_streak(
        cumulative(series, by), F.col("cum") < F.col("peak"), "time_to_recovery", by
    )


def rolling_deviation(
    series: DataFrame, by: Sequence[str] = (), width: int = 20, minimum: int = 2
) -> DataFrame:
    """Sample deviation of the last ``width`` eras, NULL with fewer than ``minimum`` values."""
    window = _time(by).rowsBetween(-(width - 1), Window.currentRow)
    return with_era_num(series).withColumn(
        "rolling_std",
        F.when(F.count("value").over(window) >= minimum, F.stddev_samp("value").over(window)),
    )


def rolling_mean(series: DataFrame, by: Sequence[str] = (), width: int = 10) -> DataFrame:
    window = _time(by).rowsBetween(-(width - 1), Window.currentRow)
    return with_era_num(series).withColumn(
        "rolling_mean",
        F.when(F.count("value").over(window) >= width, F.avg("value").over(window)),
    )


def ordinal_percentile(
    df: DataFrame, column: str, out: str, by: Sequence[str] = ("era",)
) -> DataFrame:
    """Row number over row count within the group, ties ordered by id.

    Oversized groups are numbered from one distributed sort by (group, value, id):
    the stored partition number and a small table of counts per group and partition
    place every row, whatever the group sizes and ties are.
    """
    by = list(by)
    shape = group_shape(df, by)
    group = Window.partitionBy(*by)
    if shape[1] <= max_group_rows(df.sparkSession):
        number = F.row_number().over(group.orderBy(column, "id"))
        return df.withColumn(out, number / F.count(F.lit(1)).over(group))
    keys = df.select(*by, "id", F.col(column).alias("__value"))
    ordered = materialize(
        keys.orderBy(*by, "__value", "id").withColumn("__part", F.spark_partition_id()), "ordered"
    )
    totals = ordered.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__in"))
    totals = totals.withColumn("__n", F.sum("__in").over(group)).withColumn(
        "__before", F.sum("__in").over(group.orderBy("__part")) - F.col("__in")
    )
    inside = F.row_number().over(Window.partitionBy(*by, "__part").orderBy("__value", "id"))
    numbered = ordered.join(broadcast_checked(totals), [*by, "__part"]).select(
        *by, "id", ((F.col("__before") + inside) / F.col("__n")).alias(out)
    )
    return df.join(numbered, [*by, "id"])


def series_stats(series: DataFrame, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Count, mean, deviation, their ratio, and bias-corrected skewness and kurtosis."""
    sd = F.stddev_pop(value)
    return series.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        sd.alias("std"),
        F.coalesce(ratio(F.avg(value), sd), F.lit(0.0)).alias("sharpe"),
        sample_skew(F.col(value)).alias("skew"),
        sample_kurtosis(F.col(value)).alias("kurt"),
    )


def payout_series(
    corr: DataFrame,
    mmc: DataFrame,
    by: Sequence[str] = (),
    payout_factor: float = 1.0,
    bound: float = PAYOUT_CLIP,
) -> DataFrame:
    """Weighted sum of both scores on the eras they share, raw and clipped."""
    joined = with_era_num(corr.withColumnRenamed("value", "corr")).join(
        mmc.select(*by, "era", F.col("value").alias("mmc")), [*by, "era"]
    )
    raw = F.lit(payout_factor) * (
        F.lit(CORR_WEIGHT) * F.col("corr") + F.lit(MMC_WEIGHT) * F.col("mmc")
    )
    return joined.withColumn("raw", raw).withColumn("value", clip(F.col("raw"), -bound, bound))


def annual_return(value: Column) -> Column:
    """Aggregate: compounded growth per year; -1 after a total loss, 0 below two eras."""
    n = F.count(value)
    growth = F.product(F.lit(1.0) + value)
    return (
        F.when(n < 2, 0.0)
        .when(growth <= 0.0, -1.0)
        .otherwise(F.pow(growth, F.lit(ERAS_PER_YEAR) / n) - 1.0)
    )


def gain_to_pain(value: Column) -> Column:
    gains = F.sum(F.greatest(value, F.lit(0.0)))
    losses = F.sum(F.abs(F.least(value, F.lit(0.0))))
    return (
        F.when(losses > 0.0, gains / F.when(losses > 0.0, losses))
        .when(gains > 0.0, float("inf"))
        .otherwise(0.0)
    )


def kelly(raw: Column) -> Column:
    mean, variance = F.avg(raw), F.var_pop(raw)
    return F.when(
        (variance > 0.0) & (mean > 0.0), F.least(mean / F.when(variance > 0.0, variance), F.lit(1.0))
    ).otherwise(0.0)


def burn_rate(value: Column) -> Column:
    return F.avg((value < 0.0).cast("double"))


def sortino(value: Column, target: float = 0.0) -> Column:
    shortfall = F.least(value - F.lit(target), F.lit(0.0))
    down = F.sqrt(F.avg(shortfall * shortfall))
    return F.when(down > 0.0, (F.avg(value) - target) / F.when(down > 0.0, down)).otherwise(0.0)


def payout_shape(payout: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every payout statistic that is one aggregate of the clipped (or raw) series."""
    value = F.col("value")
    return payout.groupBy(*by).agg(
        F.count(value).alias("n_eras"),
        F.avg(value).alias("mean_payout"),
        annual_return(value).alias("cagr_1y"),
        gain_to_pain(value).alias("gain_to_pain_ratio"),
        kelly(F.col("raw")).alias("kelly_fraction"),
        burn_rate(value).alias("burn_rate"),
        sortino(value).alias("sortino"),
    )


def cvar(series: DataFrame, by: Sequence[str] = (), q: float = 0.05) -> DataFrame:
    """Mean of the max(1, floor(q n)) smallest values."""
    group = Window.partitionBy(*by)
    keep = F.greatest(F.floor(F.lit(q) * F.count(F.lit(1)).over(group)), F.lit(1))
    return (
        series.withColumn("__keep", keep)
        .withColumn("__position", F.row_number().over(group.orderBy("value", "era")))
        .where(F.col("__position") <= F.col("__keep"))
        .groupBy(*by)
        .agg(F.avg("value").alias("cvar"))
    )


def calmar(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean over the largest drawdown; infinite for a gain without drawdown."""
    mean, worst = F.avg("value"), F.max("drawdown")
    return cumulative(series, by).groupBy(*by).agg(
        worst.alias("max_drawdown"),
        F.when(worst > 0.0, mean / F.when(worst > 0.0, worst))
        .when(mean > 0.0, float("inf"))
        .otherwise(0.0)
        .alias("calmar"),
    )


def centred_drawdown(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Largest fall (a negative number) of the running sum of deviations from the mean."""
    centred = series.withColumn(
        "__c", F.col("value") - F.avg("value").over(Window.partitionBy(*by))
    )
    return cumulative(centred, by, "__c").groupBy(*by).agg(
        F.when(F.count("value") >= 2, F.min(F.col("cum") - F.col("peak"))).alias("centred_drawdown")
    )


def payout_report(payout: DataFrame, by: Sequence[str] = (), q: float = 0.05) -> DataFrame:
    """All payout and downside statistics of each series, plus the moments of its raw
    series, in one pass: every window and the final aggregate share the partitioning by
    series, so the (era-long) series are shuffled once."""
    group, order, run = Window.partitionBy(*by), _time(by), _running(by)
    n = F.count(F.lit(1)).over(group)
    df = (
        payout.withColumns({"__cum": F.sum("value").over(run), "__i": F.row_number().over(order)})
        .withColumn("__peak", F.max("__cum").over(run))
        .withColumns({"__burn": F.col("value") < 0.0, "__under": F.col("__cum") < F.col("__peak")})
        .withColumns(
            {
                "__burn_island": F.col("__i") - F.sum(F.col("__burn").cast("int")).over(run),
                "__under_island": F.col("__i") - F.sum(F.col("__under").cast("int")).over(run),
            }
        )
        .withColumns(
            {
                "__burn_run": F.sum(F.col("__burn").cast("int")).over(
                    Window.partitionBy(*by, "__burn_island")
                ),
                "__under_run": F.sum(F.col("__under").cast("int")).over(
                    Window.partitionBy(*by, "__under_island")
                ),
                "__tail": F.row_number().over(group.orderBy("value", "era"))
                <= F.greatest(F.floor(F.lit(q) * n), F.lit(1)),
            }
        )
    )
    value, raw = F.col("value"), F.col("raw")
    mean, worst = F.avg(value), F.max(F.col("__peak") - F.col("__cum"))
    raw_sd = F.stddev_pop(raw)
    return df.groupBy(*by).agg(
        F.count(value).alias("n_eras"),
        mean.alias("mean_payout"),
        annual_return(value).alias("cagr_1y"),
        gain_to_pain(value).alias("gain_to_pain_ratio"),
        kelly(raw).alias("kelly_fraction"),
        burn_rate(value).alias("burn_rate"),
        sortino(value).alias("sortino"),
        F.avg(F.when(F.col("__tail"), value)).alias("cvar5"),
        worst.alias("max_drawdown"),
        F.when(worst > 0.0, mean / F.when(worst > 0.0, worst))
        .when(mean > 0.0, float("inf"))
        .otherwise(0.0)
        .alias("calmar"),
        F.coalesce(F.max("__burn_run"), F.lit(0)).alias("max_burn_streak"),
        F.coalesce(F.max("__under_run"), F.lit(0)).alias("time_to_recovery"),
        F.count(raw).alias("n"),
        F.coalesce(ratio(F.avg(raw), raw_sd), F.lit(0.0)).alias("sharpe"),
        sample_skew(raw).alias("skew"),
        sample_kurtosis(raw).alias("kurt"),
    )

