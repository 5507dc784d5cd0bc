"""Inference on score series: block bootstrap, autocorrelation-adjusted ratio,
deflated ratio, false-discovery control.

A series (one model's metric, one feature's IC) has at most one value per era, so a
whole series fits one row. Resampling is vectorized inside a task, one series at a
time; the cluster works on many series at once. Block starts come from md5 of
(seed, replicate, block), so results do not depend on the layout and another engine
can recompute them. The mean uses circular prefix sums: a replicate costs one
addition per block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache
from hashlib import md5
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eraflow.functions.stats import (
    EULER_GAMMA,
    is_finite,
    norm_cdf,
    ratio,
    with_norm_ppf,
)
from eraflow.operators.series import with_era_num

BLOCK_FLOOR = {"20D": 5, "60D": 13}
BANDWIDTH_FLOOR = {"20D": 4, "60D": 12}
BOOT_TYPE = "point double, ci_low double, ci_high double, p_value double, n_valid bigint"


def block_length(n: Column, horizon: str) -> Column:
    """Cube root of n rounded half to even, at least the horizon's floor, at most n."""
    root = F.bround(F.pow(n.cast("double"), F.lit(1.0 / 3.0)), 0).cast("int")
    return F.least(F.greatest(root, F.lit(BLOCK_FLOOR[horizon])), n.cast("int"))


def bandwidth(n: Column, horizon: str) -> Column:
    base = F.floor(F.lit(4.0) * F.pow(n / F.lit(100.0), F.lit(2.0 / 9.0))).cast("int")
    return F.least(
        F.greatest(base, F.lit(BANDWIDTH_FLOOR[horizon])), (n - 1).cast("int")
    )


def horizon_of(target: Column) -> Column:
    return F.when(target.endswith("_60"), F.lit("60D")).otherwise(F.lit("20D"))


def packed_series(series: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """One row per series: its finite values in era order. Bounded by the eras."""
    rows = with_era_num(series).where(is_finite(value))
    return rows.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("era_num", F.col(value).alias("v"))))
        .getField("v")
        .alias("values")
    )


@lru_cache(maxsize=8)
def _start_hashes(seed: int, n_boot: int, n_blocks: int) -> np.ndarray:
    out = np.empty((n_boot, n_blocks), dtype=np.int64)
    for b in range(n_boot):
        for j in range(n_blocks):
            out[b, j] = int(md5(f"{seed}|{b}|{j}".encode()).hexdigest()[:8], 16)
    return out


def _replicate_means(x: np.ndarray, block: int, seed: int, n_boot: int) -> np.ndarray:
    n = x.size
    n_blocks = ceil(n / block)
    starts = _start_hashes(seed, n_boot, n_blocks) % n
    prefix = np.concatenate([[0.0], np.cumsum(np.concatenate([x, x]))])
    lengths = np.full(n_blocks, block)
    lengths[-1] = n - block * (n_blocks - 1)
    return (prefix[starts + lengths] - prefix[starts]).sum(axis=1) / n


def _resamples(x: np.ndarray, block: int, seed: int, n_boot: int) -> np.ndarray:
    n = x.size
    n_blocks = ceil(n / block)
    starts = _start_hashes(seed, n_boot, n_blocks) % n
    index = (starts[:, :, None] + np.arange(block)) % n
    return x[index.reshape(n_boot, -1)[:, :n]]


def _adjusted_ratio(samples: np.ndarray, lags: int) -> np.ndarray:
    """Mean over deviation with Bartlett-weighted autocorrelation, per sample row."""
    mean = samples.mean(axis=1, keepdims=True)
    centred = samples - mean
    energy = (centred**2).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        total = np.ones(len(samples))
        for k in range(1, lags + 1):
            rho = (centred[:, :-k] * centred[:, k:]).sum(axis=1) / energy
            total = total + 2.0 * (1.0 - k / (lags + 1.0)) * rho
        value = mean[:, 0] / samples.std(axis=1) / np.sqrt(np.maximum(total, 1e-12))
    return np.where(energy == 0.0, 0.0, value)


def block_bootstrap(
    packed: DataFrame,
    *,
    block: Column,
    statistic: str | Callable[[np.ndarray], np.ndarray] = "mean",
    lags: Column | None = None,
    n_boot: int = 1000,
    seed: int = 0,
    alpha: float = 0.05,
    out: str = "boot",
    least: int = 2,
) -> DataFrame:
    """Circular block bootstrap of each packed series: point, percentile interval and
    (for the mean) the two-sided p-value against a zero mean.

    ``statistic`` is "mean", "ac_sharpe" (needs ``lags``) or a function from a matrix
    of resampled rows to one number per row. An interval needs at least half of the
    replicates finite; fewer than ``least`` values give NULLs and a p-value of NULL.
    """
    name = statistic if isinstance(statistic, str) else "custom"

    def one(values: np.ndarray, size: int, n_lags: int) -> tuple:
        x = np.asarray(values, dtype=float)
        if x.size < least or not 1 <= size <= x.size:
            return (None, None, None, None, 0)
        p_value = None
        if name == "mean":
            point = float(x.mean())
            thetas = _replicate_means(x, size, seed, n_boot)
            if x.std() < 1e-12 or point == 0.0:
                p_value = 1.0
            else:
                # replicates that equal the observed mean up to rounding count as extreme
                extreme = np.abs(thetas - point) >= abs(point) - 1e-12
                p_value = (1.0 + int(extreme.sum())) / (1.0 + n_boot)
        else:
            fn = (lambda m: _adjusted_ratio(m, n_lags)) if name == "ac_sharpe" else statistic
            point = float(fn(x[None, :])[0])
            thetas = np.asarray(fn(_resamples(x, size, seed, n_boot)), dtype=float)
        valid = thetas[np.isfinite(thetas)]
        if valid.size < 0.5 * n_boot:
            raise ValueError("insufficient valid bootstrap replicates")
        low, high = np.percentile(valid, [100 * alpha / 2, 100 * (1 - alpha / 2)])
        return (point, float(low), float(high), p_value, int(valid.size))

    @F.pandas_udf(BOOT_TYPE)
    def resample(values: pd.Series, sizes: pd.Series, all_lags: pd.Series) -> pd.DataFrame:
        rows = [one(v, int(s), int(k)) for v, s, k in zip(values, sizes, all_lags)]
        return pd.DataFrame(rows, columns=["point", "ci_low", "ci_high", "p_value", "n_valid"])

    lag_column = lags if lags is not None else F.lit(0)
    return packed.withColumn(
        out, resample(F.col("values"), block.cast("int"), lag_column.cast("int"))
    )


def mean_interval(
    series: DataFrame,
    by: Sequence[str],
    horizon: str | Column = "20D",
    *,
    short: str = "error",
    **options,
) -> DataFrame:
    """(by, n, point, ci_low, ci_high, p_value) of the series mean.

    ``horizon`` is a fixed name or a column of ``by``-constant names. A series shorter
    than the horizon's block floor fails ("error"), gets NULLs ("null"), or uses one
    block of full length ("one_block"), whose replicates are all equal.
    """
    if short not in ("error", "null", "one_block"):
        raise ValueError(f"unknown rule for short series: {short!r}")
    packed = packed_series(series, by).withColumn("n", F.size("values"))
    if isinstance(horizon, str):
        size, floor = block_length(F.col("n"), horizon), F.lit(BLOCK_FLOOR[horizon])
    else:
        long = horizon == "60D"
        size = F.when(long, block_length(F.col("n"), "60D")).otherwise(
            block_length(F.col("n"), "20D")
        )
        floor = F.when(long, BLOCK_FLOOR["60D"]).otherwise(BLOCK_FLOOR["20D"])
    if short != "one_block":
        too_short = F.raise_error(F.lit("series is shorter than its block floor")).cast("int") if short == "error" else F.lit(0)
        size = F.when(F.col("n") >= floor, size).otherwise(too_short)
    packed = packed.withColumn("block", size)
    done = block_bootstrap(packed, block=F.col("block"), **options)
    return done.select(
        *by, "n", "block", "boot.point", "boot.ci_low", "boot.ci_high", "boot.p_value"
    )


def ac_sharpe_interval(
    series: DataFrame, by: Sequence[str], horizon: str = "20D", **options
) -> DataFrame:
    """Interval of the adjusted ratio; NULLs for a series shorter than the block floor."""
    packed = packed_series(series, by).withColumn("n", F.size("values"))
    done = block_bootstrap(
        packed,
        block=F.when(F.col("n") >= BLOCK_FLOOR[horizon], block_length(F.col("n"), horizon)).otherwise(0),
        statistic="ac_sharpe",
        lags=bandwidth(F.col("n"), horizon),
        **options,
    )
    return done.select(*by, "n", "boot.point", "boot.ci_low", "boot.ci_high")


def benjamini_hochberg(
    df: DataFrame, p: str = "p_value", by: Sequence[str] = (), order: Sequence[str] = ()
) -> DataFrame:
    """Step-up q-values within ``by``; a missing or non-finite p counts as 1. The
    groups are one row per tested feature."""
    known = F.when(is_finite(p), F.col(p)).otherwise(F.lit(1.0))
    group = Window.partitionBy(*by)
    ascending = group.orderBy("__p", *order)
    descending = group.orderBy(F.desc("__position")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        df.withColumn("__p", known)
        .withColumn("__position", F.row_number().over(ascending))
        .withColumn(
            "__raw", F.col("__p") * F.count(F.lit(1)).over(group) / F.col("__position")
        )
        .withColumn("fdr_q", F.least(F.min("__raw").over(descending), F.lit(1.0)))
        .drop("__p", "__position", "__raw")
    )


def ac_adjusted_sharpe(series: DataFrame, by: Sequence[str] = (), horizon: str = "20D") -> DataFrame:
    """Mean over deviation, divided by the root of the Bartlett-weighted sum of
    autocorrelations up to the horizon's bandwidth. Lagged products come from a
    bounded number of lags over each (era-long) series."""
    packed = packed_series(series, by).withColumn("n", F.size("values"))
    packed = packed.withColumn("lags", bandwidth(F.col("n"), horizon))

    def plus(t: Column, x: Column) -> Column:
        return t + x

    mean = F.aggregate("values", F.lit(0.0), plus) / F.col("n")
    packed = packed.withColumn("mean", mean).withColumn(
        "c", F.transform("values", lambda v: v - F.col("mean"))
    )
    packed = packed.withColumn(
        "energy", F.aggregate(F.transform("c", lambda v: v * v), F.lit(0.0), plus)
    )

    def lagged(k: Column) -> Column:
        count = F.col("n") - k
        products = F.zip_with(
            F.slice(F.col("c"), F.lit(1), count),
            F.slice(F.col("c"), k + 1, count),
            lambda a, b: a * b,
        )
        return (F.lit(1.0) - k / (F.col("lags") + 1.0)) * F.aggregate(products, F.lit(0.0), plus)

    weighted = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.col("lags")), lagged), F.lit(0.0), plus
    )
    spread = F.sqrt(F.col("energy") / F.col("n"))
    adjustment = F.greatest(
        F.lit(1.0) + 2.0 * ratio(weighted, F.col("energy")), F.lit(1e-12)
    )
    value = F.coalesce(ratio(F.col("mean"), spread) / F.sqrt(adjustment), F.lit(0.0))
    return packed.select(*by, "n", value.alias("ac_sharpe"))


def with_deflated_sharpe(
    df: DataFrame,
    n_trials: Column,
    trials_variance: Column | None = None,
    baseline: float = 0.0,
    out: str = "dsr",
) -> DataFrame:
    """Add the probability that a ratio (columns sharpe, skew, kurt, n) beats the best
    of ``n_trials`` lucky ones; NULL where its variance term is not positive. With a
    single trial the hurdle is the baseline alone."""
    hurdle = F.lit(float(baseline))
    if trials_variance is not None:
        trials = F.greatest(n_trials, F.lit(2)).cast("double")
        df = df.withColumns(
            {
                "__p1": F.lit(1.0) - F.lit(1.0) / trials,
                "__p2": F.lit(1.0) - F.lit(1.0) / (trials * F.exp(F.lit(1.0))),
            }
        )
        df = with_norm_ppf(df, {"__z1": "__p1", "__z2": "__p2"})
        best = F.lit(1.0 - EULER_GAMMA) * F.col("__z1") + F.lit(EULER_GAMMA) * F.col("__z2")
        hurdle = hurdle + F.when(n_trials == 1, 0.0).otherwise(F.sqrt(trials_variance) * best)
    sharpe = F.col("sharpe")
    df = df.withColumn(
        "__inner", 1.0 - F.col("skew") * sharpe + (F.col("kurt") - 1.0) / 4.0 * sharpe * sharpe
    )
    z = (sharpe - hurdle) * F.sqrt((F.col("n") - 1).cast("double")) / F.sqrt(
        F.when(F.col("__inner") > 0.0, F.col("__inner"))
    )
    return (
        df.withColumn("__z", z)
        .withColumn(out, norm_cdf("__z"))
        .drop("__p1", "__p2", "__z1", "__z2", "__inner", "__z")
    )


def deflated_sharpe_fleet(
    trials: DataFrame, by: Sequence[str] = (), baseline: float = 0.0
) -> DataFrame:
    """Deflate each trial (columns sharpe, skew, kurt, n) against the spread of all
    trials of its fleet; ``reason`` says why a value is missing."""
    facts = [F.count(F.lit(1)).alias("n_trials"), F.var_samp("sharpe").alias("trials_variance")]
    if by:
        joined = trials.join(trials.groupBy(*by).agg(*facts), list(by))
    else:
        fleet = trials.agg(F.struct(*facts).alias("fleet")).scalar()
        joined = trials.withColumn("__fleet", fleet).select("*", "__fleet.*").drop("__fleet")
    few = F.col("n_trials") < 2
    flat = F.sqrt(F.col("trials_variance")) < 1e-12
    deflated = with_deflated_sharpe(
        joined, F.col("n_trials"), F.col("trials_variance"), baseline, "__dsr"
    )
    return (
        deflated.withColumn(
            "reason",
            F.when(few, "insufficient_trials")
            .when(flat, "zero_cross_trial_sharpe_variance")
            .when(F.col("__dsr").isNull(), "radicand")
            .otherwise(""),
        )
        .withColumn("dsr", F.when(F.col("reason") == "", F.col("__dsr")))
        .drop("__dsr")
    )


def attach_deflation(trials: DataFrame, key: Sequence[str]) -> DataFrame:
    """Deflate the trials whose inputs are all finite and join the result back; the
    others keep a reason."""
    inputs = is_finite("sharpe") & is_finite("skew") & is_finite("kurt")
    valid = trials.where(inputs & (F.col("n") >= 2))
    deflated = deflated_sharpe_fleet(valid).select(*key, "dsr", "reason")
    return trials.join(deflated, list(key), "left").withColumn(
        "reason", F.coalesce("reason", F.lit("invalid_trial"))
    )


def paired_comparison(
    a: DataFrame,
    b: DataFrame,
    by: Sequence[str] = (),
    *,
    horizon: str = "20D",
    min_overlap_eras: int = 20,
    device_a: str | None = None,
    device_b: str | None = None,
    **options,
) -> DataFrame:
    """Mean per-era difference of two score series with a block-bootstrap interval.
    Pairs with too few shared eras fail rather than report noise."""
    left = with_era_num(a).select(*by, "era_num", F.col("value").alias("a"))
    right = with_era_num(b).select(*by, "era_num", F.col("value").alias("b"))
    diffs = left.join(right, [*by, "era_num"]).select(
        *by, "era_num", F.col("era_num").cast("string").alias("era"),
        (F.col("a") - F.col("b")).alias("value"),
    )
    out = mean_interval(diffs, by, horizon, **options)
    enough = F.when(F.col("n") >= min_overlap_eras, F.col("n")).otherwise(
        F.raise_error(F.lit(f"fewer than {min_overlap_eras} shared eras")).cast("int")
    )
    mismatch = device_a is not None and device_b is not None and device_a != device_b
    return out.select(
        *by, F.col("point").alias("mean_diff"), "ci_low", "ci_high",
        enough.alias("n_eras"), F.lit(mismatch).alias("device_mismatch"), "block",
    )
