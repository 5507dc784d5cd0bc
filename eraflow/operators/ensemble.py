"""Rank-domain blending, weight learning and diversification of prediction columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eraflow.functions.ranks import group_shape, with_rank_gauss, with_ranks, with_unit_variance
from eraflow.functions.stats import all_finite, none_null, ratio
from eraflow.operators import scoring

RIDGE_ALPHA = 1.0


def rank_normalize(
    df: DataFrame, preds: Sequence[str], by: Sequence[str] = ("era",)
) -> DataFrame:
    """Replace each prediction by its normal score with unit variance per era."""
    shape = group_shape(df, by)
    scored = with_rank_gauss(df, by, {f"__z_{p}": p for p in preds}, shape=shape)
    unit = with_unit_variance(scored, by, [f"__z_{p}" for p in preds], shape=shape)
    kept = unit.withColumns({p: F.col(f"__z_{p}") for p in preds})
    return kept.drop("__n", *[f"__z_{p}" for p in preds])


def blend(
    df: DataFrame,
    preds: Sequence[str],
    weights: Sequence[float] | None = None,
    out: str = "prediction",
    by: Sequence[str] = ("era",),
) -> DataFrame:
    """Normal score of the weighted sum of rank-normalized predictions (equal weights
    unless given)."""
    weights = [1.0 / len(preds)] * len(preds) if weights is None else [float(w) for w in weights]
    if len(weights) != len(preds) or not np.isfinite(weights).all():
        raise ValueError("one finite weight per prediction is required")
    normalized = rank_normalize(df, preds, by)
    total = F.lit(0.0)
    for p, w in zip(preds, weights):
        total = total + F.lit(w) * F.col(p)
    # sums that differ by less than rounding noise are ties
    summed = normalized.withColumn("__sum", F.round(total, 12))
    scored = with_rank_gauss(summed, by, {"__blend": "__sum"}, shape=group_shape(df, by))
    return scored.withColumn(out, F.col("__blend")).drop("__sum", "__blend", "__n")


def percentile_ensemble(
    df: DataFrame, preds: Sequence[str], out: str = "prediction", by: Sequence[str] = ("era",)
) -> DataFrame:
    """Percentile rank (rank / n) of the sum of percentile ranks."""
    shape = group_shape(df, by)
    ranked = with_ranks(df, by, {f"__r_{p}": p for p in preds}, count_as="__n", shape=shape)
    total = F.lit(0.0)
    for p in preds:
        total = total + F.col(f"__r_{p}") / F.col("__n")
    summed = ranked.withColumn("__sum", F.round(total, 12))
    final = with_ranks(summed, by, {"__r": "__sum"}, shape=shape)
    return final.withColumn(out, F.col("__r") / F.col("__n")).drop(
        "__r", "__sum", "__n", *[f"__r_{p}" for p in preds]
    )


def gram(df: DataFrame, columns: Sequence[str], target: str) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of the columns with each other and with the target: one
    aggregation over all rows; only k x k sums come back."""
    cells, names = [], []
    for i, a in enumerate(columns):
        for j in range(i, len(columns)):
            cells.append(F.sum(F.col(a) * F.col(columns[j])).alias(f"g_{i}_{j}"))
            names.append((i, j))
        cells.append(F.sum(F.col(a) * F.col(target)).alias(f"r_{i}"))
    row = df.agg(*cells).first()
    k = len(columns)
    matrix, rhs = np.zeros((k, k)), np.zeros(k)
    for i, j in names:
        matrix[i, j] = matrix[j, i] = row[f"g_{i}_{j}"]
    for i in range(k):
        rhs[i] = row[f"r_{i}"]
    return matrix, rhs


def non_negative_solution(matrix: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Least squares under w >= 0 from the normal equations (active-set method)."""
    k = len(rhs)
    weights, active = np.zeros(k), np.zeros(k, dtype=bool)
    tolerance = 1e-10 * max(1.0, float(np.abs(rhs).max()))
    for _ in range(10 * k + 10):
        slope = rhs - matrix @ weights
        slope[active] = -np.inf
        if slope.max() <= tolerance:
            break
        active[int(slope.argmax())] = True
        while True:
            trial = np.zeros(k)
            trial[active] = np.linalg.lstsq(matrix[np.ix_(active, active)], rhs[active], rcond=None)[0]
            if (trial[active] > 0).all():
                break
            down = active & (trial <= 0)
            step = (weights[down] / (weights[down] - trial[down])).min()
            weights = weights + step * (trial - weights)
            active &= weights > tolerance * 1e-6
            weights[~active] = 0.0
        weights = trial
    return weights


def learn_weights(
    df: DataFrame,
    preds: Sequence[str],
    target: str,
    method: str = "ridge",
    by: Sequence[str] = ("era",),
) -> list[float]:
    """Blend weights from out-of-fold predictions: ridge without intercept, or
    non-negative least squares, on rank-normalized columns."""
    rows = df.select(*by, *preds, target).where(none_null([*preds, target]))
    usable = rank_normalize(rows, preds, by).where(all_finite([*preds, target]))
    if method == "equal":
        raise ValueError("equal weights are not learned")
    return solved_weights(*gram(usable, preds, target), method)


def solved_weights(matrix: np.ndarray, rhs: np.ndarray, method: str) -> list[float]:
    """Blend weights from the Gram matrix of the columns and their products with the target."""
    if method == "ridge":
        weights = np.linalg.solve(matrix + RIDGE_ALPHA * np.eye(len(rhs)), rhs)
    elif method == "non_negative":
        weights = non_negative_solution(matrix, rhs)
    elif method == "equal":
        weights = np.full(len(rhs), 1.0 / len(rhs))
    else:
        raise ValueError("method must be 'ridge' or 'non_negative'")
    return [float(w) for w in weights]


def decorrelation_sweep(
    df: DataFrame,
    candidates: Sequence[str],
    benchmark: str,
    target: str,
    grid: Sequence[float],
) -> DataFrame:
    """Mean per-era correlation with the target after taking a share of the ranked
    benchmark out of each candidate and ranking the rest. Rows are joined by key; the
    shares multiply rows by a fixed small factor, and every share scores at once."""
    base = df.select("era", "id", *candidates, benchmark, target).where(
        all_finite([*candidates, benchmark])
    )
    ranked = rank_normalize(base, [benchmark])
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("candidate"),
                    F.lit(float(g)).alias("share"),
                    F.round(F.col(c) - F.lit(float(g)) * F.col(benchmark), 12).alias("x"),
                )
                for c in candidates
                for g in grid
            ]
        )
    )
    long = ranked.select("era", F.col(target).cast("double").alias("t"), cells.alias("s")).select(
        "era", "t", "s.*"
    )
    by = ["candidate", "share", "era"]
    scored = rank_normalize(long, ["x"], by)
    series = scoring.per_era_pearson(scored, "x", "t", by)
    return series.groupBy("candidate", "share").agg(
        F.avg("value").alias("score"), F.count("value").alias("n_eras")
    )


def best_candidate(sweep: DataFrame) -> DataFrame:
    order = F.struct("score", F.negative(F.col("share")).alias("s"))
    return sweep.agg(
        F.max_by("candidate", order).alias("candidate"),
        F.max_by("share", order).alias("share"),
        F.max("score").alias("score"),
    )


def similarity(df: DataFrame, models: Sequence[str], stress: DataFrame | None = None) -> DataFrame:
    """Pooled correlation of the rank-normalized predictions of every model pair, over
    rows all models share; with a table of ``stress`` eras also inside and outside of
    them. Every task folds its rows into sums per era and pair, so neither rows nor
    their pairs are shuffled."""
    from eraflow.operators.correlation import pair_moments

    rows = df.where(all_finite(list(models)))
    scored = rank_normalize(rows.select("era", *models), models)
    sums = pair_moments(scored.select("era", F.array(*models).alias("z")))
    if stress is None:
        sums = sums.withColumn("stress", F.lit(False))
    else:
        marks = stress.select("era").distinct().withColumn("stress", F.lit(True))
        sums = sums.join(marks, "era", "left").withColumn(
            "stress", F.coalesce("stress", F.lit(False))
        )

    def pooled(condition: Column) -> Column:
        n, sa, sb, saa, sbb, sab = (
            F.sum(F.when(condition, F.col(c)).otherwise(0.0)) for c in ("n", "sa", "sb", "saa", "sbb", "sab")
        )
        rows_in = F.when(n > 0, n)
        spread = (saa - sa * sa / rows_in) * (sbb - sb * sb / rows_in)
        value = ratio(sab - sa * sb / rows_in, F.sqrt(F.greatest(spread, F.lit(0.0))))
        clipped = F.greatest(F.least(value, F.lit(1.0)), F.lit(-1.0))
        return F.coalesce(F.when(spread > 1e-12, clipped), F.lit(0.0))

    labels = F.array(*[F.lit(m) for m in models])
    pairs = sums.groupBy("a", "b").agg(
        pooled(F.lit(True)).alias("corr"),
        pooled(F.col("stress")).alias("stress_corr"),
        pooled(~F.col("stress")).alias("normal_corr"),
        F.sum(F.when(F.col("stress"), F.col("n")).otherwise(0.0)).cast("bigint").alias("n_stress_rows"),
    )
    return pairs.withColumns({"a": F.get(labels, F.col("a")), "b": F.get(labels, F.col("b"))})


def diversification(pairs: DataFrame) -> DataFrame:
    """Mean and largest overlap with a tier label, and the change under stress (needs
    five stressed rows)."""
    mean = F.avg("corr")
    return pairs.agg(
        mean.alias("mean_overlap"),
        F.max("corr").alias("max_overlap"),
        F.count(F.lit(1)).alias("n_pairs"),
        F.when(
            F.min("n_stress_rows") >= 5, F.avg("stress_corr") - F.avg("normal_corr")
        ).alias("stress_delta"),
    ).withColumn(
        "badge",
        F.when(F.col("mean_overlap") < 0.65, "EXCELLENT DIVERSIFICATION")
        .when(F.col("mean_overlap") <= 0.85, "MODERATE OVERLAP")
        .otherwise("HIGH REDUNDANCY"),
    )


def blended_sharpe(series: DataFrame, name: str = "model_id") -> DataFrame:
    """Mean over sample deviation of the equal-weight mean of the series, on shared eras;
    NULL with fewer than three series."""
    n = series.select(name).distinct().count()
    mean = (
        series.groupBy("era").agg(F.avg("value").alias("m"), F.count("value").alias("c"))
        .where(F.col("c") == n)
    )
    return mean.agg(
        F.when(F.lit(n >= 3), ratio(F.avg("m"), F.stddev_samp("m"))).alias("blended_sharpe"),
        F.count("m").alias("n_eras"),
    )
