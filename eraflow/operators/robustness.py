"""Robustness diagnostics: perturbed features, horizon and regime stability.

Perturbations are keyed by content (seed, era, id, feature), so they do not depend
on how the rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eraflow.functions.hashing import hash32, uniform
from eraflow.functions.ranks import group_shape
from eraflow.functions.stats import all_finite
from eraflow.operators import inference, scoring
from eraflow.operators.rows import bins_valid
from eraflow.operators.series import with_era_num
from eraflow.session import broadcast_checked, materialize

MAX_BIN = 4


def _check_share(share: float) -> None:
    if not 0.1 <= share <= 0.25:
        raise ValueError("the share must be within [0.1, 0.25]")


def _require_bins(df: DataFrame, features: Sequence[str]) -> None:
    row = bins_valid(df, features, MAX_BIN).first()
    bad = [f for f in features if not row[f]]
    if bad:
        raise ValueError(f"features must hold integer bins 0..{MAX_BIN}: {bad}")


def perturb_cells(df: DataFrame, features: Sequence[str], share: float, seed: int) -> DataFrame:
    """Move each cell one bin up or down with the given probability, within 0..4."""
    _check_share(share)
    moved = {}
    for f in features:
        hit = uniform(seed, "cell", F.col("era"), F.col("id"), f) < share
        step = F.when(hash32(seed, "step", F.col("era"), F.col("id"), f) % 2 == 0, 1).otherwise(-1)
        shifted = F.greatest(F.least(F.col(f) + step, F.lit(MAX_BIN)), F.lit(0))
        moved[f] = F.when(hit, shifted).otherwise(F.col(f)).cast("int")
    return df.withColumns(moved)


def changed_fraction(clean: DataFrame, perturbed: DataFrame, features: Sequence[str]) -> DataFrame:
    """Share of cells that really differ (a move at the edge changes nothing)."""
    renamed = perturbed.select("era", "id", *[F.col(f).alias(f"__p_{f}") for f in features])
    joined = clean.select("era", "id", *features).join(renamed, ["era", "id"])
    changed = F.lit(0)
    for f in features:
        changed = changed + (F.col(f) != F.col(f"__p_{f}")).cast("int")
    return joined.agg(
        (F.sum(changed) / (F.count(F.lit(1)) * len(features))).alias("effective_fraction"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def numbered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row numbers 0..n-1 in key order as ``donor``: one distributed sort, then numbers
    within each sorted part on top of the sizes of the parts before it."""
    parts = materialize(df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), "numbered")
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    out = parts.withColumn("__i", inside).join(broadcast_checked(starts), "__part")
    return out.withColumn("donor", F.col("__start") + F.col("__i") - 1).drop("__part", "__start", "__i")


def swap_blocks(
    df: DataFrame,
    train: DataFrame,
    blocks: Mapping[str, Sequence[str]],
    share: float,
    seed: int,
) -> DataFrame:
    """With the given probability per row and block, copy a whole feature block from a
    random train row. Donor numbers are uniform, so the join has no hot keys."""
    _check_share(share)
    if not blocks or any(not cols for cols in blocks.values()):
        raise ValueError("every block must contain at least one feature")
    n_train = train.count()
    if n_train < 1:
        raise ValueError("train must contain at least one row")
    used = sorted({f for cols in blocks.values() for f in cols})
    donors = numbered(train.select("era", "id", *used), ["era", "id"]).select("donor", F.struct(*used).alias("source"))
    hits = [
        F.when(
            uniform(seed, "block", F.col("era"), F.col("id"), name) < share,
            F.struct(
                F.lit(name).alias("block"),
                F.floor(uniform(seed, "donor", F.col("era"), F.col("id"), name) * n_train).cast("bigint").alias("donor"),
            ),
        )
        for name in blocks
    ]
    # one row per touched block, joined once with its donor, then back to one per row
    touched = df.select("era", "id", F.explode(F.array_compact(F.array(*hits))).alias("hit")).distinct()
    copied = (
        touched.select("era", "id", "hit.block", "hit.donor").join(donors, "donor").groupBy("era", "id")
        .agg(*[F.max(F.when(F.col("block") == name, F.col("source"))).alias(f"__s_{name}") for name in blocks])
    )
    owner = {c: name for name, cols in blocks.items() for c in cols}
    cells = {c: F.when(F.col(f"__s_{b}").isNotNull(), F.col(f"__s_{b}.{c}")).otherwise(F.col(c)) for c, b in owner.items()}
    return df.join(copied, ["era", "id"], "left").withColumns(cells).select(*df.columns)


def linear_score(weights: Mapping[str, float]) -> Callable[[DataFrame], DataFrame]:
    """Scorer of a linear model as one column expression."""

    def score(df: DataFrame) -> DataFrame:
        total: Column = F.lit(0.0)
        for f, w in weights.items():
            total = total + F.lit(float(w)) * F.col(f)
        return df.select("era", "id", total.alias("score"))

    return score


def matrix_score(
    predict: Callable[[np.ndarray], np.ndarray], features: Sequence[str]
) -> Callable[[DataFrame], DataFrame]:
    """Scorer of any function from a feature matrix to a vector, in Arrow batches."""
    features = list(features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = np.asarray(predict(batch[features].to_numpy(dtype=float)), dtype=float)
            if values.shape != (len(batch),) or not np.isfinite(values).all():
                raise ValueError("the scorer must return one finite number per row")
            yield pd.DataFrame({"era": batch["era"], "id": batch["id"], "score": values})

    return lambda df: df.select("era", "id", *features).mapInPandas(
        run, "era string, id string, score double"
    )


def adversarial_perturbation(
    evaluation: DataFrame,
    train: DataFrame,
    scorer: Callable[[DataFrame], DataFrame],
    features: Sequence[str],
    blocks: Mapping[str, Sequence[str]],
    share: float = 0.1,
    seed: int = 0,
) -> DataFrame:
    """Mean per-era rank correlation between scores on clean rows and on rows with
    independent (ceiling) and block (manifold) perturbations; the gap between them."""
    _check_share(share)
    rows = evaluation.select("era", "id", *features)
    _require_bins(rows, features)
    _require_bins(train, features)
    cells = perturb_cells(rows, features, share, seed)
    swapped = swap_blocks(rows, train, blocks, share, seed)
    scored = (
        scorer(rows).withColumnRenamed("score", "clean")
        .join(scorer(cells).withColumnRenamed("score", "independent"), ["era", "id"])
        .join(scorer(swapped).withColumnRenamed("score", "block"), ["era", "id"])
    )
    both = scored.select(
        "era", "clean",
        F.explode(
            F.array(
                F.struct(F.lit("ceiling").alias("kind"), F.col("independent").alias("other")),
                F.struct(F.lit("manifold").alias("kind"), F.col("block").alias("other")),
            )
        ).alias("c"),
    ).select("era", "clean", "c.*")
    series = scoring.per_era_spearman(both, "clean", "other", ["kind", "era"])
    ceiling = F.avg(F.when(F.col("kind") == "ceiling", F.col("value")))
    manifold = F.avg(F.when(F.col("kind") == "manifold", F.col("value")))
    means = series.agg(
        F.count_if(F.col("kind") == "ceiling").alias("n_eras"),
        ceiling.alias("ceiling_stability"),
        manifold.alias("manifold_stability"),
        (ceiling - manifold).alias("gap"),
    )
    fraction = changed_fraction(rows, cells, features).select("effective_fraction").scalar()
    return means.withColumn("effective_fraction", fraction)


def horizon_stability(
    df: DataFrame,
    pred: str,
    benchmark: str,
    target_20: str,
    target_60: str,
    by: Sequence[str] = (),
    min_overlap_eras: int = scoring.MIN_OVERLAP_ERAS,
) -> DataFrame:
    """Drop of the adjusted score ratio from the short to the long horizon, for the
    model, the benchmark, and their difference. An era counts only if all four
    prediction/target pairs have at least two complete rows."""
    by = list(by)
    pairs = [("model", pred, target_20, "20D"), ("model", pred, target_60, "60D"),
             ("bench", benchmark, target_20, "20D"), ("bench", benchmark, target_60, "60D")]
    enough = [F.count_if(all_finite([p, t])) >= 2 for _, p, t, _ in pairs]
    resolved = df.groupBy(*by, "era").agg(
        (enough[0] & enough[1] & enough[2] & enough[3]).alias("ok")
    ).where("ok").drop("ok")
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(side).alias("side"), F.lit(h).alias("horizon"),
                    F.col(p).cast("double").alias("p"), F.col(t).cast("double").alias("t"),
                )
                for side, p, t, h in pairs
            ]
        )
    ).alias("c")
    long = df.select(*by, "era", cells).select(*by, "era", "c.*")
    keys = [*by, "side", "horizon"]
    groups, largest = group_shape(df, [*by, "era"])
    series = scoring.per_era_corr(long, "p", "t", [*keys, "era"], (4 * groups, largest))
    return horizon_ratios(series.join(resolved, [*by, "era"]), by, min_overlap_eras)


def horizon_ratios(series: DataFrame, by: Sequence[str], min_overlap_eras: int = scoring.MIN_OVERLAP_ERAS) -> DataFrame:
    """:func:`horizon_stability` from the scores of the eras that count: (by, side, horizon,
    era, value)."""
    keys = [*by, "side", "horizon"]
    series = with_era_num(series)
    ratios = inference.ac_adjusted_sharpe(series.where("horizon = '20D'"), keys, "20D").unionByName(
        inference.ac_adjusted_sharpe(series.where("horizon = '60D'"), keys, "60D")
    )

    def pick(side: str, horizon: str) -> Column:
        chosen = (F.col("side") == side) & (F.col("horizon") == horizon)
        return F.max(F.when(chosen, F.col("ac_sharpe")))

    table = ratios.groupBy(*by).agg(
        F.min("n").alias("n_eras"),
        pick("model", "20D").alias("model_sharpe_20"), pick("model", "60D").alias("model_sharpe_60"),
        pick("bench", "20D").alias("bench_sharpe_20"), pick("bench", "60D").alias("bench_sharpe_60"),
    ).where(F.col("n_eras") >= min_overlap_eras)
    return table.withColumn("model_decay", F.col("model_sharpe_20") - F.col("model_sharpe_60")).withColumn(
        "benchmark_decay", F.col("bench_sharpe_20") - F.col("bench_sharpe_60")
    ).withColumn("relative_divergence", F.col("model_decay") - F.col("benchmark_decay"))


def regime_corr(
    series: DataFrame,
    labels: DataFrame,
    by: Sequence[str] = (),
    horizon: str = "20D",
    min_eras: int | None = scoring.MIN_OVERLAP_ERAS,
    strict: bool = True,
    **options,
) -> DataFrame:
    """Mean score and bootstrap interval per regime. Labels are one row per era. A regime
    with too few eras fails, as its interval would mean nothing; with ``strict`` off it
    keeps a row with its number of eras and NULL scores. Without ``min_eras`` every regime
    keeps its scores: one shorter than the block floor is resampled as one block."""
    from eraflow.operators.rows import with_labels

    labelled = with_labels(with_era_num(series), labels.select("era", "regime"))
    if min_eras is None:
        out = inference.mean_interval(labelled, [*by, "regime"], horizon, short="one_block", least=1, **options)
        return out.select(*by, "regime", F.col("n").alias("n_eras"), F.col("point").alias("mean_corr"), "ci_low", "ci_high")
    out = inference.mean_interval(labelled, [*by, "regime"], horizon, short="error" if strict else "null", **options)
    if not strict:
        known = F.col("n") >= min_eras
        cells = {"point": "mean_corr", "ci_low": "ci_low", "ci_high": "ci_high"}
        return out.select(
            *by, "regime", F.col("n").alias("n_eras"), *[F.when(known, F.col(c)).alias(name) for c, name in cells.items()]
        )
    checked = F.when(F.col("n") >= min_eras, F.col("n")).otherwise(
        F.raise_error(F.lit(f"a regime has fewer than {min_eras} eras")).cast("int")
    )
    return out.select(
        *by, "regime", checked.alias("n_eras"), F.col("point").alias("mean_corr"), "ci_low", "ci_high"
    )


