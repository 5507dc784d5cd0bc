"""Full evaluation of many models at once: one scorecard row per model.

All models share one base. An era's features meet its models in one task, which gives every
per-era score in one pass; eras too large for a task take a pass per metric. What
follows works on the small (model, metric, era) table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eraflow.functions import groups
from eraflow.functions.stats import all_finite, is_finite
from eraflow.operators import inference, normal, robustness, scoring, series
from eraflow.session import materialize

BY = ["model_id"]
KEYS = ["model_id", "era"]
CELLS = ("mean_payout", "corr", "mmc", "bmc", "cwmm", "corr_sharpe_ac")


def evaluation_rows(
    predictions: DataFrame, meta: DataFrame, targets: DataFrame, features: DataFrame,
    benchmarks: DataFrame | None = None,
) -> DataFrame:
    """(model_id, era, id, prediction) joined with everything scoring needs; only rows
    present on all sides, except that the benchmark may be missing."""
    keys = ["era", "id"]
    base = predictions.join(meta, keys).join(targets, keys).join(features, keys)
    return base if benchmarks is None else base.join(benchmarks, keys, "left")


def per_era_scores(
    base: DataFrame, target: str, meta: str, features: Sequence[str], benchmark: str | None, feature_rows: DataFrame
) -> DataFrame:
    """(model_id, metric, era, era_num, value) for every per-era metric; ``feature_rows``
    has target and features once per (era, id)."""
    if scoring.all_rows_finite(base, ["prediction", meta, target]):
        core = scoring.core_scores(base, "prediction", meta, target, KEYS)
        names = ("corr", "meta_corr", "mmc", "cwmm")
        cells = F.explode(
            F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])
        ).alias("c")
        out = core.select(*KEYS, cells).select("model_id", "c.metric", "era", "c.value")
        parts = {}
    else:
        out = None
        parts = {
            "corr": scoring.per_era_corr(base, "prediction", target, KEYS),
            "mmc": scoring.per_era_mmc(base, "prediction", meta, target, KEYS),
            "meta_corr": scoring.per_era_corr(base, meta, target, KEYS),
            "cwmm": scoring.per_era_cwmm(base, "prediction", meta, KEYS, 0),
        }
    parts["fnc"] = scoring.per_era_fnc_models(base, feature_rows, features, target)
    if benchmark is not None:
        parts["bmc"] = scoring.per_era_bmc(base, "prediction", benchmark, target, KEYS, 0)
    for metric, df in parts.items():
        part = df.select("model_id", F.lit(metric).alias("metric"), "era", "value")
        out = part if out is None else out.unionByName(part)
    return series.with_era_num(out)


def scores_in_tasks(
    base: DataFrame, target: str, meta: str, benchmark: str | None, horizon_pair: tuple[str, str] | None,
    features: DataFrame, dealt: tuple[list, int],
) -> DataFrame:
    """(model_id, era, one column per score): every score of every model in one pass, an
    era's rows beside its models (``scoring.card_scores``); ``features`` has era, id, t, x."""
    sources = {"p": "prediction", "m": meta, "y": target}
    if benchmark is not None:
        sources["b"] = benchmark
        if horizon_pair is not None:
            sources |= {"short": horizon_pair[0], "long": horizon_pair[1]}
    # a column that has two parts is sent once
    first = {source: name for name, source in reversed(sources.items())}
    work = base.select("model_id", "era", "id", *[F.col(source).cast("double").alias(name) for source, name in first.items()])

    def scores(models: list, t: np.ndarray, x: np.ndarray) -> list[dict]:
        sets = [({n: columns[first[source]] for n, source in sources.items()}, place) for columns, place in models]
        return scoring.card_scores(sets, t, x)

    return groups.by_models(work, features, list(first.values()), "model_id", dealt, scores, scoring.CARD_TYPES)


def _long(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """(model_id, metric, era, value) of the scores that there are."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("c")
    return wide.select("model_id", "era", cells).select("model_id", "c.metric", "era", "c.value").where("value is not null")


def max_exposure(predictions: DataFrame, feature_rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """The largest size of a correlation of a model's predictions with a feature in an era.
    Predictions are put together per row, and one scan folds their products with the
    features (``normal.era_moments``), whatever the number of models."""
    models = sorted(r["model_id"] for r in predictions.select("model_id").distinct().collect())
    names = [f"__m{i}" for i in range(len(models))]
    told = F.map_from_entries(F.collect_list(F.struct("model_id", F.col("prediction").cast("double").alias("p"))))
    known = predictions.where(is_finite("prediction")).groupBy("era", "id").agg(told.alias("ps"))
    wide = known.join(feature_rows.select("era", "id", *features).where(all_finite(features)), ["era", "id"])
    wide = wide.withColumns({n: F.col("ps")[m] for n, m in zip(names, models, strict=True)}).drop("ps")
    moments = normal.era_moments(wide, features, names)
    sizes = moments.groupBy("era").applyInPandas(_exposures(len(features), models), "model_id string, size double")
    found = sizes.groupBy("model_id").agg(F.max("size").alias("max_feature_exposure"))
    return predictions.select("model_id").distinct().join(found, "model_id")


def _exposures(n_features: int, models: Sequence[str]):
    def of_era(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        sets = [
            (pattern, normal.Moments.unpacked(int(n), np.asarray(mean), np.asarray(spread)))
            for pattern, n, mean, spread in zip(part["pattern"], part["n"], part["mean"], part["spread"], strict=True)
        ]
        for i, model in enumerate(models):
            whole = None
            for pattern, moments in sets:
                if pattern[i] == "1":
                    whole = normal.merged(whole, moments)
            if whole is None:
                continue
            own = n_features + i
            scale = np.sqrt(np.diag(whole.spread)[:n_features] * whole.spread[own, own])
            with np.errstate(divide="ignore", invalid="ignore"):
                sizes = np.where(scale > 0, np.abs(whole.spread[:n_features, own]) / scale, 0.0)
            out.append((model, float(sizes.max())))
        return pd.DataFrame(out, columns=["model_id", "size"])

    return of_era


def _cells(scores: DataFrame, horizon: str, min_overlap_eras: int, **options) -> DataFrame:
    """Mean and interval of every (model, metric) series in one bootstrap job."""
    tested = inference.mean_interval(
        scores.where("metric in ('corr', 'mmc', 'bmc', 'cwmm', 'payout')"), ["model_id", "metric"],
        horizon, short="null", **options,
    )

    def of(metric: str, column: str) -> Column:
        few = (F.col("n") < min_overlap_eras) if metric in ("bmc", "cwmm") else F.lit(False)
        return F.max(F.when((F.col("metric") == metric) & ~few, F.col(column)))

    names = {"mean_payout": "payout", "corr": "corr", "mmc": "mmc", "bmc": "bmc", "cwmm": "cwmm"}
    return tested.groupBy(*BY).agg(
        *[
            F.struct(
                of(m, "point").alias("value"), of(m, "ci_low").alias("ci_low"),
                of(m, "ci_high").alias("ci_high"), of(m, "n").cast("bigint").alias("n_eras"),
            ).alias(name)
            for name, m in names.items()
        ]
    )


def evaluate_models(
    base: DataFrame,
    *,
    target: str,
    meta: str,
    features: Sequence[str],
    benchmark: str | None = None,
    horizon_pair: tuple[str, str] | None = None,
    regimes: DataFrame | None = None,
    n_trials: int = 1,
    trials_variance: float | None = None,
    horizon: str = "20D",
    n_boot: int = 1000,
    seed: int = 0,
    min_overlap_eras: int = scoring.MIN_OVERLAP_ERAS,
    feature_rows: DataFrame | None = None,
    perturbation: DataFrame | None = None,
    payout_factor: float = 1.0,
    payout_bound: float = series.PAYOUT_CLIP,
    level: float = 0.95,
) -> DataFrame:
    """One row per model. Cells are structs (value, ci_low, ci_high, n_eras); a cell that
    cannot be computed is NULL and its ``*_reason`` says why.

    ``feature_rows`` has target and features once per (era, id), so that the base of
    all models holds none; without it they are taken out of ``base``. ``perturbation``
    (model_id, ceiling_stability, manifold_stability, gap, ...) joins the cards as
    ``perturb_`` columns. Payouts are scaled by ``payout_factor`` and clipped at
    ``payout_bound``; intervals hold the share ``level`` of the replicates."""
    if not 0.0 < level < 1.0:
        raise ValueError("level must be between 0 and 1")
    if feature_rows is None:
        feature_rows = base.select("era", "id", target, *features).dropDuplicates(["era", "id"])
    feature_rows = materialize(feature_rows.select("era", "id", target, *features), "feature-rows")
    complete = scoring.complete_features(feature_rows, features, target)
    dealt = groups.models_a_task(base, complete, 6, len(features), "model_id")
    wide = None
    if dealt[1]:
        needed = ["prediction", meta, target, *([] if benchmark is None else [benchmark]), *(horizon_pair or ())]
        base = materialize(base.select("model_id", "era", "id", *dict.fromkeys(needed)), "evaluation-base")
        wide = materialize(scores_in_tasks(base, target, meta, benchmark, horizon_pair, complete, dealt), "era-scores")
        scores = series.with_era_num(_long(wide, ["corr", "meta_corr", "mmc", "cwmm", "fnc", "bmc"]))
    else:
        present = feature_rows.select("era", "id", all_finite(features).alias("features_ok"))
        base = materialize(base.drop(*features).join(present, ["era", "id"], "left"), "evaluation-base")
        scores = materialize(per_era_scores(base, target, meta, features, benchmark, feature_rows), "scores")

    def metric(name: str) -> DataFrame:
        return scores.where(F.col("metric") == name).drop("metric")

    payout = materialize(series.payout_series(metric("corr"), metric("mmc"), BY, payout_factor, payout_bound), "payout")
    long = scores.unionByName(
        payout.select("model_id", F.lit("payout").alias("metric"), "era", "value", "era_num")
    )
    options = {"n_boot": n_boot, "seed": seed, "alpha": 1.0 - level}
    card = _cells(long, horizon, min_overlap_eras, **options)

    sharpe = inference.ac_sharpe_interval(metric("corr"), BY, horizon, **options).select(
        *BY,
        F.struct(F.col("point").alias("value"), "ci_low", "ci_high", F.col("n").cast("bigint").alias("n_eras")).alias("corr_sharpe_ac"),
    )
    report = series.payout_report(payout, BY).drop("mean_payout")
    variance = F.lit(trials_variance) if trials_variance is not None else None
    report = inference.with_deflated_sharpe(report, F.lit(n_trials), variance, out="deflated_sharpe")
    report = report.drop("n", "sharpe", "skew", "kurt")
    means = scores.groupBy(*BY).agg(
        F.avg(F.when(F.col("metric") == "fnc", F.col("value"))).alias("fnc"),
        F.stddev_pop(F.when(F.col("metric") == "corr", F.col("value"))).alias("std_corr"),
    )
    turnover = scoring.per_era_turnover(series.with_era_num(base), "prediction", BY).groupBy(*BY).agg(
        F.count("value").alias("__n"),
        F.when(F.count("value") >= 2, F.avg("value")).alias("turnover_mean"),
        F.when(F.count("value") >= 2, F.stddev_pop("value")).alias("turnover_std"),
    ).drop("__n")
    meta_scores = metric("meta_corr").select("model_id", "era", F.col("value").alias("__meta"))
    down = F.col("__meta") < 0.0
    n_down = F.count_if(down)
    mmc_down = metric("mmc").join(meta_scores, KEYS).groupBy(*BY).agg(
        F.when(n_down >= scoring.MIN_DOWNSIDE_ERAS, F.avg(F.when(down, F.col("value")))).alias("mmc_down"),
        n_down.alias("mmc_down_n_eras"),
        F.when(n_down < scoring.MIN_DOWNSIDE_ERAS, "insufficient_downside_eras").alias("mmc_down_reason"),
    )
    if wide is not None:
        degenerate = wide.where("degenerate").select(*KEYS)
        exposure = wide.groupBy(*BY).agg(F.max("exposure").alias("max_feature_exposure"))
    else:
        with_features = base.withColumn("prediction", F.when(F.col("features_ok"), F.col("prediction")))
        degenerate = scoring.degenerate_eras(with_features, "prediction", target, meta, by=KEYS)
        exposure = max_exposure(base, feature_rows, features)
    degenerate = degenerate.groupBy(*BY).agg(F.count(F.lit(1)).alias("n_degenerate_eras"))
    mmc_sharpe = inference.ac_adjusted_sharpe(metric("mmc"), BY, horizon)
    parts = [
        sharpe, report, means, turnover, mmc_down, exposure, degenerate,
        mmc_sharpe.select(*BY, F.col("ac_sharpe").alias("mmc_sharpe_ac")),
    ]
    if benchmark is not None and horizon_pair is not None:
        if wide is not None:
            names = F.split("metric", "_")
            horizon_of = F.when(names[1] == "short", "20D").otherwise("60D")
            sides = _long(wide, ["model_short", "model_long", "bench_short", "bench_long"])
            sides = sides.select("model_id", "era", names[0].alias("side"), horizon_of.alias("horizon"), "value")
            stability = robustness.horizon_ratios(sides, BY, min_overlap_eras)
        else:
            stability = robustness.horizon_stability(
                base, "prediction", benchmark, *horizon_pair, by=BY, min_overlap_eras=min_overlap_eras
            )
        parts.append(stability.select(*BY, *[F.col(c).alias(f"horizon_{c}") for c in stability.columns if c != "model_id"]))
    if regimes is not None:
        per = robustness.regime_corr(metric("corr"), regimes, BY, horizon, min_overlap_eras, strict=False, **options)
        cell = F.struct("mean_corr", "ci_low", "ci_high", F.col("n_eras").cast("bigint").alias("n_eras"))
        whole = F.bool_and(F.col("mean_corr").isNotNull())
        parts.append(per.groupBy(*BY).agg(
            F.when(whole, F.map_from_entries(F.sort_array(F.collect_list(F.struct("regime", cell))))).alias("regime_corr"),
            F.when(~whole, F.lit(f"a regime has fewer than {min_overlap_eras} eras")).alias("__regime_reason"),
        ))
    if perturbation is not None:
        cells = [c for c in perturbation.columns if c != "model_id"]
        parts.append(perturbation.select(*BY, *[F.col(c).alias(f"perturb_{c}") for c in cells]))
    # each part has one row per model; models are few next to rows
    for part in parts:
        card = card.join(part, BY, "left")
    available = set(card.columns)
    return card.withColumns(
        {
            "rank_scalar": F.col("mean_payout.value"),
            "n_degenerate_eras": F.coalesce("n_degenerate_eras", F.lit(0)),
            "turnover_reason": F.when(F.col("turnover_mean").isNull(), "insufficient_transitions"),
            "bmc_reason": _reason("bmc", benchmark is not None),
            "cwmm_reason": _reason("cwmm", True),
            "horizon_reason": F.when(
                F.col("horizon_model_decay").isNull(), "too few resolved eras"
            ) if "horizon_model_decay" in available else F.lit("benchmark unavailable"),
            **({} if perturbation is None else {"perturb_reason": F.when(F.col("perturb_ceiling_stability").isNull(), "no perturbation result")}),
            "regime_reason": F.coalesce("__regime_reason", F.when(F.col("regime_corr").isNull(), "no labelled eras"))
            if regimes is not None else F.lit("regime labels unavailable"),
            **{
                f"{cell}_reason": F.when(F.col(f"{cell}.value").isNull(), "series is shorter than its block floor")
                for cell in ("corr", "mmc", "mean_payout", "corr_sharpe_ac")
            },
        }
    ).drop("__regime_reason")


def _reason(cell: str, available: bool) -> Column:
    text = "fewer overlap eras than required" if available else "benchmark unavailable"
    return F.when(F.col(f"{cell}.value").isNull(), text)


def flatten(cards: DataFrame) -> DataFrame:
    """Scorecards with plain columns: cells become name, name_ci_low, name_ci_high and
    name_n_eras, the regime map becomes counts and JSON. Sorted by model."""
    cells = []
    for name in cards.columns:
        if name in CELLS:
            cells.append(F.col(f"{name}.value").alias(name))
            cells += [F.col(f"{name}.{part}").alias(f"{name}_{part}") for part in ("ci_low", "ci_high", "n_eras")]
        elif name == "regime_corr":
            counts = F.transform(F.map_values(name), lambda c: c["n_eras"])
            cells += [
                F.size(F.map_keys(name)).cast("bigint").alias("regime_count"),
                F.array_min(counts).alias("regime_min_n_eras"),
                F.array_max(counts).alias("regime_max_n_eras"),
                F.to_json(name).alias("regime_corr_json"),
            ]
        else:
            cells.append(F.col(name))
    return cards.select(*cells).orderBy("model_id")


def union_scorecards(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.orderBy("model_id")
