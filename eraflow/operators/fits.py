"""Prediction generators and model fits on Spark estimators.

Every fit is a distributed Spark ML job over the train rows; nothing is collected but
coefficients. Folds are fitted one after the other, each on the whole cluster, and
their predictions are written as they finish, so a lost executor (or a restart)
repeats at most one fold.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eraflow.functions.hashing import uniform
from eraflow.functions.ranks import group_shape, percentile_rank, with_ranks
from eraflow.functions.stats import clip, is_finite, with_norm_ppf
from eraflow.operators import analysis, ensemble, folds, normal, scoring
from eraflow.operators.neutralize import neutralize
from eraflow.operators.rows import KEYS, complete_join, era_table, fill_missing, finite_target_rows, rows_of_eras
from eraflow.session import broadcast_checked, materialize, path_exists, shared_dir

TREE_PARAMS = {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "seed": 7}


# -- baselines ----------------------------------------------------------------


def null_predictions(
    index: DataFrame,
    kind: str,
    seed: int = 0,
    features: DataFrame | None = None,
    feature_cols: Sequence[str] = (),
) -> DataFrame:
    """Constant, uniform, clipped normal, or feature-mean predictions, reproducible from
    (seed, era, id) whatever the partitioning."""
    keys = index.select(*KEYS).distinct()
    if kind == "constant":
        return keys.withColumn("prediction", F.lit(0.5))
    if kind == "uniform":
        return keys.withColumn("prediction", uniform(seed, F.col("era"), F.col("id")))
    if kind == "gaussian":
        drawn = keys.withColumn("__u", uniform(seed, F.col("era"), F.col("id")))
        scored = with_norm_ppf(drawn, {"__z": "__u"})
        value = clip(F.lit(0.5) + F.lit(0.15) * F.col("__z"), 0.0, 1.0)
        return scored.withColumn("prediction", value).drop("__u", "__z")
    if kind == "feature_mean":
        if features is None or not feature_cols:
            raise ValueError("feature_mean needs features")
        joined = complete_join(keys, features.select(*KEYS, *feature_cols))
        return joined.select(*KEYS, horizontal_mean(feature_cols).alias("prediction"))
    raise ValueError(f"unknown kind {kind!r}")


def horizontal_mean(columns: Sequence[str]) -> Column:
    """Mean over the non-NULL columns of a row."""
    total, present = F.lit(0.0), F.lit(0)
    for c in columns:
        total = total + F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        present = present + F.col(c).isNotNull().cast("int")
    return F.when(present > 0, total / F.when(present > 0, present))


def lagged_target_predictions(
    train: DataFrame, index: DataFrame, target: str, window: int = 1
) -> DataFrame:
    """The mean target of the last ``window`` train eras, for every later row."""
    eras = train.select("era", "era_num").distinct()
    last = eras.withColumn("i", F.row_number().over(Window.orderBy(F.desc("era_num"))))
    rows = rows_of_eras(train, last.where(F.col("i") <= window))
    known = rows.where(F.col(target).isNotNull())
    mean = known.agg(F.avg(F.col(target).cast("double")).alias("mean")).scalar()
    return index.select(*KEYS).withColumn("prediction", mean)


# -- fits ------------------------------------------------------------------------


def purged(train: DataFrame, rows: DataFrame, targets: Sequence[str], purge: int) -> DataFrame:
    """``train`` without its last ``purge`` eras, whose targets overlap the scored ones.
    Too short a purge for the targets, or a gap of another width, is an error. One job
    lists the eras of both sides; the cut is a filter that reaches the scan."""
    sides = era_table(train).withColumn("train", F.lit(True)).unionByName(era_table(rows).withColumn("train", F.lit(False)))
    eras = sides.collect()
    known = [e["era_num"] for e in eras if e["train"]]
    folds.require_purge(train, list(targets), purge, len(known))
    return train.where(F.col("era_num") <= folds.purge_end(known, [e["era_num"] for e in eras if not e["train"]], purge))


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="error").transform(df)


def ridge(train: DataFrame, features: Sequence[str], target: str, alpha: float):
    """Least squares with penalty ``alpha`` on the squared coefficients and a free
    intercept. Spark scales the label by its deviation and divides the loss by n, so
    its parameter is alpha / n times that deviation."""
    rows = finite_target_rows(train, target).select(*features, F.col(target).cast("double").alias("__y"))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("__y").alias("sd")).first()
    if not stats["n"]:
        raise ValueError(f"no finite rows of {target}")
    parameter = alpha / stats["n"] * (stats["sd"] or 1.0)
    model = LinearRegression(
        featuresCol="__x", labelCol="__y", solver="normal", standardization=False, regParam=parameter
    )
    return model.fit(_assembled(rows, features))


def trees(train: DataFrame, features: Sequence[str], target: str, **params):
    rows = finite_target_rows(train, target).select(*features, F.col(target).cast("double").alias("__y"))
    return GBTRegressor(featuresCol="__x", labelCol="__y", **{**TREE_PARAMS, **params}).fit(
        _assembled(rows, features)
    )


def predict(model, df: DataFrame, features: Sequence[str], out: str = "prediction") -> DataFrame:
    """Scores of a fitted model; rows are scored where they are, partition by partition."""
    scored = model.setPredictionCol("__p").transform(_assembled(df, features))
    return scored.withColumn(out, F.col("__p")).drop("__x", "__p")


def ridge_predictions(
    train: DataFrame,
    rows: DataFrame,
    features: Sequence[str],
    targets: Sequence[str],
    purge: int,
    alpha: float = 1.0,
    weights: Sequence[float] | None = None,
) -> DataFrame:
    """One ridge per target on standardized features, blended by rank, unit variance. The
    train rows are read once for all targets."""
    moments = normal.era_moments(purged(train, rows, targets, purge), features, targets)
    names = [f"__m_{t}" for t in targets]
    fits = normal.ridge_fits(moments, targets, [alpha], scaled=True)
    return _blended(normal.predict(rows, fits, features, names).select(*KEYS, *names), names, weights)


def _blended(df: DataFrame, names: Sequence[str], weights: Sequence[float] | None = None) -> DataFrame:
    out = ensemble.blend(df, names, weights, out="prediction").select(*KEYS, "prediction")
    return ensemble.rank_normalize(out, ["prediction"])


def tree_predictions(
    train: DataFrame,
    rows: DataFrame,
    features: Sequence[str],
    targets: Sequence[str],
    purge: int,
    weights: Sequence[float] | None = None,
    neutralize_features: Sequence[str] = (),
    proportion: float = 0.0,
    holdout_share: float = 0.0,
    **params,
) -> DataFrame:
    """Boosted trees per target, blended by rank and optionally neutralized. With
    ``holdout_share`` that share of the last train eras (at least one) decides when to
    stop adding trees; the ``purge`` eras before them train nothing."""
    train = purged(train, rows, targets, purge)
    scored = rows
    names = []
    for t in targets:
        if holdout_share:
            roles = folds.held_out(era_table(train), holdout_share, purge).where("role <> 'purge'")
            marks = roles.select("era", (F.col("role") == "held_out").alias("__valid"))
            fitted = train.join(broadcast_checked(marks), "era")
            data = finite_target_rows(fitted, t).select(*features, "__valid", F.col(t).cast("double").alias("__y"))
            model = GBTRegressor(
                featuresCol="__x", labelCol="__y", validationIndicatorCol="__valid",
                **{**TREE_PARAMS, **params},
            ).fit(_assembled(data, features))
        else:
            model = trees(train, features, t, **params)
        scored = predict(model, scored, features, f"__m_{t}")
        names.append(f"__m_{t}")
    out = _blended(scored.select(*KEYS, *names), names, weights)
    if proportion > 0.0 and neutralize_features:
        joined = complete_join(out, rows.select(*KEYS, *neutralize_features))
        out = neutralize(joined, "prediction", neutralize_features, proportion).select(
            *KEYS, "prediction"
        )
    return out


def riskiest_neutralized_predictions(
    train: DataFrame, rows: DataFrame, features: Sequence[str], targets: Sequence[str],
    main_target: str, count: int, proportion: float, purge: int, **params,
) -> DataFrame:
    """Tree predictions neutralized against the features with the least stable signal."""
    ic = analysis.ic_by_era(purged(train, rows, [main_target], purge), features, [main_target])
    risky = [r["feature"] for r in analysis.riskiest_features(analysis.stability_screen(ic), count).collect()]
    return tree_predictions(
        train, rows, features, targets, purge, neutralize_features=risky, proportion=proportion, **params
    )


def ridge_stack(
    train: DataFrame,
    rows: DataFrame,
    features: Sequence[str],
    specialists: Sequence[str],
    main_target: str,
    meta_share: float,
    purge: int,
    alpha: float = 1.0,
    meta_alpha: float = 1.0,
    fill: float | None = None,
    neutralize_features: Sequence[str] = (),
    proportion: float = 0.0,
) -> DataFrame:
    """Two layers: a ridge per specialist target on the early eras, and a ridge on their
    ranked predictions over the held-back last ``meta_share`` of the train eras. ``fill``
    replaces NULL features; the result can be neutralized."""
    if fill is not None:
        train, rows = fill_missing(train, features, fill), fill_missing(rows, features, fill)
    early, tail = stack_sides(train, rows, [*specialists, main_target], meta_share, purge)
    names = [f"s_{t}" for t in specialists]
    fits = normal.ridge_fits(normal.era_moments(early, features, specialists), specialists, [alpha])
    tail_ranked = _ranked(normal.predict(tail, fits, features, names), [main_target], names)
    rows_ranked = _ranked(normal.predict(rows, fits, features, names), [], names)
    meta = normal.ridge_fits(normal.era_moments(tail_ranked, names, [main_target]), [main_target], [meta_alpha])
    out = normal.predict(rows_ranked, meta, names, ["prediction"]).select(*KEYS, "prediction")
    out = _blended(out, ["prediction"])
    if proportion > 0.0 and neutralize_features:
        joined = complete_join(out, rows.select(*KEYS, *neutralize_features))
        out = neutralize(joined, "prediction", neutralize_features, proportion).select(*KEYS, "prediction")
    return out


def _ranked(df: DataFrame, kept: Sequence[str], names: Sequence[str]) -> DataFrame:
    return ensemble.rank_normalize(df.select(*KEYS, *kept, *names), names)


def stack_sides(
    train: DataFrame, rows: DataFrame, targets: Sequence[str], meta_share: float, purge: int
) -> tuple[DataFrame, DataFrame]:
    """Rows of the specialists' eras and of the meta model's, with purges between them and
    before the scored rows."""
    train = purged(train, rows, targets, purge)
    roles = folds.stack_partitions(era_table(train), meta_share, any(t.endswith("_60") for t in targets))
    return tuple(rows_of_eras(train, roles.where(F.col("role") == r)) for r in ("specialist", "meta"))


def target_quality(
    train: DataFrame, main_target: str, candidates: Sequence[str],
    hints: Sequence[str] = (), weights: Mapping[str, float] | None = None,
) -> DataFrame:
    """Coverage and correlation with the main target of each candidate, best first."""
    weights = weights or {}
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("target"), F.col(c).cast("double").alias("v"),
                    F.lit(1.0 if c in hints else 0.0).alias("hint"),
                    F.lit(float(weights.get(c, 0.0))).alias("weight"),
                )
                for c in candidates
            ]
        )
    ).alias("c")
    long = train.select(F.col(main_target).cast("double").alias("m"), cells).select("m", "c.*")
    both = is_finite("m") & is_finite("v")
    from eraflow.functions.stats import safe_corr

    return long.groupBy("target", "hint", "weight").agg(
        (F.count("v") / F.count(F.lit(1))).alias("coverage"),
        safe_corr(F.when(both, F.col("v")), F.when(both, F.col("m"))).alias("corr"),
    )


def select_targets(
    quality: DataFrame, min_coverage: float, min_abs_corr: float, top: int
) -> DataFrame:
    kept = quality.where(
        (F.col("coverage") >= min_coverage) & (F.abs("corr") >= min_abs_corr)
    )
    order = [F.desc("hint"), F.desc("weight"), F.desc("corr"), F.asc("target")]
    return kept.orderBy(*order).limit(top)


def penalty_search(
    tail: DataFrame, fits: DataFrame, features: Sequence[str], asked: Sequence[tuple[str, float]], main_target: str
) -> DataFrame:
    """Score ratio on the tail of each (target, penalty) of ``asked``, whose fits are in that
    order: (target, alpha, era_sharpe, n_eras). All are columns of one scan of the tail,
    and one aggregation scores them."""
    names = [f"a{i}" for i in range(len(asked))]
    ranked = _ranked(normal.predict(tail, fits, features, names), [main_target], names)
    cells = [
        F.struct(F.lit(t).alias("target"), F.lit(float(a)).alias("alpha"), F.col(name).alias("p"))
        for name, (t, a) in zip(names, asked, strict=True)
    ]
    long = ranked.select("era", F.col(main_target).alias("__y"), F.explode(F.array(*cells)).alias("c")).select("era", "__y", "c.*")
    return scoring.era_sharpe(long, "p", "__y", ["target", "alpha"])


def ridge_stack_search(
    train: DataFrame,
    rows: DataFrame,
    features: Sequence[str],
    specialists: Sequence[str],
    main_target: str,
    benchmark: str,
    meta_share: float,
    purge: int,
    *,
    top: int,
    alphas: Sequence[float] = (0.1, 1.0, 10.0),
    shares: Sequence[float] = (0.0, 0.1, 0.3),
    sharpe_floor: float = 0.0,
    min_coverage: float = 0.5,
    min_abs_corr: float = 0.0,
    min_specialists: int = 1,
    hints: Sequence[str] = (),
    target_weights: Mapping[str, float] | None = None,
    meta_penalties: Sequence[float] = (1.0,),
    meta_trees: Mapping[str, object] | None = None,
    proportions: Sequence[float] = (0.0,),
) -> DataFrame:
    """Search over specialists, penalties and benchmark decorrelation. At most ``top``
    specialists are tried, hinted ones first; fewer than ``min_specialists`` over the
    floors is an error. The metas are a free ridge, a non-negative one per penalty and,
    with ``meta_trees`` (parameters of ``era_stopped_trees``), boosted trees that stop on
    the tail's last eras. Candidates are compared on the rows' own targets, so the
    winner's score is selection-biased; of shares of neutralization that score alike the
    least in ``proportions`` is taken, as the scores are taken before it. The early rows
    are read once for all specialists and penalties."""
    early, tail = stack_sides(train, rows, [*specialists, main_target], meta_share, purge)
    judged = target_quality(early, main_target, specialists, hints, target_weights)
    chosen = [r["target"] for r in select_targets(judged, min_coverage, min_abs_corr, top).collect()]
    asked = [(t, float(a)) for t in chosen for a in alphas]
    fits = normal.ridge_fits(normal.era_moments(early, features, specialists), specialists, alphas, fitted=chosen) if chosen else None
    best: dict[str, tuple[float, float]] = {}
    for r in penalty_search(tail, fits, features, asked, main_target).collect() if asked else []:
        best[r["target"]] = min(best.get(r["target"], (float("inf"), 0.0)), (-r["era_sharpe"], r["alpha"]))
    kept = [(t, best[t][1]) for t in chosen if t in best and -best[t][0] >= sharpe_floor]
    if len(kept) < max(1, min_specialists):
        raise ValueError(f"{len(kept)} specialists reach the floor, {max(1, min_specialists)} are needed")
    columns = [f"a{i}" for i in range(len(asked))]
    names = [columns[asked.index(pair)] for pair in kept]
    tail_ranked = materialize(_ranked(normal.predict(tail, fits, features, columns), ["era_num", main_target], names), "stack-tail")
    scored = _ranked(normal.predict(rows, fits, features, columns), [main_target, benchmark], names)
    matrix, rhs = ensemble.gram(finite_target_rows(tail_ranked, main_target), names, main_target)
    free = normal.ridge_fits(normal.era_moments(tail_ranked, names, [main_target]), [main_target], [1.0])
    scored = normal.predict(scored, free, names, ["free"])
    metas = {}
    for i, penalty in enumerate(meta_penalties):
        positive = ensemble.non_negative_solution(matrix + penalty * np.eye(len(names)), rhs)
        metas[f"positive_{i}"] = sum((F.lit(float(w)) * F.col(n) for n, w in zip(names, positive)), F.lit(0.0))
    if meta_trees is not None:
        model = era_stopped_trees(tail_ranked, names, main_target, **meta_trees)
        scored = predict(model, scored, names, "trees")
    scored = materialize(scored.withColumns(metas), "stack-candidates")
    metas = [*metas, *(["trees"] if meta_trees is not None else [])]
    sweep = ensemble.decorrelation_sweep(scored, ["free", *metas], benchmark, main_target, shares)
    best = ensemble.best_candidate(sweep).first()
    bench = ensemble.rank_normalize(scored.where(is_finite(benchmark)), [benchmark])
    raw = F.col(best["candidate"]) - F.lit(best["share"]) * F.col(benchmark)
    out = bench.select(*KEYS, raw.alias("prediction"))
    if min(proportions) > 0.0:
        out = neutralize(complete_join(out, rows.select(*KEYS, *features)), "prediction", features, min(proportions))
    return _blended(out.select(*KEYS, "prediction"), ["prediction"])


def era_stopped_trees(
    rows: DataFrame, features: Sequence[str], target: str, share: float = 0.2, least: int = 5, **params
):
    """Boosted trees that stop adding when the last eras no longer gain: that ``share`` of
    the eras of usable rows (rounded half to even), at least ``least``, but never all. One
    era alone stops nothing."""
    known = finite_target_rows(rows, target)
    nums = sorted(r["era_num"] for r in known.select("era_num").distinct().collect())
    if not nums:
        raise ValueError(f"no finite rows of {target}")
    held = min(max(least, round(len(nums) * share)), max(1, len(nums) - 1))
    data = known.select(*features, (F.col("era_num") >= nums[-held]).alias("__valid"), F.col(target).cast("double").alias("__y"))
    settings = {**TREE_PARAMS, **params}
    if len(nums) == 1:
        return GBTRegressor(featuresCol="__x", labelCol="__y", **settings).fit(_assembled(data, features))
    return GBTRegressor(featuresCol="__x", labelCol="__y", validationIndicatorCol="__valid", **settings).fit(_assembled(data, features))


# -- cross-validation --------------------------------------------------------------


def out_of_fold(
    df: DataFrame,
    folds: DataFrame,
    fit: Callable[[DataFrame], object],
    features: Sequence[str],
    run_name: str | None = None,
    settings: Mapping[str, object] | None = None,
) -> DataFrame:
    """Fit on each fold's train eras, predict its validation eras, put them together.

    Each fold's predictions are written to the shared folder; with a ``run_name`` a
    repeated call finds the finished folds there and fits only the others. ``settings``
    says what the fit is (target, estimator, parameters); finished folds are only found
    under the same settings, features, eras per fold and input plan. An era validated
    twice is an error.
    """
    spark = df.sparkSession
    if run_name and settings is None:
        raise ValueError("a run that can be resumed needs the settings of its fit")
    identity = run_identity(df, folds, features, settings or {}) if run_name else None
    numbers = [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()]
    val = folds.where("role = 'val'")
    if val.groupBy("era").count().where("count > 1").limit(1).count():
        raise ValueError("validation eras overlap between folds")
    parts = []
    for k in numbers:
        path = f"{shared_dir(spark)}/eraflow/oof/{run_name}/{identity}/fold={k}" if run_name else None
        if path and path_exists(spark, f"{path}/_SUCCESS"):
            parts.append(spark.read.parquet(path))
            continue
        train = rows_of_eras(df, folds.where((F.col("fold") == k) & (F.col("role") == "train")))
        rows = rows_of_eras(df, val.where(F.col("fold") == k))
        scored = predict(fit(train), rows, features).select(
            *KEYS, "prediction", F.lit(k).alias("fold")
        )
        if path:
            scored.write.mode("overwrite").parquet(path)
            parts.append(spark.read.parquet(path))
        else:
            parts.append(materialize(scored, f"oof-{k}"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def run_identity(df: DataFrame, folds: DataFrame, features: Sequence[str], settings: Mapping[str, object]) -> str:
    """Hash of everything the predictions of a run depend on: the folds (one row per era),
    the features, the settings, and the input's files and shape."""
    eras = sorted((r["fold"], r["role"], r["era"]) for r in folds.select("fold", "role", "era").collect())
    facts = {
        "folds": eras, "features": list(features), "settings": {k: repr(settings[k]) for k in sorted(settings)},
        "schema": df.schema.simpleString(), "files": sorted(df.inputFiles()),
    }
    return hashlib.sha256(json.dumps(facts, default=str).encode()).hexdigest()[:24]


def targets_out_of_fold(
    df: DataFrame, folds_table: DataFrame, fit: Callable[[DataFrame, str], object],
    features: Sequence[str], targets: Sequence[str], run_name: str | None = None,
    settings: Mapping[str, object] | None = None,
) -> DataFrame:
    """Out-of-fold predictions of every target as one frame: a column per target."""
    out = None
    for t in targets:
        part = out_of_fold(
            df, folds_table, lambda train, t=t: fit(train, t), features,
            f"{run_name}-{t}" if run_name else None, None if settings is None else {**settings, "target": t},
        )
        part = part.select(*KEYS, "fold", F.col("prediction").alias(t))
        out = part if out is None else out.join(part, [*KEYS, "fold"])
    return out


def ridge_out_of_fold(
    df: DataFrame, folds_table: DataFrame, features: Sequence[str], targets: Sequence[str], alpha: float = 1.0
) -> DataFrame:
    """Out-of-fold ridge predictions of every target, a column each: (era, id, fold,
    targets). The train rows of all folds and targets are read once."""
    scored, asked = normal.out_of_fold(df, folds_table, features, targets, [alpha])
    return scored.select(*KEYS, "fold", *[F.col(f"__p{i}").alias(t) for i, (t, _) in enumerate(asked)])


def full_history_fit(
    df: DataFrame, fit: Callable[[DataFrame], object], path: str
) -> object:
    """Fit on every row and save the model, which ``deploy_pipeline`` can load again."""
    model = fit(df)
    model.write().overwrite().save(path)
    return model


def parameter_sweep(
    train: DataFrame,
    held_out: DataFrame,
    features: Sequence[str],
    target: str,
    grid: Sequence[Mapping[str, float]],
    purge: int,
) -> DataFrame:
    """Held-out score moments of a ridge per grid point, best first. One scan of the train
    rows serves every point, the trials' scores are columns of one scan of the held-out
    rows, and one aggregation scores them all."""
    moments = normal.era_moments(purged(train, held_out, [target], purge), features, [target])
    names = [f"t{i}" for i in range(len(grid))]
    fits = normal.ridge_fits(moments, [target], [p["alpha"] for p in grid])
    cells = [
        F.struct(F.lit(i).alias("trial_id"), F.lit(float(p["alpha"])).alias("alpha"), F.col(f"t{i}").alias("p"))
        for i, p in enumerate(grid)
    ]
    scored = normal.predict(held_out, fits, features, names)
    long = scored.select("era", target, F.explode(F.array(*cells)).alias("c")).select("era", target, "c.*")
    moments = _trial_moments(long, target, ["trial_id", "alpha"])
    return moments.orderBy(F.desc("mean"), "trial_id")


def _trial_moments(long: DataFrame, target: str, by: Sequence[str]) -> DataFrame:
    from eraflow.operators.series import series_stats

    return series_stats(scoring.per_era_corr(long, "p", target, [*by, "era"]), by)


def configuration_sweep(
    rows: DataFrame,
    features: Sequence[str],
    main_target: str,
    grid: Sequence[Mapping[str, object]],
    purge: int,
    n_folds: int = 3,
    share: float = 0.2,
) -> DataFrame:
    """Held-out score of whole configurations, best first: (trial_id, params_json,
    weights, and the moments of the held-out score series).

    A configuration names its ``targets``, the penalty ``alpha`` and how the blend's
    weights are learned (``method``: ridge, non_negative or equal). The last ``share`` of
    the eras is held out behind a purge. On the eras before, walk-forward folds give
    out-of-fold predictions per target, from which the weights are learned; the anchor
    fold's fits predict the held-out eras, blended with these weights.

    All configurations share one scan of the train rows (moments per era, merged for
    every fold), one for the out-of-fold scores with one Gram matrix of all columns, and
    one of the held-out rows."""
    grid = [{"method": "ridge", "alpha": 1.0, **point} for point in grid]
    targets = list(dict.fromkeys(t for point in grid for t in point["targets"]))
    alphas = sorted({float(point["alpha"]) for point in grid})
    eras = era_table(rows)
    folds.require_purge(eras, [*targets, main_target], purge)
    roles = folds.held_out(eras, share, purge)
    inner = rows_of_eras(rows, roles.where("role = 'train'"))
    held = rows_of_eras(rows, roles.where("role = 'held_out'"))
    inner_eras = roles.where("role = 'train'").select("era", "era_num")
    walk = materialize(folds.walk_forward(inner_eras, n_folds, purge), "sweep-folds")
    last = folds.anchor(inner_eras, purge).withColumn("fold", F.lit(n_folds))
    groups = walk.unionByName(last).where("role = 'train'").select("fold", "era")
    fits = normal.ridge_fits(normal.era_moments(inner, features, targets), targets, alphas, groups)
    asked = [(t, a) for t in targets for a in alphas]
    names = [f"p{i}" for i in range(len(asked))]
    val = walk.where("role = 'val'").select("era", F.col("fold").cast("int").alias("fold"))
    known = finite_target_rows(inner, main_target).join(broadcast_checked(val), "era").join(broadcast_checked(fits), "fold")
    oof = _ranked(normal.with_scores(known, F.col("fits"), features, names), [main_target], names)
    matrix, rhs = ensemble.gram(oof, names, main_target)
    blends, weights = [], []
    for i, point in enumerate(grid):
        used = [asked.index((t, float(point["alpha"]))) for t in point["targets"]]
        found = ensemble.solved_weights(matrix[np.ix_(used, used)], rhs[used], str(point["method"]))
        weights.append(found)
        total = sum((F.lit(w) * F.col(names[k]) for w, k in zip(found, used, strict=True)), F.lit(0.0))
        shown = F.lit(json.dumps({k: point[k] for k in sorted(point)}))
        blends.append(F.struct(F.lit(i).alias("trial_id"), shown.alias("params_json"), F.array(*map(F.lit, found)).alias("weights"), F.round(total, 12).alias("p")))
    scored = normal.predict(held, fits.where(F.col("fold") == n_folds), features, names)
    ranked = _ranked(scored, [main_target], names)
    long = ranked.select("era", main_target, F.explode(F.array(*blends)).alias("c")).select("era", main_target, "c.*")
    return _trial_moments(long, main_target, ["trial_id", "params_json", "weights"]).orderBy(F.desc("mean"), "trial_id")


# -- score time --------------------------------------------------------------------


def deploy_pipeline(
    df: DataFrame,
    models: Mapping[str, object],
    features: Sequence[str],
    weights: Sequence[float] | None = None,
    neutralize_features: Sequence[str] = (),
    proportion: float = 0.0,
) -> DataFrame:
    """Raw scores of each model, blended by rank, neutralized, as percentile ranks."""
    scored = df
    for name, model in models.items():
        scored = predict(model, scored, features, name)
    out = ensemble.blend(scored, list(models), weights)
    if proportion > 0.0 and neutralize_features:
        out = neutralize(out, "prediction", neutralize_features, proportion)
    return era_percentiles(out.select(*KEYS, "prediction"))


def era_percentiles(df: DataFrame, by: Sequence[str] = ("era",)) -> DataFrame:
    rounded = df.withColumn("__v", F.round("prediction", 12))
    ranked = with_ranks(rounded, by, {"__r": "__v"}, count_as="__n", shape=group_shape(df, by))
    return ranked.withColumn("prediction", percentile_rank(F.col("__r"), F.col("__n"))).drop(
        "__r", "__n", "__v"
    )


def submission(predictions: DataFrame) -> DataFrame:
    """Percentile ranks over all rows, sorted by id. Repeated ids or non-finite values
    are errors."""
    from eraflow.operators.rows import checked_ids

    facts = checked_ids(predictions).first()
    if facts["n_repeated_ids"] or not facts["all_finite"]:
        raise ValueError("a submission needs unique ids and finite predictions")
    whole = predictions.select("id", F.col("prediction").cast("double").alias("__v"), F.lit(1).alias("__all"))
    ranked = with_ranks(whole, ["__all"], {"__r": "__v"}, count_as="__n")
    return ranked.select("id", percentile_rank(F.col("__r"), F.col("__n")).alias("prediction")).orderBy("id")
