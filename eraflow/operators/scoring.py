"""Per-era scores of predictions: rank-domain correlation, contribution, exposure.

Inputs are row frames keyed by ``by`` (an era, or model and era); outputs have one
row per group with a ``value``. Rows with a missing or non-finite required column
are left out before ranking. A group with fewer than two usable rows, or with a
constant input, scores 0.0 rather than disappearing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eraflow.functions import groups
from eraflow.functions.ranks import group_shape, with_rank_gauss, with_ranks
from eraflow.functions.stats import (
    all_finite,
    finite_or,
    is_finite,
    ratio,
    raw_corr,
    safe_corr,
    signed_power,
)
from eraflow.operators.neutralize import _fold, _solved, feature_vector, fit_models, fitted_value, project
from eraflow.session import broadcast_checked, materialize

MIN_OVERLAP_ERAS = 20
MIN_SHARED_IDS = 10
MIN_DOWNSIDE_ERAS = 5


class NonVacuityError(ValueError):
    """Fewer eras than a statistic needs to mean anything."""


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows on which every listed numeric column is present and finite."""
    return df.where(all_finite(columns))


def _usable(df: DataFrame, by: Sequence[str], columns: dict[str, str]) -> DataFrame:
    picked = df.select(*by, *[F.col(src).cast("double").alias(out) for out, src in columns.items()])
    return picked.withColumn("ok", all_finite(list(columns)))


def _varies(columns: Sequence[str]) -> Column:
    """Aggregate: at least two usable rows and no constant column among them."""
    result = F.count(F.when(F.col("ok"), 1)) >= 2
    for name in columns:
        value = F.when(F.col("ok"), F.col(name))
        result = result & (F.min(value) < F.max(value))
    return result


def _score(condition: Column, value: Column) -> Column:
    return finite_or(F.when(F.coalesce(condition, F.lit(False)), value), 0.0).alias("value")


def per_era_corr(
    df: DataFrame,
    pred: str,
    target: str,
    by: Sequence[str] = ("era",),
    shape: tuple[int, int] | None = None,
) -> DataFrame:
    """Correlation of the signed 1.5 powers of the prediction's normal score and of
    the centred target. ``shape`` may bound the groups if the caller knows them."""
    work = _usable(df, by, {"p": pred, "t": target})
    shape = shape or group_shape(df, by)
    scored = with_rank_gauss(
        groups.dealt(work, by, shape), [*by, "ok"], {"z": "p"}, stats={"t_mean": F.avg("t")}, shape=shape
    )
    x = F.when(F.col("ok"), signed_power(F.col("z")))
    y = F.when(F.col("ok"), signed_power(F.col("t") - F.col("t_mean")))
    return scored.groupBy(*by).agg(_score(_varies(["p", "t"]), raw_corr(x, y)))


def per_era_mmc(
    df: DataFrame, pred: str, meta: str, target: str, by: Sequence[str] = ("era",)
) -> DataFrame:
    """Contribution over ``meta``: the part of the prediction's normal score that is
    orthogonal to the meta score, times the centred target, averaged over rows.
    Targets that all lie in [0, 1] count on the 0..4 scale."""
    work = _usable(df, by, {"p": pred, "m": meta, "t": target})
    shape = group_shape(df, by)
    if groups.fits_task(df, shape[1], 3):
        return groups.by_group(work, by, ["p", "m", "t", "ok"], _mmc_of_group, "value double", shape=shape)
    z = with_rank_gauss(work, [*by, "ok"], {"zp": "p", "zm": "m"}, shape=shape)
    return z.groupBy(*by).agg(_mmc_value())


def _good(held: dict[str, np.ndarray], columns: str) -> tuple[np.ndarray, ...]:
    ok = held["ok"].astype(bool)
    return tuple(held[c][ok] for c in columns)


def _power_corr(x: np.ndarray, y: np.ndarray) -> float:
    return groups.corr(groups.signed_power(x), groups.signed_power(y))


def _mmc_of_group(held: dict[str, np.ndarray]) -> dict[str, float]:
    p, m, t = _good(held, "pmt")
    if not groups.varies(p, m, t):
        return {"value": 0.0}
    return {"value": _mmc_of(groups.rank_gauss(p), groups.rank_gauss(m), t)}


def _mmc_of(zp: np.ndarray, zm: np.ndarray, t: np.ndarray) -> float:
    n, energy = t.size, zm @ zm
    if energy == 0.0:
        return 0.0
    centred_p = zp @ t - t.sum() * zp.sum() / n
    centred_m = zm @ t - t.sum() * zm.sum() / n
    value = (centred_p - zp @ zm / energy * centred_m) / n
    value = float(value * (4.0 if t.min() >= 0.0 and t.max() <= 1.0 else 1.0))
    return value if np.isfinite(value) else 0.0


def _core_of_group(held: dict[str, np.ndarray]) -> dict[str, float]:
    p, m, t = (held[c] for c in "pmt")
    vp, vm, vt = (groups.varies(c) for c in (p, m, t))
    zp, zm = (groups.rank_gauss(c) for c in (p, m))
    y = t - t.mean()
    return {
        "corr": _power_corr(zp, y) if vp and vt else 0.0,
        "meta_corr": _power_corr(zm, y) if vm and vt else 0.0,
        "mmc": _mmc_of(zp, zm, t) if vp and vm and vt else 0.0,
        "cwmm": _power_corr(zp, zm) if vp and vm else 0.0,
    }


def _bmc_of_group(held: dict[str, np.ndarray]) -> dict[str, float | bool]:
    return {**_mmc_of_group(held), "covered": bool(np.isfinite(held["m"]).any())}


def _cwmm_of_group(held: dict[str, np.ndarray]) -> dict[str, float | bool]:
    p, m = _good(held, "pm")
    value = _power_corr(groups.rank_gauss(p), groups.rank_gauss(m)) if groups.varies(p, m) else 0.0
    return {"value": value, "covered": bool(np.isfinite(held["m"]).any())}



def _mmc_value() -> Column:
    zp, zm, t = (F.when(F.col("ok"), F.col(c)) for c in ("zp", "zm", "t"))
    n = F.count(t)
    centred_p = F.sum(zp * t) - F.sum(t) * F.sum(zp) / n
    centred_m = F.sum(zm * t) - F.sum(t) * F.sum(zm) / n
    slope = ratio(F.sum(zp * zm), F.sum(zm * zm))
    in_unit = F.bool_and(F.when(F.col("ok"), F.col("t").between(0.0, 1.0)))
    value = (centred_p - slope * centred_m) / n * F.when(in_unit, 4.0).otherwise(1.0)
    return _score(_varies(["p", "m", "t"]), value)


def core_scores(
    df: DataFrame, pred: str, meta: str, target: str, by: Sequence[str] = ("era",)
) -> DataFrame:
    """(by, corr, meta_corr, mmc, cwmm) in one pass: the normal scores of prediction and
    meta model are computed once for all four. Only for rows on which all three columns
    are finite, where the four scores use the same rows."""
    work = _usable(df, by, {"p": pred, "m": meta, "t": target})
    shape = group_shape(df, by)
    if groups.fits_task(df, shape[1], 3):
        types = "corr double, meta_corr double, mmc double, cwmm double"
        return groups.by_group(work, by, ["p", "m", "t"], _core_of_group, types, shape=shape)
    z = with_rank_gauss(
        work, by, {"zp": "p", "zm": "m"}, stats={"t_mean": F.avg("t")}, shape=shape
    )
    x, y, t = signed_power(F.col("zp")), signed_power(F.col("zm")), signed_power(F.col("t") - F.col("t_mean"))
    scores = {
        "corr": _score(_varies(["p", "t"]), raw_corr(x, t)),
        "meta_corr": _score(_varies(["m", "t"]), raw_corr(y, t)),
        "mmc": _mmc_value(),
        "cwmm": _score(_varies(["p", "m"]), raw_corr(x, y)),
    }
    return z.groupBy(*by).agg(*[score.alias(name) for name, score in scores.items()])


def all_rows_finite(df: DataFrame, columns: Sequence[str]) -> bool:
    return df.where(~all_finite(columns)).limit(1).count() == 0


def coverage_eras(df: DataFrame, column: str, by: Sequence[str] = ("era",)) -> DataFrame:
    """Groups in which ``column`` has at least one finite value."""
    return (
        df.groupBy(*by)
        .agg(F.count_if(is_finite(column)).alias("n_covered"))
        .where(F.col("n_covered") > 0)
    )


def require_overlap(df: DataFrame, column: str, era: str, minimum: int) -> None:
    covered = coverage_eras(df, column, [era]).count()
    if covered < minimum:
        raise NonVacuityError(f"{covered} eras have {column}; at least {minimum} are required")


def per_era_bmc(
    df: DataFrame,
    pred: str,
    benchmark: str,
    target: str,
    by: Sequence[str] = ("era",),
    min_overlap_eras: int = MIN_OVERLAP_ERAS,
) -> DataFrame:
    """Contribution over a benchmark, on the eras the benchmark covers."""
    if min_overlap_eras > 0:
        require_overlap(df, benchmark, by[-1], min_overlap_eras)
    work = _usable(df, by, {"p": pred, "m": benchmark, "t": target})
    covered = F.bool_or(is_finite("m"))
    shape = group_shape(df, by)
    if groups.fits_task(df, shape[1], 3):
        found = groups.by_group(work, by, ["p", "m", "t", "ok"], _bmc_of_group, "value double, covered boolean", shape=shape)
        return found.where("covered").drop("covered")
    z = with_rank_gauss(work, [*by, "ok"], {"zp": "p", "zm": "m"}, shape=shape)
    return (
        z.groupBy(*by).agg(_mmc_value(), covered.alias("covered")).where("covered").drop("covered")
    )


def per_era_cwmm(
    df: DataFrame,
    pred: str,
    meta: str,
    by: Sequence[str] = ("era",),
    min_overlap_eras: int = MIN_OVERLAP_ERAS,
) -> DataFrame:
    """Correlation with the meta model, both sides as signed 1.5 powers of normal scores."""
    if min_overlap_eras > 0:
        require_overlap(df, meta, by[-1], min_overlap_eras)
    work = _usable(df, by, {"p": pred, "m": meta})
    shape = group_shape(df, by)
    if groups.fits_task(df, shape[1], 2):
        found = groups.by_group(work, by, ["p", "m", "ok"], _cwmm_of_group, "value double, covered boolean", shape=shape)
        return found.where("covered").drop("covered")
    z = with_rank_gauss(work, [*by, "ok"], {"zp": "p", "zm": "m"}, shape=shape)
    x = F.when(F.col("ok"), signed_power(F.col("zp")))
    y = F.when(F.col("ok"), signed_power(F.col("zm")))
    covered = F.bool_or(is_finite("m"))
    return (
        z.groupBy(*by)
        .agg(_score(_varies(["p", "m"]), raw_corr(x, y)), covered.alias("covered"))
        .where("covered")
        .drop("covered")
    )


def per_era_fnc(
    df: DataFrame, pred: str, features: Sequence[str], target: str, by: Sequence[str] = ("era",)
) -> DataFrame:
    """Feature-neutral correlation: the normal score loses its linear projection on
    the features and a constant, then scores as in :func:`per_era_corr`."""
    flat = F.array(*[F.col(c).cast("double") for c in features])
    work = df.select(
        *by,
        F.col(pred).cast("double").alias("p"),
        F.col(target).cast("double").alias("t"),
        flat.alias("features"),
    ).withColumn("ok", all_finite(["p", "t"]) & F.forall("features", is_finite))
    shape = group_shape(df, by)
    scored = with_rank_gauss(work, [*by, "ok"], {"z": "p"}, shape=shape)
    scored = scored.withColumn("z_ok", F.when(F.col("ok"), F.col("z")))
    fitted = project(scored, "z_ok", "features", [*by, "ok"], usable="ok", shape=shape)
    residual = fitted.withColumn("residual", F.col("z_ok") - F.col("fit"))
    # a residual that is rounding noise of an exact fit counts as constant
    residual = residual.withColumn(
        "residual", F.when(F.abs("residual") > 1e-9, F.col("residual")).when(F.col("ok"), 0.0)
    )
    return per_era_corr_or_zero(residual, "residual", "t", by, shape)


def per_era_fnc_models(
    predictions: DataFrame, rows: DataFrame, features: str | Sequence[str], target: str, name: str = "model_id"
) -> DataFrame:
    """:func:`per_era_fnc` of many models: (model, era, value). ``predictions`` is long
    (``name``, era, id, prediction); ``rows`` has target and features once per (era, id).
    The features never travel with the models: where one task may hold them all, an era's
    rows meet the models' predictions in it; for larger eras and many models, scores are
    put together per row and the features of an era are factored once for all of them
    (``neutralize.fit_models``)."""
    work = predictions.select(F.col(name).cast("string").alias(name), "era", "id", F.col("prediction").cast("double").alias("p"))
    complete = complete_features(rows, features, target)
    dealt = groups.models_a_task(work, complete, 1, _width(complete), name)
    if dealt[1] >= len(dealt[0]):

        def scores(models: list, t: np.ndarray, x: np.ndarray) -> list[dict]:
            return [{"value": v} for v in neutral_scores(models, t, x)]

        return groups.by_models(work, complete, ["p"], name, dealt, scores, "value double")
    usable = rows.select("era", "id", F.col(target).cast("double").alias("t"), feature_vector(features).alias("x"))
    usable = usable.where(is_finite("t") & F.coalesce(F.forall("x", is_finite), F.lit(False)))
    listed = predictions.select(F.col(name).cast("string").alias(name), "era", "id", F.col("prediction").cast("double").alias("p"))
    known = listed.where(is_finite("p")).join(usable.select("era", "id"), ["era", "id"], "left_semi")
    ranked = with_rank_gauss(known, [name, "era"], {"z": "p"}, shape=group_shape(known, [name, "era"]))
    together = ranked.groupBy("era", "id").agg(F.sort_array(F.collect_list(F.struct(name, "z", "p"))).alias("scores"))
    wide = materialize(together.join(usable, ["era", "id"]), "model-rows")
    fits = fit_models(wide, "x", name)
    coefficients = fits.groupBy("era").agg(
        F.map_from_entries(F.collect_list(F.struct("model", F.struct("coefficients", "flat")))).alias("fits")
    )
    placed = wide.join(broadcast_checked(coefficients), "era")

    def residual(score: Column) -> Column:
        fit = F.col("fits")[score[name]]
        rest = score["z"] - F.when(fit["flat"], F.lit(0.0)).otherwise(fitted_value(fit["coefficients"], F.col("x")))
        # a residual that is rounding noise of an exact fit counts as constant
        return F.struct(score[name].alias(name), score["p"].alias("p"), F.when(F.abs(rest) > 1e-9, rest).otherwise(0.0).alias("residual"))

    rest = placed.select("era", "t", F.explode(F.transform("scores", residual)).alias("r"))
    rest = rest.select("era", "t", "r.*", F.lit(True).alias("ok"))
    by = [name, "era"]
    shape = (group_shape(known, by)[0], group_shape(known, by)[1])
    scored = per_era_corr_or_zero(rest, "residual", "t", by, shape)
    every = listed.select(name, "era").distinct()
    return every.join(scored, by, "left").select(*by, F.coalesce("value", F.lit(0.0)).alias("value"))


def complete_features(rows: DataFrame, features: str | Sequence[str], target: str) -> DataFrame:
    """(era, id, t, x) of the rows whose features are all finite."""
    listed = rows.select("era", "id", F.col(target).cast("double").alias("t"), feature_vector(features).alias("x"))
    return listed.where(F.coalesce(F.forall("x", is_finite), F.lit(False)))


def _width(rows: DataFrame) -> int:
    first = rows.select(F.size("x").alias("n")).first()
    return first["n"] if first else 0


def _residuals(
    models: list[tuple[dict[str, np.ndarray], np.ndarray]], known: np.ndarray, x: np.ndarray, side: Callable[[np.ndarray], np.ndarray]
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(model, places, predictions, what is left of their ``side`` beside the features) of
    the models with two ``known`` rows or more. Models that share their rows share one
    factorization."""
    held, sets = [], {}
    for i, (columns, place) in enumerate(models):
        p = columns["p"]
        ok = np.isfinite(p) & (place >= 0)
        ok[ok] = known[place[ok]]
        order = np.argsort(place[ok], kind="stable")
        at, p = place[ok][order], p[ok][order]
        held.append((at, p, side(p) if p.size else p))
        sets.setdefault(at.tobytes(), []).append(i)
    for members in sets.values():
        at = held[members[0]][0]
        if at.size < 2:
            continue
        design = np.column_stack([x[at], np.ones(at.size)])
        sides = np.column_stack([held[i][2] for i in members])
        solution = _solved(_fold([np.hstack([design, sides])]), design.shape[1])
        for k, i in enumerate(members):
            _, p, z = held[i]
            # column by column, so that equal rows have equal residuals
            fit = np.zeros(at.size)
            if groups.varies(z):
                for j in range(design.shape[1]):
                    fit += solution[j, k] * design[:, j]
            yield i, at, p, z - fit


def neutral_scores(models: list[tuple[dict[str, np.ndarray], np.ndarray]], t: np.ndarray, x: np.ndarray) -> list[float]:
    """:func:`per_era_fnc` of one era's models (predictions ``p``, places in ``x``)."""
    out = [0.0] * len(models)
    for i, at, p, rest in _residuals(models, np.isfinite(t), x, groups.rank_gauss):
        y = t[at]
        # a residual that is rounding noise of an exact fit counts as constant
        rest[np.abs(rest) <= 1e-9] = 0.0
        if groups.varies(rest, y, p):
            out[i] = _power_corr(groups.rank_gauss(rest), y - y.mean())
    return out


def plain_and_neutral_ic(
    models: list[tuple[dict[str, np.ndarray], np.ndarray]], t: np.ndarray, x: np.ndarray
) -> list[dict[str, float | None]]:
    """Correlation of each model's predictions with the target, before and after they lose
    their projection on the features; None where the target is constant. NaN is a value
    like others to the first, which is then 0.0; the second leaves such rows out."""
    out = []
    for columns, place in models:
        p, y = columns["p"][place >= 0], t[place[place >= 0]]
        gaps = np.isnan(y)
        varies = not gaps.all() if gaps.any() else groups.varies(y)
        out.append({"ic": groups.corr(p, y) if varies and y.size >= 2 else None, "neutral": None})
    for i, at, _, rest in _residuals(models, np.isfinite(t) & np.isfinite(x).all(axis=1), x, lambda p: p):
        if groups.varies(t[at]):
            out[i]["neutral"] = groups.corr(rest, t[at])
    return out


def largest_exposure(p: np.ndarray, place: np.ndarray, x: np.ndarray) -> float | None:
    """The largest size of a correlation of ``p`` with a feature; None without a row."""
    ok = np.isfinite(p) & (place >= 0)
    if not ok.any():
        return None
    held, p = x[place[ok]], p[ok]
    return max((abs(groups.corr(p, held[:, j])) for j in range(held.shape[1])), default=0.0)


def card_scores(
    models: list[tuple[dict[str, np.ndarray], np.ndarray]], t: np.ndarray, x: np.ndarray
) -> list[dict[str, float | bool | None]]:
    """Every score of a card of one era's models: columns are the prediction ``p``, the meta
    model ``m``, the target ``y`` and, where they are known, the benchmark ``b`` and the
    targets ``short`` and ``long`` of two horizons. Each score uses the rows on which its
    own columns are finite; one that has no value is None."""
    out = []
    for (columns, place), fnc in zip(models, neutral_scores(models, t, x), strict=True):
        finite = {c: np.isfinite(v) for c, v in columns.items()}
        known: dict[tuple[str, bytes], np.ndarray] = {}

        def normal(c: str, ok: np.ndarray) -> np.ndarray:
            key = (c, ok.tobytes())
            if key not in known:
                known[key] = groups.rank_gauss(columns[c][ok])
            return known[key]

        def corr(c: str, target: str) -> float:
            ok = finite[c] & finite[target]
            y = columns[target][ok]
            return _power_corr(normal(c, ok), y - y.mean()) if groups.varies(columns[c][ok], y) else 0.0

        def mmc(other: str) -> float:
            ok = finite["p"] & finite[other] & finite["y"]
            p, m, y = (columns[c][ok] for c in ("p", other, "y"))
            return _mmc_of(normal("p", ok), normal(other, ok), y) if groups.varies(p, m, y) else 0.0

        def cwmm() -> float:
            ok = finite["p"] & finite["m"]
            varies = groups.varies(columns["p"][ok], columns["m"][ok])
            return _power_corr(normal("p", ok), normal("m", ok)) if varies else 0.0

        whole = finite["p"] & finite["m"] & finite["y"] & (place >= 0)
        cells = {
            "corr": corr("p", "y"), "meta_corr": corr("m", "y"), "mmc": mmc("m"), "fnc": fnc,
            "cwmm": cwmm() if finite["m"].any() else None,
            "bmc": mmc("b") if "b" in columns and finite["b"].any() else None,
            "exposure": largest_exposure(columns["p"], place, x),
            "degenerate": not groups.varies(*[columns[c][whole] for c in ("p", "y", "m")]),
        }
        pairs = {f"{side}_{h}": (c, h) for side, c in (("model", "p"), ("bench", "b")) for h in ("short", "long")}
        resolved = {"b", "short", "long"} <= set(columns) and all((finite[c] & finite[h]).sum() >= 2 for c, h in pairs.values())
        out.append({**cells, **{n: corr(c, h) if resolved else None for n, (c, h) in pairs.items()}})
    return out


CARD_TYPES = ", ".join(
    f"{n} double" for n in ("corr", "meta_corr", "mmc", "fnc", "cwmm", "bmc", "exposure", "model_short", "model_long", "bench_short", "bench_long")
) + ", degenerate boolean"


def per_era_corr_or_zero(df, pred, target, by, shape):
    scored = with_rank_gauss(
        df, [*by, "ok"], {"zr": pred}, count_as="__n2", stats={"t_mean": F.avg(target)}, shape=shape
    )
    x = F.when(F.col("ok"), signed_power(F.col("zr")))
    y = F.when(F.col("ok"), signed_power(F.col(target) - F.col("t_mean")))
    return scored.groupBy(*by).agg(_score(_varies([pred, target, "p"]), raw_corr(x, y)))


def downside_eras(meta_corr: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Eras whose meta-model correlation is strictly below the threshold."""
    return meta_corr.where(F.col("value") < threshold)


def mmc_down(
    mmc: DataFrame, meta_corr: DataFrame, by: Sequence[str] = (), minimum: int = MIN_DOWNSIDE_ERAS
) -> DataFrame:
    """Mean contribution over the downside eras, or a reason for its absence."""
    joined = mmc.join(meta_corr.select("era", F.col("value").alias("meta_value")), "era")
    down = F.col("meta_value") < 0.0
    n = F.count_if(down)
    return joined.groupBy(*by).agg(
        F.when(n >= minimum, F.avg(F.when(down, F.col("value")))).alias("mmc_down"),
        n.alias("mmc_down_n_eras"),
        F.when(n < minimum, F.lit("insufficient_downside_eras")).alias("mmc_down_reason"),
    )


def per_era_pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = ("era",)) -> DataFrame:
    """Plain correlation on the groups where both sides vary; others are absent."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return (
        rows.groupBy(*by)
        .agg(raw_corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("value"))
        .where(F.col("value").isNotNull())
    )


def era_sharpe(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean over population deviation of the per-era plain correlations."""
    series = per_era_pearson(df, x, y, [*by, "era"])
    return series.groupBy(*by).agg(
        (F.avg("value") / (F.stddev_pop("value") + F.lit(1e-12))).alias("era_sharpe"),
        F.count("value").alias("n_eras"),
    )


def per_era_spearman(df: DataFrame, left: str, right: str, by: Sequence[str] = ("era",)) -> DataFrame:
    ranked = with_ranks(df, by, {"rank_left": left, "rank_right": right})
    return ranked.groupBy(*by).agg(
        safe_corr(F.col("rank_left"), F.col("rank_right")).alias("value")
    )


def per_era_spearman_mean(df: DataFrame, left: str, right: str) -> DataFrame:
    return per_era_spearman(df, left, right).agg(
        F.avg("value").alias("mean_spearman"), F.count("value").alias("n_eras")
    )


def era_positions(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Eras with their position among the eras present. The window runs over the
    table of eras, never over the rows."""
    eras = df.select(*by, "era", "era_num").distinct()
    window = Window.partitionBy(*by).orderBy("era_num")
    return eras.withColumn("position", F.row_number().over(window))


def consecutive_pairs(df: DataFrame, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Each id's prediction in an era beside the one in the era before."""
    positions = broadcast_checked(era_positions(df, by))
    rows = df.select(*by, "era", "era_num", "id", F.col(pred).alias("now")).join(
        positions, [*by, "era", "era_num"]
    )
    before = rows.select(
        *by, "id", (F.col("position") + 1).alias("position"), F.col("now").alias("before")
    )
    return rows.join(before, [*by, "id", "position"])


def per_era_turnover(
    df: DataFrame, pred: str, by: Sequence[str] = (), minimum: int = MIN_SHARED_IDS
) -> DataFrame:
    """1 - rank correlation of the ids two consecutive eras share (at least ten)."""
    shape = group_shape(df, [*by, "era"])
    if groups.fits_task(df, 2 * shape[1], 4):
        return _turnover_of_groups(df, pred, by, minimum)
    pairs = consecutive_pairs(df, pred, by)
    group = [*by, "era", "era_num"]
    # the ids two eras share are at most the rows of one of them
    ranked = with_ranks(pairs, group, {"r_now": "now", "r_before": "before"}, shape=shape)
    return (
        ranked.groupBy(*group)
        .agg(
            F.count(F.lit(1)).alias("n_shared"),
            (F.lit(1.0) - safe_corr(F.col("r_now"), F.col("r_before"))).alias("value"),
        )
        .where(F.col("n_shared") >= minimum)
    )


def _turnover_of_groups(df: DataFrame, pred: str, by: Sequence[str], minimum: int) -> DataFrame:
    """Every row goes to its own era and to the next one; a task joins and ranks the two."""
    positions = broadcast_checked(era_positions(df, by))
    rows = df.select(*by, "era", "era_num", "id", F.col(pred).alias("value")).join(positions, [*by, "era", "era_num"])
    later = F.explode(F.array(F.lit(0), F.lit(1))).alias("later")
    rows = rows.where(F.col("id").isNotNull()).select(*by, "position", "id", F.col("value").cast("double").alias("value"), later)
    rows = rows.withColumn("position", F.col("position") + F.col("later"))
    found = groups.by_group(rows, [*by, "position"], ["id", "value", "later"], _turnover_of_group, "n_shared bigint, value double", raw=True)
    found = found.where(F.col("n_shared") >= max(minimum, 1))
    return positions.join(found, [*by, "position"]).select(*by, "era", "era_num", "n_shared", "value")


def _turnover_of_group(held: dict[str, pa.ChunkedArray]) -> dict[str, float | int]:
    later = held["later"].to_numpy().astype(bool)
    table = pa.table({"id": held["id"], "value": held["value"]})
    now, before = table.filter(pa.array(~later)), table.filter(pa.array(later))
    both = now.join(before, "id", join_type="inner", right_suffix="_before", use_threads=False)
    x, y = (_null_first_ranks(both.column(c)) for c in ("value", "value_before"))
    return {"n_shared": both.num_rows, "value": 1.0 - groups.corr(x, y)}


def _null_first_ranks(column: pa.ChunkedArray) -> np.ndarray:
    """Tie-averaged ranks in the order of a window: NULLs, numbers, NaN."""
    x = column.to_numpy()
    kind = np.where(np.isnan(x), 2, 1)
    kind[column.is_null().to_numpy()] = 0
    if (kind == 1).all():
        return groups.average_ranks(x)
    _, dense = np.unique(x[kind == 1], return_inverse=True)
    out = np.where(kind == 0, -1.0, x.size)
    out[kind == 1] = dense
    return groups.average_ranks(out)


def degenerate_eras(
    df: DataFrame,
    pred: str,
    target: str,
    meta: str,
    features: Sequence[str] = (),
    by: Sequence[str] = ("era",),
) -> DataFrame:
    """Groups whose scores fall back to 0.0: under two complete rows or a constant side."""
    work = df.select(*by, *[F.col(c).cast("double").alias(c) for c in {pred, target, meta, *features}])
    work = work.withColumn("ok", all_finite([pred, target, meta, *features]))
    return (
        work.groupBy(*by)
        .agg(
            F.count_if("ok").alias("n_usable"),
            (~F.coalesce(_varies([pred, target, meta]), F.lit(False))).alias("degenerate"),
        )
        .where("degenerate")
        .drop("degenerate")
    )
