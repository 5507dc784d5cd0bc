"""Dataset shape, target and feature statistics, information coefficients, screens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eraflow.functions.ranks import group_shape, with_ranks
from eraflow.functions.stats import (
    finite_or,
    is_finite,
    none_null,
    raw_corr,
    safe_corr,
    weighted_corr,
)
from eraflow.operators import inference
from eraflow.operators.normal import cross_correlations
from eraflow.operators.series import with_era_num
from eraflow.session import broadcast_rows, materialize

MIN_MEAN_CORR = 0.01
MAX_ABS_DECAY = 0.001
FDR_Q = 0.05


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], value: str) -> DataFrame:
    """Long form by position: one row (keys, k, value) per key and column. Positions are
    cheaper to group by than names; :func:`labelled` puts the names back at the end."""
    cells = F.array(*[F.col(c).cast("double") for c in columns])
    return df.select(*keys, F.posexplode(cells).alias("k", value))


def labelled(df: DataFrame, columns: Sequence[str], name: str, position: str = "k") -> DataFrame:
    labels = F.array(*[F.lit(c) for c in columns])
    others = [c for c in df.columns if c != position]
    return df.select(F.get(labels, F.col(position)).alias(name), *others)


# -- shape ------------------------------------------------------------------


def describe_splits(df: DataFrame, split: str = "split") -> DataFrame:
    per_era = df.groupBy(split, "era", "era_num").agg(F.count(F.lit(1)).alias("rows"))
    shape = per_era.groupBy(split).agg(
        F.sum("rows").alias("n_rows"),
        F.count(F.lit(1)).alias("n_eras"),
        F.min_by("era", "era_num").alias("min_era"),
        F.max_by("era", "era_num").alias("max_era"),
        F.min("rows").alias("rows_per_era_min"),
        F.percentile("rows", 0.5).alias("rows_per_era_median"),
        F.max("rows").alias("rows_per_era_max"),
        F.avg("rows").alias("rows_per_era_mean"),
        F.stddev_pop("rows").alias("rows_per_era_std"),
    )
    ids = df.select(split, "id").distinct().groupBy(split).agg(F.count(F.lit(1)).alias("n_ids"))
    return shape.join(ids, split)


def era_structure(df: DataFrame) -> DataFrame:
    """Rows and distinct ids per era; ``gap`` marks a jump in the numbering."""
    rows = df.groupBy("era", "era_num", "id").agg(F.count(F.lit(1)).alias("c"))
    per = rows.groupBy("era", "era_num").agg(
        F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_ids")
    )
    before = F.lag("era_num").over(Window.orderBy("era_num"))
    return per.withColumn(
        "gap", F.coalesce(F.col("era_num") != before + 1, F.lit(False))
    )


def target_profile(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    long = unpivot(df, ["era"], targets, "v")
    value = F.when(is_finite("v"), F.col("v"))
    per_era = long.groupBy("k", "era").agg(
        F.avg(value).alias("m"),
        ((F.count(value) >= 2) & (F.min(value) == F.max(value))).alias("flat"),
    )
    eras = per_era.groupBy("k").agg(
        F.count("m").alias("n_eras_present"),
        F.avg("m").alias("era_mean_mean"),
        F.stddev_pop("m").alias("era_mean_std"),
        F.count_if("flat").alias("zero_variance_era_count"),
    )
    spread = F.min(value) < F.max(value)
    has = F.count(value) > 0
    pooled = long.groupBy("k").agg(
        (F.lit(1.0) - F.count(value) / F.count(F.lit(1))).alias("missing_rate"),
        F.avg(value).alias("pooled_mean"),
        F.stddev_pop(value).alias("pooled_std"),
        F.when(has, F.when(spread, F.skewness(value)).otherwise(0.0)).alias("pooled_skew"),
        F.when(has, F.when(spread, F.kurtosis(value)).otherwise(0.0)).alias("pooled_kurtosis"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    return labelled(pooled.join(eras, "k"), targets, "target")


def target_correlation(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Mean over eras of the rank correlation of each target pair, on rows where both
    are finite; eras where either side is constant do not count."""
    pairs = [
        F.struct(
            F.lit(a).alias("target_a"),
            F.lit(b).alias("target_b"),
            F.col(a).cast("double").alias("va"),
            F.col(b).cast("double").alias("vb"),
        )
        for i, a in enumerate(targets)
        for b in targets[i + 1 :]
    ]
    keys = ["target_a", "target_b", "era"]
    long = df.select("era", F.explode(F.array(*pairs)).alias("p")).select("era", "p.*")
    both = is_finite("va") & is_finite("vb")
    # targets have few distinct values: count value pairs before any ordering
    cells = (
        long.withColumn("ok", both)
        .groupBy(*keys, "ok", F.when(both, F.col("va")).alias("va"), F.when(both, F.col("vb")).alias("vb"))
        .agg(F.count(F.lit(1)).alias("w"))
    )
    eras, largest = group_shape(df, ["era"])
    ranked = with_ranks(
        cells, [*keys, "ok"], {"ra": "va", "rb": "vb"}, weight="w", shape=(2 * eras * len(pairs), largest)
    )
    used = ranked.where("ok")
    per_era = used.groupBy(*keys).agg(
        weighted_corr(F.col("ra"), F.col("rb"), F.col("w")).alias("corr"),
        ((F.min("va") < F.max("va")) & (F.min("vb") < F.max("vb"))).alias("varies"),
    )
    return per_era.groupBy("target_a", "target_b").agg(
        F.avg(F.when(F.col("varies"), F.col("corr"))).alias("mean_corr"),
        F.count_if("varies").alias("n_eras"),
    )


def nulls_per_era(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    return df.groupBy("era").agg(*[F.count_if(F.col(t).isNull()).alias(t) for t in targets])


# -- information coefficients ------------------------------------------------


def ic_by_era(df: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Per-era plain and rank correlation of every feature with every target.

    Rows need every listed column; an era whose target has under two finite values or
    only one value is flagged and scores zero. Binned features (an estimate says there
    are few values an era) are counted with the targets on the map side
    (``counted_ic``); features of many values are ranked once (``ranked_ic``).
    """
    df = with_era_num(df)
    if "id" not in df.columns:
        return counted_ic(df, features, targets)
    values = [F.col(f).cast("double") for f in features]
    some = df.where(none_null([*features, *targets])).select(
        "era", F.exists(F.array(*values), F.isnan).alias("nan"),
        F.explode(F.array(*[F.xxhash64(F.lit(i), v) for i, v in enumerate(values)])).alias("v"),
    )
    found = some.agg(F.approx_count_distinct(F.xxhash64("era", "v")).alias("cells"), F.bool_or("nan").alias("nan")).first()
    if found["cells"] <= broadcast_rows(df.sparkSession) or found["nan"]:
        return counted_ic(df, features, targets)
    return ranked_ic(df, features, targets)


def _ic_grid(df: DataFrame, features: Sequence[str], targets: Sequence[str], scored: DataFrame) -> DataFrame:
    """A row for every target, era and feature from (t, era, f, ic, spearman_ic, varies)."""
    names = [F.array(*[F.lit(c) for c in columns]) for columns in (targets, features)]
    grid = (
        df.select("era", "era_num")
        .distinct()
        .select("*", F.posexplode(names[0]).alias("t", "target"))
        .select("*", F.posexplode(names[1]).alias("f", "feature"))
    )
    varies = F.coalesce("varies", F.lit(False))
    return grid.join(scored, ["t", "era", "f"], "left").select(
        "target",
        "era",
        "era_num",
        "feature",
        F.when(varies, F.col("ic")).otherwise(0.0).alias("ic"),
        F.when(varies, F.col("spearman_ic")).otherwise(0.0).alias("spearman_ic"),
        (~varies).alias("degenerate"),
    )


def ranked_ic(df: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """:func:`ic_by_era` for features of many values. Targets that are finite on the same
    rows share the features' ranks, taken once in long form and put together again per
    row; values and ranks then meet the targets as products folded in the tasks. No table
    has rows x features x targets. Features must be finite."""
    df = with_era_num(df)
    rows = df.where(none_null([*features, *targets]))
    marks = rows.agg(*[
        F.struct(F.count_if(is_finite(t)), F.bit_xor(F.when(is_finite(t), F.xxhash64("era", "id")))).cast("string").alias(f"m{i}")
        for i, t in enumerate(targets)
    ]).first()
    groups: dict[str, list[int]] = {}
    for i in range(len(targets)):
        groups.setdefault(marks[f"m{i}"], []).append(i)
    out = None
    for members in groups.values():
        part = _ranked_ic_of(rows.where(is_finite(targets[members[0]])), features, [targets[i] for i in members])
        part = part.withColumn("t", F.get(F.array(*[F.lit(i) for i in members]), F.col("t")))
        out = part if out is None else out.unionByName(part)
    return _ic_grid(df, features, targets, out)


def _ranked_ic_of(rows: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """(t, era, f, ic, spearman_ic, varies) of targets that are finite on all rows."""
    n = len(features)
    columns = [*features, *targets]
    wide = rows.select("era", "id", F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))
    eras, largest = group_shape(wide, ["era"])
    long = wide.select("era", "id", F.posexplode("v").alias("i", "x"))
    ranked = with_ranks(long, ["era", "i"], {"r": "x"}, shape=(eras * len(columns), largest))
    both = ranked.groupBy("era", "id").agg(F.sort_array(F.collect_list(F.struct("i", "x", "r"))).alias("c"))
    both = materialize(both.select("era", F.col("c.x").alias("v"), F.col("c.r").alias("r")), "ranked-rows")
    parts = {}
    for name in ("v", "r"):
        sides = both.select("era", F.slice(name, 1, n).alias("x"), F.slice(name, n + 1, len(targets)).alias("y"))
        parts[name] = cross_correlations(sides, "x", "y")
    last = F.explode(F.transform(F.slice("v", n + 1, len(targets)), lambda y, t: F.struct(t.alias("t"), y.alias("y")))).alias("c")
    varies = both.select("era", last).groupBy("era", "c.t").agg((F.min("c.y") < F.max("c.y")).alias("varies"))
    plain = parts["v"].withColumnRenamed("corr", "ic")
    return plain.join(parts["r"].withColumnRenamed("corr", "spearman_ic"), ["era", "f", "t"]).join(varies, ["era", "t"])


def counted_ic(df: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """:func:`ic_by_era` from counts: rows are counted per (era, target, feature, feature
    value, target value) on the map side, and everything else happens on that table,
    which for binned features has a handful of rows per era however long the era is."""
    df = with_era_num(df)
    # positions instead of names keep the keys of the big aggregation small
    rows = df.where(none_null([*features, *targets])).select(
        "era",
        F.posexplode(F.array(*[F.col(f).cast("double") for f in features])).alias("f", "x"),
        F.array(*[F.col(t).cast("double") for t in targets]).alias("ys"),
    )
    keys = ["t", "era", "f"]
    cells = (
        rows.select("era", "f", "x", F.posexplode("ys").alias("t", "y"))
        .where(is_finite("y"))
        .groupBy(*keys, "x", "y")
        .agg(F.count(F.lit(1)).alias("w"))
    )
    weight = F.col("w")
    eras, largest = group_shape(df, ["era"])
    ranked = with_ranks(
        cells,
        keys,
        {"rx": "x", "ry": "y"},
        weight="w",
        count_as="n",
        stats={"sx": F.sum(F.col("x") * F.col("w"))},
        shape=(eras * len(features) * len(targets), largest),
    ).withColumn("mx", F.col("sx") / F.col("n"))
    scored = ranked.groupBy(*keys).agg(
        weighted_corr(F.col("x") - F.col("mx"), F.col("y"), weight).alias("ic"),
        F.when(F.bool_or(F.isnan("x")), F.lit(0.0))
        .otherwise(weighted_corr(F.col("rx"), F.col("ry"), weight))
        .alias("spearman_ic"),
        (F.min("y") < F.max("y")).alias("varies"),
    )
    return _ic_grid(df, features, targets, scored)


def vector_ic_by_era(df: DataFrame, vector: str, target: str) -> DataFrame:
    """Plain correlation of every component of an array column with the target. The
    unpivot is folded into partial aggregates before anything is shuffled."""
    long = df.where(is_finite(target)).select(
        "era", F.col(target).cast("double").alias("y"), F.posexplode(vector).alias("feature", "x")
    )
    return long.groupBy("era", "feature").agg(
        safe_corr(F.col("x").cast("double"), F.col("y")).alias("ic")
    )


def feature_summary(df: DataFrame, features: Sequence[str]) -> DataFrame:
    long = unpivot(df, [], features, "v")
    value = F.when(is_finite("v"), F.col("v"))
    return labelled(long.groupBy("k").agg(*moments(value)), features, "feature")


def moments(value: Column) -> list[Column]:
    """Pooled moments; Spark merges the partial states, so this also works per batch."""
    has, spread = F.count(value) > 0, F.min(value) < F.max(value)
    return [
        F.avg(value).alias("pooled_mean"),
        F.stddev_pop(value).alias("pooled_std"),
        F.when(has, F.when(spread, F.skewness(value)).otherwise(0.0)).alias("pooled_skew"),
        F.when(has, F.when(spread, F.kurtosis(value)).otherwise(0.0)).alias("pooled_kurtosis"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        (F.lit(1.0) - F.count(value) / F.count(F.lit(1))).alias("missing_rate"),
    ]


def ic_by_split(ic: DataFrame, train_max_era: int, val_min_era: int) -> DataFrame:
    """Mean IC on either side of the boundary and their difference."""
    if train_max_era >= val_min_era:
        raise ValueError("train_max_era must be below val_min_era")
    clean = ic.where(~F.col("degenerate"))

    def side(condition: Column, prefix: str) -> DataFrame:
        return clean.where(condition).groupBy("target", "feature").agg(
            F.avg("ic").alias(f"{prefix}_mean_ic"), F.count("ic").alias(f"{prefix}_n_eras")
        )

    train = side(F.col("era_num") <= train_max_era, "train")
    val = side(F.col("era_num") >= val_min_era, "val")
    return train.join(val, ["target", "feature"], "full").withColumn(
        "delta_ic", F.col("val_mean_ic") - F.col("train_mean_ic")
    )


# -- screens -------------------------------------------------------------------


def stability_screen(
    ic: DataFrame,
    min_mean_corr: float = MIN_MEAN_CORR,
    max_abs_decay: float = MAX_ABS_DECAY,
) -> DataFrame:
    """Mean, deviation, linear trend and half-to-half variance of each feature's IC
    over the valid eras. The gate on the mean is signed."""
    keys = ["target", "feature"]
    group = Window.partitionBy(*keys)
    valid = (
        ic.where(~F.col("degenerate"))
        .withColumn("i", (F.row_number().over(group.orderBy("era_num")) - 1).cast("double"))
        .withColumn("half", F.floor(F.count(F.lit(1)).over(group) / 2))
    )
    first = F.coalesce(F.avg(F.when(F.col("i") < F.col("half"), F.col("ic"))), F.lit(0.0))
    second = F.avg(F.when(F.col("i") >= F.col("half"), F.col("ic")))
    stats = valid.groupBy(*keys).agg(
        F.avg("ic").alias("mean_corr"),
        F.stddev_pop("ic").alias("corr_std"),
        F.when(F.count("ic") >= 2, F.regr_slope("ic", "i")).otherwise(0.0).alias("decay_slope"),
        (F.lit(0.25) * F.pow(first - second, 2)).alias("cross_regime_variance"),
        F.avg("spearman_ic").alias("mean_spearman"),
        F.count("ic").alias("n_eras"),
    )
    out = ic.select(*keys).distinct().join(stats, keys, "left")
    out = out.withColumn("n_eras", F.coalesce("n_eras", F.lit(0)))
    return out.withColumn("stable", is_stable(min_mean_corr, max_abs_decay))


def is_stable(min_mean_corr: float, max_abs_decay: float) -> Column:
    return F.coalesce(
        (F.col("mean_corr") >= min_mean_corr)
        & (F.abs("decay_slope") <= max_abs_decay)
        & (F.col("n_eras") >= 2),
        F.lit(False),
    )


def select_stable(
    screen: DataFrame,
    min_mean_corr: float = MIN_MEAN_CORR,
    max_abs_decay: float = MAX_ABS_DECAY,
) -> DataFrame:
    return screen.where(is_stable(min_mean_corr, max_abs_decay)).select("target", "feature")


def nonlinear_flag(threshold: float = MIN_MEAN_CORR) -> Column:
    """Rank correlation above the threshold where the plain one is not."""
    both = is_finite("mean_corr") & is_finite("mean_spearman")
    return F.coalesce(
        both & (F.abs("mean_corr") <= threshold) & (F.abs("mean_spearman") > threshold),
        F.lit(False),
    )


def full_screen(
    ic: DataFrame,
    *,
    n_boot: int = 1000,
    seed: int = 0,
    min_mean_corr: float = MIN_MEAN_CORR,
    max_abs_decay: float = MAX_ABS_DECAY,
) -> DataFrame:
    """Stability screen plus bootstrap interval, p-value and false-discovery control
    per target. A feature is stable if it passes the point gates, its interval
    excludes zero and its q-value is at most 5 %."""
    keys = ["target", "feature"]
    base = stability_screen(ic, min_mean_corr, max_abs_decay)
    horizon = inference.horizon_of(F.col("target"))
    series = ic.where(~F.col("degenerate")).select(*keys, "era_num", F.col("ic").alias("value"))
    tested = inference.mean_interval(
        series, keys, horizon, short="one_block", n_boot=n_boot, seed=seed
    ).select(
        *keys,
        F.col("ci_low").alias("mean_corr_ci_lo"),
        F.col("ci_high").alias("mean_corr_ci_hi"),
        "p_value",
    )
    known = inference.benjamini_hochberg(
        tested.where(F.col("p_value").isNotNull()), by=["target"], order=["feature"]
    )
    low, high = F.col("mean_corr_ci_lo"), F.col("mean_corr_ci_hi")
    excludes = F.coalesce(((low > 0) & (high > 0)) | ((low < 0) & (high < 0)), F.lit(False))
    passes = F.coalesce(F.col("fdr_q") <= FDR_Q, F.lit(False))
    return (
        base.join(known, keys, "left")
        .withColumn("ci_excludes_zero", excludes)
        .withColumn("fdr_pass", passes)
        .withColumn("nonlinear", nonlinear_flag(min_mean_corr))
        .withColumn("stable", F.col("stable") & F.col("ci_excludes_zero") & F.col("fdr_pass"))
    )


def riskiest_features(screen: DataFrame, count: int) -> DataFrame:
    """The ``count`` features whose IC moved most between the halves of history."""
    order = [F.desc_nulls_last("cross_regime_variance"), F.asc("feature")]
    return screen.orderBy(*order).limit(count).select("feature", "cross_regime_variance")


def feature_metrics(ic: DataFrame) -> DataFrame:
    """Summary of each feature's IC series: mean, deviation, ratio, drawdown, half delta."""
    from eraflow.operators.series import summarize

    keys = ["target", "feature"]
    series = ic.where(~F.col("degenerate")).select(*keys, "era", "era_num", F.col("ic").alias("value"))
    group = Window.partitionBy(*keys)
    halves = (
        series.withColumn("i", F.row_number().over(group.orderBy("era_num")) - 1)
        .withColumn("half", F.floor(F.count(F.lit(1)).over(group) / 2))
        .groupBy(*keys)
        .agg(
            (
                F.avg(F.when(F.col("i") >= F.col("half"), F.col("value")))
                - F.avg(F.when(F.col("i") < F.col("half"), F.col("value")))
            ).alias("half_delta")
        )
    )
    return summarize(series, keys).join(halves, keys)


def derived_sets(train_screen: DataFrame, drift: DataFrame) -> DataFrame:
    """Feature sets built from the train-side screen: stable, nonlinear, their union,
    and the union without drifted features."""
    stable = train_screen.where("stable").select(F.lit("stable").alias("feature_set"), "feature")
    nonlinear = train_screen.where("nonlinear").select(
        F.lit("nonlinear").alias("feature_set"), "feature"
    )
    union = (
        stable.unionByName(nonlinear).select("feature").distinct()
        .select(F.lit("stable_or_nonlinear").alias("feature_set"), "feature")
    )
    drifted = drift.where("drifted").select("feature")
    kept = union.join(drifted, "feature", "left_anti").select(
        F.lit("stable_or_nonlinear_undrifted").alias("feature_set"), "feature"
    )
    return stable.distinct().unionByName(nonlinear.distinct()).unionByName(union).unionByName(kept)


# -- exposure and context ----------------------------------------------------


def exposure_by_era(df: DataFrame, pred: str, features: Sequence[str]) -> DataFrame:
    """Plain correlation of the prediction with each feature, per era. Eras without a
    complete row score zero."""
    ok = none_null([pred, *features])
    work = unpivot(df.withColumn("__p", F.when(ok, F.col(pred).cast("double"))), ["era", "__p"], features, "v")
    value = F.when(F.col("__p").isNotNull(), F.col("v"))
    per = work.groupBy("era", "k").agg(safe_corr(F.col("__p"), value).alias("exposure"))
    return labelled(per, features, "feature")


def feature_exposure(df: DataFrame, pred: str, features: Sequence[str]) -> DataFrame:
    return exposure_by_era(df, pred, features).groupBy("feature").agg(
        F.avg(F.abs("exposure")).alias("mean_abs_exposure"),
        F.max(F.abs("exposure")).alias("max_abs_exposure"),
    )


def exposed_volatile_features(
    df: DataFrame, ic: DataFrame, pred: str, features: Sequence[str], count: int
) -> DataFrame:
    """Features with the largest product of exposure and IC volatility."""
    volatility = ic.where(~F.col("degenerate")).groupBy("feature").agg(
        F.stddev_pop("ic").alias("volatility")
    )
    return (
        feature_exposure(df, pred, features)
        .join(volatility, "feature")
        .withColumn("risk", F.col("mean_abs_exposure") * F.col("volatility"))
        .orderBy(F.desc("risk"), F.asc("feature"))
        .limit(count)
        .select("feature", "risk")
    )


def meta_orthogonality(
    df: DataFrame, features: Sequence[str], meta: str, target: str, threshold: float = MIN_MEAN_CORR
) -> DataFrame:
    """Mean per-era correlation of each feature with the meta model and the target;
    ``orthogonal`` features carry target signal the meta model does not."""
    rows = df.where(
        none_null([meta, target, *features])
        & is_finite(meta)
        & is_finite(target)
    )
    m, t = F.col("__m"), F.col("__t")
    sides = {"__m": F.col(meta).cast("double"), "__t": F.col(target).cast("double")}
    per_era = (
        unpivot(rows.withColumns(sides), ["era", "__m", "__t"], features, "x")
        .groupBy("era", "k")
        .agg(
            safe_corr(F.col("x"), m).alias("cm"),
            safe_corr(F.col("x"), t).alias("ct"),
            ((F.count(m) >= 2) & (F.min(m) < F.max(m)) & (F.min(t) < F.max(t))).alias("varies"),
        )
        .where("varies")
    )
    out = per_era.groupBy("k").agg(
        F.avg("cm").alias("corr_meta"), F.avg("ct").alias("corr_target"), F.count(F.lit(1)).alias("n_eras")
    )
    return labelled(out, features, "feature").withColumn(
        "orthogonal",
        (F.abs("corr_meta") <= threshold) & (F.abs("corr_target") > threshold),
    )


def benchmark_era_corr(df: DataFrame, benchmarks: Sequence[str], target: str) -> DataFrame:
    """Per-era plain correlation of benchmark columns with the target, on rows where
    all are present; eras with a constant target are absent."""
    rows = df.where(none_null([*benchmarks, target]) & is_finite(target))
    rows = rows.withColumn("__t", F.col(target).cast("double"))
    long = unpivot(rows, ["era", "era_num", "__t"], benchmarks, "b")
    per = (
        long.groupBy("k", "era", "era_num")
        .agg(
            safe_corr(F.col("b"), F.col("__t")).alias("corr"),
            ((F.count("__t") >= 2) & (F.min("__t") < F.max("__t"))).alias("varies"),
        )
        .where("varies")
        .drop("varies")
    )
    return labelled(per, benchmarks, "benchmark")


def benchmark_summary(per_era: DataFrame) -> DataFrame:
    return per_era.groupBy("benchmark").agg(
        F.avg("corr").alias("mean_corr"),
        F.stddev_samp("corr").alias("corr_std"),
        F.count("corr").alias("n_eras"),
        F.min_by("era", "era_num").alias("first_era"),
        F.max_by("era", "era_num").alias("last_era"),
    )


# -- regimes -------------------------------------------------------------------


def era_signal(ic: DataFrame) -> DataFrame:
    """Per-era mean, deviation and size of the feature ICs, with percentile rank among
    the valid eras and a low/normal/high label by quartile of rank."""
    per = ic.groupBy("era", "era_num").agg(
        F.avg("ic").alias("mean_ic"),
        F.stddev_samp("ic").alias("ic_std"),
        F.count("feature").alias("n_features"),
        F.max(F.abs("ic")).alias("max_abs_ic"),
        F.bool_or("degenerate").alias("degenerate"),
    )
    valid = Window.partitionBy("degenerate")
    n = F.count(F.lit(1)).over(valid)
    place = F.row_number().over(valid.orderBy("mean_ic", "era_num")) - 1
    pct = F.when(
        ~F.col("degenerate"),
        F.when(n > 1, F.lit(100.0) * place / F.when(n > 1, n - 1)).otherwise(50.0),
    )
    ranked = per.withColumn("pct_rank", pct)
    return (
        ranked.withColumn(
            "regime",
            F.when(F.col("degenerate"), "unlabeled")
            .when(F.col("pct_rank") <= 25.0, "low")
            .when(F.col("pct_rank") >= 75.0, "high")
            .otherwise("normal"),
        )
        .withColumn("crash", F.coalesce(F.col("pct_rank") <= 10.0, F.lit(False)))
        .withColumn("hot", F.coalesce(F.col("pct_rank") >= 90.0, F.lit(False)))
    )


def regime_thresholds(signal: DataFrame) -> DataFrame:
    """Quartiles and outer deciles of the valid eras' mean IC (one value per era)."""
    valid = signal.where(~F.col("degenerate"))
    return valid.agg(
        F.percentile("mean_ic", 0.25).alias("q1"),
        F.percentile("mean_ic", 0.75).alias("q3"),
        F.percentile("mean_ic", 0.10).alias("mean_ic_low"),
        F.percentile("mean_ic", 0.90).alias("mean_ic_high"),
    )


def ic_persistence(ic: DataFrame) -> DataFrame:
    """Rank correlation of the feature ICs of neighbouring eras: mean, deviation, count.
    Eras whose ICs are all zero are left out before neighbours are found."""
    live = ic.groupBy("era_num").agg(F.max(F.abs("ic")).alias("m")).where("m > 0")
    numbered = live.withColumn("i", F.row_number().over(Window.orderBy("era_num"))).drop("m")
    # ICs that differ by rounding noise are ties
    joined = ic.join(numbered, "era_num").withColumn("ic", F.round("ic", 12))
    ranked = with_ranks(joined, ["i"], {"r": "ic"}, shape=(1, 0))
    now = ranked.select("i", "feature", "r")
    before = ranked.select((F.col("i") + 1).alias("i"), "feature", F.col("r").alias("b"))
    pairs = now.join(before, ["i", "feature"]).groupBy("i").agg(
        raw_corr(F.col("r"), F.col("b")).alias("c")
    )
    return pairs.agg(
        finite_or(F.avg("c"), 0.0).alias("mean"),
        finite_or(F.stddev_pop("c"), 0.0).alias("std"),
        F.count("c").alias("n_adjacent"),
    )


def ic_rolling_volatility(signal: DataFrame, width: int = 20) -> DataFrame:
    from eraflow.operators.series import rolling_deviation

    series = signal.select(
        "era", "era_num", F.when(~F.col("degenerate"), F.col("mean_ic")).alias("value")
    )
    return rolling_deviation(series, (), width).select("era", "era_num", "rolling_std")
