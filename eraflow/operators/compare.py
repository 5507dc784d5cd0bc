"""Comparing models: gates, tiers, placement, statuses, leaderboards, verdicts.

Inputs are one-row-per-model tables (scorecards, run records). They stay DataFrames
throughout; thresholds and rungs are small tables joined to them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eraflow.functions.hashing import multiset_digest
from eraflow.functions.stats import is_finite
from eraflow.operators import scoring, series
from eraflow.session import broadcast_checked

# Fields of the production gate. Operators: at least, above, at most,
# and fields that are only displayed.
GATE = (
    ("corr", ">=", 0.0286),
    ("corr_sharpe_ac", ">=", 0.78),
    ("fnc", ">=", 0.020),
    ("deflated_sharpe", "display", 0.95),
    ("gain_to_pain_ratio", ">=", 1.50),
    ("cagr_1y", ">", 0.0),
    ("turnover_mean", "<=", 0.35),
)
STATUS_FIELDS = tuple(f for f, op, _ in GATE if op != "display")
NULL_FLOOR_CORR, NULL_FLOOR_SHARPE = 0.005, 0.15

# True where a larger value is better
METRIC_DIRECTION = {
    "corr_sharpe_ac": True, "rank_scalar": True, "corr": True, "mmc": True, "fnc": True,
    "deflated_sharpe": True, "std_corr": False, "max_drawdown": False,
}


def gate_table(spark: SparkSession, gate: Sequence[tuple[str, str, float]] = GATE) -> DataFrame:
    return spark.createDataFrame(list(gate), "field string, op string, threshold double")


def _receipt(measured: Column, op: Column, threshold: Column) -> Column:
    """True / False, or NULL where the field is unavailable or only displayed."""
    return (
        F.when(measured.isNull() | (op == "display"), F.lit(None).cast("boolean"))
        .when(op == ">", measured > threshold)
        .when(op == "<=", measured <= threshold)
        .otherwise(measured >= threshold)
    )


def gate_report(cards: DataFrame, gate: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per model and gate field: threshold, measured value, pass. Turnover is an
    upper bound here as in the verdict. A non-finite value fails the job first."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("measured")) for f in fields])
    ).alias("c")
    long = cards.select("model_id", cells).select("model_id", "c.*")
    bad = F.col("measured").isNotNull() & ~is_finite("measured")
    checked = F.when(
        bad, F.raise_error(F.concat(F.lit("non-finite value in scorecard "), "model_id", F.lit("."), "field")).cast("double")
    ).otherwise(F.col("measured"))
    # a gate has a handful of rows: dealt by field, one task would hold a field of all models
    joined = long.withColumn("measured", checked).join(broadcast_checked(gate), "field")
    return joined.select(
        "model_id", "field", "threshold", "measured",
        _receipt(F.col("measured"), F.col("op"), F.col("threshold")).alias("pass"),
    )


def gate_violations(report: DataFrame) -> DataFrame:
    return report.where(~F.coalesce("pass", F.lit(True)))


def null_floor_violations(
    cards: DataFrame, corr: float = NULL_FLOOR_CORR, sharpe: float = NULL_FLOOR_SHARPE
) -> DataFrame:
    """Structural null baselines that score above the statistical floor; must be empty."""
    long = cards.select(
        "model_id",
        F.explode(
            F.array(
                F.struct(F.lit("corr").alias("metric"), F.col("corr").alias("observed"), F.lit(corr).alias("tolerance")),
                F.struct(F.lit("corr_sharpe_ac").alias("metric"), F.col("corr_sharpe_ac").alias("observed"), F.lit(sharpe).alias("tolerance")),
            )
        ).alias("c"),
    ).select("model_id", "c.*")
    return long.where(F.abs("observed") > F.col("tolerance"))


def tier_ladder(cards: DataFrame, metric: str = "corr", tolerance: float = 1e-5) -> DataFrame:
    """Best value per tier, and whether it keeps the order of the tier below (strictly,
    except that the top tier may equal the one below it)."""
    best = cards.where("tier is not null").groupBy("tier").agg(F.max(metric).alias("best"))
    order = Window.orderBy("tier")
    below, top = F.lag("best").over(order), F.max("tier").over(Window.partitionBy())
    ordered = F.when(
        F.col("tier") == top, below <= F.col("best") + tolerance
    ).otherwise(below + tolerance <= F.col("best"))
    return best.withColumn("in_order", F.coalesce(ordered, F.lit(True)))


def place(cards: DataFrame, rungs: DataFrame, value: str = "corr") -> DataFrame:
    """Where each value falls on the ladder of tier rungs (a handful of rows, so one
    sorted array, a scalar subquery, reaches every row and the rows are not shuffled)."""
    packed = rungs.agg(
        F.sort_array(F.collect_list(F.struct("tier", F.col("corr").alias("rung")))).alias("ladder")
    ).scalar()
    df = cards.withColumn("ladder", packed)
    v, ladder = F.col(value), F.col("ladder")
    first, last = F.get(ladder, 0), F.element_at(ladder, -1)
    hit = F.filter(
        F.sequence(F.lit(0), F.size(ladder) - 2),
        lambda i: (F.get(ladder, i)["rung"] <= v) & (v < F.get(ladder, i + 1)["rung"]),
    )
    i = F.get(hit, 0)
    between = F.concat(
        F.lit("tier"), F.get(ladder, i)["tier"].cast("string"), F.lit("..tier"),
        F.get(ladder, i + 1)["tier"].cast("string"),
    )
    label = (
        F.when(v < first["rung"], F.concat(F.lit("below tier "), first["tier"].cast("string")))
        .when(v > last["rung"], F.concat(F.lit("above tier "), last["tier"].cast("string")))
        .when(i.isNotNull(), between)
        .otherwise(F.concat(F.lit("tier"), last["tier"].cast("string")))
    )
    return df.withColumn("placement", label).drop("ladder")


def gate_status(
    board: DataFrame,
    gate: Sequence[tuple[str, str, float]] = GATE,
    reference: str | None = None,
    champion: str | None = None,
) -> DataFrame:
    """Status of every leaderboard row with its per-field receipts. Full-history rows
    are never gated and benchmark rows are exempt; an unavailable turnover does not
    block, a measured violation does."""
    receipts = {
        f"gate_{f}": _receipt(F.col(f), F.lit(op), F.lit(threshold))
        for f, op, threshold in gate
        if f in STATUS_FIELDS
    }
    df = board.withColumns(receipts)
    ready = F.lit(True)
    for f in STATUS_FIELDS:
        passed = F.col(f"gate_{f}")
        ready = ready & F.coalesce(passed, F.lit(f == "turnover_mean"))
    is_reference = F.col("model_id") == F.lit(reference) if reference else F.lit(False)
    is_champion = F.col("model_id") == F.lit(champion) if champion else F.lit(False)
    status = (
        F.when(F.col("source") == "full", "FULL")
        .when(F.col("source") == "benchmark", F.when(is_reference, "GATE HURDLE").otherwise("BENCHMARK"))
        .when(is_champion, "CHAMPION")
        .when(ready, "CAPITAL READY")
        .otherwise("RESEARCH")
    )
    return df.select("model_id", status.alias("status"), *receipts)


def evaluable_rows(board: DataFrame) -> DataFrame:
    """Rows with out-of-sample metrics."""
    return board.where(F.col("source") != "full")


def merged_leaderboard(runs: DataFrame, benchmarks: DataFrame) -> DataFrame:
    return runs.unionByName(benchmarks, allowMissingColumns=True)


def ordered_leaderboard(board: DataFrame, champion: str | None = None) -> DataFrame:
    """Champion first, then full versions by name, runs by falling score ratio, and
    benchmarks by tier."""
    is_champion = F.col("model_id") == F.lit(champion) if champion else F.lit(False)
    section = (
        F.when(is_champion, 0)
        .when(F.col("source") == "full", 1)
        .when(F.col("source").isin("trained", "trained_legacy"), 2)
        .otherwise(3)
    )
    ratio = F.when(section == 2, F.col("corr_sharpe_ac"))
    tier = F.when(section == 3, F.coalesce(F.col("tier"), F.lit(99)))
    name = F.when(section == 1, F.coalesce(F.col("run_name"), F.lit("")))
    return board.withColumn("section", section).orderBy(
        "section", F.asc_nulls_first(name), F.desc_nulls_last(ratio), F.asc_nulls_first(tier), "model_id"
    )


def fleet_summary(
    runs: DataFrame, metric: str = "corr_sharpe_ac", n_trials: int = 1, confidence: float = 0.95
) -> DataFrame:
    """One row per run record with the chosen metric, its interval and eras, the deflated
    ratio against ``confidence``, why an exposure is missing, what the run is made of and
    which diagnostics it has; runs without a scorecard keep their row."""
    if n_trials < 1:
        raise ValueError("n_trials must be at least 1")
    if not 0.0 < confidence < 1.0:
        raise ValueError("confidence must be between 0 and 1")
    card, config = "scorecard", "manifest.config"
    ranked = F.coalesce(F.col("manifest.scorecard_prediction_scale") == "percentile_rank", F.lit(False))
    fields = runs.schema["scorecard"].dataType.fieldNames()

    def optional(name: str, kind: str = "double") -> Column:
        return F.col(f"{card}.{name}").cast(kind) if name in fields else F.lit(None).cast(kind)

    table = runs.select(
        "run_id",
        F.col(f"{card}.{metric}").alias("metric"),
        optional(f"{metric}_ci_low").alias("metric_ci_low"),
        optional(f"{metric}_ci_high").alias("metric_ci_high"),
        optional(f"{metric}_n_eras", "bigint").alias("metric_n_eras"),
        F.col(f"{card}.deflated_sharpe").alias("deflated_sharpe"),
        F.coalesce(F.col(f"{card}.deflated_sharpe") >= confidence, F.lit(False)).alias("dsr_pass"),
        F.when(ranked, F.col(f"{card}.max_feature_exposure")).alias("max_feature_exposure"),
        F.when(~ranked, "pre_rank_fix_definition").alias("max_feature_exposure_reason"),
        F.col("manifest.oof_device").alias("oof_device"),
        F.col(f"{config}.model.preset").alias("preset"),
        F.col(f"{config}.data.feature_set").alias("feature_set"),
        F.col(f"{config}.data.feature_subset").alias("feature_subset"),
        F.col(f"{config}.risk.neutralization_proportion").alias("neutralization_proportion"),
        optional("bmc").isNotNull().alias("has_bmc"),
        optional("horizon_model_sharpe_20").isNotNull().alias("has_horizon"),
        optional("perturb_ceiling_stability").isNotNull().alias("has_perturb"),
        optional("regime_count").isNotNull().alias("has_regime"),
        F.lit(n_trials).cast("bigint").alias("policy_n_trials"),
        F.lit(float(confidence)).alias("policy_dsr_confidence"),
    )
    return table.orderBy(F.desc_nulls_last("metric"), "run_id")


def verdicts(candidates: DataFrame, champion: DataFrame, metric: str = "corr_sharpe_ac") -> DataFrame:
    """promote / hold / caution of every candidate against the champion (one row, or
    none). Overlapping or missing intervals are a caution; a champion without the
    metric does not count."""
    up = METRIC_DIRECTION[metric]
    low, high = f"{metric}_ci_low", f"{metric}_ci_high"
    champ = champion.where(F.col(metric).isNotNull()).agg(
        F.first(F.struct(F.col(low).cast("double").alias("low"), F.col(high).cast("double").alias("high"))).alias("c")
    ).scalar()
    df = candidates.where(F.col(metric).isNotNull()).withColumn("c", champ)
    missing = F.col(low).isNull() | F.col(high).isNull() | F.col("c.low").isNull() | F.col("c.high").isNull()
    above, below = F.col(low) > F.col("c.high"), F.col(high) < F.col("c.low")
    verdict = (
        F.when(F.col("c").isNull(), "promote")
        .when(missing, "caution")
        .when(above if up else below, "promote")
        .when(below if up else above, "hold")
        .otherwise("caution")
    )
    return df.select("model_id", verdict.alias("verdict"))


def best_run(runs: DataFrame, metric: str, key: str = "model_id") -> DataFrame:
    """The run with the largest metric (ties to the larger id)."""
    known = runs.where(F.col(metric).isNotNull())
    return known.agg(
        F.max_by(key, F.struct(metric, key)).alias(key), F.max(metric).alias(metric)
    )


def better_than(runs: DataFrame, champion: DataFrame, metric: str) -> DataFrame:
    """Runs whose metric beats the champion's, in the metric's own direction."""
    up = METRIC_DIRECTION[metric]
    value = champion.agg(F.first(metric).alias("value")).scalar()
    df = runs.withColumn("__champion", value)
    better = F.col(metric) > F.col("__champion") if up else F.col(metric) < F.col("__champion")
    return df.where(better).drop("__champion")


def trajectories(scores: DataFrame, axis: DataFrame, meta_corr: DataFrame) -> DataFrame:
    """Metric series of every model on a common era axis: missing eras are 0, payouts
    compound, other metrics add up, payouts carry their drawdown, and downside eras of
    the meta model are marked. ``scores`` is (model_id, metric, era, value)."""
    known = scores.select("model_id", "metric").distinct()
    eras = axis.select("era", "era_num").distinct()
    packed = eras.agg(F.collect_list(F.struct("era", "era_num")).alias("eras")).scalar()
    grid = (
        known.withColumn("eras", packed)
        .select("model_id", "metric", F.explode("eras").alias("e"))
        .select("model_id", "metric", "e.era", "e.era_num")
    )
    down = meta_corr.select("era", (F.col("value") < 0.0).alias("downside"))
    filled = (
        grid.join(scores, ["model_id", "metric", "era"], "left")
        .join(down, "era", "left")
        .withColumn("value", F.coalesce("value", F.lit(0.0)))
        .withColumn("downside", F.coalesce("downside", F.lit(False)))
    )
    by = ["model_id", "metric"]
    grown = series.wealth(series.cumulative(filled, by), by)
    is_payout = F.col("metric") == "payout"
    return grown.select(
        *by, "era", "era_num", "value", "downside",
        F.when(is_payout, F.col("wealth")).otherwise(F.col("cum")).alias("cumulative"),
        F.when(is_payout, F.col("wealth_drawdown")).alias("drawdown"),
    )


def reconcile_capital(board: DataFrame, corr: DataFrame, mmc: DataFrame, meta_corr: DataFrame) -> DataFrame:
    """Fill capital columns of trained rows that miss any of them by recomputing the
    block from per-era series; a complete stored block wins, cell for cell."""
    columns = ["cagr_1y", "gain_to_pain_ratio", "kelly_fraction"]
    payout = series.payout_series(corr, mmc, ["model_id"])
    fresh = series.payout_shape(payout, ["model_id"]).select("model_id", *[F.col(c).alias(f"__{c}") for c in columns])
    down = scoring.mmc_down(mmc, meta_corr, ["model_id"]).select(
        "model_id", F.col("mmc_down").alias("__mmc_down"), F.col("mmc_down_reason").alias("__mmc_down_reason")
    )
    stored = F.lit(True)
    for c in columns:
        stored = stored & F.col(c).isNotNull()
    trained = F.col("source").isin("trained", "trained_legacy")
    df = board.join(fresh, "model_id", "left").join(down, "model_id", "left")
    replace = trained & ~stored & F.col("__cagr_1y").isNotNull()
    filled = {
        c: F.when(F.col("__replace"), F.col(f"__{c}")).otherwise(F.col(c))
        for c in [*columns, "mmc_down", "mmc_down_reason"]
    }
    return df.withColumn("__replace", replace).withColumns(filled).select(*board.columns)


def scorecard_digest(cards: DataFrame, digits: int = 6) -> DataFrame:
    """One digest of all scorecards, without timings, rounded so that the order of
    additions does not show. Neither partitioning nor the order of rows matters: the rows'
    hashes are added up (``hashing.multiset_digest``), and nothing is gathered."""
    columns = sorted(c for c in cards.columns if not c.startswith("timing_"))
    cells = []
    for c in columns:
        kind = cards.schema[c].dataType.typeName()
        cells.append(F.round(c, digits).alias(c) if kind in ("double", "float") else F.col(c))
    return multiset_digest(cards, F.to_json(F.struct(*cells))).withColumnRenamed("n_rows", "n_models")
