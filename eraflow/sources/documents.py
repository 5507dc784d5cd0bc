"""Run records, campaign logs, feature metadata and scorecard files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eraflow.session import broadcast_checked

# Field names of the documents, and the columns of the unified table.
SCORE_FIELDS = (
    "corr", "corr_ci_low", "corr_ci_high", "corr_sharpe_ac", "corr_sharpe_ac_ci_low",
    "corr_sharpe_ac_ci_high", "std_corr", "max_drawdown", "deflated_sharpe", "fnc", "mmc",
    "mmc_sharpe_ac", "bmc", "cwmm", "mean_payout", "cagr_1y", "gain_to_pain_ratio",
    "kelly_fraction", "mmc_down", "turnover_mean", "rank_scalar", "cvar5", "burn_rate",
    "max_feature_exposure", "horizon_model_sharpe_20", "perturb_ceiling_stability",
)
COUNT_FIELDS = ("corr_n_eras", "corr_sharpe_ac_n_eras", "n_eras", "regime_count")

RUN_SCHEMA = (
    "run_id string, metrics struct<mean double, std double, sharpe double, max_drawdown double>, "
    "manifest struct<oof_device string, scorecard_prediction_scale string, config struct<"
    "data struct<feature_set string, feature_subset string, targets array<string>>, "
    "model struct<backend string, preset string>, risk struct<neutralization_proportion double>, "
    "run struct<name string>>>, scorecard struct<"
    + ", ".join(
        [f"{f}: double" for f in SCORE_FIELDS]
        + [f"{f}: bigint" for f in COUNT_FIELDS]
        + ["mmc_down_reason: string"]
    )
    + ">, _corrupt_record string"
)
CAMPAIGN_SCHEMA = (
    "campaign_id string, name string, configs array<struct<path string, sha256 string>>, "
    "runs array<struct<config_path string, run_id string, status string, error string>>"
)
FULL_SCHEMA = (
    "family string, promoted_from_run_id string, promoted_at string, rehearsal boolean, config struct<"
    "data struct<feature_set string, feature_subset string, targets array<string>>, "
    "model struct<backend string, preset string>>, _corrupt_record string"
)
# columns of the unified table that both run records and benchmark rows fill
UNIFIED = (
    "model_id", "source", "run_name", "family", "training_scope", "has_full_version", "backend", "preset", "feature_set", "feature_subset",
    "n_targets", "targets", "neutralization_proportion", "oof_device", "corr", "corr_ci_low",
    "corr_ci_high", "corr_n_eras", "corr_sharpe_ac", "corr_sharpe_ac_ci_low",
    "corr_sharpe_ac_ci_high", "corr_sharpe_ac_n_eras", "std_corr", "max_drawdown",
    "deflated_sharpe", "fnc", "mmc", "mmc_sharpe_ac", "bmc", "cwmm", "mean_payout", "cagr_1y",
    "gain_to_pain_ratio", "kelly_fraction", "mmc_down", "mmc_down_reason", "turnover_mean",
    "n_eras", "rank_scalar", "cvar5", "burn_rate", "max_feature_exposure",
    "max_feature_exposure_reason", "has_bmc", "has_horizon", "has_perturb", "has_regime", "tier",
    "run_dir",
)


def read_run_records(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Run documents under a declared schema; unreadable ones are skipped. One without a
    run id is known by its folder, and an empty scorecard is none."""
    raw = (
        spark.read.schema(RUN_SCHEMA)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("multiLine", multiline)
        .json(path)
    )
    place = F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]+$", 1)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    scored = F.coalesce(*[F.col(f"scorecard.{f.name}").cast("string") for f in raw.schema["scorecard"].dataType])
    return (
        raw.withColumn("run_dir", place)
        .withColumn("run_id", F.coalesce("run_id", folder))
        .withColumn("scorecard", F.when(scored.isNotNull(), F.col("scorecard")))
        .where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    )


def _stored_first(field: str, fallback: str) -> Column:
    """A scorecard value of 0.0 is real; only a missing one falls back on the metrics."""
    return F.coalesce(
        F.col(f"scorecard.{field}"), F.col(f"metrics.{fallback}"), F.lit(0.0)
    ).alias(field)


def read_full_versions(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Manifests of families' full-history versions: one row per family, the one promoted
    last; unreadable ones, rehearsals and those without a family are none."""
    raw = (
        spark.read.schema(FULL_SCHEMA)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("multiLine", multiline).json(path)
        .withColumn("run_dir", F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]+$", 1))
    )
    good = raw.where(F.col("_corrupt_record").isNull() & F.col("family").isNotNull() & ~F.coalesce("rehearsal", F.lit(False)))
    fields = ["promoted_at", "promoted_from_run_id", "config", "run_dir"]
    return good.groupBy("family").agg(F.max(F.struct(*fields)).alias("v")).select("family", *[f"v.{f}" for f in fields])


def full_rows(versions: DataFrame) -> DataFrame:
    """Full versions in the unified columns; they have no out-of-sample scores."""
    targets = F.col("config.data.targets")
    some = F.size(F.coalesce(targets, F.array().cast("array<string>"))) > 0
    special = {
        "model_id": F.concat("family", F.lit("::full")), "source": F.lit("full"), "run_name": F.col("family"),
        "family": F.col("family"), "training_scope": F.lit("full"), "has_full_version": F.lit(False),
        "backend": F.col("config.model.backend"), "preset": F.col("config.model.preset"),
        "feature_set": F.col("config.data.feature_set"), "feature_subset": F.col("config.data.feature_subset"),
        "n_targets": F.when(some, F.size(targets)).cast("bigint"), "targets": F.when(some, F.concat_ws(", ", targets)),
        "run_dir": F.col("run_dir"),
    }
    kinds = {"mmc_down_reason": "string", "max_feature_exposure_reason": "string", "oof_device": "string", "tier": "bigint"}
    kinds |= {f"has_{c}": "boolean" for c in ("bmc", "horizon", "perturb", "regime")} | {c: "bigint" for c in COUNT_FIELDS}
    return versions.select(*[special.get(c, F.lit(None).cast(kinds.get(c, "double"))).alias(c) for c in UNIFIED])


def dangling_versions(versions: DataFrame, runs: DataFrame) -> DataFrame:
    """Full versions whose run is not in the registry: (family, promoted_from_run_id)."""
    known = runs.select(F.col("run_id").alias("promoted_from_run_id")).distinct()
    return versions.select("family", "promoted_from_run_id").join(known, "promoted_from_run_id", "left_anti").select("family", "promoted_from_run_id")


def registry_leaderboard(runs: DataFrame, versions: DataFrame) -> DataFrame:
    """Run records and full versions in one table. A run whose family has a full version
    says so; the families are matched by a join, and every version has a row of its own."""
    board = run_leaderboard(runs)
    promoted = versions.select("family", F.lit(True).alias("promoted")).distinct()
    marked = board.join(broadcast_checked(promoted), "family", "left")
    marked = marked.withColumn("has_full_version", F.coalesce("promoted", F.lit(False))).select(*UNIFIED)
    return marked.unionByName(full_rows(versions))


def run_leaderboard(runs: DataFrame) -> DataFrame:
    """Run records in the unified columns, without any full version."""
    ranked = F.col("manifest.scorecard_prediction_scale") == "percentile_rank"
    config = "manifest.config"
    special = {
        "model_id": F.col("run_id"),
        "source": F.when(F.col("scorecard").isNotNull(), "trained").otherwise("trained_legacy"),
        "run_name": F.coalesce(f"{config}.run.name", F.lit("unknown")),
        "family": F.coalesce(f"{config}.run.name", F.lit("unknown")),
        "training_scope": F.lit("research"),
        "has_full_version": F.lit(False),
        "run_dir": F.col("run_dir") if "run_dir" in runs.columns else F.lit(None).cast("string"),
        "backend": F.coalesce(f"{config}.model.backend", F.lit("unknown")),
        "preset": F.coalesce(f"{config}.model.preset", F.lit("unknown")),
        "feature_set": F.coalesce(f"{config}.data.feature_set", F.lit("unknown")),
        "feature_subset": F.col(f"{config}.data.feature_subset"),
        "n_targets": F.coalesce(F.size(F.col(f"{config}.data.targets")), F.lit(0)).cast("bigint"),
        "targets": F.concat_ws(", ", f"{config}.data.targets"),
        "neutralization_proportion": F.col(f"{config}.risk.neutralization_proportion"),
        "oof_device": F.col("manifest.oof_device"),
        "corr": _stored_first("corr", "mean"),
        "corr_sharpe_ac": _stored_first("corr_sharpe_ac", "sharpe"),
        "std_corr": _stored_first("std_corr", "std"),
        "max_drawdown": _stored_first("max_drawdown", "max_drawdown"),
        # exposures of runs scored before predictions were ranked are not comparable
        "max_feature_exposure": F.when(ranked, F.col("scorecard.max_feature_exposure")),
        "max_feature_exposure_reason": F.when(
            ~F.coalesce(ranked, F.lit(False)), "pre_rank_fix_definition"
        ),
        "has_bmc": F.col("scorecard.bmc").isNotNull(),
        "has_horizon": F.col("scorecard.horizon_model_sharpe_20").isNotNull(),
        "has_perturb": F.col("scorecard.perturb_ceiling_stability").isNotNull(),
        "has_regime": F.col("scorecard.regime_count").isNotNull(),
        "tier": F.lit(None).cast("bigint"),
    }
    cells = [special.get(c, F.col(f"scorecard.{c}") if c not in special else None) for c in UNIFIED]
    return runs.select(*[cell.alias(name) for cell, name in zip(cells, UNIFIED)])


def read_scorecard_csv(spark: SparkSession, path: str) -> DataFrame:
    """Scorecard CSV with the declared types of the fields it has, and the file as run_dir."""
    header = spark.read.option("header", True).csv(path)
    casts = []
    for c in header.columns:
        kind = (
            "bigint" if c in (*COUNT_FIELDS, "tier") else "double" if c in SCORE_FIELDS else "string"
        )
        casts.append(F.col(c).cast(kind).alias(c))
    return header.select(*casts, F.col("_metadata.file_path").alias("run_dir"))


def benchmark_leaderboard(cards: DataFrame) -> DataFrame:
    """Benchmark scorecards in the unified columns, with the defaults of a benchmark row."""

    def have(name: str, kind: str = "double") -> Column:
        return F.col(name) if name in cards.columns else F.lit(None).cast(kind)

    group = have("strategy_group", "string")
    special = {
        "std_corr": F.coalesce(have("std_corr"), F.lit(0.0)),
        "max_drawdown": F.coalesce(have("max_drawdown"), F.lit(0.0)),
        "source": F.lit("benchmark"),
        "run_name": F.coalesce(
            group, F.concat(F.lit("tier"), have("tier", "bigint").cast("string")), F.lit("benchmark")
        ),
        "backend": F.lit("benchmark"),
        "preset": F.lit("benchmark"),
        "feature_set": F.lit("all"),
        "feature_subset": F.lit(None).cast("string"),
        "n_targets": F.lit(1).cast("bigint"),
        "targets": F.coalesce(have("horizon_target_name", "string"), F.lit("target")),
        "neutralization_proportion": F.lit(None).cast("double"),
        "oof_device": F.lit(None).cast("string"),
        "max_feature_exposure_reason": F.lit("unranked_predictions"),
        "mmc_down_reason": have("mmc_down_reason", "string"),
        "model_id": have("model_id", "string"),
        "tier": have("tier", "bigint"),
        "corr_n_eras": have("corr_n_eras", "bigint"),
        "corr_sharpe_ac_n_eras": have("corr_sharpe_ac_n_eras", "bigint"),
        "n_eras": have("n_eras", "bigint"),
        "has_bmc": have("bmc").isNotNull(),
        "has_horizon": have("horizon_model_sharpe_20").isNotNull(),
        "has_perturb": have("perturb_ceiling_stability").isNotNull(),
        "has_regime": have("regime_count", "bigint").isNotNull(),
        "family": F.lit(None).cast("string"), "training_scope": F.lit(None).cast("string"),
        "has_full_version": F.lit(False), "run_dir": have("run_dir", "string"),
    }
    return cards.select(*[special[c].alias(c) if c in special else have(c).alias(c) for c in UNIFIED])


def read_campaigns(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Campaign logs, one row per run of each campaign."""
    logs = spark.read.schema(CAMPAIGN_SCHEMA).option("multiLine", multiline).json(path)
    return logs.select(
        "campaign_id", "name", F.size("configs").cast("bigint").alias("n_configs"),
        F.explode("runs").alias("r"),
    ).select(
        "campaign_id", "name", "n_configs", "r.config_path", "r.run_id", "r.status", "r.error",
        F.regexp_extract("r.config_path", r"([^/]+)\.[^./]+$", 1).alias("variant"),
    )


def tier_rungs(cards: DataFrame) -> DataFrame:
    return cards.where("tier is not null").groupBy("tier").agg(F.max("corr").alias("corr"))


def read_feature_sets(
    spark: SparkSession, path: str, supplemental: str | None = None
) -> DataFrame:
    """Feature metadata as a table (feature_set, ord, feature). A set name that both
    files define is an error, and so is an empty or missing map."""

    def one(p: str) -> DataFrame:
        raw = spark.read.schema("feature_sets map<string, array<string>>").option(
            "multiLine", True
        ).json(p)
        return raw.select(F.explode("feature_sets").alias("feature_set", "features"))

    sets = one(path)
    if supplemental is not None:
        sets = sets.unionByName(one(supplemental))
    names = [r["feature_set"] for r in sets.select("feature_set").collect()]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"feature sets defined twice: {repeated}")
    if not names:
        raise ValueError(f"{path}: 'feature_sets' must be a non-empty mapping")
    return sets.select("feature_set", F.posexplode("features").alias("ord", "feature"))


def resolve_set(
    sets: DataFrame, name: str, available: Sequence[str], require_all: bool = False
) -> list[str]:
    """One set's features among the available columns, in file order. Nothing left, or
    (with ``require_all``) anything missing, is an error."""
    features = [r["feature"] for r in sets.where(F.col("feature_set") == name).orderBy("ord").collect()]
    if not features:
        raise ValueError(f"feature set {name!r} is missing or empty")
    missing = [f for f in features if f not in available]
    if require_all and missing:
        raise ValueError(f"columns missing for {name!r}: {missing[:5]}")
    kept = [f for f in features if f in available]
    if not kept:
        raise ValueError(f"feature set {name!r} has no overlap with the columns")
    return kept
