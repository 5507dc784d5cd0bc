"""Jobs over whole datasets: the benchmark hierarchy, campaign evidence, and the
dataset report. Each composes operators; tables several steps need are written once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eraflow.functions import groups
from eraflow.functions.stats import is_finite
from eraflow.operators import analysis, compare, correlation, drift, fits, inference, scoring, series
from eraflow.operators.neutralize import feature_vector, neutralized_ic
from eraflow.plans import scorecard
from eraflow.session import broadcast_checked, materialize

PAIRS = (("v2", "v3"), ("v2", "v4"), ("v3", "v4"))


def hierarchy_predictions(
    train: DataFrame, rows: DataFrame, features: Sequence[str], target: str,
    benchmarks: Sequence[str], purge: int, seed: int = 0, **tree_params,
) -> DataFrame:
    """Predictions of every tier, long form with ``tier``: nulls (0), lagged target (1),
    ridge (2), trees (3), stored benchmark columns (4)."""
    cells = [
        (0, f"null_{kind}", fits.null_predictions(rows, kind, seed, rows, features))
        for kind in ("constant", "uniform", "gaussian", "feature_mean")
    ]
    known = fits.purged(train, rows, [target], purge)
    cells.append((1, "lagged_target", fits.lagged_target_predictions(known, rows, target, 5)))
    cells.append((2, "ridge", fits.ridge_predictions(train, rows, features, [target], purge)))
    cells.append((3, "trees", fits.tree_predictions(train, rows, features, [target], purge, **tree_params)))
    for b in benchmarks:
        present = rows.where(F.col(b).isNotNull())
        cells.append((4, b, present.select("era", "id", F.col(b).cast("double").alias("prediction"))))
    out = None
    for tier, name, df in cells:
        part = df.select(F.lit(name).alias("model_id"), F.lit(tier).alias("tier"), "era", "id", "prediction")
        out = part if out is None else out.unionByName(part)
    return out


def hierarchy(
    train: DataFrame, rows: DataFrame, features: Sequence[str], target: str, meta: str,
    benchmarks: Sequence[str], n_boot: int = 200, fleet: Sequence[tuple[str, int, DataFrame, bool]] = (), **options,
) -> DataFrame:
    """Scorecards of all cells from a single evaluation: tier, group label, where the cell
    falls on the ladder of the tiers' best (``placement``), its verdict at the gate with
    the fields it fails (one that is not finite, as a ratio without losses, is
    unavailable), and whether it was chosen on the rows it is scored on.

    ``fleet`` adds cells: (model_id, tier, predictions, selection_bias); a search over
    candidates scored on ``rows`` is biased."""
    cells = hierarchy_predictions(train, rows, features, target, benchmarks, **options)
    for name, tier, found, _ in fleet:
        cells = cells.unionByName(found.select(F.lit(name).alias("model_id"), F.lit(tier).alias("tier"), "era", "id", "prediction"))
    predictions = materialize(cells, "hierarchy")
    tiers = predictions.select("model_id", "tier").distinct()
    base = scorecard.evaluation_rows(
        predictions.drop("tier"), rows.select("era", "id", meta), rows.select("era", "id", target),
        rows.select("era", "id"), rows.select("era", "id", F.col(benchmarks[0]).alias("reference")),
    )
    cards = scorecard.evaluate_models(
        base, target=target, meta=meta, features=features, benchmark="reference", n_boot=n_boot, feature_rows=rows
    )
    flat = scorecard.flatten(cards).join(tiers, "model_id", "left")
    flat = materialize(flat.withColumn("strategy_group", F.concat(F.lit("tier"), F.col("tier").cast("string"))), "hierarchy-cards")
    fields = [f for f, op, _ in compare.GATE if op != "display" and f in flat.columns]
    finite = flat.withColumns({f: F.when(is_finite(f), F.col(f)) for f in fields})
    report = compare.gate_report(finite, compare.gate_table(flat.sparkSession), fields)
    failed = compare.gate_violations(report).groupBy("model_id").agg(F.sort_array(F.collect_list("field")).alias("gate_failed"))
    placed = compare.place(flat, flat.groupBy("tier").agg(F.max("corr").alias("corr")))
    biased = F.col("model_id").isin([name for name, _, _, bias in fleet if bias]) if fleet else F.lit(False)
    none = F.array().cast("array<string>")
    return placed.join(failed, "model_id", "left").withColumns(
        {"gate_failed": F.coalesce("gate_failed", none), "gate_pass": F.col("gate_failed").isNull(), "selection_bias": biased}
    )


def campaign_evidence(
    runs: DataFrame, predictions: DataFrame, rows: DataFrame, target: str, features: Sequence[str],
    n_boot: int = 200, seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(variants, ic series). Per recorded run: IC mean with interval, moments, drawdown,
    fully neutralized IC with interval, and the fleet-deflated ratio. Runs that were not
    recorded, or have no predictions, keep a row with an error. ``rows`` has an (era, id)
    once."""
    recorded = runs.where("status = 'recorded' and run_id is not null").select("variant", "run_id")
    preds = predictions.join(broadcast_checked(recorded), "run_id").select("variant", "era", "id", "prediction")
    by = ["variant"]
    ic, fne = (series.with_era_num(found) for found in _ics(preds, rows, target, features))
    stats = series.series_stats(ic, by)
    # A series below the block floor has no interval.
    options = {"n_boot": n_boot, "seed": seed, "short": "null"}
    ic_ci = inference.mean_interval(ic, by, "20D", **options).select(
        *by, F.col("ci_low").alias("ic_ci_lo"), F.col("ci_high").alias("ic_ci_hi")
    )
    fne_ci = inference.mean_interval(fne, by, "20D", **options).select(
        *by, F.col("point").alias("fne100"), F.col("ci_low").alias("fne100_ci_lo"), F.col("ci_high").alias("fne100_ci_hi")
    )
    deflated = inference.attach_deflation(stats.where("std > 0 and n >= 4"), by).select(*by, "dsr", F.col("reason").alias("dsr_reason"))
    table = (
        runs.select("variant", "run_id", "status", "error", *_made_of(runs))
        .join(stats.select(*by, F.col("n").alias("n_eras"), F.col("mean").alias("mean_ic"), F.col("sharpe").alias("ic_sharpe"), F.col("std").alias("ic_std"), F.col("skew").alias("ic_skew"), F.col("kurt").alias("ic_kurt")), by, "left")
        .join(ic_ci, by, "left")
        .join(series.centred_drawdown(ic, by), by, "left")
        .join(fne_ci, by, "left")
        .join(deflated, by, "left")
    )
    missing = (F.col("status") == "recorded") & F.col("n_eras").isNull()
    error = (
        F.when(F.col("status") != "recorded", F.coalesce("error", F.concat(F.lit("status="), "status")))
        .when(missing, F.concat(F.lit("predictions missing for "), F.coalesce("run_id", F.lit("?"))))
    )
    short = F.col("n_eras").isNotNull() & F.col("ic_ci_lo").isNull()
    reason = F.when(short, "series is shorter than its block floor")
    return table.withColumn("error", error).withColumn("ic_ci_reason", reason), ic


def _made_of(runs: DataFrame) -> list[Column]:
    """The backend and the device a recorded run was meant for; other runs have none."""
    recorded = F.col("status") == "recorded"
    backend = F.col("backend") if "backend" in runs.columns else F.lit(None).cast("string")
    device = F.col("device") if "device" in runs.columns else F.lit(None).cast("string")
    return [F.when(recorded, backend).alias("backend"), F.when(recorded, F.coalesce(device, F.lit("auto"))).alias("device")]


def _ics(preds: DataFrame, rows: DataFrame, target: str, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(variant, era, value) of the plain and the fully neutralized correlations, stored. An
    era's rows meet its variants in one task; larger eras are joined and take a pass each."""
    ours = preds.where("prediction is not null").withColumn("prediction", F.col("prediction").cast("double"))
    theirs = rows.where(F.col(target).isNotNull()).select("era", "id", F.col(target).cast("double").alias("t"), feature_vector(features).alias("x"))
    dealt = groups.models_a_task(ours, theirs, 1, len(features), "variant")
    if dealt[1]:
        work = ours.withColumnRenamed("prediction", "p")
        found = groups.by_models(work, theirs, ["p"], "variant", dealt, scoring.plain_and_neutral_ic, "ic double, neutral double")
        found = materialize(found, "campaign-ic")
        return tuple(found.where(F.col(c).isNotNull()).select("variant", "era", F.col(c).alias("value")) for c in ("ic", "neutral"))
    joined = materialize(preds.join(rows.select("era", "id", target, *features), ["era", "id"]), "campaign")
    fne = neutralized_ic(joined, ["prediction"], features, target, [1.0], ["variant", "era"])
    return materialize(_plain_ic(joined, target), "campaign-ic"), materialize(fne.select("variant", "era", F.col("ic").alias("value")), "campaign-neutral")


def _plain_ic(joined: DataFrame, target: str) -> DataFrame:
    """Plain per-era correlation; a constant prediction counts 0, a constant target not at all."""
    from eraflow.functions.stats import none_null, safe_corr

    p, t = F.col("prediction").cast("double"), F.col(target).cast("double")
    return (
        joined.where(none_null(["prediction", target]))
        .groupBy("variant", "era")
        .agg(safe_corr(p, t).alias("value"), ((F.count(t) >= 2) & (F.min(t) < F.max(t))).alias("ok"))
        .where("ok").drop("ok")
    )


def campaign_pairs(
    ic: DataFrame, variants: DataFrame, n_boot: int = 200, seed: int = 0, min_overlap_eras: int = 20
) -> DataFrame:
    """Mean IC differences of the screen-defining variant pairs (v2/v3/v4 of a prefix).
    Pairs with too few shared eras get an error instead of an interval. A pair's backend
    is that of the prefix's v2 run, else of its v3 run, else the prefix itself."""
    tagged = ic.select(
        F.regexp_extract("variant", r"^(.*)_v\d+$", 1).alias("prefix"),
        F.regexp_extract("variant", r"_(v\d+)$", 1).alias("version"), "era", "era_num", "value",
    ).where("prefix <> ''")
    wanted = F.explode(
        F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in PAIRS])
    ).alias("w")
    left = tagged.select("*", wanted).where("version = w.a").select("prefix", "w", "era", "era_num", F.col("value").alias("va"))
    right = tagged.select("*", wanted).where("version = w.b").select("prefix", "w", "era", F.col("value").alias("vb"))
    version = F.regexp_extract("variant", r"_(v\d+)$", 1)
    backends = variants.where("backend is not null").select(F.regexp_extract("variant", r"^(.*)_v\d+$", 1).alias("prefix"), version.alias("version"), "backend")
    backends = backends.where("version in ('v2', 'v3')").groupBy("prefix").agg(F.min_by("backend", "version").alias("backend"))
    diffs = left.join(right, ["prefix", "w", "era"]).select(
        "prefix",
        F.concat("prefix", F.lit("_"), "w.a", F.lit(" vs "), "prefix", F.lit("_"), "w.b").alias("pair"),
        "era", "era_num", (F.col("va") - F.col("vb")).alias("value"),
    )
    named = diffs.select("pair", "prefix").distinct().join(broadcast_checked(backends), "prefix", "left")
    named = named.select("pair", F.coalesce("backend", "prefix").alias("backend"))
    tested = inference.mean_interval(diffs.drop("prefix"), ["pair"], "20D", short="one_block", n_boot=n_boot, seed=seed).join(named, "pair")
    enough = F.col("n") >= min_overlap_eras
    return tested.select(
        "pair",
        "backend",
        F.when(enough, F.col("point")).alias("mean_diff"),
        F.when(enough, F.col("ci_low")).alias("ci_low"),
        F.when(enough, F.col("ci_high")).alias("ci_high"),
        F.when(enough, F.col("n")).otherwise(0).cast("bigint").alias("n_eras"),
        F.when(~enough, F.lit(f"fewer than {min_overlap_eras} shared eras")).alias("error"),
    )


def dataset_report(
    panel: DataFrame, features: Sequence[str], targets: Sequence[str], is_train: Column,
    train_last_era: int, benchmarks: Sequence[str], meta: str, n_boot: int = 200,
) -> Mapping[str, DataFrame]:
    """Every table of a dataset analysis. The IC table is written once and read by all
    screens, regime and persistence tables."""
    main = targets[0]
    ic = materialize(analysis.ic_by_era(panel, features, targets), "report-ic")
    main_ic = ic.where(F.col("target") == main)
    signal = analysis.era_signal(main_ic)
    train_screen = analysis.full_screen(ic.where(F.col("era_num") <= train_last_era), n_boot=n_boot)
    profile = materialize(drift.drift_profile(panel, features, is_train), "report-drift")
    pairs = materialize(correlation.correlation_structure(panel, features), "report-pairs")
    per_era = analysis.benchmark_era_corr(panel, benchmarks, main)
    return {
        "overview": analysis.describe_splits(panel),
        "eras": analysis.era_structure(panel),
        "targets": analysis.target_profile(panel, targets),
        "target_correlation": analysis.target_correlation(panel, targets),
        "ic": ic,
        "ic_by_split": analysis.ic_by_split(ic, train_last_era, train_last_era + 1),
        "screen": analysis.full_screen(ic, n_boot=n_boot),
        "train_screen": train_screen,
        "features": analysis.feature_summary(panel, features),
        "drift": profile,
        "derived_sets": analysis.derived_sets(train_screen, profile),
        "correlation_top": correlation.top_pairs(pairs),
        "correlation_summary": correlation.structure_summary(pairs),
        "regimes": signal,
        "regime_thresholds": analysis.regime_thresholds(signal),
        "persistence": analysis.ic_persistence(main_ic),
        "rolling_volatility": analysis.ic_rolling_volatility(signal),
        "benchmarks": analysis.benchmark_summary(per_era),
        "meta_orthogonality": analysis.meta_orthogonality(panel, features, meta, main),
    }


def report_sizes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of every report table."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n_rows"))
        out = part if out is None else out.unionByName(part)
    return out
