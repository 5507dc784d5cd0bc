"""Scorecards against the operators they are made of."""

import pytest
from pyspark.sql import functions as F

from eraflow.operators import scoring, series
from eraflow.plans import scorecard
from eraflow.sources.testpanel import FEATURES, META, customer_month, model_predictions

BY = ["model_id", "era"]


@pytest.fixture(scope="module")
def parts(spark, sf_dir):
    panel = customer_month(spark, sf_dir)
    long = model_predictions(spark, sf_dir)
    base = long.select("model_id", "era", "id", "prediction", META, "target", "bench_b60")
    options = {"target": "target", "meta": META, "features": FEATURES, "benchmark": "bench_b60", "feature_rows": panel, "n_boot": 40}
    return panel, long, base, options


def cards(base, **options):
    return {r["model_id"]: r for r in scorecard.flatten(scorecard.evaluate_models(base, **options)).collect()}


def mean(df):
    return {r["model_id"]: r["m"] for r in df.groupBy("model_id").agg(F.avg("value").alias("m")).collect()}


def test_cells_are_means_of_the_series(parts):
    _, long, base, options = parts
    got = cards(base, **options)
    for name, df in {
        "corr": scoring.per_era_corr(long, "prediction", "target", BY),
        "mmc": scoring.per_era_mmc(long, "prediction", META, "target", BY),
        "bmc": scoring.per_era_bmc(long, "prediction", "bench_b60", "target", BY, 0),
        "cwmm": scoring.per_era_cwmm(long, "prediction", META, BY, 0),
        "fnc": scoring.per_era_fnc(long, "prediction", FEATURES, "target", BY),
    }.items():
        for model, value in mean(df).items():
            assert got[model][name] == pytest.approx(value, abs=1e-9), name
    assert all(r["n_degenerate_eras"] == scoring.degenerate_eras(long.where(F.col("model_id") == m), "prediction", "target", META, FEATURES, BY).count() for m, r in got.items())


def test_features_out_of_the_base_give_the_same_cards(parts):
    _, long, base, options = parts
    other = {k: v for k, v in options.items() if k != "feature_rows"}
    with_features = long.select("model_id", "era", "id", "prediction", META, "target", "bench_b60", *FEATURES)
    first, second = cards(base, **options), cards(with_features, **other)
    for model, row in first.items():
        for name, value in row.asDict().items():
            assert second[model][name] == (pytest.approx(value, abs=1e-9) if isinstance(value, float) else value), name


def test_perturbation_payout_and_level(spark, parts):
    panel, long, base, options = parts
    told = spark.createDataFrame([("pred_a", 80, 0.9, 0.8, 0.1, 0.2)], "model_id string, n_eras long, ceiling_stability double, manifold_stability double, gap double, effective_fraction double")
    plain = cards(base, **options)
    got = cards(base, **options, perturbation=told, payout_factor=0.5, payout_bound=0.01, level=0.5)
    assert (got["pred_a"]["perturb_ceiling_stability"], got["pred_a"]["perturb_reason"]) == (0.9, None)
    assert (got["pred_b"]["perturb_ceiling_stability"], got["pred_b"]["perturb_reason"]) == (None, "no perturbation result")
    corr, mmc = scoring.per_era_corr(long, "prediction", "target", BY), scoring.per_era_mmc(long, "prediction", META, "target", BY)
    payouts = mean(series.payout_series(corr, mmc, ["model_id"], 0.5, 0.01))
    for model, row in got.items():
        assert row["mean_payout"] == pytest.approx(payouts[model], abs=1e-12)
        assert row["corr_ci_high"] - row["corr_ci_low"] <= plain[model]["corr_ci_high"] - plain[model]["corr_ci_low"]
    with pytest.raises(ValueError, match="level"):
        scorecard.evaluate_models(base, **options, level=1.0)
