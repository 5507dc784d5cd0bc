import numpy as np
import pytest

from eraflow.operators import inference, series

import brute


def make(spark, values, name="m"):
    return spark.createDataFrame(
        [(name, f"{i + 1:04d}", i + 1, float(v)) for i, v in enumerate(values)],
        "model_id string, era string, era_num int, value double",
    )


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(42)
    return 0.01 + 0.03 * rng.normal(size=90)


@pytest.mark.parametrize("horizon,floor", [("20D", 4), ("60D", 12)])
def test_ac_sharpe(spark, walk, horizon, floor):
    got = inference.ac_adjusted_sharpe(make(spark, walk), ["model_id"], horizon).first()["ac_sharpe"]
    assert got == pytest.approx(brute.ac_sharpe(walk, floor))


def test_interval_and_p_value_agree(spark, walk):
    strong, weak = make(spark, walk + 0.02), make(spark, walk - walk.mean() + 0.0005, "w")
    rows = inference.mean_interval(strong.union(weak), ["model_id"], n_boot=500, seed=3).collect()
    by = {r["model_id"]: r for r in rows}
    assert by["m"]["ci_low"] > 0 and by["m"]["p_value"] < 0.05
    assert by["w"]["ci_low"] < 0 < by["w"]["ci_high"] and by["w"]["p_value"] > 0.05
    for r in rows:
        assert r["ci_low"] <= r["point"] <= r["ci_high"]


def test_ac_sharpe_interval_contains_point(spark, walk):
    r = inference.ac_sharpe_interval(make(spark, walk), ["model_id"], n_boot=300, seed=3).first()
    assert r["point"] == pytest.approx(brute.ac_sharpe(walk, 4))
    assert r["ci_low"] < r["point"] < r["ci_high"]


def test_custom_statistic(spark, walk):
    packed = inference.packed_series(make(spark, walk), ["model_id"])
    from pyspark.sql import functions as F

    done = inference.block_bootstrap(packed, block=F.lit(5), statistic=lambda m: np.median(m, axis=1), n_boot=200)
    assert done.first()["boot"]["point"] == pytest.approx(np.median(walk))


def test_constant_and_short_series(spark):
    flat = inference.mean_interval(make(spark, [0.5] * 30), ["model_id"], n_boot=50).first()
    assert flat["p_value"] == 1.0 and flat["ci_low"] == flat["ci_high"] == 0.5
    with pytest.raises(Exception, match="block floor"):
        inference.mean_interval(make(spark, [0.1, 0.2, 0.3]), ["model_id"]).collect()
    short = inference.mean_interval(make(spark, [0.1, 0.2, 0.3]), ["model_id"], short="one_block", n_boot=50).first()
    assert short["block"] == 3


def test_benjamini_hochberg(spark):
    rng = np.random.default_rng(0)
    p = np.append(rng.uniform(size=30) ** 2, [np.nan, 1.0])
    df = spark.createDataFrame([(f"{i:02d}", float(v)) for i, v in enumerate(p)], "feature string, p_value double")
    got = {r["feature"]: r["fdr_q"] for r in inference.benjamini_hochberg(df, order=["feature"]).collect()}
    known = np.where(np.isfinite(p), p, 1.0)
    order = np.argsort(known, kind="stable")
    raw = known[order] * len(p) / np.arange(1, len(p) + 1)
    want = np.empty(len(p))
    want[order] = np.minimum(np.minimum.accumulate(raw[::-1])[::-1], 1.0)
    assert [got[f"{i:02d}"] for i in range(len(p))] == pytest.approx(list(want))


def test_short_series_get_no_interval(spark, walk):
    few = make(spark, walk[:4])
    got = inference.mean_interval(few, ["model_id"], short="null", n_boot=50).first()
    assert got["n"] == 4 and got["point"] is None and got["ci_low"] is None and got["p_value"] is None
    assert inference.ac_sharpe_interval(few, ["model_id"], n_boot=50).first()["point"] is None
    enough = inference.mean_interval(make(spark, walk[:5]), ["model_id"], short="null", n_boot=50).first()
    assert enough["point"] is not None
    with pytest.raises(ValueError):
        inference.mean_interval(few, ["model_id"], short="maybe")


def test_payout_report_matches_single_operators(spark, walk):
    df = make(spark, walk - 0.012).withColumn("raw", __import__("pyspark.sql.functions", fromlist=["x"]).col("value") * 1.5)
    r = series.payout_report(df, ["model_id"]).first()
    assert r["cvar5"] == pytest.approx(series.cvar(df, ["model_id"]).first()["cvar"])
    c = series.calmar(df, ["model_id"]).first()
    assert (r["max_drawdown"], r["calmar"]) == pytest.approx((c["max_drawdown"], c["calmar"]))
    assert r["max_burn_streak"] == series.max_burn_streak(df, ["model_id"]).first()["max_burn_streak"]
    assert r["time_to_recovery"] == series.time_to_recovery(df, ["model_id"]).first()["time_to_recovery"]


@pytest.mark.parametrize("values", [[0.1] * 6, [-0.1] * 6, [0.0] * 6])
def test_payout_edges(spark, values):
    from pyspark.sql import functions as F

    df = make(spark, values).withColumn("raw", F.col("value"))
    r = series.payout_report(df, ["model_id"]).first()
    if values[0] > 0:
        assert r["gain_to_pain_ratio"] == float("inf") and r["calmar"] == float("inf")
    elif values[0] < 0:
        assert r["gain_to_pain_ratio"] == 0.0 and r["burn_rate"] == 1.0 and r["max_burn_streak"] == 6
    else:
        assert r["gain_to_pain_ratio"] == 0.0 and r["calmar"] == 0.0 and r["sortino"] == 0.0


def test_fleet_reasons(spark):
    one = spark.createDataFrame([("a", 0.1, 0.0, 3.0, 50)], "model_id string, sharpe double, skew double, kurt double, n long")
    assert inference.deflated_sharpe_fleet(one).first()["reason"] == "insufficient_trials"
    same = one.union(one.selectExpr("'b'", "sharpe", "skew", "kurt", "n"))
    assert inference.deflated_sharpe_fleet(same).first()["reason"] == "zero_cross_trial_sharpe_variance"
    bad = one.union(spark.createDataFrame([("b", 2.0, 5.0, 1.0, 50)], one.schema))
    reasons = {r["model_id"]: r["reason"] for r in inference.deflated_sharpe_fleet(bad).collect()}
    assert reasons == {"a": "", "b": "radicand"}


def test_too_few_shared_eras(spark, walk):
    a, b = make(spark, walk[:15]), make(spark, walk[5:20])
    with pytest.raises(Exception, match="shared eras"):
        inference.paired_comparison(a, b, ["model_id"], n_boot=20).collect()
