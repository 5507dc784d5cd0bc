"""Correlations from products folded in the tasks: packed matrices and rank-once scores."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eraflow.operators import analysis, correlation, normal

import brute


def panel(eras=3, rows=50, k=5, seed=1):
    rng = np.random.default_rng(seed)
    parts = []
    for e in range(1, eras + 1):
        x = rng.normal(size=(rows, k))
        x[:, 1] = np.round(x[:, 1])
        frame = pd.DataFrame(x, columns=[f"f{i}" for i in range(k)])
        frame["y"] = x[:, 0] + rng.normal(size=rows)
        frame["z"] = np.where(rng.random(rows) < 0.2, np.nan, rng.integers(0, 3, rows) / 2)
        frame["w"] = 1.0 if e == 2 else frame["y"] * 2
        parts.append(frame.assign(era=f"{e:04d}", era_num=e, id=[f"{i:03d}" for i in range(rows)]))
    return pd.concat(parts, ignore_index=True)


FEATURES, TARGETS = [f"f{i}" for i in range(5)], ["y", "z", "w"]


@pytest.fixture()
def no_counts(spark):
    spark.conf.set("spark.eraflow.broadcastRows", "0")
    yield
    spark.conf.unset("spark.eraflow.broadcastRows")


def scores(df):
    return {(r["target"], r["era"], r["feature"]): (r["ic"], r["spearman_ic"], r["degenerate"]) for r in df.collect()}


def test_ranked_once_equals_counted(spark, no_counts):
    df = spark.createDataFrame(panel()).repartition(7)
    want = scores(analysis.counted_ic(df, FEATURES, TARGETS))
    got = scores(analysis.ic_by_era(df, FEATURES, TARGETS))
    assert got.keys() == want.keys()
    for key, (ic, spearman, degenerate) in want.items():
        assert got[key][:2] == pytest.approx((ic, spearman), abs=1e-9) and got[key][2] == degenerate
    assert got[("w", "0002", "f0")] == (0.0, 0.0, True)


def test_ranked_once_on_binned_features(spark, sf_dir):
    from eraflow.sources.testpanel import FEATURES as BINNED
    from eraflow.sources.testpanel import customer_month

    df = customer_month(spark, sf_dir).where("era_num <= 10")
    want = scores(analysis.counted_ic(df, BINNED, ["target", "target_b_20"]))
    got = scores(analysis.ranked_ic(df, BINNED, ["target", "target_b_20"]))
    for key, (ic, spearman, degenerate) in want.items():
        assert got[key][:2] == pytest.approx((ic, spearman), abs=1e-9) and got[key][2] == degenerate


def test_no_table_of_rows_features_and_targets(spark, monkeypatch):
    df = spark.createDataFrame(panel())
    plans = []
    real = analysis.materialize

    def noted(table, name):
        plans.append(table._jdf.queryExecution().executedPlan().toString())
        return real(table, name)

    monkeypatch.setattr(analysis, "materialize", noted)
    out = analysis.ranked_ic(df, FEATURES, ["y", "w"])  # finite on the same rows: ranked once for both
    assert len(plans) == 1 and plans[0].count("Generate posexplode") == 1
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "posexplode(ys" not in text and text.count("MapInArrow") == 4


@pytest.mark.parametrize("parts", [1, 12])
def test_cross_correlations(spark, parts):
    pdf = panel()
    df = spark.createDataFrame(pdf).repartition(parts).select("era", F.array(*FEATURES).alias("x"), F.array("y", "w").alias("t"))
    for r in normal.cross_correlations(df, "x", "t").collect():
        part = pdf[pdf["era"] == r["era"]]
        x, y = part[FEATURES[r["f"]]].to_numpy(), part[["y", "w"][r["t"]]].to_numpy()
        assert r["corr"] == pytest.approx(brute.pearson(x, y), abs=1e-10)


def direct(pdf, features):
    total = 0.0
    for _, part in pdf.groupby("era"):
        z = np.column_stack([brute.PPF(brute.avg_rank(part[f]) / (len(part) + 1)) for f in features])
        total = total + np.corrcoef(z.T)
    return total / pdf["era"].nunique()


@pytest.mark.parametrize("tile", [3, 4096])
def test_mean_correlations(spark, no_counts, tile):
    pdf = panel(k=6)
    features = [f"f{i}" for i in range(6)]
    got = correlation.mean_correlations(spark.createDataFrame(pdf).repartition(9), features, tile).collect()
    want = direct(pdf, features)
    assert sorted((r["a"], r["b"]) for r in got) == [(a, b) for a in range(6) for b in range(a + 1, 6)]
    for r in got:
        assert r["mean_corr"] == pytest.approx(want[r["a"], r["b"]], abs=1e-9)


def test_triangles_grow_with_eras_not_tasks(spark):
    rng = np.random.default_rng(3)
    rows = [(f"{e:04d}", f"{i}", rng.normal(size=64).tolist()) for e in range(1, 4) for i in range(150)]
    made = []
    for parts in (2, 40):
        z = spark.createDataFrame(rows, "era string, id string, z array<double>").repartition(parts)
        dealt = normal._dealt(z, ["era"], "z", 64)
        made.append(dealt.select("era", F.spark_partition_id().alias("p")).distinct().count())
        assert normal.era_moments(z, "z").count() == 3
    assert made[0] <= 6 and made[1] <= 6
