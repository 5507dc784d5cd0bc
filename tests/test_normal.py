"""Ridge fits from moments of eras, against closed forms over the rows."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eraflow.operators import ensemble, fits, folds, normal
from eraflow.operators.normal import Moments

K = 4


def panel(seed=3, eras=12, rows=30):
    rng = np.random.default_rng(seed)
    parts = []
    for e in range(1, eras + 1):
        x = rng.normal(size=(rows, K)) + 100.0
        y = x @ [0.5, -0.2, 0.1, 0.0] + rng.normal(size=rows)
        z = np.where(rng.random(rows) < 0.3, np.nan, x @ [0.0, 0.1, 0.2, 0.3] + rng.normal(size=rows))
        parts.append(pd.DataFrame({"era": f"{e:04d}", "era_num": e, "id": [f"{i:03d}" for i in range(rows)], "features": list(x), "y": y, "z": z}))
    return pd.concat(parts, ignore_index=True)


def closed(x, y, alpha, scaled_by=None):
    ok = np.isfinite(y)
    scale = np.ones(x.shape[1]) if scaled_by is None else scaled_by.std(axis=0)
    inverse = np.where(scale > 0, 1 / np.where(scale > 0, scale, 1), 0.0)
    u, v = x[ok] * inverse, y[ok]
    uc, vc = u - u.mean(axis=0), v - v.mean()
    w = np.linalg.solve(uc.T @ uc + alpha * np.eye(x.shape[1]), uc.T @ vc) * inverse
    return w, v.mean() - x[ok].mean(axis=0) @ w


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 40), st.integers(0, 39), st.integers(0, 10**6))
def test_moments_merge_and_pack(n, cut, seed):
    rows = np.random.default_rng(seed).normal(size=(n, 3)) * 10 + 1000
    cut = min(max(1, cut), n - 1)
    whole, both = Moments.of(rows), Moments.of(rows[:cut]).merge(Moments.of(rows[cut:]))
    again = Moments.unpacked(both.n, both.mean, both.packed())
    for found in (both, again):
        assert found.n == n and np.allclose(found.mean, whole.mean) and np.allclose(found.spread, whole.spread, atol=1e-6)


@pytest.mark.parametrize("cap", ["1000000", "20"])
@pytest.mark.parametrize("parts", [1, 30])
def test_fits_of_folds_targets_and_penalties(spark, cap, parts):
    pdf = panel()
    df = spark.createDataFrame(pdf).repartition(parts)
    groups = pd.DataFrame([(k, f"{e:04d}") for k in range(3) for e in range(1, 5 + 3 * k)], columns=["fold", "era"])
    spark.conf.set("spark.eraflow.maxGroupRows", cap)
    try:
        moments = normal.era_moments(df, "features", ["y", "z"])
        for scaled in (False, True):
            got = normal.ridge_fits(moments, ["y", "z"], [0.5, 50.0], spark.createDataFrame(groups), scaled=scaled).collect()
            assert sorted(r["fold"] for r in got) == [0, 1, 2]
            for r in got:
                part = pdf[pdf["era_num"] < 5 + 3 * r["fold"]]
                x = np.vstack(part["features"])
                assert [(f["target"], f["alpha"]) for f in r["fits"]] == [("y", 0.5), ("y", 50.0), ("z", 0.5), ("z", 50.0)]
                for f in r["fits"]:
                    w, b = closed(x, part[f["target"]].to_numpy(), f["alpha"], x if scaled else None)
                    assert np.allclose(f["coefficients"], w, atol=1e-7) and f["intercept"] == pytest.approx(b, abs=1e-5)
                    assert f["n"] == part[f["target"]].notna().sum()
    finally:
        spark.conf.unset("spark.eraflow.maxGroupRows")


def test_features_without_spread_and_zero_penalty(spark):
    pdf = panel(eras=2)
    pdf["features"] = [np.append(f, 7.0) for f in pdf["features"]]
    moments = normal.era_moments(spark.createDataFrame(pdf), "features", ["y"])
    x, y = np.vstack(pdf["features"]), pdf["y"].to_numpy()
    scaled = normal.ridge_fits(moments, ["y"], [1.0], scaled=True).first()["fits"][0]
    assert scaled["coefficients"][-1] == 0.0
    free = normal.ridge_fits(moments, ["y"], [0.0]).first()["fits"][0]
    want = np.linalg.lstsq(np.hstack([x[:, :K], np.ones((len(x), 1))]), y, rcond=None)[0]
    assert np.allclose(free["coefficients"][:K], want[:K], atol=1e-6)


def test_bad_rows_are_errors(spark):
    pdf = panel(eras=2)
    df = spark.createDataFrame(pdf)
    with pytest.raises(Exception, match="no finite rows"):
        normal.ridge_fits(normal.era_moments(df.withColumn("z", F.lit(None).cast("double")), "features", ["z"]), ["z"], [1.0])
    holes = df.withColumn("features", F.transform("features", lambda v: F.when(F.col("id") != "003", v)))
    with pytest.raises(Exception, match="finite"):
        normal.era_moments(holes, "features", ["y"])
    fitted = normal.ridge_fits(normal.era_moments(df, "features", ["y"]), ["y"], [1.0])
    with pytest.raises(Exception, match="finite"):
        normal.predict(holes, fitted, "features", ["p"]).collect()


def test_out_of_fold_equals_a_fit_per_fold(spark, sf_dir):
    from eraflow.sources.testpanel import FEATURES, customer_month

    df = customer_month(spark, sf_dir)
    table = folds.walk_forward(df.select("era", "era_num").distinct(), 2, 4)
    got = {(r["era"], r["id"]): r for r in fits.ridge_out_of_fold(df, table, FEATURES, ["target", "target_b_20"], 3.0).collect()}
    for t in ("target", "target_b_20"):
        want = fits.out_of_fold(df, table, lambda rows, t=t: fits.ridge(rows, FEATURES, t, 3.0), FEATURES).collect()
        assert len(want) == len(got)
        for r in want:
            assert got[(r["era"], r["id"])][t] == pytest.approx(r["prediction"], abs=1e-8)
    twice = table.unionByName(table.withColumn("fold", F.col("fold") + 2))
    with pytest.raises(ValueError, match="overlap"):
        fits.ridge_out_of_fold(df, twice, FEATURES, ["target"])


def passes_of(monkeypatch, job):
    """(tables a call stores from rows or moments, scans of files in the first's plan)."""
    names, scans = [], []
    real = normal.materialize

    def noted(df, name):
        names.append(name)
        scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return real(df, name)

    with monkeypatch.context() as patch:
        patch.setattr(normal, "materialize", noted)
        job()
    return names, scans[0]


def test_one_scan_of_the_train_rows_whatever_the_grid(spark, sf_dir, monkeypatch):
    from eraflow.sources.testpanel import FEATURES, customer_month

    p = customer_month(spark, sf_dir)
    train, val = p.where("split = 'train'"), p.where("split = 'validation'")

    def sweep(n):
        return lambda: fits.parameter_sweep(train, val, FEATURES, "target", [{"alpha": 2.0**i} for i in range(n)], 8).count()

    def predictions(n):
        return lambda: fits.ridge_predictions(train, val, FEATURES, ["target", "target_a_20", "target_b_20"][:n], 8).count()

    def configured(n):
        grid = [{"targets": ["target"], "alpha": 2.0**i} for i in range(n)]
        return lambda: fits.configuration_sweep(p, FEATURES, "target", grid, 8, n_folds=2).count()

    for make in (sweep, predictions, configured):
        one, three = passes_of(monkeypatch, make(1)), passes_of(monkeypatch, make(3))
        assert one == three and one[0] == ["moments", "ridge-fits"]


def test_configuration_sweep_learns_its_weights(spark, sf_dir):
    from eraflow.sources.testpanel import FEATURES, customer_month

    p = customer_month(spark, sf_dir)
    pair = ["target", "target_a_20"]
    grid = [{"targets": pair, "method": m, "alpha": 2.0} for m in ("ridge", "non_negative", "equal")] + [{"targets": ["target_a_20"], "alpha": 9.0}]
    got = {r["trial_id"]: r for r in fits.configuration_sweep(p, FEATURES, "target", grid, 8, n_folds=2).collect()}
    roles = folds.held_out(p.select("era", "era_num").distinct(), 0.2, 8)
    inner = p.join(roles.where("role = 'train'").select("era"), "era", "left_semi")
    table = folds.walk_forward(inner.select("era", "era_num").distinct(), 2, 8)
    oof = fits.ridge_out_of_fold(inner, table, FEATURES, pair, 2.0).withColumnsRenamed({t: f"p_{t}" for t in pair})
    joined = oof.join(inner.select("era", "id", "target"), ["era", "id"])
    for trial, method in enumerate(("ridge", "non_negative")):
        want = ensemble.learn_weights(joined, [f"p_{t}" for t in pair], "target", method)
        assert got[trial]["weights"] == pytest.approx(want, abs=1e-8)
    assert got[2]["weights"] == [0.5, 0.5]
    assert all(r["n"] == roles.where("role = 'held_out'").count() for r in got.values())
    with pytest.raises(ValueError, match="below"):
        fits.configuration_sweep(p, FEATURES, "target", [{"targets": ["target_a_60"]}], 8)


def test_trees_stop_on_the_last_eras(spark, sf_dir):
    from eraflow.sources.testpanel import FEATURES, customer_month

    p = customer_month(spark, sf_dir).where("era_num <= 12")
    model = fits.era_stopped_trees(p, FEATURES, "target", maxIter=4, maxDepth=2)
    assert 1 <= model.getNumTrees <= 4
    one = fits.era_stopped_trees(p.where("era_num = 1"), FEATURES, "target", maxIter=2, maxDepth=2)
    assert one.getNumTrees == 2
    with pytest.raises(ValueError, match="finite"):
        fits.era_stopped_trees(p.withColumn("target", F.lit(None).cast("double")), FEATURES, "target")
