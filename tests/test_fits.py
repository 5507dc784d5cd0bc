import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eraflow.operators import ensemble, fits, folds
from eraflow.operators.neutralize import neutralize, project

import brute


def wide(seed=5, eras=3, rows=80, k=12):
    rng = np.random.default_rng(seed)
    parts = []
    for e in range(1, eras + 1):
        x = rng.normal(size=(rows, k))
        parts.append(pd.DataFrame({
            "era": f"{e:04d}", "id": [f"{i:03d}" for i in range(rows)], "features": list(x),
            "p": x @ rng.normal(size=k) + rng.normal(size=rows), "q": rng.normal(size=rows),
        }))
    return pd.concat(parts, ignore_index=True)


def residuals(pdf, column, share=1.0):
    out = {}
    for _, part in pdf.groupby("era"):
        x = np.vstack(part["features"])
        y = part[column].to_numpy()
        rest = y if np.ptp(y) == 0 else y - share * (y - brute.residual(y, x))
        out.update(zip(zip(part["era"], part["id"]), rest))
    return out


@pytest.mark.parametrize("cap,one_step", [("1000000", 65536), ("1000000", 5), ("20", 65536)])
@pytest.mark.parametrize("case", ["plain", "duplicate", "constant", "flat_pred", "few_rows"])
def test_neutralize_against_lstsq(spark, case, cap, one_step, monkeypatch):
    monkeypatch.setattr("eraflow.operators.neutralize.ONE_STEP_ROWS", one_step)
    pdf = wide(rows=8 if case == "few_rows" else 80)
    if case == "duplicate":
        pdf["features"] = [np.append(f, f[0]) for f in pdf["features"]]
    if case == "constant":
        pdf["features"] = [np.append(f, 3.0) for f in pdf["features"]]
    if case == "flat_pred":
        pdf.loc[pdf["era"] == "0002", "p"] = 4.0
    spark.conf.set("spark.eraflow.maxGroupRows", cap)
    try:
        got = neutralize(spark.createDataFrame(pdf).repartition(5), "p", "features", 0.5).collect()
    finally:
        spark.conf.unset("spark.eraflow.maxGroupRows")
    want = residuals(pdf, "p", 0.5)
    assert len(got) == len(pdf)
    for r in got:
        assert r["p"] == pytest.approx(want[(r["era"], r["id"])], abs=1e-8)


def test_several_predictions_share_a_fit(spark):
    pdf = wide()
    got = project(spark.createDataFrame(pdf), ["p", "q"], "features", ["era"]).collect()
    for name in ("p", "q"):
        want = residuals(pdf, name)
        for r in got:
            assert r[name] - r[f"fit_{name}"] == pytest.approx(want[(r["era"], r["id"])], abs=1e-8)


def test_zero_share_is_identity_and_bad_inputs_fail(spark):
    pdf = wide(eras=1)
    df = spark.createDataFrame(pdf)
    assert neutralize(df, "p", "features", 0.0) is df
    with pytest.raises(ValueError):
        neutralize(df, "p", "features", 1.5)
    pdf.loc[3, "p"] = np.nan
    with pytest.raises(Exception, match="finite"):
        neutralize(spark.createDataFrame(pdf), "p", "features").collect()


@pytest.mark.parametrize("alpha", [0.1, 10.0, 500.0])
def test_ridge_matches_closed_form(spark, alpha):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 5, size=(200, 3)).astype(float)
    y = x @ [0.5, -0.25, 0.0] + rng.normal(size=200)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y)
    model = fits.ridge(spark.createDataFrame(pdf), ["a", "b", "c"], "y", alpha)
    xc, yc = x - x.mean(axis=0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
    assert np.allclose(model.coefficients.toArray(), want, atol=1e-8)
    assert model.intercept == pytest.approx(y.mean() - x.mean(axis=0) @ want)


def test_non_negative_solution_is_optimal():
    rng = np.random.default_rng(9)
    for _ in range(50):
        x, y = rng.normal(size=(40, 5)), rng.normal(size=40)
        g, r = x.T @ x, x.T @ y
        w = ensemble.non_negative_solution(g, r)
        slope = g @ w - r
        assert (w >= 0).all()
        assert (slope >= -1e-6).all() and abs(w @ slope) < 1e-6


def test_blend_equal_weights_default(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"era": ["1"] * 30, "id": range(30), "a": rng.normal(size=30), "b": rng.normal(size=30)})
    got = ensemble.blend(spark.createDataFrame(pdf), ["a", "b"]).toPandas().sort_values("id")

    def unit(v):
        z = brute.gauss(v)
        return z / z.std()

    want = brute.gauss(np.round(0.5 * unit(pdf["a"]) + 0.5 * unit(pdf["b"]), 12))
    assert np.allclose(got["prediction"], want)
    with pytest.raises(ValueError):
        ensemble.blend(spark.createDataFrame(pdf), ["a", "b"], [1.0])


def era_frame(spark, n, gap_at=None):
    nums = [i for i in range(1, n + 1) if i != gap_at]
    return spark.createDataFrame([(f"{i:04d}", i) for i in nums], "era string, era_num int")


def test_walk_forward_invariants(spark):
    eras = era_frame(spark, 60)
    table = folds.walk_forward(eras, 4, 8)
    assert folds.fold_violations(table, eras, 8).count() == 0
    assert folds.fold_violations(table, eras, 7).count() == 4
    val = table.where("role = 'val'").groupBy("fold").count().collect()
    assert {r["count"] for r in val} == {12}


def test_split_errors(spark):
    with pytest.raises(Exception, match="too few eras"):
        folds.walk_forward(era_frame(spark, 9), 4, 8).collect()
    train, val = era_frame(spark, 40), spark.createDataFrame([("0050", 50)], "era string, era_num int")
    with pytest.raises(Exception, match="purge gap"):
        folds.purged_split(train, val, 8).collect()
    with pytest.raises(ValueError):
        folds.require_purge(era_frame(spark, 40), ["target_x_60"], 8)
    folds.require_purge(era_frame(spark, 20), ["target_x_60"], 8)


def test_out_of_fold_resumes(spark, sf_dir):
    from eraflow.sources.testpanel import FEATURES, customer_month

    df = customer_month(spark, sf_dir)
    table = folds.walk_forward(df.select("era", "era_num").distinct(), 2, 4)
    calls = []

    def fit(train):
        calls.append(1)
        return fits.ridge(train, FEATURES, "target", 1.0)

    run = f"resume-{uuid.uuid4().hex}"
    settings = {"target": "target", "alpha": 1.0}
    first = fits.out_of_fold(df, table, fit, FEATURES, run, settings).count()
    again = fits.out_of_fold(df, table, fit, FEATURES, run, settings).count()
    assert first == again and len(calls) == 2
    fits.out_of_fold(df, table, fit, FEATURES, run, {"target": "target", "alpha": 2.0}).count()
    assert len(calls) == 4  # another fit under the same name starts anew
    fits.out_of_fold(df, table, fit, FEATURES[:3] + FEATURES[3:][::-1], run, settings).count()
    assert len(calls) == 6
    with pytest.raises(ValueError, match="settings"):
        fits.out_of_fold(df, table, fit, FEATURES, run)


def test_generators_purge_the_train_eras(spark, sf_dir):
    from eraflow.sources.testpanel import FEATURES, customer_month

    p = customer_month(spark, sf_dir)
    train, val = p.where("split = 'train'"), p.where("split = 'validation'")
    assert fits.purged(train, val, ["target"], 8).agg(F.max("era_num")).first()[0] == 40
    with pytest.raises(ValueError, match="below"):
        fits.ridge_predictions(train, val, FEATURES, ["target_a_60"], 8)
    with pytest.raises(Exception, match="purge gap"):
        fits.ridge_predictions(train, val.where("era_num > 55"), FEATURES, ["target"], 8).collect()
    # what happens in the purged eras does not reach the predictions
    shaken = train.withColumn("target", F.when(F.col("era_num") > 40, 1.0 - F.col("target")).otherwise(F.col("target")))
    for predict in (
        lambda t: fits.ridge_predictions(t, val, FEATURES, ["target"], 8),
        lambda t: fits.tree_predictions(t, val, FEATURES, ["target"], 8, maxIter=2),
        lambda t: fits.ridge_stack(t, val, FEATURES, ["target"], "target", 0.25, 8),
    ):
        a = {(r["era"], r["id"]): r["prediction"] for r in predict(train).collect()}
        b = {(r["era"], r["id"]): r["prediction"] for r in predict(shaken).collect()}
        assert a == pytest.approx(b)


def test_stack_and_held_out_trees_with_a_60_era_target(spark, sf_dir):
    from eraflow.sources.testpanel import FEATURES, customer_month

    p = customer_month(spark, sf_dir)
    train, val = p.where("split = 'train'").cache(), p.where("split = 'validation'").cache()
    both = ["target", "target_a_60"]
    nums = sorted(r[0] for r in train.select("era_num").distinct().collect())
    known, outer = nums[:-16], nums[-16:]
    n_meta, n_held = round(len(known) * 0.25), round(len(known) * 0.15)
    meta, inner = known[-n_meta:], known[-n_meta - 16 : -n_meta]
    held = known[-n_held:]
    assert len(known) - n_meta - 16 >= 2

    def shaken(eras):
        return train.withColumns({t: F.when(F.col("era_num").isin(eras), 1.0 - F.col(t)).otherwise(F.col(t)) for t in both})

    def stack(t, purge=16):
        return fits.ridge_stack(t, val, FEATURES, both, "target", 0.25, purge, fill=0.5, neutralize_features=["f_qty"], proportion=0.5)

    def search(t, purge=16):
        return fits.ridge_stack_search(t, val, FEATURES, both, "target", "bench_b60", 0.25, purge, top=2, alphas=(1.0,), shares=(0.0,), sharpe_floor=-100.0)

    def trees(t, purge=16):
        return fits.tree_predictions(t, val, FEATURES, both, purge, weights=[0.7, 0.3], holdout_share=0.15, maxIter=2)

    def rounded(df):
        return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())

    within = [e for e in known if held[0] - 16 <= e < held[0]]
    for predict, hidden, used in ((stack, inner, meta), (search, inner, meta), (trees, within, known[:2])):
        with pytest.raises(ValueError, match="below"):
            predict(train, 8)
        want = rounded(predict(train))
        assert want and rounded(predict(shaken(outer + hidden))) == want
        assert rounded(predict(shaken(used))) != want


def test_full_history_model_loads_again(spark, sf_dir, tmp_path):
    from pyspark.ml.regression import LinearRegressionModel

    from eraflow.sources.testpanel import FEATURES, customer_month

    p = customer_month(spark, sf_dir)
    model = fits.full_history_fit(p, lambda t: fits.ridge(t, FEATURES, "target", 1.0), f"file://{tmp_path}/model")
    again = LinearRegressionModel.load(f"file://{tmp_path}/model")
    assert np.allclose(model.coefficients.toArray(), again.coefficients.toArray())


def test_null_predictions_do_not_depend_on_layout(spark):
    df = spark.range(200).select(F.lit("0001").alias("era"), F.col("id").cast("string").alias("id"))
    a = {r["id"]: r["prediction"] for r in fits.null_predictions(df, "gaussian", 4).collect()}
    b = {r["id"]: r["prediction"] for r in fits.null_predictions(df.repartition(7), "gaussian", 4).collect()}
    assert a == b and all(0.0 <= v <= 1.0 for v in a.values())
