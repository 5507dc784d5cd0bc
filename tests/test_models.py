"""Many models on the features of an era: one factorization, the scores of each alone."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eraflow.operators import neutralize, scoring
from eraflow.plans import scorecard

import brute

K = 3


def panel(models=5, eras=3, rows=60, ragged=False, seed=2):
    rng = np.random.default_rng(seed)
    features, predictions = [], []
    for e in range(1, eras + 1):
        x = rng.normal(size=(rows, K))
        t = rng.integers(0, 5, size=rows) / 4
        for i in range(rows):
            features.append((f"{e:04d}", f"{i:03d}", float(t[i]), *map(float, x[i])))
        for m in range(models):
            p = x @ rng.normal(size=K) + rng.normal(size=rows)
            for i in range(rows):
                if not ragged or (i + m) % (3 + m) or m == 0:
                    predictions.append((f"m{m}", f"{e:04d}", f"{i:03d}", float(p[i])))
    return features, predictions


ROWS = "era string, id string, target double, f0 double, f1 double, f2 double"
LONG = "model_id string, era string, id string, prediction double"
FEATURES = ["f0", "f1", "f2"]


def frames(spark, **options):
    features, predictions = panel(**options)
    return spark.createDataFrame(features, ROWS), spark.createDataFrame(predictions, LONG)


@pytest.mark.parametrize("ragged", [False, True])
@pytest.mark.parametrize("cap", ["1000000", "20"])
def test_scores_of_models_are_those_of_each_alone(spark, ragged, cap):
    rows, predictions = frames(spark, ragged=ragged)
    hole = F.when((F.col("id") == "007") & (F.col("era") == "0002"), F.lit(float("nan"))).otherwise(F.col("f1"))
    rows = rows.withColumn("f1", hole).repartition(5)
    predictions = predictions.unionByName(spark.createDataFrame([("flat", "0001", f"{i:03d}", 0.5) for i in range(40)] + [("few", "0003", "001", 0.1)], LONG))
    spark.conf.set("spark.eraflow.maxGroupRows", cap)
    try:
        got = {(r["model_id"], r["era"]): r["value"] for r in scoring.per_era_fnc_models(predictions, rows, FEATURES, "target").collect()}
        base = predictions.join(rows, ["era", "id"])
        want = {(r["model_id"], r["era"]): r["value"] for r in scoring.per_era_fnc(base, "prediction", FEATURES, "target", ["model_id", "era"]).collect()}
    finally:
        spark.conf.unset("spark.eraflow.maxGroupRows")
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(value, abs=1e-8)
    assert got[("flat", "0001")] == got[("few", "0003")] == 0.0


def test_against_numpy(spark):
    features, predictions = panel(models=2)
    got = scoring.per_era_fnc_models(spark.createDataFrame(predictions, LONG), spark.createDataFrame(features, ROWS), FEATURES, "target")
    f = pd.DataFrame(features, columns=["era", "id", "t", *FEATURES])
    p = pd.DataFrame(predictions, columns=["m", "era", "id", "p"])
    for r in got.collect():
        part = p[(p["m"] == r["model_id"]) & (p["era"] == r["era"])].merge(f, on=["era", "id"])
        rest = brute.residual(brute.gauss(part["p"]), part[FEATURES].to_numpy())
        assert r["value"] == pytest.approx(brute.corr(rest, part["t"].to_numpy()), abs=1e-8)


def test_fifty_models_cost_one_factorization_per_era(spark, monkeypatch):
    rows, predictions = frames(spark, models=50, eras=3, rows=40)
    seen = []
    real = neutralize.factors

    def noted(df, tail, vector, by, shape=None):
        out = real(df, tail, vector, by, shape)
        seen.append((df.count(), out.select(*by).distinct().count()))
        return out

    monkeypatch.setattr(neutralize, "factors", noted)
    got = scoring.per_era_fnc_models(predictions, rows, FEATURES, "target").collect()
    assert len(got) == 150 and seen == [(120, 3)]  # rows once, not once per model; one group per era


def test_exposure_of_models(spark):
    rows, predictions = frames(spark, ragged=True)
    got = {r["model_id"]: r["max_feature_exposure"] for r in scorecard.max_exposure(predictions, rows, FEATURES).collect()}
    joined = predictions.join(rows, ["era", "id"]).toPandas()
    for model, part in joined.groupby("model_id"):
        want = max(abs(np.corrcoef(p["prediction"], p[f])[0, 1]) for _, p in part.groupby("era") for f in FEATURES)
        assert got[model] == pytest.approx(want, abs=1e-9)
