"""Scores of all models of an era in one task, against the layouts of larger eras."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eraflow.functions import groups
from eraflow.operators import scoring
from eraflow.plans import reports, scorecard

FEATURES = ["f0", "f1"]
BASE = "model_id string, era string, id string, prediction double, meta double, y double, y60 double, bench double"


def frames(spark, eras=24, rows=30):
    rng = np.random.default_rng(5)
    base, features = [], []
    for e in range(1, eras + 1):
        for i in range(rows):
            x, y, meta = rng.integers(0, 5, size=2), float(rng.integers(0, 5)) / 4, float(rng.normal())
            hole = float("nan") if (e, i) == (2, 3) else float(x[0])
            features.append((f"{e:04d}", f"{i:03d}", y, hole, float(x[1])))
            for m in range(3):
                p = None if (e, i, m) == (3, 4, 1) else 0.5 if (e, m) == (5, 2) else float(np.round(x.sum() * m + rng.normal(), 1))
                base.append((f"m{m}", f"{e:04d}", f"{i:03d}", p, None if e == 4 else meta, y, y if i % 2 else None, None if e < 3 else meta + p if p else 0.1))
    return spark.createDataFrame(base, BASE), spark.createDataFrame(features, "era string, id string, y double, f0 double, f1 double")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_neutral_scores_need_neither_windows_nor_joins(spark):
    base, features = frames(spark)
    told = plan(scoring.per_era_fnc_models(base, features, FEATURES, "y"))
    assert "FlatMapCoGroupsInArrow" in told and "Window" not in told and "SortMergeJoin" not in told


def test_turnover_needs_no_windows_over_rows(spark):
    base, _ = frames(spark)
    base = base.withColumn("era_num", F.col("era").cast("int"))
    told = plan(scoring.per_era_turnover(base, "prediction", ["model_id"]))
    assert "FlatMapGroupsInArrow" in told and "rank(" not in told


@pytest.mark.parametrize("models", [1, 16])
def test_cards_are_those_of_the_layouts_of_large_eras(spark, monkeypatch, models):
    base, features = frames(spark)
    options = {"target": "y", "meta": "meta", "features": FEATURES, "benchmark": "bench", "horizon_pair": ("y", "y60"), "feature_rows": features, "n_boot": 20}

    def cards():
        return {r["model_id"]: r.asDict() for r in scorecard.flatten(scorecard.evaluate_models(base, **options)).collect()}

    monkeypatch.setattr(groups, "TASK_MODELS", models)
    got = cards()
    spark.conf.set("spark.eraflow.maxGroupRows", "20")
    try:
        want = cards()
    finally:
        spark.conf.unset("spark.eraflow.maxGroupRows")
    assert got.keys() == want.keys() == {"m0", "m1", "m2"}
    for model, row in want.items():
        assert row["horizon_model_decay"] is not None and row["n_degenerate_eras"] > 0
        for name, value in row.items():
            assert got[model][name] == (pytest.approx(value, abs=1e-9) if isinstance(value, float) else value), (model, name)


def test_campaign_correlations_are_those_of_the_joined_rows(spark, monkeypatch):
    base, features = frames(spark)
    nan = math.nan
    odd = [("m0", "0090", "a", nan), ("m0", "0090", "b", 0.5), ("m1", "0091", "a", 0.1), ("m1", "0092", "z", 0.1), ("m2", "0093", "a", 1.0), ("m2", "0093", "b", 2.0)]
    preds = base.select(F.col("model_id").alias("variant"), "era", "id", "prediction").unionByName(spark.createDataFrame(odd, "variant string, era string, id string, prediction double"))
    more = [(e, i, y, 1.0, 2.0) for e, i, y in [("0090", "a", 0.0), ("0090", "b", 1.0), ("0091", "a", 0.5), ("0093", "a", nan), ("0093", "b", 1.0)]]
    rows = features.unionByName(spark.createDataFrame(more, features.schema)).withColumn("y", F.when((F.col("era") != "0006") | (F.col("id") > "003"), F.col("y")))

    def found():
        return [{(r["variant"], r["era"]): r["value"] for r in df.collect()} for df in reports._ics(preds, rows, "y", FEATURES)]

    spark.conf.set("spark.eraflow.maxGroupRows", "20")
    try:
        want = found()
    finally:
        spark.conf.unset("spark.eraflow.maxGroupRows")

    def joined(*_):
        raise AssertionError("joined the rows of an era that a task can hold")

    monkeypatch.setattr(reports, "neutralized_ic", joined)
    got = found()
    assert len(want[0]) == 74 and len(want[1]) == 72 and want[0]["m0", "0090"] == 0.0
    for mine, theirs in zip(got, want, strict=True):
        assert mine.keys() == theirs.keys()
        assert all(mine[k] == pytest.approx(v, abs=1e-9) for k, v in theirs.items())


def test_turnover_with_nulls_nan_and_repeated_ids(spark):
    nan, inf = math.nan, math.inf
    values = [0.1, None, nan, inf, 0.3, None, nan, -inf, 0.3, 0.2, 0.7, 0.1]
    rows = [("a", f"{e:04d}", e, f"{(i * e) % 11}" if i else None, v) for e in (1, 2, 4) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "model_id string, era string, era_num int, id string, p double")

    def found():
        return sorted((r["era"], r["n_shared"], round(r["value"], 9)) for r in scoring.per_era_turnover(df, "p", ["model_id"], 1).collect())

    got = found()
    spark.conf.set("spark.eraflow.maxGroupRows", "7")
    try:
        assert got == found() and len(got) == 2
    finally:
        spark.conf.unset("spark.eraflow.maxGroupRows")


def test_gate_report_leaves_the_rows_where_they_are(spark):
    """A join dealt by field would give one task a field of all models."""
    from eraflow.operators import compare

    fields = [f for f, _, _ in compare.GATE]
    cards = spark.range(3).select(F.col("id").cast("string").alias("model_id"), *[F.lit(0.5).alias(f) for f in fields])
    report = compare.gate_report(cards, compare.gate_table(spark), fields)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    assert report.count() == 3 * len(fields)
