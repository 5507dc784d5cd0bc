import json

import pytest
from pyspark.sql import functions as F

from eraflow.operators import compare, correlation, rows
from eraflow.sources import documents, panel


def write(path, content):
    path.write_text(content if isinstance(content, str) else json.dumps(content))
    return str(path)


def test_feature_sets(spark, tmp_path):
    main = write(tmp_path / "features.json", {"feature_sets": {"small": ["b", "a"], "all": ["a", "b", "c"]}, "targets": []})
    extra = write(tmp_path / "extra.json", {"feature_sets": {"mine": ["c"]}})
    clash = write(tmp_path / "clash.json", {"feature_sets": {"small": ["c"]}})
    sets = documents.read_feature_sets(spark, main, extra)
    assert sets.count() == 6
    assert documents.resolve_set(sets, "small", ["a", "b"]) == ["b", "a"]
    assert documents.resolve_set(sets, "all", ["c"]) == ["c"]
    with pytest.raises(ValueError, match="twice"):
        documents.read_feature_sets(spark, main, clash)
    with pytest.raises(ValueError, match="overlap"):
        documents.resolve_set(sets, "small", ["z"])
    with pytest.raises(ValueError, match="missing"):
        documents.resolve_set(sets, "all", ["a"], require_all=True)
    relations = {(r["a"], r["b"]): r["a_subset_of_b"] for r in correlation.set_subsets(sets).collect()}
    assert relations[("small", "all")] and not relations[("all", "small")] and not relations[("mine", "small")]


def test_run_records(spark, tmp_path):
    full = {"run_id": "r1", "metrics": {"mean": 0.5, "sharpe": 1.0}, "manifest": {"scorecard_prediction_scale": "percentile_rank",
            "config": {"run": {"name": "n"}, "data": {"targets": ["t1", "t2"]}}}, "scorecard": {"corr": 0.0, "max_feature_exposure": 0.2}}
    legacy = {"run_id": "r2", "metrics": {"mean": 0.25}, "scorecard": None}
    for i, doc in enumerate([full, legacy, "{broken"]):
        (tmp_path / f"r{i}").mkdir()
        write(tmp_path / f"r{i}" / "run.json", doc)
    runs = documents.read_run_records(spark, f"{tmp_path}/*/run.json")
    board = {r["model_id"]: r for r in documents.run_leaderboard(runs).collect()}
    assert sorted(board) == ["r1", "r2"]
    # a stored 0.0 is real; only a missing value falls back
    assert board["r1"]["corr"] == 0.0 and board["r1"]["corr_sharpe_ac"] == 1.0
    assert board["r1"]["n_targets"] == 2 and board["r1"]["targets"] == "t1, t2"
    assert board["r2"]["corr"] == 0.25 and board["r2"]["source"] == "trained_legacy"
    assert board["r2"]["max_feature_exposure_reason"] == "pre_rank_fix_definition"


def test_campaigns(spark, tmp_path):
    log = {"campaign_id": "c", "name": "n", "configs": [{"path": "p"}], "runs": [
        {"config_path": "a/gbt_v2.yaml", "run_id": "x", "status": "recorded"}, {"config_path": "a/gbt_v3.yaml", "status": "failed", "error": "e"}]}
    got = documents.read_campaigns(spark, write(tmp_path / "log.json", log)).collect()
    assert [(r["variant"], r["status"]) for r in got] == [("gbt_v2", "recorded"), ("gbt_v3", "failed")]


def test_csv_spells_non_finite(spark, tmp_path):
    df = spark.createDataFrame([("a", float("nan")), ("b", float("inf")), ("c", 0.5), ("d", None)], "k string, v double")
    panel.write_csv(df, f"{tmp_path}/x")
    got = {r["k"]: r["v"] for r in spark.read.option("header", True).csv(f"{tmp_path}/x").collect()}
    assert got == {"a": "NaN", "b": "Infinity", "c": "0.5", "d": None}


def test_bucketed_table_keeps_labels_and_prunes(spark, tmp_path, sf_dir):
    from eraflow.sources.testpanel import customer_month

    path = f"{tmp_path}/t"
    panel.write_table(customer_month(spark, sf_dir).select("era", "era_num", "id"), path, 10)
    df = spark.read.parquet(path).where("era_bucket = 1")
    assert "0012" in {r["era"] for r in df.select("era").distinct().collect()}
    assert "PartitionFilters: [isnotnull(era_bucket" in df._jdf.queryExecution().toString()


def test_unknown_target(spark, tmp_path):
    spark.createDataFrame([("0001", "a", 1.0)], "era string, id string, target double").write.parquet(f"{tmp_path}/p")
    assert panel.scan(spark, f"{tmp_path}/p", ["f"], ["target"], ["target"]).columns == ["era", "id", "target"]
    with pytest.raises(ValueError, match="unknown"):
        panel.scan(spark, f"{tmp_path}/p", [], ["nope"], ["target"])


def test_era_labels(spark):
    good = spark.createDataFrame([("0002",), ("0010",), ("0002",)], "era string")
    assert [r["era_num"] for r in rows.validated_eras(good).orderBy("era_num").collect()] == [2, 10]
    with pytest.raises(Exception, match="non-numeric"):
        rows.validated_eras(good.union(spark.createDataFrame([("X",)], "era string"))).collect()
    with pytest.raises(Exception, match="zero padding"):
        rows.validated_eras(good.union(spark.createDataFrame([("2",)], "era string"))).collect()


def test_joins_that_must_not_lose_rows(spark):
    left = spark.createDataFrame([("1", "a"), ("1", "b")], "era string, id string")
    right = spark.createDataFrame([("1", "a", 1.0)], "era string, id string, f double")
    with pytest.raises(ValueError):
        rows.complete_join(left, right)
    with pytest.raises(ValueError):
        rows.evaluation_base(left.drop("id"), right, right, right)
    diff = {(r["id"], r["problem"]) for r in rows.universe_differences(left, right).collect()}
    assert diff == {("b", "extra")}


def test_newest_version(spark):
    df = spark.createDataFrame([("v5.2",), ("v5.10",), ("v4.99",), ("latest",)], "version string")
    assert panel.newest_version(df).first()["newest"] == "v5.10"


def test_gate_and_placement(spark):
    card = dict(model_id="m", corr=0.03, corr_sharpe_ac=0.9, fnc=0.03, deflated_sharpe=0.1, gain_to_pain_ratio=2.0, cagr_1y=0.0, turnover_mean=0.2)
    schema = "model_id string, corr double, corr_sharpe_ac double, fnc double, deflated_sharpe double, gain_to_pain_ratio double, cagr_1y double, turnover_mean double"
    df = spark.createDataFrame([tuple(card.values())], schema)
    fields = [f for f, _, _ in compare.GATE]
    report = {r["field"]: r["pass"] for r in compare.gate_report(df, compare.gate_table(spark), fields).collect()}
    assert report["cagr_1y"] is False and report["deflated_sharpe"] is None and report["turnover_mean"] is True
    with pytest.raises(Exception, match="non-finite"):
        compare.gate_report(df.withColumn("corr", F.lit(float("nan"))), compare.gate_table(spark), fields).collect()
    rungs = spark.createDataFrame([(0, 0.01), (1, 0.02), (2, 0.04)], "tier int, corr double")
    values = spark.createDataFrame([("a", 0.0), ("b", 0.015), ("c", 0.04), ("d", 0.5)], "model_id string, corr double")
    got = {r["model_id"]: r["placement"] for r in compare.place(values, rungs).collect()}
    assert got == {"a": "below tier 0", "b": "tier0..tier1", "c": "tier2", "d": "above tier 2"}
