"""Feature sets as bitmaps, digests that need no order, full versions."""

import json

import pytest
from pyspark.sql import functions as F

from eraflow.functions.hashing import multiset_digest
from eraflow.operators import compare, correlation
from eraflow.sources import documents


def frame(spark, sets):
    rows = [(name, f) for name, members in sets.items() for f in (members or [None])]
    return spark.createDataFrame(rows, "feature_set string, feature string")


@pytest.mark.parametrize("cap", ["1000000", "5"])
def test_contained_sets(spark, cap):
    import random

    rng = random.Random(4)
    sets = {f"s{i:03d}": rng.sample([f"f{k}" for k in range(90)], rng.choice([1, 2, 3, 40, 80])) for i in range(80)}
    sets |= {"all": [f"f{k}" for k in range(90)], "none": [], "twin": sets["s001"], "repeat": sets["s002"] * 2}
    spark.conf.set("spark.eraflow.maxGroupRows", cap)
    try:
        got = {tuple(r) for r in correlation.contained_sets(frame(spark, sets)).collect()}
    finally:
        spark.conf.unset("spark.eraflow.maxGroupRows")
    want = {(a, b) for a, x in sets.items() for b, y in sets.items() if a != b and x and set(x) <= set(y)}
    assert got == want
    pairs = {(r["a"], r["b"]): r["a_subset_of_b"] for r in correlation.set_subsets(frame(spark, sets)).collect()}
    assert pairs == {(a, b): set(x) <= set(y) for a, x in sets.items() for b, y in sets.items() if a != b}


def test_ten_thousand_sets(spark):
    n = 10_000
    sets = spark.range(n).select(
        F.concat(F.lit("s"), F.col("id")).alias("feature_set"),
        F.explode(F.array(F.concat(F.lit("f"), F.col("id")), F.concat(F.lit("f"), (F.col("id") + 1) % n), F.concat(F.lit("g"), F.col("id") % 50))).alias("feature"),
    )
    inside = spark.range(0, n, 100).select(F.concat(F.lit("t"), F.col("id")).alias("feature_set"), F.explode(F.array(F.concat(F.lit("f"), F.col("id")), F.concat(F.lit("g"), F.col("id") % 50))).alias("feature"))
    got = {tuple(r) for r in correlation.contained_sets(sets.unionByName(inside)).collect()}
    assert got == {(f"t{i}", f"s{i}") for i in range(0, n, 100)}


def digest(df, *columns):
    return multiset_digest(df, F.to_json(F.struct(*columns))).first()


def test_digest_of_rows_in_any_order(spark):
    df = spark.range(500).select("id", (F.col("id") % 7 / 3).alias("x"))
    one = digest(df, "id", "x")
    assert one["n_rows"] == 500
    assert digest(df.repartition(17, "x"), "id", "x") == one == digest(df.orderBy(F.desc("id")).coalesce(1), "id", "x")
    changed = df.withColumn("x", F.when(F.col("id") == 77, 9.0).otherwise(F.col("x")))
    swapped = df.withColumn("id", F.when(F.col("id") == 3, 4).otherwise(F.col("id")))
    for other in (changed, swapped, df.where("id > 0"), df.unionByName(df.limit(1)), df.unionByName(df)):
        assert digest(other, "id", "x")["digest"] != one["digest"]
    assert digest(df.limit(0), "id", "x")["n_rows"] == 0
    plan = multiset_digest(df, F.col("x").cast("string"))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Sort" not in plan


def test_full_versions(spark, tmp_path):
    def manifest(folder, **fields):
        path = tmp_path / "full" / folder
        path.mkdir(parents=True)
        (path / "manifest.json").write_text(json.dumps(fields) if "broken" not in fields else "{")

    config = {"data": {"feature_set": "all", "targets": ["target", "target_a_20"]}, "model": {"backend": "gbt", "preset": "deep"}}
    manifest("a1", family="a", promoted_from_run_id="r1", promoted_at="2026-01-01", config=config)
    manifest("a2", family="a", promoted_from_run_id="r2", promoted_at="2026-02-01", config=config)
    manifest("a3", family="a", promoted_from_run_id="r3", promoted_at="2026-03-01", rehearsal=True, config=config)
    manifest("b1", family="b", promoted_from_run_id="gone")
    manifest("c1", broken=True)
    manifest("d1", promoted_from_run_id="r2")
    for run, name in (("r1", "a"), ("r2", "a"), ("r9", "z")):
        path = tmp_path / "runs" / run
        path.mkdir(parents=True)
        (path / "run.json").write_text(json.dumps({"manifest": {"config": {"run": {"name": name}}}, "scorecard": {"corr": 0.02}}))
    versions = documents.read_full_versions(spark, f"{tmp_path}/full/*/manifest.json")
    runs = documents.read_run_records(spark, f"{tmp_path}/runs/*/run.json")
    board = documents.registry_leaderboard(runs, versions)
    assert tuple(board.columns) == documents.UNIFIED
    rows = {r["model_id"]: r for r in board.collect()}
    assert sorted(rows) == ["a::full", "b::full", "r1", "r2", "r9"]
    assert [rows[k]["has_full_version"] for k in ("r1", "r2", "r9", "a::full")] == [True, True, False, False]
    full = rows["a::full"]
    assert (full["source"], full["training_scope"], full["targets"], full["n_targets"], full["corr"]) == ("full", "full", "target, target_a_20", 2, None)
    assert full["run_dir"].endswith("/full/a2") and rows["r1"]["run_dir"].endswith("/runs/r1") and rows["b::full"]["n_targets"] is None
    assert [tuple(r) for r in documents.dangling_versions(versions, runs).collect()] == [("b", "gone")]
    status = {r["model_id"]: r["status"] for r in compare.gate_status(board).collect()}
    assert status["a::full"] == status["b::full"] == "FULL"
    assert [r["model_id"] for r in compare.ordered_leaderboard(board, "r9").collect()] == ["r9", "a::full", "b::full", "r1", "r2"]
    assert {r["model_id"] for r in compare.evaluable_rows(board).collect()} == {"r1", "r2", "r9"}


def test_summary_checks_its_policy(spark, tmp_path):
    (tmp_path / "run.json").write_text(json.dumps({"run_id": "r", "scorecard": {"corr_sharpe_ac": 1.0, "corr_sharpe_ac_n_eras": 30, "horizon_model_sharpe_20": 0.5, "perturb_ceiling_stability": 0.9, "regime_count": 2, "deflated_sharpe": 0.97}}))
    runs = documents.read_run_records(spark, f"{tmp_path}/run.json")
    row = compare.fleet_summary(runs, n_trials=3, confidence=0.96).first()
    assert (row["metric_n_eras"], row["dsr_pass"], row["has_horizon"], row["has_perturb"], row["has_regime"], row["has_bmc"]) == (30, True, True, True, True, False)
    assert (row["policy_n_trials"], row["policy_dsr_confidence"]) == (3, 0.96)
    for options in ({"n_trials": 0}, {"confidence": 1.0}, {"confidence": 0.0}):
        with pytest.raises(ValueError):
            compare.fleet_summary(runs, **options)
