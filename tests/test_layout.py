"""Joins and era scans of tables in buckets of (era, id)."""

import uuid

import pytest
from pyspark.sql import functions as F

from eraflow.operators import rows, scoring
from eraflow.sources import layout
from eraflow.sources.testpanel import FEATURES, customer_month


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    folder, mark = tmp_path_factory.mktemp("layout"), uuid.uuid4().hex[:8]
    p = customer_month(spark, sf_dir)
    parts = {
        "predictions": p.select("era", "era_num", "id", F.col("pred_a").alias("prediction")),
        "meta": p.select("era", "era_num", "id", "meta"),
        "targets": p.select("era", "era_num", "id", "target"),
        "features": p.select("era", "era_num", "id", *FEATURES),
    }
    named = {k: f"{k}_{mark}" for k in parts}
    yield p, {k: layout.write_bucketed(df, named[k], f"{folder}/{k}", buckets=4) for k, df in parts.items()}, folder
    for name in named.values():
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def keyed(df, *columns):
    return df.select("era", "id", *columns)


def base_of(t):
    return rows.evaluation_base(
        keyed(t["predictions"], "prediction"), keyed(t["meta"], "meta"), keyed(t["targets"], "target"), keyed(t["features"], *FEATURES)
    )


def test_the_evaluation_base_joins_without_a_shuffle(spark, tables):
    p, t, _ = tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        base = base_of(t)
        text = plan(base)
        assert "Exchange" not in text and text.count("SortMergeJoin") == 3
        assert base.count() == p.count()
        attached = rows.attach_benchmark(keyed(t["predictions"], "prediction"), t["targets"], "target")
        assert "Exchange" not in plan(attached)
        scored = {r["era"]: r["value"] for r in scoring.per_era_corr(base, "prediction", "target").collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = {r["era"]: r["value"] for r in scoring.per_era_corr(p, "pred_a", "target").collect()}
    assert scored == pytest.approx(want, abs=1e-12)


def test_scans_of_eras_open_their_folders(spark, tables):
    p, t, _ = tables
    some = t["targets"].where(layout.eras_between(9, 20))
    assert "PartitionFilters: [isnotnull(era_bucket" in plan(some) and some.count() == p.where("era_num between 9 and 20").count()
    folders = {f.split("era_bucket=")[1].split("/")[0] for f in some.inputFiles()}
    assert folders <= {"1", "2"}
    assert t["targets"].where(layout.eras_between(last=7)).count() == p.where("era_num <= 7").count()
    assert t["targets"].where(layout.eras_between()).count() == p.count()


def test_another_session_opens_the_table(spark, tables):
    p, _, folder = tables
    name = f"again_{uuid.uuid4().hex[:8]}"
    try:
        again = layout.open_bucketed(spark, name, f"{folder}/targets", "era STRING, era_num INT, id STRING, target DOUBLE", 4)
        assert again.count() == p.count() and "Bucketed: true" in plan(again.groupBy("era", "id").count())
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    for bad in ("two words", "x;y", ""):
        with pytest.raises(ValueError):
            layout.open_bucketed(spark, bad, "/nowhere", "era STRING")
