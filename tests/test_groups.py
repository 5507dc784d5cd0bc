"""Scores of whole groups in numpy agree with the layouts for groups of any size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eraflow.functions import groups
from eraflow.operators import scoring

BY = ["model_id", "era"]


@pytest.fixture(scope="module")
def rows(spark):
    cell = lambda salt, bins: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(bins)) / F.lit(float(bins))
    df = spark.range(400).select(
        F.concat(F.lit("m"), F.pmod("id", F.lit(2))).alias("model_id"), F.lpad((F.col("id") % 7).cast("string"), 4, "0").alias("era"),
        cell(1, 60).alias("p"), cell(2, 900).alias("m"), cell(3, 5).alias("t"), F.col("id"),
    )
    odd = F.pmod("id", F.lit(14))
    return df.withColumns({
        "p": F.when(odd == 3, 0.5).when(F.col("id") % 31 == 0, float("nan")).otherwise(F.col("p")),
        "m": F.when(odd == 5, None).when(F.col("id") % 37 == 0, None).otherwise(F.col("m")),
        "t": F.when(F.col("id") % 41 == 0, float("inf")).otherwise(F.col("t")),
    }).drop("id").localCheckpoint()


SCORES = {
    "mmc": lambda df: scoring.per_era_mmc(df, "p", "m", "t", BY),
    "bmc": lambda df: scoring.per_era_bmc(df, "p", "m", "t", BY, 0),
    "cwmm": lambda df: scoring.per_era_cwmm(df, "p", "m", BY, 0),
    "core": lambda df: scoring.core_scores(scoring.complete_rows(df, ["p", "m", "t"]), "p", "m", "t", BY),
}


@pytest.mark.parametrize("name", sorted(SCORES))
def test_both_layouts(spark, rows, name, monkeypatch):
    grouped = SCORES[name](rows)
    assert "Window" not in grouped._jdf.queryExecution().executedPlan().toString()
    got = grouped.orderBy(*BY).toPandas()
    monkeypatch.setattr(groups, "fits_task", lambda *_: False)
    want = SCORES[name](rows).orderBy(*BY).toPandas()
    assert got[BY].equals(want[BY]) and len(got)
    assert np.allclose(got.drop(columns=BY), want[got.columns.drop(BY)], atol=1e-12)


def test_equal_hashes(spark, rows, monkeypatch):
    want = SCORES["mmc"](rows).orderBy(*BY).toPandas()
    monkeypatch.setattr(groups.F, "xxhash64", lambda *_: F.lit(1).cast("bigint"))
    assert SCORES["mmc"](rows).orderBy(*BY).toPandas().equals(want)


def test_tasks_hold_a_bounded_number_of_rows(spark, monkeypatch):
    """Groups are dealt once, over tasks that do not grow with the rows."""
    rows = [(f"{e:04d}", float((i * 7 + e) % 11), float(i % 3), float(i % 5)) for e in range(40) for i in range(30)]
    df = spark.createDataFrame(rows, "era string, p double, m double, t double")

    def found():
        frames = scoring.per_era_corr(df, "p", "t"), scoring.per_era_mmc(df, "p", "m", "t")
        plans = [f._jdf.queryExecution().executedPlan().toString() for f in frames]
        return plans, [sorted((r["era"], round(r["value"], 9)) for r in f.collect()) for f in frames]

    _, want = found()
    monkeypatch.setattr(groups, "TASK_ROWS", 60)
    plans, got = found()
    assert got == want
    for plan in plans:
        assert "20), REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning") == 1
    spark.conf.set("spark.eraflow.maxGroupRows", "20")  # no task takes a group that is too large for it
    try:
        assert "REPARTITION_BY_NUM" not in scoring.per_era_corr(df, "p", "t")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.eraflow.maxGroupRows")
