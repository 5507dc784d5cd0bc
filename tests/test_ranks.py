import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eraflow.functions.ranks import with_group_stats, with_rank_gauss, with_ranks
from eraflow.functions.running import running_totals
from eraflow.operators.series import ordinal_percentile
from pyspark.sql import functions as F

from brute import gauss


def panel(seed=3, rows=400):
    """One era holds a third of all rows, one value holds a third of that era."""
    rng = np.random.default_rng(seed)
    era = np.where(np.arange(rows) < rows // 3, "0001", [f"{i % 5 + 2:04d}" for i in range(rows)])
    value = np.round(rng.normal(size=rows), 2)
    value[: rows // 9] = 0.25
    return pd.DataFrame({"era": era, "id": [f"{i:05d}" for i in range(rows)], "v": value})


def check(spark, frame, weight=None):
    df = spark.createDataFrame(frame)
    got = with_ranks(df, ["era"], {"r": "v"}, count_as="n").toPandas().sort_values("id")
    want = frame.assign(r=frame.groupby("era")["v"].rank(), n=frame.groupby("era")["v"].transform("size"))
    want = want.sort_values("id")
    assert np.allclose(got["r"].to_numpy(), want["r"].to_numpy())
    assert (got["n"].to_numpy() == want["n"].to_numpy()).all()


def test_window_layout(spark):
    check(spark, panel())


def test_bucket_layout(spark, tiny_groups):
    check(spark, panel())


def test_bucket_layout_without_broadcast(spark, tiny_groups, no_broadcast):
    check(spark, panel())


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-3, 3)), min_size=1, max_size=60))
def test_layouts_agree(spark, rows):
    frame = pd.DataFrame(
        [(f"{e:04d}", f"{i:03d}", float(v)) for i, (e, v) in enumerate(rows)], columns=["era", "id", "v"]
    )
    spark.conf.set("spark.eraflow.maxGroupRows", "3")
    try:
        check(spark, frame)
    finally:
        spark.conf.unset("spark.eraflow.maxGroupRows")


@pytest.mark.parametrize("cap", ["1000000", "7"])
def test_weighted_ranks(spark, cap):
    frame = panel()
    counts = frame.groupby(["era", "v"]).size().rename("w").reset_index()
    want = frame.assign(r=frame.groupby("era")["v"].rank()).drop_duplicates(["era", "v"])
    spark.conf.set("spark.eraflow.maxGroupRows", cap)
    try:
        got = with_ranks(spark.createDataFrame(counts), ["era"], {"r": "v"}, weight="w").toPandas()
    finally:
        spark.conf.unset("spark.eraflow.maxGroupRows")
    both = got.merge(want, on=["era", "v"])
    assert np.allclose(both["r_x"], both["r_y"])


def test_rank_gauss(spark):
    frame = panel()
    got = with_rank_gauss(spark.createDataFrame(frame), ["era"], {"z": "v"}).toPandas()
    for _, part in got.groupby("era"):
        assert np.allclose(part["z"], gauss(part["v"]), atol=1e-12)


def test_group_stats_layouts(spark, tiny_groups):
    frame = panel()
    got = with_group_stats(spark.createDataFrame(frame), ["era"], {"m": F.avg("v")}).toPandas()
    assert np.allclose(got["m"], got.groupby("era")["v"].transform("mean"))


@pytest.mark.parametrize("cap", ["1000000", "7"])
def test_running_totals(spark, cap):
    frame = panel().drop_duplicates(["era", "v"]).assign(w=lambda d: np.arange(len(d)) + 1)
    spark.conf.set("spark.eraflow.maxGroupRows", cap)
    try:
        got = running_totals(spark.createDataFrame(frame), ["era"], "v", {"b": "w"}, "nx").toPandas()
    finally:
        spark.conf.unset("spark.eraflow.maxGroupRows")
    got = got.sort_values(["era", "v"])
    want = frame.sort_values(["era", "v"])
    total = want.groupby("era")["w"].cumsum() - want["w"]
    assert (got["b"].to_numpy() == total.to_numpy()).all()
    assert np.allclose(got["nx"], want.groupby("era")["v"].shift(-1), equal_nan=True)


@pytest.mark.parametrize("cap", ["1000000", "7"])
def test_ordinal(spark, cap):
    frame = panel()
    spark.conf.set("spark.eraflow.maxGroupRows", cap)
    try:
        got = ordinal_percentile(spark.createDataFrame(frame), "v", "o").toPandas().sort_values("id")
    finally:
        spark.conf.unset("spark.eraflow.maxGroupRows")
    want = frame.sort_values("id").groupby("era")["v"].rank(method="first", pct=True)
    assert np.allclose(got["o"].to_numpy(), want.to_numpy())
