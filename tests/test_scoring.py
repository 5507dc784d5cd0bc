import numpy as np
import pandas as pd
import pytest

from eraflow.operators import scoring
from eraflow.operators.series import summarize, with_era_num

import brute


def frame(seed=11, eras=4, rows=60):
    rng = np.random.default_rng(seed)
    out = []
    for e in range(1, eras + 1):
        f = rng.integers(0, 5, size=(rows, 3)).astype(float)
        pred = f @ [0.3, -0.2, 0.1] + rng.normal(size=rows)
        out.append(pd.DataFrame({
            "era": f"{e:04d}", "id": [f"i{i:03d}" for i in range(rows)], "pred": pred,
            "meta": pred + rng.normal(size=rows), "target": rng.integers(0, 5, rows) / 4.0,
            "f1": f[:, 0], "f2": f[:, 1], "f3": f[:, 2],
        }))
    return pd.concat(out, ignore_index=True)


def values(df):
    return {r["era"]: r["value"] for r in df.collect()}


def mutate(kind):
    df = frame()
    one = df["era"] == "0002"
    if kind == "constant_pred":
        df.loc[one, "pred"] = 1.0
    elif kind == "constant_target":
        df.loc[one, "target"] = 0.5
    elif kind == "constant_meta":
        df.loc[one, "meta"] = 2.0
    elif kind == "nan_pred":
        df.loc[df.index[one][:7], "pred"] = np.nan
    elif kind == "ties_pred":
        df.loc[one, "pred"] = np.round(df.loc[one, "pred"])
    elif kind == "single_row":
        df = df[~one | (df["id"] == "i000")]
    elif kind == "two_rows":
        df = df[~one | (df["id"] <= "i001")]
    elif kind == "wide_target":
        df.loc[one, "target"] = df.loc[one, "target"] * 3
    return df


KINDS = ["none", "constant_pred", "constant_target", "constant_meta", "nan_pred", "ties_pred",
         "single_row", "two_rows", "wide_target"]


@pytest.mark.parametrize("kind", KINDS)
def test_scores_against_numpy(spark, kind):
    pdf = mutate(kind)
    df = spark.createDataFrame(pdf)
    got = {
        "corr": values(scoring.per_era_corr(df, "pred", "target")),
        "mmc": values(scoring.per_era_mmc(df, "pred", "meta", "target")),
    }
    for era, part in pdf.groupby("era"):
        clean = part[np.isfinite(part["pred"])]
        p, m, t = (clean[c].to_numpy() for c in ("pred", "meta", "target"))
        assert got["corr"][era] == pytest.approx(brute.corr(p, t), abs=1e-9)
        assert got["mmc"][era] == pytest.approx(brute.mmc(p, m, t), abs=1e-9)


def test_core_scores_match_single_ones(spark):
    df = spark.createDataFrame(frame())
    core = {r["era"]: r for r in scoring.core_scores(df, "pred", "meta", "target").collect()}
    for name, series in {
        "corr": scoring.per_era_corr(df, "pred", "target"),
        "meta_corr": scoring.per_era_corr(df, "meta", "target"),
        "mmc": scoring.per_era_mmc(df, "pred", "meta", "target"),
        "cwmm": scoring.per_era_cwmm(df, "pred", "meta", min_overlap_eras=1),
    }.items():
        for era, value in values(series).items():
            assert core[era][name] == pytest.approx(value, abs=1e-12)


@pytest.mark.parametrize("kind", ["none", "ties_pred", "nan_pred", "constant_pred"])
@pytest.mark.parametrize("extra", [None, "duplicate", "constant"])
def test_fnc_against_numpy(spark, kind, extra):
    pdf = mutate(kind)
    features = ["f1", "f2", "f3"]
    if extra == "duplicate":
        pdf["f4"] = pdf["f1"]
        features.append("f4")
    elif extra == "constant":
        pdf["f4"] = 1.0
        features.append("f4")
    got = values(scoring.per_era_fnc(spark.createDataFrame(pdf), "pred", features, "target"))
    for era, part in pdf.groupby("era"):
        clean = part[np.isfinite(part["pred"])]
        p, t = clean["pred"].to_numpy(), clean["target"].to_numpy()
        want = 0.0
        if not brute.degenerate(p, t):
            rest = brute.residual(brute.gauss(p), clean[features].to_numpy())
            want = brute.corr(np.round(rest, 12), t)
        assert got[era] == pytest.approx(want, abs=1e-6)


def test_self_correlation_and_monotone_invariance(spark):
    pdf = frame()
    pdf["same"] = pdf["pred"] * 7 - 3
    df = spark.createDataFrame(pdf)
    for value in values(scoring.per_era_cwmm(df, "pred", "same", min_overlap_eras=1)).values():
        assert value == pytest.approx(1.0)
    a = values(scoring.per_era_corr(df, "pred", "target"))
    b = values(scoring.per_era_corr(df, "same", "target"))
    assert a == pytest.approx(b)


def test_overlap_floor(spark):
    df = spark.createDataFrame(frame())
    with pytest.raises(scoring.NonVacuityError):
        scoring.per_era_bmc(df, "pred", "meta", "target", min_overlap_eras=5)


def test_bmc_leaves_out_uncovered_eras(spark):
    pdf = frame()
    pdf.loc[pdf["era"] == "0003", "meta"] = np.nan
    got = values(scoring.per_era_bmc(spark.createDataFrame(pdf), "pred", "meta", "target", min_overlap_eras=1))
    assert sorted(got) == ["0001", "0002", "0004"]


def test_drawdown_starts_at_first_value(spark):
    df = spark.createDataFrame([("0001", -1.0), ("0002", 0.5), ("0010", -0.25)], "era string, value double")
    row = summarize(df).first()
    assert row["max_drawdown"] == pytest.approx(0.25)
    assert with_era_num(df).agg({"era_num": "max"}).first()[0] == 10


def test_turnover_needs_ten_shared_ids(spark):
    pdf = frame(eras=3, rows=20)
    pdf = pdf[~((pdf["era"] == "0003") & (pdf["id"] >= "i009"))].assign(era_num=lambda d: d["era"].astype(int))
    got = scoring.per_era_turnover(spark.createDataFrame(pdf), "pred").collect()
    assert [r["era"] for r in got] == ["0002"]
    a = pdf[pdf["era"] == "0001"].set_index("id")["pred"]
    b = pdf[pdf["era"] == "0002"].set_index("id")["pred"]
    rho = brute.pearson(brute.avg_rank(a), brute.avg_rank(b.loc[a.index]))
    assert got[0]["value"] == pytest.approx(1 - rho)
