"""Distribution drift of features between two sides (train, validation).

Values are first counted per (feature, value) and side; the counts of a binned
feature fit a few rows, those of a continuous one stay distributed, and running
totals along the value give quantiles, distribution functions and ranks without
gathering a feature in one task. Results are exact, not sampled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eraflow.functions.running import running_totals
from eraflow.functions.stats import is_finite, ratio
from eraflow.operators.analysis import labelled, unpivot
from eraflow.session import broadcast_checked, materialize

PSI_EPSILON = 1e-6
PSI_FLAG, W1_FLAG, AUC_FLAG = 0.25, 0.5, 0.1


def value_counts(df: DataFrame, features: Sequence[str], is_train: Column) -> DataFrame:
    """(feature, v, nt, nv): finite values with their counts on either side."""
    long = unpivot(df.withColumn("__train", is_train), ["__train"], features, "v")
    counts = long.where(is_finite("v")).groupBy("k", "v").agg(
        F.count_if("__train").alias("nt"), F.count_if(~F.col("__train")).alias("nv")
    )
    return labelled(counts, features, "feature")


def side_totals(counts: DataFrame) -> DataFrame:
    """Rows on either side, and the train mean and deviation, of every feature."""
    sums = counts.groupBy("feature").agg(
        F.sum("nt").alias("n_train"),
        F.sum("nv").alias("n_val"),
        ratio(F.sum(F.col("nt") * F.col("v")), F.sum("nt")).alias("train_mean"),
        (F.min(F.when(F.col("nt") > 0, F.col("v"))) == F.max(F.when(F.col("nt") > 0, F.col("v")))).alias("train_constant"),
    )
    off = F.col("v") - F.col("train_mean")
    spread = counts.join(broadcast_checked(sums), "feature").groupBy("feature").agg(
        F.sqrt(ratio(F.sum(F.col("nt") * off * off), F.sum("nt"))).alias("train_std")
    )
    return sums.join(spread, "feature")


def quantile_edges(counts: DataFrame, totals: DataFrame, n_bins: int) -> DataFrame:
    """Interior train quantiles per feature, linear between order statistics.
    ``counts`` carries ``before_t``, the train rows below each value."""
    # One row of wanted positions per feature: of the values, only those that hold one of
    # them give rows.
    steps = F.array(*[F.struct(F.lit(i).alias("k"), (F.lit(i / n_bins) * (F.col("n_train") - 1)).alias("h")) for i in range(1, n_bins)])
    wanted = totals.where("n_train > 0").select("feature", steps.alias("wanted"))
    rows = counts.where("nt > 0").join(broadcast_checked(wanted), "feature")
    first, last = F.col("before_t"), F.col("before_t") + F.col("nt")

    def holds(position: Column) -> Column:
        return (position >= first) & (position < last)

    held = F.filter("wanted", lambda w: holds(F.floor(w["h"])) | holds(F.ceil(w["h"])))
    hit = rows.select("feature", "v", "before_t", "nt", F.explode(held).alias("w")).select("feature", "v", "before_t", "nt", "w.k", "w.h")
    edges = hit.groupBy("feature", "k", "h").agg(
        F.max(F.when(holds(F.floor("h")), F.col("v"))).alias("low"),
        F.max(F.when(holds(F.ceil("h")), F.col("v"))).alias("high"),
    )
    value = F.col("low") + (F.col("high") - F.col("low")) * (F.col("h") - F.floor("h"))
    return edges.groupBy("feature").agg(F.collect_list(value).alias("edges"))


def drift_profile(
    df: DataFrame,
    features: Sequence[str],
    is_train: Column,
    *,
    n_bins: int = 10,
    psi_flag: float = PSI_FLAG,
    w1_flag: float = W1_FLAG,
    auc_flag: float = AUC_FLAG,
) -> DataFrame:
    """Population stability index over train quantile bins, 1-Wasserstein distance (raw
    and in train deviations), and the area under the curve of telling the sides apart."""
    counts = materialize(value_counts(df, features, is_train), "value-counts")
    known = materialize(side_totals(counts), "side-totals")
    # a feature without a finite value anywhere keeps its row
    names = F.explode(F.array(*[F.lit(f) for f in features])).alias("feature")
    listed = known.agg(F.count(F.lit(1))).select(names)
    totals = listed.join(known, "feature", "left").fillna(0, ["n_train", "n_val"])
    placed = running_totals(
        counts, ["feature"], "v", {"before_t": "nt", "before_v": "nv"}, next_as="next_v"
    )
    placed = placed.join(broadcast_checked(known), "feature").where("n_train > 0 and n_val > 0")
    placed = materialize(placed, "placed")

    below_t = (F.col("before_t") + F.col("nt")) / F.col("n_train")
    below_v = (F.col("before_v") + F.col("nv")) / F.col("n_val")
    gap = F.abs(below_t - below_v) * (F.coalesce("next_v", F.col("v")) - F.col("v"))
    rank = F.col("before_t") + F.col("before_v") + (F.col("nt") + F.col("nv") + 1) / F.lit(2.0)
    distances = placed.groupBy("feature").agg(
        F.sum(gap).alias("w1"),
        (
            (F.sum(rank * F.col("nv")) - F.first("n_val") * (F.first("n_val") + 1) / F.lit(2.0))
            / (F.first("n_train").cast("double") * F.first("n_val"))
        ).alias("auc_roc"),
    )

    edges = quantile_edges(
        placed.select("feature", "v", "nt", "before_t"), known, n_bins
    )
    binned = placed.join(broadcast_checked(edges), "feature").withColumn(
        "bin", F.size(F.filter("edges", lambda e: e <= F.col("v")))
    )
    cells = binned.groupBy("feature", "bin").agg(
        (F.sum("nt") / F.first("n_train") + F.lit(PSI_EPSILON)).alias("pt"),
        (F.sum("nv") / F.first("n_val") + F.lit(PSI_EPSILON)).alias("pv"),
    )
    psi = cells.groupBy("feature").agg(
        F.sum((F.col("pv") - F.col("pt")) * F.log(F.col("pv") / F.col("pt"))).alias("psi")
    )
    out = totals.join(distances, "feature", "left").join(psi, "feature", "left")
    out = out.withColumn(
        "psi", F.when(F.col("train_constant") & (F.col("n_val") > 0), 0.0).otherwise(F.col("psi"))
    ).withColumn("w1_norm", ratio(F.col("w1"), F.col("train_std")))
    drifted = (
        F.coalesce(F.col("psi") > psi_flag, F.lit(False))
        | F.coalesce(F.col("w1_norm") > w1_flag, F.lit(False))
        | F.coalesce(F.abs(F.col("auc_roc") - 0.5) > auc_flag, F.lit(False))
    )
    return out.select(
        "feature", "psi", "w1", "w1_norm", "auc_roc", "n_train", "n_val", drifted.alias("drifted")
    )


def drift_psi(df: DataFrame, features: Sequence[str], is_train: Column, n_bins: int = 10) -> DataFrame:
    """The stability index alone, with its own flag."""
    profile = drift_profile(df, features, is_train, n_bins=n_bins)
    flag = F.coalesce(F.col("psi") > PSI_FLAG, F.lit(False))
    return profile.select("feature", "psi", "n_train", "n_val", flag.alias("drifted"))
