"""The panels the registered queries run on, derived from the given tables.

``customer_month`` is the main one: one row per customer and order month, with
integer-binned features, targets in [0, 1], prediction columns, a consensus
("meta") column and two benchmark columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eraflow.session import materialize, path_exists

FEATURES = ["f_lines", "f_qty", "f_disc", "f_tax", "f_prio", "f_maxq"]
TARGETS = ["target", "target_a_20", "target_a_60", "target_b_20"]
MODELS = ["pred_a", "pred_b", "pred_c"]
META = "meta"
BENCHMARKS = ["bench_a20", "bench_b60"]
TRAIN_LAST_ERA = 48

_tables: dict[tuple[str, str, str], tuple[str, DataFrame]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _bin(expression: str) -> F.Column:
    return F.expr(f"greatest(least({expression}, 4), 0)").cast("int")


def build_customer_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_custkey").alias("cust"),
        ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")).cast("int").alias("era_num"),
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("prio"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("total_cents"),
    )
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.col("l_quantity").cast("bigint").alias("qty"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("disc"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("tax"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
    )
    # every sum is over integers, so any engine and any task order gives the same panel
    grouped = (
        lines.join(orders, "l_orderkey")
        .groupBy("era_num", "cust")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.sum("qty").alias("qty"),
            F.max("qty").alias("maxq"),
            F.sum("disc").alias("disc"),
            F.sum("tax").alias("tax"),
            F.max("prio").alias("prio"),
            F.max("total_cents").alias("total_cents"),
            F.sum(F.col("cents") * (100 - F.col("disc"))).alias("rev"),
        )
        .withColumn("noise", F.expr("pmod(cust * 7919 + era_num * 104729, 1009)"))
        .withColumn("noise2", F.expr("pmod(cust * 104723 + era_num * 7907, 997)"))
    )
    return grouped.select(
        F.lpad(F.col("era_num").cast("string"), 4, "0").alias("era"),
        "era_num",
        F.col("cust").cast("string").alias("id"),
        F.when(F.col("era_num") <= TRAIN_LAST_ERA, "train").otherwise("validation").alias("split"),
        _bin("n_lines - 1").alias("f_lines"),
        _bin("qty div 45").alias("f_qty"),
        _bin("disc div 9").alias("f_disc"),
        _bin("tax div 7").alias("f_tax"),
        _bin("prio - 1").alias("f_prio"),
        _bin("maxq div 11").alias("f_maxq"),
        F.expr("least(rev div 1000000000, 4) / 4.0D").alias("target"),
        F.expr("least(total_cents div 12000000, 4) / 4.0D").alias("target_a_20"),
        F.expr("least((rev div 500000000 + tax) div 8, 4) / 4.0D").alias("target_a_60"),
        F.expr(
            "case when cust % 11 = 0 then null when cust % 13 = 0 then double('NaN') "
            "else least(rev div 1500000000, 4) / 4.0D end"
        ).alias("target_b_20"),
        F.expr("(30 * qty + 200 * n_lines + noise) / 10000.0D").alias("pred_a"),
        F.expr("(50 * maxq + 17 * disc + 3 * noise) / 10000.0D").alias("pred_b"),
        F.expr("noise / 1009.0D").alias("pred_c"),
        F.expr("(20 * qty + 60 * disc + 2 * noise2) / 10000.0D").alias("meta"),
        F.expr("case when era_num > 10 then (10 * qty + noise2) / 1000.0D end").alias("bench_a20"),
        F.expr("(15 * n_lines + noise2 div 20) / 1000.0D").alias("bench_b60"),
    )


def customer_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel, written once per session to the shared folder (as the panel of a
    real deployment would be stored) and scanned from there."""
    return stored(spark, sf_dir, "customer_month", build_customer_month)


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key in _tables:
        path, df = _tables[key]
        if path_exists(spark, path):
            return df
    df = materialize(build(spark, sf_dir), name)
    _tables[key] = (df.inputFiles()[0].rsplit("/", 1)[0], df)
    return df


def model_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: one row per model, era and id, with everything scoring needs."""
    panel = customer_month(spark, sf_dir)
    models = F.explode(
        F.array(*[F.struct(F.lit(m).alias("model_id"), F.col(m).alias("prediction")) for m in MODELS])
    )
    return panel.select("*", models.alias("m")).select(*panel.columns, "m.model_id", "m.prediction")


def embedding_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector panel: 64 features per row, four eras."""
    return table(spark, sf_dir, "embeddings").select(
        F.lpad((F.col("vec_id") % 4 + 1).cast("string"), 4, "0").alias("era"),
        (F.col("vec_id") % 4 + 1).cast("int").alias("era_num"),
        F.col("vec_id").cast("string").alias("id"),
        F.col("embedding").alias("features"),
        F.col("label").cast("double").alias("target"),
    )
