"""Poisson replication."""

import math

import pytest
from samples import SCHEMA
from pyspark.sql import functions as F

from eraflow.llm import mixing


def rates(spark, *pairs):
    return spark.createDataFrame(pairs, "source string, rate double")


def docs(spark, n, source="a"):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit(source).alias("source"), F.lit(1).cast("long").alias("n_chars"))


@pytest.mark.parametrize("rate", [0.2, 1.0, 3.5, 63.9, 200.0])
def test_counts_are_poisson(spark, rate):
    n = 4000
    counts = mixing.replicate(docs(spark, n), rates(spark, ("a", rate)), 1).groupBy("doc_id").count()
    total, squares = counts.agg(F.sum("count"), F.sum(F.col("count") * F.col("count"))).first()
    mean, variance = total / n, squares / n - (total / n) ** 2
    assert abs(mean - rate) < 5 * math.sqrt(rate / n)
    assert abs(variance - rate) < 6 * math.sqrt((rate + 2 * rate**2) / n)


def test_same_draw_on_any_layout(spark):
    one = mixing.replicate(docs(spark, 500).coalesce(1), rates(spark, ("a", 1.5)), 7)
    many = mixing.replicate(docs(spark, 500).repartition(9), rates(spark, ("a", 1.5)), 7)
    key = lambda df: sorted((r["doc_id"], r["copy"], r["shuffle_key"]) for r in df.collect())
    assert key(one) == key(many)
    other = mixing.replicate(docs(spark, 500), rates(spark, ("a", 1.5)), 8)
    assert key(one) != key(other)


def test_order_is_shuffled(spark):
    got = [r["doc_id"] for r in mixing.replicate(docs(spark, 3000), rates(spark, ("a", 1.0)), 1).collect()]
    up = sum(a < b for a, b in zip(got, got[1:], strict=False)) / len(got)
    assert 0.45 < up < 0.55


def test_rates_reach_their_shares(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    table = mixing.temperature_rates(frame, 0.5, 2.0).toPandas()
    assert abs((table.rate * table.n_chars).sum() - 2 * table.n_chars.sum()) < 1
    share = table.rate * table.n_chars / (table.n_chars**0.5)
    assert share.max() - share.min() < 1e-6 * share.max()


def test_odd_rows(spark, odd, odd_rows):
    frame = odd.withColumn("copy", F.lit("mine")).withColumn("_extra", F.lit(1))
    table = mixing.temperature_rates(frame, 0.7)
    got = mixing.replicate(frame, table, 3)
    assert got.columns == [*SCHEMA.replace(",", "").split()[::2], "_extra", "copy", "shuffle_key"]
    every = mixing.replicate(odd, rates(spark, *((s, 40.0) for s in ("a", "b", "c", None))), 3)
    counts = {(r["doc_id"], r["text"]): r["count"] for r in every.groupBy("doc_id", "text").count().collect()}
    assert set(counts) == {(r[0], r[1]) for r in odd_rows}
    assert table.where("source IS NULL").count() == 1


def test_source_without_size_or_rate(spark):
    frame = spark.createDataFrame([(i, None if i % 2 else "", "en", "e", 0) for i in range(400)] + [(1000, "abc", "en", "f", 0)], SCHEMA)
    table = {r["source"]: r["rate"] for r in mixing.temperature_rates(frame, 0.7).collect()}
    assert table == {"e": 1.0, "f": 1.0}
    assert mixing.replicate(frame, rates(spark, ("f", 0.0)), 1).count() == 0


def test_empty_table(spark, none):
    assert mixing.replicate(none, mixing.temperature_rates(none, 0.7), 1).count() == 0


def test_without_broadcast(spark, monkeypatch):
    import eraflow.llm.common as common

    want = mixing.replicate(docs(spark, 300), rates(spark, ("a", 2.0)), 1).count()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert mixing.replicate(docs(spark, 300), rates(spark, ("a", 2.0)), 1).count() == want
