"""The shape of the physical plans, which is what decides the cost at scale."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from eraflow.operators import analysis, scoring
from eraflow.sources.testpanel import FEATURES, customer_month

QUERIES = entry.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "score_corr", "score_mmc", "turnover", "ic_by_era", "meta_orthogonality", "standardize",
    "perturb_blocks", "placement", "trajectories", "join_evaluation_base", "rank_normalize",
])
def test_no_products_of_rows(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_reads_only_what_is_needed(spark, sf_dir):
    df = scoring.per_era_corr(customer_month(spark, sf_dir).where("era_num <= 40"), "pred_a", "target")
    text = df._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(era_num), LessThanOrEqual(era_num,40)]" in text
    assert "ReadSchema: struct<era:string,era_num:int,target:double,pred_a:double>" in text


def test_scoring_shuffles_rows_once(spark, sf_dir):
    text = plan(scoring.per_era_corr(customer_month(spark, sf_dir), "pred_a", "target"))
    # rows by era for the ranks, then one partial result per era and task
    assert text.count("Exchange hashpartitioning") == 2 and "Python" not in text


def test_ic_shuffles_counts_only(spark, sf_dir):
    df = analysis.ic_by_era(customer_month(spark, sf_dir), FEATURES, ["target"])
    lines = plan(df).splitlines()
    unpivot = max(i for i, line in enumerate(lines) if "Generate" in line)
    below = "\n".join(lines[unpivot:])
    above = [line for line in lines[:unpivot] if "Exchange" in line or "partial_count(1)" in line]
    # the unpivoted rows are counted before the first shuffle above them
    assert "Exchange" not in below and "partial_count(1)" in above[-1]


def test_oversized_groups_leave_no_unsplit_window(spark, sf_dir, tiny_groups):
    text = plan(scoring.per_era_corr(customer_month(spark, sf_dir), "pred_a", "target"))
    windows = [l for l in text.splitlines() if "Window [" in l]
    assert windows and all("__bucket_" in l for l in windows)


def test_big_tables_are_not_broadcast(spark, sf_dir, no_broadcast):
    from eraflow.operators.rows import every_nth_era

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan(every_nth_era(customer_month(spark, sf_dir), 4))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_block_swaps_read_each_side_once(spark, sf_dir):
    from eraflow.operators.robustness import swap_blocks

    p = customer_month(spark, sf_dir)
    train, val = p.where("split = 'train'"), p.where("split = 'validation'").select("era", "id", *FEATURES)
    scans = []
    for n in (1, 2, 4):
        blocks = {f"b{i}": [FEATURES[i]] for i in range(n)}
        scans.append(plan(swap_blocks(val, train, blocks, 0.2, 1)).count("FileScan parquet"))
    assert scans[0] == scans[1] == scans[2]


def test_bytes_bound_broadcasts(spark):
    from eraflow.session import broadcast_checked, fits_broadcast

    spark.conf.set("spark.eraflow.broadcastBytes", "4000")
    try:
        wide = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("text"))
        assert "ResolvedHint" not in broadcast_checked(wide)._jdf.queryExecution().analyzed().toString()
        assert "ResolvedHint" in broadcast_checked(wide.select("id"))._jdf.queryExecution().analyzed().toString()
        assert fits_broadcast(spark, 10, 400) and not fits_broadcast(spark, 10, 401)
    finally:
        spark.conf.unset("spark.eraflow.broadcastBytes")


def test_results_do_not_depend_on_partitions(spark, sf_dir):
    df = customer_month(spark, sf_dir)

    def scores():
        return {r["era"]: round(r["value"], 9) for r in scoring.per_era_mmc(df, "pred_b", "meta", "target").collect()}

    first = scores()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert scores() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert df.select(F.countDistinct("era")).first()[0] == len(first)
