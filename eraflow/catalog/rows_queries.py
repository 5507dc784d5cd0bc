"""Scans, sinks, projections, predicates, joins and set operations over panels."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from eraflow.catalog import sqltext as q
from eraflow.catalog.analysis_queries import BENCH, ic_ctes, ic_table  # noqa: F401
from eraflow.catalog.registry import register, tidy
from eraflow.catalog.series_queries import PAY, S, corr_series
from eraflow.functions.stats import none_null
from eraflow.operators import rows, scoring
from eraflow.session import shared_dir
from eraflow.sources import layout
from eraflow.sources import panel as src
from eraflow.sources.testpanel import (
    BENCHMARKS, FEATURES, META, MODELS, TARGETS, customer_month, model_predictions, stored, table,
)

ID_ERA = ["era", "id"]


def panel_path(spark, sf):
    return customer_month(spark, sf).inputFiles()[0].rsplit("/", 1)[0]


@register("scan_projected", q.query([], "SELECT era, id, f_qty::BIGINT AS f_qty, f_tax::BIGINT AS f_tax, round(target, 6) + 0.0 AS target FROM panel"))
def scan_projected(spark, sf):
    df = src.scan(spark, panel_path(spark, sf), ["f_qty", "f_tax", "not_there"], ["target"], TARGETS)
    return tidy(df)


@register("scan_eras", q.query([], "SELECT era, id, era_num::BIGINT AS era_num, round(pred_a, 6) + 0.0 AS pred_a FROM panel WHERE era_num <= 60"))
def scan_eras(spark, sf):
    p = customer_month(spark, sf)
    parts = [p.where("split = 'train'"), p.where("split = 'validation'")]
    return tidy(src.scan_eras(parts, ["pred_a"], 60))


@register("scan_benchmark_domain", q.query([], "SELECT era, id, round(bench_a20, 6) + 0.0 AS bench_a20, round(bench_b60, 6) + 0.0 AS bench_b60, round(meta, 6) + 0.0 AS meta FROM panel"))
def scan_benchmark_domain(spark, sf):
    return tidy(src.scan(spark, panel_path(spark, sf), [], [*BENCHMARKS, META]))


@register("scan_horizon_lookups",
          q.query([], "SELECT era, id, round(target_a_20, 6) + 0.0 AS short, round(target_a_60, 6) + 0.0 AS long, round(bench_a20, 6) + 0.0 AS bench_a20 FROM panel "
                  "WHERE era IN (SELECT era FROM panel WHERE meta IS NOT NULL)"))
def scan_horizon_lookups(spark, sf):
    p = customer_month(spark, sf)
    short, long = src.horizon_targets(p, ["target_x_20", "target_a_20", "target"], ["target_a_60", "target"])
    targets, benchmarks = src.lookups(
        p.select("era", "id", F.col(short).alias("short"), F.col(long).alias("long")),
        p.select("era", "id", META), p.select("era", "id", *BENCHMARKS), "bench_a20", META,
    )
    return tidy(targets.join(benchmarks, ID_ERA))


@register("scan_full_history", q.query([], "SELECT split, count(*)::BIGINT AS n_rows, sum(f_qty)::BIGINT AS qty FROM panel GROUP BY split"))
def scan_full_history(spark, sf):
    p = customer_month(spark, sf)
    both = src.full_history(p.where("split = 'train'"), p.where("split = 'validation'").drop("bench_a20"))
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("f_qty").alias("qty"))


@register("scan_truncated",
          q.query(["e AS (SELECT split, era, row_number() OVER (PARTITION BY split ORDER BY era_num) AS i FROM (SELECT DISTINCT split, era, era_num FROM panel))"],
                  "SELECT split, era, id FROM panel SEMI JOIN (SELECT * FROM e WHERE i <= 5) k USING (split, era)"))
def scan_truncated(spark, sf):
    return src.truncated_window(customer_month(spark, sf), 5).select("split", "era", "id")


@register("dataset_snapshot",
          q.query([], "SELECT 'panel' AS dataset, count(*)::BIGINT AS n_rows, count(DISTINCT era)::BIGINT AS n_eras, min_by(era, era_num) AS min_era, max_by(era, era_num) AS max_era, "
                  "sha256('panel|era,era_num,id,target|' || count(*)::VARCHAR || '|' || count(DISTINCT era)::VARCHAR || '|' || min_by(era, era_num) || '|' || max_by(era, era_num)) AS fingerprint FROM panel"))
def dataset_snapshot(spark, sf):
    return src.snapshot(customer_month(spark, sf).select("era", "era_num", "id", "target"), "panel").drop("columns")


@register("era_ledger", q.query([], "SELECT '2024-05-01' AS date, split AS dataset, min_by(era, era_num) AS start_era, max_by(era, era_num) AS end_era FROM panel GROUP BY split "
                                "UNION ALL SELECT '2024-04-01', 'train', min_by(era, era_num), max_by(era, era_num) FROM panel WHERE era_num <= 40"))
def era_ledger(spark, sf):
    p = customer_month(spark, sf)
    old = src.era_ledger(p.where("era_num <= 40"), "2024-04-01")
    stale = src.era_ledger(p.where("era_num <= 44"), "2024-05-01")
    out = src.update_ledger(old.unionByName(stale), src.era_ledger(p, "2024-05-01"))
    return out.withColumn("date", F.col("date").cast("string"))


@register("last_live_round", q.query([], "SELECT max(era_num)::BIGINT AS last_round FROM panel WHERE split = 'validation'"))
def last_live_round(spark, sf):
    eras = customer_month(spark, sf).groupBy("split", "era", "era_num").agg(F.count(F.lit(1)).alias("c"))
    ledger = eras.select(
        F.when(F.col("split") == "validation", "live").otherwise("train").alias("dataset"),
        F.col("era_num").cast("double").alias("round_id"),
    )
    return tidy(src.last_live_round(ledger))


@register("sink_parquet_roundtrip", q.query([], "SELECT era, count(*)::BIGINT AS n, sum(f_qty)::BIGINT AS qty FROM panel WHERE era_num BETWEEN 20 AND 39 GROUP BY era"))
def sink_parquet_roundtrip(spark, sf):
    path = f"{shared_dir(spark)}/eraflow/sink-{spark.sparkContext.applicationId}"
    src.write_table(customer_month(spark, sf).select("era", "era_num", "id", "f_qty"), path, bucket_width=10)
    back = spark.read.parquet(path).where("era_bucket in (2, 3)")
    return back.groupBy("era").agg(F.count(F.lit(1)).alias("n"), F.sum("f_qty").alias("qty"))


@register("sink_csv_roundtrip", q.query([], "SELECT era, id, CASE WHEN isnan(target_b_20) THEN 'NaN' ELSE (target_b_20 * 100)::BIGINT::VARCHAR END AS cell FROM panel WHERE target_b_20 IS NOT NULL"))
def sink_csv_roundtrip(spark, sf):
    path = f"{shared_dir(spark)}/eraflow/csv-{spark.sparkContext.applicationId}"
    src.write_csv(customer_month(spark, sf).select("era", "id", "target_b_20"), path)
    back = spark.read.option("header", True).schema("era string, id string, target_b_20 string").csv(path)
    number = (F.expr("try_cast(target_b_20 as double)") * 100).cast("bigint").cast("string")
    return back.where("target_b_20 is not null").select(
        "era", "id", F.when(F.col("target_b_20") == "NaN", "NaN").otherwise(number).alias("cell")
    )


@register("complete_rows", q.query([], f"SELECT era, id, round(target_b_20, 6) + 0.0 AS target_b_20 FROM panel WHERE {q.finite('target_b_20')} AND {q.finite('bench_a20')}"))
def complete_rows(spark, sf):
    df = scoring.complete_rows(customer_month(spark, sf), ["target_b_20", "bench_a20"])
    return tidy(df.select("era", "id", "target_b_20"))


@register("finite_target_rows", q.query([], f"SELECT era, count(*)::BIGINT AS n FROM panel WHERE split = 'train' AND {q.finite('target_b_20')} GROUP BY era"))
def finite_target_rows(spark, sf):
    train = customer_month(spark, sf).where("split = 'train'")
    return rows.finite_target_rows(train, "target_b_20").groupBy("era").agg(F.count(F.lit(1)).alias("n"))


@register("coerce_float", q.query([], "SELECT era, id, f_qty::DOUBLE AS f_qty, f_tax::DOUBLE AS f_tax FROM panel"))
def coerce_float(spark, sf):
    df = customer_month(spark, sf).select("era", "id", "f_qty", "f_tax")
    return tidy(rows.coerce_float(df, ["f_qty", "f_tax"]))


@register("benchmark_predictions", q.query([], f"SELECT era, id, round(bench_a20, 6) + 0.0 AS prediction FROM panel WHERE {q.finite('bench_a20')}"))
def benchmark_predictions(spark, sf):
    return tidy(rows.benchmark_predictions(customer_month(spark, sf), "bench_a20"))


@register("fill_missing", q.query([], "SELECT era, id, CASE WHEN isnan(coalesce(target_b_20, 0.5)) THEN -1.0 ELSE round(coalesce(target_b_20, 0.5), 6) END + 0.0 AS filled FROM panel"))
def fill_missing(spark, sf):
    df = rows.fill_missing(customer_month(spark, sf), ["target_b_20"])
    # a NaN must have stayed a NaN
    return tidy(df.select("era", "id", F.when(F.isnan("target_b_20"), -1.0).otherwise(F.col("target_b_20")).alias("filled")))


ERAS = "er AS (SELECT era, era_num, row_number() OVER (ORDER BY era_num) AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT era, era_num FROM panel))"


@register("eras_after_purge", q.query([ERAS.replace("FROM panel)", "FROM panel WHERE split = 'validation')")], "SELECT era, id FROM panel SEMI JOIN (SELECT era FROM er WHERE pos > 8) k USING (era)"))
def eras_after_purge(spark, sf):
    return rows.eras_after_purge(customer_month(spark, sf).where("split = 'validation'"), 8).select("era", "id")


@register("every_fourth_era", q.query([ERAS], "SELECT era, count(*)::BIGINT AS n FROM panel SEMI JOIN (SELECT era FROM er WHERE (pos - 1) % 4 = 0) k USING (era) GROUP BY era"))
def every_fourth_era(spark, sf):
    return rows.every_nth_era(customer_month(spark, sf), 4).groupBy("era").agg(F.count(F.lit(1)).alias("n"))


@register("max_era_bound", q.query([], "SELECT era, id FROM panel WHERE era_num <= 30"))
def max_era_bound(spark, sf):
    return customer_month(spark, sf).where(F.col("era_num") <= 30).select("era", "id")


@register("validated_eras", q.query([], "SELECT DISTINCT era, era_num::BIGINT AS era_num FROM panel"))
def validated_eras(spark, sf):
    return tidy(rows.validated_eras(customer_month(spark, sf)))


@register("bins_valid", q.query([], "SELECT " + ", ".join(f"bool_and({f} BETWEEN 0 AND 4) AS {f}" for f in FEATURES) + ", coalesce(bool_and(pred_a BETWEEN 0 AND 4 AND pred_a = floor(pred_a)), false) AS pred_a FROM panel"))
def bins_valid(spark, sf):
    return rows.bins_valid(customer_month(spark, sf), [*FEATURES, "pred_a"])


@register("standardize",
          q.query(["st AS (SELECT avg(f_qty) AS mq, stddev_pop(f_qty) AS sq, avg(pred_a) AS mp, stddev_pop(pred_a) AS sp FROM panel WHERE split = 'train')",
                   "o AS (SELECT era, id, (f_qty - mq) / sq AS f_qty, (pred_a - mp) / sp AS pred_a FROM panel, st WHERE split = 'validation')"],
                  q.rounded("o", ["era", "id"], ["f_qty", "pred_a"])))
def standardize(spark, sf):
    p = customer_month(spark, sf).select("era", "id", "split", F.col("f_qty").cast("double").alias("f_qty"), "pred_a")
    out = rows.standardize(p.where("split = 'train'"), p.where("split = 'validation'"), ["f_qty", "pred_a"])
    return tidy(out.select("era", "id", "f_qty", "pred_a"))


# -- joins -------------------------------------------------------------------


@register("join_evaluation_base", q.query([], f"SELECT era, id, round(pred_a, 6) + 0.0 AS prediction, round(meta, 6) + 0.0 AS meta, round(target, 6) + 0.0 AS target, f_qty::BIGINT AS f_qty FROM panel WHERE {q.finite('target_b_20')}"))
def join_evaluation_base(spark, sf):
    p = customer_month(spark, sf)
    known = rows.finite_target_rows(p, "target_b_20")
    return tidy(rows.evaluation_base(
        p.select("era", "id", F.col("pred_a").alias("prediction")), p.select("era", "id", META),
        known.select("era", "id", "target"), p.select("era", "id", "f_qty"),
    ))


@register("bucketed_evaluation_base", q.query([], f"SELECT era, id, round(pred_a, 6) + 0.0 AS prediction, round(meta, 6) + 0.0 AS meta, round(target, 6) + 0.0 AS target, f_qty::BIGINT AS f_qty FROM panel WHERE era_num BETWEEN 9 AND 50 AND {q.finite('target_b_20')}"))
def bucketed_evaluation_base(spark, sf):
    """The evaluation base of some eras, from tables in the same buckets of (era, id)."""
    p, folder = customer_month(spark, sf), f"{shared_dir(spark)}/eraflow/buckets-{uuid.uuid4().hex[:12]}"
    known = rows.finite_target_rows(p, "target_b_20")
    parts = {
        "predictions": p.select("era", "era_num", "id", F.col("pred_a").alias("prediction")), "meta": p.select("era", "era_num", "id", META),
        "targets": known.select("era", "era_num", "id", "target"), "features": p.select("era", "era_num", "id", "f_qty"),
    }
    stored_ = [layout.write_bucketed(df, f"{name}_{uuid.uuid4().hex[:12]}", f"{folder}/{name}", 8) for name, df in parts.items()]
    some = [t.where(layout.eras_between(9, 50)).drop("era_num", "era_bucket") for t in stored_]
    return tidy(rows.evaluation_base(*some))


@register("join_benchmark", q.query([], "SELECT era, id, round(pred_a, 6) + 0.0 AS pred_a, round(bench_a20, 6) + 0.0 AS bench_a20 FROM panel"))
def join_benchmark(spark, sf):
    p = customer_month(spark, sf)
    present = p.where("bench_a20 is not null")
    return tidy(rows.attach_benchmark(p.select("era", "id", "pred_a"), present, "bench_a20"))


@register("join_stacked_predictions", q.query([], "SELECT era, id, round(pred_a, 6) + 0.0 AS t1, round(bench_a20, 6) + 0.0 AS t2 FROM panel WHERE bench_a20 IS NOT NULL"))
def join_stacked_predictions(spark, sf):
    p = customer_month(spark, sf)
    long = p.select("era", "id", F.lit("t1").alias("target"), F.col("pred_a").alias("prediction")).unionByName(
        p.where("bench_a20 is not null").select("era", "id", F.lit("t2").alias("target"), F.col("bench_a20").alias("prediction"))
    )
    return tidy(rows.stacked_predictions(long, ["t1", "t2"]))


@register("join_common_rows", q.query([], " UNION ALL ".join(f"SELECT era, id, '{m}' AS model_id FROM panel WHERE era_num > 20 AND f_qty > 1" for m in MODELS)))
def join_common_rows(spark, sf):
    long = model_predictions(spark, sf).where("model_id <> 'pred_a' or era_num > 20").where("model_id <> 'pred_b' or f_qty > 1")
    return rows.common_rows(long, 3).select("era", "id", "model_id")


@register("join_consecutive_eras", q.query(["ep AS (SELECT era, row_number() OVER (ORDER BY era_num) AS pos FROM (SELECT DISTINCT era, era_num FROM panel))", "pp AS (SELECT era, id, pos, pred_a AS v FROM panel JOIN ep USING (era))"],
                                           "SELECT a.era, a.id, round(a.v, 6) + 0.0 AS now, round(b.v, 6) + 0.0 AS before FROM pp a JOIN pp b ON a.id = b.id AND a.pos = b.pos + 1"))
def join_consecutive_eras(spark, sf):
    return tidy(scoring.consecutive_pairs(customer_month(spark, sf), "pred_a").select("era", "id", "now", "before"))


@register("join_aligned_sources", q.query([], f"SELECT era, id, round(bench_a20, 6) + 0.0 AS bench_a20, round(CASE WHEN f_tax > 0 THEN meta END, 6) + 0.0 AS meta, round(target, 6) + 0.0 AS target FROM panel WHERE bench_a20 IS NOT NULL OR f_tax > 0"))
def join_aligned_sources(spark, sf):
    p = customer_month(spark, sf)
    return tidy(rows.aligned_sources(
        p.where("bench_a20 is not null").select("era", "id", "bench_a20"),
        p.where("f_tax > 0").select("era", "id", META), p.select("era", "id", "target"),
    ))


@register("join_regime_labels",
          q.query([*S, "lab AS (SELECT era, CASE WHEN avg(f_qty) > 1.9 THEN 'busy' ELSE 'calm' END AS regime FROM panel GROUP BY era)",
                   "o AS (SELECT model_id, era, regime, value FROM ser JOIN lab USING (era))"], q.rounded("o", ["model_id", "era", "regime"], ["value"])))
def join_regime_labels(spark, sf):
    return tidy(rows.with_labels(corr_series(spark, sf), era_labels(spark, sf)).select("model_id", "era", "regime", "value"))


def era_labels(spark, sf):
    p = customer_month(spark, sf)
    return p.groupBy("era").agg(F.when(F.avg("f_qty") > 1.9, "busy").otherwise("calm").alias("regime"))


@register("join_attached_features", q.query([], "SELECT era, id, round(pred_a, 6) + 0.0 AS pred_a, f_qty::BIGINT AS f_qty, f_tax::BIGINT AS f_tax FROM panel"))
def join_attached_features(spark, sf):
    p = customer_month(spark, sf)
    return tidy(rows.complete_join(p.select("era", "id", "pred_a"), p.select("era", "id", "f_qty", "f_tax")))


@register("join_universe_differences",
          q.query(["nw AS (SELECT max(era_num) AS last FROM panel)", "ua AS (SELECT DISTINCT id FROM panel, nw WHERE era_num = last - 1)", "ub AS (SELECT DISTINCT id FROM panel, nw WHERE era_num = last)"],
                  "SELECT id, 'extra' AS problem FROM ua WHERE id NOT IN (SELECT id FROM ub) UNION ALL SELECT id, 'missing' FROM ub WHERE id NOT IN (SELECT id FROM ua)"))
def join_universe_differences(spark, sf):
    p = customer_month(spark, sf)
    last = p.agg(F.max("era_num")).scalar()
    return rows.universe_differences(p.where(F.col("era_num") == last - 1), p.where(F.col("era_num") == last))


@register("join_meta_window", q.query([q.corr_scores("s", "panel", "meta", "target")], q.rounded("s", ["era"], ["value"])))
def join_meta_window(spark, sf):
    p = customer_month(spark, sf)
    joined = p.select("era", "id", META).join(p.select("era", "id", "target"), ID_ERA)
    return tidy(scoring.per_era_corr(joined, META, "target"))


@register("join_meta_training", q.query([], "SELECT era, id, round(pred_a, 6) + 0.0 AS pred_a, CASE WHEN isnan(target_b_20) THEN 'NaN' ELSE (target_b_20 * 100)::BIGINT::VARCHAR END AS t FROM panel WHERE target_b_20 IS NOT NULL"))
def join_meta_training(spark, sf):
    p = customer_month(spark, sf)
    out = rows.meta_training_rows(p.select("era", "id", "pred_a"), p.select("era", "id", "target_b_20"), "target_b_20")
    text = F.when(F.isnan("target_b_20"), "NaN").otherwise((F.col("target_b_20") * 100).cast("bigint").cast("string"))
    return tidy(out.select("era", "id", "pred_a", text.alias("t")))


@register("block_score_matrix",
          q.query([ERAS, "bl AS (SELECT floor((pos - 1) * 4 / n::DOUBLE)::BIGINT AS block, f_qty::DOUBLE AS a, f_prio::DOUBLE AS b, target AS t FROM panel JOIN er USING (era))",
                   "ft AS (SELECT block AS train_block, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, t) AS ca, covar_pop(b, t) AS cb FROM bl GROUP BY block)",
                   "fw AS (SELECT train_block, (ca * bb - cb * ab) / (aa * bb - ab * ab) AS wa, (cb * aa - ca * ab) / (aa * bb - ab * ab) AS wb FROM ft)",
                   "sc AS (SELECT train_block, block AS test_block, wa * a + wb * b AS p, t FROM bl, fw)",
                   f"o AS (SELECT train_block, test_block, {q.corr('p', 't')} AS corr FROM sc GROUP BY train_block, test_block)"],
                  q.rounded("o", ["train_block", "test_block"], ["corr"])))
def block_score_matrix(spark, sf):
    return tidy(rows.block_score_matrix(customer_month(spark, sf), "f_qty", "f_prio", "target"))


# -- sets, sorts, top-k ------------------------------------------------------


@register("distinct_keys", q.query([], "SELECT DISTINCT era, split FROM panel"))
def distinct_keys(spark, sf):
    return customer_month(spark, sf).select("era", "split").distinct()


@register("union_of_series", q.query([q.corr_scores("a", "panel", "pred_a", "target"), q.corr_scores("b", "panel", "pred_b", "target")],
                                     "SELECT 'a' AS source, era, round(value, 6) + 0.0 AS value, NULL::VARCHAR AS note FROM a UNION ALL SELECT 'b', era, round(value, 6) + 0.0, 'second' FROM b"))
def union_of_series(spark, sf):
    p = customer_month(spark, sf)
    a = scoring.per_era_corr(p, "pred_a", "target").withColumn("source", F.lit("a"))
    b = scoring.per_era_corr(p, "pred_b", "target").withColumn("source", F.lit("b")).withColumn("note", F.lit("second"))
    return tidy(a.unionByName(b, allowMissingColumns=True).select("source", "era", "value", "note"))


@register("intersect_eras", q.query([], "SELECT era FROM panel WHERE bench_a20 IS NOT NULL INTERSECT SELECT era FROM panel WHERE split = 'train'"))
def intersect_eras(spark, sf):
    p = customer_month(spark, sf)
    return p.where("bench_a20 is not null").select("era").intersect(p.where("split = 'train'").select("era"))


@register("except_eras", q.query([], "SELECT era FROM panel EXCEPT SELECT era FROM panel WHERE bench_a20 IS NOT NULL"))
def except_eras(spark, sf):
    p = customer_month(spark, sf)
    return p.select("era").subtract(p.where("bench_a20 is not null").select("era"))


@register("union_of_eras", q.query([], "SELECT era FROM panel WHERE f_qty = 0 UNION SELECT era FROM panel WHERE f_tax = 4"))
def union_of_eras(spark, sf):
    p = customer_month(spark, sf)
    return p.where("f_qty = 0").select("era").union(p.where("f_tax = 4").select("era")).distinct()


@register("pivot_ic", q.query(ic_ctes(), "SELECT era, " + ", ".join(f"round(max(ic) FILTER (WHERE feature = '{f}'), 6) + 0.0 AS {f}" for f in FEATURES) + " FROM ic WHERE target = 'target' GROUP BY era"))
def pivot_ic(spark, sf):
    ic = ic_table(spark, sf).where("target = 'target'")
    return tidy(ic.groupBy("era").pivot("feature", FEATURES).agg(F.max("ic")))


@register("sorted_keys", q.query([], "SELECT era, id, round(pred_a, 6) + 0.0 AS pred_a FROM panel ORDER BY era, id"))
def sorted_keys(spark, sf):
    return tidy(customer_month(spark, sf).select("era", "id", "pred_a")).orderBy("era", "id")


@register("sorted_nulls_last", q.query([], "SELECT era, id, round(bench_a20, 6) + 0.0 AS bench_a20 FROM panel ORDER BY bench_a20 DESC NULLS LAST, era, id"))
def sorted_nulls_last(spark, sf):
    df = tidy(customer_month(spark, sf).select("era", "id", "bench_a20"))
    return df.orderBy(F.desc_nulls_last("bench_a20"), "era", "id")


@register("top_rows", q.query([], "SELECT era, id, round(pred_a, 6) + 0.0 AS pred_a FROM panel ORDER BY pred_a DESC, era, id LIMIT 100"))
def top_rows(spark, sf):
    df = customer_month(spark, sf).select("era", "id", "pred_a")
    return tidy(df.orderBy(F.desc("pred_a"), "era", "id").limit(100))


@register("best_model_per_era", q.query([*S, "bm AS (SELECT *, row_number() OVER (PARTITION BY era ORDER BY round(value, 12) DESC, model_id DESC) AS i FROM ser)"], "SELECT era, model_id, round(value, 6) + 0.0 AS value FROM bm WHERE i = 1"))
def best_model_per_era(spark, sf):
    best = corr_series(spark, sf).groupBy("era").agg(
        F.max_by("model_id", F.struct(F.round("value", 12), "model_id")).alias("model_id"), F.max("value").alias("value")
    )
    return tidy(best)


@register("newest_version", q.query([], "SELECT 'v' || max(p_size)::VARCHAR || '.' || max_by(p_partkey % 100, p_size * 1000 + p_partkey % 100)::VARCHAR AS newest FROM part", panel=False))
def newest_version(spark, sf):
    labels = table(spark, sf, "part").select(
        F.concat(F.lit("v"), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 100).cast("string")).alias("version")
    )
    return src.newest_version(labels)
