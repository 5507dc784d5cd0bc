"""Run records, leaderboards, gates, tiers, verdicts, scorecards, reports, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from eraflow.catalog import sqltext as q
from eraflow.catalog.registry import register, tidy
from eraflow.functions.hashing import multiset_digest
from eraflow.catalog.rows_queries import era_labels, panel_path
from eraflow.catalog.scoring_queries import THREE, fnc_three_sql
from eraflow.catalog.series_queries import (
    BLOCK20, PAY, RUN, S, SEED, ac_ctes, bootstrap_ctes, corr_series, mmc_series, payouts, _cum, _stats,
)
from eraflow.catalog.analysis_queries import SETS, derived_feature_sets
from eraflow.operators import compare, correlation, fits, scoring, series
from eraflow.plans import reports, scorecard
from eraflow.session import shared_dir
from eraflow.sources import documents, snapshots
from eraflow.sources.panel import write_csv
from eraflow.sources.testpanel import (
    BENCHMARKS, FEATURES, META, TARGETS, TRAIN_LAST_ERA, customer_month, model_predictions, stored, table,
)
from eraflow.streaming import incremental

# -- run records derived from the customers, benchmark scorecards from the suppliers ----

CARDS = """
rk AS (SELECT c_name AS model_id, c_custkey AS k, c_nationkey AS nation, c_mktsegment AS seg, round(c_acctbal * 100)::BIGINT AS a FROM customer WHERE c_custkey % 97 <> 0),
rv AS (SELECT *, k % 10 <> 0 AS has_card, a / 20000000.0::DOUBLE AS x_corr, ((k * 37) % 200) / 100.0::DOUBLE - 0.5::DOUBLE AS x_sharpe FROM rk),
cards AS (SELECT model_id, k, a, nation, seg, has_card, CASE WHEN has_card THEN 'trained' ELSE 'trained_legacy' END AS source, 'run-' || nation::VARCHAR AS run_name,
  CASE WHEN has_card THEN x_corr ELSE x_corr * 2.0::DOUBLE END AS corr,
  CASE WHEN has_card AND k % 13 <> 0 THEN x_corr - (k % 7) / 1000.0::DOUBLE END AS corr_ci_low,
  CASE WHEN has_card THEN x_corr + (k % 5) / 1000.0::DOUBLE END AS corr_ci_high,
  CASE WHEN has_card THEN x_sharpe ELSE ((k * 7) % 100) / 50.0::DOUBLE - 1.0::DOUBLE END AS corr_sharpe_ac,
  CASE WHEN has_card AND k % 13 <> 0 THEN x_sharpe - 0.2::DOUBLE END AS corr_sharpe_ac_ci_low,
  CASE WHEN has_card THEN x_sharpe + 0.3::DOUBLE END AS corr_sharpe_ac_ci_high,
  CASE WHEN has_card THEN x_corr * 0.8::DOUBLE END AS fnc,
  CASE WHEN has_card THEN (k % 101) / 100.0::DOUBLE END AS deflated_sharpe,
  CASE WHEN has_card AND k % 17 <> 0 THEN ((k * 13) % 40) / 10.0::DOUBLE END AS gain_to_pain_ratio,
  CASE WHEN has_card AND k % 17 <> 0 THEN ((k * 17) % 60 - 10) / 100.0::DOUBLE END AS cagr_1y,
  CASE WHEN has_card AND k % 17 <> 0 THEN (k % 11) / 10.0::DOUBLE END AS kelly_fraction,
  CASE WHEN has_card AND k % 3 <> 0 THEN (k % 10) / 10.0::DOUBLE END AS turnover_mean,
  CASE WHEN has_card THEN (k % 9 + 1) / 100.0::DOUBLE ELSE 0.1::DOUBLE END AS std_corr,
  CASE WHEN has_card THEN (k % 50) / 100.0::DOUBLE ELSE 0.3::DOUBLE END AS max_drawdown,
  CASE WHEN has_card AND k % 2 <> 0 THEN x_corr / 4.0::DOUBLE END AS bmc,
  CASE WHEN has_card AND k % 4 <> 0 THEN (k % 30) / 100.0::DOUBLE END AS max_feature_exposure,
  CASE WHEN k % 4 = 0 THEN 'pre_rank_fix_definition' END AS max_feature_exposure_reason,
  CASE WHEN k % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS n_targets,
  CASE WHEN k % 2 = 0 THEN 'target' ELSE 'target, target_a_20' END AS targets
 FROM rv)"""
BENCH_CARDS = """
bcards AS (SELECT s_name AS model_id, 'benchmark' AS source, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN 'grp' || (s_suppkey % 3)::VARCHAR END, 'tier' || (s_suppkey % 5)::VARCHAR) AS run_name,
  (s_suppkey % 5)::BIGINT AS tier, round(s_acctbal * 100)::BIGINT / 40000000.0::DOUBLE AS corr, ((s_suppkey * 31) % 150) / 100.0::DOUBLE AS corr_sharpe_ac FROM supplier)"""


def build_run_documents(spark, sf):
    """JSON run documents, one text line each; some are broken, some have no scorecard."""
    c = table(spark, sf, "customer").select(
        "c_name", "c_mktsegment", F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"),
        F.round(F.col("c_acctbal") * 100).cast("bigint").alias("a"),
    )
    c = c.withColumn("x_corr", F.col("a") / F.lit(20000000.0)).withColumn(
        "x_sharpe", F.expr("((k * 37) % 200) / 100.0D - 0.5D")
    )

    def when(rule: str, value: str):
        return F.expr(f"case when {rule} then {value} end")

    card = F.struct(
        F.col("x_corr").alias("corr"),
        when("k % 13 <> 0", "x_corr - (k % 7) / 1000.0D").alias("corr_ci_low"),
        F.expr("x_corr + (k % 5) / 1000.0D").alias("corr_ci_high"),
        F.col("x_sharpe").alias("corr_sharpe_ac"),
        when("k % 13 <> 0", "x_sharpe - 0.2D").alias("corr_sharpe_ac_ci_low"),
        F.expr("x_sharpe + 0.3D").alias("corr_sharpe_ac_ci_high"),
        F.expr("x_corr * 0.8D").alias("fnc"),
        F.expr("(k % 101) / 100.0D").alias("deflated_sharpe"),
        when("k % 17 <> 0", "((k * 13) % 40) / 10.0D").alias("gain_to_pain_ratio"),
        when("k % 17 <> 0", "((k * 17) % 60 - 10) / 100.0D").alias("cagr_1y"),
        when("k % 17 <> 0", "(k % 11) / 10.0D").alias("kelly_fraction"),
        when("k % 3 <> 0", "(k % 10) / 10.0D").alias("turnover_mean"),
        F.expr("(k % 9 + 1) / 100.0D").alias("std_corr"),
        F.expr("(k % 50) / 100.0D").alias("max_drawdown"),
        when("k % 2 <> 0", "x_corr / 4.0D").alias("bmc"),
        F.expr("(k % 30) / 100.0D").alias("max_feature_exposure"),
    )
    metrics = F.struct(
        F.expr("x_corr * 2.0D").alias("mean"), F.lit(0.1).alias("std"),
        F.expr("((k * 7) % 100) / 50.0D - 1.0D").alias("sharpe"), F.lit(0.3).alias("max_drawdown"),
    )
    manifest = F.struct(
        F.lit("cpu").alias("oof_device"), when("k % 4 <> 0", "'percentile_rank'").alias("scorecard_prediction_scale"),
        F.struct(
            F.struct(F.lit("all").alias("feature_set"), F.expr("case when k % 2 = 0 then array('target') else array('target', 'target_a_20') end").alias("targets")).alias("data"),
            F.struct(F.lit("gbt").alias("backend"), F.col("c_mktsegment").alias("preset")).alias("model"),
            F.struct(F.lit(0.5).alias("neutralization_proportion")).alias("risk"),
            F.struct(F.concat(F.lit("run-"), F.col("nation").cast("string")).alias("name")).alias("run"),
        ).alias("config"),
    )
    text = F.to_json(F.struct(
        F.col("c_name").alias("run_id"), metrics.alias("metrics"), manifest.alias("manifest"),
        F.when(F.col("k") % 10 != 0, card).alias("scorecard"),
    ))
    return c.select(F.when(F.col("k") % 97 == 0, F.lit('{"run_id": "broken", "metrics"')).otherwise(text).alias("value"))


def _text_dir(spark, name: str) -> str:
    return f"{shared_dir(spark)}/eraflow/{name}-{uuid.uuid4().hex[:12]}"


def run_records(spark, sf):
    path = _text_dir(spark, "run-json")
    build_run_documents(spark, sf).write.text(path)
    return documents.read_run_records(spark, path, multiline=False)


def leaderboard(spark, sf):
    return stored(spark, sf, "leaderboard", lambda s, d: documents.registry_leaderboard(run_records(s, d), full_versions(s, d)))


def scored_runs(spark, sf):
    """The runs of the leaderboard; full versions have no scores to place or gate."""
    return compare.evaluable_rows(leaderboard(spark, sf))


def full_versions(spark, sf):
    """Manifests of full versions, one text line each: of every third nation's family, with
    rehearsals, an older version and a broken line among them."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("v"))
    n = n.where("k % 3 = 0")
    config = F.struct(
        F.struct(F.lit("all").alias("feature_set"), F.expr("case when k % 2 = 0 then array('target') end").alias("targets")).alias("data"),
        F.struct(F.lit("gbt").alias("backend"), F.concat(F.lit("preset-"), F.col("k").cast("string")).alias("preset")).alias("model"),
    )
    text = F.to_json(F.struct(
        F.concat(F.lit("run-"), F.col("k").cast("string")).alias("family"), (F.col("v") == 2).alias("rehearsal"),
        F.concat(F.lit("2026-01-0"), (F.col("v") + 1).cast("string")).alias("promoted_at"),
        F.expr("'Customer#' || lpad(cast(k * 97 + k % 2 as string), 9, '0')").alias("promoted_from_run_id"), config.alias("config"),
    ))
    path = _text_dir(spark, "full-json")
    n.select(F.when((F.col("k") == 9) & (F.col("v") == 0), '{"family": "run-9"').otherwise(text).alias("value")).write.text(path)
    return documents.read_full_versions(spark, path, multiline=False)


def build_benchmark_board(spark, sf):
    cards = table(spark, sf, "supplier").select(
        F.col("s_name").alias("model_id"),
        F.expr("case when s_suppkey % 2 = 0 then concat('grp', s_suppkey % 3) end").alias("strategy_group"),
        (F.col("s_suppkey") % 5).alias("tier"),
        F.expr("cast(round(s_acctbal * 100) as bigint) / 40000000.0D").alias("corr"),
        F.expr("((s_suppkey * 31) % 150) / 100.0D").alias("corr_sharpe_ac"),
    )
    path = _text_dir(spark, "bench-csv")
    write_csv(cards, path)
    return documents.benchmark_leaderboard(documents.read_scorecard_csv(spark, path))


def benchmark_board(spark, sf):
    return stored(spark, sf, "benchmark_board", build_benchmark_board)


BOARD_DOUBLES = ["corr", "corr_ci_low", "corr_ci_high", "corr_sharpe_ac", "fnc", "std_corr", "max_drawdown", "turnover_mean", "bmc", "max_feature_exposure"]
BOARD_KEYS = ["model_id", "source", "run_name", "n_targets", "targets", "max_feature_exposure_reason"]


FULL = """
fv AS (SELECT n_nationkey AS k, 'run-' || n_nationkey::VARCHAR AS family, 'Customer#' || lpad((n_nationkey * 97 + n_nationkey % 2)::VARCHAR, 9, '0') AS promoted FROM nation WHERE n_nationkey % 3 = 0),
full_rows AS (SELECT family || '::full' AS model_id, 'full' AS source, family AS run_name, family, 'full' AS training_scope, false AS has_full_version, 'gbt' AS backend, 'preset-' || k::VARCHAR AS preset,
  'all' AS feature_set, CASE WHEN k % 2 = 0 THEN 1::BIGINT END AS n_targets, CASE WHEN k % 2 = 0 THEN 'target' END AS targets FROM fv)"""
BOARD_ALL = [c for c in documents.UNIFIED if c != "run_dir"]


def board_sql() -> str:
    """All columns but the folder: runs, then full versions, whose scores are NULL."""
    runs = {
        "family": "run_name", "training_scope": "'research'", "has_full_version": "run_name IN (SELECT family FROM fv)", "backend": "'gbt'", "preset": "seg",
        "feature_set": "'all'", "feature_subset": "NULL::VARCHAR", "neutralization_proportion": "0.5::DOUBLE", "oof_device": "'cpu'", "has_bmc": "bmc IS NOT NULL",
        "has_horizon": "false", "has_perturb": "false", "has_regime": "false", "mmc_down_reason": "NULL::VARCHAR", "tier": "NULL::BIGINT",
        **{c: "NULL::DOUBLE" for c in ("mmc", "mmc_sharpe_ac", "cwmm", "mean_payout", "mmc_down", "rank_scalar", "cvar5", "burn_rate")},
        **{c: "NULL::BIGINT" for c in ("corr_n_eras", "corr_sharpe_ac_n_eras", "n_eras")},
    }
    full = {"model_id", "source", "run_name", "family", "training_scope", "has_full_version", "backend", "preset", "feature_set", "n_targets", "targets"}
    doubles = set(documents.SCORE_FIELDS) | {"neutralization_proportion"}
    cell = lambda c, x: f"round({x}, 10) + 0.0 AS {c}" if c in doubles else f"{x} AS {c}"
    one = ", ".join(cell(c, runs.get(c, c)) for c in BOARD_ALL)
    two = ", ".join(c if c in full else f"NULL AS {c}" for c in BOARD_ALL)
    return q.query([CARDS, FULL], f"SELECT {one} FROM cards UNION ALL SELECT {two} FROM full_rows", panel=False)


@register("run_leaderboard", board_sql())
def run_leaderboard(spark, sf):
    board = documents.registry_leaderboard(run_records(spark, sf), full_versions(spark, sf))
    return tidy(board.select(*BOARD_ALL), 10)


@register("dangling_versions", q.query([CARDS, FULL], "SELECT family, promoted AS promoted_from_run_id FROM fv WHERE promoted NOT IN (SELECT model_id FROM cards)", panel=False))
def dangling_versions(spark, sf):
    return documents.dangling_versions(full_versions(spark, sf), run_records(spark, sf))


@register("benchmark_leaderboard",
          q.query([BENCH_CARDS], "SELECT model_id, source, run_name, tier, 'unranked_predictions' AS max_feature_exposure_reason, 'target' AS targets, round(corr, 10) + 0.0 AS corr, round(corr_sharpe_ac, 10) + 0.0 AS corr_sharpe_ac FROM bcards", panel=False))
def benchmark_leaderboard(spark, sf):
    board = build_benchmark_board(spark, sf)
    return tidy(board.select("model_id", "source", "run_name", "tier", "max_feature_exposure_reason", "targets", "corr", "corr_sharpe_ac"), 10)


@register("campaign_runs",
          q.query([], "SELECT 'c' || (c_custkey // 10)::VARCHAR AS campaign_id, c_mktsegment || '_v' || (c_custkey % 5)::VARCHAR AS variant, c_name AS run_id, "
                  "CASE WHEN c_custkey % 6 = 0 THEN 'failed' ELSE 'recorded' END AS status, CASE WHEN c_custkey % 12 = 0 THEN 'out of memory' END AS error FROM customer", panel=False))
def campaign_runs(spark, sf):
    c = table(spark, sf, "customer").withColumn("k", F.col("c_custkey"))
    run = F.struct(
        F.concat(F.lit("configs/"), F.col("c_mktsegment"), F.lit("_v"), (F.col("k") % 5).cast("string"), F.lit(".yaml")).alias("config_path"),
        F.col("c_name").alias("run_id"), F.expr("case when k % 6 = 0 then 'failed' else 'recorded' end").alias("status"),
        F.expr("case when k % 12 = 0 then 'out of memory' end").alias("error"),
    )
    # ten runs per campaign, so a log document stays small
    logs = c.groupBy(F.expr("k div 10").alias("g")).agg(F.collect_list(run).alias("runs")).select(
        F.to_json(F.struct(
            F.concat(F.lit("c"), F.col("g").cast("string")).alias("campaign_id"), F.lit("sweep").alias("name"),
            F.array(F.struct(F.lit("configs/a.yaml").alias("path"), F.lit("0").alias("sha256"))).alias("configs"), "runs",
        )).alias("value")
    )
    path = _text_dir(spark, "campaign-json")
    logs.write.text(path)
    runs = documents.read_campaigns(spark, path, multiline=False)
    return runs.select("campaign_id", "variant", "run_id", "status", "error")


@register("tier_rungs", q.query([BENCH_CARDS, "o AS (SELECT tier, max(corr) AS corr FROM bcards GROUP BY tier)"], q.rounded("o", ["tier"], ["corr"], 10), panel=False))
def tier_rungs(spark, sf):
    return tidy(documents.tier_rungs(benchmark_board(spark, sf)), 10)


@register("tier_ladder",
          q.query([BENCH_CARDS, "b AS (SELECT tier, max(corr) AS best FROM bcards GROUP BY tier)",
                   "o AS (SELECT tier, best, coalesce(CASE WHEN tier = max(tier) OVER () THEN lag(best) OVER (ORDER BY tier) <= best + 1e-5 ELSE lag(best) OVER (ORDER BY tier) + 1e-5 <= best END, true) AS in_order FROM b)"],
                  q.rounded("o", ["tier", "in_order"], ["best"], 10), panel=False))
def tier_ladder(spark, sf):
    return tidy(compare.tier_ladder(benchmark_board(spark, sf)), 10)


@register("placement",
          q.query([CARDS, BENCH_CARDS, "ru AS (SELECT tier, max(corr) AS lo, lead(max(corr)) OVER (ORDER BY tier) AS hi, lead(tier) OVER (ORDER BY tier) AS nt FROM bcards GROUP BY tier)",
                   "ft AS (SELECT min_by(lo, tier) AS f, max_by(lo, tier) AS l, min(tier) AS ft, max(tier) AS lt FROM ru)",
                   "hit AS (SELECT model_id, min_by('tier' || tier::VARCHAR || '..tier' || nt::VARCHAR, tier) AS label FROM cards JOIN ru ON corr >= lo AND corr < hi GROUP BY model_id)"],
                  "SELECT model_id, CASE WHEN corr < f THEN 'below tier ' || ft::VARCHAR WHEN corr > l THEN 'above tier ' || lt::VARCHAR ELSE coalesce(label, 'tier' || lt::VARCHAR) END AS placement "
                  "FROM cards LEFT JOIN hit USING (model_id), ft", panel=False))
def placement(spark, sf):
    placed = compare.place(scored_runs(spark, sf), documents.tier_rungs(benchmark_board(spark, sf)))
    return placed.select("model_id", "placement")


GATE_SQL = "gate AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{op}', {t}::DOUBLE)" for f, op, t in compare.GATE) + ") g(field, op, threshold))"
RECEIPT = "CASE WHEN measured IS NULL OR op = 'display' THEN NULL WHEN op = '>' THEN measured > threshold WHEN op = '<=' THEN measured <= threshold ELSE measured >= threshold END"
GATE_LONG = "gl AS (" + " UNION ALL ".join(f"SELECT model_id, '{f}' AS field, {f} AS measured FROM cards" for f, _, _ in compare.GATE) + ")"


@register("gate_report", q.query([CARDS, GATE_SQL, GATE_LONG, f"o AS (SELECT model_id, field, threshold, measured, {RECEIPT} AS pass FROM gl JOIN gate USING (field))"],
                                 q.rounded("o", ["model_id", "field", "pass::VARCHAR AS pass"], ["threshold", "measured"], 10), panel=False))
def gate_report(spark, sf):
    fields = [f for f, _, _ in compare.GATE]
    report = compare.gate_report(scored_runs(spark, sf), compare.gate_table(spark), fields)
    return tidy(report.withColumn("pass", F.col("pass").cast("string")), 10)


@register("gate_violations", q.query([CARDS, GATE_SQL, GATE_LONG, f"o AS (SELECT model_id, field, {RECEIPT} AS pass FROM gl JOIN gate USING (field))"],
                                     "SELECT field, count(*)::BIGINT AS n FROM o WHERE NOT coalesce(pass, true) GROUP BY field", panel=False))
def gate_violations(spark, sf):
    fields = [f for f, _, _ in compare.GATE]
    report = compare.gate_report(scored_runs(spark, sf), compare.gate_table(spark), fields)
    return compare.gate_violations(report).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


@register("null_floor_violations",
          q.query([CARDS], "SELECT model_id, 'corr' AS metric, round(corr, 10) + 0.0 AS observed, 0.005::DOUBLE AS tolerance FROM cards WHERE abs(corr) > 0.005 UNION ALL "
                  "SELECT model_id, 'corr_sharpe_ac', round(corr_sharpe_ac, 10) + 0.0, 0.15::DOUBLE FROM cards WHERE abs(corr_sharpe_ac) > 0.15::DOUBLE", panel=False))
def null_floor_violations(spark, sf):
    return tidy(compare.null_floor_violations(scored_runs(spark, sf)), 10)


def _receipt_sql(f: str, op: str, t: float) -> str:
    return f"CASE WHEN {f} IS NOT NULL THEN {f} {op} {t}::DOUBLE END AS gate_{f}"


STATUS = [CARDS, "st AS (SELECT model_id, source, " + ", ".join(_receipt_sql(f, op, t) for f, op, t in compare.GATE if op != "display") + " FROM cards)"]
READY = " AND ".join(f"coalesce(gate_{f}, {'true' if f == 'turnover_mean' else 'false'})" for f in compare.STATUS_FIELDS)


@register("gate_status",
          q.query([*STATUS, BENCH_CARDS, FULL], f"SELECT model_id, CASE WHEN model_id = 'Customer#000000007' THEN 'CHAMPION' WHEN {READY} THEN 'CAPITAL READY' ELSE 'RESEARCH' END AS status, gate_corr::VARCHAR AS gate_corr, gate_turnover_mean::VARCHAR AS gate_turnover_mean FROM st "
                  "UNION ALL SELECT model_id, CASE WHEN model_id = 'Supplier#000000003' THEN 'GATE HURDLE' ELSE 'BENCHMARK' END, (corr >= 0.0286)::VARCHAR, NULL FROM bcards UNION ALL SELECT model_id, 'FULL', NULL, NULL FROM full_rows", panel=False))
def gate_status(spark, sf):
    board = compare.merged_leaderboard(leaderboard(spark, sf), benchmark_board(spark, sf))
    out = compare.gate_status(board, reference="Supplier#000000003", champion="Customer#000000007")
    return out.select("model_id", "status", *[F.col(c).cast("string").alias(c) for c in ("gate_corr", "gate_turnover_mean")])


@register("leaderboard_order",
          q.query([CARDS, BENCH_CARDS, FULL, "al AS (SELECT model_id, source, run_name, corr_sharpe_ac, NULL::BIGINT AS tier FROM cards UNION ALL SELECT model_id, source, run_name, corr_sharpe_ac, tier FROM bcards UNION ALL SELECT model_id, source, run_name, NULL, NULL FROM full_rows)",
                   "se AS (SELECT *, CASE WHEN model_id = 'Customer#000000007' THEN 0 WHEN source = 'full' THEN 1 WHEN source = 'benchmark' THEN 3 ELSE 2 END AS section FROM al)"],
                  "SELECT section::BIGINT AS section, model_id, source, round(corr_sharpe_ac, 6) + 0.0 AS corr_sharpe_ac, coalesce(tier, -1) AS tier FROM se ORDER BY section, CASE WHEN section = 2 THEN corr_sharpe_ac END DESC NULLS LAST, CASE WHEN section = 3 THEN tier END, model_id", panel=False))
def leaderboard_order(spark, sf):
    board = compare.merged_leaderboard(leaderboard(spark, sf), benchmark_board(spark, sf))
    return tidy(compare.ordered_leaderboard(board, "Customer#000000007").select("section", "model_id", "source", "corr_sharpe_ac", F.coalesce("tier", F.lit(-1)).alias("tier")))


@register("evaluable_rows", q.query([CARDS], "SELECT model_id, source FROM cards WHERE source <> 'full'", panel=False))
def evaluable_rows(spark, sf):
    return compare.evaluable_rows(leaderboard(spark, sf)).select("model_id", "source")


@register("fleet_summary",
          q.query([CARDS], "SELECT model_id AS run_id, round(CASE WHEN has_card THEN corr_sharpe_ac END, 6) + 0.0 AS metric, round(corr_sharpe_ac_ci_low, 6) + 0.0 AS metric_ci_low, coalesce(deflated_sharpe >= 0.95::DOUBLE, false) AS dsr_pass, "
                  "round(corr_sharpe_ac_ci_high, 6) + 0.0 AS metric_ci_high, NULL::BIGINT AS metric_n_eras, round(deflated_sharpe, 6) + 0.0 AS deflated_sharpe, 'cpu' AS oof_device, 'all' AS feature_set, NULL::VARCHAR AS feature_subset, "
                  "0.5::DOUBLE AS neutralization_proportion, false AS has_horizon, false AS has_perturb, false AS has_regime, 10::BIGINT AS policy_n_trials, 0.95::DOUBLE AS policy_dsr_confidence, "
                  "round(max_feature_exposure, 6) + 0.0 AS max_feature_exposure, max_feature_exposure_reason, seg AS preset, bmc IS NOT NULL AS has_bmc FROM cards", panel=False))
def fleet_summary(spark, sf):
    return tidy(compare.fleet_summary(run_records(spark, sf), n_trials=10))


@register("promotion_verdicts",
          q.query([CARDS, "ch AS (SELECT corr_sharpe_ac_ci_low AS lo, corr_sharpe_ac_ci_high AS hi FROM cards WHERE model_id = 'Customer#000000007')"],
                  "SELECT model_id, CASE WHEN corr_sharpe_ac_ci_low IS NULL OR corr_sharpe_ac_ci_high IS NULL THEN 'caution' WHEN corr_sharpe_ac_ci_low > hi THEN 'promote' WHEN corr_sharpe_ac_ci_high < lo THEN 'hold' ELSE 'caution' END AS verdict FROM cards, ch", panel=False))
def promotion_verdicts(spark, sf):
    board = scored_runs(spark, sf)
    return compare.verdicts(board, board.where("model_id = 'Customer#000000007'"))


@register("best_run", q.query([CARDS], "SELECT model_id, round(corr, 10) + 0.0 AS corr FROM cards ORDER BY corr DESC, model_id DESC LIMIT 1", panel=False))
def best_run(spark, sf):
    return tidy(compare.best_run(scored_runs(spark, sf), "corr"), 10)


@register("better_than_champion", q.query([CARDS], "SELECT model_id, round(max_drawdown, 6) + 0.0 AS max_drawdown FROM cards WHERE max_drawdown < (SELECT max_drawdown FROM cards WHERE model_id = 'Customer#000000025')", panel=False))
def better_than_champion(spark, sf):
    board = scored_runs(spark, sf)
    return tidy(compare.better_than(board, board.where("model_id = 'Customer#000000025'"), "max_drawdown").select("model_id", "max_drawdown"))


@register("robustness_cells", q.query([CARDS], "SELECT model_id, bmc IS NOT NULL AS has_bmc, false AS has_horizon, false AS has_perturb, false AS has_regime FROM cards", panel=False))
def robustness_cells(spark, sf):
    return scored_runs(spark, sf).select("model_id", "has_bmc", "has_horizon", "has_perturb", "has_regime")


@register("tier_metadata", q.query([CARDS, "md AS (SELECT model_id, nation::BIGINT AS tier, 'tier' || nation::VARCHAR AS strategy_group FROM cards WHERE a >= 0)"],
                                   "SELECT model_id, coalesce(md.tier, -1) AS tier, strategy_group FROM cards LEFT JOIN md USING (model_id)", panel=False))
def tier_metadata(spark, sf):
    from eraflow.operators.rows import with_metadata

    cards = scored_runs(spark, sf).select("model_id")
    meta = table(spark, sf, "customer").where("c_acctbal >= 0").select(
        F.col("c_name").alias("model_id"), F.col("c_nationkey").cast("bigint").alias("tier"),
        F.concat(F.lit("tier"), F.col("c_nationkey").cast("string")).alias("strategy_group"),
    )
    return with_metadata(cards, meta).withColumn("tier", F.coalesce("tier", F.lit(-1)))


@register("feature_set_relations",
          q.query(["sets AS (SELECT 'qty' || f_qty::VARCHAR AS feature_set, id AS feature FROM panel GROUP BY ALL)",
                   "sz AS (SELECT feature_set, count(*)::BIGINT AS n_features FROM sets GROUP BY feature_set)",
                   "bo AS (SELECT x.feature_set AS a, y.feature_set AS b, count(*) AS c FROM sets x JOIN sets y USING (feature) GROUP BY x.feature_set, y.feature_set)"],
                  "SELECT x.feature_set AS a, y.feature_set AS b, x.n_features, coalesce(c, 0) = x.n_features AS a_subset_of_b FROM sz x JOIN sz y ON x.feature_set <> y.feature_set LEFT JOIN bo ON bo.a = x.feature_set AND bo.b = y.feature_set"))
def feature_set_relations(spark, sf):
    # ids grouped by a bin stand for named sets of members
    sets = customer_month(spark, sf).select(
        F.concat(F.lit("qty"), F.col("f_qty").cast("string")).alias("feature_set"), F.col("id").alias("feature")
    ).distinct()
    sizes = correlation.set_sizes(sets).withColumnRenamed("feature_set", "a")
    return correlation.set_subsets(sets).join(sizes, "a").select("a", "b", "n_features", "a_subset_of_b")


# -- trajectories, capital ---------------------------------------------------------


@register("trajectories",
          q.query([*PAY, q.corr_scores("mc", "panel", "meta", "target_a_20"),
                   "al AS (SELECT model_id, 'corr20' AS metric, era, value FROM sc UNION ALL SELECT model_id, 'payout', era, value FROM pay)",
                   "ax AS (SELECT DISTINCT era, era_num::BIGINT AS era_num FROM panel)", "kn AS (SELECT DISTINCT model_id, metric FROM al)",
                   "gr AS (SELECT k.model_id, k.metric, ax.era, ax.era_num, coalesce(al.value, 0.0) AS value, coalesce(mc.value < 0, false) AS downside FROM kn k CROSS JOIN ax LEFT JOIN al USING (model_id, metric, era) LEFT JOIN mc USING (era))",
                   "cu AS (SELECT *, sum(value) OVER w AS cum, product(1 + value) OVER w AS wealth FROM gr WINDOW w AS (PARTITION BY model_id, metric ORDER BY era_num ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
                   "wp AS (SELECT *, max(wealth) OVER (PARTITION BY model_id, metric ORDER BY era_num ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pk FROM cu)",
                   "o AS (SELECT model_id, metric, era, era_num, value, downside, CASE WHEN metric = 'payout' THEN wealth ELSE cum END AS cumulative, CASE WHEN metric = 'payout' THEN wealth / pk - 1.0 END AS drawdown FROM wp)"],
                  q.rounded("o", ["model_id", "metric", "era", "era_num", "downside"], ["value", "cumulative", "drawdown"])))
def trajectories(spark, sf):
    p = customer_month(spark, sf)
    corr = corr_series(spark, sf).select("model_id", F.lit("corr20").alias("metric"), "era", "value")
    pay = payouts(spark, sf).select("model_id", F.lit("payout").alias("metric"), "era", "value")
    return tidy(compare.trajectories(corr.unionByName(pay), p, scoring.per_era_corr(p, META, "target_a_20")))


@register("reconciled_capital",
          q.query([*PAY, "sh AS (SELECT model_id, pow(product(1 + value), 52.0 / count(*)) - 1.0 AS cagr_1y, sum(greatest(value, 0)) / sum(abs(least(value, 0))) AS gain_to_pain_ratio FROM pay GROUP BY model_id)",
                   "o AS (SELECT model_id, CASE WHEN model_id = 'pred_b' THEN 0.25 ELSE cagr_1y END AS cagr_1y, CASE WHEN model_id = 'pred_b' THEN 2.0 ELSE gain_to_pain_ratio END AS gain_to_pain_ratio FROM sh)"],
                  q.rounded("o", ["model_id"], ["cagr_1y", "gain_to_pain_ratio"])))
def reconciled_capital(spark, sf):
    corr, mmc = corr_series(spark, sf), mmc_series(spark, sf)
    whole = F.col("model_id") == "pred_b"
    board = corr.select("model_id").distinct().select(
        "model_id", F.lit("trained").alias("source"),
        # one row has a complete stored block, the others only part of it
        F.lit(0.25).alias("cagr_1y"), F.when(whole, 2.0).alias("gain_to_pain_ratio"), F.when(whole, 0.1).alias("kelly_fraction"),
        F.lit(None).cast("double").alias("mmc_down"), F.lit(None).cast("string").alias("mmc_down_reason"),
    )
    meta = scoring.per_era_corr(customer_month(spark, sf), META, "target_a_20")
    return tidy(compare.reconcile_capital(board, corr, mmc, meta).select("model_id", "cagr_1y", "gain_to_pain_ratio"))


# -- scorecards -----------------------------------------------------------------------


def scorecards(spark, sf):
    def build(s, d):
        base = model_predictions(s, d).select("model_id", "era", "id", "prediction", META, "target_a_20", "target_a_60", "bench_a20")
        return scorecard.evaluate_models(
            base, feature_rows=customer_month(s, d), target="target_a_20", meta=META, features=FEATURES, benchmark="bench_a20",
            horizon_pair=("target_a_20", "target_a_60"), regimes=era_regimes(s, d), n_boot=200, seed=SEED,
        )

    return stored(spark, sf, "scorecards", build)


def era_regimes(spark, sf):
    """Two halves of history: both long enough for an interval."""
    return customer_month(spark, sf).groupBy("era", "era_num").agg(F.count(F.lit(1)).alias("n")).select(
        "era", F.when(F.col("era_num") <= 40, "early").otherwise("late").alias("regime")
    )


@register("scorecard")
def full_scorecard(spark, sf):
    return tidy(scorecard.flatten(scorecards(spark, sf)), 5)


EXPOSURE = ["fx AS (" + " UNION ALL ".join(f"SELECT model_id, era, '{f}' AS feature, prediction AS p, {f}::DOUBLE AS v FROM models" for f in FEATURES) + ")",
            f"fe AS (SELECT model_id, feature, era, {q.corr('p', 'v')} AS x FROM fx GROUP BY model_id, feature, era)",
            "fm AS (SELECT model_id, max(abs(x)) AS max_feature_exposure FROM fe GROUP BY model_id)"]
CORE = [*PAY, *EXPOSURE, *bootstrap_ctes("ser", "model_id", BLOCK20, 200, SEED),
        "mms AS (SELECT model_id, era::INTEGER AS era_num, value FROM sm)", *ac_ctes("mms", "model_id", 4, "am"),
        "payraw AS (SELECT model_id, raw AS value FROM pay)", *_stats("payraw"),
        "dz AS (SELECT model_id, sharpe * sqrt(n - 1.0) / sqrt(1 - skew * sharpe + (kurt - 1) / 4.0 * sharpe * sharpe) AS z FROM ss)",
        f"dd AS (SELECT model_id, {q.cdf('z')} AS deflated_sharpe FROM dz)",
        "ps AS (SELECT model_id, avg(value) AS mean_payout, pow(product(1 + value), 52.0 / count(*)) - 1.0 AS cagr_1y, avg(CASE WHEN value < 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS burn_rate FROM pay GROUP BY model_id)",
        "cs AS (SELECT model_id, avg(value) AS corr, stddev_pop(value) AS std_corr FROM sc GROUP BY model_id)", "ms AS (SELECT model_id, avg(value) AS mmc FROM sm GROUP BY model_id)",
        "co AS (SELECT model_id, corr, ci_low AS corr_ci_low, ci_high AS corr_ci_high, std_corr, mmc, mean_payout, cagr_1y, burn_rate, deflated_sharpe, max_feature_exposure, ac_sharpe AS mmc_sharpe_ac "
        "FROM cs JOIN ms USING (model_id) JOIN ps USING (model_id) JOIN dd USING (model_id) JOIN fm USING (model_id) JOIN am USING (model_id) JOIN bo USING (model_id))"]
CORE_COLUMNS = ["corr", "corr_ci_low", "corr_ci_high", "std_corr", "mmc", "mean_payout", "cagr_1y", "burn_rate", "deflated_sharpe", "max_feature_exposure", "mmc_sharpe_ac"]


@register("scorecard_core", q.query(CORE, q.rounded("co", ["model_id"], CORE_COLUMNS)))
def scorecard_core(spark, sf):
    return tidy(scorecard.flatten(scorecards(spark, sf)).select("model_id", *CORE_COLUMNS))


@register("scorecard_digest")
def scorecard_digest(spark, sf):
    return compare.scorecard_digest(scorecard.flatten(scorecards(spark, sf)))


PANEL_TEXT = "concat_ws('|', era, id, " + ", ".join(f"{f}" for f in FEATURES) + ")"


@register("panel_digest",
          q.query([f"h AS (SELECT sha256({PANEL_TEXT}) AS d FROM panel)",
                   "p AS (SELECT " + ", ".join(f"('0x' || substr(d, {8 * i + 1}, 8))::BIGINT AS p{i}" for i in range(8)) + " FROM h)",
                   "s AS (SELECT count(*) AS n_rows, concat_ws(':', count(*), " + ", ".join(f"sum(p{i})::HUGEINT" for i in range(8)) + ", " + ", ".join(f"bit_xor(p{i})" for i in range(8)) + ") AS told FROM p)"],
                  "SELECT sha256(told) AS digest, n_rows FROM s"))
def panel_digest(spark, sf):
    p = customer_month(spark, sf)
    return multiset_digest(p, F.concat_ws("|", "era", "id", *[F.col(f).cast("string") for f in FEATURES]))


@register("scorecard_fnc",
          q.query([q.MODELS, *fnc_three_sql("target_a_20"), "o AS (SELECT model_id, avg(value) AS fnc FROM s GROUP BY model_id)"], q.rounded("o", ["model_id"], ["fnc"], 5)))
def scorecard_fnc(spark, sf):
    """The feature-neutral cell of the cards, on three features."""
    base = model_predictions(spark, sf).select("model_id", "era", "id", "prediction", META, "target_a_20")
    cards = scorecard.evaluate_models(base, target="target_a_20", meta=META, features=THREE, feature_rows=customer_month(spark, sf), n_boot=20)
    return tidy(scorecard.flatten(cards).select("model_id", "fnc"), 5)


@register("scorecard_union")
def scorecard_union(spark, sf):
    cards = scorecard.flatten(scorecards(spark, sf))
    other = cards.withColumn("model_id", F.concat(F.lit("second_"), "model_id")).drop("bmc")
    return tidy(scorecard.union_scorecards([cards, other]).select("model_id", "corr", "bmc", "rank_scalar"), 5)


@register("hierarchy")
def hierarchy(spark, sf):
    p = customer_month(spark, sf)
    train, val = p.where("split = 'train'"), p.where("split = 'validation'")
    pair = ["target", "target_a_20"]
    searched = fits.ridge_stack_search(train, val, FEATURES, pair, "target", "bench_b60", 0.25, 8, top=2, alphas=(1.0,), sharpe_floor=-100.0)
    fleet = [("ridge_stack", 3, fits.ridge_stack(train, val, FEATURES, pair, "target", 0.25, 8), False), ("ridge_stack_search", 3, searched, True)]
    cards = reports.hierarchy(train, val, FEATURES, "target", META, ["bench_b60"], purge=8, fleet=fleet, maxIter=5)
    return tidy(cards.select("model_id", "tier", "strategy_group", "corr", "corr_sharpe_ac", "fnc", "placement", "gate_pass", F.array_join("gate_failed", ",").alias("gate_failed"), "selection_bias"), 5)


@register("campaign_evidence")
def campaign_evidence(spark, sf):
    variants, _ = _evidence(spark, sf)
    return tidy(variants, 5)


def _evidence(spark, sf):
    preds = model_predictions(spark, sf).select(F.col("model_id").alias("run_id"), "era", "id", "prediction")
    runs = spark.createDataFrame(
        [("gbt_v2", "pred_a", "recorded", None, None, "gpu"), ("gbt_v3", "pred_b", "recorded", None, "boosted", None), ("gbt_v4", "pred_c", "recorded", None, "other", None),
         ("gbt_v5", None, "failed", "out of memory", "boosted", "gpu"), ("gbt_v6", "pred_z", "recorded", None, None, None)],
        "variant string, run_id string, status string, error string, backend string, device string",
    )
    rows_ = customer_month(spark, sf).select("era", "id", "target", *FEATURES)
    return reports.campaign_evidence(runs, preds, rows_, "target", FEATURES)


@register("campaign_pairs",
          q.query([q.MODELS, f"ic AS (SELECT model_id, era::INTEGER AS era_num, {q.corr('prediction', 'target')} AS v FROM models GROUP BY model_id, era HAVING count(*) >= 2 AND min(target) < max(target))",
                   "pr AS (SELECT * FROM (VALUES ('gbt_v2 vs gbt_v3', 'pred_a', 'pred_b'), ('gbt_v2 vs gbt_v4', 'pred_a', 'pred_c'), ('gbt_v3 vs gbt_v4', 'pred_b', 'pred_c')) p(pair, ma, mb))",
                   "di AS (SELECT pair, x.era_num, x.v - y.v AS value FROM pr JOIN ic x ON x.model_id = ma JOIN ic y ON y.model_id = mb AND y.era_num = x.era_num)",
                   *bootstrap_ctes("di", "pair", BLOCK20, 200, 0),
                   "o AS (SELECT pair, 'boosted' AS backend, point AS mean_diff, ci_low, ci_high, n::BIGINT AS n_eras, NULL::VARCHAR AS error FROM bo)"],
                  q.rounded("o", ["pair", "backend", "n_eras", "error"], ["mean_diff", "ci_low", "ci_high"])))
def campaign_pairs(spark, sf):
    variants, ic = _evidence(spark, sf)
    return tidy(reports.campaign_pairs(ic, variants))


@register("dataset_report")
def dataset_report(spark, sf):
    tables = reports.dataset_report(
        customer_month(spark, sf), FEATURES, ["target", "target_a_20", "target_a_60"],
        F.col("era_num") <= TRAIN_LAST_ERA, TRAIN_LAST_ERA, BENCHMARKS, META,
    )
    return reports.report_sizes(tables)


# -- streams --------------------------------------------------------------------------


@register("stream_feature_moments",
          q.query(["l AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f}::DOUBLE AS v FROM panel" for f in [*FEATURES, "target_b_20"]) + ")", "lf AS (SELECT feature, CASE WHEN isfinite(v) THEN v END AS v FROM l)",
                   "p AS (SELECT feature, 1.0 - count(v) / count(*)::DOUBLE AS missing_rate, avg(v) AS pooled_mean, stddev_pop(v) AS pooled_std, min(v) AS min, max(v) AS max FROM lf GROUP BY feature)",
                   "k AS (SELECT feature, avg(pow(v - pooled_mean, 3)) / pow(any_value(pooled_std), 3) AS pooled_skew, avg(pow(v - pooled_mean, 4)) / pow(any_value(pooled_std), 4) - 3 AS pooled_kurtosis FROM lf JOIN p USING (feature) GROUP BY feature)"],
                  q.rounded("p JOIN k USING (feature)", ["feature"], ["missing_rate", "pooled_mean", "pooled_std", "pooled_skew", "pooled_kurtosis", "min", "max"])))
def stream_feature_moments(spark, sf):
    panel = customer_month(spark, sf)
    stream = incremental.era_stream(spark, panel_path(spark, sf), panel.schema, 1)
    out, mark = _text_dir(spark, "stream-moments"), _text_dir(spark, "stream-mark")
    incremental.run_feature_moments(stream, [*FEATURES, "target_b_20"], out, mark)
    return tidy(snapshots.current(spark, out))


@register("stream_era_scores", q.query([q.corr_scores("s", "panel", "pred_b", "target")], q.rounded("s", ["era", "era::BIGINT AS era_num"], ["value"])))
def stream_era_scores(spark, sf):
    panel = customer_month(spark, sf)
    source = panel_path(spark, sf)
    stream = incremental.era_stream(spark, source, panel.schema, 2)
    out, mark, state = (_text_dir(spark, f"stream-{n}") for n in ("scores", "mark", "state"))
    incremental.run_era_scores(stream, state, lambda df: scoring.per_era_corr(df, "pred_b", "target"), out, mark)
    return tidy(incremental.current_scores(spark, out))
