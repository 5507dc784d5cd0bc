"""Folds and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from eraflow.catalog import sqltext as q
from eraflow.catalog.registry import register, tidy
from eraflow.catalog.rows_queries import ERAS
from eraflow.catalog.series_queries import PAY, S, corr_series, payouts
from eraflow.operators import ensemble, folds, rows, scoring
from eraflow.session import broadcast_checked
from eraflow.sources.testpanel import META, MODELS, customer_month


def eras(spark, sf):
    return rows.era_table(customer_month(spark, sf))


def walk_sql(k: int, purge: int) -> list[str]:
    return [ERAS, f"wf AS (SELECT fold::BIGINT AS fold, era, era_num::BIGINT AS era_num, pos - 1 AS i, n // {k + 1} AS size, n - {k} * (n // {k + 1}) + fold * (n // {k + 1}) AS st FROM er, range(0, {k}) r(fold))",
            f"wr AS (SELECT fold, CASE WHEN i >= st AND i < st + size THEN 'val' WHEN i < st - {purge} THEN 'train' END AS role, era, era_num FROM wf)"]


FOLD_SELECT = "SELECT fold, role, era, era_num FROM wr WHERE role IS NOT NULL"


@register("folds_walk_forward", q.query(walk_sql(4, 8), FOLD_SELECT))
def folds_walk_forward(spark, sf):
    return tidy(folds.walk_forward(eras(spark, sf), 4, 8))


@register("folds_anchor", q.query(walk_sql(1, 8), FOLD_SELECT))
def folds_anchor(spark, sf):
    return tidy(folds.anchor(eras(spark, sf), 8))


@register("folds_grouped_time", q.query(walk_sql(5, 0), FOLD_SELECT))
def folds_grouped_time(spark, sf):
    return tidy(folds.grouped_time_folds(eras(spark, sf), 5))


@register("fold_violations",
          q.query([*walk_sql(4, 4), "v AS (SELECT fold, count(*) FILTER (WHERE role = 'train')::BIGINT AS n_train, count(*) FILTER (WHERE role = 'val')::BIGINT AS n_val, "
                   "max(era_num) FILTER (WHERE role = 'train') AS train_max, min(era_num) FILTER (WHERE role = 'val') AS val_min FROM wr WHERE role IS NOT NULL GROUP BY fold)",
                   "g AS (SELECT v.*, 0::BIGINT AS n_shared, (SELECT count(*) FROM er WHERE era_num > train_max AND era_num < val_min)::BIGINT AS gap FROM v)"],
                  "SELECT * FROM g WHERE gap <> 8"))
def fold_violations(spark, sf):
    # folds cut with half the purge they are checked for: every one must be reported
    return tidy(folds.fold_violations(folds.walk_forward(eras(spark, sf), 4, 4), eras(spark, sf), 8))


@register("purged_split", q.query([], "SELECT DISTINCT 'train' AS role, era, era_num::BIGINT AS era_num FROM panel WHERE era_num <= 40 UNION ALL "
                                  "SELECT DISTINCT 'val', era, era_num::BIGINT FROM panel WHERE split = 'validation'"))
def purged_split(spark, sf):
    p = customer_month(spark, sf)
    return tidy(folds.purged_split(rows.era_table(p.where("split = 'train'")), rows.era_table(p.where("split = 'validation'")), 8))


@register("held_out_eras",
          q.query([ERAS, "h AS (SELECT *, pos > n - greatest(round_even(n * 0.2, 0), 1) AS held FROM er)", "m AS (SELECT min(era_num) AS first FROM h WHERE held)"],
                  "SELECT CASE WHEN held THEN 'held_out' WHEN era_num >= first - 8 AND era_num < first THEN 'purge' ELSE 'train' END AS role, era, era_num::BIGINT AS era_num FROM h, m"))
def held_out_eras(spark, sf):
    return tidy(folds.held_out(eras(spark, sf), 0.2, 8))


@register("stack_partitions",
          q.query([ERAS], "SELECT CASE WHEN pos > n - greatest(round_even(n * 0.25, 0), 1) THEN 'meta' WHEN pos > n - greatest(round_even(n * 0.25, 0), 1) - 16 THEN 'purge' ELSE 'specialist' END AS role, era, era_num::BIGINT AS era_num FROM er"))
def stack_partitions(spark, sf):
    return tidy(folds.stack_partitions(eras(spark, sf), 0.25, True))


@register("weight_learning_roles",
          q.query(walk_sql(4, 8), "SELECT CASE WHEN fold < 3 THEN 'learn' ELSE 'score' END AS role, era, era_num FROM wr WHERE role = 'val'"))
def weight_learning_roles(spark, sf):
    return tidy(folds.weight_learning_roles(folds.walk_forward(eras(spark, sf), 4, 8)))


@register("fold_rows", q.query(walk_sql(4, 8), "SELECT fold, wr.role, count(*)::BIGINT AS n FROM panel JOIN wr USING (era) WHERE role IS NOT NULL GROUP BY fold, role"))
def fold_rows(spark, sf):
    f = folds.walk_forward(eras(spark, sf), 4, 8).drop("era_num")
    joined = customer_month(spark, sf).select("era", "id").join(broadcast_checked(f), "era")
    return tidy(joined.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n")))


def unit_z(name: str, source: str, columns: list[str], by: str = "era", keep: str = "era, id") -> list[str]:
    """CTEs: ``name`` holds rank-gauss unit-variance versions of the columns."""
    ranks = ", ".join(f"({q.avg_rank(c, by)} - 0.5) / count(*) OVER (PARTITION BY {by}) AS u_{c}" for c in columns)
    zs = ", ".join(f"{q.ppf('u_' + c)} AS z_{c}" for c in columns)
    units = ", ".join(f"CASE WHEN stddev_pop(z_{c}) OVER (PARTITION BY {by}) > 0 THEN z_{c} / stddev_pop(z_{c}) OVER (PARTITION BY {by}) ELSE 0.0 END AS {c}" for c in columns)
    return [f"{name}_u AS (SELECT {keep}, {ranks} FROM {source})", f"{name}_z AS (SELECT {keep}, {zs} FROM {name}_u)", f"{name} AS (SELECT {keep}, {units} FROM {name}_z)"]


@register("rank_normalize", q.query(unit_z("o", "panel", MODELS), q.rounded("o", ["era", "id"], MODELS)))
def rank_normalize(spark, sf):
    df = customer_month(spark, sf).select("era", "id", *MODELS)
    return tidy(ensemble.rank_normalize(df, MODELS))


@register("blend",
          q.query([*unit_z("nz", "panel", MODELS), "bs AS (SELECT era, id, round(0.0::DOUBLE + 0.5::DOUBLE * pred_a + 0.3::DOUBLE * pred_b + 0.2::DOUBLE * pred_c, 12) AS s FROM nz)",
                   f"bu AS (SELECT era, id, ({q.avg_rank('s', 'era')} - 0.5) / count(*) OVER (PARTITION BY era) AS u FROM bs)", f"o AS (SELECT era, id, {q.ppf('u')} AS prediction FROM bu)"],
                  q.rounded("o", ["era", "id"], ["prediction"])))
def blend(spark, sf):
    df = customer_month(spark, sf).select("era", "id", *MODELS)
    return tidy(ensemble.blend(df, MODELS, [0.5, 0.3, 0.2]).select("era", "id", "prediction"))


@register("percentile_ensemble",
          q.query(["pr AS (SELECT era, id, count(*) OVER (PARTITION BY era) AS n, " + ", ".join(f"{q.avg_rank(m, 'era')} AS r_{m}" for m in MODELS) + " FROM panel)",
                   "ps AS (SELECT era, id, n, round(" + " + ".join(f"r_{m} / n" for m in MODELS) + ", 12) AS s FROM pr)",
                   f"o AS (SELECT era, id, {q.avg_rank('s', 'era')} / n AS prediction FROM ps)"], q.rounded("o", ["era", "id"], ["prediction"])))
def percentile_ensemble(spark, sf):
    df = customer_month(spark, sf).select("era", "id", *MODELS)
    return tidy(ensemble.percentile_ensemble(df, MODELS).select("era", "id", "prediction"))


GRAM2 = [*unit_z("nz", "panel", ["pred_a", "pred_b"], keep="era, id, target"),
         "gr AS (SELECT sum(pred_a * pred_a) AS aa, sum(pred_a * pred_b) AS ab, sum(pred_b * pred_b) AS bb, sum(pred_a * target) AS ca, sum(pred_b * target) AS cb FROM nz)"]


def _weights_frame(spark, df, weights):
    """The learned weights as rows beside the number of rows they were learned on."""
    cells = F.array(*[F.struct(F.lit(m).alias("model_id"), F.lit(w).alias("weight")) for m, w in weights])
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.explode(cells).alias("c")).select("n_rows", "c.*")


@register("learn_weights_ridge",
          q.query([*GRAM2, "w AS (SELECT (ca * (bb + 1) - cb * ab) / ((aa + 1) * (bb + 1) - ab * ab) AS wa, (cb * (aa + 1) - ca * ab) / ((aa + 1) * (bb + 1) - ab * ab) AS wb FROM gr)",
                   "o AS (SELECT 'pred_a' AS model_id, wa AS weight FROM w UNION ALL SELECT 'pred_b', wb FROM w)", "c AS (SELECT count(*)::BIGINT AS n_rows FROM panel)"],
                  q.rounded("o, c", ["model_id", "n_rows"], ["weight"])))
def learn_weights_ridge(spark, sf):
    df = customer_month(spark, sf)
    names = ["pred_a", "pred_b"]
    return tidy(_weights_frame(spark, df, zip(names, ensemble.learn_weights(df, names, "target"))))


@register("learn_weights_non_negative",
          q.query([*unit_z("nz", "panel", ["pred_a", "pred_c"], keep="era, id, target"),
                   "gr AS (SELECT sum(pred_a * pred_a) AS aa, sum(pred_a * pred_c) AS ab, sum(pred_c * pred_c) AS bb, sum(pred_a * target) AS ca, sum(pred_c * target) AS cb FROM nz)",
                   "w AS (SELECT *, (ca * bb - cb * ab) / (aa * bb - ab * ab) AS wa, (cb * aa - ca * ab) / (aa * bb - ab * ab) AS wb FROM gr)",
                   # one of two columns negative: the best single column with its own non-negative fit
                   "x AS (SELECT CASE WHEN wa >= 0 AND wb >= 0 THEN wa WHEN ca > 0 AND (cb <= 0 OR ca * ca / aa >= cb * cb / bb) THEN ca / aa ELSE 0.0 END AS wa, "
                   "CASE WHEN wa >= 0 AND wb >= 0 THEN wb WHEN cb > 0 AND NOT (ca > 0 AND ca * ca / aa >= cb * cb / bb) THEN cb / bb ELSE 0.0 END AS wb FROM w)",
                   "o AS (SELECT 'pred_a' AS model_id, wa AS weight FROM x UNION ALL SELECT 'pred_c', wb FROM x)", "c AS (SELECT count(*)::BIGINT AS n_rows FROM panel)"],
                  q.rounded("o, c", ["model_id", "n_rows"], ["weight"])))
def learn_weights_non_negative(spark, sf):
    df = customer_month(spark, sf)
    names = ["pred_a", "pred_c"]
    return tidy(_weights_frame(spark, df, zip(names, ensemble.learn_weights(df, names, "target", "non_negative"))))


SWEEP = [f"sb AS (SELECT * FROM panel WHERE {q.finite('bench_a20')})", *unit_z("sz", "sb", ["bench_a20"], keep="era, id, target AS t, pred_a, pred_b".replace("target AS t", "target")),
         "sl AS (SELECT era, target AS t, share, 'pred_a' AS candidate, round(pred_a - share * bench_a20, 12) AS x FROM sz, (SELECT unnest([0.0, 0.1, 0.3])::DOUBLE AS share) UNION ALL "
         "SELECT era, target, share, 'pred_b', round(pred_b - share * bench_a20, 12) FROM sz, (SELECT unnest([0.0, 0.1, 0.3])::DOUBLE AS share))",
         *unit_z("sn", "sl", ["x"], by="candidate, share, era", keep="candidate, share, era, t"),
         "se AS (SELECT candidate, share, era, covar_pop(x, t) / (stddev_pop(x) * stddev_pop(t)) AS v FROM sn GROUP BY candidate, share, era HAVING min(x) < max(x) AND min(t) < max(t))",
         "so AS (SELECT candidate, share, avg(v) AS score, count(*)::BIGINT AS n_eras FROM se GROUP BY candidate, share)"]


@register("decorrelation_sweep", q.query(SWEEP, q.rounded("so", ["candidate", "n_eras"], ["share", "score"])))
def decorrelation_sweep(spark, sf):
    return tidy(ensemble.decorrelation_sweep(customer_month(spark, sf), ["pred_a", "pred_b"], "bench_a20", "target", [0.0, 0.1, 0.3]))


@register("decorrelation_best", q.query([*SWEEP, "o AS (SELECT candidate, share, score FROM so ORDER BY score DESC, share LIMIT 1)"], q.rounded("o", ["candidate"], ["share", "score"])))
def decorrelation_best(spark, sf):
    sweep = ensemble.decorrelation_sweep(customer_month(spark, sf), ["pred_a", "pred_b"], "bench_a20", "target", [0.0, 0.1, 0.3])
    return tidy(ensemble.best_candidate(sweep))


SIM = [*unit_z("zz", "panel", MODELS), q.corr_scores("mc", "panel", "meta", "target_a_20"),
       "zs AS (SELECT zz.*, coalesce(mc.value < 0, false) AS stress FROM zz LEFT JOIN mc USING (era))",
       "pl AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, stress, {a} AS x, {b} AS y, CASE WHEN stress THEN {a} END AS xs, CASE WHEN stress THEN {b} END AS ys, CASE WHEN NOT stress THEN {a} END AS xn, CASE WHEN NOT stress THEN {b} END AS yn FROM zs"
                                      for i, a in enumerate(MODELS) for b in MODELS[i + 1:]) + ")",
       f"si AS (SELECT a, b, {q.corr('x', 'y')} AS corr, {q.corr('xs', 'ys')} AS stress_corr, {q.corr('xn', 'yn')} AS normal_corr, count(*) FILTER (WHERE stress)::BIGINT AS n_stress_rows FROM pl GROUP BY a, b)"]


def _similarity(spark, sf):
    df = customer_month(spark, sf)
    stress = scoring.downside_eras(scoring.per_era_corr(df, META, "target_a_20"))
    return ensemble.similarity(df, MODELS, stress)


@register("similarity", q.query(SIM, q.rounded("si", ["a", "b", "n_stress_rows"], ["corr", "stress_corr", "normal_corr"])))
def similarity(spark, sf):
    return tidy(_similarity(spark, sf))


@register("diversification",
          q.query([*SIM, "o AS (SELECT avg(corr) AS mean_overlap, max(corr) AS max_overlap, count(*)::BIGINT AS n_pairs, CASE WHEN min(n_stress_rows) >= 5 THEN avg(stress_corr) - avg(normal_corr) END AS stress_delta, "
                   "CASE WHEN avg(corr) < 0.65 THEN 'EXCELLENT DIVERSIFICATION' WHEN avg(corr) <= 0.85 THEN 'MODERATE OVERLAP' ELSE 'HIGH REDUNDANCY' END AS badge FROM si)"],
                  q.rounded("o", ["badge", "n_pairs"], ["mean_overlap", "max_overlap", "stress_delta"])))
def diversification(spark, sf):
    return tidy(ensemble.diversification(_similarity(spark, sf)))


@register("blended_sharpe",
          q.query([*PAY, "m AS (SELECT era, avg(value) AS m FROM pay GROUP BY era HAVING count(*) = 3)", "o AS (SELECT avg(m) / stddev_samp(m) AS blended_sharpe, count(*)::BIGINT AS n_eras FROM m)"],
                  q.rounded("o", ["n_eras"], ["blended_sharpe"])))
def blended_sharpe(spark, sf):
    return tidy(ensemble.blended_sharpe(payouts(spark, sf)))
