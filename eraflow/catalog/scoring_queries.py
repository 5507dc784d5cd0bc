"""Per-era scoring, ordered-rank and turnover queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eraflow.catalog import sqltext as q
from eraflow.catalog.registry import register, tidy
from eraflow.functions.ranks import with_ranks, with_rank_gauss, with_unit_variance
from eraflow.operators import scoring
from eraflow.operators.neutralize import neutralize
from eraflow.sources.testpanel import BENCHMARKS, FEATURES, META, customer_month, model_predictions

MODEL_ERA = ["model_id", "era"]


@register(
    "score_corr",
    q.query([q.MODELS, q.corr_scores("s", "models", "prediction", "target", "model_id, era")],
            q.rounded("s", ["model_id", "era"], ["value"])),
)
def score_corr(spark, sf):
    return tidy(scoring.per_era_corr(model_predictions(spark, sf), "prediction", "target", MODEL_ERA))


@register(
    "score_corr_sparse_target",
    q.query([q.corr_scores("s", "panel", "pred_a", "target_b_20")], q.rounded("s", ["era"], ["value"])),
)
def score_corr_sparse_target(spark, sf):
    return tidy(scoring.per_era_corr(customer_month(spark, sf), "pred_a", "target_b_20"))


@register(
    "score_mmc",
    q.query([q.MODELS, q.mmc_scores("s", "models", "prediction", "meta", "target", "model_id, era")],
            q.rounded("s", ["model_id", "era"], ["value"])),
)
def score_mmc(spark, sf):
    df = model_predictions(spark, sf)
    return tidy(scoring.per_era_mmc(df, "prediction", META, "target", MODEL_ERA))


@register(
    "score_bmc",
    q.query([q.mmc_scores("s", "panel", "pred_a", "bench_a20", "target"),
             "cov AS (SELECT era FROM panel GROUP BY era HAVING count(bench_a20) > 0)"],
            q.rounded("s SEMI JOIN cov USING (era)", ["era"], ["value"])),
)
def score_bmc(spark, sf):
    return tidy(scoring.per_era_bmc(customer_month(spark, sf), "pred_a", "bench_a20", "target"))


@register(
    "score_cwmm",
    q.query([q.MODELS, q.cwmm_scores("s", "models", "prediction", "meta", "model_id, era")],
            q.rounded("s", ["model_id", "era"], ["value"])),
)
def score_cwmm(spark, sf):
    return tidy(scoring.per_era_cwmm(model_predictions(spark, sf), "prediction", META, MODEL_ERA))


def _two_feature_residual(pred: str, by: str = "era") -> str:
    """CTEs: residual of ``pred`` on f_qty, f_tax and a constant, by normal equations."""
    return f"""
nz AS (SELECT era, id, {pred} AS p, f_qty::DOUBLE AS a, f_tax::DOUBLE AS b, target AS t FROM nsrc),
ns AS (SELECT era, count(*) AS n, avg(p) AS mp, avg(a) AS ma, avg(b) AS mb,
   var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, p) AS ap, covar_pop(b, p) AS bp
   FROM nz GROUP BY era),
nc AS (SELECT *, aa * bb - ab * ab AS det FROM ns),
nr AS (SELECT nz.era, nz.id, nz.p, nz.t, CASE WHEN n <= 2 THEN 0.0
   ELSE p - mp - (ap * bb - bp * ab) / det * (a - ma) - (bp * aa - ap * ab) / det * (b - mb) END AS res
   FROM nz JOIN nc USING (era))"""


@register(
    "score_fnc_two_features",
    q.query(
        [f"nrk AS (SELECT *, {q.avg_rank('pred_b', 'era')} AS rk, count(*) OVER (PARTITION BY era) AS cn FROM panel)",
         "nu AS (SELECT *, (rk - 0.5) / cn AS u FROM nrk)",
         f"nsrc AS (SELECT *, {q.ppf('u')} AS z FROM nu)",
         _two_feature_residual("z"),
         q.corr_scores("s", "nr", "res", "t")],
        q.rounded("s", ["era"], ["value"])),
)
def score_fnc_two_features(spark, sf):
    return tidy(scoring.per_era_fnc(customer_month(spark, sf), "pred_b", ["f_qty", "f_tax"], "target"))


@register("score_fnc_all_features")
def score_fnc_all_features(spark, sf):
    df = model_predictions(spark, sf).select(*MODEL_ERA, "id", "prediction")
    return tidy(scoring.per_era_fnc_models(df, customer_month(spark, sf), FEATURES, "target"))


THREE = ["f_qty", "f_tax", "f_prio"]


def _three_feature_residual() -> list[str]:
    """CTEs up to ``nr`` (model_id, era, id, p, t, res): the least-squares residual of z on
    three features and a constant, by Cramer's rule on centred sums."""
    a, b, c = THREE
    sums = ", ".join(f"covar_pop({x}, {y}) AS {n}" for x, y, n in (
        (a, a, "aa"), (b, b, "bb"), (c, c, "cc"), (a, b, "ab"), (a, c, "ac"), (b, c, "bc"), (a, "z", "az"), (b, "z", "bz"), (c, "z", "cz")))
    det = "(aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac))"
    wa = f"(az * (bb * cc - bc * bc) - ab * (bz * cc - bc * cz) + ac * (bz * bc - bb * cz)) / {det}"
    wb = f"(aa * (bz * cc - bc * cz) - az * (ab * cc - bc * ac) + ac * (ab * cz - bz * ac)) / {det}"
    wc = f"(aa * (bb * cz - bz * bc) - ab * (ab * cz - bz * ac) + az * (ab * bc - bb * ac)) / {det}"
    return [
        f"ns AS (SELECT model_id, era, {sums}, avg({a}) AS ma, avg({b}) AS mb, avg({c}) AS mc, avg(z) AS mz FROM nz GROUP BY model_id, era)",
        f"nw AS (SELECT model_id, era, ma, mb, mc, mz, {wa} AS wa, {wb} AS wb, {wc} AS wc FROM ns)",
        f"nr AS (SELECT model_id, era, id, prediction AS p, target AS t, z - mz - wa * ({a} - ma) - wb * ({b} - mb) - wc * ({c} - mc) AS res FROM nz JOIN nw USING (model_id, era))",
    ]


def fnc_three_sql(target: str) -> list[str]:
    """CTEs up to ``s`` (model_id, era, value): scores of ``models`` neutral to three features."""
    return [
        f"nk AS (SELECT model_id, era, id, prediction, {target} AS target, {', '.join(THREE)}, ({q.avg_rank('prediction', 'model_id, era')} - 0.5) / count(*) OVER (PARTITION BY model_id, era) AS u FROM models)",
        f"nz AS (SELECT *, {q.ppf('u')} AS z FROM nk)", *_three_feature_residual(),
        "nd AS (SELECT model_id, era, id, CASE WHEN abs(res) > 1e-9 THEN res ELSE 0.0 END AS res, t FROM nr)",
        q.corr_scores("s", "nd", "res", "t", "model_id, era"),
    ]


@register("score_fnc_three_features", q.query([q.MODELS, *fnc_three_sql("target")], q.rounded("s", ["model_id", "era"], ["value"], 5)))
def score_fnc_three_features(spark, sf):
    df = model_predictions(spark, sf).select(*MODEL_ERA, "id", "prediction")
    return tidy(scoring.per_era_fnc_models(df, customer_month(spark, sf), THREE, "target"), 5)


@register(
    "neutralize_two_features",
    q.query(["nsrc AS (SELECT * FROM panel)", _two_feature_residual("pred_b"),
             "res AS (SELECT era, id, CASE WHEN max(p) OVER (PARTITION BY era) = min(p) OVER (PARTITION BY era) "
             "THEN p ELSE p - 0.5 * (p - res) END AS pred_b FROM nr)"],
            q.rounded("res", ["era", "id"], ["pred_b"])),
)
def neutralize_two_features(spark, sf):
    df = customer_month(spark, sf).select("era", "id", "pred_b", "f_qty", "f_tax")
    return tidy(neutralize(df, "pred_b", ["f_qty", "f_tax"], 0.5).select("era", "id", "pred_b"))


@register(
    "coverage_eras",
    q.query([], f"SELECT era, count(*) FILTER (WHERE {q.finite('bench_a20')})::BIGINT AS n_covered FROM panel "
            f"GROUP BY era HAVING count(*) FILTER (WHERE {q.finite('bench_a20')}) > 0"),
)
def coverage_eras(spark, sf):
    return scoring.coverage_eras(customer_month(spark, sf), "bench_a20")


@register(
    "downside_eras",
    q.query([q.corr_scores("s", "panel", "meta", "target_a_20")],
            q.rounded("s", ["era"], ["value"], tail="WHERE value < 0")),
)
def downside_eras(spark, sf):
    meta_corr = scoring.per_era_corr(customer_month(spark, sf), META, "target_a_20")
    return tidy(scoring.downside_eras(meta_corr))


@register(
    "mmc_down",
    q.query([q.MODELS, q.mmc_scores("a", "models", "prediction", "meta", "target_a_20", "model_id, era"),
             q.corr_scores("b", "panel", "meta", "target_a_20"),
             "d AS (SELECT model_id, avg(CASE WHEN b.value < 0 THEN a.value END) AS md, "
             "count(*) FILTER (WHERE b.value < 0)::BIGINT AS n FROM a JOIN b USING (era) GROUP BY model_id)"],
            "SELECT model_id, CASE WHEN n >= 5 THEN round(md, 6) + 0.0 END AS mmc_down, n AS mmc_down_n_eras, "
            "CASE WHEN n < 5 THEN 'insufficient_downside_eras' END AS mmc_down_reason FROM d"),
)
def mmc_down(spark, sf):
    rows = model_predictions(spark, sf)
    mmc = scoring.per_era_mmc(rows, "prediction", META, "target_a_20", MODEL_ERA)
    meta_corr = scoring.per_era_corr(customer_month(spark, sf), META, "target_a_20")
    return tidy(scoring.mmc_down(mmc, meta_corr, ["model_id"]))


@register(
    "era_sharpe",
    q.query([q.MODELS,
             "c AS (SELECT model_id, era, covar_pop(target, prediction) / (stddev_pop(prediction) * stddev_pop(target)) AS v "
             "FROM models GROUP BY model_id, era HAVING min(prediction) < max(prediction) AND min(target) < max(target))",
             "s AS (SELECT model_id, avg(v) / (stddev_pop(v) + 1e-12) AS era_sharpe, count(v)::BIGINT AS n_eras FROM c GROUP BY model_id)"],
            q.rounded("s", ["model_id", "n_eras"], ["era_sharpe"], 5)),
)
def era_sharpe(spark, sf):
    df = scoring.era_sharpe(model_predictions(spark, sf), "prediction", "target", ["model_id"])
    return tidy(df, 5)


@register(
    "era_spearman_mean",
    q.query([f"r AS (SELECT era, {q.avg_rank('pred_a', 'era')} AS x, {q.avg_rank('meta', 'era')} AS y FROM panel)",
             f"c AS (SELECT era, {q.corr('x', 'y')} AS v FROM r GROUP BY era)",
             "s AS (SELECT avg(v) AS mean_spearman, count(v)::BIGINT AS n_eras FROM c)"],
            q.rounded("s", ["n_eras"], ["mean_spearman"])),
)
def era_spearman_mean(spark, sf):
    return tidy(scoring.per_era_spearman_mean(customer_month(spark, sf), "pred_a", META))


TURNOVER_SQL = [
    "ep AS (SELECT era, row_number() OVER (ORDER BY era_num) AS pos FROM (SELECT DISTINCT era, era_num FROM panel))",
    "pp AS (SELECT p.era, p.era_num, pos, id, pred_b AS v FROM panel p JOIN ep USING (era))",
    "tj AS (SELECT a.era, a.era_num, a.v AS now, b.v AS before FROM pp a JOIN pp b ON a.id = b.id AND a.pos = b.pos + 1)",
    f"tr AS (SELECT era, era_num, {q.avg_rank('now', 'era')} AS x, {q.avg_rank('before', 'era')} AS y FROM tj)",
    f"tv AS (SELECT era, era_num, count(*)::BIGINT AS n_shared, 1.0 - {q.corr('x', 'y')} AS value FROM tr "
    "GROUP BY era, era_num HAVING count(*) >= 10)",
]


@register("turnover", q.query(TURNOVER_SQL, q.rounded("tv", ["era", "era_num::BIGINT AS era_num", "n_shared"], ["value"])))
def turnover(spark, sf):
    return tidy(scoring.per_era_turnover(customer_month(spark, sf), "pred_b"))


@register(
    "degenerate_eras",
    q.query([f"c AS (SELECT *, {q.finite('pred_a')} AND {q.finite('target_b_20')} AND {q.finite('bench_a20')} AS ok FROM panel)"],
            "SELECT era, count(*) FILTER (WHERE ok)::BIGINT AS n_usable FROM c GROUP BY era HAVING NOT coalesce("
            "count(*) FILTER (WHERE ok) >= 2 AND min(pred_a) FILTER (WHERE ok) < max(pred_a) FILTER (WHERE ok) "
            "AND min(target_b_20) FILTER (WHERE ok) < max(target_b_20) FILTER (WHERE ok) "
            "AND min(bench_a20) FILTER (WHERE ok) < max(bench_a20) FILTER (WHERE ok), false)"),
)
def degenerate_eras(spark, sf):
    return scoring.degenerate_eras(
        customer_month(spark, sf), "pred_a", "target_b_20", "bench_a20", FEATURES
    )


@register(
    "rank_average",
    q.query([f"r AS (SELECT era, id, {q.avg_rank('f_qty', 'era')} AS avg_rank FROM panel)"],
            q.rounded("r", ["era", "id"], ["avg_rank"])),
)
def rank_average(spark, sf):
    df = with_ranks(customer_month(spark, sf), ["era"], {"avg_rank": "f_qty"})
    return tidy(df.select("era", "id", "avg_rank"))


@register(
    "rank_percentile",
    q.query([f"r AS (SELECT era, id, {q.avg_rank('pred_a', 'era')} AS k, count(*) OVER (PARTITION BY era) AS n FROM panel)",
             "p AS (SELECT era, id, (k - 0.5) / n AS open_rank, k / n AS pct_rank FROM r)"],
            q.rounded("p", ["era", "id"], ["open_rank", "pct_rank"])),
)
def rank_percentile(spark, sf):
    df = with_ranks(customer_month(spark, sf), ["era"], {"k": "pred_a"}, count_as="n")
    return tidy(
        df.select("era", "id", ((F.col("k") - 0.5) / F.col("n")).alias("open_rank"),
                  (F.col("k") / F.col("n")).alias("pct_rank"))
    )


@register(
    "rank_gauss",
    q.query([f"r AS (SELECT era, id, {q.avg_rank('pred_a', 'era')} AS k, count(*) OVER (PARTITION BY era) AS n FROM panel)",
             "u AS (SELECT *, (k - 0.5) / n AS u FROM r)", f"z AS (SELECT era, id, {q.ppf('u')} AS z FROM u)",
             "d AS (SELECT *, stddev_pop(z) OVER (PARTITION BY era) AS sd FROM z)",
             "s AS (SELECT era, id, z, CASE WHEN sd > 0 THEN z / sd ELSE 0.0 END AS z_unit FROM d)"],
            q.rounded("s", ["era", "id"], ["z", "z_unit"])),
)
def rank_gauss(spark, sf):
    df = with_rank_gauss(customer_month(spark, sf), ["era"], {"z": "pred_a"})
    df = with_unit_variance(df.withColumn("z_unit", F.col("z")), ["era"], ["z_unit"])
    return tidy(df.select("era", "id", "z", "z_unit"))


@register(
    "rank_ordinal",
    q.query([], "SELECT era, id, round(row_number() OVER (PARTITION BY era ORDER BY f_qty, id) / "
            "count(*) OVER (PARTITION BY era)::DOUBLE, 6) + 0.0 AS ordinal_rank FROM panel"),
)
def rank_ordinal(spark, sf):
    from eraflow.operators.series import ordinal_percentile

    df = ordinal_percentile(customer_month(spark, sf), "f_qty", "ordinal_rank")
    return tidy(df.select("era", "id", "ordinal_rank"))
