"""Dataset, target, feature, drift, correlation and regime queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eraflow.catalog import sqltext as q
from eraflow.catalog.registry import register, tidy
from eraflow.catalog.series_queries import BLOCK20, bootstrap_ctes
from eraflow.operators import analysis, correlation, drift
from eraflow.sources.testpanel import (
    BENCHMARKS, FEATURES, META, TARGETS, TRAIN_LAST_ERA, customer_month, embedding_panel, stored,
)

IC_TARGETS = ["target", "target_a_20", "target_a_60"]
N_BOOT = 200


def ic_table(spark, sf):
    """IC of every feature with three targets, computed once and shared."""
    return stored(spark, sf, "ic_table", lambda s, d: analysis.ic_by_era(customer_month(s, d), FEATURES, IC_TARGETS))


def _union(columns, name, value, source="panel", keys="era, era_num", where=""):
    return " UNION ALL ".join(f"SELECT {keys}, '{c}' AS {name}, {c}::DOUBLE AS {value} FROM {source} {where}" for c in columns)


def ic_ctes(features=FEATURES, targets=IC_TARGETS) -> list[str]:
    ok = " AND ".join(f"{c} IS NOT NULL" for c in [*features, *targets])
    feats = " UNION ALL ".join(f"SELECT *, '{f}' AS feature, {f}::DOUBLE AS x FROM icb" for f in features)
    tgts = " UNION ALL ".join(f"SELECT era, era_num, feature, x, '{t}' AS target, {t}::DOUBLE AS y FROM icf" for t in targets)
    return [
        f"icb AS (SELECT * FROM panel WHERE {ok})", f"icf AS ({feats})", f"icl AS (SELECT * FROM ({tgts}) WHERE isfinite(y))",
        f"icr AS (SELECT *, {q.avg_rank('x', 'target, feature, era')} AS rx, {q.avg_rank('y', 'target, feature, era')} AS ry FROM icl)",
        f"ics AS (SELECT target, feature, era, era_num, {q.corr('x', 'y')} AS ic, {q.corr('rx', 'ry')} AS spearman_ic, "
        "count(*) >= 2 AND min(y) < max(y) AS varies FROM icr GROUP BY target, feature, era, era_num)",
        "icg AS (SELECT * FROM (SELECT DISTINCT era, era_num FROM panel), "
        f"(SELECT unnest({list(targets)}) AS target), (SELECT unnest({list(features)}) AS feature))",
        "ic AS (SELECT g.target, g.feature, g.era, g.era_num, CASE WHEN varies THEN ic ELSE 0.0 END AS ic, "
        "CASE WHEN varies THEN spearman_ic ELSE 0.0 END AS spearman_ic, NOT coalesce(varies, false) AS degenerate "
        "FROM icg g LEFT JOIN ics USING (target, feature, era))",
    ]


@register("describe_splits",
          q.query(["e AS (SELECT split, era, era_num, count(*) AS r FROM panel GROUP BY split, era, era_num)",
                   "s AS (SELECT split, sum(r)::BIGINT AS n_rows, count(*)::BIGINT AS n_eras, min_by(era, era_num) AS min_era, max_by(era, era_num) AS max_era, "
                   "min(r)::BIGINT AS rows_per_era_min, median(r) AS rows_per_era_median, max(r)::BIGINT AS rows_per_era_max, "
                   "avg(r) AS rows_per_era_mean, stddev_pop(r) AS rows_per_era_std FROM e GROUP BY split)",
                   "i AS (SELECT split, count(DISTINCT id)::BIGINT AS n_ids FROM panel GROUP BY split)"],
                  q.rounded("s JOIN i USING (split)", ["split", "n_rows", "n_eras", "min_era", "max_era", "rows_per_era_min", "rows_per_era_max", "n_ids"],
                            ["rows_per_era_median", "rows_per_era_mean", "rows_per_era_std"])))
def describe_splits(spark, sf):
    return tidy(analysis.describe_splits(customer_month(spark, sf)))


@register("era_structure",
          q.query(["e AS (SELECT era, era_num, count(*)::BIGINT AS n_rows, count(DISTINCT id)::BIGINT AS n_ids FROM panel GROUP BY era, era_num)"],
                  "SELECT era, era_num::BIGINT AS era_num, n_rows, n_ids, coalesce(era_num <> lag(era_num) OVER (ORDER BY era_num) + 1, false) AS gap FROM e"))
def era_structure(spark, sf):
    return tidy(analysis.era_structure(customer_month(spark, sf)))


@register("target_profile",
          q.query([f"l AS ({_union(TARGETS, 'target', 'v')})", "lf AS (SELECT target, era, CASE WHEN isfinite(v) THEN v END AS v FROM l)",
                   "e AS (SELECT target, era, avg(v) AS m, count(v) >= 2 AND min(v) = max(v) AS flat FROM lf GROUP BY target, era)",
                   "es AS (SELECT target, count(m)::BIGINT AS n_eras_present, avg(m) AS era_mean_mean, stddev_pop(m) AS era_mean_std, "
                   "count(*) FILTER (WHERE flat)::BIGINT AS zero_variance_era_count FROM e GROUP BY target)",
                   "p AS (SELECT target, 1.0 - count(v) / count(*)::DOUBLE AS missing_rate, avg(v) AS pooled_mean, stddev_pop(v) AS pooled_std, min(v) AS min, max(v) AS max FROM lf GROUP BY target)",
                   "k AS (SELECT target, avg(pow(v - pooled_mean, 3)) / pow(any_value(pooled_std), 3) AS pooled_skew, "
                   "avg(pow(v - pooled_mean, 4)) / pow(any_value(pooled_std), 4) - 3 AS pooled_kurtosis FROM lf JOIN p USING (target) GROUP BY target)"],
                  q.rounded("p JOIN es USING (target) JOIN k USING (target)", ["target", "n_eras_present", "zero_variance_era_count"],
                            ["missing_rate", "era_mean_mean", "era_mean_std", "pooled_mean", "pooled_std", "pooled_skew", "pooled_kurtosis", "min", "max"])))
def target_profile(spark, sf):
    return tidy(analysis.target_profile(customer_month(spark, sf), TARGETS))


@register("target_correlation",
          q.query(["pr AS (" + " UNION ALL ".join(
              f"SELECT '{a}' AS target_a, '{b}' AS target_b, era, {a} AS va, {b} AS vb FROM panel" for i, a in enumerate(TARGETS) for b in TARGETS[i + 1:]) + ")",
              "pf AS (SELECT * FROM pr WHERE isfinite(va) AND isfinite(vb))",
              f"k AS (SELECT *, {q.avg_rank('va', 'target_a, target_b, era')} AS ra, {q.avg_rank('vb', 'target_a, target_b, era')} AS rb FROM pf)",
              "e AS (SELECT target_a, target_b, era, covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)) AS c FROM k GROUP BY target_a, target_b, era "
              "HAVING count(*) >= 2 AND min(va) < max(va) AND min(vb) < max(vb))",
              "o AS (SELECT target_a, target_b, avg(c) AS mean_corr, count(*)::BIGINT AS n_eras FROM e GROUP BY target_a, target_b)"],
              q.rounded("o", ["target_a", "target_b", "n_eras"], ["mean_corr"])))
def target_correlation(spark, sf):
    return tidy(analysis.target_correlation(customer_month(spark, sf), TARGETS))


@register("ic_by_era", q.query(ic_ctes(), q.rounded("ic", ["target", "feature", "era", "era_num::BIGINT AS era_num", "degenerate"], ["ic", "spearman_ic"])))
def ic_by_era(spark, sf):
    return tidy(analysis.ic_by_era(customer_month(spark, sf), FEATURES, IC_TARGETS))


@register("ic_by_era_sparse_target",
          q.query(ic_ctes(FEATURES, ["target_b_20"]), q.rounded("ic", ["target", "feature", "era", "era_num::BIGINT AS era_num", "degenerate"], ["ic", "spearman_ic"])))
def ic_by_era_sparse_target(spark, sf):
    return tidy(analysis.ic_by_era(customer_month(spark, sf), FEATURES, ["target_b_20"]))


EMB = ("emb AS (SELECT lpad((vec_id % 4 + 1)::VARCHAR, 4, '0') AS era, vec_id AS id, label::DOUBLE AS target, "
       "unnest(range(0, 64)) AS feature, unnest(embedding)::DOUBLE AS x FROM embeddings)")


@register("ic_vector",
          q.query([EMB, f"o AS (SELECT era, feature::BIGINT AS feature, {q.corr('x', 'target')} AS ic FROM emb GROUP BY era, feature)"],
                  q.rounded("o", ["era", "feature"], ["ic"]), panel=False))
def ic_vector(spark, sf):
    return tidy(analysis.vector_ic_by_era(embedding_panel(spark, sf), "features", "target"))


@register("feature_summary",
          q.query([f"l AS ({_union([*FEATURES, 'target_b_20'], 'feature', 'v')})", "lf AS (SELECT feature, CASE WHEN isfinite(v) THEN v END AS v FROM l)",
                   "p AS (SELECT feature, 1.0 - count(v) / count(*)::DOUBLE AS missing_rate, avg(v) AS pooled_mean, stddev_pop(v) AS pooled_std, min(v) AS min, max(v) AS max FROM lf GROUP BY feature)",
                   "k AS (SELECT feature, avg(pow(v - pooled_mean, 3)) / pow(any_value(pooled_std), 3) AS pooled_skew, "
                   "avg(pow(v - pooled_mean, 4)) / pow(any_value(pooled_std), 4) - 3 AS pooled_kurtosis FROM lf JOIN p USING (feature) GROUP BY feature)"],
                  q.rounded("p JOIN k USING (feature)", ["feature"], ["missing_rate", "pooled_mean", "pooled_std", "pooled_skew", "pooled_kurtosis", "min", "max"])))
def feature_summary(spark, sf):
    return tidy(analysis.feature_summary(customer_month(spark, sf), [*FEATURES, "target_b_20"]))


def screen_ctes(name="scr", ic="ic", where="NOT degenerate") -> list[str]:
    return [
        f"{name}v AS (SELECT *, row_number() OVER (PARTITION BY target, feature ORDER BY era_num) - 1 AS i, "
        f"floor(count(*) OVER (PARTITION BY target, feature) / 2.0) AS half FROM {ic} WHERE {where})",
        f"{name} AS (SELECT target, feature, avg(ic) AS mean_corr, stddev_pop(ic) AS corr_std, regr_slope(ic, i) AS decay_slope, "
        "0.25 * pow(coalesce(avg(ic) FILTER (WHERE i < half), 0) - avg(ic) FILTER (WHERE i >= half), 2) AS cross_regime_variance, "
        f"avg(spearman_ic) AS mean_spearman, count(*)::BIGINT AS n_eras FROM {name}v GROUP BY target, feature)",
    ]


STABLE = "(mean_corr >= 0.01 AND abs(decay_slope) <= 0.001 AND n_eras >= 2)"
SCREEN_DOUBLES = ["mean_corr", "corr_std", "decay_slope", "cross_regime_variance", "mean_spearman"]


@register("stability_screen",
          q.query([*ic_ctes(), *screen_ctes()], q.rounded("scr", ["target", "feature", "n_eras", f"{STABLE} AS stable"], SCREEN_DOUBLES)))
def stability_screen(spark, sf):
    return tidy(analysis.stability_screen(ic_table(spark, sf)))


@register("stable_features", q.query([*ic_ctes(), *screen_ctes()], f"SELECT target, feature FROM scr WHERE {STABLE}"))
def stable_features(spark, sf):
    return analysis.select_stable(analysis.stability_screen(ic_table(spark, sf)))


BLOCK_SCREEN = ("CASE WHEN target LIKE '%\\_60' ESCAPE '\\' THEN least(greatest(round_even(pow(n, 1.0 / 3.0), 0), 13), n) ELSE " + BLOCK20 + " END")


def full_screen_ctes(where="NOT degenerate") -> list[str]:
    return [
        *screen_ctes(where=where),
        f"bsrc AS (SELECT target, feature, era_num, ic AS value FROM ic WHERE {where})",
        *bootstrap_ctes("bsrc", "target, feature", BLOCK_SCREEN, N_BOOT, 0),
        "bq AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY p_value, feature) AS i, count(*) OVER (PARTITION BY target) AS m FROM bo)",
        "bf AS (SELECT *, least(min(p_value * m / i) OVER (PARTITION BY target ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0) AS fdr_q FROM bq)",
        "fs AS (SELECT scr.*, ci_low AS mean_corr_ci_lo, ci_high AS mean_corr_ci_hi, p_value, fdr_q, "
        "(ci_low > 0 AND ci_high > 0) OR (ci_low < 0 AND ci_high < 0) AS ci_excludes_zero, fdr_q <= 0.05 AS fdr_pass, "
        "abs(mean_corr) <= 0.01 AND abs(mean_spearman) > 0.01 AS nonlinear, "
        f"{STABLE} AND ((ci_low > 0 AND ci_high > 0) OR (ci_low < 0 AND ci_high < 0)) AND fdr_q <= 0.05 AS stable "
        "FROM scr JOIN bf USING (target, feature))",
    ]


@register("full_screen",
          q.query([*ic_ctes(), *full_screen_ctes()],
                  q.rounded("fs", ["target", "feature", "n_eras", "ci_excludes_zero", "fdr_pass", "nonlinear", "stable"],
                            [*SCREEN_DOUBLES, "mean_corr_ci_lo", "mean_corr_ci_hi", "p_value", "fdr_q"])))
def full_screen(spark, sf):
    return tidy(analysis.full_screen(ic_table(spark, sf), n_boot=N_BOOT, seed=0))


@register("nonlinear_features",
          q.query([*ic_ctes(), *screen_ctes()],
                  "SELECT target, feature, coalesce(abs(mean_corr) <= 0.01 AND abs(mean_spearman) > 0.01, false) AS nonlinear FROM scr"))
def nonlinear_features(spark, sf):
    screen = analysis.stability_screen(ic_table(spark, sf))
    return screen.select("target", "feature", analysis.nonlinear_flag().alias("nonlinear"))


@register("ic_by_split",
          q.query([*ic_ctes(), "t AS (SELECT target, feature, avg(ic) AS train_mean_ic, count(*)::BIGINT AS train_n_eras FROM ic WHERE NOT degenerate AND era_num <= 48 GROUP BY ALL)",
                   "v AS (SELECT target, feature, avg(ic) AS val_mean_ic, count(*)::BIGINT AS val_n_eras FROM ic WHERE NOT degenerate AND era_num >= 53 GROUP BY ALL)",
                   "o AS (SELECT *, val_mean_ic - train_mean_ic AS delta_ic FROM t FULL JOIN v USING (target, feature))"],
                  q.rounded("o", ["target", "feature", "train_n_eras", "val_n_eras"], ["train_mean_ic", "val_mean_ic", "delta_ic"])))
def ic_by_split(spark, sf):
    return tidy(analysis.ic_by_split(ic_table(spark, sf), TRAIN_LAST_ERA, TRAIN_LAST_ERA + 5))


DRIFT_COLUMNS = [*FEATURES, "pred_a", "target_b_20"]


def drift_ctes(columns=DRIFT_COLUMNS) -> list[str]:
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, era_num <= 48 AS tr, {c}::DOUBLE AS v FROM panel" for c in columns)
    return [
        f"dl AS (SELECT * FROM ({long}) WHERE isfinite(v))",
        "dt AS (SELECT feature, count(*) FILTER (WHERE tr) AS n_train, count(*) FILTER (WHERE NOT tr) AS n_val, stddev_pop(v) FILTER (WHERE tr) AS sd, "
        "min(v) FILTER (WHERE tr) = max(v) FILTER (WHERE tr) AS const, "
        + ", ".join(f"quantile_cont(v, {i / 10}) FILTER (WHERE tr) AS e{i}" for i in range(1, 10)) + " FROM dl GROUP BY feature)",
        "dbn AS (SELECT feature, " + " + ".join(f"(e{i} <= v)::INTEGER" for i in range(1, 10)) + " AS bin, tr, n_train, n_val FROM dl JOIN dt USING (feature))",
        "dbc AS (SELECT feature, bin, count(*) FILTER (WHERE tr) / any_value(n_train)::DOUBLE + 1e-6 AS pt, count(*) FILTER (WHERE NOT tr) / any_value(n_val)::DOUBLE + 1e-6 AS pv FROM dbn GROUP BY feature, bin)",
        "dpsi AS (SELECT feature, sum((pv - pt) * ln(pv / pt)) AS psi FROM dbc GROUP BY feature)",
        "dv AS (SELECT feature, v, count(*) FILTER (WHERE tr) AS nt, count(*) FILTER (WHERE NOT tr) AS nv FROM dl GROUP BY feature, v)",
        "dc AS (SELECT *, sum(nt) OVER w AS ct, sum(nv) OVER w AS cv, lead(v) OVER w AS nx FROM dv WINDOW w AS (PARTITION BY feature ORDER BY v))",
        "dw AS (SELECT feature, sum(abs(ct / n_train::DOUBLE - cv / n_val::DOUBLE) * (coalesce(nx, v) - v)) AS w1, "
        "(sum((ct + cv - (nt + nv) + (nt + nv + 1) / 2.0::DOUBLE) * nv) - any_value(n_val) * (any_value(n_val) + 1) / 2.0::DOUBLE) / (any_value(n_train)::DOUBLE * any_value(n_val)) AS auc_roc "
        "FROM dc JOIN dt USING (feature) GROUP BY feature)",
        "dr AS (SELECT feature, CASE WHEN const THEN 0.0 ELSE psi END AS psi, w1, CASE WHEN sd > 0 THEN w1 / sd END AS w1_norm, auc_roc, n_train::BIGINT AS n_train, n_val::BIGINT AS n_val FROM dt JOIN dpsi USING (feature) JOIN dw USING (feature))",
        "drf AS (SELECT *, coalesce(psi > 0.25, false) OR coalesce(w1_norm > 0.5, false) OR coalesce(abs(auc_roc - 0.5) > 0.1, false) AS drifted FROM dr)",
    ]


@register("drift_profile", q.query(drift_ctes(), q.rounded("drf", ["feature", "n_train", "n_val", "drifted"], ["psi", "w1", "w1_norm", "auc_roc"])))
def drift_profile(spark, sf):
    return tidy(drift.drift_profile(customer_month(spark, sf), DRIFT_COLUMNS, F.col("era_num") <= TRAIN_LAST_ERA))


@register("drift_psi", q.query(drift_ctes(), q.rounded("dr", ["feature", "n_train", "n_val", "psi > 0.25 AS drifted"], ["psi"])))
def drift_psi(spark, sf):
    return tidy(drift.drift_psi(customer_month(spark, sf), DRIFT_COLUMNS, F.col("era_num") <= TRAIN_LAST_ERA))


@register("meta_orthogonality",
          q.query(["b AS (SELECT * FROM panel WHERE target_b_20 IS NOT NULL AND isfinite(target_b_20) AND meta IS NOT NULL)",
                   f"l AS ({_union(FEATURES, 'feature', 'x', 'b', 'era, meta AS m, target_b_20 AS t')})",
                   f"e AS (SELECT feature, era, {q.corr('x', 'm')} AS cm, {q.corr('x', 't')} AS ct FROM l GROUP BY feature, era "
                   "HAVING count(*) >= 2 AND min(m) < max(m) AND min(t) < max(t))",
                   "o AS (SELECT feature, avg(cm) AS corr_meta, avg(ct) AS corr_target, count(*)::BIGINT AS n_eras FROM e GROUP BY feature)"],
                  q.rounded("o", ["feature", "n_eras", "abs(corr_meta) <= 0.01 AND abs(corr_target) > 0.01 AS orthogonal"], ["corr_meta", "corr_target"])))
def meta_orthogonality(spark, sf):
    return tidy(analysis.meta_orthogonality(customer_month(spark, sf), FEATURES, META, "target_b_20"))


NAMES = [f"e{i:02d}" for i in range(64)]


def emb_pair_ctes() -> list[str]:
    return [EMB, f"er AS (SELECT era, id, feature, {q.avg_rank('x', 'era, feature')} / (count(*) OVER (PARTITION BY era, feature) + 1) AS u FROM emb)",
            f"ez AS (SELECT era, id, feature, {q.ppf('u')} AS z FROM er)",
            f"ep AS (SELECT x.era, x.feature AS a, y.feature AS b, {q.corr('x.z', 'y.z')} AS corr FROM ez x JOIN ez y ON x.era = y.era AND x.id = y.id AND x.feature < y.feature GROUP BY x.era, x.feature, y.feature)",
            "em AS (SELECT 'e' || lpad(a::VARCHAR, 2, '0') AS feature_a, 'e' || lpad(b::VARCHAR, 2, '0') AS feature_b, avg(corr) AS mean_corr FROM ep GROUP BY a, b)"]


def panel_pair_ctes() -> list[str]:
    feats = " UNION ALL ".join(f"SELECT era, id, {i} AS feature, {f}::DOUBLE AS x FROM panel" for i, f in enumerate(FEATURES))
    return [f"emb AS ({feats})", *emb_pair_ctes()[1:4],
            f"em AS (SELECT (list_value({', '.join(repr(f) for f in FEATURES)}))[a + 1] AS feature_a, (list_value({', '.join(repr(f) for f in FEATURES)}))[b + 1] AS feature_b, avg(corr) AS mean_corr "
            "FROM ep WHERE era IN (SELECT era FROM panel GROUP BY era HAVING count(*) >= 2) GROUP BY a, b)"]


def emb_pairs(spark, sf):
    return stored(spark, sf, "emb_pairs", lambda s, d: correlation.correlation_structure(embedding_panel(s, d), "features", NAMES))


@register("feature_correlation", q.query(panel_pair_ctes(), q.rounded("em", ["feature_a", "feature_b"], ["mean_corr"])))
def feature_correlation(spark, sf):
    return tidy(correlation.correlation_structure(customer_month(spark, sf), FEATURES))


@register("feature_correlation_vector", q.query(emb_pair_ctes(), q.rounded("em", ["feature_a", "feature_b"], ["mean_corr"]), panel=False))
def feature_correlation_vector(spark, sf):
    return tidy(correlation.correlation_structure(embedding_panel(spark, sf), "features", NAMES))


@register("feature_correlation_top",
          q.query([*emb_pair_ctes(), "o AS (SELECT * FROM em ORDER BY abs(mean_corr) DESC, feature_a, feature_b LIMIT 100)"],
                  q.rounded("o", ["feature_a", "feature_b"], ["mean_corr"]), panel=False))
def feature_correlation_top(spark, sf):
    return tidy(correlation.top_pairs(emb_pairs(spark, sf), 100))


@register("feature_correlation_summary",
          q.query([*emb_pair_ctes(), "o AS (SELECT avg(abs(mean_corr)) AS mean_abs_corr, quantile_cont(abs(mean_corr), 0.5) AS p50_abs_corr, "
                   "quantile_cont(abs(mean_corr), 0.9) AS p90_abs_corr, count(*)::BIGINT AS n_pairs FROM em)"],
                  q.rounded("o", ["n_pairs"], ["mean_abs_corr", "p50_abs_corr", "p90_abs_corr"]), panel=False))
def feature_correlation_summary(spark, sf):
    return tidy(correlation.structure_summary(emb_pairs(spark, sf)))


SETS = {"small": FEATURES[:2], "medium": FEATURES[:4], "all": FEATURES, "single": FEATURES[5:]}
SETS_SQL = "sets AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{f}')" for s, fs in SETS.items() for f in fs) + ") v(feature_set, feature))"


def set_table(spark):
    return spark.createDataFrame([(s, f) for s, fs in SETS.items() for f in fs], "feature_set string, feature string")


@register("set_redundancy",
          q.query([*panel_pair_ctes(), SETS_SQL,
                   "i AS (SELECT feature_set, avg(abs(mean_corr)) AS mean_abs_corr, median(abs(mean_corr)) AS median_abs_corr, max(abs(mean_corr)) AS max_abs_corr, count(*) AS n_pairs "
                   "FROM em JOIN sets s1 ON s1.feature = feature_a JOIN sets s2 USING (feature_set) WHERE s2.feature = feature_b GROUP BY feature_set)",
                   "o AS (SELECT feature_set, count(*)::BIGINT AS n_features FROM sets GROUP BY feature_set)"],
                  q.rounded("o LEFT JOIN i USING (feature_set)", ["feature_set", "n_features", "coalesce(n_pairs, 0)::BIGINT AS n_pairs"], ["mean_abs_corr", "median_abs_corr", "max_abs_corr"])))
def set_redundancy(spark, sf):
    pairs = correlation.correlation_structure(customer_month(spark, sf), FEATURES)
    return tidy(correlation.set_redundancy(pairs, set_table(spark)))


@register("correlation_change",
          q.query([*panel_pair_ctes()[:-1],
                   "o AS (SELECT a::BIGINT AS a, b::BIGINT AS b, max(corr) FILTER (WHERE era = '0010') - max(corr) FILTER (WHERE era = '0060') AS difference FROM ep GROUP BY a, b)"],
                  q.rounded("o", ["a", "b"], ["difference"])))
def correlation_change(spark, sf):
    return tidy(correlation.era_pair_difference(customer_month(spark, sf), FEATURES, "0010", "0060"))


IC_MAIN = "icm AS (SELECT * FROM ic WHERE target = 'target')"
SIGNAL = [
    "sg1 AS (SELECT era, era_num, avg(ic) AS mean_ic, stddev_samp(ic) AS ic_std, count(*)::BIGINT AS n_features, max(abs(ic)) AS max_abs_ic, bool_or(degenerate) AS degenerate FROM icm GROUP BY era, era_num)",
    "sg2 AS (SELECT *, CASE WHEN NOT degenerate THEN 100.0 * (row_number() OVER (PARTITION BY degenerate ORDER BY mean_ic, era_num) - 1) / nullif(count(*) OVER (PARTITION BY degenerate) - 1, 0) END AS pct_rank FROM sg1)",
    "sg AS (SELECT *, CASE WHEN degenerate THEN 'unlabeled' WHEN pct_rank <= 25 THEN 'low' WHEN pct_rank >= 75 THEN 'high' ELSE 'normal' END AS regime, "
    "coalesce(pct_rank <= 10, false) AS crash, coalesce(pct_rank >= 90, false) AS hot FROM sg2)",
]


def main_ic(spark, sf):
    return ic_table(spark, sf).where("target = 'target'")


@register("regime_signal",
          q.query([*ic_ctes(), IC_MAIN, *SIGNAL], q.rounded("sg", ["era", "era_num::BIGINT AS era_num", "n_features", "degenerate", "regime", "crash", "hot"],
                                                            ["mean_ic", "ic_std", "max_abs_ic", "pct_rank"])))
def regime_signal(spark, sf):
    return tidy(analysis.era_signal(main_ic(spark, sf)))


@register("regime_thresholds",
          q.query([*ic_ctes(), IC_MAIN, *SIGNAL, "o AS (SELECT quantile_cont(mean_ic, 0.25) AS q1, quantile_cont(mean_ic, 0.75) AS q3, "
                   "quantile_cont(mean_ic, 0.1) AS mean_ic_low, quantile_cont(mean_ic, 0.9) AS mean_ic_high FROM sg WHERE NOT degenerate)"],
                  q.rounded("o", [], ["q1", "q3", "mean_ic_low", "mean_ic_high"])))
def regime_thresholds(spark, sf):
    return tidy(analysis.regime_thresholds(analysis.era_signal(main_ic(spark, sf))))


@register("ic_persistence",
          q.query([*ic_ctes(), IC_MAIN,
                   "lv AS (SELECT era_num, row_number() OVER (ORDER BY era_num) AS i FROM icm GROUP BY era_num HAVING max(abs(ic)) > 0)",
                   "ir AS (SELECT i, feature, round(ic, 12) AS ic FROM icm JOIN lv USING (era_num))", f"rk AS (SELECT i, feature, {q.avg_rank('ic', 'i')} AS r FROM ir)",
                   "c AS (SELECT x.i, CASE WHEN min(x.r) < max(x.r) AND min(y.r) < max(y.r) THEN covar_pop(x.r, y.r) / (stddev_pop(x.r) * stddev_pop(y.r)) END AS c FROM rk x JOIN rk y ON x.feature = y.feature AND x.i = y.i + 1 GROUP BY x.i)",
                   "o AS (SELECT coalesce(avg(c), 0) AS mean, coalesce(stddev_pop(c), 0) AS std, count(c)::BIGINT AS n_adjacent FROM c)"],
                  q.rounded("o", ["n_adjacent"], ["mean", "std"])))
def ic_persistence(spark, sf):
    return tidy(analysis.ic_persistence(main_ic(spark, sf)))


@register("ic_rolling_volatility",
          q.query([*ic_ctes(), IC_MAIN, *SIGNAL, "s AS (SELECT era, era_num, CASE WHEN NOT degenerate THEN mean_ic END AS v FROM sg)",
                   "o AS (SELECT era, era_num::BIGINT AS era_num, CASE WHEN count(v) OVER w >= 2 THEN stddev_samp(v) OVER w END AS rolling_std FROM s WINDOW w AS (ORDER BY era_num ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"],
                  q.rounded("o", ["era", "era_num"], ["rolling_std"])))
def ic_rolling_volatility(spark, sf):
    return tidy(analysis.ic_rolling_volatility(analysis.era_signal(main_ic(spark, sf))))


BENCH = ["bb AS (SELECT * FROM panel WHERE bench_a20 IS NOT NULL AND bench_b60 IS NOT NULL AND isfinite(target))",
         f"bl AS ({_union(BENCHMARKS, 'benchmark', 'b', 'bb', 'era, era_num, target AS t')})",
         f"be AS (SELECT benchmark, era, era_num, {q.corr('b', 't')} AS corr FROM bl GROUP BY benchmark, era, era_num HAVING count(*) >= 2 AND min(t) < max(t))"]


@register("benchmark_era_corr", q.query(BENCH, q.rounded("be", ["benchmark", "era", "era_num::BIGINT AS era_num"], ["corr"])))
def benchmark_era_corr(spark, sf):
    return tidy(analysis.benchmark_era_corr(customer_month(spark, sf), BENCHMARKS, "target"))


@register("benchmark_summary",
          q.query([*BENCH, "o AS (SELECT benchmark, avg(corr) AS mean_corr, stddev_samp(corr) AS corr_std, count(*)::BIGINT AS n_eras, "
                   "min_by(era, era_num) AS first_era, max_by(era, era_num) AS last_era FROM be GROUP BY benchmark)"],
                  q.rounded("o", ["benchmark", "n_eras", "first_era", "last_era"], ["mean_corr", "corr_std"])))
def benchmark_summary(spark, sf):
    return tidy(analysis.benchmark_summary(analysis.benchmark_era_corr(customer_month(spark, sf), BENCHMARKS, "target")))


@register("derived_feature_sets",
          q.query([*ic_ctes(), *full_screen_ctes("NOT degenerate AND era_num <= 48"), *drift_ctes(FEATURES),
                   "u AS (SELECT DISTINCT feature FROM fs WHERE stable OR nonlinear)"],
                  "SELECT DISTINCT 'stable' AS feature_set, feature FROM fs WHERE stable UNION ALL SELECT DISTINCT 'nonlinear', feature FROM fs WHERE nonlinear "
                  "UNION ALL SELECT 'stable_or_nonlinear', feature FROM u UNION ALL "
                  "SELECT 'stable_or_nonlinear_undrifted', feature FROM u WHERE feature NOT IN (SELECT feature FROM drf WHERE drifted)"))
def derived_feature_sets(spark, sf):
    train = ic_table(spark, sf).where(F.col("era_num") <= TRAIN_LAST_ERA)
    screen = analysis.full_screen(train, n_boot=N_BOOT, seed=0)
    profile = drift.drift_profile(customer_month(spark, sf), FEATURES, F.col("era_num") <= TRAIN_LAST_ERA)
    return analysis.derived_sets(screen, profile)


EXPO = [f"xl AS ({_union(FEATURES, 'feature', 'v', 'panel', 'era, pred_a AS p')})",
        f"xe AS (SELECT era, feature, {q.corr('p', 'v')} AS x FROM xl GROUP BY era, feature)",
        "xf AS (SELECT feature, avg(abs(x)) AS mean_abs_exposure, max(abs(x)) AS max_abs_exposure FROM xe GROUP BY feature)"]


@register("feature_exposure", q.query(EXPO, q.rounded("xf", ["feature"], ["mean_abs_exposure", "max_abs_exposure"])))
def feature_exposure(spark, sf):
    return tidy(analysis.feature_exposure(customer_month(spark, sf), "pred_a", FEATURES))


@register("riskiest_features",
          q.query([*ic_ctes(), *screen_ctes(), "o AS (SELECT feature, cross_regime_variance FROM scr WHERE target = 'target' ORDER BY cross_regime_variance DESC NULLS LAST, feature LIMIT 3)"],
                  q.rounded("o", ["feature"], ["cross_regime_variance"], 9)))
def riskiest_features(spark, sf):
    return tidy(analysis.riskiest_features(analysis.stability_screen(main_ic(spark, sf)), 3), 9)


@register("feature_metrics",
          q.query([*ic_ctes(), "v AS (SELECT *, row_number() OVER (PARTITION BY target, feature ORDER BY era_num) - 1 AS i, floor(count(*) OVER (PARTITION BY target, feature) / 2.0) AS half, "
                   "sum(ic) OVER (PARTITION BY target, feature ORDER BY era_num) AS cum FROM ic WHERE NOT degenerate)",
                   "p AS (SELECT *, max(cum) OVER (PARTITION BY target, feature ORDER BY era_num) - cum AS dd FROM v)",
                   "o AS (SELECT target, feature, avg(ic) AS mean, stddev_pop(ic) AS std, avg(ic) / stddev_pop(ic) AS sharpe, max(dd) AS max_drawdown, "
                   "avg(ic) FILTER (WHERE i >= half) - avg(ic) FILTER (WHERE i < half) AS half_delta FROM p GROUP BY target, feature)"],
                  q.rounded("o", ["target", "feature"], ["mean", "std", "sharpe", "max_drawdown", "half_delta"])))
def feature_metrics(spark, sf):
    return tidy(analysis.feature_metrics(ic_table(spark, sf)))


@register("nulls_per_era", q.query([], "SELECT era, " + ", ".join(f"count(*) FILTER (WHERE {t} IS NULL)::BIGINT AS {t}" for t in TARGETS) + " FROM panel GROUP BY era"))
def nulls_per_era(spark, sf):
    return analysis.nulls_per_era(customer_month(spark, sf), TARGETS)


@register("exposed_volatile_features",
          q.query([*ic_ctes(), *EXPO, "vo AS (SELECT feature, stddev_pop(ic) AS vol FROM ic WHERE target = 'target' AND NOT degenerate GROUP BY feature)",
                   "o AS (SELECT feature, mean_abs_exposure * vol AS risk FROM xf JOIN vo USING (feature) ORDER BY risk DESC, feature LIMIT 3)"],
                  q.rounded("o", ["feature"], ["risk"])))
def exposed_volatile_features(spark, sf):
    return tidy(analysis.exposed_volatile_features(customer_month(spark, sf), main_ic(spark, sf), "pred_a", FEATURES, 3))


@register("neutralized_ic_profile")
def neutralized_ic_profile(spark, sf):
    from eraflow.operators.neutralize import neutralized_ic_profile as profile

    return tidy(profile(customer_month(spark, sf), ["pred_a", "pred_b"], FEATURES, "target"))


def nic_ctes(ps) -> list[str]:
    from eraflow.catalog.scoring_queries import _two_feature_residual

    parts = ", ".join(str(p) for p in ps)
    return ["nsrc AS (SELECT * FROM panel)", _two_feature_residual("pred_b"),
            f"np AS (SELECT era, proportion, p - proportion * (p - res) AS x, t FROM nr, (SELECT unnest([{parts}])::DOUBLE AS proportion))",
            f"ni AS (SELECT 'pred_b' AS signal, era, proportion, {q.corr('x', 't')} AS ic FROM np GROUP BY era, proportion HAVING min(t) < max(t))"]


@register("neutralized_ic_two_features",
          q.query([*nic_ctes([0.0, 0.5]), "o AS (SELECT signal, proportion, avg(ic) AS mean_ic, stddev_pop(ic) AS corr_std, count(*)::BIGINT AS n_eras FROM ni GROUP BY signal, proportion)"],
                  q.rounded("o", ["signal", "n_eras"], ["proportion", "mean_ic", "corr_std"])))
def neutralized_ic_two_features(spark, sf):
    from eraflow.operators.neutralize import neutralized_ic_profile as profile

    return tidy(profile(customer_month(spark, sf), ["pred_b"], ["f_qty", "f_tax"], "target", (0.0, 0.5)))


@register("neutralized_ic_series", q.query(nic_ctes([0.5]), q.rounded("ni", ["signal", "era"], ["proportion", "ic"])))
def neutralized_ic_series(spark, sf):
    from eraflow.operators.neutralize import neutralized_ic

    return tidy(neutralized_ic(customer_month(spark, sf), ["pred_b"], ["f_qty", "f_tax"], "target", [0.5]))


@register("neutralization_frontier",
          q.query([*nic_ctes([0.0, 0.5])[:3], "nx AS (SELECT proportion, era, round(x, 12) AS x, t FROM np)", q.corr_scores("s", "nx", "x", "t", "proportion, era"),
                   "cu AS (SELECT *, sum(value) OVER w AS cum FROM s WINDOW w AS (PARTITION BY proportion ORDER BY era ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
                   "dd AS (SELECT *, max(cum) OVER (PARTITION BY proportion ORDER BY era ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - cum AS d FROM cu)",
                   "o AS (SELECT proportion, avg(value) AS mean, stddev_pop(value) AS std, avg(value) / stddev_pop(value) AS sharpe, max(d) AS max_drawdown FROM dd GROUP BY proportion)"],
                  q.rounded("o", [], ["proportion", "mean", "std", "sharpe", "max_drawdown"])))
def neutralization_frontier(spark, sf):
    from eraflow.operators.neutralize import neutralization_frontier as frontier

    return tidy(frontier(customer_month(spark, sf), "pred_b", ["f_qty", "f_tax"], "target", (0.0, 0.5)))
