"""Robustness diagnostics, baselines and model fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from eraflow.catalog import sqltext as q
from eraflow.catalog.blend_queries import eras, unit_z, walk_sql
from eraflow.catalog.registry import register, tidy
from eraflow.catalog.rows_queries import era_labels
from eraflow.catalog.series_queries import BLOCK20, N_BOOT, S, SEED, ac_ctes, bootstrap_ctes, corr_series
from eraflow.operators import fits, folds, normal, robustness, rows
from eraflow.sources.testpanel import FEATURES, customer_month

IC_TARGETS = ["target", "target_a_60"]
WEIGHTS = {"f_lines": 0.5, "f_qty": 1.0, "f_disc": 0.25, "f_tax": 0.25, "f_prio": 0.1, "f_maxq": -0.2}
BLOCKS = {"volume": ["f_lines", "f_qty", "f_maxq"], "rates": ["f_disc", "f_tax"]}


def md5_int(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def md5_uniform(text: str) -> str:
    return f"(({md5_int(text)} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def halves(spark, sf):
    p = customer_month(spark, sf)
    return p.where("split = 'train'"), p.where("split = 'validation'")


PERTURB = ["pt AS (SELECT era, id, " + ", ".join(
    f"{f} AS c_{f}, CASE WHEN {md5_uniform(f"'5|cell|' || era || '|' || id || '|{f}'")} < 0.2 THEN greatest(least({f} + CASE WHEN {md5_int(f"'5|step|' || era || '|' || id || '|{f}'")} % 2 = 0 THEN 1 ELSE -1 END, 4), 0) ELSE {f} END AS {f}"
    for f in FEATURES) + " FROM panel)"]


@register("perturb_cells", q.query(PERTURB, "SELECT era, id, " + ", ".join(f"{f}::BIGINT AS {f}" for f in FEATURES) + " FROM pt"))
def perturb_cells(spark, sf):
    df = customer_month(spark, sf).select("era", "id", *FEATURES)
    return tidy(robustness.perturb_cells(df, FEATURES, 0.2, 5))


@register("perturb_changed_fraction",
          q.query([*PERTURB, "o AS (SELECT (" + " + ".join(f"sum(({f} <> c_{f})::INTEGER)" for f in FEATURES) + f") / (count(*) * {len(FEATURES)}.0::DOUBLE) AS effective_fraction, count(*)::BIGINT AS n_rows FROM pt)"],
                  q.rounded("o", ["n_rows"], ["effective_fraction"])))
def perturb_changed_fraction(spark, sf):
    df = customer_month(spark, sf).select("era", "id", *FEATURES)
    return tidy(robustness.changed_fraction(df, robustness.perturb_cells(df, FEATURES, 0.2, 5), FEATURES))


def _swap_sql() -> list[str]:
    ctes = ["tn AS (SELECT " + ", ".join(f"{f} AS d_{f}" for f in FEATURES) + ", row_number() OVER (ORDER BY era, id) - 1 AS donor, count(*) OVER () AS n FROM panel WHERE split = 'train')",
            "nt AS (SELECT max(n) AS n FROM tn)",
            "ev AS (SELECT *, " + ", ".join(
                f"CASE WHEN {md5_uniform(f"'5|block|' || era || '|' || id || '|{b}'")} < 0.2 THEN floor({md5_uniform(f"'5|donor|' || era || '|' || id || '|{b}'")} * n)::BIGINT END AS k_{b}"
                for b in BLOCKS) + " FROM panel, nt WHERE split = 'validation')"]
    cells = []
    for f in FEATURES:
        b = next((b for b, cols in BLOCKS.items() if f in cols), None)
        cells.append(f"coalesce({b}.d_{f}, ev.{f})::BIGINT AS {f}" if b else f"ev.{f}::BIGINT AS {f}")
    joins = " ".join(f"LEFT JOIN tn {b} ON {b}.donor = ev.k_{b}" for b in BLOCKS)
    return [*ctes, f"sw AS (SELECT era, id, {', '.join(cells)} FROM ev {joins})"]


@register("perturb_blocks", q.query(_swap_sql(), "SELECT * FROM sw"))
def perturb_blocks(spark, sf):
    train, val = halves(spark, sf)
    return tidy(robustness.swap_blocks(val.select("era", "id", *FEATURES), train, BLOCKS, 0.2, 5))


@register("perturbation_stability")
def perturbation_stability(spark, sf):
    train, val = halves(spark, sf)
    return tidy(robustness.adversarial_perturbation(val, train, robustness.linear_score(WEIGHTS), FEATURES, BLOCKS, 0.2, 5))


@register("perturbation_stability_matrix")
def perturbation_stability_matrix(spark, sf):
    train, val = halves(spark, sf)
    scorer = robustness.matrix_score(lambda x: x @ [WEIGHTS[f] for f in FEATURES], FEATURES)
    return tidy(robustness.adversarial_perturbation(val, train, scorer, FEATURES, BLOCKS, 0.2, 5))


def _horizon_sql() -> list[str]:
    ok = "target_a_60 IS NOT NULL AND bench_a20 IS NOT NULL"
    out = [f"hs AS (SELECT era FROM panel GROUP BY era HAVING count(*) FILTER (WHERE {ok}) >= 2)"]
    cells = []
    for side, p in (("model", "pred_b"), ("bench", "bench_a20")):
        for h, t, floor in (("20", "target_a_20", 4), ("60", "target_a_60", 12)):
            n = f"{side}{h}"
            out += [q.corr_scores(f"c{n}", "panel", p, t), f"v{n} AS (SELECT 'x' AS g, era::INTEGER AS era_num, value FROM c{n} SEMI JOIN hs USING (era))",
                    *ac_ctes(f"v{n}", "g", floor, f"a{n}")]
            cells.append(f"(SELECT ac_sharpe FROM a{n}) AS {'model' if side == 'model' else 'bench'}_sharpe_{h}")
    out.append(f"hz AS (SELECT (SELECT n FROM amodel20) AS n_eras, {', '.join(cells)})")
    out.append("ho AS (SELECT *, model_sharpe_20 - model_sharpe_60 AS model_decay, bench_sharpe_20 - bench_sharpe_60 AS benchmark_decay, "
               "model_sharpe_20 - model_sharpe_60 - (bench_sharpe_20 - bench_sharpe_60) AS relative_divergence FROM hz)")
    return out


@register("horizon_stability", q.query(_horizon_sql(), q.rounded("ho", ["n_eras"], ["model_sharpe_20", "model_sharpe_60", "bench_sharpe_20", "bench_sharpe_60", "model_decay", "benchmark_decay", "relative_divergence"])))
def horizon_stability(spark, sf):
    return tidy(robustness.horizon_stability(customer_month(spark, sf), "pred_b", "bench_a20", "target_a_20", "target_a_60"))


@register("regime_corr",
          q.query([*S, "lab AS (SELECT era, CASE WHEN avg(f_qty) > 1.9 THEN 'busy' ELSE 'calm' END AS regime FROM panel GROUP BY era)",
                   "rs AS (SELECT model_id, regime, era_num, value FROM ser JOIN lab USING (era))", *bootstrap_ctes("rs", "model_id, regime", BLOCK20),
                   "o AS (SELECT model_id, regime, n::BIGINT AS n_eras, point AS mean_corr, ci_low, ci_high FROM bo)"],
                  q.rounded("o", ["model_id", "regime", "n_eras"], ["mean_corr", "ci_low", "ci_high"])))
def regime_corr(spark, sf):
    return tidy(robustness.regime_corr(corr_series(spark, sf), era_labels(spark, sf), ["model_id"], min_eras=None, n_boot=N_BOOT, seed=SEED))


NULLS = [f"nu AS (SELECT DISTINCT era, id FROM panel)", f"ng AS (SELECT era, id, {md5_uniform("'3|' || era || '|' || id")} AS u FROM nu)"]


@register("null_predictions",
          q.query([*NULLS, f"gz AS (SELECT era, id, u, {q.ppf('u')} AS z FROM ng)",
                   "o AS (SELECT 'constant' AS kind, era, id, 0.5::DOUBLE AS prediction FROM nu UNION ALL SELECT 'uniform', era, id, u FROM ng UNION ALL "
                   "SELECT 'gaussian', era, id, greatest(least(0.5 + 0.15 * z, 1.0), 0.0) FROM gz UNION ALL "
                   "SELECT 'feature_mean', era, id, (f_lines + f_qty + f_disc + f_tax + f_prio + f_maxq) / 6.0::DOUBLE FROM panel)"],
                  q.rounded("o", ["kind", "era", "id"], ["prediction"])))
def null_predictions(spark, sf):
    p = customer_month(spark, sf)
    out = None
    for kind in ("constant", "uniform", "gaussian", "feature_mean"):
        part = fits.null_predictions(p, kind, 3, p, FEATURES).select(F.lit(kind).alias("kind"), "era", "id", "prediction")
        out = part if out is None else out.unionByName(part)
    return tidy(out)


@register("lagged_target_predictions",
          q.query(["m AS (SELECT avg(target) AS prediction FROM panel WHERE era_num BETWEEN 44 AND 48)", "o AS (SELECT era, id, prediction FROM panel, m WHERE split = 'validation')"],
                  q.rounded("o", ["era", "id"], ["prediction"])))
def lagged_target_predictions(spark, sf):
    train, val = halves(spark, sf)
    return tidy(fits.lagged_target_predictions(train, val, "target", 5))


@register("ridge_coefficients",
          q.query(["t AS (SELECT f_qty::DOUBLE AS a, f_prio::DOUBLE AS b, target AS y FROM panel WHERE split = 'train')",
                   "s AS (SELECT count(*) AS n, var_pop(a) * count(*) + 50 AS aa, var_pop(b) * count(*) + 50 AS bb, covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS yb, "
                   "avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM t)",
                   "w AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS wa, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM s)",
                   "o AS (SELECT n::BIGINT AS n_rows, wa, wb, my - wa * ma - wb * mb AS intercept FROM w)"], q.rounded("o", ["n_rows"], ["wa", "wb", "intercept"])))
def ridge_coefficients(spark, sf):
    train, _ = halves(spark, sf)
    model = fits.ridge(train, ["f_qty", "f_prio"], "target", 50.0)
    wa, wb = (float(v) for v in model.coefficients)
    return tidy(train.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(wa).alias("wa"), F.lit(wb).alias("wb"), F.lit(float(model.intercept)).alias("intercept")))


@register("ridge_predictions")
def ridge_predictions(spark, sf):
    train, val = halves(spark, sf)
    return tidy(fits.ridge_predictions(train, val, FEATURES, IC_TARGETS, 16), 4)


def ridge_sql(name: str, source: str, alpha: float, by: str = "1") -> list[str]:
    """CTE ``name`` (g, wa, wb, icpt): ridges of y on a and b with a free intercept, one
    for each ``by`` of ``source`` (a, b, y)."""
    return [
        f"{name}_s AS (SELECT {by} AS g, var_pop(a) * count(*) + {alpha} AS aa, var_pop(b) * count(*) + {alpha} AS bb, covar_pop(a, b) * count(*) AS ab, "
        f"covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS yb, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM {source} GROUP BY {by})",
        f"{name}_w AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS wa, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM {name}_s)",
        f"{name} AS (SELECT g, wa, wb, my - wa * ma - wb * mb AS icpt FROM {name}_w)",
    ]


TWO = ["f_qty", "f_prio"]


@register("ridge_predictions_two_features",
          q.query(["st AS (SELECT avg(f_qty) AS ma, stddev_pop(f_qty) AS sa, avg(f_prio) AS mb, stddev_pop(f_prio) AS sb FROM panel WHERE era_num <= 40)",
                   "sc AS (SELECT era, id, era_num, split, target AS y, (f_qty - ma) / sa AS a, (f_prio - mb) / sb AS b FROM panel, st)",
                   "tr AS (SELECT * FROM sc WHERE era_num <= 40)", *ridge_sql("w", "tr", 1.0),
                   "pr AS (SELECT era, id, wa * a + wb * b + icpt AS p FROM sc, w WHERE split = 'validation')", *unit_z("nz", "pr", ["p"]),
                   "bs AS (SELECT era, id, round(0.0::DOUBLE + 1.0::DOUBLE * p, 12) AS s FROM nz)",
                   f"bu AS (SELECT era, id, ({q.avg_rank('s', 'era')} - 0.5) / count(*) OVER (PARTITION BY era) AS u FROM bs)",
                   f"bz AS (SELECT era, id, {q.ppf('u')} AS prediction FROM bu)", *unit_z("o", "bz", ["prediction"])],
                  q.rounded("o", ["era", "id"], ["prediction"])))
def ridge_predictions_two_features(spark, sf):
    train, val = halves(spark, sf)
    return tidy(fits.ridge_predictions(train, val, TWO, ["target"], 8))


def fold_ridge_sql(n_folds: int) -> str:
    ctes = [*walk_sql(n_folds, 8), "fr AS (SELECT wr.fold, wr.role, p.era, p.id, f_qty::DOUBLE AS a, f_prio::DOUBLE AS b, target AS y FROM panel p JOIN wr ON wr.era = p.era)",
            "ft AS (SELECT * FROM fr WHERE role = 'train')", *ridge_sql("w", "ft", 1.0, "fold"),
            "o AS (SELECT era, id, fold, wa * a + wb * b + icpt AS prediction FROM fr JOIN w ON w.g = fr.fold WHERE role = 'val')"]
    return q.query(ctes, q.rounded("o", ["era", "id", "fold"], ["prediction"]))


@register("out_of_fold_two_features", fold_ridge_sql(3))
def out_of_fold_two_features(spark, sf):
    table = folds.walk_forward(eras(spark, sf), 3, 8)
    out = fits.ridge_out_of_fold(customer_month(spark, sf), table, TWO, ["target"])
    return tidy(out.withColumnRenamed("target", "prediction"))


@register("anchor_fit_two_features", fold_ridge_sql(1))
def anchor_fit_two_features(spark, sf):
    table = folds.anchor(eras(spark, sf), 8)
    out = fits.ridge_out_of_fold(customer_month(spark, sf), table, TWO, ["target"])
    return tidy(out.withColumnRenamed("target", "prediction"))


@register("targets_out_of_fold",
          q.query([*walk_sql(2, 16), "fr AS (SELECT wr.fold, wr.role, p.era, p.id, f_qty::DOUBLE AS a, f_prio::DOUBLE AS b, target, target_a_60 FROM panel p JOIN wr ON wr.era = p.era)",
                   "f1 AS (SELECT *, target AS y FROM fr WHERE role = 'train')", *ridge_sql("w1", "f1", 1.0, "fold"),
                   "f2 AS (SELECT *, target_a_60 AS y FROM fr WHERE role = 'train')", *ridge_sql("w2", "f2", 1.0, "fold"),
                   "o AS (SELECT era, id, fold, w1.wa * a + w1.wb * b + w1.icpt AS target, w2.wa * a + w2.wb * b + w2.icpt AS target_a_60 FROM fr JOIN w1 ON w1.g = fold JOIN w2 ON w2.g = fold WHERE role = 'val')"],
                  q.rounded("o", ["era", "id", "fold"], IC_TARGETS)))
def targets_out_of_fold(spark, sf):
    table = folds.walk_forward(eras(spark, sf), 2, 16)
    return tidy(fits.ridge_out_of_fold(customer_month(spark, sf), table, TWO, IC_TARGETS))


@register("deploy_two_features",
          q.query(["tr AS (SELECT f_qty::DOUBLE AS a, f_prio::DOUBLE AS b, target, target_a_20 FROM panel WHERE era_num <= 40)", "t1 AS (SELECT *, target AS y FROM tr)", *ridge_sql("w1", "t1", 1.0),
                   "t2 AS (SELECT *, target_a_20 AS y FROM tr)", *ridge_sql("w2", "t2", 1.0),
                   "pr AS (SELECT era, id, w1.wa * f_qty + w1.wb * f_prio + w1.icpt AS m1, w2.wa * f_qty + w2.wb * f_prio + w2.icpt AS m2 FROM panel, w1, w2 WHERE split = 'validation')", *unit_z("nz", "pr", ["m1", "m2"]),
                   "bs AS (SELECT era, id, round(0.0::DOUBLE + 0.6::DOUBLE * m1 + 0.4::DOUBLE * m2, 12) AS s FROM nz)",
                   f"bu AS (SELECT era, id, ({q.avg_rank('s', 'era')} - 0.5) / count(*) OVER (PARTITION BY era) AS u FROM bs)",
                   f"bz AS (SELECT era, id, round({q.ppf('u')}, 12) AS v FROM bu)",
                   f"o AS (SELECT era, id, ({q.avg_rank('v', 'era')} - 0.5) / count(*) OVER (PARTITION BY era) AS prediction FROM bz)"],
                  q.rounded("o", ["era", "id"], ["prediction"])))
def deploy_two_features(spark, sf):
    train, val = halves(spark, sf)
    known = fits.purged(train, val, ["target", "target_a_20"], 8)
    models = {"m1": fits.ridge(known, TWO, "target", 1.0), "m2": fits.ridge(known, TWO, "target_a_20", 1.0)}
    return tidy(fits.deploy_pipeline(val, models, TWO, [0.6, 0.4]))


@register("tree_predictions")
def tree_predictions(spark, sf):
    train, val = halves(spark, sf)
    return tidy(fits.tree_predictions(train, val, FEATURES, ["target"], 8, maxIter=5), 4)


@register("canonical_predictions")
def canonical_predictions(spark, sf):
    train, val = halves(spark, sf)
    return tidy(fits.tree_predictions(train, val, FEATURES, IC_TARGETS, 16, neutralize_features=["f_qty", "f_tax"], proportion=0.5, maxIter=5), 4)


@register("fleet_tree_predictions")
def fleet_tree_predictions(spark, sf):
    train, val = halves(spark, sf)
    return tidy(fits.riskiest_neutralized_predictions(train, val, FEATURES, ["target"], "target", 2, 0.5, 8, maxIter=5), 4)


@register("weighted_tree_predictions")
def weighted_tree_predictions(spark, sf):
    train, val = halves(spark, sf)
    return tidy(fits.tree_predictions(train, val, FEATURES, ["target", "target_a_20"], 8, weights=[0.7, 0.3], holdout_share=0.15, maxIter=8), 4)


@register("ridge_stack")
def ridge_stack(spark, sf):
    train, val = halves(spark, sf)
    out = fits.ridge_stack(train, val, FEATURES, ["target", "target_a_20"], "target", 0.25, 8, fill=0.5, neutralize_features=["f_qty"], proportion=0.5)
    return tidy(out, 4)


@register("ridge_stack_search")
def ridge_stack_search(spark, sf):
    train, val = halves(spark, sf)
    out = fits.ridge_stack_search(
        train, val, FEATURES, ["target", "target_a_20"], "target", "bench_b60", 0.25, 8, top=2, alphas=(1.0, 100.0), hints=["target_a_20"], meta_penalties=(1.0, 10.0),
        meta_trees={"maxIter": 3, "maxDepth": 2},
    )
    return tidy(out, 4)


@register("stack_penalty_search",
          q.query(["pe AS (SELECT era, row_number() OVER (ORDER BY era_num) AS pos FROM (SELECT DISTINCT era, era_num FROM panel WHERE era_num <= 40))",
                   "al AS (SELECT * FROM (VALUES (1.0::DOUBLE), (900.0::DOUBLE)) v(alpha))",
                   "se AS (SELECT alpha, f_qty::DOUBLE AS a, f_prio::DOUBLE AS b, target, target_a_20 FROM panel JOIN pe USING (era), al WHERE pe.pos <= (SELECT max(pos) FROM pe) - 18)",
                   "se1 AS (SELECT alpha, a, b, target AS y FROM se)", "se2 AS (SELECT alpha, a, b, target_a_20 AS y FROM se)", *ridge_sql("w1", "se1", "alpha", "alpha"), *ridge_sql("w2", "se2", "alpha", "alpha"),
                   "ws AS (SELECT 'target' AS target, * FROM w1 UNION ALL SELECT 'target_a_20', * FROM w2)",
                   "sp AS (SELECT ws.target, g AS alpha, era, id, panel.target AS y, wa * f_qty + wb * f_prio + icpt AS p FROM panel, ws WHERE era IN (SELECT era FROM pe WHERE pos > (SELECT max(pos) FROM pe) - 10))",
                   *unit_z("sz", "sp", ["p"], "target, alpha, era", "target, alpha, era, id, y"),
                   "co AS (SELECT target, alpha, era, covar_pop(p, y) / (stddev_pop(p) * stddev_pop(y)) AS v FROM sz GROUP BY ALL HAVING stddev_pop(p) > 0 AND stddev_pop(y) > 0)",
                   "o AS (SELECT target, alpha, avg(v) / (stddev_pop(v) + 1e-12) AS era_sharpe, count(*) AS n_eras FROM co GROUP BY ALL)"], q.rounded("o", ["target", "n_eras"], ["alpha", "era_sharpe"], 5)))
def stack_penalty_search(spark, sf):
    train, val = halves(spark, sf)
    pair, alphas = ["target", "target_a_20"], [1.0, 900.0]
    early, tail = fits.stack_sides(train, val, pair, 0.25, 8)
    found = normal.ridge_fits(normal.era_moments(early, TWO, pair), pair, alphas)
    return tidy(fits.penalty_search(tail, found, TWO, [(t, a) for t in pair for a in alphas], "target"), 5)


def stack_sql() -> list[str]:
    """CTEs up to ``sz`` (era, id, y, split, a, b): the ranked predictions of two
    specialists, on the meta model's eras and on the validation eras."""
    early, tail = "pe.pos <= (SELECT max(pos) FROM pe) - 18", "pe.pos > (SELECT max(pos) FROM pe) - 10"
    return [
        "pe AS (SELECT era, row_number() OVER (ORDER BY era_num) AS pos FROM (SELECT DISTINCT era, era_num FROM panel WHERE era_num <= 40))",
        f"se AS (SELECT f_qty::DOUBLE AS a, f_prio::DOUBLE AS b, target AS y, target_a_20 AS y2 FROM panel JOIN pe USING (era) WHERE {early})",
        "se1 AS (SELECT a, b, y FROM se)", "se2 AS (SELECT a, b, y2 AS y FROM se)", *ridge_sql("w1", "se1", 1.0), *ridge_sql("w2", "se2", 1.0),
        f"sp AS (SELECT era, id, target AS y, split, w1.wa * f_qty + w1.wb * f_prio + w1.icpt AS a, w2.wa * f_qty + w2.wb * f_prio + w2.icpt AS b FROM panel, w1, w2 "
        f"WHERE split = 'validation' OR era IN (SELECT era FROM pe WHERE {tail}))",
        *unit_z("sz", "sp", ["a", "b"], keep="era, id, y, split"),
    ]


@register("ridge_stack_two_features",
          q.query([*stack_sql(), "st AS (SELECT * FROM sz WHERE split = 'train')", *ridge_sql("wm", "st", 1.0),
                   "pr AS (SELECT era, id, wa * a + wb * b + icpt AS p FROM sz, wm WHERE split = 'validation')", *unit_z("nz", "pr", ["p"]),
                   "bs AS (SELECT era, id, round(p, 12) AS s FROM nz)",
                   f"bu AS (SELECT era, id, ({q.avg_rank('s', 'era')} - 0.5) / count(*) OVER (PARTITION BY era) AS u FROM bs)",
                   f"bz AS (SELECT era, id, {q.ppf('u')} AS prediction FROM bu)", *unit_z("o", "bz", ["prediction"])],
                  q.rounded("o", ["era", "id"], ["prediction"])))
def ridge_stack_two_features(spark, sf):
    train, val = halves(spark, sf)
    return tidy(fits.ridge_stack(train, val, TWO, ["target", "target_a_20"], "target", 0.25, 8))


@register("target_quality",
          q.query([" , ".join(["l AS (" + " UNION ALL ".join(f"SELECT '{t}' AS target, {t} AS v, target AS m FROM panel WHERE split = 'train'" for t in ("target_a_20", "target_a_60", "target_b_20")) + ")"]),
                   "f AS (SELECT target, v IS NOT NULL AS has, CASE WHEN isfinite(v) THEN v END AS x, CASE WHEN isfinite(v) THEN m END AS y FROM l)",
                   f"o AS (SELECT target, count(*) FILTER (WHERE has) / count(*)::DOUBLE AS coverage, {q.corr('x', 'y')} AS corr FROM f GROUP BY target)",
                   "k AS (SELECT * FROM o WHERE coverage >= 0.5 AND abs(corr) >= 0.1 ORDER BY corr DESC LIMIT 2)"], q.rounded("k", ["target"], ["coverage", "corr"])))
def target_quality(spark, sf):
    train, _ = halves(spark, sf)
    quality = fits.target_quality(train, "target", ["target_a_20", "target_a_60", "target_b_20"])
    return tidy(fits.select_targets(quality, 0.5, 0.1, 2).select("target", "coverage", "corr"))


@register("out_of_fold")
def out_of_fold(spark, sf):
    p = customer_month(spark, sf)
    table = folds.walk_forward(eras(spark, sf), 3, 8)
    return tidy(fits.ridge_out_of_fold(p, table, FEATURES, ["target"]).withColumnRenamed("target", "prediction"), 5)


@register("anchor_fit")
def anchor_fit(spark, sf):
    p = customer_month(spark, sf)
    table = folds.anchor(eras(spark, sf), 8)
    return tidy(fits.out_of_fold(p, table, lambda t: fits.ridge(t, FEATURES, "target", 1.0), FEATURES), 5)


@register("deploy_pipeline")
def deploy_pipeline(spark, sf):
    train, val = halves(spark, sf)
    known = fits.purged(train, val, IC_TARGETS, 16)
    models = {"m1": fits.ridge(known, FEATURES, "target", 1.0), "m2": fits.ridge(known, FEATURES, "target_a_60", 1.0)}
    return tidy(fits.deploy_pipeline(val, models, FEATURES, [0.6, 0.4], ["f_qty"], 0.5), 5)


@register("submission",
          q.query([f"l AS (SELECT id, pred_a AS v, 1 AS g FROM panel WHERE era_num = (SELECT max(era_num) FROM panel))", f"o AS (SELECT id, ({q.avg_rank('v', 'g')} - 0.5) / count(*) OVER () AS prediction FROM l)"],
                  q.rounded("o", ["id"], ["prediction"])))
def submission(spark, sf):
    p = customer_month(spark, sf)
    live = p.where(F.col("era_num") == p.agg(F.max("era_num")).scalar()).select("id", F.col("pred_a").alias("prediction"))
    return tidy(fits.submission(live))


@register("prediction_contract",
          q.query([], "SELECT count(*)::BIGINT AS n_rows, (SELECT count(*) FROM (SELECT id FROM panel GROUP BY id HAVING count(*) > 1))::BIGINT AS n_repeated_ids, "
                  "bool_and(isfinite(pred_c)) AS all_finite, bool_and(pred_c > 0 AND pred_c < 1) AS all_inside FROM panel"))
def prediction_contract(spark, sf):
    return rows.checked_ids(customer_month(spark, sf).select("id", F.col("pred_c").alias("prediction")))


@register("parameter_sweep")
def parameter_sweep(spark, sf):
    train, val = halves(spark, sf)
    return tidy(fits.parameter_sweep(train, val, FEATURES, "target", [{"alpha": a} for a in (0.1, 10.0, 1000.0)], 8), 5)


def moments_sql(name: str, source: str, by: str) -> str:
    """CTE ``name``: count, mean, deviation, ratio, skewness and kurtosis of value."""
    return (f"{name} AS (SELECT {by}, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS std, avg(value) / stddev_pop(value) AS sharpe, "
            f"skewness(value) AS skew, kurtosis(value) + 3 AS kurt FROM {source} GROUP BY {by})")


@register("parameter_sweep_two_features",
          q.query(["al AS (SELECT * FROM (VALUES (0, 0.5::DOUBLE), (1, 5000.0::DOUBLE)) v(trial_id, alpha))",
                   "tr AS (SELECT trial_id, f_qty::DOUBLE AS a, f_prio::DOUBLE AS b, target AS y FROM panel, al WHERE era_num <= 40)",
                   *[c.replace(" + 0 AS", " + alpha AS").replace("GROUP BY trial_id", "JOIN al USING (trial_id) GROUP BY trial_id, alpha") for c in ridge_sql("w", "tr", 0, "trial_id")],
                   "pp AS (SELECT trial_id, alpha, era, target, wa * f_qty + wb * f_prio + icpt AS p FROM panel, w JOIN al ON al.trial_id = w.g WHERE split = 'validation')",
                   q.corr_scores("sc", "pp", "p", "target", "trial_id, alpha, era"), moments_sql("o", "sc", "trial_id, alpha")],
                  q.rounded("o", ["trial_id::BIGINT AS trial_id", "n"], ["alpha", "mean", "std", "sharpe", "skew", "kurt"], 5)))
def parameter_sweep_two_features(spark, sf):
    train, val = halves(spark, sf)
    return tidy(fits.parameter_sweep(train, val, TWO, "target", [{"alpha": a} for a in (0.5, 5000.0)], 8), 5)


SWEEP = ({"targets": ["target", "target_a_20"], "alpha": 1.0, "method": "ridge"}, {"targets": ["target_a_20"], "alpha": 1.0, "method": "equal"})


def sweep_sql() -> str:
    n_folds, purge = 2, 8
    return q.query([
        "ae AS (SELECT era, era_num, row_number() OVER (ORDER BY era_num) AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT era, era_num FROM panel))",
        "hf AS (SELECT min(era_num) AS first FROM ae WHERE pos > n - greatest(round_even(n * 0.2, 0)::INT, 1))",
        "ie AS (SELECT era, era_num, row_number() OVER (ORDER BY era_num) - 1 AS i, count(*) OVER () AS n FROM ae, hf WHERE era_num < first - 8)",
        f"gf AS (SELECT fold, era, n // {n_folds + 1} AS size, n - {n_folds} * (n // {n_folds + 1}) + fold * (n // {n_folds + 1}) AS st, i FROM ie, range(0, {n_folds}) r(fold) "
        f"UNION ALL SELECT {n_folds}, era, n // 2, n - n // 2, i FROM ie)",
        f"gr AS (SELECT fold, era, CASE WHEN i < st - {purge} THEN 'train' WHEN i >= st AND i < st + size THEN 'val' END AS role FROM gf)",
        "fr AS (SELECT fold, role, p.era, id, f_qty::DOUBLE AS a, f_prio::DOUBLE AS b, target, target_a_20 FROM panel p JOIN gr USING (era))",
        "f1 AS (SELECT *, target AS y FROM fr WHERE role = 'train')", *ridge_sql("w1", "f1", 1.0, "fold"),
        "f2 AS (SELECT *, target_a_20 AS y FROM fr WHERE role = 'train')", *ridge_sql("w2", "f2", 1.0, "fold"),
        f"oof AS (SELECT era, id, target, w1.wa * a + w1.wb * b + w1.icpt AS p, w2.wa * a + w2.wb * b + w2.icpt AS r FROM fr JOIN w1 ON w1.g = fold JOIN w2 ON w2.g = fold WHERE role = 'val' AND fold < {n_folds})",
        *unit_z("oz", "oof", ["p", "r"], keep="era, id, target"),
        "gm AS (SELECT sum(p * p) + 1 AS pp, sum(p * r) AS pr, sum(r * r) + 1 AS rr, sum(p * target) AS py, sum(r * target) AS ry FROM oz)",
        "gw AS (SELECT (py * rr - ry * pr) / (pp * rr - pr * pr) AS u, (ry * pp - py * pr) / (pp * rr - pr * pr) AS v FROM gm)",
        f"he AS (SELECT p.era, id, target, w1.wa * f_qty + w1.wb * f_prio + w1.icpt AS p, w2.wa * f_qty + w2.wb * f_prio + w2.icpt AS r FROM panel p, hf, w1, w2 WHERE era_num >= first AND w1.g = {n_folds} AND w2.g = {n_folds})",
        *unit_z("hz", "he", ["p", "r"], keep="era, id, target"),
        "bl AS (SELECT 0 AS trial_id, era, target, round(u * p + v * r, 12) AS p FROM hz, gw UNION ALL SELECT 1, era, target, round(r, 12) FROM hz)",
        q.corr_scores("sc", "bl", "p", "target", "trial_id, era"), moments_sql("o", "sc", "trial_id"),
    ], q.rounded("o", ["trial_id::BIGINT AS trial_id", "n"], ["mean", "std", "sharpe", "skew", "kurt"], 5))


@register("configuration_sweep", sweep_sql())
def configuration_sweep(spark, sf):
    out = fits.configuration_sweep(customer_month(spark, sf), TWO, "target", SWEEP, 8, n_folds=2)
    return tidy(out.drop("params_json", "weights"), 5)
