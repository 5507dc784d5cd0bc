"""SQL pieces of the reference answers: the same panels and the same arithmetic,
written for a plain SQL engine."""

from __future__ import annotations

from collections.abc import Sequence

from eraflow.functions import stats

PANEL = """
src_orders AS (
  SELECT o_orderkey, o_custkey AS cust,
         ((year(o_orderdate) - 1995) * 12 + month(o_orderdate))::INTEGER AS era_num,
         substr(o_orderpriority, 1, 1)::BIGINT AS prio,
         round(o_totalprice * 100)::BIGINT AS total_cents
  FROM orders),
src_lines AS (
  SELECT l_orderkey, l_quantity::BIGINT AS qty, round(l_discount * 100)::BIGINT AS disc,
         round(l_tax * 100)::BIGINT AS tax, round(l_extendedprice * 100)::BIGINT AS cents
  FROM lineitem),
src AS (
  SELECT era_num, cust, count(*)::BIGINT AS n_lines, sum(qty)::BIGINT AS qty, max(qty) AS maxq,
         sum(disc)::BIGINT AS disc, sum(tax)::BIGINT AS tax, max(prio) AS prio,
         max(total_cents) AS total_cents, sum(cents * (100 - disc))::BIGINT AS rev
  FROM src_lines JOIN src_orders ON l_orderkey = o_orderkey GROUP BY era_num, cust),
src_noise AS (
  SELECT *, (cust * 7919 + era_num * 104729) % 1009 AS noise,
         (cust * 104723 + era_num * 7907) % 997 AS noise2 FROM src),
panel AS (
  SELECT lpad(era_num::VARCHAR, 4, '0') AS era, era_num, cust::VARCHAR AS id,
    CASE WHEN era_num <= 48 THEN 'train' ELSE 'validation' END AS split,
    greatest(least(n_lines - 1, 4), 0)::INTEGER AS f_lines,
    greatest(least(qty // 45, 4), 0)::INTEGER AS f_qty,
    greatest(least(disc // 9, 4), 0)::INTEGER AS f_disc,
    greatest(least(tax // 7, 4), 0)::INTEGER AS f_tax,
    greatest(least(prio - 1, 4), 0)::INTEGER AS f_prio,
    greatest(least(maxq // 11, 4), 0)::INTEGER AS f_maxq,
    least(rev // 1000000000, 4) / 4.0::DOUBLE AS target,
    least(total_cents // 12000000, 4) / 4.0::DOUBLE AS target_a_20,
    least((rev // 500000000 + tax) // 8, 4) / 4.0::DOUBLE AS target_a_60,
    CASE WHEN cust % 11 = 0 THEN NULL WHEN cust % 13 = 0 THEN 'NaN'::DOUBLE
         ELSE least(rev // 1500000000, 4) / 4.0::DOUBLE END AS target_b_20,
    (30 * qty + 200 * n_lines + noise) / 10000.0::DOUBLE AS pred_a,
    (50 * maxq + 17 * disc + 3 * noise) / 10000.0::DOUBLE AS pred_b,
    noise / 1009.0::DOUBLE AS pred_c,
    (20 * qty + 60 * disc + 2 * noise2) / 10000.0::DOUBLE AS meta,
    CASE WHEN era_num > 10 THEN (10 * qty + noise2) / 1000.0::DOUBLE END AS bench_a20,
    (15 * n_lines + noise2 // 20) / 1000.0::DOUBLE AS bench_b60
  FROM src_noise)"""

MODELS = """
models AS (
  SELECT *, 'pred_a' AS model_id, pred_a AS prediction FROM panel
  UNION ALL SELECT *, 'pred_b', pred_b FROM panel
  UNION ALL SELECT *, 'pred_c', pred_c FROM panel)"""


def query(ctes: Sequence[str], final: str, panel: bool = True) -> str:
    parts = ([PANEL] if panel else []) + list(ctes)
    return ("WITH " + ",\n".join(p.strip() for p in parts) + "\n" + final) if parts else final


def rounded(table: str, keys: Sequence[str], doubles: Sequence[str], digits: int = 6, tail: str = "") -> str:
    """Final projection: keys as they are, doubles rounded (adding 0.0 drops a minus zero)."""
    cells = list(keys) + [f"round({d}, {digits}) + 0.0 AS {d}" for d in doubles]
    return f"SELECT {', '.join(cells)} FROM {table} {tail}"


def _poly(coefficients: Sequence[float], x: str) -> str:
    text = repr(float(coefficients[0])) + "::DOUBLE"
    for c in coefficients[1:]:
        text = f"({text} * {x} + {float(c)!r}::DOUBLE)"
    return text


def ppf(p: str) -> str:
    q = f"(({p}) - 0.5::DOUBLE)"
    r = f"(0.180625::DOUBLE - {q} * {q})"
    t = f"sqrt(-ln(least(({p}), 1.0::DOUBLE - ({p}))))"
    near, far = f"({t} - 1.6::DOUBLE)", f"({t} - 5.0::DOUBLE)"
    size = (
        f"(CASE WHEN {t} <= 5.0 THEN {_poly(stats.AS241_MIDDLE_NUM, near)} / {_poly(stats.AS241_MIDDLE_DEN, near)}"
        f" ELSE {_poly(stats.AS241_TAIL_NUM, far)} / {_poly(stats.AS241_TAIL_DEN, far)} END)"
    )
    return (
        f"(CASE WHEN ({p}) IS NULL OR ({p}) <= 0 OR ({p}) >= 1 THEN NULL"
        f" WHEN abs({q}) <= 0.425 THEN {q} * {_poly(stats.AS241_CENTRAL_NUM, r)} / {_poly(stats.AS241_CENTRAL_DEN, r)}"
        f" WHEN {q} < 0 THEN -{size} ELSE {size} END)"
    )


def cdf(x: str) -> str:
    a = f"abs({x})"
    e = f"exp(-({a}) * ({a}) / 2.0)"
    body = f"{e} * {_poly(stats.HART_NUM, a)} / {_poly(stats.HART_DEN, a)}"
    f1 = f"({a} + 0.65)"
    for k in (4, 3, 2, 1):
        f1 = f"({a} + {k}.0 / {f1})"
    upper = (
        f"(CASE WHEN {a} > 37 THEN 0.0 WHEN {a} < 7.07106781186547 THEN {body}"
        f" ELSE {e} / {f1} / 2.506628274631 END)"
    )
    return f"(CASE WHEN ({x}) > 0 THEN 1.0 - {upper} ELSE {upper} END)"


def finite(x: str) -> str:
    return f"({x} IS NOT NULL AND isfinite({x}))"


def avg_rank(column: str, by: str) -> str:
    """Tie-averaged rank within ``by`` (a comma list of columns)."""
    return (
        f"(rank() OVER (PARTITION BY {by} ORDER BY {column})"
        f" + (count(*) OVER (PARTITION BY {by}, {column}) - 1) / 2.0)"
    )


def power15(x: str) -> str:
    return f"(sign({x}) * pow(abs({x}), 1.5))"


def corr(x: str, y: str) -> str:
    """Aggregate: population covariance over both deviations, 0 where undefined."""
    return (
        f"(CASE WHEN count({x}) >= 2 AND min({x}) < max({x}) AND min({y}) < max({y})"
        f" THEN covar_pop({y}, {x}) / (stddev_pop({x}) * stddev_pop({y})) ELSE 0.0 END)"
    )


def corr_scores(name: str, source: str, pred: str, target: str, by: str = "era") -> str:
    """CTEs ending in ``name``(by, value): the power-transformed rank correlation."""
    return f"""
{name}_r AS (
  SELECT {by}, {pred} AS p, {target} AS t, {avg_rank(pred, by)} AS rk,
         count(*) OVER (PARTITION BY {by}) AS n, avg({target}) OVER (PARTITION BY {by}) AS tm
  FROM {source} WHERE {finite(pred)} AND {finite(target)}),
{name}_u AS (SELECT *, (rk - 0.5) / n AS u FROM {name}_r),
{name}_z AS (SELECT *, {ppf('u')} AS z FROM {name}_u),
{name}_x AS (SELECT {by}, p, t, {power15('z')} AS x, {power15('(t - tm)')} AS y FROM {name}_z),
{name}_s AS (
  SELECT {by}, CASE WHEN count(*) >= 2 AND min(p) < max(p) AND min(t) < max(t)
     THEN covar_pop(y, x) / (stddev_pop(x) * stddev_pop(y)) ELSE 0.0 END AS value
  FROM {name}_x GROUP BY {by}),
{name} AS (
  SELECT e.*, coalesce(s.value, 0.0) AS value
  FROM (SELECT DISTINCT {by} FROM {source}) e LEFT JOIN {name}_s s USING ({by}))"""


def mmc_scores(name: str, source: str, pred: str, meta: str, target: str, by: str = "era") -> str:
    return f"""
{name}_r AS (
  SELECT {by}, {pred} AS p, {meta} AS m, {target} AS t, {avg_rank(pred, by)} AS rp,
         {avg_rank(meta, by)} AS rm, count(*) OVER (PARTITION BY {by}) AS n
  FROM {source} WHERE {finite(pred)} AND {finite(meta)} AND {finite(target)}),
{name}_u AS (SELECT *, (rp - 0.5) / n AS up, (rm - 0.5) / n AS um FROM {name}_r),
{name}_z AS (SELECT *, {ppf('up')} AS zp, {ppf('um')} AS zm FROM {name}_u),
{name}_a AS (
  SELECT {by}, count(*) AS n, min(p) < max(p) AND min(m) < max(m) AND min(t) < max(t) AS ok,
    sum(zp * t) - sum(t) * sum(zp) / count(*) AS cp, sum(zm * t) - sum(t) * sum(zm) / count(*) AS cm,
    sum(zp * zm) AS pm, sum(zm * zm) AS mm, bool_and(t BETWEEN 0 AND 1) AS unit
  FROM {name}_z GROUP BY {by}),
{name} AS (
  SELECT e.*, CASE WHEN a.n >= 2 AND a.ok AND a.mm > 0
     THEN (a.cp - a.pm / a.mm * a.cm) / a.n * (CASE WHEN a.unit THEN 4.0 ELSE 1.0 END) ELSE 0.0 END AS value
  FROM (SELECT DISTINCT {by} FROM {source}) e LEFT JOIN {name}_a a USING ({by}))"""


def cwmm_scores(name: str, source: str, pred: str, meta: str, by: str = "era") -> str:
    return f"""
{name}_r AS (
  SELECT {by}, {pred} AS p, {meta} AS m, {avg_rank(pred, by)} AS rp,
         {avg_rank(meta, by)} AS rm, count(*) OVER (PARTITION BY {by}) AS n
  FROM {source} WHERE {finite(pred)} AND {finite(meta)}),
{name}_u AS (SELECT *, (rp - 0.5) / n AS up, (rm - 0.5) / n AS um FROM {name}_r),
{name}_z AS (SELECT *, {ppf('up')} AS zp, {ppf('um')} AS zm FROM {name}_u),
{name}_x AS (SELECT {by}, {power15('zp')} AS x, {power15('zm')} AS y FROM {name}_z),
{name} AS (SELECT {by}, {corr('x', 'y')} AS value FROM {name}_x GROUP BY {by})"""
