"""Column builders shared by every operator. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Coefficients of Wichura's algorithm AS 241 (PPND16), the inverse
# normal distribution function. Highest power first.
AS241_CENTRAL_NUM = (
    2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4,
    4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3,
    1.3314166789178437745e2, 3.3871328727963666080e0,
)
AS241_CENTRAL_DEN = (
    5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4,
    2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2,
    4.2313330701600911252e1, 1.0,
)
AS241_MIDDLE_NUM = (
    7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1,
    1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0,
    4.63033784615654529590e0, 1.42343711074968357734e0,
)
AS241_MIDDLE_DEN = (
    1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2,
    1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0,
    2.05319162663775882187e0, 1.0,
)
AS241_TAIL_NUM = (
    2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3,
    2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0,
    5.46378491116411436990e0, 6.65790464350110377720e0,
)
AS241_TAIL_DEN = (
    2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5,
    7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1,
    5.99832206555887937690e-1, 1.0,
)

# Hart's rational approximation of the normal distribution function
# (double precision). Highest power first.
HART_NUM = (
    3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
HART_DEN = (
    8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)

EULER_GAMMA = 0.5772156649015329


def polynomial(coefficients: Sequence[float], x: str) -> str:
    """Horner form as SQL text (one parsed expression instead of many nested calls)."""
    text = f"{float(coefficients[0])!r}D"
    for coefficient in coefficients[1:]:
        text = f"({text} * {x} + {float(coefficient)!r}D)"
    return text


def with_norm_ppf(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add the normal quantile of each probability column (new name -> column).

    Minus/plus infinity at 0 and 1, NULL outside. The tail variable and the argument
    of the rational functions are columns of their own and never NULL: the generated
    code stays small enough for the JIT compiler, which skips very large methods.
    """
    tails, arguments, quantiles = {}, {}, {}
    for out, p in columns.items():
        tail, x = f"__tail_{out}", f"__arg_{out}"
        tails[tail] = F.expr(f"coalesce(sqrt(-ln(least({p}, 1.0D - {p}))), 0.0D)")
        arguments[x] = F.expr(
            f"coalesce(case when abs({p} - 0.5D) <= 0.425D then 0.180625D - ({p} - 0.5D) * ({p} - 0.5D) "
            f"when {tail} <= 5.0D then {tail} - 1.6D else {tail} - 5.0D end, 0.0D)"
        )
        inner = f"{polynomial(AS241_CENTRAL_NUM, x)} / {polynomial(AS241_CENTRAL_DEN, x)}"
        middle = f"{polynomial(AS241_MIDDLE_NUM, x)} / {polynomial(AS241_MIDDLE_DEN, x)}"
        outer = f"{polynomial(AS241_TAIL_NUM, x)} / {polynomial(AS241_TAIL_DEN, x)}"
        quantiles[out] = F.expr(
            f"case when {p} < 0 or {p} > 1 then cast(null as double) "
            f"when {p} = 0 then double('-Infinity') when {p} = 1 then double('Infinity') "
            f"else (case when abs({p} - 0.5D) <= 0.425D then {p} - 0.5D when {p} < 0.5D then -1.0D else 1.0D end) * "
            f"(case when abs({p} - 0.5D) <= 0.425D then {inner} when {tail} <= 5.0D then {middle} else {outer} end) end"
        )
    return (
        df.withColumns(tails).withColumns(arguments).withColumns(quantiles).drop(*tails, *arguments)
    )


def norm_cdf(x: str) -> Column:
    """Normal distribution function of a column."""
    size = f"abs({x})"
    body = f"exp(-{size} * {size} / 2.0D) * {polynomial(HART_NUM, size)} / {polynomial(HART_DEN, size)}"
    fraction = f"({size} + 0.65D)"
    for step in (4, 3, 2, 1):
        fraction = f"({size} + {step}.0D / {fraction})"
    tail = f"exp(-{size} * {size} / 2.0D) / {fraction} / 2.506628274631D"
    upper = (
        f"(case when {size} > 37 then 0.0D when {size} < 7.07106781186547D then {body} "
        f"else {tail} end)"
    )
    return F.expr(f"case when {x} > 0 then 1.0D - {upper} else {upper} end")


def _finite_sql(name: str) -> str:
    value = f"cast(`{name}` as double)"
    return f"coalesce(not isnan({value}) and abs({value}) < double('Infinity'), false)"


def is_finite(value: Column | str) -> Column:
    """Neither NULL, NaN nor infinite; never NULL itself. Takes a column name (one parsed
    expression) or any column."""
    if isinstance(value, str):
        return F.expr(_finite_sql(value))
    return F.coalesce(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.lit(False))


def all_finite(columns: Sequence[str]) -> Column:
    return F.expr(" and ".join(_finite_sql(c) for c in columns) or "true")


def none_null(columns: Sequence[str]) -> Column:
    return F.expr(" and ".join(f"`{c}` is not null" for c in columns) or "true")


def signed_power(x: Column) -> Column:
    return F.signum(x) * F.pow(F.abs(x), F.lit(1.5))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def ratio(numerator: Column, denominator: Column) -> Column:
    """NULL instead of an ANSI division error when the denominator is zero."""
    return F.when(denominator != 0.0, numerator / F.when(denominator != 0.0, denominator))


def finite_or(value: Column, default: float) -> Column:
    return F.when(is_finite(value), value).otherwise(F.lit(float(default)))


def raw_corr(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; NULL where it is undefined."""
    usable = (F.count(x) >= 2) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    spread = F.when(usable, F.stddev_pop(x) * F.stddev_pop(y))
    value = F.covar_pop(x, y) / F.when(spread > 0.0, spread)
    return F.when(is_finite(value), value)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; 0.0 where it is undefined. Rows where
    either side is NULL must be NULL on both sides."""
    return F.coalesce(raw_corr(x, y), F.lit(0.0))


def weighted_corr(x: Column, y: Column, weight: Column) -> Column:
    """Pearson correlation of rows that stand for ``weight`` equal rows; 0.0 where
    undefined. Values should be small in size (bins, ranks / n)."""
    n = F.sum(weight)
    sx, sy = F.sum(weight * x), F.sum(weight * y)
    vx = F.sum(weight * x * x) - sx * sx / n
    vy = F.sum(weight * y * y) - sy * sy / n
    cov = F.sum(weight * x * y) - sx * sy / n
    spread = F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0)))
    usable = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y)) & (spread > 0.0)
    value = cov / F.when(usable, spread)
    return finite_or(value, 0.0)


def sample_skew(x: Column) -> Column:
    """Bias-corrected skewness; 0 below three values or without spread."""
    n = F.count(x).cast("double")
    ok = (F.count(x) >= 3) & (F.min(x) < F.max(x))
    return F.when(ok, F.skewness(x) * F.sqrt(n * (n - 1.0)) / F.when(n > 2, n - 2.0)).otherwise(0.0)


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected, not excess; 3 below four values or without spread."""
    n = F.count(x).cast("double")
    ok = (F.count(x) >= 4) & (F.min(x) < F.max(x))
    value = ((n + 1.0) * F.kurtosis(x) + 6.0) * (n - 1.0) / F.when(n > 3, (n - 2.0) * (n - 3.0)) + 3.0
    return F.when(ok, value).otherwise(3.0)
