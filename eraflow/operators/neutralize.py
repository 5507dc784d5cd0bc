"""Linear neutralization of predictions against features, one fit per era.

The rows never move for the fit. Every task folds its rows into a small triangular
factor per era (the R of a QR decomposition of [features, 1, predictions]); only
these factors are shuffled, and folding factors into factors gives the factor of
the whole era, however its rows are spread. An era that holds a third of the panel
therefore costs no task more than its share of rows. All right-hand sides of an
era share one factorization.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eraflow.functions.ranks import group_shape
from eraflow.functions.stats import is_finite, safe_corr
from eraflow.session import broadcast_checked, materialize, max_group_rows

RCOND = 1e-6
FLUSH_BYTES = 256 * 2**20
FOLD_ROWS = 2048
# Factors of one group meet in steps, so that no task stacks more than a few dozen of
# them: none, one or two steps before the last, by the rows of the largest group.
WIDE_WAYS, NARROW_WAYS = 4096, 64
ONE_STEP_ROWS = 65_536


def feature_vector(features: str | Sequence[str]) -> Column:
    """An array column: either one already, or built from numeric columns."""
    if isinstance(features, str):
        return F.col(features).cast("array<double>")
    return F.array(*[F.col(c).cast("double") for c in features])


def _fold(blocks: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack(blocks), mode="r")


def factors(
    df: DataFrame, tail: Column, vector: str, by: Sequence[str], shape: tuple[int, int] | None = None
) -> DataFrame:
    """Triangular factors of [features, 1, tail] per group, folded as far as one group's
    few remaining ones: (by, way, width, design, factor, low, high). ``tail`` is an array
    of right-hand sides, of one length within a group; ``low`` and ``high`` are their
    extremes and ``design`` counts the columns before them. Rows must be complete."""
    shape = shape or group_shape(df, by)
    by = list(by)
    key_fields = [df.schema[c] for c in by]
    block_schema = T.StructType(
        [
            *key_fields,
            T.StructField("way", T.IntegerType()),
            T.StructField("width", T.IntegerType()),
            T.StructField("design", T.IntegerType()),
            T.StructField("factor", T.ArrayType(T.DoubleType())),
            T.StructField("low", T.ArrayType(T.DoubleType())),
            T.StructField("high", T.ArrayType(T.DoubleType())),
        ]
    )
    rows = df.select(
        *by,
        F.pmod(F.spark_partition_id(), F.lit(WIDE_WAYS)).alias("way"),
        (F.size(vector) + 1).alias("design"),
        F.concat(F.col(vector), F.array(F.lit(1.0)), tail).alias("row"),
    )

    def factor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = way = design = 0

        def flush(like: pa.Schema) -> pa.RecordBatch:
            found = [_fold(state[0]) for state in held.values()]
            doubles = pa.list_(pa.float64())
            columns = [
                pa.array([key[i] for key in held], like.field(c).type) for i, c in enumerate(by)
            ]
            columns += [
                pa.array([way] * len(held), pa.int32()),
                pa.array([f.shape[1] for f in found], pa.int32()),
                pa.array([design] * len(held), pa.int32()),
                pa.array([f.ravel() for f in found], doubles),
                pa.array([state[2] for state in held.values()], doubles),
                pa.array([state[3] for state in held.values()], doubles),
            ]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, [f.name for f in block_schema.fields])

        for batch in batches:
            if not batch.num_rows:
                continue
            way, design = batch.column("way")[0].as_py(), batch.column("design")[0].as_py()
            cells = batch.column("row").flatten().to_numpy(zero_copy_only=False)
            starts = batch.column("row").offsets.to_numpy()
            starts = starts - starts[0]
            if not np.isfinite(cells).all():
                raise ValueError("predictions and features must be finite")
            keys = batch.select(by).to_pandas()
            codes = keys.groupby(by, sort=False, dropna=False).ngroup().to_numpy()
            order = np.argsort(codes, kind="stable")
            cuts = np.flatnonzero(np.diff(codes[order])) + 1
            for members in np.split(order, cuts):
                width = starts[members[0] + 1] - starts[members[0]]
                block = cells[starts[members][:, None] + np.arange(width)]
                key = tuple(batch.column(c)[int(members[0])].as_py() for c in by)
                sides = block[:, design:]
                low, high = sides.min(axis=0), sides.max(axis=0)
                state = held.get(key)
                if state is None:
                    held[key] = [[block], len(block), low, high]
                    size += block.nbytes
                    continue
                state[0].append(block)
                state[1] += len(block)
                state[2], state[3] = np.minimum(state[2], low), np.maximum(state[3], high)
                size += block.nbytes
                if state[1] > max(FOLD_ROWS, 4 * block.shape[1]):
                    size -= sum(x.nbytes for x in state[0])
                    state[0] = [_fold(state[0])]
                    state[1] = len(state[0][0])
                    size += state[0][0].nbytes
            if size > FLUSH_BYTES:
                yield flush(batch.schema)
                size = 0
        if held:
            yield flush(batch.schema)

    def fold_ways(part: pd.DataFrame) -> pd.DataFrame:
        factor, low, high = _unpacked(part)
        row = {c: part[c].iloc[0] for c in [*by, "way", "width", "design"]}
        return pd.DataFrame([{**row, "factor": factor.ravel(), "low": low, "high": high}])

    blocks = rows.mapInArrow(factor_rows, block_schema)
    if shape[1] > max_group_rows(df.sparkSession):
        steps = (WIDE_WAYS, NARROW_WAYS)
    else:
        steps = (NARROW_WAYS,) if shape[1] > ONE_STEP_ROWS else ()
    for ways in steps:
        spread = blocks.withColumn("way", F.pmod("way", F.lit(ways)))
        blocks = spread.groupBy(*by, "way").applyInPandas(fold_ways, block_schema)
    return blocks


def _unpacked(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The fold of factors of one width, and the extremes over them."""
    low = np.vstack(part["low"].to_numpy()).min(axis=0)
    high = np.vstack(part["high"].to_numpy()).max(axis=0)
    width = int(part["width"].iloc[0])
    return _fold([np.asarray(f, dtype=float).reshape(-1, width) for f in part["factor"]]), low, high


def _solved(factor: np.ndarray, design: int) -> np.ndarray:
    top = factor[:design]
    return np.linalg.lstsq(top[:, :design], top[:, design:], rcond=RCOND)[0]


def fit_projection(
    df: DataFrame,
    preds: Sequence[str],
    vector: str,
    by: Sequence[str],
    shape: tuple[int, int] | None = None,
) -> DataFrame:
    """Least-squares coefficients per group: (by, fits), where ``fits`` holds one
    (coefficients, flat) pair per prediction and ``flat`` marks a constant one.
    Rows must be complete."""
    by = list(by)

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        factor, low, high = _unpacked(part)
        solution = _solved(factor, int(part["design"].iloc[0]))
        fits = [
            {"coefficients": solution[:, i].tolist(), "flat": bool(low[i] == high[i])}
            for i in range(len(preds))
        ]
        return pd.DataFrame([{**{c: part[c].iloc[0] for c in by}, "fits": fits}])

    fit = T.StructType([
        T.StructField("coefficients", T.ArrayType(T.DoubleType())), T.StructField("flat", T.BooleanType()),
    ])
    blocks = factors(df, F.array(*[F.col(p) for p in preds]), vector, by, shape)
    schema = T.StructType([*[df.schema[c] for c in by], T.StructField("fits", T.ArrayType(fit))])
    return blocks.groupBy(*by).applyInPandas(solve, schema)


SEPARATOR = "\x1f"


def fit_models(rows: DataFrame, vector: str, name: str = "model_id") -> DataFrame:
    """Least-squares coefficients of every model's scores on the features of its own rows,
    per era, stored: (era, model, coefficients, flat). ``rows`` has era, the features'
    ``vector`` and ``scores``, an array of (``name``, z) sorted by name, of the models
    that have the row.

    The features of an era are factored once per pattern of models that share rows, with
    the models' scores as further columns; where all models have all rows that is once.
    A model's factor is the fold of those of its patterns, again shared by all models of
    the same patterns."""
    marked = rows.select(
        "era", vector, F.array_join(F.transform("scores", lambda s: s[name]), SEPARATOR).alias("pattern"),
        F.transform("scores", lambda s: s["z"]).alias("sides"),
    )
    blocks = factors(marked, F.col("sides"), vector, ["era", "pattern"], group_shape(rows, ["era"]))

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        patterns = [(pattern.split(SEPARATOR), *_unpacked(block)) for pattern, block in part.groupby("pattern", sort=True)]
        design = int(part["design"].iloc[0])
        of: dict[tuple[int, ...], list[str]] = {}
        for model in sorted({m for models, *_ in patterns for m in models}):
            of.setdefault(tuple(i for i, (models, *_) in enumerate(patterns) if model in models), []).append(model)
        out = []
        for used, models in of.items():
            places = [[patterns[i][0].index(m) for m in models] for i in used]
            parts = [patterns[i][1][:, [*range(design), *(design + p for p in at)]] for i, at in zip(used, places, strict=True)]
            solution = _solved(parts[0] if len(parts) == 1 else _fold(parts), design)
            low = np.min([patterns[i][2][at] for i, at in zip(used, places, strict=True)], axis=0)
            high = np.max([patterns[i][3][at] for i, at in zip(used, places, strict=True)], axis=0)
            for k, model in enumerate(models):
                out.append({"era": part["era"].iloc[0], "model": model, "coefficients": solution[:, k].tolist(), "flat": bool(low[k] == high[k])})
        return pd.DataFrame(out)

    schema = T.StructType([
        rows.schema["era"], T.StructField("model", T.StringType()),
        T.StructField("coefficients", T.ArrayType(T.DoubleType())), T.StructField("flat", T.BooleanType()),
    ])
    return materialize(blocks.groupBy("era").applyInPandas(solve, schema), "model-fits")


def fitted_value(coefficients: Column, vector: Column) -> Column:
    """The projection of a row: its features and a constant, times the coefficients."""
    terms = F.zip_with(
        coefficients, F.concat(vector, F.array(F.lit(1.0))), lambda c, x: c * x
    )
    return F.aggregate(terms, F.lit(0.0), lambda total, x: total + x)


def project(
    df: DataFrame,
    pred: str | Sequence[str],
    vector: str,
    by: Sequence[str],
    usable: str | None = None,
    shape: tuple[int, int] | None = None,
) -> DataFrame:
    """Add ``fit`` (or ``fit_<pred>`` for several): the projection of each prediction
    on the features and a constant, within its group. Constant predictions project
    to 0, so subtracting leaves them unchanged."""
    preds = [pred] if isinstance(pred, str) else list(pred)
    rows = df.where(F.col(usable)) if usable else df
    fits = broadcast_checked(materialize(fit_projection(rows, preds, vector, by, shape), "fits"))
    out = df.join(fits, list(by), "left")
    for i, name in enumerate(preds):
        fit = F.col("fits")[i]
        value = F.when(fit["flat"], F.lit(0.0)).otherwise(
            fitted_value(fit["coefficients"], F.col(vector).cast("array<double>"))
        )
        out = out.withColumn("fit" if isinstance(pred, str) else f"fit_{name}", value)
    return out.drop("fits")


def neutralize(
    df: DataFrame,
    pred: str,
    features: str | Sequence[str],
    proportion: float = 1.0,
    by: Sequence[str] = ("era",),
) -> DataFrame:
    """``pred`` minus ``proportion`` of its per-era projection on the features."""
    if not 0.0 <= proportion <= 1.0:
        raise ValueError("proportion must be between 0 and 1")
    if proportion == 0.0:
        return df
    work = df.withColumn("__vector", feature_vector(features))
    fitted = project(work, pred, "__vector", by)
    return fitted.withColumn(pred, F.col(pred) - F.lit(proportion) * F.col("fit")).drop(
        "fit", "__vector"
    )


def neutralized_ic(
    df: DataFrame,
    signals: Sequence[str],
    features: str | Sequence[str],
    target: str,
    proportions: Sequence[float],
    by: Sequence[str] = ("era",),
) -> DataFrame:
    """Per-era correlation with the target after removing each share of the feature
    projection: (by, signal, proportion, ic). One fit serves every share, since the
    neutralized signal is linear in it. Eras with a constant target are absent."""
    if not all(0.0 <= p <= 1.0 for p in proportions):
        raise ValueError("proportions must be within [0, 1]")
    vector = feature_vector(features)
    ok = is_finite(target) & F.forall(vector, is_finite)
    for s in signals:
        ok = ok & is_finite(s)
    rows = df.select(
        *by,
        F.col(target).cast("double").alias("t"),
        vector.alias("features"),
        *[F.col(s).cast("double").alias(s) for s in signals],
    ).where(F.coalesce(ok, F.lit(False)))
    fitted = project(rows, list(signals), "features", by)
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(s).alias("signal"),
                    F.lit(float(p)).alias("proportion"),
                    (F.col(s) - F.lit(float(p)) * F.col(f"fit_{s}")).alias("x"),
                )
                for s in signals
                for p in proportions
            ]
        )
    )
    long = fitted.select(*by, "t", cells.alias("c")).select(*by, "t", "c.*")
    return (
        long.groupBy(*by, "signal", "proportion")
        .agg(
            safe_corr(F.col("x"), F.col("t")).alias("ic"),
            (F.min("t") < F.max("t")).alias("varies"),
        )
        .where("varies")
        .drop("varies")
    )


def neutralization_frontier(
    df: DataFrame,
    pred: str,
    features: str | Sequence[str],
    target: str,
    proportions: Sequence[float],
) -> DataFrame:
    """Score summary per neutralization share: (proportion, mean, std, sharpe,
    max_drawdown). One fit serves all shares, and one pass scores them all."""
    from eraflow.operators.scoring import per_era_corr
    from eraflow.operators.series import summarize

    work = df.select("era", pred, target, feature_vector(features).alias("__vector"))
    shape = group_shape(df, ["era"])
    fitted = project(work, pred, "__vector", ["era"], shape=shape)
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(float(p)).alias("proportion"),
                    F.round(F.col(pred) - F.lit(float(p)) * F.col("fit"), 12).alias("x"),
                )
                for p in proportions
            ]
        )
    ).alias("c")
    long = fitted.select("era", target, cells).select("era", target, "c.*")
    wide = (shape[0] * len(proportions), shape[1])
    return summarize(per_era_corr(long, "x", target, ["proportion", "era"], wide), ["proportion"])


def neutralized_ic_profile(df, signals, features, target, proportions=(0.0, 0.5, 1.0)) -> DataFrame:
    """Mean and deviation over eras of :func:`neutralized_ic`, per signal and share."""
    series = neutralized_ic(df, signals, features, target, proportions)
    return series.groupBy("signal", "proportion").agg(
        F.avg("ic").alias("mean_ic"),
        F.stddev_pop("ic").alias("corr_std"),
        F.count("ic").alias("n_eras"),
    )
