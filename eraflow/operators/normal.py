"""Ridge fits from mergeable moments of eras.

One scan gives every era's moments: row count, means and co-moments of features and
targets, apart for each pattern of present targets (a target's rows are those on which
it is finite). Moments of two sets of rows merge exactly, so the train side of a fold,
or of a purged split, is a merge over its eras, and a fit for any target and penalty is
the solution of one k x k system. However many folds, targets and penalties are asked
for, the train rows are read once.

Tasks fold their rows into one set of moments per era and pattern. Where an era's rows lie
on so many tasks that these sets would be larger than the rows, the rows are dealt by
(era, salt) first; which is the case is measured. Sums travel as packed triangles and are
merged in two steps where an era is large, one set at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eraflow.functions.ranks import group_shape
from eraflow.functions.stats import is_finite
from eraflow.operators.neutralize import FLUSH_BYTES, FOLD_ROWS, feature_vector
from eraflow.session import broadcast_checked, materialize, max_group_rows

# Rows of one (era, salt) where rows are dealt, and ways of the first merge step.
DEALT_ROWS, MERGE_WAYS = 65_536, 64


@dataclass
class Moments:
    """Row count, means and co-moments (sums of products of deviations)."""

    n: int
    mean: np.ndarray
    spread: np.ndarray

    @classmethod
    def of(cls, block: np.ndarray) -> Moments:
        mean = block.mean(axis=0)
        centred = block - mean
        return cls(len(block), mean, centred.T @ centred)

    def merge(self, other: Moments) -> Moments:
        n = self.n + other.n
        apart = other.mean - self.mean
        mean = self.mean + apart * (other.n / n)
        spread = self.spread + other.spread + np.outer(apart, apart) * (self.n * other.n / n)
        return Moments(n, mean, spread)

    def packed(self) -> np.ndarray:
        return self.spread[np.triu_indices(len(self.mean))]

    @classmethod
    def unpacked(cls, n: int, mean: np.ndarray, packed: np.ndarray) -> Moments:
        spread = np.zeros((len(mean), len(mean)))
        spread[np.triu_indices(len(mean))] = packed
        return cls(n, mean, spread + np.triu(spread, 1).T)


def merged(left: Moments | None, right: Moments) -> Moments:
    return right if left is None else left.merge(right)


def _dealt(df: DataFrame, by: Sequence[str], vector: str, width: int) -> DataFrame:
    """``df`` as it lies, or dealt by (group, salt) where the sets of moments that its
    tasks would make are larger than its rows."""
    sets = df.select(*by, F.spark_partition_id().alias("__part")).groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("rows"))
    found = sets.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("sets")).first()
    if found["sets"] * (width + 1) <= 2 * found["rows"]:
        return df
    salts = -(-group_shape(df, by)[1] // DEALT_ROWS)
    return df.repartition(*by, F.pmod(F.xxhash64(vector), F.lit(salts)))


def _array(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.float64())


def era_moments(
    df: DataFrame, features: str | Sequence[str], targets: Sequence[str] = (), by: Sequence[str] = ("era",)
) -> DataFrame:
    """Moments per group and pattern of finite targets, stored: (by, pattern, n, mean,
    spread). The first values of ``mean`` belong to the features, the last to
    ``targets``; a target that the pattern leaves out counts as 0. ``spread`` is the upper
    triangle, row by row. Features that are missing or not finite are an error."""
    by, targets = list(by), list(targets)
    rows = df.select(
        *by, feature_vector(features).alias("x"),
        F.array(*[F.col(t).cast("double") for t in targets]).cast("array<double>").alias("y"),
    )
    if isinstance(features, str):
        first = df.select(F.size(feature_vector(features)).alias("n")).first()
        width = (first["n"] if first else 0) + len(targets)
    else:
        width = len(features) + len(targets)
    keys = [df.schema[c] for c in by]
    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType([
        *keys, T.StructField("pattern", T.StringType()), T.StructField("way", T.IntegerType()),
        T.StructField("n", T.LongType()), T.StructField("mean", doubles), T.StructField("spread", doubles),
    ])
    names = [f.name for f in schema.fields]

    def batch_of(held: dict[tuple, Moments], like: pa.Schema, ways: list[int]) -> pa.RecordBatch:
        columns = [pa.array([key[i] for key in held], like.field(c).type) for i, c in enumerate([*by])]
        columns += [
            pa.array([key[len(by)] for key in held], pa.string()), pa.array(ways, pa.int32()),
            pa.array([m.n for m in held.values()], pa.int64()),
            pa.array([m.mean for m in held.values()], pa.list_(pa.float64())),
            pa.array([m.packed() for m in held.values()], pa.list_(pa.float64())),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        way = TaskContext.get().partitionId() % MERGE_WAYS
        blocks: dict[tuple, list[np.ndarray]] = {}
        sums: dict[tuple, Moments] = {}

        def settle(key: tuple) -> None:
            sums[key] = merged(sums.get(key), Moments.of(np.vstack(blocks.pop(key))))

        like = None
        for batch in batches:
            if not batch.num_rows:
                continue
            like = batch.schema
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if not np.isfinite(x).all():
                raise ValueError("features must be finite")
            y = batch.column("y").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, len(targets))
            known = np.isfinite(y)
            matrix = np.hstack([x, np.where(known, y, 0.0)])
            codes = batch.select(by).to_pandas().groupby(by, sort=False, dropna=False).ngroup().to_numpy()
            cells = np.column_stack([codes, known]) if targets else codes[:, None]
            _, first, code = np.unique(cells, axis=0, return_index=True, return_inverse=True)
            order = np.argsort(code.ravel(), kind="stable")
            for at, members in zip(first, np.split(order, np.flatnonzero(np.diff(code.ravel()[order])) + 1), strict=True):
                pattern = "".join("1" if k else "0" for k in known[at])
                key = (*[batch.column(c)[int(at)].as_py() for c in by], pattern)
                held = blocks.setdefault(key, [])
                held.append(matrix[members])
                if sum(map(len, held)) > FOLD_ROWS:
                    settle(key)
            if sum(m.spread.nbytes for m in sums.values()) > FLUSH_BYTES:
                for key in list(blocks):
                    settle(key)
                yield batch_of(sums, like, [way] * len(sums))
                sums.clear()
        for key in list(blocks):
            settle(key)
        if sums:
            yield batch_of(sums, like, [way] * len(sums))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets of moments of one key follow each other; one is held at a time."""
        key, way, held, like = None, 0, None, None
        for batch in batches:
            like = batch.schema
            for i in range(batch.num_rows):
                found = tuple(batch.column(c)[i].as_py() for c in [*by, "pattern", "way"])
                mean = batch.column("mean")[i].values.to_numpy()
                moments = Moments.unpacked(batch.column("n")[i].as_py(), mean, batch.column("spread")[i].values.to_numpy())
                if found != key:
                    if held is not None:
                        yield batch_of({key[:-1]: held}, like, [way])
                    key, way, held = found, found[-1], None
                held = merged(held, moments)
        if held is not None:
            yield batch_of({key[:-1]: held}, like, [way])

    found = _dealt(rows, by, "x", width).mapInArrow(fold, schema)
    steps = [F.col("way"), F.lit(0)] if group_shape(df, by)[1] > max_group_rows(df.sparkSession) else [F.lit(0)]
    for way in steps:
        found = found.withColumn("way", way.cast("int"))
        found = found.repartition(*by, "pattern", "way").sortWithinPartitions(*by, "pattern", "way").mapInArrow(merge, schema)
    return materialize(found.drop("way"), "moments")


@dataclass
class Cross:
    """Row count, means, squared deviations of two sides of columns, and their products."""

    n: int
    means: tuple[np.ndarray, np.ndarray]
    squares: tuple[np.ndarray, np.ndarray]
    products: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray) -> Cross:
        means = x.mean(axis=0), y.mean(axis=0)
        u, v = x - means[0], y - means[1]
        return cls(len(x), means, ((u * u).sum(axis=0), (v * v).sum(axis=0)), u.T @ v)

    def merge(self, other: Cross) -> Cross:
        n, share = self.n + other.n, self.n * other.n / (self.n + other.n)
        u, v = other.means[0] - self.means[0], other.means[1] - self.means[1]
        means = self.means[0] + u * (other.n / n), self.means[1] + v * (other.n / n)
        squares = self.squares[0] + other.squares[0] + u * u * share, self.squares[1] + other.squares[1] + v * v * share
        return Cross(n, means, squares, self.products + other.products + np.outer(u, v) * share)

    def packed(self) -> np.ndarray:
        return np.concatenate([*self.means, *self.squares, self.products.ravel()])

    @classmethod
    def unpacked(cls, n: int, width: int, packed: np.ndarray) -> Cross:
        other = (len(packed) - 2 * width) // (width + 2)
        parts = np.split(packed, np.cumsum([width, other, width, other]))
        return cls(n, (parts[0], parts[1]), (parts[2], parts[3]), parts[4].reshape(width, other))

    def correlations(self) -> np.ndarray:
        scale = np.sqrt(np.outer(*self.squares))
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(scale > 0, self.products / scale, 0.0)


def cross_correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """(era, f, t, corr): correlation of every value of array ``x`` with every one of array
    ``y`` per era. Each task folds its rows into one set of products per era; nothing as
    long as rows x features x targets exists. Values must be finite."""
    schema = "era string, width int, n long, packed array<double>"

    def batch_of(held: dict[str, Cross]) -> pa.RecordBatch:
        return pa.record_batch(
            [pa.array(list(held), pa.string()), pa.array([len(c.means[0]) for c in held.values()], pa.int32()),
             pa.array([c.n for c in held.values()], pa.int64()), pa.array([c.packed() for c in held.values()], pa.list_(pa.float64()))],
            ["era", "width", "n", "packed"],
        )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Cross] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            sides = [batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("x", "y")]
            if not all(np.isfinite(side).all() for side in sides):
                raise ValueError("values must be finite")
            eras = batch.column("era").dictionary_encode()
            codes = eras.indices.to_numpy()
            for k, era in enumerate(eras.dictionary.to_pylist()):
                one = Cross.of(*[side[codes == k] for side in sides])
                held[era] = held[era].merge(one) if era in held else one
            if sum(c.products.nbytes for c in held.values()) > FLUSH_BYTES:
                yield batch_of(held)
                held.clear()
        if held:
            yield batch_of(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        era, held = None, None

        def listed() -> pa.RecordBatch:
            corr = held.correlations()
            f, t = np.indices(corr.shape)
            return pa.record_batch(
                [pa.array([era] * corr.size, pa.string()), pa.array(f.ravel(), pa.int32()), pa.array(t.ravel(), pa.int32()), pa.array(corr.ravel())],
                ["era", "f", "t", "corr"],
            )

        for batch in batches:
            for i in range(batch.num_rows):
                found, width, n = (batch.column(c)[i].as_py() for c in ("era", "width", "n"))
                if found != era and held is not None:
                    yield listed()
                    held = None
                one = Cross.unpacked(n, width, batch.column("packed")[i].values.to_numpy())
                era, held = found, one if held is None else held.merge(one)
        if held is not None:
            yield listed()

    doubles = [F.col(c).cast("array<double>").alias(n) for c, n in ((x, "x"), (y, "y"))]
    sums = df.select(F.col("era").cast("string").alias("era"), *doubles).mapInArrow(fold, schema)
    return sums.repartition("era").sortWithinPartitions("era").mapInArrow(merge, "era string, f int, t int, corr double")


FIT = "array<struct<target: string, alpha: double, n: bigint, coefficients: array<double>, intercept: double>>"


def solution(
    moments: Moments, n_features: int, place: int, alpha: float, scale: np.ndarray | None = None
) -> tuple[np.ndarray, float]:
    """Coefficients and free intercept of the ridge of the target at ``place``; with
    ``scale`` (deviations) the penalty is on coefficients of scaled features, and those
    without spread get none."""
    inner = moments.spread[:n_features, :n_features]
    outer = moments.spread[:n_features, n_features + place]
    with np.errstate(divide="ignore"):
        unit = np.ones(n_features) if scale is None else np.where(scale > 0, 1.0 / scale, 0.0)
    system = inner * np.outer(unit, unit) + alpha * np.eye(n_features)
    if alpha > 0:
        found = np.linalg.solve(system, outer * unit)
    else:
        found = np.linalg.lstsq(system, outer * unit, rcond=None)[0]
    weights = found * unit
    return weights, float(moments.mean[n_features + place] - weights @ moments.mean[:n_features])


def ridge_fits(
    moments: DataFrame,
    targets: Sequence[str],
    alphas: Sequence[float],
    groups: DataFrame | None = None,
    fitted: Sequence[str] | None = None,
    scaled: bool = False,
) -> DataFrame:
    """One row per group of eras, stored: (fold, fits) with a fit for each target and
    penalty. ``groups`` has (fold, era); without it all eras are fold 0. ``targets`` are
    those of the moments, ``fitted`` the ones to fit (all by default). ``scaled`` puts
    the penalty on coefficients of features of unit deviation over all rows of the
    group. A target without a finite row in a group is an error."""
    targets, fitted = list(targets), list(fitted if fitted is not None else targets)
    if groups is None:
        joined = moments.withColumn("fold", F.lit(0))
    else:
        joined = moments.join(broadcast_checked(groups.select(F.col("fold").cast("int").alias("fold"), "era").distinct()), "era")
    ordered = joined.select("fold", "pattern", "n", "mean", "spread").repartition("fold").sortWithinPartitions("fold")

    def solved(fold: int, whole: Moments, states: dict[str, Moments]) -> pa.RecordBatch:
        n_features = len(whole.mean) - len(targets)
        scale = np.sqrt(np.diag(whole.spread)[:n_features] / whole.n) if scaled else None
        fits = []
        for t in fitted:
            if t not in states:
                raise ValueError(f"no finite rows of {t}")
            for alpha in alphas:
                weights, intercept = solution(states[t], n_features, targets.index(t), alpha, scale)
                fits.append({"target": t, "alpha": float(alpha), "n": states[t].n, "coefficients": weights, "intercept": intercept})
        kind = pa.list_(pa.struct([
            ("target", pa.string()), ("alpha", pa.float64()), ("n", pa.int64()),
            ("coefficients", pa.list_(pa.float64())), ("intercept", pa.float64()),
        ]))
        return pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([fits], kind)], ["fold", "fits"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, whole, states = None, None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                found = batch.column("fold")[i].as_py()
                if found != fold:
                    if whole is not None:
                        yield solved(fold, whole, states)
                    fold, whole, states = found, None, {}
                one = Moments.unpacked(
                    batch.column("n")[i].as_py(), batch.column("mean")[i].values.to_numpy(), batch.column("spread")[i].values.to_numpy()
                )
                whole = merged(whole, one)
                for t, present in zip(targets, batch.column("pattern")[i].as_py(), strict=True):
                    if present == "1":
                        states[t] = merged(states.get(t), one)
        if whole is not None:
            yield solved(fold, whole, states)

    return materialize(ordered.mapInArrow(solve, f"fold int, fits {FIT}"), "ridge-fits")


def dot(coefficients: Column, vector: Column) -> Column:
    return F.aggregate(F.zip_with(coefficients, vector, lambda c, x: c * x), F.lit(0.0), lambda total, x: total + x)


def with_scores(rows: DataFrame, fits: Column, features: str | Sequence[str], names: Sequence[str]) -> DataFrame:
    """Adds a score per fit, in their order; ``fits`` is an array of fits in each row. A
    feature that is missing or not finite is an error."""
    vector = feature_vector(features)
    error = F.raise_error(F.lit("features must be finite")).cast("array<double>")
    vector = F.when(F.coalesce(F.forall(vector, is_finite), F.lit(False)), vector).otherwise(error)
    scores = {name: fits[i]["intercept"] + dot(fits[i]["coefficients"], F.col("__x")) for i, name in enumerate(names)}
    return rows.withColumn("__x", vector).withColumns(scores).drop("__x")


def predict(rows: DataFrame, fits: DataFrame, features: str | Sequence[str], names: Sequence[str]) -> DataFrame:
    """Scores of the fits of a single group, as columns of one scan."""
    one = fits.select(F.struct("fits").alias("one")).scalar()
    return with_scores(rows.withColumn("__fits", one), F.col("__fits.fits"), features, names).drop("__fits")


def out_of_fold(
    df: DataFrame,
    folds: DataFrame,
    features: str | Sequence[str],
    targets: Sequence[str],
    alphas: Sequence[float] = (1.0,),
    scaled: bool = False,
) -> tuple[DataFrame, list[tuple[str, float]]]:
    """Rows of the validation eras with ``fold`` and a score column ``__p0``, ``__p1``, ...
    per (target, penalty) of the list that is returned beside them. The train rows of all
    folds are read in one scan. An era validated twice is an error."""
    val = folds.where("role = 'val'").select("era", F.col("fold").cast("int").alias("fold"))
    if val.groupBy("era").count().where("count > 1").limit(1).count():
        raise ValueError("validation eras overlap between folds")
    train = folds.where("role = 'train'")
    used = df.join(broadcast_checked(train.select("era").distinct()), "era", "left_semi")
    fits = ridge_fits(era_moments(used, features, targets), targets, alphas, train, scaled=scaled)
    rows = df.join(broadcast_checked(val), "era").join(broadcast_checked(fits), "fold")
    asked = [(t, float(a)) for t in targets for a in alphas]
    return with_scores(rows, F.col("fits"), features, [f"__p{i}" for i in range(len(asked))]).drop("fits"), asked
