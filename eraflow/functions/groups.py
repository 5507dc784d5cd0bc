"""Scores of whole groups in one task each, on Arrow columns.

Spark deals the rows by group; a task then holds the numeric columns of one group (at
most ``spark.eraflow.maxGroupRows`` rows and that number of ``GROUP_CELLS`` cells) and
ranks them in numpy, which costs a tenth of a window's sort and row-wise frames.
Groups beyond that take the layouts of ``functions/ranks.py``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eraflow.functions import stats
from eraflow.session import max_group_rows

# Cells of one group for each row that a group may have, and models that one task scores
# in an era (many more models than eras would leave the cluster idle).
GROUP_CELLS, TASK_MODELS = 8, 16
# Rows of whole groups that one task should sort, and the most tasks made for that.
TASK_ROWS, MOST_TASKS = 500_000, 4_096


def fits_task(df: DataFrame, rows: int, columns: int) -> bool:
    """Whether one task may hold a group of that many rows and numeric columns."""
    limit = max_group_rows(df.sparkSession)
    return rows <= limit and rows * columns <= GROUP_CELLS * limit


def dealt(df: DataFrame, by: Sequence[str], shape: tuple[int, int]) -> DataFrame:
    """``df`` dealt by group over tasks of about ``TASK_ROWS`` rows; as it is where tasks
    are that small anyhow, or a group is too large for one. Left to itself, adaptive
    execution joins partitions to about one a core, or to what compressed bytes allow, so
    that a task's sort grows with the input."""
    tasks = min(-(-shape[0] * shape[1] // TASK_ROWS), shape[0], MOST_TASKS)
    if tasks <= df.sparkSession.sparkContext.defaultParallelism or shape[1] > max_group_rows(df.sparkSession):
        return df
    return df.repartition(tasks, *by)


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Tie-averaged ranks from 1; values must be finite."""
    order = np.argsort(x, kind="stable")
    ordered = x[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    sizes = np.diff(np.r_[starts, x.size])
    out = np.empty(x.size)
    out[order] = np.repeat(starts + (sizes + 1) / 2.0, sizes)
    return out


def norm_ppf(p: np.ndarray) -> np.ndarray:
    """The normal quantile of probabilities inside (0, 1), as ``stats.with_norm_ppf``."""
    q = p - 0.5
    out = np.empty(p.size)
    central = np.abs(q) <= 0.425
    r = 0.180625 - q[central] * q[central]
    out[central] = q[central] * np.polyval(stats.AS241_CENTRAL_NUM, r) / np.polyval(stats.AS241_CENTRAL_DEN, r)
    outer = ~central
    tail = np.sqrt(-np.log(np.minimum(p[outer], 1.0 - p[outer])))
    near, far = tail - 1.6, tail - 5.0
    size = np.where(
        tail <= 5.0,
        np.polyval(stats.AS241_MIDDLE_NUM, near) / np.polyval(stats.AS241_MIDDLE_DEN, near),
        np.polyval(stats.AS241_TAIL_NUM, far) / np.polyval(stats.AS241_TAIL_DEN, far),
    )
    out[outer] = np.where(q[outer] < 0.0, -size, size)
    return out


def rank_gauss(x: np.ndarray) -> np.ndarray:
    return norm_ppf((average_ranks(x) - 0.5) / x.size)


def signed_power(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.abs(x) ** 1.5


def varies(*columns: np.ndarray) -> bool:
    """At least two rows and no constant column among them."""
    return all(c.size >= 2 and c.min() < c.max() for c in columns)


def corr(x: np.ndarray, y: np.ndarray) -> float:
    """Pearson correlation, 0.0 where it is undefined."""
    if not varies(x, y):
        return 0.0
    spread = x.std() * y.std()
    value = float(((x - x.mean()) * (y - y.mean())).mean() / spread) if spread > 0.0 else 0.0
    return value if np.isfinite(value) else 0.0


def by_group(
    df: DataFrame, by: Sequence[str], columns: Sequence[str],
    scores: Callable[[dict[str, np.ndarray]], dict[str, float | int | bool]], types: str,
    raw: bool = False, shape: tuple[int, int] | None = None,
) -> DataFrame:
    """(by, scores): ``scores`` of the ``columns`` of every group; ``types`` are theirs in
    SQL. NULLs arrive as NaN, arrays as matrices, flags as booleans; ``raw`` columns as
    they are in Arrow. Groups of a known ``shape`` are dealt over tasks of bounded size."""
    by, columns = list(by), list(columns)
    found = T.StructType.fromDDL(types)
    schema = T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in by], *found.fields])
    names = [f.name for f in found.fields]

    def of_group(table: pa.Table) -> pa.Table:
        keys = [table.column(c) for c in by]
        if all(_constant(k) for k in keys):
            return one(table)
        # groups whose hashes are equal
        codes = table.select(by).to_pandas().groupby(by, sort=False, dropna=False).ngroup().to_numpy()
        return pa.concat_tables([one(table.filter(pa.array(codes == i))) for i in range(codes.max() + 1)])

    def one(table: pa.Table) -> pa.Table:
        out = scores({c: table.column(c) if raw else _numbers(table.column(c)) for c in columns})
        cells = {c: table.column(c).slice(0, 1) for c in by}
        return pa.table({**cells, **{n: pa.array([out[n]]) for n in names}})

    # rows sort by one number, which costs a part of a sort by several texts
    hashed = df.select(F.xxhash64(*by).alias("__group"), *by, *columns)
    if shape is not None:
        hashed = dealt(hashed, ["__group"], shape)
    return hashed.groupBy("__group").applyInArrow(of_group, schema)


def _constant(key: pa.ChunkedArray) -> bool:
    if key.null_count:
        return key.null_count == len(key)
    return pc.all(pc.equal(key, key[0])).as_py()


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    if pa.types.is_list(column.type):
        flat = column.combine_chunks()
        flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)
    return column.to_numpy()


def models_a_task(
    predictions: DataFrame, rows: DataFrame, columns: int, features: int, name: str
) -> tuple[list, int]:
    """The models, sorted, and how many of them one task may hold in an era beside the
    era's ``rows`` (0: not even one). One pass over the keys of each side."""
    limit = max_group_rows(predictions.sparkSession)
    sizes = predictions.groupBy(name, "era").agg(F.count(F.lit(1)).alias("rows"))
    found = sizes.groupBy(name).agg(F.max("rows").alias("rows")).collect()
    models = sorted((r[name] for r in found), key=lambda m: (m is not None, m))
    largest = max((r["rows"] for r in found), default=1)
    era = rows.groupBy("era").agg(F.count(F.lit(1)).alias("rows")).agg(F.max("rows")).first()[0] or 0
    room = GROUP_CELLS * limit - era * (features + 3)
    return models, max(0, min(TASK_MODELS, limit // largest, room // (largest * (columns + 3)))) if era <= limit else 0


def by_models(
    predictions: DataFrame, rows: DataFrame, columns: Sequence[str], name: str, dealt: tuple[list, int],
    scores: Callable[[list[tuple[dict[str, np.ndarray], np.ndarray]], np.ndarray, np.ndarray], list[dict]], types: str,
) -> DataFrame:
    """(``name``, era, scores) of every model of every era. ``predictions`` has ``name``, era,
    id and the numeric ``columns``; ``rows`` has era, id, a number ``t`` and finite features
    ``x``, once per (era, id). A task gets an era's rows once and as many models as
    ``dealt`` (``models_a_task``) allows, and calls ``scores`` with a list of (columns,
    place) per model, t and x: ``place`` is the row of ``x`` with the same id, -1 without."""
    models, held = dealt
    columns = list(columns)
    found = T.StructType.fromDDL(types)
    keys = [predictions.schema[c] for c in (name, "era")]
    left = predictions.select(name, "era", "id", *columns)
    right = rows.where(F.col("era").isNotNull() & F.col("id").isNotNull()).select(
        F.col("era").cast(keys[1].dataType).alias("era"), F.col("id").cast(left.schema["id"].dataType).alias("id"), "t", "x"
    )
    parts = -(-len(models) // max(held, 1))
    if parts > 1:
        # a few models a part: their rows of an era fit one task
        listed = left.sparkSession.createDataFrame([(m, i // held) for i, m in enumerate(models)], T.StructType([T.StructField("__m", keys[0].dataType), T.StructField("__part", T.IntegerType())]))
        left = left.join(F.broadcast(listed), F.col(name).eqNullSafe(F.col("__m"))).drop("__m")
        right = right.withColumn("__part", F.explode(F.array(*[F.lit(i) for i in range(parts)])))
    else:
        left, right = left.withColumn("__part", F.lit(0)), right.withColumn("__part", F.lit(0))

    def of_group(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        cells: list[tuple] = []
        whole = [ours.schema.field(c).type for c in (name, "era")]
        for part in _parted(ours, "__part"):
            beside = theirs.filter(_equal(theirs.column("__part"), part.column("__part")[0]))
            for era in _parted(part, "era"):
                cells += of_era(era, beside.filter(_equal(beside.column("era"), era.column("era")[0])))
        kinds = [*whole, *[_arrow_type(f.dataType) for f in found.fields]]
        return pa.table([pa.array([c[i] for c in cells], kind) for i, kind in enumerate(kinds)], [name, "era", *[f.name for f in found.fields]])

    def of_era(ours: pa.Table, theirs: pa.Table) -> list[tuple]:
        ids = theirs.column("id").combine_chunks()
        places = pc.fill_null(pc.index_in(ours.column("id"), value_set=ids), -1).to_numpy()
        x = _numbers(theirs.column("x")) if theirs.num_rows else np.empty((0, 0))
        codes = pc.dictionary_encode(ours.column(name), null_encoding="encode").combine_chunks()
        code = codes.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        numbers = {c: _numbers(ours.column(c)) for c in columns}
        members = np.split(order, np.flatnonzero(np.diff(code[order])) + 1)
        sets = [({c: v[at] for c, v in numbers.items()}, places[at]) for at in members]
        out = scores(sets, _numbers(theirs.column("t")), x)
        era = ours.column("era")[0].as_py()
        return [
            (codes.dictionary[int(code[at[0]])].as_py(), era, *[got[f.name] for f in found.fields])
            for at, got in zip(members, out, strict=True)
        ]

    # rows sort by one number; groups whose hashes are equal are told apart in the task
    deal = F.xxhash64("era", "__part").alias("__group")
    both = left.select(deal, "*").groupBy("__group").cogroup(right.select(deal, "*").groupBy("__group"))
    return both.applyInArrow(of_group, T.StructType([*keys, *found.fields]))


def _parted(table: pa.Table, key: str) -> list[pa.Table]:
    column = table.column(key)
    if not table.num_rows or _constant(column):
        return [table] if table.num_rows else []
    return [table.filter(_equal(column, value)) for value in pc.unique(column)]


def _equal(column: pa.ChunkedArray, value: pa.Scalar) -> pa.ChunkedArray:
    return pc.equal(column, value) if value.is_valid else pc.is_null(column)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    return {"double": pa.float64(), "boolean": pa.bool_(), "bigint": pa.int64()}[kind.simpleString()]
