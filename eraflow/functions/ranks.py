"""Tie-averaged ranks within groups, for groups of any size.

Two layouts give the same numbers:

* one window per group, when no group has more rows than one task may sort
  (checked by a cheap count of the grouping columns);
* otherwise every oversized group is cut at its own quantiles. Values equal to a
  cut point form a bucket that needs no ordering at all (all its rows tie), the
  open buckets between cut points hold a bounded share of the group, and the
  rows below a bucket come from a small table of bucket totals. A task then
  never sees more than one bucket, even if a single era, or a single value,
  holds a third of the panel.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eraflow.functions.stats import with_norm_ppf
from eraflow.session import fits_broadcast, max_group_rows


_shapes: dict[tuple, tuple[int, int]] = {}


def group_shape(df: DataFrame, by: Sequence[str]) -> tuple[int, int]:
    """(number of groups, rows of the largest group): one pass over the keys alone.

    Remembered per plan and input files, so a source that has grown is counted again;
    plans without files are counted every time.
    """
    keys = df.select(*by)
    files = keys.inputFiles()
    known = (df.sparkSession.sparkContext.applicationId, keys.semanticHash(), hash(tuple(sorted(files))))
    if known not in _shapes or not files:
        sizes = keys.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
        row = sizes.agg(F.count(F.lit(1)).alias("groups"), F.max("rows").alias("rows")).first()
        _shapes[known] = (int(row["groups"]), int(row["rows"] or 0))
    return _shapes[known]


def with_ranks(
    df: DataFrame,
    by: Sequence[str],
    ranks: Mapping[str, str],
    *,
    count_as: str | None = None,
    stats: Mapping[str, Column] | None = None,
    weight: str | None = None,
    shape: tuple[int, int] | None = None,
) -> DataFrame:
    """Add one tie-averaged rank column per ``ranks`` entry (new name -> column).

    ``count_as`` adds the group's row count and ``stats`` further group
    aggregates. With ``weight`` a row stands for that many equal rows. Rows whose
    ranked column is NULL sort first and should be in a group of their own.
    """
    stats = dict(stats or {})
    if count_as:
        stats[count_as] = F.sum(weight) if weight else F.count(F.lit(1))
    if shape is None:
        shape = group_shape(df, by)
    if shape[1] <= max_group_rows(df.sparkSession):
        return _window_ranks(df, by, ranks, stats, weight)
    return _bucket_ranks(df, by, ranks, stats, weight, shape)


def _average_rank(window: Window, weight: str | None) -> Column:
    if weight is None:
        return (F.rank().over(window) + F.count(F.lit(1)).over(window)) / F.lit(2.0)
    through = F.sum(weight).over(window)
    ties = F.sum(weight).over(window.rangeBetween(Window.currentRow, Window.currentRow))
    return through - (ties - F.lit(1.0)) / F.lit(2.0)


def _window_ranks(df, by, ranks, stats, weight):
    # ranks first: the sort of the last rank also serves the unordered statistics
    group = Window.partitionBy(*by)
    ranked = df.withColumns(
        {name: _average_rank(group.orderBy(column), weight) for name, column in ranks.items()}
    )
    return ranked.withColumns({name: agg.over(group) for name, agg in stats.items()})


def _bucket_ranks(df, by, ranks, stats, weight, shape):
    cap = max_group_rows(df.sparkSession)
    # twice as many buckets as cap-sized parts of the largest group, and as many salts
    cuts = salts = max(2, -(-2 * shape[1] // cap))
    points = [i / (cuts + 1.0) for i in range(1, cuts + 1)]
    accuracy = F.lit(max(10_000, 20 * cuts))
    size = F.count(F.lit(1))
    per_group = df.groupBy(*by).agg(
        *[agg.alias(name) for name, agg in stats.items()],
        *[
            F.when(
                size > cap,
                F.sort_array(F.array_distinct(F.percentile_approx(column, points, accuracy))),
            ).alias(f"__cuts_{name}")
            for name, column in ranks.items()
        ],
    )
    width = 16 * (len(by) + len(stats)) + 64 + 8 * cuts * len(ranks)
    small = fits_broadcast(df.sparkSession, shape[0], width)
    out = _join_null_safe(df, F.broadcast(per_group) if small else per_group, by)
    row_hash = F.xxhash64(*[F.col(c) for c in df.columns])
    for name, column in ranks.items():
        edges, bucket, salt = f"__cuts_{name}", f"__bucket_{name}", f"__salt_{name}"
        value = F.col(column)
        below = F.size(F.filter(edges, lambda e: e < value))
        tied = F.array_contains(edges, value)
        out = out.withColumn(
            bucket,
            F.when(F.col(edges).isNull() | value.isNull(), F.lit(0)).otherwise(
                2 * below + tied.cast("int")
            ),
        )
        # rows of an equality bucket need no order, so they spread over salts
        out = out.withColumn(
            salt,
            F.when(F.col(bucket) % 2 == 1, F.pmod(row_hash, F.lit(salts))).otherwise(F.lit(0)),
        )
        total = F.sum(weight) if weight else F.count(F.lit(1))
        totals = out.groupBy(*by, bucket).agg(total.alias("__in"))
        running = Window.partitionBy(*by).orderBy(bucket)
        totals = totals.withColumn("__before", F.sum("__in").over(running) - F.col("__in"))
        few = fits_broadcast(df.sparkSession, shape[0] * (2 * cuts + 1), 16 * (len(by) + 3) + 64)
        out = _join_null_safe(out, F.broadcast(totals) if few else totals, [*by, bucket])
        inside = _average_rank(
            Window.partitionBy(*by, bucket, salt).orderBy(column), weight
        )
        out = out.withColumn(
            name,
            F.col("__before")
            + F.when(F.col(bucket) % 2 == 1, (F.col("__in") + 1) / F.lit(2.0)).otherwise(inside),
        ).drop(edges, bucket, salt, "__in", "__before")
    return out


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = None
    for k in keys:
        match = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        condition = match if condition is None else condition & match
    return left.join(renamed, condition).drop(*[f"__r_{k}" for k in keys])


def percentile_rank(rank: Column, count: Column) -> Column:
    """(rank - 0.5) / n, strictly inside (0, 1)."""
    return (rank - F.lit(0.5)) / count


def with_rank_gauss(
    df: DataFrame,
    by: Sequence[str],
    columns: Mapping[str, str],
    *,
    count_as: str = "__n",
    stats: Mapping[str, Column] | None = None,
    shape: tuple[int, int] | None = None,
) -> DataFrame:
    """Add the normal score of the percentile rank for every ``columns`` entry."""
    ranked = with_ranks(
        df,
        by,
        {f"__rank_{out}": column for out, column in columns.items()},
        count_as=count_as,
        stats=stats,
        shape=shape,
    )
    shares = {
        f"__share_{out}": percentile_rank(F.col(f"__rank_{out}"), F.col(count_as))
        for out in columns
    }
    scored = with_norm_ppf(ranked.withColumns(shares), {out: f"__share_{out}" for out in columns})
    return scored.drop(*[f"__rank_{out}" for out in columns], *shares)


def with_unit_variance(
    df: DataFrame,
    by: Sequence[str],
    columns: Sequence[str],
    *,
    shape: tuple[int, int] | None = None,
) -> DataFrame:
    """Divide each column by its population deviation in the group (0 if it has none)."""
    return with_group_stats(
        df, by, {f"__sd_{c}": F.stddev_pop(c) for c in columns}, shape=shape
    ).withColumns(
        {
            c: F.when(F.col(f"__sd_{c}") > 0.0, F.col(c) / F.col(f"__sd_{c}")).otherwise(F.lit(0.0))
            for c in columns
        }
    ).drop(*[f"__sd_{c}" for c in columns])


def with_group_stats(
    df: DataFrame,
    by: Sequence[str],
    stats: Mapping[str, Column],
    *,
    shape: tuple[int, int] | None = None,
) -> DataFrame:
    """Attach group aggregates to the rows: by window while groups are small,
    else by partial aggregation and a join (which splits hot groups)."""
    if shape is None:
        shape = group_shape(df, by)
    if shape[1] <= max_group_rows(df.sparkSession):
        group = Window.partitionBy(*by)
        return df.withColumns({name: agg.over(group) for name, agg in stats.items()})
    table = df.groupBy(*by).agg(*[agg.alias(name) for name, agg in stats.items()])
    small = fits_broadcast(df.sparkSession, shape[0], 16 * (len(by) + len(stats)) + 64)
    return _join_null_safe(df, F.broadcast(table) if small else table, by)
