"""Running totals along an order within groups, for groups of any size.

Small groups use one window. Otherwise one distributed sort by (group, order) is
stored with its partition numbers; totals per group and partition form a small
table whose prefix sums place every partition, so no task sees a whole group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eraflow.functions.ranks import group_shape
from eraflow.session import broadcast_checked, materialize, max_group_rows


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    sums: Mapping[str, str],
    next_as: str | None = None,
) -> DataFrame:
    """Per ``sums`` entry (new name -> column) the total of all rows ordered before
    this one; ``next_as`` names the following row's ``order`` value. ``order`` must be
    unique within a group."""
    by = list(by)
    group = Window.partitionBy(*by)
    if group_shape(df, by)[1] <= max_group_rows(df.sparkSession):
        ordered = group.orderBy(order)
        added = {out: F.sum(c).over(ordered) - F.col(c) for out, c in sums.items()}
        if next_as:
            added[next_as] = F.lead(order).over(ordered)
        return df.withColumns(added)
    stored = materialize(
        df.orderBy(*by, order).withColumn("__part", F.spark_partition_id()), "ordered"
    )
    totals = stored.groupBy(*by, "__part").agg(
        F.min(order).alias("__first"), *[F.sum(c).alias(f"__in_{out}") for out, c in sums.items()]
    )
    parts = group.orderBy("__part")
    totals = totals.withColumns(
        {
            **{
                f"__before_{out}": F.sum(f"__in_{out}").over(parts) - F.col(f"__in_{out}")
                for out in sums
            },
            "__following": F.lead("__first").over(parts),
        }
    ).drop("__first", *[f"__in_{out}" for out in sums])
    inside = Window.partitionBy(*by, "__part").orderBy(order)
    joined = stored.join(broadcast_checked(totals), [*by, "__part"])
    added = {
        out: F.col(f"__before_{out}") + F.sum(c).over(inside) - F.col(c) for out, c in sums.items()
    }
    if next_as:
        added[next_as] = F.coalesce(F.lead(order).over(inside), F.col("__following"))
    return joined.withColumns(added).drop(
        "__part", "__following", *[f"__before_{out}" for out in sums]
    )
