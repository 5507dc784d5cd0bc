"""Content-keyed pseudo randomness: the same key gives the same number on any
cluster layout, and other engines can reproduce it (plain md5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash32(*parts: Column | str | int) -> Column:
    texts = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws("|", *texts).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def uniform(*parts: Column | str | int) -> Column:
    """Uniform on the open interval (0, 1)."""
    return (hash32(*parts).cast("double") + 0.5) / F.lit(4294967296.0)


def multiset_digest(df: DataFrame, text: Column) -> DataFrame:
    """One row (digest, n_rows) that tells multisets of rows apart, given a text per row.

    Sums and exclusive ors of the eight 32-bit parts of the rows' SHA-256, merged in
    partial aggregates: the same for any order and partitioning, and rows that occur a
    different number of times change the sums. No row is gathered."""
    digest = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
    parts = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"p{i}") for i in range(8)]
    sums = df.select(*parts).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.sum(F.col(f"p{i}").cast("decimal(20,0)")).alias(f"s{i}") for i in range(8)],
        *[F.bit_xor(f"p{i}").alias(f"x{i}") for i in range(8)],
    )
    cells = [F.col("n_rows")] + [F.coalesce(F.col(f"{k}{i}"), F.lit(0)) for k in "sx" for i in range(8)]
    told = F.concat_ws(":", *[c.cast("string") for c in cells])
    return sums.select(F.sha2(told.cast("binary"), 256).alias("digest"), "n_rows")
