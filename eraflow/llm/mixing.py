"""Mixing sources to target weights by Poisson replication.

Every document gets a count drawn from the Poisson distribution whose mean is its
source's repetition rate, by inverting the distribution at a uniform number hashed from
the seed and the document id: the draw does not depend on the layout of the data, a
rerun gives the same mix, and no source needs to be counted off in order. Documents are
exploded by their counts, and all copies are dealt to partitions and ordered inside them
by a hash of (seed, document, copy): a global shuffle with one exchange.

A source is a value of the source column, null included. A source without any size
(only empty or null texts) has rate 1. Rows that repeat an id get equal counts. Texts of
any length are copied as they are. ``copy`` and ``shuffle_key`` of the input are replaced;
all other columns stay, whatever they are called. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eraflow.llm.common import broadcast_if_small, hidden

# Largest mean that is inverted at once; a larger one is a sum of equal smaller draws.
# exp(-mean) and the last terms of the sum are then far above the smallest double.
MAX_MEAN = 64.0
# Terms of the distribution function for a mean up to MAX_MEAN: beyond them the tail is
# under 2**-52, the step of the uniform numbers.
TERMS = 160


def uniform(*parts: Column) -> Column:
    """Uniform on [0, 1) in steps of 2**-52, from the md5 of the joined parts."""
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def temperature_rates(
    docs: DataFrame, alpha: float, epochs: float = 1.0, text: str = "text", source: str = "source"
) -> DataFrame:
    """(source, n_chars, rate): the mix has ``epochs`` times the corpus's characters, and
    a source's share of it is proportional to its own characters to the power ``alpha``."""
    sizes = docs.groupBy(F.col(source).alias("source")).agg(
        F.sum(F.coalesce(F.length(text), F.lit(0))).cast("long").alias("n_chars")
    )
    total = sizes.agg(
        F.sum("n_chars").alias("chars"),
        F.sum(F.when(F.col("n_chars") > 0, F.pow(F.col("n_chars").cast("double"), F.lit(alpha)))).alias("power"),
    )
    chars, power = total.select("chars").scalar(), total.select("power").scalar()
    share = F.pow(F.col("n_chars").cast("double"), F.lit(alpha)) / power
    rate = F.when(F.col("n_chars") > 0, F.lit(float(epochs)) * chars * share / F.col("n_chars")).otherwise(1.0)
    return sizes.select("source", "n_chars", rate.alias("rate"))


def with_distribution(rates: DataFrame) -> DataFrame:
    """Adds, per source, the number of equal draws and the distribution function of one."""
    parts = F.greatest(F.ceil(F.col("rate") / MAX_MEAN), F.lit(1)).cast("int")
    mean = F.col("rate") / F.col("draws")
    start = F.struct(F.exp(-mean).alias("term"), F.array(F.exp(-mean)).alias("sums"))
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS - 1)), start,
        lambda acc, k: F.struct(
            (acc["term"] * F.col("mean") / k).alias("term"),
            F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + acc["term"] * F.col("mean") / k)).alias("sums"),
        ),
    )
    return rates.withColumn("draws", parts).withColumn("mean", mean).withColumn("cdf", steps["sums"]).drop("mean")


def poisson_count(doc_id: Column, seed: int) -> Column:
    """Number of copies: for each draw, how many values of the distribution function the
    uniform number has reached."""
    key = F.coalesce(doc_id.cast("string"), F.lit("null"))
    draws = F.transform(
        F.sequence(F.lit(1), F.col("draws")), lambda j: uniform(F.lit(str(seed)), key, j.cast("string"))
    )
    reached = lambda u: F.size(F.filter("cdf", lambda c: c <= u))
    return F.aggregate(draws, F.lit(0), lambda acc, u: acc + reached(u))


def replicate(
    docs: DataFrame, rates: DataFrame, seed: int, doc_id: str = "doc_id", source: str = "source"
) -> DataFrame:
    """``docs`` with columns copy (from 1) and shuffle_key, shuffled globally. ``rates``
    has one row per source with its mean repetition rate; a document whose source has no
    rate is not in the mix. Columns of these names are replaced."""
    docs, now, back = hidden(docs, ["_source", "_n", "draws", "cdf"])
    doc_id, source = now(doc_id), now(source)
    kept = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    dist = with_distribution(rates.select(F.col("source").alias("_source"), "rate"))
    dist = dist.select("_source", "draws", "cdf")
    joined = docs.select(*kept).join(broadcast_if_small(dist), F.col(source).eqNullSafe(F.col("_source")))
    counted = joined.withColumn("_n", poisson_count(F.col(doc_id), seed)).where("_n > 0")
    copies = counted.select(*kept, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"))
    key = F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.col("copy").cast("string")).cast("binary"))
    return back(copies.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key"))
