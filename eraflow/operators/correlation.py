"""Correlation structure of the feature universe and of feature sets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eraflow.functions.ranks import group_shape, with_ranks
from eraflow.functions.running import running_totals
from eraflow.functions.stats import is_finite, ratio, with_norm_ppf
from eraflow.operators import normal
from eraflow.operators.neutralize import FLUSH_BYTES, feature_vector
from eraflow.session import broadcast_rows, materialize

PAIR_SCHEMA = (
    "era string, a int, b int, n double, sa double, sb double, saa double, sbb double, sab double"
)


def scored_vectors(df: DataFrame, features: str | Sequence[str]) -> DataFrame:
    """(era, z): complete rows with every feature replaced by the normal score of
    rank / (n + 1) within its era.

    If an estimate says there are few (era, feature, value) cells (binned features),
    they are counted and ranked, and the scores travel to the rows as one lookup map per
    era and feature: no row is shuffled. Otherwise the values are ranked in long form
    and the vectors put together again.
    """
    rows = df.select("era", "id", feature_vector(features).alias("x")).where(
        F.forall("x", is_finite)
    )
    long = rows.select("era", "id", F.posexplode("x").alias("i", "v"))
    limit = broadcast_rows(df.sparkSession)
    groups, largest = group_shape(df, ["era"])
    estimate = long.agg(
        F.approx_count_distinct(F.xxhash64("era", "i", "v")).alias("cells"),
        (F.max("i") + 1).alias("width"),
    ).first()
    if estimate["cells"] <= limit:
        cells = long.groupBy("era", "i", "v").agg(F.count(F.lit(1)).alias("w"))
        table = materialize(_scores(cells, (groups, largest), "w"), "scores")
        # the estimate chose the way; the broadcast itself depends on the exact count
        if table.limit(limit + 1).count() <= limit:
            maps = table.groupBy("era", "i").agg(
                F.map_from_entries(F.collect_list(F.struct("v", "z"))).alias("m")
            )
            maps = maps.groupBy("era").agg(
                F.map_from_entries(F.collect_list(F.struct("i", "m"))).alias("ms")
            )
            return rows.join(F.broadcast(maps), "era").select(
                "era", F.transform("x", lambda v, i: F.col("ms")[i][v]).alias("z")
            )
    scored = _scores(long, (groups * int(estimate["width"] or 0), largest), None)
    return scored.groupBy("era", "id").agg(
        F.sort_array(F.collect_list(F.struct("i", "z"))).getField("z").alias("z")
    ).select("era", "z")


def _scores(values: DataFrame, shape: tuple[int, int], weight: str | None) -> DataFrame:
    ranked = with_ranks(values, ["era", "i"], {"r": "v"}, weight=weight, count_as="n", shape=shape)
    shares = ranked.where("n >= 2").withColumn("p", F.col("r") / (F.col("n") + 1))
    keys = ["era", "i", "v"] if weight else ["era", "id", "i"]
    return with_norm_ppf(shares, {"z": "p"}).select(*keys, "z")


def pair_moments(vectors: DataFrame) -> DataFrame:
    """Partial sums per (era, feature pair) of every task's rows, added up by pair. The
    rows stay where they are; only sums are shuffled, keyed so finely that neither a
    long era nor a wide feature universe makes a hot key."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}

        def flush() -> pd.DataFrame:
            frames = []
            for era, gram in held.items():
                k = len(gram) - 1
                a, b = np.triu_indices(k, 1)
                frames.append(
                    pd.DataFrame(
                        {
                            "era": era, "a": a.astype(np.int32), "b": b.astype(np.int32),
                            "n": gram[k, k], "sa": gram[a, k], "sb": gram[b, k],
                            "saa": gram[a, a], "sbb": gram[b, b], "sab": gram[a, b],
                        }
                    )
                )
            held.clear()
            return pd.concat(frames, ignore_index=True)

        for batch in batches:
            for era, part in batch.groupby("era", sort=False):
                z = np.vstack(part["z"].to_numpy())
                block = np.hstack([z, np.ones((len(z), 1))])
                gram = block.T @ block
                held[era] = held[era] + gram if era in held else gram
                if sum(g.nbytes for g in held.values()) > FLUSH_BYTES:
                    yield flush()
        if held:
            yield flush()

    sums = vectors.mapInPandas(fold, PAIR_SCHEMA)
    return sums.groupBy("era", "a", "b").agg(
        *[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")]
    )


# Pairs of one tile of a packed matrix.
TILE_PAIRS = 4096


def era_matrices(df: DataFrame, features: str | Sequence[str]) -> DataFrame:
    """Moments of the score vectors per era, stored: one packed triangle an era. Tasks hand
    on one triangle per era they hold; rows that lie so scattered that the triangles
    would outweigh them are dealt by (era, salt) first (``normal.era_moments``)."""
    return normal.era_moments(scored_vectors(df, features), "z")


def _correlations(width: int, packed: np.ndarray) -> np.ndarray:
    """The pairs' correlations, row by row, from a packed triangle of co-moments; a pair
    with a constant side has 0."""
    rows, columns = np.triu_indices(width)
    own = np.flatnonzero(rows == columns)
    spread = np.maximum(packed[own], 0.0)
    off = rows != columns
    scale = np.sqrt(spread[rows[off]] * spread[columns[off]])
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(scale > 1e-12, packed[off] / scale, 0.0)


def pair_correlations(df: DataFrame, features: str | Sequence[str]) -> DataFrame:
    """(era, a, b, corr) by feature position; a pair with a constant side has 0."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                width = len(batch.column("mean")[i])
                corr = _correlations(width, batch.column("spread")[i].values.to_numpy())
                a, b = np.triu_indices(width, 1)
                era = pa.array([batch.column("era")[i].as_py()] * len(a), pa.string())
                yield pa.record_batch([era, pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(corr)], ["era", "a", "b", "corr"])

    moments = era_matrices(df, features).select(F.col("era").cast("string").alias("era"), "mean", "spread")
    return moments.mapInArrow(listed, "era string, a int, b int, corr double")


def mean_correlations(df: DataFrame, features: str | Sequence[str], tile_pairs: int = TILE_PAIRS) -> DataFrame:
    """(a, b, mean_corr): equal-era mean of the correlations. Every task adds its eras'
    matrices up and hands on tiles of the packed sum; long form begins behind the mean."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, eras, width = None, 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                width = len(batch.column("mean")[i])
                corr = _correlations(width, batch.column("spread")[i].values.to_numpy())
                total, eras = corr if total is None else total + corr, eras + 1
        if total is not None:
            tiles = [total[k : k + tile_pairs] for k in range(0, len(total), tile_pairs)]
            yield pa.record_batch(
                [pa.array(range(len(tiles)), pa.int64()), pa.array([width] * len(tiles), pa.int32()),
                 pa.array([eras] * len(tiles), pa.int64()), pa.array(tiles, pa.list_(pa.float64()))],
                ["tile", "width", "eras", "sums"],
            )

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tiles of one number follow each other; one sum is held."""
        held: tuple[int, int, int, np.ndarray] | None = None

        def listed(tile: int, width: int, eras: int, sums: np.ndarray) -> pa.RecordBatch:
            places = np.arange(len(sums)) + tile * tile_pairs
            ends = np.cumsum(np.arange(width - 1, 0, -1))  # pairs (a, b) with b > a, row by row
            a = np.searchsorted(ends, places, side="right")
            b = places - (ends[a] - (width - 1 - a)) + a + 1
            return pa.record_batch([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(sums / eras)], ["a", "b", "mean_corr"])

        for batch in batches:
            for i in range(batch.num_rows):
                tile, width, eras = (batch.column(c)[i].as_py() for c in ("tile", "width", "eras"))
                sums = batch.column("sums")[i].values.to_numpy()
                if held is not None and held[0] != tile:
                    yield listed(*held)
                    held = None
                held = (tile, width, eras, sums) if held is None else (tile, width, held[2] + eras, held[3] + sums)
        if held is not None:
            yield listed(*held)

    tiles = era_matrices(df, features).select("mean", "spread").mapInArrow(added, "tile long, width int, eras long, sums array<double>")
    return tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(mean, "a int, b int, mean_corr double")


def correlation_structure(
    df: DataFrame, features: str | Sequence[str], names: Sequence[str] | None = None
) -> DataFrame:
    """(feature_a, feature_b, mean_corr): equal-era mean of the score correlations."""
    names = list(names if names is not None else features)
    labels = F.array(*[F.lit(n) for n in names])
    return mean_correlations(df, features).select(
        F.get(labels, F.col("a")).alias("feature_a"),
        F.get(labels, F.col("b")).alias("feature_b"),
        "mean_corr",
    )


def top_pairs(pairs: DataFrame, count: int = 100) -> DataFrame:
    order = [F.desc(F.abs("mean_corr")), F.asc("feature_a"), F.asc("feature_b")]
    return pairs.orderBy(*order).limit(count)


def structure_summary(pairs: DataFrame) -> DataFrame:
    size = F.abs("mean_corr")
    return pairs.agg(
        F.avg(size).alias("mean_abs_corr"),
        F.percentile(size, 0.5).alias("p50_abs_corr"),
        F.percentile(size, 0.9).alias("p90_abs_corr"),
        F.count(F.lit(1)).alias("n_pairs"),
    )


def set_redundancy(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairwise size of correlation inside each feature set (feature_set, feature)."""
    known = pairs.select(F.col("feature_a").alias("feature")).union(pairs.select("feature_b")).distinct()
    members = sets.select("feature_set", "feature").distinct().join(known, "feature", "left_semi")
    sizes = sets.select("feature_set").distinct().join(
        members.groupBy("feature_set").agg(F.count(F.lit(1)).alias("n")), "feature_set", "left"
    )
    size = F.abs("mean_corr")
    inside = (
        pairs.join(members.withColumnRenamed("feature", "feature_a"), "feature_a")
        .join(members.withColumnRenamed("feature", "feature_b"), ["feature_set", "feature_b"])
        .groupBy("feature_set")
        .agg(
            F.avg(size).alias("mean_abs_corr"),
            F.percentile(size, 0.5).alias("median_abs_corr"),
            F.max(size).alias("max_abs_corr"),
            F.count(F.lit(1)).alias("n_pairs"),
        )
    )
    return sizes.join(inside, "feature_set", "left").select(
        "feature_set",
        F.coalesce("n", F.lit(0)).alias("n_features"),
        "mean_abs_corr", "median_abs_corr", "max_abs_corr",
        F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"),
    )


def set_sizes(sets: DataFrame) -> DataFrame:
    return sets.distinct().groupBy("feature_set").agg(F.count("feature").alias("n_features"))


# Features of one word of a set's bitmap, and blocks of names when all pairs are listed.
WORD_BITS, NAME_BLOCKS = 63, 64


def set_bitmaps(sets: DataFrame) -> DataFrame:
    """Sets as bitmaps: (feature_set, words, size, rarest). ``words`` maps the number of a
    word to its bits; ``rarest`` is the member that is in the fewest sets. Features are
    numbered by how often they occur, the rarest first, from running totals, so that
    neither the names nor a set's members meet in one row."""
    members = sets.select("feature_set", "feature").where(F.col("feature").isNotNull()).distinct()
    uses = members.groupBy("feature").agg(F.count(F.lit(1)).alias("uses"))
    key = F.concat(F.lpad(F.col("uses").cast("string"), 20, "0"), F.lit("|"), F.col("feature"))
    numbers = running_totals(
        uses.select("feature", key.alias("key"), F.lit(1).alias("one"), F.lit(0).alias("all")), ["all"], "key", {"number": "one"}
    )
    placed = members.join(numbers.select("feature", "number"), "feature")
    word, bit = F.floor(F.col("number") / WORD_BITS), F.pmod("number", F.lit(WORD_BITS)).cast("int")
    words = placed.groupBy("feature_set", word.cast("bigint").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("bits"),
        F.count(F.lit(1)).alias("n"), F.min("number").alias("least"),
    )
    return words.groupBy("feature_set").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"),
        F.sum("n").alias("size"), F.min("least").alias("rarest"),
    )


def contained_sets(sets: DataFrame) -> DataFrame:
    """(a, b): the pairs of different sets of which the first, not empty, is within the
    second. A set that holds another holds its rarest member, so candidates come from an
    equi-join on it; they are told apart by and-not of bitmaps."""
    maps = materialize(set_bitmaps(sets), "set-bitmaps")
    width = F.lit(WORD_BITS)
    bits = F.explode(F.map_entries("words")).alias("w")
    held = maps.select(F.col("feature_set").alias("b"), bits).select(
        "b", F.explode(F.transform(F.filter(F.sequence(F.lit(0), width - 1), lambda i: F.getbit(F.col("w.value"), i) == 1), lambda i: F.col("w.key") * width + i)).alias("rarest")
    )
    candidates = maps.select(F.col("feature_set").alias("a"), "size", "rarest").join(held, "rarest").where("a <> b")
    larger = maps.select(F.col("feature_set").alias("b"), F.col("words").alias("other"), F.col("size").alias("size_b"))
    both = candidates.join(larger, "b").where("size <= size_b").join(maps.select(F.col("feature_set").alias("a"), "words"), "a")
    missing = F.exists(
        F.map_entries("words"),
        lambda w: w["value"].bitwiseAND(F.bitwise_not(F.coalesce(F.col("other")[w["key"]], F.lit(0).cast("bigint")))) != 0,
    )
    return both.where(~missing).select("a", "b")


def set_subsets(sets: DataFrame) -> DataFrame:
    """For every ordered pair of sets: is the first contained in the second? The answer
    has a row per pair; names are dealt to blocks and paired block by block."""
    found = contained_sets(sets).withColumn("inside", F.lit(True))
    names = sets.groupBy("feature_set").agg(F.count("feature").alias("n"))
    block = F.pmod(F.xxhash64("feature_set"), F.lit(NAME_BLOCKS))
    left = names.select(F.col("feature_set").alias("a"), (F.col("n") == 0).alias("empty"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(NAME_BLOCKS - 1).cast("bigint"))).alias("block"))
    right = names.select(F.col("feature_set").alias("b"), block.alias("block"))
    pairs = left.join(right, "block").where("a <> b")
    return pairs.join(found, ["a", "b"], "left").select("a", "b", (F.coalesce("inside", F.lit(False)) | F.col("empty")).alias("a_subset_of_b"))


def era_pair_difference(df: DataFrame, features: str | Sequence[str], era_a: str, era_b: str) -> DataFrame:
    """Feature pairs whose correlation differs most between two eras."""
    c = pair_correlations(df.where(F.col("era").isin(era_a, era_b)), features)
    return c.groupBy("a", "b").agg(
        (
            F.max(F.when(F.col("era") == era_a, F.col("corr")))
            - F.max(F.when(F.col("era") == era_b, F.col("corr")))
        ).alias("difference")
    )
