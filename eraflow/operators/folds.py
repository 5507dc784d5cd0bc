"""Time splits as tables of (fold, role, era). Everything here runs on the table of
eras (one row per era); panels are joined to the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PURGE_20D, PURGE_60D = 8, 16


def _placed(eras: DataFrame) -> DataFrame:
    whole = Window.partitionBy()
    return (
        eras.select("era", "era_num").distinct()
        .withColumn("i", F.row_number().over(Window.orderBy("era_num")) - 1)
        .withColumn("n", F.count(F.lit(1)).over(whole).cast("int"))
    )


def _require(condition: Column, value: Column, message: str) -> Column:
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)).cast("int"))


def walk_forward(eras: DataFrame, n_folds: int, purge: int) -> DataFrame:
    """Expanding train windows before consecutive validation blocks of equal size; the
    ``purge`` eras right before a block belong to neither side."""
    placed = _placed(eras)
    size = F.floor(F.col("n") / (n_folds + 1)).cast("int")
    start = F.col("n") - n_folds * size + F.col("fold") * size
    rows = placed.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    enough = (size >= 1) & (F.col("n") - n_folds * size - purge >= 1)
    rows = rows.withColumn("start", _require(enough, start, "too few eras for the folds and purge"))
    role = F.when((F.col("i") >= F.col("start")) & (F.col("i") < F.col("start") + size), "val").when(
        F.col("i") < F.col("start") - purge, "train"
    )
    return rows.select("fold", role.alias("role"), "era", "era_num").where("role is not null")


def anchor(eras: DataFrame, purge: int) -> DataFrame:
    """A single fold: the later half validates, the earlier half minus the purge trains."""
    return walk_forward(eras, 1, purge)


def grouped_time_folds(eras: DataFrame, n_folds: int) -> DataFrame:
    return walk_forward(eras, n_folds, 0)


def fold_violations(folds: DataFrame, eras: DataFrame, purge: int) -> DataFrame:
    """Folds that break an invariant: a side without eras, train not strictly before
    validation, an era on both sides, or a purge gap of the wrong width. Empty = good."""
    train = F.col("role") == "train"
    val = F.col("role") == "val"
    sides = folds.groupBy("fold").agg(
        F.count_if(train).alias("n_train"),
        F.count_if(val).alias("n_val"),
        F.max(F.when(train, F.col("era_num"))).alias("train_max"),
        F.min(F.when(val, F.col("era_num"))).alias("val_min"),
        (F.count(F.lit(1)) - F.count_distinct("era")).alias("n_shared"),
    )
    placed = _placed(eras).select("era_num", "i")
    ends = placed.select(F.col("era_num").alias("train_max"), F.col("i").alias("last"))
    starts = placed.select(F.col("era_num").alias("val_min"), F.col("i").alias("first"))
    gaps = sides.join(ends, "train_max", "left").join(starts, "val_min", "left").select(
        *sides.columns, (F.col("first") - F.col("last") - 1).cast("bigint").alias("gap")
    )
    ordered = F.coalesce(F.col("train_max") < F.col("val_min"), F.lit(False))
    good = (
        (F.col("n_train") > 0) & (F.col("n_val") > 0) & (F.col("n_shared") == 0) & ordered
        & (F.col("gap") == purge)
    )
    return gaps.where(~F.coalesce(good, F.lit(False)))


def purged_split(train_eras: DataFrame, val_eras: DataFrame, purge: int) -> DataFrame:
    """One-shot split: the last ``purge`` train eras are dropped, and exactly that many
    numbers must then separate both sides."""
    train = _placed(train_eras).where(F.col("i") < F.col("n") - purge).select(
        F.lit("train").alias("role"), "era", "era_num"
    )
    val = val_eras.select(F.lit("val").alias("role"), "era", "era_num").distinct()
    both = train.unionByName(val)
    whole = Window.partitionBy()
    last = F.max(F.when(F.col("role") == "train", F.col("era_num"))).over(whole)
    first = F.min(F.when(F.col("role") == "val", F.col("era_num"))).over(whole)
    return both.withColumn(
        "era_num",
        _require(first - last - 1 == purge, F.col("era_num"), "the purge gap has the wrong width"),
    )


def held_out(eras: DataFrame, fraction: float, purge: int) -> DataFrame:
    """Roles train / purge / held_out: the last share of eras (rounded half to even, at
    least one) is held out; purging counts era numbers below the first held-out one."""
    placed = _placed(eras)
    count = F.greatest(F.bround(F.col("n") * F.lit(fraction), 0).cast("int"), F.lit(1))
    marked = placed.withColumn("held", F.col("i") >= F.col("n") - count)
    first = F.min(F.when(F.col("held"), F.col("era_num"))).over(Window.partitionBy())
    role = (
        F.when(F.col("held"), "held_out")
        .when((F.col("era_num") >= first - purge) & (F.col("era_num") < first), "purge")
        .otherwise("train")
    )
    return marked.select(role.alias("role"), "era", "era_num")


def stack_partitions(eras: DataFrame, meta_share: float, any_60d: bool) -> DataFrame:
    """Roles specialist / purge / meta for a two-layer stack."""
    purge = PURGE_60D if any_60d else PURGE_20D
    placed = _placed(eras)
    meta = F.greatest(F.bround(F.col("n") * F.lit(meta_share), 0).cast("int"), F.lit(1))
    left = F.col("n") - meta - purge
    role = (
        F.when(F.col("i") >= F.col("n") - meta, "meta")
        .when(F.col("i") >= left, "purge")
        .otherwise("specialist")
    )
    checked = placed.withColumn("i", _require(left >= 2, F.col("i"), "too few eras for the stack"))
    return checked.select(role.alias("role"), "era", "era_num")


def purge_floor(targets: list[str]) -> int:
    return PURGE_60D if any(t.endswith("_60") for t in targets) else PURGE_20D


def require_purge(eras: DataFrame, targets: list[str], purge: int, n_eras: int | None = None) -> None:
    """Once there are enough eras, the purge must cover the longest target horizon.
    ``n_eras`` is their number, where the caller knows it."""
    floor = purge_floor(targets)
    if purge < floor:
        n_eras = eras.select("era").distinct().count() if n_eras is None else n_eras
        if n_eras >= 2 * floor:
            raise ValueError(f"purge of {purge} eras is below the {floor} the targets need")


def purge_end(train_nums: list[int], val_nums: list[int], purge: int) -> int:
    """The last train era number after the purge; on both sides of the gap exactly
    ``purge`` numbers must be missing."""
    kept, scored = sorted(train_nums)[: len(train_nums) - purge], sorted(val_nums)
    if not kept or not scored or scored[0] - kept[-1] - 1 != purge:
        raise ValueError("the purge gap has the wrong width")
    return kept[-1]


def weight_learning_roles(folds: DataFrame) -> DataFrame:
    """Validation eras of every fold but the last learn blend weights; the last scores."""
    val = folds.where("role = 'val'")
    last = F.max("fold").over(Window.partitionBy())
    return val.select(
        F.when(F.col("fold") < last, "learn").otherwise("score").alias("role"), "era", "era_num"
    )
