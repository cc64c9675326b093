"""Reproducible folds and splits: rows are ordered by a hash of seed and id, never by chance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.labels import ANOMALOUS, NORMAL
from pulsegrid.operators.ordered import attach, positions
from pulsegrid.storage import durable


def shuffle_key(seed: int | str, *ids: str) -> Column:
    """Hash of seed and ids; the seed is a number or the name of a column."""
    first = F.col(seed).cast("string") if isinstance(seed, str) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", first, *[F.col(i).cast("string") for i in ids]))


def shuffled_rank(df: DataFrame, ids: Sequence[str], seed: int, keys: Sequence[str] = (), group_rows: int | None = None) -> DataFrame:
    """``rank``: 0-based place of a row among those of its class in hash order."""
    hashed = df.withColumn("_h", shuffle_key(seed, *ids))
    return positions(hashed, list(keys), ["_h", *ids], "rank", group_rows).drop("_h")


def stratified_folds(df: DataFrame, ids: Sequence[str], label: str, folds: int, seed: int, group_rows: int | None = None) -> DataFrame:
    """Fold number with every class spread evenly."""
    return shuffled_rank(df, ids, seed, [label], group_rows).withColumn("fold", (F.col("rank") % folds).cast("int")).drop("rank")


def plain_folds(df: DataFrame, ids: Sequence[str], folds: int, seed: int, group_rows: int | None = None) -> DataFrame:
    return shuffled_rank(df, ids, seed, [], group_rows).withColumn("fold", (F.col("rank") % folds).cast("int")).drop("rank")


def shuffled_split(
    df: DataFrame, ids: Sequence[str], train_ratio: float = 0.7, val_ratio: float = 0.15, seed: int = 42, group_rows: int | None = None
) -> DataFrame:
    """train / val by ratio of all rows, the rest test, whatever the labels."""
    ranked = shuffled_rank(df, ids, seed, [], group_rows)
    n = df.agg(F.count(F.lit(1))).scalar()
    train, val = F.floor(n * F.lit(float(train_ratio))), F.floor(n * F.lit(float(val_ratio)))
    part = F.when(F.col("rank") < train, "train").when(F.col("rank") < train + val, "val").otherwise("test")
    return ranked.withColumn("split", part).drop("rank")


def supervised_split(
    df: DataFrame, ids: Sequence[str], label: str = "label", train_ratio: float | str = 0.8, val_ratio: float = 0.2,
    seed: int | str = 42, keys: Sequence[str] = (), group_rows: int | None = None,
) -> DataFrame:
    """Train holds normal rows only; the other normal rows and the anomalies go to val and test per class.

    Unlabelled rows take no part. If the pool for val and test is too small to keep the class shares
    (below 5 rows, or a class with one row), it is split as a whole. ``keys`` repeat the split for
    each of several groups, such as seeds. The ratio of train is a number or the name of a column that is constant in a group.
    """
    by = list(keys) or ["_all_rows"]
    usable = df.where(F.col(label).isin(NORMAL, ANOMALOUS)).withColumn("_h", shuffle_key(seed, *ids))
    if not keys:
        usable = usable.withColumn("_all_rows", F.lit(0))
    ranked = positions(usable, [*by, label], ["_h", *ids], "_rank", group_rows)

    normal = F.col(label) == NORMAL
    ratio = F.max(train_ratio) if isinstance(train_ratio, str) else F.lit(float(train_ratio))
    train_size = F.when(normal, F.floor(F.col("_size") * F.col("_ratio"))).otherwise(0)
    sizes = usable.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_size"), ratio.alias("_ratio")).withColumn("_train", train_size)
    sizes = sizes.withColumn("_pool", F.col("_size") - F.col("_train"))
    pools = sizes.where("_pool > 0").groupBy(*by).agg(F.sum("_pool").alias("_pools"), F.min("_pool").alias("_least"))
    sizes = durable(attach(sizes, pools, by, ["_pools", "_least"]), "sizes")

    marked = attach(ranked, sizes, [*by, label], ["_train", "_pool", "_pools", "_least"])
    place = F.col("_rank") - F.col("_train")
    by_class = F.floor(F.col("_pool") * F.lit(float(val_ratio)))
    as_whole = F.when(F.col("_pools") > 1, F.least(F.greatest(F.lit(1), F.floor(F.col("_pools") * F.lit(float(val_ratio)))), F.col("_pools") - 1)).otherwise(0)
    place_in_whole = place + F.when(normal, 0).otherwise(F.col("_pools") - F.col("_pool"))
    val = F.when((F.col("_pools") >= 5) & (F.col("_least") >= 2), place < by_class).otherwise(place_in_whole < as_whole)
    split = F.when(place < 0, "train").when(val, "val").otherwise("test")
    return marked.withColumn("split", split).select(*df.columns, "split")


def first_rows(df: DataFrame, order: Sequence[str], count: int | None) -> DataFrame:
    """The first ``count`` rows in order; all of them without a count."""
    return df if not count else df.orderBy(*order).limit(count)


def row_overlap(windows: DataFrame, size: int, stride: int, keys: Sequence[str] = (), win: str = "win_id") -> DataFrame:
    """Rows that windows of different splits share, as (split_a, split_b, shared_rows).

    Windows are given as (keys, win_id, split); window i covers rows i*stride .. i*stride+size-1. A row
    is shared by two splits if windows of both cover it, which one grouping by row decides.
    """
    covered = windows.withColumn(
        "_row", F.explode(F.sequence(F.col(win) * stride, F.col(win) * stride + size - 1))
    ).groupBy(*keys, "_row").agg(F.array_sort(F.collect_set("split")).alias("_splits"))
    pairs = covered.where(F.size("_splits") > 1).withColumn("_a", F.explode("_splits")).withColumn("_b", F.explode("_splits"))
    return (
        pairs.where("_a < _b").groupBy(F.col("_a").alias("split_a"), F.col("_b").alias("split_b"))
        .agg(F.count(F.lit(1)).alias("shared_rows"))
    )


def shared_values(train: DataFrame, test: DataFrame, value: str) -> DataFrame:
    """Distinct values that occur on both sides."""
    return train.select(value).intersect(test.select(value))
