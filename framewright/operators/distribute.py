"""Building blocks that keep hot keys and global orders out of single tasks."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.session import cut

#: Of the most frequent keys so many at most, each of more than HOT_ROWS rows, are joined by broadcast: every key
#: that holds 1 / HOT_KEYS of the rows or more is among them.
HOT_KEYS, HOT_ROWS = 200, 20_000


def hot_keys(counts: DataFrame, key: str, n: str) -> list:
    """The hot keys of a table with one row per key and its number of rows n; null is none."""
    top = counts.where(F.col(key).isNotNull() & (F.col(n) > HOT_ROWS)).select(key, n)
    return [r[0] for r in top.orderBy(F.col(n).desc(), key).limit(HOT_KEYS).collect()]


def join_unique(big: DataFrame, unique: DataFrame, key: str, how: str = "left", hot: list | None = None) -> DataFrame:
    """Join big to unique (one row per key) when a few keys may hold most rows of big.

    Rows of hot keys meet their partner by broadcast (at most HOT_KEYS rows of unique are hot, so the broadcast is
    bounded); the rest is an ordinary join. Null keys match nothing. how: left or inner. hot: the hot keys, if
    the caller knows them (hot_keys); otherwise one job counts the keys of big.
    """
    if hot is None:
        hot = hot_keys(big.groupBy(key).agg(F.count("*").alias("_n")), key, "_n")
    if not hot:
        return big.join(unique, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return big.where(~is_hot).join(unique, key, how).unionByName(
        big.where(is_hot).join(F.broadcast(unique.where(F.col(key).isin(hot))), key, how)
    )


def small(df: DataFrame, at_most: int = 100_000) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, else as it is. It is counted, so it should be cut."""
    return F.broadcast(df) if df.limit(at_most + 1).count() <= at_most else df


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with the 0-based position of each row in a total order, without a single-task window.

    The rows are range-partitioned and sorted; a row's rank is its place in the partition plus the sizes of
    the partitions before (one number per partition goes through the driver). Give order a unique tail,
    so that equal keys can be divided among partitions.
    """
    sorted_ = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = sorted_.withColumn("_id", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_id", 33))
    before, offsets = 0, []
    for p, n in sorted((r["_p"], r["n"]) for r in placed.groupBy("_p").agg(F.count("*").alias("n")).collect()):
        offsets.append((p, before))
        before += n
    start = df.sparkSession.createDataFrame(offsets, "_p bigint, _start bigint")
    out = placed.join(F.broadcast(start), "_p").withColumn(name, F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1))
    return out.drop("_p", "_id", "_start")


def prefix_sum(df: DataFrame, order: list[Column], weight: str, name: str = "upto") -> DataFrame:
    """df with the running sum of weight (the row included) in a total order; weights are not null.

    Partial sums per range partition are added up on the driver, one number a partition.
    """
    sorted_ = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    before, offsets = 0, []
    for p, n in sorted((r["_p"], r["n"]) for r in sorted_.groupBy("_p").agg(F.sum(weight).alias("n")).collect()):
        offsets.append((p, before))
        before += n
    kind = dict(sorted_.dtypes)[weight]
    if kind.startswith("decimal"):
        offsets = [(p, Decimal(n)) for p, n in offsets]
    start = df.sparkSession.createDataFrame(offsets, f"_p int, _start {kind if kind == 'double' or kind.startswith('decimal') else 'bigint'}")
    within = F.sum(weight).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return sorted_.withColumn("_in", within).join(F.broadcast(start), "_p").withColumn(name, F.col("_start") + F.col("_in")).drop("_p", "_in", "_start")
