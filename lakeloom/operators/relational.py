"""Latest rows, version ranges, row numbers, as-of joins, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.runtime import materialize


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, which should be total; the rank-1 filter is cut short before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def valid_until(df: DataFrame, keys: list[str], start: str, ties: list[str], end: str) -> DataFrame:
    """df with the day before the next version's start; null for the last version."""
    following = F.lead(start).over(Window.partitionBy(*keys).orderBy(start, *ties))
    return df.withColumn(end, F.date_sub(following, 1))


def numbered(df: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """df with consecutive numbers (long) in a total order, without one task that sorts everything.

    Rows are dealt out by ranges and sorted inside each; a small table of range sizes gives each its offset.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    # The pair (partition, place) is fixed by writing it down: ranges come from a sample, so a second run could differ.
    placed = materialize(ranged.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("__part", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND((1 << 33) - 1))
    # One row per partition: no more than spark.sql.shuffle.partitions of them.
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    return placed.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__offset") + F.col("__at") + F.lit(first)).drop("__id", "__part", "__at", "__offset")


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, clamp: bool = True) -> DataFrame:
    """left with value of right's last row at or before at, per key. One union and one window, so no range join.

    Of rows of right with equal keys and at, the largest value counts. If clamp, rows before the first take the first's value.
    """
    cols = [c for c in left.columns if c not in keys and c != at]
    a = left.select(*keys, at, F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__value"), F.struct(*cols).alias("__row"))
    b = right.select(*keys, at, F.lit(0).alias("__side"), F.col(value).alias("__value"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"))
    order = Window.partitionBy(*keys).orderBy(at, "__side", "__value")
    known = F.last("__value", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    if clamp:
        known = F.coalesce(known, F.first("__value", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    return a.union(b).withColumn(value, known).filter("__side = 1").select(*keys, at, "__row.*", value)


def top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows of a total order: each task keeps k, and only those meet."""
    return df.orderBy(*order).limit(k)


def difference(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys of df that other doesn't have; null is a key like any other."""
    return df.select(*keys).subtract(other.select(*keys))


def is_subset(df: DataFrame, other: DataFrame, keys: list[str]) -> bool:
    """Whether other has all keys of df."""
    return difference(df, other, keys).isEmpty()
