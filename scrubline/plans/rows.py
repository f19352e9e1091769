"""Row identity, order and carrying values along it, without moving all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrubline.functions import columns as c
from scrubline.plans.registry import ROW_ID

#: Rows of one block when values are carried along the row order.
BLOCK_ROWS = 100_000
#: Keys of a mapping up to which it is broadcast.
BROADCAST_KEYS = 100_000


def with_row_id(df: DataFrame, name: str = ROW_ID) -> DataFrame:
    """df with consecutive row numbers from 0 in the order of its partitions.

    One small job counts the rows of each partition; the offsets are one number a
    partition. df must give the same partitions each time it is read, as scans do.
    """
    if name in df.columns:
        return df
    place = F.bitwise_and(F.monotonically_increasing_id(), F.lit(2**33 - 1)) if hasattr(F, "bitwise_and") else F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    counted = df.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
    offsets, total = [], 0
    by_part = {r.p: r.n for r in counted}
    for part in range(max(by_part, default=-1) + 1):
        offsets.append(total)
        total += by_part.get(part, 0)
    if not offsets:
        return df.withColumn(name, place)
    return df.withColumn(name, F.get(F.array(*(F.lit(x).cast("bigint") for x in offsets)), F.spark_partition_id()) + place)


def head(df: DataFrame, n: int, name: str = ROW_ID) -> DataFrame:
    """The first n rows in row order."""
    return df.filter(F.col(name) < n)


def carry(df: DataFrame, column: str, backward: bool = False, order: str = ROW_ID, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df with nulls of column filled by the last value before them in the order, or the next one behind.

    Rows are carried inside blocks of the order; then only one value for each block
    is carried along the blocks.
    """
    block = F.floor(F.col(order) / block_rows)
    step = F.desc if backward else F.asc
    inside = Window.partitionBy("_block").orderBy(step(order)).rowsBetween(Window.unboundedPreceding, 0)
    col = F.col(f"`{column}`")
    blocked = df.withColumn("_block", block)
    ends = blocked.filter(col.isNotNull()).groupBy("_block").agg((F.min_by if backward else F.max_by)(col, order).alias("_end"))
    along = Window.orderBy(step("_block")).rowsBetween(Window.unboundedPreceding, -1)
    every = blocked.select("_block").distinct().join(ends, "_block", "left")
    carried = every.select("_block", F.last("_end", ignorenulls=True).over(along).alias("_carried"))
    filled = blocked.withColumn(column, F.last(col, ignorenulls=True).over(inside)).join(carried, "_block", "left")
    return filled.withColumn(column, F.coalesce(col, F.col("_carried"))).drop("_block", "_carried")


def lookup_values(df: DataFrame, column: str, table: DataFrame, fold: bool = False) -> DataFrame:
    """df with values of column replaced by those of table (from_value, to_value); a join, for mappings too large for a plan.

    fold compares without letter case and blanks at the ends. to_value may be null;
    of several rows for one value any counts, so there should be one.
    """
    same = c.key if fold else lambda x: x
    found = table.select(same(F.col("from_value").cast("string")).alias("_from"), F.col("to_value").alias("_to"), F.lit(True).alias("_hit")).dropDuplicates(["_from"])
    joined = df.join(found, same(F.col(f"`{column}`").cast("string")) == F.col("_from"), "left")
    return joined.withColumn(column, F.when(F.col("_hit"), F.col("_to")).otherwise(F.col(f"`{column}`").cast("string"))).drop("_from", "_to", "_hit")


def map_values(df: DataFrame, column: str, mapping: dict, fold: bool = False) -> DataFrame:
    """df with values of column replaced by a mapping of any size, which goes to the tasks as a table."""
    pairs = {(str(k).strip().casefold() if fold else str(k)): None if v is None else str(v) for k, v in mapping.items()}
    table = df.sparkSession.createDataFrame(list(pairs.items()), "from_value string, to_value string")
    # Up to that many keys the table is small enough for every task; beyond, both sides are shuffled by the value.
    return lookup_values(df, column, F.broadcast(table) if len(pairs) <= BROADCAST_KEYS else table, fold)
