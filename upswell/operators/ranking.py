"""Top-k, exact global ranks and fixed-size batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from upswell.session import materialize


def top_n(df: DataFrame, n: int, *order: Column, rank: str = "rank") -> DataFrame:
    """First ``n`` rows in ``order`` with their 1-based rank.

    The limit keeps ``n`` rows per task before anything moves; the rank window
    then sees ``n`` rows.
    """
    first = df.orderBy(*order).limit(n)
    return first.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def top_n_per(df: DataFrame, keys: list[str], n: int, *order: Column, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of every key. Spark limits each group before the shuffle."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(rank) <= n)


def global_rank(df: DataFrame, *order: Column, rank: str = "rank") -> DataFrame:
    """Exact 1-based rank of every row, without bringing the rows into one task.

    ``order`` must be total. Rows are range-partitioned and sorted; a row's rank is
    its place in its partition plus the sizes of the partitions before. Only those
    sizes, one per partition, meet in one place. The placed rows are materialised,
    because a second range partitioning could cut elsewhere.
    """
    placed = materialize(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    placed = placed.select(
        "*",
        F.shiftright("_place", 33).alias("_part"),
        F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"),
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    # One row per range partition, so at most spark.sql.shuffle.partitions rows.
    ranked = placed.join(F.broadcast(starts), "_part")
    return ranked.withColumn(rank, F.col("_start") + F.col("_row") + 1).drop(
        "_place", "_part", "_row", "_size", "_start"
    )


def batches(df: DataFrame, size: int, *order: Column) -> DataFrame:
    """Adds ``batch_no`` (from 0) and ``pos`` (from 1 within the batch) in ``order``."""
    at = F.col("_rank") - 1
    return (
        global_rank(df, *order, rank="_rank")
        .withColumn("batch_no", F.floor(at / size).cast("bigint"))
        .withColumn("pos", (at % size + 1).cast("int"))
        .drop("_rank")
    )
