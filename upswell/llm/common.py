"""Expressions and steps that several of the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from upswell.session import materialize

#: ASCII letters: the operators fold these only, never other alphabets.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def set_aside(df: DataFrame, taken: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], list[Column]]]:
    """``df`` with its columns of the ``taken`` names renamed, and their old names again.

    An operator that keeps all columns adds some of its own for a while; a column of the
    same name in the input must neither be lost nor be taken for the operator's.
    """
    own = {c.lower() for c in df.columns}
    used = {c.lower() for c in taken}
    names = {}
    for c in df.columns:
        new = c
        while new.lower() in used or (new != c and new.lower() in own):
            new += "_"
        names[c] = new
        own.add(new.lower())

    def back(result: DataFrame) -> list[Column]:
        return [result[f"`{new}`"].alias(old) for old, new in names.items()]

    return df.toDF(*names.values()), back


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def null_last(column: Column) -> Column:
    """A key that is never NULL, sorts by code point, and sorts NULL after every text."""
    return F.when(column.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), column.cast("string")))


def partitions_for(total_bytes: int | None, bytes_each: int, at_least: int = 1) -> int:
    """Partitions of about ``bytes_each`` for ``total_bytes``."""
    return max(at_least, -(-int(total_bytes or 0) // bytes_each))


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_total(df: DataFrame, groups: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``value`` summed over the rows of a group up to and including each row.

    No group has to fit into a task: rows are range-partitioned by (groups, order) and
    summed inside each partition, and only one sum per partition and group meets with
    the sums of the partitions before. ``order`` must be total inside a group and group
    columns must not be NULL. The placed rows are written once, as a second range
    partitioning could cut elsewhere.
    """
    keys = [F.col(c) for c in [*groups, *order]]
    placed = materialize(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_place", 33))
    inside = Window.partitionBy("_part", *groups).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("_local", F.sum(value).over(inside))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part", *groups)
        .agg(F.sum(value).alias("_sum"))
        .select("_part", *groups, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    )
    return local.join(offsets, ["_part", *groups]).select(
        *df.columns, (F.col("_local") + F.col("_before")).alias(out)
    )
