"""Streaming forms of the daily collection. Every job stops once its input is read."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from upswell.fixed_values import METRIC_SOURCE
from upswell.operators import catalogue, upserts, weekly
from upswell.plans.collect import upsert_day
from upswell.schemas import ID_RANGE, METRIC_PAGE
from upswell.session import materialize, stages
from upswell.sources import landed, tables

#: Ranges of keys that are no whole numbers.
HASH_RANGES = 64


def stream_metrics(
    spark: SparkSession, root: str, pages: str, metric_date: dt.date, checkpoint: str
) -> StreamingQuery:
    """Landed metric pages into the daily table, file by file, as they arrive.

    Each micro-batch is an idempotent upsert, so a batch run twice after a failure
    changes nothing.
    """
    targets = catalogue.metric_targets(tables.scan(spark, root, "songs"))

    def merge(batch: DataFrame, _: int) -> None:
        readings = landed.metric_readings(batch)
        rows = catalogue.metric_rows(targets, readings, F.lit(metric_date), METRIC_SOURCE)
        # Read twice below, for its days and for its rows.
        rows = rows.persist()
        upsert_day(batch.sparkSession, root, rows)
        rows.unpersist()

    arriving = spark.readStream.schema(METRIC_PAGE).option("mode", "FAILFAST").json(pages)
    # Within one micro-batch the later file wins.
    arriving = arriving.withColumn("page_file", F.col("_metadata.file_path"))
    return (
        arriving.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


_COUNTS = "song_id bigint, n bigint, batch bigint, week date"


def add_counts(stored: DataFrame, fresh: DataFrame, batch_id: int) -> DataFrame:
    """Stored weekly counts with those of one micro-batch added, each row once.

    ``batch`` is the last micro-batch that a row has in its count: a batch that runs again
    after a failure finds its number there and adds nothing.
    """
    add = fresh.select("song_id", "week", F.col("n").alias("_add"))
    due = F.col("_add").isNotNull() & F.coalesce(F.col("batch") < batch_id, F.lit(True))
    return stored.join(add, ["song_id", "week"], "full").select(
        "song_id",
        (F.coalesce("n", F.lit(0)) + F.when(due, F.col("_add")).otherwise(0)).cast("bigint").alias("n"),
        F.when(due, F.lit(batch_id)).otherwise(F.col("batch")).cast("bigint").alias("batch"),
        "week",
    )


def stream_deriv_weekly(derived: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keeps a table of new derived works per original and Monday week up to date with the stream.

    The table is the only state: a micro-batch is counted by (original, week) and added to
    the weeks it falls in, which alone are read and rewritten. So a row may be late by any
    time and still amends its week, as in the batch count, and nothing is kept in memory
    from one micro-batch to the next. ``out`` belongs to one ``checkpoint``.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with stages(spark):
            # A hot original is folded in the map tasks.
            fresh = materialize(weekly.deriv_counts(batch))
            weeks = [row[0] for row in fresh.select("week").distinct().collect()]
            stored = spark.read.schema(_COUNTS).parquet(out).where(F.col("week").isin(weeks))
            tables.write_partitioned(materialize(add_counts(stored, fresh, batch_id)), out, ["week"])

    derived.sparkSession.createDataFrame([], _COUNTS).write.mode("append").partitionBy("week").parquet(out)
    return (
        derived.select("original_song_id", "discovered_at")
        .writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def key_range(schema: T.StructType, key: str) -> Column:
    """Where a key's rows are stored: by ranges of a whole number, by a hash of anything else."""
    if isinstance(schema[key].dataType, T.IntegralType):
        return F.expr(f"`{key}` div {ID_RANGE}").cast("bigint")
    return F.pmod(F.xxhash64(key), F.lit(HASH_RANGES)).cast("bigint")


def stream_dedupe_links(
    links: DataFrame, keys: list[str], at: str, out: str, checkpoint: str
) -> StreamingQuery:
    """Keeps a table with the first arrival of every link, one row per key for ever.

    Each micro-batch adds the keys that the table does not hold, whatever their age, so a
    batch run twice after a failure adds nothing. The table is laid out by ranges of the
    first key: of the stored rows only the keys in the ranges of the batch are read.
    """
    schema = links.schema
    stored_schema = T.StructType([*schema.fields, T.StructField("key_range", T.LongType())])
    place = key_range(schema, keys[0])

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys]
        with stages(spark):
            first = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(at)).alias("_first"))
            first = materialize(first.select(*keys, "_first.*").select(*batch.columns).withColumn("key_range", place))
            ranges = [row[0] for row in first.select("key_range").distinct().collect()]
            stored = spark.read.schema(stored_schema).parquet(out).where(F.col("key_range").isin(ranges))
            # Stored first: the write adds files to the folder that it is computed from.
            fresh = materialize(upserts.new_rows(stored, first, keys))
            fresh.select(stored_schema.names).hint("rebalance", "key_range").write.mode("append").partitionBy("key_range").parquet(out)

    links.sparkSession.createDataFrame([], stored_schema).write.mode("append").partitionBy("key_range").parquet(out)
    return (
        links.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
