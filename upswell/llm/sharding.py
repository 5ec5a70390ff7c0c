"""A global shuffle in two passes, and the shards cut from it."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upswell.llm.common import partitions_for, set_aside
from upswell.session import materialize

#: Rows that repeat a key more often than this are dealt over several buckets.
HOT_ROWS = 1000


def record_bytes() -> Column:
    """What a record takes: the UTF-8 bytes of its text and 8 more."""
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.lit(8)


def shuffled_shards(
    docs: DataFrame,
    shards: int = 24,
    seed: int = 0,
    bucket_bytes: int = 32 << 20,
    least_buckets: int = 32,
) -> DataFrame:
    """``docs`` with shard and slot: a seeded random order of all rows, cut into shards.

    Pass one scatters whole records by a seeded hash of their doc_id into buckets of about
    ``bucket_bytes``. Pass two gives each bucket a Fisher-Yates shuffle in memory. Buckets
    follow each other in the order of their numbers; the order of all rows is cut into
    ``shards`` runs whose row counts differ by one at most. slot counts from 0 in a shard.

    Texts move once. Partition ``n`` of the result is bucket ``n`` in its new order, so
    files written from it hold the shards one after another. Where a bucket starts is
    known from a scan of the keys: 8 bytes per bucket come to the driver.

    The order depends on the rows, the seed and the number of buckets, which follows from
    the bytes of all records: a bucket is sorted by content before it is shuffled, so a lost
    executor's bucket comes out the same again. Rows that repeat a doc_id (NULL included)
    over ``HOT_ROWS`` times are dealt over buckets by their content; of those that are equal
    in every column one travels with their number, and its copies are dealt out again.

    All columns stay; shard and slot replace columns of these names. An empty table gives
    no rows. A single text may be larger than ``bucket_bytes``; it then is a bucket's bulk.
    """
    own = ["shard", "slot", "_hot", "_key", "_copies", "_turn", "_bucket", "_order"]
    kept, back = set_aside(docs.drop("shard", "slot"), own)
    total = kept.agg(F.sum(record_bytes())).first()[0]
    buckets = partitions_for(total, bucket_bytes, least_buckets)
    bucket_of = lambda *salt: F.pmod(F.xxhash64(F.lit(seed), "doc_id", *salt), F.lit(buckets)).cast("int")

    plain = kept.withColumn("_bucket", bucket_of())
    ids = kept.groupBy(F.col("doc_id").alias("_hot")).agg(F.count(F.lit(1)).alias("_copies"))
    hot = materialize(ids.where(F.col("_copies") > HOT_ROWS).select("_hot"))
    if not hot.isEmpty():
        is_hot = F.col("doc_id").eqNullSafe(F.col("_hot"))
        key = F.md5(F.to_json(F.struct(*kept.columns)))
        keyed = kept.join(hot, is_hot, "left_semi").withColumn("_key", key)
        copies = materialize(keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_copies")).where(F.col("_copies") > HOT_ROWS))
        single = keyed.join(copies, "_key", "left_anti")
        # Folded in the map tasks: one row per task and key moves.
        folded = keyed.join(copies.select("_key"), "_key", "left_semi").groupBy("_key").agg(
            *[F.first(c).alias(c) for c in kept.columns]
        )
        again = folded.join(copies, "_key").withColumn("_turn", F.explode(F.sequence(F.lit(1), "_copies")))
        plain = (
            plain.join(hot, is_hot, "left_anti")
            .unionByName(single.withColumn("_bucket", bucket_of("_key")).drop("_key"))
            .unionByName(again.withColumn("_bucket", bucket_of("_key", "_turn")).drop("_key", "_turn", "_copies"))
        )

    sizes = np.zeros(buckets, np.int64)
    for row in plain.groupBy("_bucket").count().toLocalIterator():
        sizes[row[0]] = row[1]
    # Nested columns do not sort in Arrow: their text does.
    nested = [c for c, kind in kept.dtypes if kind.startswith(("array", "map", "struct", "variant"))]
    ordered = plain.withColumn("_order", F.to_json(F.struct(*nested)) if nested else F.lit(""))
    result = T.StructType([*ordered.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    dealt = ordered.repartitionById(buckets, F.col("_bucket")).mapInArrow(_fisher_yates(seed, shards, sizes, nested), result)
    return dealt.select(*back(dealt), "shard", "slot")


def _fisher_yates(seed: int, shards: int, sizes: np.ndarray, nested: list[str]):
    starts = np.concatenate([[0], np.cumsum(sizes)])
    # The first ``larger`` shards have one row more than the others.
    rows, larger = divmod(int(starts[-1]), shards)
    cuts = np.arange(shards + 1) * rows + np.minimum(np.arange(shards + 1), larger)

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        bucket = pa.Table.from_batches(held).combine_chunks()
        number = bucket["_bucket"][0].as_py()
        # A defined order first, then the shuffle.
        names = sorted(n for n in bucket.column_names if n not in nested)
        order = pc.sort_indices(bucket, sort_keys=[(n, "ascending") for n in names]).to_numpy().copy()
        np.random.default_rng([seed, number]).shuffle(order)  # NumPy's is the Fisher-Yates shuffle
        place = starts[number] + np.arange(len(order))
        shard = np.searchsorted(cuts, place, side="right") - 1
        slot = place - cuts[shard]
        # Slices bound what is copied at once.
        for at in range(0, len(order), 1024):
            part = bucket.take(pa.array(order[at : at + 1024])).combine_chunks()
            for name, value in (("shard", pa.array(shard[at : at + 1024], pa.int32())), ("slot", pa.array(slot[at : at + 1024]))):
                part = part.append_column(name, value)
            yield from part.to_batches()

    return shuffle


def write_shards(docs: DataFrame, path: str, **how) -> None:
    """Writes the shards below ``path``, one folder each, rows in the order of their slots.

    A task has one bucket, which lies in one shard or a few neighbouring ones: nothing
    moves again, and the files of a folder follow each other by name.
    """
    placed = shuffled_shards(docs, **how).sortWithinPartitions("shard", "slot")
    placed.write.partitionBy("shard").mode("overwrite").parquet(path)
