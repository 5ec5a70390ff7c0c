"""Work queue, vocabulary and prompts of the canonicalization run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upswell.fixed_values import SEED_VOCAB, TAG_BATCH, UNRESOLVED, WORK_LIMIT
from upswell.functions.scores import confirmed_canon
from upswell.operators.ranking import batches, top_n


def usage_counts(tags: DataFrame, song_tags: DataFrame) -> DataFrame:
    """Unresolved tags and how often songs carry them; unused tags have 0.

    Links are counted per tag before the join, so a tag on very many songs moves
    as one row per task.
    """
    uses = song_tags.groupBy(F.col("tag_id").alias("id")).agg(F.count(F.lit(1)).alias("_uses"))
    open_tags = tags.where(F.col("canon_status").isin(*UNRESOLVED)).select("id", "name")
    return open_tags.join(uses, "id", "left").select(
        "id", "name", F.coalesce("_uses", F.lit(0)).alias("uses")
    )


def work_queue(tags: DataFrame, song_tags: DataFrame, limit: int = WORK_LIMIT) -> DataFrame:
    """Most used unresolved tags first, in batches: ``batch_no, pos, id, name, uses``."""
    queue = top_n(usage_counts(tags, song_tags), limit, F.desc("uses"), F.asc("id"), rank="_rank")
    at = F.col("_rank") - 1
    return queue.select(
        F.floor(at / TAG_BATCH).cast("bigint").alias("batch_no"),
        (at % TAG_BATCH + 1).cast("int").alias("pos"),
        "id",
        "name",
        "uses",
    )


def full_queue(tags: DataFrame, song_tags: DataFrame, size: int = TAG_BATCH) -> DataFrame:
    """As ``work_queue`` without a limit, for any number of tags."""
    return batches(usage_counts(tags, song_tags), size, F.desc("uses"), F.asc("id"))


def confirmed_terms(tags: DataFrame) -> DataFrame:
    """Distinct canonical names confirmed so far."""
    known = tags.where(confirmed_canon(F.col("canon_status"), F.col("canon_name")))
    return known.select(F.col("canon_name").alias("term")).distinct()


def vocabulary(tags: DataFrame, seed: Sequence[str] = SEED_VOCAB) -> DataFrame:
    """Allowed terms: the seed and everything confirmed."""
    # An exploded literal stays a local row, unlike a DataFrame built from Python data.
    start = tags.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, seed))).alias("term"))
    return confirmed_terms(tags).union(start).distinct()


def vocabulary_json(vocab: DataFrame) -> Column:
    """The vocabulary as one sorted JSON array, for use as a value in other frames.

    A prompt carries the whole vocabulary by definition, so it fits one value.
    """
    return vocab.agg(F.to_json(F.array_sort(F.collect_set("term")))).scalar()


def batch_payload(work: DataFrame) -> DataFrame:
    """One row per batch: its items in order, as an array and as the JSON to send."""
    grouped = work.groupBy("batch_no").agg(
        F.array_sort(F.collect_list(F.struct("pos", "id", "name"))).alias("items")
    )
    payload = F.to_json(
        F.transform("items", lambda i: F.struct(i["id"].alias("id"), i["name"].alias("name")))
    )
    return grouped.withColumn("payload", payload)
