"""Embedding run: stale songs, a user-supplied embedding service, checked replies, upsert."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from upswell.fixed_values import TEXT_BATCH
from upswell.operators import similarity, upserts
from upswell.plans.calls import ServiceUnavailable, tasks_for
from upswell.session import materialize, stages
from upswell.sources import tables

#: Called in a task with up to one batch of texts; returns the reply, one JSON text with
#: an index and a vector per text. Raises ``ServiceUnavailable`` when the service is down.
EmbedCall = Callable[[list[str]], "str | None"]

#: Texts whose vectors are stored together: what a killed run has to repeat at most.
WAVE_TEXTS = 100_000


def embed_texts(
    stale: DataFrame, embed: EmbedCall, size: int = TEXT_BATCH, calls_at_once: int | None = None
) -> DataFrame:
    """``song_id, source_text, embedding`` for every text, packed into batches per task.

    A batch counts only if its reply has every index once (``similarity.parse_vectors``);
    else its texts have NULL vectors and the next run finds them stale. After an outage a
    task calls no more. Replies are stored before use.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch_no, alive = TaskContext.get().partitionId() << 32, True
        for frame in frames:
            songs, texts = frame["song_id"].tolist(), frame["source_text"].tolist()
            parts = [slice(at, at + size) for at in range(0, len(texts), size)]
            raw = []
            for part in parts:
                reply = None
                if alive:
                    try:
                        reply = embed(texts[part])
                    except ServiceUnavailable:
                        alive = False
                raw.append(reply)
            # One frame out for each frame in: a frame for every batch costs more than the batch.
            yield pd.DataFrame(
                {
                    "batch_no": range(batch_no, batch_no + len(parts)),
                    "n": [len(texts[part]) for part in parts],
                    "songs": [songs[part] for part in parts],
                    "texts": [texts[part] for part in parts],
                    "raw": pd.Series(raw, dtype="object"),
                }
            )
            batch_no += len(parts)

    texts = stale.select("song_id", "source_text")
    tasks = tasks_for(texts, -(-texts.count() // size), calls_at_once)
    replies = materialize(
        texts.repartition(tasks, "song_id").mapInPandas(
            run, "batch_no bigint, n int, songs array<bigint>, texts array<string>, raw string"
        )
    )
    vectors = similarity.parse_vectors(replies.select("batch_no", "n", "raw"))
    sent = replies.select("batch_no", F.posexplode(F.arrays_zip("songs", "texts")).alias("index", "s"))
    return materialize(
        sent.join(vectors, ["batch_no", "index"], "left").select(
            F.col("s.songs").alias("song_id"), F.col("s.texts").alias("source_text"), "embedding"
        )
    )


def embedding_rows(vectors: DataFrame, model: str, run_at: Column, size: int | None = None) -> DataFrame:
    """Rows to store for the texts that got a vector; one of another ``size`` is an error."""
    vector = F.col("embedding")
    if size is not None:
        wrong = F.raise_error(F.format_string("song %d: a vector of %d values", "song_id", F.size(vector)))
        vector = F.when(F.size(vector) == size, vector).otherwise(wrong.cast("array<float>"))
    return vectors.where(F.col("embedding").isNotNull()).select(
        "song_id", vector.alias("embedding"), "source_text", F.lit(model).alias("model"), run_at.alias("updated_at")
    )


def run_embed(
    rows: DataFrame,
    stored: DataFrame,
    embed: EmbedCall,
    model: str,
    run_at: Column,
    size: int = TEXT_BATCH,
    calls_at_once: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The embedding table after the run, and a one-row summary."""
    stale = materialize(similarity.select_stale(rows, stored, model))
    vectors = embed_texts(stale, embed, size, calls_at_once)
    fresh = embedding_rows(vectors, model, run_at)
    table = upserts.update_all(stored, fresh, ["song_id"])
    return table, embed_summary(rows, vectors)


def embed_summary(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Songs, stale songs and embedded songs."""
    songs = rows.agg(F.count(F.lit(1))).scalar()
    return vectors.agg(
        F.count(F.lit(1)).alias("stale"), F.count("embedding").alias("embedded")
    ).select(songs.alias("songs"), "stale", "embedded")


def refresh_embeddings(
    spark: SparkSession,
    root: str,
    embed: EmbedCall,
    model: str,
    run_at: Column,
    size: int = TEXT_BATCH,
    calls_at_once: int | None = None,
    vector_size: int | None = None,
    wave_texts: int = WAVE_TEXTS,
) -> dict[str, int]:
    """Embeds the stale songs of the stored tables, wave by wave; returns the counts.

    Every wave is stored before the next one calls, so a run that is killed keeps what it
    paid for. A wave that got no vector ends the run. Only id ranges with new vectors are
    rewritten, and vectors of songs that are not stored are refused.
    """
    with stages(spark):
        at = tables.scan_tables(spark, root)
        rows = similarity.source_rows(
            at["songs"], at["song_artists"], at["artists"], at["song_tags"], at["tags"]
        )
        stale = materialize(similarity.select_stale(rows, at["song_embeddings"], model))
        summary = {"songs": at["songs"].count(), "stale": stale.count(), "embedded": 0}
        waves = max(1, -(-summary["stale"] // wave_texts))
        for wave in range(waves):
            due = stale.where(F.pmod(F.xxhash64("song_id"), F.lit(waves)) == wave)
            vectors = embed_texts(due, embed, size, calls_at_once)
            fresh = embedding_rows(vectors, model, run_at, vector_size)
            fresh = materialize(upserts.linked(fresh, at["songs"], "song_id", "id"))
            got = fresh.count()
            if not got:
                break
            part = tables.touched(spark, root, "song_embeddings", fresh)
            tables.write_table(upserts.update_all(part, fresh, ["song_id"]), root, "song_embeddings")
            summary["embedded"] += got
    return summary
