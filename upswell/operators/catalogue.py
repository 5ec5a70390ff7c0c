"""Song documents to catalogue tables, and their idempotent merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upswell.fixed_values import NICO_SERVICE, YOUTUBE_SERVICE
from upswell.functions.documents import artist_role, parse_date, pick_pv
from upswell.operators import upserts
from upswell.schemas import KEYS


def _filled(record: Column, *fields: str) -> Column:
    """A record that is there and has anything in it."""
    return reduce(lambda a, b: a | b, [record[f].isNotNull() for f in fields])


def _required(value: Column, what: str) -> Column:
    return F.coalesce(value, F.raise_error(F.lit(f"landed page: {what}")))


def bundles(items: DataFrame, item: str = "item") -> DataFrame:
    """One row per song document: song columns, artist links, tag links, original.

    All work is row-local. Credits without an artist record and tags without a record,
    or with an empty one, are left out; an original id of 0 counts as none. A document,
    artist or tag without an id, or a document without a name, fails the read.
    """
    doc = F.col(item)
    artists = F.transform(
        F.filter(doc["artists"], lambda a: _filled(a["artist"], "id", "name", "artistType")),
        lambda a: F.struct(
            _required(a["artist"]["id"], "an artist without id").alias("artist_id"),
            a["artist"]["name"].alias("name"),
            a["artist"]["artistType"].alias("artist_type"),
            artist_role(a["roles"], a["categories"]).alias("role"),
        ),
    )
    tags = F.transform(
        F.filter(doc["tags"], lambda t: _filled(t["tag"], "id", "name", "categoryName")),
        lambda t: F.struct(
            _required(t["tag"]["id"], "a tag without id").alias("tag_id"),
            t["tag"]["name"].alias("name"),
            t["tag"]["categoryName"].alias("category"),
        ),
    )
    others = [c for c in items.columns if c != item]
    return items.select(
        *others,
        F.struct(
            _required(doc["id"], "a song without id").alias("id"),
            _required(doc["name"], "a song without name").alias("title"),
            parse_date(doc["publishDate"]).alias("publish_date"),
            doc["songType"].alias("song_type"),
            pick_pv(doc["pvs"], NICO_SERVICE).alias("nico_video_id"),
            pick_pv(doc["pvs"], YOUTUBE_SERVICE).alias("youtube_video_id"),
        ).alias("song"),
        F.coalesce(artists, F.array()).alias("artists"),
        F.coalesce(tags, F.array()).alias("tags"),
        F.nullif(doc["originalVersionId"], F.lit(0)).alias("original_version_id"),
    )


def catalogue_frames(bundled: DataFrame, seq: Column) -> dict[str, DataFrame]:
    """Deduplicated updates for the six catalogue tables.

    Entities with several documents keep the one latest in ``seq``; links are sets.
    Within one document a later entry of an artist or tag wins.
    """
    row = bundled.withColumn("_seq", seq)
    songs = upserts.last_wins(row.select("song.*", "_seq"), ["id"], F.col("_seq")).drop("_seq")
    credits = row.select(
        F.col("song.id").alias("song_id"), "_seq", F.posexplode("artists").alias("_at", "a")
    ).select("song_id", "_seq", "_at", "a.*")
    labels = row.select(
        F.col("song.id").alias("song_id"), "_seq", F.posexplode("tags").alias("_at", "t")
    ).select("song_id", "_seq", "_at", "t.*")
    order = F.struct("_seq", "_at")
    artists = upserts.last_wins(
        credits.select(F.col("artist_id").alias("id"), "name", "artist_type", "_seq", "_at"), ["id"], order
    ).drop("_seq", "_at")
    tags = upserts.last_wins(
        labels.select(F.col("tag_id").alias("id"), "name", "category", "_seq", "_at"), ["id"], order
    ).drop("_seq", "_at")
    derived = upserts.last_wins(
        row.where(F.col("original_version_id").isNotNull()).select(
            F.col("original_version_id").alias("original_song_id"),
            F.col("song.id").alias("derived_song_id"),
            F.col("song.song_type").alias("relation_type"),
            F.col("song.publish_date").alias("derived_publish_date"),
            "_seq",
        ),
        ["original_song_id", "derived_song_id"],
        F.col("_seq"),
    ).drop("_seq")
    return {
        "songs": songs,
        "artists": artists,
        "tags": tags,
        "song_artists": credits.select("song_id", "artist_id", "role").dropDuplicates(),
        "song_tags": labels.select("song_id", "tag_id").dropDuplicates(),
        "derived_works": derived,
    }


def merge_entities(
    stored: dict[str, DataFrame], frames: dict[str, DataFrame], run_at: Column
) -> dict[str, DataFrame]:
    """Songs, artists and tags after the merge; again, only ``updated_at`` would change.

    ``stored`` needs to hold only the part of each table the updates fall in.
    """

    def stamped(name: str) -> DataFrame:
        base = stored[name]
        known = base.select("id", F.col("created_at").alias("_created"))
        fresh = frames[name].join(known, "id", "left").select(
            *frames[name].columns,
            F.coalesce("_created", run_at).alias("created_at"),
            run_at.alias("updated_at"),
        )
        return upserts.update_all(base, fresh, ["id"])

    return {
        "songs": stamped("songs"),
        "artists": stamped("artists"),
        "tags": upserts.upsert_tags(stored["tags"], frames["tags"]),
    }


def new_links(
    stored: dict[str, DataFrame], frames: dict[str, DataFrame], run_at: Column
) -> dict[str, DataFrame]:
    """Link rows to append. Known links stay, so a derived work keeps its first discovery.

    A derived work is linked only if its original is stored or part of this batch.
    """
    originals = stored["songs"].select("id").union(frames["songs"].select("id"))
    derived = upserts.linked(frames["derived_works"], originals, "original_song_id", "id")
    fresh = {
        "song_artists": frames["song_artists"],
        "song_tags": frames["song_tags"],
        "derived_works": derived.withColumn("discovered_at", run_at),
    }
    return {name: upserts.new_rows(stored[name], df, KEYS[name]) for name, df in fresh.items()}


def ingest_summary(frames: dict[str, DataFrame], songs_after: DataFrame) -> DataFrame:
    """One row of counts: rows per frame, derived links seen and linked."""
    names = ["songs", "artists", "tags", "song_artists", "song_tags"]
    counted = {n: frames[n] for n in names}
    counted["derived_linked"] = upserts.linked(
        frames["derived_works"], songs_after, "original_song_id", "id"
    )
    counted["derived_seen"] = frames["derived_works"]
    parts = None
    for name, frame in counted.items():
        part = frame.select(F.lit(name).alias("name"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy().agg(*[F.count_if(F.col("name") == n).alias(n) for n in counted])


def metric_rows(targets: DataFrame, readings: DataFrame, metric_date: Column, source: str) -> DataFrame:
    """Readings bound to songs by video id; songs sharing a video each get a row."""
    return targets.join(readings, targets["nico_video_id"] == readings["content_id"]).select(
        targets["id"].alias("song_id"),
        metric_date.alias("metric_date"),
        F.lit(source).alias("source"),
        "views",
        "comments",
        "mylists",
        "likes",
    )


def missing_targets(targets: DataFrame, readings: DataFrame) -> DataFrame:
    """Songs whose video the source no longer returns."""
    gone = targets["nico_video_id"] == readings["content_id"]
    return targets.join(readings, gone, "left_anti")


def metric_targets(songs: DataFrame) -> DataFrame:
    """Songs with a video to collect readings for."""
    return songs.where(F.col("nico_video_id").isNotNull()).select("id", "nico_video_id")
